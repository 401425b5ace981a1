"""Mixing sources to target weights: documents in hash order, prefix sums of their sizes, a cut at each source's budget.

Order within a source comes from a hash of id and text. Its leading digits are stretches: sums over (source, stretch)
give every stretch its start, and within a stretch a window gives every document its place. A source that holds most
rows is so spread over 65,536 stretches; only ids, sizes and keys are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import WORD, documents, word_array, word_count
from watchloom.session import materialize

#: Weights of the sources in code point order, repeating; the null source comes last.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
EPOCHS = 3
#: Leading hexadecimal digits of the key that name a stretch.
STRETCH = 4


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of ``sources`` (source, source_size): one row per source, the null source last.

    All sizes together are shared by weight; what a source cannot take beyond ``epochs`` times its size goes to the
    others by weight. Such shares are least(epochs * size, level * weight) with one level for all: sources are ordered
    by the level that fills them, and the level is found where what is left over fits the weights left over. The
    windows run over one row per source. Without any words all targets are 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("full_at", "number")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sources.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(pattern, F.pmod("number", F.lit(len(weights)))))
        .withColumn("most", F.col("source_size") * float(epochs))
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn(
            "open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
        .withColumn("level", F.col("rest") / F.col("open"))
        # The first source in this order that its share does not fill sets the level of all.
        .withColumn("found", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "number", "level")))
                    .over(everything))
    )
    target = F.least(F.col("most"), F.coalesce(F.col("found.level"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def before(value: str, within: list[str], *order: str) -> Column:
    """The sum of ``value`` over the earlier rows of a group."""
    window = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def mix(df: DataFrame, key: Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``df`` (with source and size) with source_size, target and taken: the words the mix takes of each row.

    Whole epochs come first; the rest of the target, rounded down, is cut from the order of ``key``, a hexadecimal
    text: rows before the cut are taken once more, the row at the cut in part, so that a source's taken words are its
    target to the word. Rows of equal key are ordered by size; those equal in both are alike. A null source is a
    source; a null size counts 0; an empty table gives none.
    """
    rows = df.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumn("__key", key)
    rows = rows.withColumn("__stretch", F.substring("__key", 1, STRETCH))
    sums = materialize(rows.groupBy("source", "__stretch").agg(F.sum("size").alias("__sum")), "mix-sums")
    goals = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, epochs)
    # In two levels of at most 256 rows each, so that no task has to walk over all stretches of a source.
    sums = sums.withColumn("__coarse", F.substring("__stretch", 1, STRETCH // 2))
    coarse = sums.groupBy("source", "__coarse").agg(F.sum("__sum").alias("__all"))
    coarse = coarse.select(
        F.col("source").alias("__s"), F.col("__coarse").alias("__c"), before("__all", ["source"], "__coarse").alias("__base")
    )
    fine = sums.withColumn("__in", before("__sum", ["source", "__coarse"], "__stretch"))
    starts = fine.join(
        coarse, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__coarse") == F.col("__c"))
    ).select("source", "__stretch", (F.col("__base") + F.col("__in")).alias("__start"))
    plan = starts.join(goals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = rows.withColumn("__before", before("size", ["source", "__stretch"], "__key", "size"))
    plan = plan.select(
        F.col("source").alias("__s"), F.col("__stretch").alias("__t"), "__start", "source_size", "target"
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__start") - F.col("__before")))
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__stretch") == F.col("__t")))
        .withColumn("taken", (whole * F.col("size") + cut).cast("long"))
        .drop("__s", "__t", "__key", "__stretch", "__start", "__before")
    )


def order_key() -> Column:
    """Hash of id and text; null parts are told apart from empty ones."""
    return F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
        F.coalesce(F.md5("text"), F.lit("-")),
    ))


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key().alias("k"))
    return mix(sized, F.col("k")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture itself: a row for every epoch of a document, the last of them cut to the words taken.

    Rows that the mix takes nothing of go, documents without a word among them. A cut text ends after its last word
    taken; n_chars follows the text.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    sized = docs.select(*columns, word_count(F.col("text")).alias("size"), order_key().alias("k"))
    taken = mix(sized, F.col("k"))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = taken.where("taken > 0").select(
        *columns, "size", "taken", F.explode(F.sequence(F.lit(1), times)).alias("epoch")
    )
    part = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    # Everything up to the end of the n-th word, as one anchored match.
    words = word_array(F.col("text"))
    cut = F.when(part < F.col("size"), F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    text = F.coalesce(cut, F.col("text"))
    n_chars = F.when(part < F.col("size"), F.length(cut).cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def sql() -> str:
    """The same in DuckDB; shares by repeated resharing, order by one window per source."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT] AS weight
  FROM d GROUP BY source),
levels AS (
  SELECT (SELECT sum(source_size)::DOUBLE / sum(weight) FROM s) AS level, 0 AS round
  UNION ALL
  SELECT (SELECT (sum(source_size)::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) FILTER (3 * source_size < level * weight), 0))
      / nullif(sum(weight) FILTER (3 * source_size >= level * weight), 0) FROM s), round + 1
  FROM levels WHERE round < 100 AND level IS NOT NULL),
best AS (SELECT max(level) AS level FROM levels),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, level * weight) AS target FROM s, best),
p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN (goal // source_size) * size
    + greatest(0, least(size, goal % source_size - before)) ELSE 0 END::BIGINT AS taken
FROM p"""


