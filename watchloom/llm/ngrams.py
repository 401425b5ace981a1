"""N-gram Jaccard join: an LSH forest of MinHash prefixes finds candidates, shared word n-grams verify them exactly.

Texts of equal n-gram sets are one class, and only classes are compared. Every tree sorts the classes by a label of MinHash
values; classes that share a prefix of the label are candidates. Prefixes start at the full label and are shortened until
the pairs at the threshold are found with the target recall. Each pair is verified in one place only, the first tree in
which it meets. Groups of candidates are cut into blocks of bounded size, and a task returns counts and a spanning
forest of its links, so a group of copies costs no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import WORD, components, documents, local_components, mix, text_slices
from watchloom.session import materialize

WORDS, THRESHOLD = 5, 0.8
TREES, LABEL, RECALL = 20, 8, 0.999
#: Classes of a block; a task compares two blocks.
BLOCK = 2048
#: Columns of n-grams compared at a time, which bounds the memory of a task.
COLUMNS = 4096


def depth(threshold: float, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold meet in some tree with the wanted probability.

    Shortened from the full label; one value is the shortest prefix.
    """
    length = label
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


class Shingles:
    """Hashed n-gram sets of texts."""

    def __init__(self, words: int) -> None:
        self.words = words

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of all texts in a row, number per text); each text's are distinct and sorted.

        A text of fewer words than an n-gram has all its words as its only one; a text without words has none.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
        word = hashes[coded.indices.to_numpy(zero_copy_only=False)][full]
        # Blank ends leave empty words, which are none.
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        n = self.words
        gram = np.zeros(len(word), dtype=np.uint64)
        factor = np.uint64(0x9E3779B97F4A7C15)
        for k in range(n):
            part = np.zeros(len(word), dtype=np.uint64)
            part[:len(word) - k] = word[k:]
            gram = gram * factor + mix(part + np.uint64(k + 1))
        gram = mix(gram)
        out, counts = [], np.zeros(len(texts), dtype=np.int64)
        for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if high - low >= n:
                own = np.unique(gram[low:high - n + 1])
            elif high > low:
                own = np.array([xxhash.xxh64_intdigest(word[low:high].tobytes(), seed=high - low)], dtype=np.uint64)
            else:
                continue
            counts[row] = len(own)
            out.append(own)
        return np.concatenate([*out, np.empty(0, np.uint64)]), counts


def minhashes(grams: np.ndarray, counts: np.ndarray, functions: int) -> np.ndarray:
    """(text, function): the least value of each function over the n-grams; texts without n-grams are left out."""
    rng = np.random.default_rng(5)
    odd = (rng.integers(0, 1 << 31, functions, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    add = rng.integers(0, 1 << 32, functions, dtype=np.uint32)
    some = counts[counts > 0]
    begins = np.cumsum(some) - some
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(some), functions), dtype=np.uint32)
    if len(some):
        for f in range(functions):
            out[:, f] = np.minimum.reduceat(x * odd[f] + add[f], begins)
    return out


def signatures(df: DataFrame, words: int, trees: int, length: int) -> DataFrame:
    """doc_id, th, th2 (which tell texts apart), n (n-grams), key (of the n-gram set) and nodes: the place in each tree."""
    source = df.select("doc_id", F.xxhash64("text").alias("th"), F.hash("text").alias("th2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for part in text_slices(batch, "text"):
                grams, counts = shingles.of_texts(part.column("text"))
                least = minhashes(grams, counts, trees * length).reshape(-1, trees, length)
                # The prefix as one number; the tree stands in the leading bits, so that trees never mix.
                node = np.zeros(least.shape[:2], dtype=np.uint64)
                for k in range(length):
                    node = mix(node + least[:, :, k].astype(np.uint64) + np.uint64(1))
                node = (node >> np.uint64(7)) | (np.arange(trees, dtype=np.uint64) << np.uint64(57))[None]
                ends = np.cumsum(counts)
                keys = [
                    xxhash.xxh128_digest(grams[end - n:end].tobytes()) if n else None
                    for end, n in zip(ends.tolist(), counts.tolist(), strict=True)
                ]
                where = np.cumsum(counts > 0) - 1
                nodes = [node[w].astype(np.int64) if n else None for w, n in zip(where, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), part.column("th2"), pa.array(counts),
                     pa.array(keys, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "th2", "n", "key", "nodes"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, th long, th2 int, n long, key binary, nodes array<long>")


def shared(flat: np.ndarray, owner: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n-grams that the texts ``first`` share with the texts ``second``, from n-grams and their texts."""
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(first), len(second)), dtype=np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        has = np.zeros((n, min(COLUMNS, width - low)), dtype=np.float32)
        has[owner[here], column[here] - low] = 1
        total += has[first] @ has[second].T
    return total


def verify(rows: pa.Table, shingles: Shingles, threshold: float) -> pa.Table | None:
    """Links of one cell: per class the number of texts linked, and a class it hangs together with.

    Cells come with the node, the two blocks and whether a row stands in the second one.
    """
    n = rows.num_rows
    if n < 2:
        return None
    grams, counts = shingles.of_texts(rows.column("text").combine_chunks())
    second = rows.column("second").to_numpy(zero_copy_only=False)
    same = rows.column("low")[0] == rows.column("high")[0]
    left = np.flatnonzero(~second)
    right = left if same else np.flatnonzero(second)
    both = shared(grams, np.repeat(np.arange(n), counts), left, right, n)
    union = counts[left][:, None] + counts[right][None] - both
    found = both >= threshold * union - 1e-6
    if same:
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    i, j = left[i], right[j]
    # The pair counts here only if this is the first tree in which its prefixes agree.
    trees = rows.column("nodes").combine_chunks().flatten().to_numpy().reshape(n, -1)
    tree = int(np.uint64(rows.column("node")[0].as_py() & ((1 << 64) - 1)) >> np.uint64(57))
    firsts = np.empty(len(i), dtype=bool)
    for low in range(0, len(i), 1 << 16):
        s = slice(low, low + (1 << 16))
        equal = trees[i[s]] == trees[j[s]]
        firsts[s] = equal[:, tree] & ~equal[:, :tree].any(axis=1)
    i, j = i[firsts], j[firsts]
    if not len(i):
        return None
    copies = rows.column("copies").to_numpy()
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    root = local_components(n, i, j)
    hit = np.flatnonzero(links)
    keys = rows.column("key").combine_chunks()
    return pa.table({
        "key": keys.take(pa.array(hit)), "links": pa.array(links[hit].astype(np.int64)),
        "other": keys.take(pa.array(root[hit])),
    })


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``names``, from batches in that order; a run may reach over batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(key[low].tolist())
            if held and own != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(low, high - low))
            last = own
    if held:
        yield pa.concat_tables(held)


def join(
    df: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL
) -> DataFrame:
    """doc_id, th, th2, class_id, n_links, kept of ``df`` (doc_id, text): one row per row.

    Linked are texts whose sets of word n-grams have a Jaccard similarity of at least ``threshold``; class_id is the
    smallest doc_id that links reach, n_links the number of other rows linked directly, kept whether the row is its
    class's smallest. Texts that are null or without words link with nothing. Copies link with each other; null ids take
    part and are smallest only among themselves. Rows of equal id are rows of their own. An empty table gives none.
    """
    length = depth(threshold, trees, LABEL, recall)
    spark = df.sparkSession
    rows = materialize(signatures(df, words, trees, length), "signatures")
    classes = materialize(
        rows.where("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.any_value("nodes").alias("nodes"),
            F.min(F.struct("th", "th2")).alias("t"),
        ), "ngram-classes",
    )
    met = classes.select("key", F.explode("nodes").alias("node"))
    h = F.xxhash64("key")
    full = met.groupBy("node").agg(
        F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")
    ).where("size > 1")
    # Trees often hold the same group; the first of them stands for all.
    full = full.groupBy("size", "x", "s").agg(F.min("node").alias("node")).select("node", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cells = met.join(full, "node").select(
        "key", "node", F.pmod(F.xxhash64("key", "node"), blocks).cast("int").alias("own"), blocks.alias("blocks")
    ).select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).select(
        "key", "node", F.least("own", "k").alias("low"), F.greatest("own", "k").alias("high"),
        (F.col("own") > F.col("k")).alias("second"),
    )
    cells = materialize(cells, "ngram-cells")
    wanted = classes.join(cells.select("key").distinct(), "key", "left_semi")
    # One text for each class that has candidates.
    texts = df.groupBy(F.xxhash64("text").alias("th"), F.hash("text").alias("th2")).agg(F.any_value("text").alias("text"))
    chosen = wanted.select("key", "copies", "nodes", F.col("t.th").alias("th"), F.col("t.th2").alias("th2")).join(
        texts, ["th", "th2"]
    ).drop("th", "th2")
    placed = cells.join(chosen, "key").select("node", "low", "high", "second", "key", "copies", "nodes", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for group in groups_of(batches, ["node", "low", "high"]):
            found = verify(group, shingles, threshold)
            if found is not None:
                yield from found.to_batches()

    dealt = placed.repartition(F.col("node"), F.col("low"), F.col("high")).sortWithinPartitions("node", "low", "high")
    links = materialize(dealt.mapInArrow(check, "key binary, links long, other binary"), "ngram-links")
    edges = links.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b"))
    roots = components(edges, "ngram-components")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "doc", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").join(
        counts, "key", "left"
    ).select(
        "key", "doc", F.coalesce("root", "key").alias("root"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    known = materialize(known, "ngram-known")
    least = known.groupBy("root").agg(F.min("doc").alias("class_id"))
    verdict = known.join(least, "root").select("key", "class_id", "n_links")
    own = rows.select("doc_id", "th", "th2", "key")
    single = own.where("key IS NULL").select(
        "doc_id", "th", "th2", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    linked = own.where("key IS NOT NULL").join(verdict, "key").select("doc_id", "th", "th2", "class_id", "n_links")
    out = linked.union(single)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id. Rows that repeat in all columns count once."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    own = docs.select(*columns, F.xxhash64("text").alias("th"), F.hash("text").alias("th2"))
    found = join(docs.select("doc_id", "text")).where("kept").select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("th2").alias("t2")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("th2") == F.col("t2"))
    return own.join(found, same, "left_semi").distinct().select(*columns)


def sql() -> str:
    """Exact sets of n-grams, all pairs that share one, and what links reach."""
    return f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (
  SELECT DISTINCT r, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)
  UNION ALL SELECT r, list_aggregate(w, 'string_agg', ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-6),
t AS (SELECT a AS node, a AS seen FROM l UNION SELECT t.node, l.b FROM t JOIN l ON l.a = t.seen),
c AS (SELECT node, min(doc_id) AS class_id FROM t JOIN w ON w.r = t.seen GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(k.n, 0)::BIGINT AS n_links,
  coalesce(class_id, doc_id) = doc_id AS kept
FROM w LEFT JOIN c ON c.node = w.r LEFT JOIN k ON k.a = w.r"""
