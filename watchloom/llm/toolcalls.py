"""Tool-call linking for chat data: calls and results joined by identifier, put in order, checked, and written as JSON.

Built-in expressions only. Messages are rows; nothing gathers a conversation into one row, so its length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import materialize

#: What an assistant message with calls, and what a tool message with a result look like.
CALLS = "tool_calls array<struct<id string, name string, after string, arguments map<string, string>>>"
RESULT = "tool_call_id string, content string"

#: What is allowed as a value of each type, as patterns over the text of the JSON value.
TYPES = {
    "integer": r"^-?(0|[1-9][0-9]*)$",
    "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "boolean": r"^(true|false)$",
    "string": r"^[\s\S]*$",
}


def calls_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, place, call_id, name, after, arguments: the calls in assistant messages.

    A call's arguments come as a map from name to value; ``after`` names a call of the same conversation whose result it
    needs. Texts that are no such JSON hold no call.
    """
    parsed = F.from_json("text", CALLS)
    return (
        messages.where((F.col("role") == "assistant") & F.ltrim("text").startswith("{"))
        .select("conv_id", "turn", F.posexplode(parsed["tool_calls"]).alias("place", "c"))
        .select("conv_id", "turn", "place", F.col("c.id").alias("call_id"), "c.name", "c.after", "c.arguments")
    )


def results_of(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content: the tool messages."""
    parsed = F.from_json("text", RESULT)
    return messages.where((F.col("role") == "tool") & F.ltrim("text").startswith("{")).select(
        "conv_id", "turn", parsed["tool_call_id"].alias("call_id"), parsed["content"].alias("content")
    )


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with problem, why the arguments don't meet the schema of the tool, or null, and the schema as params.

    ``schemas`` has a row per parameter: tool, param, type (integer, number, boolean, string) and required. It is a
    description of tools, gathered into one row per tool. The first problem by name counts; an unknown tool is one. A
    value's type is judged by its text.
    """
    tools = schemas.groupBy(F.col("tool").alias("name")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", "type")))).alias("params"),
        F.sort_array(F.collect_list(F.when(F.col("required"), F.col("param")))).alias("needed"),
    )
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    given = F.coalesce(F.col("arguments"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    names = F.array_sort(F.map_keys(given))
    missing = F.filter("needed", lambda p: given[p].isNull())
    unknown = F.filter(names, lambda p: ~F.array_contains(F.map_keys("params"), p))
    wrong = F.filter(
        names, lambda p: F.col("params")[p].isNotNull() & given[p].isNotNull() & ~F.regexp_like(given[p], pattern[F.col("params")[p]])
    )
    problem = (
        F.when(F.col("params").isNull(), F.lit("unknown tool"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.get(missing, F.lit(0))))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.get(unknown, F.lit(0))))
        .when(F.size(wrong) > 0, F.concat(F.lit("type of "), F.get(wrong, F.lit(0))))
    )
    return calls.join(tools, "name", "left").withColumn("problem", problem).drop("needed")


def canonical(column: Column) -> Column:
    """A string column as a JSON string."""
    # A one-element array is JSON that every writer puts the same way; its brackets go.
    text = F.to_json(F.array(column))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for a call that needs no other, else one more than the call it comes after.

    Each round doubles the stretch that a call knows about, so that a chain of n calls takes log n rounds, however
    many rows a conversation has. Calls on a circle get no level. A call that is not there counts as none.
    """
    ids = calls.select("conv_id", "call_id")
    first = calls.alias("c").join(
        ids.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi")),
        F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("after") == F.col("pi")), "left",
    ).select("conv_id", "call_id", F.col("pi").alias("up"), F.when(F.col("pi").isNull(), 0).otherwise(1).alias("steps"))
    known = materialize(first, "call-levels")
    left, total = known.where("up IS NOT NULL").count(), None
    rounds = 0
    while left:
        ups = known.select(
            F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), F.col("up").alias("pu"), F.col("steps").alias("ps")
        )
        known = materialize(
            known.join(
                ups, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("up") == F.col("pi")), "left"
            ).select(
                "conv_id", "call_id", F.col("pu").alias("up"),
                (F.col("steps") + F.coalesce("ps", F.lit(0))).alias("steps"),
            ), "call-levels",
        )
        rounds += 1
        before, left = left, known.where("up IS NOT NULL").count()
        if total is None:
            total = known.count()
        # What is still open after so many doublings that every chain must have ended goes in circles.
        if 1 << rounds > total:
            break
    return known.where("up IS NULL").select("conv_id", "call_id", F.col("steps").cast("int").alias("level"))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call and per stray result of ``messages`` (conv_id, turn, role, text).

    conv_id, call_id, turn, place, result_turn, level, status, json. Rows in the order level, turn, place put every call
    behind the one it needs. Of several calls with one id the first by turn and place counts, of several results the
    first by turn and content; others are ``repeated call`` and ``repeated result``. Status otherwise: ``ok``; the
    problem of the arguments; ``circle`` for calls that need each other; ``no result``; ``early result`` if the result
    stands before the call; ``no call`` for a result without one. A call or result without id is never linked.
    json is canonical: sorted keys, no blanks, null for what is missing. Null, empty and other texts hold nothing.
    """
    calls, results = calls_of(messages), results_of(messages)
    # The first call and the first result of an id, by partial aggregation: an id that many rows share stays one row.
    place = F.struct("turn", "place")
    every = materialize(checked(calls, schemas).withColumn("spot", place), "calls")
    firsts = every.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("spot").alias("first"))
    joined = every.join(
        firsts.select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "first"),
        F.col("conv_id").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi")), "left",
    ).withColumn("is_first", F.coalesce(F.col("spot") == F.col("first"), F.lit(False))).drop("fc", "fi", "first")
    joined = materialize(joined, "calls-numbered")
    # Rows that repeat a message repeat its calls; one of them stands for all.
    own = joined.where("is_first").groupBy("conv_id", "call_id").agg(F.min("after").alias("after"))
    ranked = levels(own)
    answer = F.struct("turn", "content")
    firsts = results.where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(answer).alias("r"))
    firsts = firsts.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), "r")
    ranked = ranked.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level")
    linked = joined.join(
        firsts, F.col("is_first") & F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left"
    ).join(
        ranked, F.col("is_first") & F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("li")), "left"
    )
    status = (
        F.when(F.col("call_id").isNull(), F.lit("no id"))
        .when(~F.col("is_first"), F.lit("repeated call"))
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("level").isNull(), F.lit("circle"))
        .when(F.col("r").isNull(), F.lit("no result"))
        .when(F.col("r.turn") < F.col("turn"), F.lit("early result"))
        .otherwise(F.lit("ok"))
    )
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def value(k: Column) -> Column:
        """What the schema calls a number or a truth value stands bare, everything else is a string."""
        given, kind = F.col("arguments")[k], F.col("params")[k]
        bare = kind.isin("integer", "number", "boolean") & F.regexp_like(given, pattern[kind])
        return F.when(bare, given).otherwise(F.coalesce(canonical(given), F.lit("null")))

    pairs = F.transform(
        F.array_sort(F.map_keys("arguments")), lambda k: F.concat(canonical(k), F.lit(":"), value(k))
    )
    null = F.lit("null")
    body = F.concat(
        F.lit('{"after":'), F.coalesce(canonical(F.col("after")), null),
        F.lit(',"arguments":{'), F.coalesce(F.array_join(pairs, ","), F.lit("")),
        F.lit('},"id":'), F.coalesce(canonical(F.col("call_id")), null),
        F.lit(',"name":'), F.coalesce(canonical(F.col("name")), null),
        F.lit(',"result":'), F.coalesce(canonical(F.col("r.content")), null), F.lit("}"),
    )
    out = linked.select(
        "conv_id", "call_id", "turn", "place", F.col("r.turn").alias("result_turn"), "level", status.alias("status"),
        body.alias("json"),
    )
    ids = own.select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oi"))
    same = F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("oi"))
    stray = (
        results.join(ids, same, "left")
        .join(firsts, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
        .withColumn("used", F.coalesce(answer.eqNullSafe(F.col("r")), F.lit(False)))
        .where(F.col("oi").isNull() | ~F.col("used"))
    )
    return out.unionByName(stray.select(
        "conv_id", "call_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("int").alias("place"),
        F.col("turn").alias("result_turn"), F.lit(None).cast("int").alias("level"),
        F.when(F.col("call_id").isNull(), F.lit("no id")).when(F.col("oi").isNull(), F.lit("no call"))
        .otherwise(F.lit("repeated result")).alias("status"),
        F.concat(
            F.lit('{"id":'), F.coalesce(canonical(F.col("call_id")), null),
            F.lit(',"result":'), F.coalesce(canonical(F.col("content")), null), F.lit("}"),
        ).alias("json"),
    ))


# -- the query -----------------------------------------------------------------------------


def with_tools(conversations: DataFrame) -> DataFrame:
    """The conversations with tool messages derived from their turns, as the table holds none of its own.

    Every line of a user's turn becomes a call that looks it up. It needs the call before it: that of the line above, or
    the last one of the user's turn before, so a conversation is one chain. The result is the text of the assistant's turn
    that follows; where none follows there is no result. So that every case occurs, the length of a line decides: one in
    seven gives its number of words as text, one in eleven forgets it, one in thirteen names a tool that isn't there, one in
    seventeen gets its result too early, one in nineteen gets none, one in 23 is called again, one in 29 has a stray
    result, one in 31 a second one; and where the length of a turn is a multiple of 37 its first call needs its last.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x) != "")
    user = conversations.where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", "text", lines.alias("lines"))
    answers = conversations.where("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.min("text").alias("answer"))
    former = user.groupBy("conv_id", (F.col("turn") + 2).alias("turn")).agg(F.max(F.size("lines")).alias("before"))
    # A table of its own: what follows takes lines apart in several ways.
    user = user.join(answers, ["conv_id", "turn"], "left").join(former, ["conv_id", "turn"], "left")
    user = materialize(user.withColumnRenamed("turn", "spoken"), "user-turns")

    def name(turn: Column, place: Column) -> Column:
        return F.concat(F.lit("call_"), turn, F.lit("_"), place)

    def call(line: Column, place: Column) -> Column:
        n, turn = F.length(line), F.col("spoken")
        words = F.size(F.split(F.btrim(line), r"\s+"))
        after = (
            F.when(place > 0, name(turn, place - 1)).when(F.length("text") % 37 == 0, name(turn, F.size("lines") - 1))
            .when(F.col("before") > 0, name(turn - 2, F.col("before") - 1))
        )
        return F.struct(
            name(turn, place).alias("id"), F.when(n % 13 == 0, F.lit("gone")).otherwise(F.lit("lookup")).alias("name"), after.alias("after"),
            F.struct(
                line.alias("query"), F.when(n % 11 != 0, F.when(n % 7 == 0, F.lit("many")).otherwise(words.cast("string"))).alias("words")
            ).alias("arguments"),
        )

    def message(calls: Column) -> Column:
        return F.to_json(F.struct(calls.alias("tool_calls")))

    def result(call_id: Column, content: Column) -> Column:
        return F.to_json(F.struct(call_id.alias("tool_call_id"), content.alias("content")))

    turn = F.col("spoken") * 4
    calls = user.where(F.size("lines") > 0).select(
        "conv_id", (turn + 1).alias("turn"), F.lit("assistant").alias("role"), message(F.transform("lines", call)).alias("text")
    )
    single = user.select("*", F.posexplode("lines").alias("place", "line")).withColumn("n", F.length("line"))
    own = name(F.col("spoken"), F.col("place"))
    again = single.where("n % 23 = 0").select(
        "conv_id", (turn + 2).alias("turn"), F.lit("assistant").alias("role"), message(F.array(call(F.col("line"), F.col("place")))).alias("text")
    )
    answered = single.where("n % 19 <> 0 AND answer IS NOT NULL")
    results = answered.select(
        "conv_id", F.when(F.col("n") % 17 == 0, turn).otherwise(turn + 2).alias("turn"), F.lit("tool").alias("role"),
        result(own, F.col("answer")).alias("text"),
    )
    second = answered.where("n % 31 = 0").select(
        "conv_id", (turn + 3).alias("turn"), F.lit("tool").alias("role"), result(own, F.lit("again")).alias("text")
    )
    stray = single.where("n % 29 = 0").select(
        "conv_id", (turn + 3).alias("turn"), F.lit("tool").alias("role"),
        result(F.concat(F.lit("stray_"), "spoken", F.lit("_"), "place"), F.col("line")).alias("text"),
    )
    plain = conversations.select("conv_id", (F.col("turn") * 4 + 3).alias("turn"), "role", "text")
    out = plain
    for part in (calls, again, results, second, stray):
        out = out.unionByName(part)
    return out


def tool_schemas(spark: SparkSession) -> DataFrame:
    """The tools of ``with_tools``."""
    return spark.sql(
        "SELECT * FROM VALUES ('lookup', 'query', 'string', true), ('lookup', 'words', 'integer', true)"
        " AS t(tool, param, type, required)"
    )


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link(with_tools(talks), tool_schemas(spark))


def sql() -> str:
    """The same from the turns themselves: what each derived call and result must come to."""
    return r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines
  FROM conversations WHERE role = 'user' AND text IS NOT NULL),
v AS (
  SELECT u.*, (SELECT max(len(p.lines)) FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2) AS before,
    (SELECT min(a.text) FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant') AS answer
  FROM u),
c AS (
  SELECT conv_id, turn, i - 1 AS place, lines[i] AS line, length(lines[i]) AS n, 'call_' || turn || '_' || (i - 1) AS call_id,
    CASE WHEN i > 1 THEN 'call_' || turn || '_' || (i - 2)
      WHEN length(text) % 37 = 0 THEN 'call_' || turn || '_' || (len(lines) - 1)
      WHEN before > 0 THEN 'call_' || (turn - 2) || '_' || (before - 1) END AS after,
    CASE WHEN length(lines[i]) % 19 <> 0 THEN answer END AS answer,
    CASE WHEN length(lines[i]) % 13 = 0 THEN 'gone' ELSE 'lookup' END AS name,
    CASE WHEN length(lines[i]) % 11 <> 0 THEN CASE WHEN length(lines[i]) % 7 = 0 THEN 'many'
      ELSE len(regexp_split_to_array(trim(lines[i]), '\s+'))::VARCHAR END END AS given
  FROM v, unnest(range(1, len(lines) + 1)) AS t(i)),
d AS (
  SELECT *, CASE WHEN answer IS NOT NULL THEN CASE WHEN n % 17 = 0 THEN turn * 4 ELSE turn * 4 + 2 END END AS result_turn,
    '{"after":' || coalesce('"' || after || '"', 'null') || ',"arguments":{"query":' || to_json(line)
      || CASE WHEN given IS NULL THEN '' WHEN given = 'many' OR name = 'gone' THEN ',"words":"' || given || '"'
        ELSE ',"words":' || given END || '},"id":"' || call_id || '","name":"' || name || '","result":' AS body
  FROM c),
l AS (
  SELECT conv_id, call_id, 0 AS level FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.after)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.after = l.call_id)
SELECT d.conv_id, d.call_id, turn * 4 + 1 AS turn, place::INT AS place, result_turn, level::INT AS level,
  CASE WHEN name = 'gone' THEN 'unknown tool' WHEN given IS NULL THEN 'missing words' WHEN given = 'many' THEN 'type of words'
    WHEN level IS NULL THEN 'circle' WHEN result_turn IS NULL THEN 'no result'
    WHEN result_turn < turn * 4 + 1 THEN 'early result' ELSE 'ok' END AS status,
  body || CASE WHEN answer IS NULL THEN 'null' ELSE to_json(answer)::VARCHAR END || '}' AS json
FROM d LEFT JOIN l ON l.conv_id = d.conv_id AND l.call_id = d.call_id
UNION ALL
SELECT conv_id, call_id, turn * 4 + 2, 0, NULL, NULL, 'repeated call', body || 'null}' FROM d WHERE n % 23 = 0
UNION ALL
SELECT conv_id, call_id, NULL, NULL, turn * 4 + 3, NULL, 'repeated result', '{"id":"' || call_id || '","result":"again"}'
FROM d WHERE n % 31 = 0 AND answer IS NOT NULL
UNION ALL
SELECT conv_id, 'stray_' || turn || '_' || place, NULL, NULL, turn * 4 + 3, NULL, 'no call',
  '{"id":"stray_' || turn || '_' || place || '","result":' || to_json(line) || '}' FROM d WHERE n % 29 = 0"""
