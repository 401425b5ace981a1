"""Packing, mixing, tool calls, the pipeline, and the SQL of all queries that have one."""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import sentence
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, connect
from watchloom.llm import mixing, ngrams, packing, queries, toolcalls

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_against_sql(spark, name):
    assert compare(queries.bound()[name](spark, SF), connect(SF), queries.all_sql()[name]) == "ok"


def test_names():
    numbers = [int(n[2:].split("_")[0]) for n in queries.bound()]
    assert sorted(numbers) == list(range(1, 11)) and set(queries.all_sql()) <= set(queries.bound())


# -- packing -------------------------------------------------------------------------------


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [0]


def check_packed(rows, texts):
    """Pieces are whole and placed without gap or overlap."""
    ids = {k: np.array(whole_ids(t), dtype="<u4") for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + packing.CAPACITY]
        assert r.length == len(own) and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.start == r.piece * packing.CAPACITY
        by_doc[r.doc_id].append(r.piece)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for k, own in ids.items():
        assert sorted(set(by_doc[k])) == list(range(-(-len(own) // packing.CAPACITY)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by_sequence), sum(len(i) for i in ids.values())


def test_packing_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, tokens = check_packed(packing.op6_best_fit(spark, SF).collect(), texts)
    assert used <= 1.02 * tokens / packing.CAPACITY + 1


def test_packing_edge_cases(spark, odd, odd_rows, empty):
    rows = packing.pack_documents(odd.withColumn("length", F.lit(1)).withColumn("rank", F.lit(1)), packing.tokenizer_path()).collect()
    # The two rows without id hold 50 words and nothing; both are told apart by their length.
    rows = [r if r.doc_id is not None else type(r)(**(r.asDict() | {"doc_id": -1 if r.length > 1 else -2})) for r in rows]
    texts = {r[0] if r[0] is not None else (-1 if r[1] else -2): r[1] for r in odd_rows}
    check_packed(rows, texts)
    # Each repeated row is packed on its own, a null text is its closing 0.
    assert sum(r.doc_id == 8 for r in rows) == 2 and sum(r.doc_id < 0 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id == 4] == [1]
    assert packing.pack_documents(empty, packing.tokenizer_path()).count() == 0


def test_words_give_the_ids_of_the_text():
    rnd = random.Random(2)
    atoms = ["Word", "naïve", "ÉCOLE", "don't", "it's", "x.", "y,,", "<|endoftext|>", "<|endoftext|>.", "<|ENDOFTEXT|>", "1,000.50", "a|b", "?!", " ", "\n", " ",
             "é", "́", "ΣΑΣ", "İ", "😀", "'s", "'S", "abc's.", "\x1c", " "]
    import pyarrow as pa

    texts = ["".join(rnd.choice(atoms) + rnd.choice(["", " ", "  "]) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    ids, counts = packing.word_ids(packing.tokenizer_path()).of_texts(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at:at + n].tolist() == whole_ids(text)[:-1], repr(text)
        at += n


@pytest.mark.parametrize("seed", range(6))
def test_fillings(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length in rng.integers(1, capacity + 1, 400):
        counts[length] += int(rng.integers(1, 50))
    made = np.zeros_like(counts)
    sequences = 0
    for taken, times in packing.fillings(counts, capacity):
        assert sum(taken) <= capacity
        for length in taken:
            made[length] += times
        sequences += times
    assert (made == counts).all()
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    large = int(counts[capacity // 2 + 1:].sum())
    assert sequences <= 1.05 * max(least, large) + 1
    ranks = Counter()
    for length, first, last, _, _ in sorted(packing.places(counts, capacity)):
        assert first == ranks[length]
        ranks[length] = last


def test_two_fit_beats_greedy():
    counts = np.zeros(11, dtype=np.int64)
    # 6 + 3 leaves a gap of one; in place of 3 the pieces 2 and 2 fit exactly.
    counts[[6, 3, 2]] = [1, 1, 2]
    first, _ = packing.fillings(counts, 10)[0]
    assert sorted(first) == [2, 2, 6]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, sentence(1, 30)), (2, sentence(2, 900)), (3, None)], "doc_id long, text string")
    cut = packing.pieces(docs, packing.tokenizer_path())
    packed = packing.pack(cut, [F.col("doc_id"), F.col("piece")])
    got = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    want = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.sequence_id, r.offset)):
        want[r.sequence_id] += list(r.ids)
    assert got == want and all(len(v) <= packing.CAPACITY for v in got.values())


# -- mixing --------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), most=3):
    """Resharing as told: what exceeds the limit goes to the others by weight until nothing does."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        shares = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if shares[s] > most * sizes[s]]
        if not over:
            return fixed | shares
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a", "b", "c", "d", None, "é"]) if k % 3 else "a", rnd.choice([0, 1, 5, 40, 1000])) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("level", F.lit(1))
    got = mixing.mix(df, F.md5(F.col("doc_id").cast("string"))).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = water(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s, goal in want.items():
        assert goal - 1 <= taken[s] <= goal


def test_mixing_edge_cases(spark, odd, empty):
    rows = mixing.stage(spark, odd, "").collect()
    assert all(r.text for r in rows) and not any(r.doc_id in (4, 5, 6) for r in rows)
    again = mixing.stage(spark, odd.repartition(3), "").collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)
    assert mixing.stage(spark, empty, "").count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r.target, r.taken) for r in mixing.mix(zero, F.lit("0")).collect()] == [(0.0, 0)] * 2


# -- tool calls ----------------------------------------------------------------------------


def call(i, name="add", after=None, **arguments):
    body = {"id": i, "name": name, "arguments": arguments} | ({"after": after} if after else {})
    return body


def test_tool_calls(spark, empty):
    def calls(*c):
        return json.dumps({"tool_calls": list(c)})

    def result(i, content):
        return json.dumps({"tool_call_id": i, "content": content})

    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", calls(call("c", after="b", a=1, b=2.5), call("a", b=3, a=-7))),
        (1, 2, "assistant", calls(call("b", after="a", a="x", b=1))), (1, 3, "tool", result("a", 'quo"te\n')), (1, 4, "tool", result("c", "9")),
        (1, 5, "tool", result("a", "again")), (1, 6, "tool", result("zz", "stray")), (1, 7, "assistant", calls(call("a", a=1, b=1))),
        (2, 1, "assistant", calls(call("p", after="q", a=1, b=1), call("q", after="p", a=1, b=1), call("r", a=1), call("s", "gone"), call("t", a=1, b=1, z=0))),
        (3, 1, "tool", result("early", "x")), (3, 2, "assistant", calls(call("early", a=1, b=1))),
        (4, 1, "assistant", "{broken"), (4, 2, "assistant", None), (4, 3, "tool", ""), (None, 1, "assistant", calls(call("n", a=1, b=1))), (None, 2, "tool", result("n", "ok")),
        (5, 1, "assistant", calls(call(None, a=1, b=1))), (5, 2, "tool", result(None, "x")),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit(1))
    schemas = spark.createDataFrame(
        [("add", "a", "integer", True), ("add", "b", "number", True)], "tool string, param string, type string, required boolean"
    )
    got = toolcalls.link(messages, schemas).collect()
    status = Counter((r.conv_id, r.call_id, r.status) for r in got)
    assert status == Counter([
        (1, "a", "ok"), (1, "b", "type of a"), (1, "c", "ok"), (1, "a", "repeated call"), (1, "a", "repeated result"), (1, "zz", "no call"),
        (2, "p", "circle"), (2, "q", "circle"), (2, "r", "missing b"), (2, "s", "unknown tool"), (2, "t", "unknown z"),
        (3, "early", "early result"), (None, "n", "ok"), (5, None, "no id"), (5, None, "no id"),
    ])
    level = {(r.conv_id, r.call_id): r.level for r in got if r.turn is not None and r.level is not None}
    assert (level[1, "a"], level[1, "b"], level[1, "c"]) == (0, 1, 2)
    first = next(r for r in got if r.conv_id == 1 and r.call_id == "a" and r.status == "ok")
    assert first.json == '{"after":null,"arguments":{"a":-7,"b":3},"id":"a","name":"add","result":"quo\\"te\\n"}'
    assert all(json.loads(r.json) is not None for r in got)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(none, schemas).count() == 0


def test_long_chain(spark):
    rows = [(1, k, "assistant", json.dumps({"tool_calls": [call(f"c{k}", after=f"c{k + 1}", a=1, b=1)]})) for k in range(70)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = toolcalls.calls_of(messages)
    assert {r.call_id: r.level for r in toolcalls.levels(own).collect()} == {f"c{k}": 69 - k for k in range(70)}


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    base = sentence(1, 80)
    near = " ".join("new" if k == 40 else w for k, w in enumerate(base.split()))
    rows = [(1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, near, "en", "a", 1), (4, "1234 !!", "en", "a", 1), (5, None, "en", "c", 1)]
    rows += [(10 + k, sentence(20 + k, 60), ("en", "de")[k % 2], "abc"[k % 3], 1) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "source_mix", "best_fit"]
    assert 4 not in seen[0] and 5 not in seen[0]
    assert 1 in seen[1] and 2 not in seen[1]
    assert len(seen[2] & {1, 2, 3}) == 1
    assert seen[4] == seen[3] <= seen[2]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(whole.collect(), key=repr) == sorted(docs.collect(), key=repr)


def test_stage_keeps_one_of_each_group(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    joined = ngrams.join(docs.select("doc_id", "text")).collect()
    kept = {r.doc_id for r in ngrams.stage(spark, docs, SF).collect()}
    assert kept == {r.class_id for r in joined} and len(rows) == len(joined)
