"""Token alignment against a brute-force version that tokenises whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import sentence

from watchloom.llm import alignment

PATHS = alignment.tokenizer_path(alignment.TOKENIZER_A), alignment.tokenizer_path(alignment.TOKENIZER_B)
TEXTS = [
    None, "", " ", "a", " two  blanks ", "line\nline\n\n  deep\n\tx \n", "tab\there   nbsp　x", "it's 12 345, isn't it?!...",
    "\n\n", "ends in blank ", "日本語のテキスト 😀 naïve Ünïcödé", "a▁b has the blank sign", "<|endoftext|> <s> <unk> <0x41>",
    "---- -- ------ ====== aaaaaaa aaaaaaaaaaaa", "é \x00\x1f \x1c x\x85y", "def f(x):\n    return  x+1\r\n", "x" * 3000,
    sentence(7, 400), sentence(7, 400), sentence(8, 30) + "\n" + sentence(9, 30), "der die das und nicht el la los que",
]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Aligner(*PATHS)


def whole(tokenizers, text):
    """(a, b) ids with their byte ranges, from the whole text at once."""
    if not text:
        return [], []
    sides = []
    for ids, table in (
        (tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.bytes_a),
        (tokenizers.b.encode(text), tokenizers.bytes_b),
    ):
        at, spans = 0, []
        for n in ids:
            spans.append((n, at, at + len(table[n])))
            at += len(table[n])
        if b"".join(table[n] for n in ids) != (" " + text).encode():
            return [], []
        sides.append(spans)
    return sides


def brute(tokenizers, texts):
    held, rows = Counter(), []
    for text in texts:
        a, b = whole(tokenizers, text)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 3000 else []
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [
            ",".join(str(n) for n, _, e in a if low < e <= high) + "|" + ",".join(str(n) for n, _, e in b if low < e <= high)
            for low, high in zip([0, *ends], ends)
        ]
        held.update(set(links))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [
        (a, b, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
         hashlib.sha256(text.encode()).hexdigest() if text else "")
        for a, b, g, links, text in rows
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [1, 40, 1 << 17])
def test_against_brute_force(spark, tokenizers, monkeypatch, frequent):
    """With all pairs joined, some, and none."""
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.align(docs, *PATHS).collect()}
    assert got == dict(enumerate(brute(tokenizers, TEXTS)))


def test_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(30)
    rows = docs.collect()
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.align(spark.createDataFrame(rows, docs.schema), *PATHS).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute(tokenizers, [r.text for r in rows])))


def test_memory_is_bounded(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    own = alignment.Aligner(*PATHS)
    want = [r[:4] for r in brute(tokenizers, TEXTS)]
    for _ in range(2):
        got = [tuple(own.of_texts([t])[0][0]) for t in TEXTS]
        assert got == want


def test_odd_rows(spark, odd, empty):
    got = alignment.align(odd.withColumnRenamed("lang", "n_a").withColumnRenamed("source", "uid"), *PATHS)
    rows = got.collect()
    assert got.columns == ["doc_id", *NAMES] and len(rows) == odd.count()
    assert [r.n_a for r in rows if r.doc_id in (4, 5)] == [0, 0]
    twins = [tuple(r) for r in rows if r.doc_id == 8]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert alignment.align(empty, *PATHS).collect() == []
