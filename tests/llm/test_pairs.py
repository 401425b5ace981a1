"""Line dedup, n-gram join and vector dedup against brute force."""

from __future__ import annotations

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest_llm import components_of, sentence
from pyspark.sql import functions as F

from watchloom.llm import common, lines, neardup, ngrams


# -- components ----------------------------------------------------------------------------


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(5, 4), (4, 3), (3, 2), (9, 8)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 29)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.components(df, "t").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: r for n, r in components_of(nodes, edges).items()}


# -- lines ---------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


mask, golden = 2**64 - 1, 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & mask
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & mask
    return x ^ x >> 33


def sketch_of(line):
    words = {xxhash.xxh64_intdigest(w[:lines.STEM]) for w in line.split(" ")}
    return [min(mixed((w + (k + 1) * golden) & mask) for w in words) >> 32 & 255 for k in range(16)]


def print_of(line, k):
    """One SimHash, bit by bit: the heaviest words vote with their weights."""
    seed, votes = (2 * k + 1) * golden & mask, []
    for w in {w[:lines.STEM] for w in line.split(" ")}:
        own = xxhash.xxh64_intdigest(w)
        u = ((mixed(own ^ seed) >> 11) + 1) / 2.0**53
        votes.append((-((u / len(w) ** lines.LONG) ** -lines.TAIL), own, mixed((own + seed) & mask)))
    votes = sorted(votes)[:lines.HEAVIEST]
    return sum(1 << b for b in range(64) if sum(-w if v >> b & 1 else w for w, _, v in votes) > 0)


def meet(a, b, one, two):
    """Whether two blocks are equal under a key whose classes of length do not part the lines."""
    choices = list(combinations(range(lines.BLOCKS), lines.EQUAL))
    sizes = [math.log(len(n)) / (-math.log(lines.SIMILARITY) * lines.CLASS) for n in (a, b)]
    return any(
        all(one[x] == two[x] for x in chosen) and math.floor(sizes[0] + k / len(choices)) == math.floor(sizes[1] + k / len(choices))
        for k, chosen in enumerate(choices)
    )


def brute_lines(rows):
    """Lines that go, by all pairs of SimHashes and edit distances; and the pairs that hang together."""
    spots = []
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            if plain(line):
                spots.append(((doc is None, doc or 0, k), (doc, k), plain(line)))
    texts = sorted({n for *_, n in spots})
    prints = {n: [print_of(n, k) for k in range(lines.BLOCKS)] for n in texts}
    sketches = {n: sketch_of(n) for n in texts}
    edges = [
        (a, b) for a, b in combinations(texts, 2)
        if abs(len(a) - len(b)) <= max(len(a), len(b)) // 9 and meet(a, b, prints[a], prints[b])
        and sum(x == y for x, y in zip(sketches[a], sketches[b])) >= lines.MATCHES
        and distance(a, b) <= int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9)
    ]
    roots = components_of(texts, edges)
    first = {}
    for order, spot, n in sorted(spots):
        first.setdefault(roots[n], (order, spot))
    return {spot for order, spot, n in spots if (order, spot) != first[roots[n]]}, len(edges)


def near_rows():
    """Lines of one base text, each with one more letter changed than the last, and repeated lines."""
    base = sentence(3, 90)
    rows = [(1, base + "\n" + sentence(4, 9)), (2, sentence(4, 9).upper() + "!\nshort line\n\n" + base)]
    changed = base
    for k in range(14):
        words = changed.split(" ")
        words[k * 5] = words[k * 5] + "x"
        changed = " ".join(words)
        rows.append((10 + k, changed + "\n" + sentence(50 + k, 8)))
    return rows


def test_line_dedup_against_brute_force(spark):
    rows = near_rows() + [(None, sentence(4, 9)), (90, None), (91, ""), (92, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, edges = brute_lines(rows)
    assert edges > 3
    got = {(r.doc_id, r.line_no) for r in lines.duplicates(docs).collect()}
    assert got == want


def test_repeated_rows_with_long_lines(spark):
    """Counters of repeated rows are kept apart, or they would overflow."""
    line = sentence(5, 1900)
    rows = [(1, line)] * 40 + [(2, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert {(r.doc_id, r.line_no) for r in lines.duplicates(docs).collect()} == {(2, 1)}


def test_long_lines(spark):
    """Lines of any length are weighed whole, whatever stands at their start."""
    rows = near_rows() + [(200 + k, " ".join([f"begin{k}", sentence(8, 2500 + k), "end"])) for k in range(3)]
    want, edges = brute_lines([r for r in rows if len(r[1]) < 5000])
    got = {(r.doc_id, r.line_no) for r in lines.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {(201, 1), (202, 1)}


def test_open_keys_are_compared(spark, monkeypatch):
    """Lines that share a block but neither its smallest nor its largest line are still held against each other."""
    found = []
    monkeypatch.setattr(lines, "similar", lambda pairs, texts, own=lines.similar: found.append(pairs) or own(pairs, texts))
    heavy = "extraordinarilylong"
    rows = [(k, f"{heavy} a{k} b{k} c{k} d{k}") for k in range(12)] + [(50, f"{heavy} a3 b3 c3 e3"), (51, f"{heavy} a7 b7 c7 e7")]
    want, _ = brute_lines(rows)
    assert {(r.doc_id, r.line_no) for r in lines.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert len(found) == 2


def test_simhashes_of_slices(monkeypatch):
    """Prints do not depend on what is hashed beside a line."""
    import pyarrow as pa

    names = [plain(sentence(k, 3 + k * 7)) for k in range(40)] + ["one", "ünï 12", "one one one"]
    whole = lines.simhashes(pa.array(names))
    monkeypatch.setattr(lines, "STRIP", 3)
    assert (lines.simhashes(pa.array(names)) == whole).all()
    for k in (0, 5, 39, 40, 41):
        assert (lines.simhashes(pa.array([names[k]]))[0] == whole[k]).all()
        assert [int(x) & 2**64 - 1 for x in whole[k][:lines.BLOCKS]] == [print_of(names[k], j) for j in range(lines.BLOCKS)]
        assert whole[k][lines.BLOCKS:].copy().view(np.uint8).tolist() == sketch_of(names[k])


def pairs_found(spark, pairs):
    """Which of the pairs of one-line texts lose their second line."""
    rows = [(2 * k, a) for k, (a, _) in enumerate(pairs)] + [(2 * k + 1, b) for k, (_, b) in enumerate(pairs)]
    got = {r.doc_id for r in lines.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [2 * k + 1 in got for k in range(len(pairs))]


#: Least recall of pairs at edit similarity of 0.9 and more, by kind of change; each holds in each band of lengths. Letters
#: that are scattered over a line change many words, which words cannot bear well; README has the figures.
RECALL = {"words": 0.92, "letters 1 %": 0.75, "letters 4 %": 0.62, "letters 8 %": 0.25}
BANDS = ((20, 60), (60, 120), (120, 300), (300, 800))


def test_recall_on_real_lines(spark):
    """Against edit similarity alone; no SimHash decides which pairs count."""
    dice = random.Random(3)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").collect()]
    pool = sorted({n for t in texts for n in map(plain, t.split("\n"))})

    def changed(n, kind):
        most = int(len(n) / 10 + 1e-9)
        if kind == "words":
            words = n.split(" ")
            some = [i for i in dice.sample(range(len(words)), len(words)) if len(words[i]) <= most][:max(1, len(words) // 11)]
            while some and sum(len(words[i]) for i in some) > most:
                some.pop()
            return " ".join("x" * len(w) if i in some else w for i, w in enumerate(words)) if some else None
        at = [i for i, c in enumerate(n) if c != " "]
        count = max(1, len(n) * int(kind.split()[1]) // 100)
        some = set(dice.sample(at, count)) if count <= most else set()
        return "".join(dice.choice("qxyz") if i in some else c for i, c in enumerate(n)) if some else None

    cells, pairs = [], []
    for kind in RECALL:
        for low, high in BANDS:
            own = []
            while len(own) < 150:
                n = dice.choice(pool)
                m = changed(n, kind) if low <= len(n) < high else None
                if m and m != n:
                    own.append((n, m))
            cells.append((kind, low))
            pairs += own
    import pyarrow as pa

    a, b = (lines.simhashes(pa.array([p[k] for p in pairs])).view(np.uint64) for k in (0, 1))
    equal = a[:, :lines.BLOCKS] == b[:, :lines.BLOCKS]
    alike = a[:, lines.BLOCKS:].copy().view(np.uint8) == b[:, lines.BLOCKS:].copy().view(np.uint8)
    near = (equal.sum(axis=1) >= lines.EQUAL) & (alike.sum(axis=1) >= lines.MATCHES)
    recall = {cell: near[150 * k:150 * k + 150].mean() for k, cell in enumerate(cells)}
    assert all(r >= RECALL[kind] for (kind, _), r in recall.items()), recall
    # What SimHashes bring together is found by the joins too.
    some = [k for k in range(0, len(pairs), 20)]
    assert all(f or not near[k] for f, k in zip(pairs_found(spark, [pairs[k] for k in some]), some))


def test_word_put_into_long_lines(spark):
    """A word near the start of a line of any length leaves it similar."""
    pairs = []
    for n in (1999, 2005, 3000):
        words = sentence(n, n).split(" ")
        pairs.append((" ".join(words), " ".join([*words[:10], "new", *words[10:]])))
    assert all(pairs_found(spark, pairs))


def test_short_lines_and_scripts_without_blanks(spark):
    """Lines of 4-7 words with a letter changed, lines without blanks, and exact copies of any length."""
    han = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(30))
    pairs = [(a := sentence(900 + k, 4 + k % 4), a[:-1] + "0") for k in range(20)]
    pairs += [(han, han), (han[:9], han[:9]), (han[::-1], han[::-1][:-1] + "x"), ("a" * 12 + " " + "b" * 12, "A" * 12 + ", " + "b" * 12)]
    found = pairs_found(spark, [*pairs, ("two words", "two words"), ("Yes", "yes!"), ("no", "on"), ("...", "...")])
    assert sum(found[:20]) >= 18 and all(found[20:26]) and not any(found[26:])


def test_lines_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()]
    want, _ = brute_lines(rows)
    got = {(r.doc_id, r.line_no) for r in lines.duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_texts(spark, odd, empty):
    docs = odd.withColumn("line", F.lit("mine")).withColumn("dropped", F.lit(0))
    got = lines.without_lines(docs).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert by_id[2].clean_text == "" and by_id[2].dropped == [1] and by_id[1].dropped == []
    assert by_id[4].clean_text is None and by_id[5].clean_text == "" and by_id[7].dropped == []
    assert by_id[10].clean_text == by_id[10].text and by_id[1].line == "mine"
    assert lines.without_lines(empty).count() == 0
    kept = {r.doc_id for r in lines.stage(spark, odd, "").collect()}
    assert 2 not in kept and {1, 4, 5, 6, 7, 8, 9, 10, 11} <= kept
    two = spark.createDataFrame([(1, "a b c d e f\nnew words stand here now"), (2, "x\nA b, c d e f\ny")], "doc_id long, text string")
    assert {r.doc_id: r.clean_text for r in lines.without_lines(two).collect()}[2] == "x\ny"


# -- n-grams -------------------------------------------------------------------------------


def brute_ngrams(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    edges = [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-6
    ]
    roots = components_of(range(len(rows)), edges)
    links = [sum(i in e for e in edges) for i in range(len(rows))]
    least = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), str(least.get(roots[i])), links[i]) for i in range(len(rows)))


def test_ngram_join_against_brute_force(spark, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    for k in range(12):
        words = sentence(7, 120).split()
        for j in range(k):
            words[j * 9 + 3] = f"new{k}"
        rows += [(100 + k, " ".join(words)), (200 + k, " ".join(words))]
    got = ngrams.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute_ngrams(rows)


def test_ngram_blocks(spark, monkeypatch):
    """Groups larger than a block give the same links."""
    rows = []
    for k in range(60):
        words = sentence(7, 150).split()
        words[k * 2] = f"new{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_ngrams(rows)
    monkeypatch.setattr(ngrams, "BLOCK", 7)
    monkeypatch.setattr(ngrams, "COLUMNS", 16)
    got = ngrams.join(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == want


def test_ngram_stage(spark, odd, empty):
    kept = [r.doc_id for r in ngrams.stage(spark, odd.withColumn("key", F.lit(1)), "").collect()]
    assert 1 in kept and 2 not in kept and 3 not in kept and kept.count(8) == 1 and 4 in kept and 5 in kept
    assert ngrams.stage(spark, empty, "").count() == 0 and ngrams.join(empty).count() == 0


def test_prefix_depth():
    d = ngrams.depth(0.8)
    assert 1 - (1 - 0.8**d) ** ngrams.TREES >= ngrams.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngrams.TREES
    assert ngrams.depth(0.05) == 1


# -- vectors -------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 24))
    near = np.concatenate([base[:30] + 0.08 * rng.standard_normal((30, 24)) for _ in range(3)])
    chain = [base[50]]
    for _ in range(8):
        chain.append(chain[-1] + 0.35 * rng.standard_normal(24))
    return [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, near, chain, 3 * base[:5]]))]


@pytest.mark.parametrize("block", [4096, 16])
def test_vector_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = vectors()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if x[i] @ x[j] >= 0.9]
    assert len(edges) > 100
    roots = components_of(range(len(rows)), edges)
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [None] + [1.0] * 23), (1004, [float("inf")] * 24),
           (1005, []), (1006, [1e-300] * 24), (1007, [1e300] * 24), (None, [1.0] * 24), (1008, [1.0, 2.0]), (1009, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(None)).withColumn("n", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    for i, r in roots.items():
        assert got[i] == (sum(i in e for e in edges), r, i == r)
    assert all(got[k] == (0, k, True) for k in (1000, 1001, 1002, 1003, 1004, 1005))
    assert got[1006] == (1, 1006, True) and got[1007] == (1, 1006, False) and got[None] == (0, None, None)
    assert got[1009] == (1, 1008, False)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup.near_duplicates(df).count() == 0


def test_cosines_at_the_threshold(spark):
    """Integer vectors at exactly 0.9, turned by other vectors beside them, and pairs just below."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(60):
        at = rng.permutation(32)[:4]
        a, b = np.zeros(32), np.zeros(32)
        a[at[0]], b[at] = 1 + k % 3, np.array([9, 3, 3, 1]) * (1 + k % 5)
        rows += [a, b]
    for k in range(20):
        at = rng.permutation(32)[:2]
        a, b = np.zeros(32), np.zeros(32)
        a[at[0]], b[at] = 1.0, [0.9 - 1e-10 * (k % 2), np.sqrt(1 - (0.9 - 1e-10 * (k % 2)) ** 2)]
        rows += [a, b]
    x = np.array(rows)
    norms = np.sqrt((x ** 2).sum(axis=1))
    cosine = (x @ x.T) / (norms[:, None] * norms[None])
    want = (cosine >= 0.9).sum(axis=1) - 1
    assert want.sum() > 200 and ((np.abs(cosine - 0.9) < 1e-9) & (cosine < 0.9)).any()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(rows))] == want.tolist()


def test_hubs_and_scratch(spark, tmp_path):
    """A star of many leaves, joined by broadcast, and no table of a round left over."""
    import os

    from watchloom import session

    edges = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b").union(spark.createDataFrame([(200_001, 200_000)], "a long, b long"))
    before = set(os.listdir(session.shared_dir(spark)))
    roots = common.components(edges, "star")
    assert roots.groupBy("root").count().orderBy("root").collect() == [(0, 100_001), (200_000, 2)]
    assert len(set(os.listdir(session.shared_dir(spark))) - before) == 1
    lows = spark.createDataFrame([(0, 0, 100_000), (5, 1, 2)], "a long, low long, n long")
    plan = common.lowered(edges, lows, 100_001)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_line_dedup_leaves_no_scratch(spark):
    import os

    from watchloom import session

    docs = spark.createDataFrame([(1, "one line here\nsame again"), (2, "Same again!")], "doc_id long, text string")
    before = set(os.listdir(session.shared_dir(spark)))
    assert lines.duplicates(docs).count() == 1
    assert len(set(os.listdir(session.shared_dir(spark))) - before) == 1  # the result itself


def test_line_dedup_leaves_no_shuffle_files(spark):
    """What a step has shuffled goes when the step is written, not when the driver collects garbage."""
    import glob
    import time

    from watchloom import session

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    folders = manager.localDirsString()

    def shuffled():
        return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}

    rows = near_rows() * 3
    before = shuffled()
    gone = lines.duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    for _ in range(40):  # executors delete them behind the query's back
        if not (left := shuffled() - before):
            break
        time.sleep(0.25)
    assert not left and gone.count() > 0
    assert spark.conf.get(session.CLEANUP) == "false"


def test_lines_meet_once(spark):
    """Lines that share several keys are one pair when the join is done, and no pair that shares a key is missed."""
    rows = near_rows() + [(100 + k, f"extraordinarilylong a{k} b{k} common words of c{k % 3} lines") for k in range(12)]
    spots = lines.spotted(spark.createDataFrame(rows, "doc_id long, text string"))
    different = spots.where("n IS NOT NULL").select("line", F.length("n").alias("size"), "prints", "n").dropDuplicates(["line"]).cache()
    keys = lines.keyed(different).select("key", "line")
    known = different.select(
        "line", F.col("line").alias("root"), "size", F.slice("prints", 1, lines.BLOCKS).alias("blocks"),
        *[F.get("prints", F.lit(lines.BLOCKS + k)).alias(f"s{k}") for k in (0, 1)],
    )
    found = lines.crossing(keys.join(known, "line"))
    assert not re.search(r"Aggregate \[a#", found._jdf.queryExecution().optimizedPlan().toString())
    got = [(r.a, r.b) for r in found.collect()]
    texts = {r.line: r.n for r in different.select("line", "n").collect()}
    prints = {c: [print_of(n, k) for k in range(lines.BLOCKS)] for c, n in texts.items()}
    want = {
        (a, b) for a, b in combinations(sorted(texts), 2)
        if abs(len(texts[a]) - len(texts[b])) <= int(max(len(texts[a]), len(texts[b])) * (1 - lines.SIMILARITY) + 1e-9)
        and meet(texts[a], texts[b], prints[a], prints[b])
        and sum(x == y for x, y in zip(sketch_of(texts[a]), sketch_of(texts[b]))) >= lines.MATCHES
    }
    assert len(want) > 60 and len(got) == len(set(got)) and set(got) == want
    assert keys.groupBy("line").count().agg(F.max("count")).first()[0] > 1


def test_shared_ends(spark):
    """The edit distance of what lies between shared ends is that of the whole texts."""
    dice = random.Random(5)
    pairs = [("abc", ""), ("", "x"), ("aaaa", "aaa"), ("aba", "ababa"), ("one two", "one three two"), ("x" * 70000 + "a", "x" * 70000 + "b")]
    for k in range(60):
        a = "".join(dice.choice("abü\U0001d4d0") for _ in range(dice.randrange(1, 40)))
        at = dice.randrange(len(a) + 1)
        pairs.append((a, a[:at] + "".join(dice.choice("abü") for _ in range(dice.randrange(3))) + a[at + dice.randrange(3):]))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    core = lines.between_ends(F.col("a"), F.col("b"))
    got = {r.k: r.c for r in df.select("k", core.alias("c")).collect()}
    for k, (a, b) in enumerate(pairs):
        if len(a) < 100:
            assert distance(got[k].a, got[k].b) == distance(a, b), (a, b, got[k])
            assert not (got[k].a and got[k].b) or got[k].a[0] != got[k].b[0] and got[k].a[-1] != got[k].b[-1]
    assert len(got[5].a) < 5000
    texts = df.selectExpr("2 * k AS line", "a AS n").union(df.selectExpr("2 * k + 1 AS line", "b AS n"))
    near = {r.a // 2 for r in lines.similar(df.selectExpr("2 * k AS a", "2 * k + 1 AS b"), texts).collect()}
    most = [int(max(len(a), len(b)) * (1 - lines.SIMILARITY) + 1e-9) for a, b in pairs]
    assert near == {k for k, (a, b) in enumerate(pairs) if k == 5 or k != 5 and distance(a, b) <= most[k]}


def test_edits_within_a_bound():
    """Bands of bits, side by side or one by one, against the plain edit distance."""
    from watchloom.llm import edits

    dice = random.Random(8)
    for letters, size, most_words in (("ab", 30, 1), ("abcdefgh", 200, 1), ("abü \U0001d4d0xyz", 90, 2), ("".join(map(chr, range(200, 600))), 260, 3)):
        one, two, most = [], [], []
        for k in range(60):
            a = "".join(dice.choice(letters) for _ in range(dice.randrange(size)))
            b = list(a)
            for _ in range(dice.randrange(len(a) // 6 + 2)):
                at = dice.randrange(len(b) + 1)
                b[at:at + dice.randrange(3)] = [dice.choice(letters)] * dice.randrange(3)
            one.append(a)
            two.append("".join(b))
            most.append(dice.choice([len(a) // 10, len(a) // 5, dice.randrange(64 * most_words)]))
        want = [distance(a, b) <= m for a, b, m in zip(one, two, most)]
        assert edits.within(one, two, most).tolist() == want and 5 < sum(want) < 58
        assert [bool(edits.within([a], [b], [m])[0]) for a, b, m in zip(one, two, most)] == want
    long = "".join(dice.choice("abc") for _ in range(60_000))
    other = long[:100] + "x" + long[101:-100] + "yy" + long[-99:]
    assert edits.within([long] * 2, [other] * 2, [2, 3]).tolist() == [False, True]


def test_keys_are_no_join(spark, monkeypatch):
    """The pairs of a key are counted off in the tasks: no row of a join each, no edit distance of Spark's for any. A key that
    is dealt out in blocks has the same pairs, and keys with one root have none."""
    rows = near_rows() + [(100 + k, f"extraordinarilylong a{k} b{k} common words of c{k % 3} lines") for k in range(30)]
    spots = lines.spotted(spark.createDataFrame(rows, "doc_id long, text string"))
    different = spots.where("n IS NOT NULL").select("line", F.length("n").alias("size"), "prints", "n").dropDuplicates(["line"]).cache()
    keys = lines.keyed(different)
    assert keys.groupBy("key").agg(F.count("*").alias("c"), F.max("n").alias("n")).where("c <> n").isEmpty()
    known = different.select(
        "line", F.col("line").alias("root"), "size", F.slice("prints", 1, lines.BLOCKS).alias("blocks"),
        *[F.get("prints", F.lit(lines.BLOCKS + k)).alias(f"s{k}") for k in (0, 1)],
    )
    shared = keys.select("key", "line", "n").join(known, "line").localCheckpoint()
    found = lines.crossing(shared)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((r.a, r.b) for r in found.collect())
    assert len(want) > 100
    for cell, at_once in ((3, 7), (1, 1), (1 << 12, 5)):
        monkeypatch.setattr(lines, "CELL", cell)
        monkeypatch.setattr(lines, "PAIRS_AT_ONCE", at_once)
        table = lines.cells(shared).coalesce(1).sortWithinPartitions("key", "cell", "upper").toArrow().combine_chunks()
        held = list(lines._crossing(iter(table.to_batches(max_chunksize=4))))
        assert sorted((a, b) for pb in held for a, b, *_ in zip(*[c.to_pylist() for c in pb.columns])) == want
    assert lines.crossing(shared.withColumn("root", F.lit(1).cast("long"))).isEmpty()
    near = lines.similar(found, different.select("line", "n"))
    assert "levenshtein" not in near._jdf.queryExecution().optimizedPlan().toString()
