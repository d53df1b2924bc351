import random
from itertools import combinations

import pytest

from codexmill.llm import spans
from codexmill.llm.spans import SharedSpans

SCHEMA = "doc_id bigint, text string, h string, pos string"


def brute(docs):
    """(pairs, shared length of each record) from all windows of 160 code points."""
    at = {}
    for d, t in docs:
        for j in range(len(t or "") - 159):
            at.setdefault(t[j : j + 160], []).append((d, j))
    pairs, covered = set(), {d: set() for d, t in docs if t}
    for v in at.values():
        ds = {d for d, _ in v}
        pairs |= {tuple(sorted(p)) for p in combinations(ds, 2)}
        if len(ds) > 1:
            for d, j in v:
                covered[d] |= set(range(j, j + 160))
    return pairs, {d: len(c) for d, c in covered.items()}


def words(r, n):
    return "".join(r.choices("abcdefgé日 \n", k=n))


def corpus():
    r = random.Random(4)
    long, edge, less = words(r, 400), words(r, 160), words(r, 159)
    docs = [(1, words(r, 50) + long + words(r, 30)), (2, long[100:330]), (3, edge), (4, words(r, 9) + edge + words(r, 500)), (5, less + "X"), (6, "Y" + less)]
    docs += [(7, None), (8, ""), (9, " "), (10, "a" * 1000), (11, "b" + "a" * 170), (12, words(r, 20) + 2 * words(r, 200)), (13, 2 * (edge[:80] + words(r, 90)))]
    docs += [(14, "ab" * 300), (15, "x" + "ba" * 90), (16, long), (17, long)]
    return docs


@pytest.mark.parametrize("many", [64, 1])
def test_equals_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(spans, "MANY", many)
    docs = corpus()
    pairs, lengths = brute(docs)
    df = spark.createDataFrame([(d, t, "h", "p") for d, t in docs] + [(1, docs[0][1], "h", "p"), (None, docs[0][1], "h", "p")], SCHEMA).repartition(3)
    s = SharedSpans(df)
    assert {tuple(r) for r in s.shared_pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in s.shared_lengths().collect()} == lengths


def test_slices_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "_SLICE", 300)
    docs = corpus()
    pairs, lengths = brute(docs)
    t = [(d, x) for d, x in docs if x and len(x) >= 160]
    got = set()
    for i, o, part in spans._slices([d for d, _ in t], [x for _, x in t]):
        which, pos, h = spans.kept_windows(part)
        got |= {(i[w], o[w][0] + int(p)) for w, p in zip(which, pos)}
    for d, x in t:  # every 81 windows in a row hold one that is kept
        kept = sorted(p for e, p in got if e == d)
        assert kept[0] <= 80 and kept[-1] >= len(x) - 160 and all(b - a <= 81 for a, b in zip(kept, kept[1:]))


def test_copies_of_one_passage(spark):
    r = random.Random(9)
    common = words(r, 100)  # too short to count, in many records
    docs = [(i, words(r, 90) + common + words(r, 90)) for i in range(90)] + [(200 + i, "z" * i + words(random.Random(1), 300)) for i in range(12)]
    pairs, lengths = brute(docs)
    s = SharedSpans(spark.createDataFrame([(d, t, "h", "p") for d, t in docs], SCHEMA))
    assert {tuple(r) for r in s.shared_pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in s.shared_lengths().collect()} == lengths


def test_narrow_sketch_writes_no_more_contexts(spark, monkeypatch):
    r = random.Random(3)
    shared = [words(r, 300) for _ in range(5)]
    docs = [(i, words(r, 2000) + (shared[i % 5] if i % 4 == 0 else "") + words(r, 700)) for i in range(60)]
    pairs, _ = brute(docs)
    df = spark.createDataFrame([(d, t, "h", "p") for d, t in docs], SCHEMA)
    rows = {}
    for bits in (1 << 20, 1 << 5):  # the second tells next to nothing
        monkeypatch.setattr(spans, "CHUNK_BITS", bits)
        monkeypatch.setattr(spans, "MAX_BITS", bits)
        own = df.selectExpr("doc_id as doc", "text")
        passed, kept = spans.passed_windows(own).count(), spans.repeated_windows(own)
        rows[bits] = (passed, sorted(map(tuple, kept.collect())))
        assert {tuple(x) for x in SharedSpans(df).shared_pairs().collect()} == pairs
    assert rows[1 << 20][1] == rows[1 << 5][1] and rows[1 << 5][0] > 5 * rows[1 << 20][0]
    assert rows[1 << 5][0] <= sum(len(t) for _, t in docs) / 30  # narrow rows, one in 40 code points or so


def test_empty(spark):
    s = SharedSpans(spark.createDataFrame([], SCHEMA))
    assert s.shared_pairs().count() == 0 and s.shared_lengths().count() == 0
