import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm import packing
from codexmill.llm.packing import pack_items, settle, sum_of_squares


def squares(gaps, capacity):
    return sum(gaps.count(g) ** 2 for g in set(gaps) if 0 < g < capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_each_step_is_a_least_one(sizes):
    capacity = 12
    where = sum_of_squares(np.array(sizes, np.int64), capacity)
    gaps: dict[int, int] = {}
    for s, k in zip(sizes, where):
        choices = [{**gaps, j: g - s} for j, g in gaps.items() if g >= s] + [{**gaps, -1: capacity - s}]
        gaps = {**gaps, k: gaps.get(k, capacity) - s}
        assert gaps[k] >= 0
        assert squares(list(gaps.values()), capacity) == min(squares(list(c.values()), capacity) for c in choices)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_gaps_that_nothing_fills_do_not_count(sizes):
    capacity, sizes = 12, sorted(sizes, reverse=True)
    where = sum_of_squares(np.array(sizes, np.int64), capacity, True)
    gaps: dict[int, int] = {}

    def squares_ahead(gaps, rest):
        of = [g for g in gaps if 0 < g < capacity]
        return sum(min(of.count(g), sum(s <= g for s in rest)) ** 2 for g in set(of))

    for i, (s, k) in enumerate(zip(sizes, where)):
        choices = [{**gaps, j: g - s} for j, g in gaps.items() if g >= s] + [{**gaps, -1: capacity - s}]
        gaps = {**gaps, k: gaps.get(k, capacity) - s}
        assert gaps[k] >= 0
        assert squares_ahead(list(gaps.values()), sizes[i + 1 :]) == min(squares_ahead(list(c.values()), sizes[i + 1 :]) for c in choices)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_settling_never_hurts(sizes):
    x = np.array(sizes, np.int64)
    k = settle(x, 50)
    fill = np.bincount(k, x)
    assert fill.max() <= 50 and fill.min() > 0 and len(fill) <= sum_of_squares(x, 50).max() + 1


def test_operator(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, int(n), "x") for i, n in enumerate(rng.integers(1, 140, 400))] + [(900, 350, "x"), (901, 0, "x"), (902, None, "x"), (903, 100, "x"), (7, 5, "x"), (7, 5, "x"), (None, 9, "x")]
    df = spark.createDataFrame(rows, "doc bigint, n int, fill string")
    monkeypatch.setattr(packing, "BLOCK", 60)
    got = pack_items(df, "doc", "n", 100).toPandas()
    want = sum(n for _, n, _ in rows if n)
    assert got["n_tokens"].sum() == want and (got["n_tokens"] > 0).all()
    fill = got.groupby("container")["n_tokens"].sum()
    assert (fill <= 100).all() and (got.groupby("container")["fill"].first() == fill).all()
    assert sorted(got[got.item_id == 900][["start", "n_tokens"]].itertuples(index=False, name=None)) == [(0, 100), (100, 100), (200, 100), (300, 50)]
    small = {i for i, n, _ in rows if n and n <= 100 and i is not None and i != 7}
    assert (got[got.item_id.isin(small)].groupby("item_id").size() == 1).all()
    assert len(fill) <= 1.03 * want / 100 + 2
    assert pack_items(df.limit(0), "doc", "n", 100).count() == 0


@pytest.mark.parametrize("block", [1000, 20_000])
@pytest.mark.parametrize("sizes", ["513..1023", "350..480", "threes", "uniform"])
def test_no_group_holds_the_corpus(spark, monkeypatch, sizes, block):
    """Sizes that seldom or never fill a container: the pool shrinks all the same, and nothing is wasted by it."""
    monkeypatch.setattr(packing, "BLOCK", block)
    n = 60_000
    size = {"513..1023": "513 + id * 7919 % 511", "350..480": "350 + id * 7919 % 131", "threes": "3 * (1 + id * 7919 % 341)", "uniform": "1 + id * 7919 % 1023"}[sizes]
    got = pack_items(spark.range(n).selectExpr("id", f"cast({size} as int) as n"), "id", "n", 1024)
    got = got.selectExpr("container", "fill", "n_tokens", "substring_index(container, ':', 2) as block").toPandas()
    assert got.groupby("block").size().max() <= 1.5 * block  # of any round
    total = got["n_tokens"].sum()
    best = {"513..1023": n, "350..480": -(-n // 2), "threes": -(-total // 1023), "uniform": -(-total // 1024)}[sizes]
    assert len(got) == n and got["container"].nunique() <= (1.01 if block > 5000 else 1.04) * best + 2


def test_same_rows_same_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    rows = [(i % 300, 5 + i * 37 % 90) for i in range(900)] + [(1, 42)] * 500  # one row very often
    df = spark.createDataFrame(rows, "id bigint, n int")
    a, b = (sorted(map(tuple, pack_items(df.repartition(k), "id", "n", 100).collect())) for k in (1, 5))
    assert a == b and len(a) == len(rows)
    assert len({c for c, i, *_ in a if i == 1}) > 200
