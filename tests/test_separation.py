"""Orders of separated sources."""

import itertools

import numpy as np
import pytest

from eventide.operators import separation


def test_assignment_against_all_orders():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        gain = rng.integers(-3, 4, (n, n)).astype(float) if rng.random() < 0.5 else rng.normal(size=(n, n))
        got = separation.assignment(gain)
        assert sorted(got) == list(range(n))
        assert np.isclose(gain[np.arange(n), got].sum(), max(gain[np.arange(n), list(o)].sum() for o in itertools.permutations(range(n))))
    order = rng.permutation(80)
    assert (separation.assignment(np.eye(80)[:, np.argsort(order)]) == order).all()


@pytest.mark.parametrize("size", [1, 2, 3, 1024])
def test_orders_one_after_another(spark, size):
    """The composed orders are those of going through the blocks one by one."""
    rng = np.random.default_rng(1)
    rows = [(k, b, rng.permutation(5).tolist()) for k, n in (("a", 37), ("b", 1), ("c", 9)) for b in range(n)]
    size_ = max(2, size) if size == 1 else size
    got = {(r["k"], r["block"]): r["order"] for r in separation.composed(spark.createDataFrame(rows, "k string, block long, order array<long>").repartition(3), ["k"], size=size_).collect()}
    assert len(got) == len(rows)
    whole = {}
    for k, b, own in rows:
        whole[k] = own if b == 0 else [own[i] for i in whole[k]]
        assert got[k, b] == whole[k]


def test_sources_come_back(spark):
    rng = np.random.default_rng(2)
    truth = rng.normal(size=(3, 20 * 32))
    rows, first = [], None
    for b in range(19):
        order = rng.permutation(3)
        first = order if first is None else first
        rows.append(("r", b, (truth[order, b * 32 : b * 32 + 64] + 0.2 * rng.normal(size=(3, 64))).tolist()))
    df = spark.createDataFrame(rows, "k string, block long, sources array<array<double>>").repartition(4)
    found = separation.resolved(df, ["k"], "sources", size=4)
    for r in found.collect():
        x = np.array(r["sources"])
        assert np.abs(x - truth[first, r["block"] * 32 : r["block"] * 32 + 64]).max() < 1.2
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)).tolist()
    chunks = {(r["source"], r["chunk"]): r["samples"] for r in separation.added_up(found, ["k"], "sources", window).collect()}
    assert len(chunks) == 3 * 20
    for s in range(3):
        whole = np.concatenate([chunks[s, c] for c in range(1, 19)])
        assert np.corrcoef(whole, truth[first[s], 32 : 19 * 32])[0, 1] > 0.95


def test_no_blocks(spark):
    df = spark.createDataFrame([], "k string, block long, sources array<array<double>>")
    assert separation.resolved(df, ["k"], "sources").count() == 0


def test_orders_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    orders = spark.range(20).selectExpr("1 as r", "id as block", "array(1L, 0L) as order").mapInPandas(count, "r int, block long, order array<long>")
    got = separation.composed(orders, ["r"], size=3).orderBy("block").collect()
    assert [list(r["order"]) for r in got] == [[1, 0] if r["block"] % 2 == 0 else [0, 1] for r in got] and len(got) == 20
    assert seen.value == 20
