"""Packing: every piece once, no container too full, as full as sequential best-fit."""

import random
from collections import defaultdict

import pytest

from landweave.llm.packing import bands, match, pack, slots_of, without_slot


def check(spark, sizes, capacity):
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").selectExpr("*", "'x' as size", "'y' as container")
    rows = pack(df, capacity, buckets=7).collect()
    by_doc, by_box = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r["size"]))
        by_box[r.container].append((r.position, r["size"]))
    for k, n in sizes:
        p = sorted(by_doc[k])
        assert [i for i, _ in p] == list(range(len(p))) and sum(s for _, s in p) == (n or 0)
        assert len(p) == 1 if (n or 0) <= capacity else all(s == capacity for _, s in p[:-1])
    for box in by_box.values():
        assert sorted(i for i, _ in box) == list(range(len(box))) and sum(s for _, s in box) <= capacity
    return by_box


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    sizes = [(i, rng.choice([0, None, 1, 7, 50, 51, 99, 100, 101, 250, rng.randrange(1, 100)])) for i in range(300)]
    boxes = check(spark, sizes, 100)
    parts = [p for _, n in sizes if n for p in [100] * (n // 100) + [n % 100] * (n % 100 > 0)]
    assert len(boxes) <= 1.02 * best_fit(parts, 100)


def test_equal_sizes_and_only_empty(spark):
    assert len(check(spark, [(i, 33) for i in range(100)], 100)) == 34
    assert len(check(spark, [(i, 0) for i in range(5)], 100)) == 1
    assert len(check(spark, [(1, 1000)], 100)) == 10


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


def test_bands():
    for c in (1, 2, 7, 100, 2048):
        b = bands(c)
        assert b[0][1] == c and b[-1][0] == 1 and all(p[0] == q[1] + 1 for p, q in zip(b, b[1:], strict=False))


def test_round(spark):
    """Each item gets its successor; of items that meet at one slot the largest gets it and the others move on."""
    items = spark.createDataFrame([(i, 0, s) for i, s in enumerate([90, 60, 55, 55, 51])], "doc_id bigint, piece int, size int")
    gaps = spark.createDataFrame([(i, g, 1) for i, g in enumerate([54, 56, 59, 70, 20, 72])], "container bigint, gap int, n int")
    got = {r["doc_id"]: r["container"] for r in match(items, slots_of(gaps, 51, 100), 3).collect()}
    assert got[0] is None and got[1] == 3 and got[4] == 0 and {got[2], got[3]} == {1, 2}
    assert without_slot(items, slots_of(gaps, 51, 100)) == (5, 1, 63)


@pytest.mark.parametrize("seed", range(2))
def test_round_pairs_as_brackets_do(spark, seed):
    rng = random.Random(seed)
    items, slots = [rng.randrange(1, 40) for _ in range(200)], [rng.randrange(1, 40) for _ in range(180)]
    got = match(spark.createDataFrame([(i, 0, s) for i, s in enumerate(items)], "doc_id bigint, piece int, size int"), spark.createDataFrame([(i, s, 1) for i, s in enumerate(slots)], "container bigint, size int, slot int"), 3).collect()
    stack, want = [], []
    for s, slot in sorted([(s, 0) for s in items] + [(s, 1) for s in slots]):
        if not slot:
            stack.append(s)
        elif stack:
            want.append((stack.pop(), s))
    pairs = sorted((r["size"], slots[r["container"]]) for r in got if r["container"] is not None)
    assert pairs == sorted(want) and len({r["container"] for r in got if r["container"] is not None}) == len(want) and len(got) == 200


def test_one_size_holds_a_third(spark):
    rng = random.Random(5)
    sizes = [(i, 70 if i % 3 == 0 else rng.randrange(1, 100)) for i in range(3000)]
    boxes = check(spark, sizes, 100)
    assert len(boxes) <= 1.01 * best_fit([n for _, n in sizes], 100) + 1
