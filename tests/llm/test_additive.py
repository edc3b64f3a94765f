"""Vector search: exact on small collections, measured on larger ones, defined on odd vectors."""

import numpy as np

from landweave.llm.additive import fit, nearest, neighbour_pairs

SCHEMA = "chunk_id bigint, embedding array<float>, cosine string, id string, cls string"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], "x", "y", "z") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)], SCHEMA)


def truth(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    out = set()
    for i in range(len(x)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(60, size=1500)] + rng.normal(size=(1500, 16)) * 0.3).astype(np.float32)
    want = truth(x.astype(np.float64), list(range(1500)), 5)
    got = {tuple(r) for r in neighbour_pairs(nearest(frame(spark, x), dim=16)).collect()}
    assert len(want & got) / len(want) > 0.97


def test_odd_vectors_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 4)).astype(np.float32)
    copies = [x[0]] * 20
    odd = [None, [], [1.0, 2.0], [0.0] * 4, [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0, 0, 0]]
    vectors, ids = [*x, *copies, *odd], [*range(12), *range(100, 120), *range(900, 907)]
    got = {tuple(r) for r in neighbour_pairs(nearest(frame(spark, vectors, ids), dim=4, probes=50, block=3)).collect()}
    want = truth(np.array([*x, *copies], np.float64), ids[:32], 5)
    assert got == want


def test_few_and_none(spark):
    assert nearest(frame(spark, []), dim=4).count() == 0
    assert nearest(frame(spark, [[1, 0, 0, 0]]), dim=4).count() == 0
    assert [tuple(r) for r in neighbour_pairs(nearest(frame(spark, [[1, 0, 0, 0], [0, 1, 0, 0]]), dim=4)).collect()] == [(0, 1)]


def test_codes_approximate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    m = fit(x, 16, books=4, words=32)
    lists = m.nearest_lists(x, 1)[:, 0]
    coarse = ((x - m.coarse[lists]) ** 2).sum(1).mean()
    beam = ((x - m.decode(lists, m.encode(x, lists, 8))) ** 2).sum(1).mean()
    greedy = ((x - m.decode(lists, m.encode(x, lists, 1))) ** 2).sum(1).mean()
    assert beam < greedy < 0.5 * coarse


def test_lists_outgrow_the_sample(spark):
    """With 12 coarse words the 155 lists of 1,500 vectors need the second codebook."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(60, 16))[rng.integers(60, size=1500)] + rng.normal(size=(1500, 16)) * 0.3).astype(np.float32)
    m = fit(x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True), 155)
    assert len(m.coarse) == 12 and len(m.fine) == 13
    every = m.nearest_lists(x, 12 * 13)
    d = ((x[:, None, :] - m.centre(every)) ** 2).sum(2)
    assert (np.diff(d, axis=1) > -1e-3).all()
    want = truth(x.astype(np.float64), list(range(1500)), 5)
    got = {tuple(r) for r in neighbour_pairs(nearest(frame(spark, x), dim=16, sample=200)).collect()}
    assert len(want & got) / len(want) > 0.9


def test_groups_the_sample_has_not_seen(spark):
    """600 groups of 10, of which a sample of 150 vectors has seen a few."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(600, 32))[np.repeat(np.arange(600), 10)] + rng.normal(size=(6000, 32)) * 0.4).astype(np.float32)
    want = truth(x.astype(np.float64), list(range(6000)), 5)
    got = {tuple(r) for r in neighbour_pairs(nearest(frame(spark, x), dim=32, sample=150)).collect()}
    assert len(want & got) / len(want) > 0.97
