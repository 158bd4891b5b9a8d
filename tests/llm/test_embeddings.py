import numpy as np
import pytest

import costlens.llm.embeddings as M


def brute(rows, threshold):
    keys, unit = [], []
    for k, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=float)
            keys.append(k)
            unit.append(x / np.linalg.norm(x))
    x = np.array(unit)
    near = (x @ x.T) >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(keys))
    while True:
        now = np.array([root[near[i] | (np.arange(len(root)) == i)].min() for i in range(len(root))])
        if (now == root).all():
            break
        root = now
    least = {}
    for r, k in zip(root, keys):
        least[r] = min(least.get(r, k), k)
    out = {k: (int(n), least[r]) for k, n, r in zip(keys, near.sum(axis=1), root)}
    return {k: out.get(k, (0, k)) for k, _ in rows}


@pytest.mark.parametrize("chunk,small", [(512, 64), (8, 5), (8, 64), (40, 2)])
def test_matches_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "SMALL", small)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 24))
    near = centres[rng.integers(0, 12, 250)] + 0.04 * rng.normal(size=(250, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([centres, near]))]
    rows += [(1000 + i, rows[i][1]) for i in range(40)] + [(2000 + i, [3 * c for c in rows[i][1]]) for i in range(40)]
    rows += [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] + [1.0] * 23), (3004, [])]
    rows += [(3005, [float("inf")] + [1.0] * 23), (3006, [1e200] * 24), (3007, [1e-200] * 24)]
    got = M.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute([r for r in rows if r[0] < 3000], 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id < 3000} == want
    odd = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id >= 3000}
    assert all(odd[i] == (0, i, True) for i in range(3000, 3006))
    assert odd[3006] == (1, 3006, True) and odd[3007] == (1, 3006, False)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    x, y = (M.bucket_codes(v, M.TABLES, 3, M.PROBES) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.98


@pytest.mark.parametrize("hashes, d", [(3, 64), (4, 64), (5, 64), (4, 24)])
def test_recall_stays_with_more_hashes(hashes, d):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1500, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    tables = M.tables_for(hashes, d, 0.9)
    x, y = (M.bucket_codes(v, tables, hashes, M.PROBES) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.985


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = M.hadamard(x)
    assert np.allclose((x**2).sum(axis=1), (y**2).sum(axis=1)) and np.allclose(M.hadamard(y), x)


def test_rows(spark):
    kind = "vec_id long, embedding array<float>, v int, node int, d int"
    rows = [(None, [1.0, 2.0], 1, 1, 1), (5, [1.0, 2.0], 1, 1, 1), (5, [1.0, 2.0], 1, 1, 1), (6, [1.0], 1, 1, 1), (None, None, 1, 1, 1)]
    got = M.vector_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [
        (0, 0, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5), (6, 0, 6),
    ]
    assert M.vector_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Every vector links with every other, some by a hair: counts are exact whatever buckets a pair shares."""
    monkeypatch.setattr(M, "CHUNK", 300)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    x = [(i, [float(c) for c in centre + rng.normal(size=64) * (0.25 if i % 3 else 0.05)]) for i in range(2000)]
    x += [(5000 + i, [float(c) for c in rng.normal(size=64)]) for i in range(300)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in M.vector_duplicates(df).collect()}
    want = brute(x, 0.9)
    assert sum(v[0] for v in want.values()) > 3_000_000
    missed = sum(w[0] - got[k][0] for k, w in want.items())
    assert 0 <= missed <= 0.002 * sum(v[0] for v in want.values())
    assert all(got[k][0] <= w[0] and got[k][1] == w[1] for k, w in want.items())


def test_recall_of_planted_pairs(spark):
    """Pairs at cosines from 0.90 to 0.95 among unrelated vectors."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.95, size=(2000, 1))
    both = np.vstack([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in M.vector_duplicates(df).collect()}
    assert sum(got[i + 2000] == (1, i) for i in range(2000)) >= 0.99 * 2000


def test_least_reached():
    rng = np.random.default_rng(2)
    for _ in range(30):
        linked = rng.random((25, 25)) < 0.05
        linked |= linked.T
        root = M._least_reached(linked, True)
        reach = np.linalg.matrix_power(linked + np.eye(25), 25) > 0
        assert list(root) == [int(np.flatnonzero(r)[0]) for r in reach]
        cross = rng.random((10, 15)) < 0.1
        whole = np.zeros((25, 25), dtype=bool)
        whole[:10, 10:] = cross
        assert list(M._least_reached(cross, False)) == list(M._least_reached(whole | whole.T, True))
