import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import neighbours


def made(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(3)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def exact(vectors, ask, k):
    """Nearest by brute force: (id, score), ties to the smaller id."""
    out = {}
    for i, q in vectors.items():
        if ask(i):
            scored = sorted((-float(np.dot(q, v)), j) for j, v in vectors.items() if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def recall(got, want):
    hit = sum(len({j for _, j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items())
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["directions", "lengths", "groups"])
def test_recall_of_narrow_windows(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 24))
    if kind == "groups":
        x = 3 * rng.standard_normal((100, 24))[rng.integers(100, size=4000)] + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.uniform(0.5, 2, (4000, 1))
    x = x.astype(np.float32).astype(float)
    got = found(neighbours.search(made(spark, list(enumerate(x.tolist()))), F.col("vec_id") % 20 == 0, k=20, block=64, sample=64))
    want = exact(dict(enumerate(x)), lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all([r for r, _, _ in g] == list(range(1, 21)) for g in got.values())
    for i, g in got.items():
        assert np.allclose([s for _, _, s in g], [x[i] @ x[j] for _, j, _ in g], atol=1e-12)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(g, g[1:], strict=False))
    assert recall(got, want) >= 0.93


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(4).tolist()) for k in range(1, 60)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(100, 400)]
    rows += [(400, None), (420, [0.0] * 4), (440, [1.0, float("nan"), 0.0, 0.0]), (460, [1.0, None, 0.0, 0.0]), (480, []), (500, [float("inf")] * 4)]
    rows += [(520, [1.0, 0.0]), (521, [2.0, 0.0]), (None, [1.0, 1.0])]
    got = found(neighbours.search(made(spark, rows), F.col("vec_id") % 20 == 0, k=5))
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 400}
    want = exact(good, lambda i: i % 20 == 0, 5)
    assert {i: [j for _, j, _ in g] for i, g in got.items() if i < 400} == {i: [j for j, _ in w] for i, w in want.items()}
    assert got[520] == [(1, 521, 2.0), (2, None, 1.0)]
    assert set(got) == set(want) | {520}


def test_repeated_ids_and_few_rows(spark):
    got = found(neighbours.search(made(spark, [(20, [1.0, 0.0]), (20, [1.0, 0.0])]), F.col("vec_id") % 20 == 0, k=5))
    assert got[20] == [(1, 20, 1.0), (1, 20, 1.0)]
    assert found(neighbours.search(made(spark, [(20, [1.0, 0.0])]), F.col("vec_id") % 20 == 0)) == {}
    assert found(neighbours.search(made(spark, []), F.col("vec_id") % 20 == 0)) == {}


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbouring_cells(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = neighbours.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_codes_bound_their_loss():
    x = np.random.default_rng(7).standard_normal((50, 16)) * 10.0 ** np.arange(-25, 25)[:, None]
    small, scale, lost = neighbours.codes(x)
    assert (np.linalg.norm(x - small * scale[:, None], axis=1) <= lost).all()
