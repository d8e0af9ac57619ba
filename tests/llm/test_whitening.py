"""Whitening against a dense eigendecomposition, and its solver on hard matrices."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyzone.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x binary, n string, v double"


def plain(rows, components=16):
    """(id, component) -> (n, deviation, |whitened|, explained) by numpy's eigensolver."""
    ok = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    lengths = Counter(len(v) for _, v in rows if v)
    dim = max(lengths, key=lambda d: (lengths[d], d)) if lengths else 0
    ok = [(i, [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]) for i, v in ok if len(v) == dim]
    fit = sorted({tuple(x) for _, x in ok})
    n = len(fit)
    if not n:
        return {}
    sums = [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in ok:
        apart = [n * a - s for a, s in zip(x, sums)]
        for k in range(min(components, dim)):
            if e[k] > 1e-13 * e[0] > 0:
                out.setdefault((i, k + 1), []).append(
                    (n, sum(a * a for a in apart), abs(np.dot(apart, u[:, k]) / n / math.sqrt(e[k])), e[k] / e.sum()))
    return out


def same(got, rows):
    want = plain(rows)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter({k: len(v) for k, v in want.items()})
    for r in got:
        close = [w for w in want[r["vec_id"], r["component"]] if w[:2] == (r["n"], r["deviation"])
                 and abs(w[2] - abs(r["whitened"])) < 1e-8 * max(1, w[2])]
        assert close and abs(close[0][3] - r["explained"]) < 1e-9
        assert r["identity_error"] < 1e-9


def asked(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, b"x", "n", 0.5) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op11_embedding_whitening(spark, str(tmp_path)).collect()


def test_given_embeddings(spark):
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{path}/embeddings.parquet'").fetchall()
    got = W.op11_embedding_whitening(spark, path).collect()
    assert len(got) == 500 * 16
    same(got, rows)
    for k in range(1, 17):  # one sign for all rows
        by_id = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k}
        assert abs(sum(by_id.values())) < 1e-6


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 2, 5).astype(np.float32)]) for i in range(40)]
    rows += [(3, rows[3][1])] * 30 + [(None, rows[4][1]), (70, None), (71, []), (72, [1.0, None, 2.0, 3.0, 4.0]),
                                      (73, [1.0, float("nan"), 2.0, 3.0, 4.0]), (74, [float("inf")] * 5),
                                      (75, [1.0, 2.0]), (76, [1e30] * 5), (77, [300.0, -300.0, 0.0, 0.0, 1.0])]
    same(asked(spark, rows, tmp_path), [r for r in rows if r[0] != 76])


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 0.25])] * 3])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert asked(spark, rows, tmp_path) == []


def test_constant_entry_and_very_long_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, *(float(x) for x in rng.normal(0, 1, 300).astype(np.float32))]) for i in range(12)]
    same(asked(spark, rows, tmp_path), rows)  # 11 components


def test_packing_and_exact_sums():
    rows = np.array([[1, -2], [127, 128], [1 << 20, 0], [1 << 45, -5], [-128, 0]])
    packed = W.pack(rows)
    assert [len(p) for p in packed] == [2, 4, 8, 16, 4]
    assert (W.unpack(packed, 2) == rows).all()
    big = W.offsets(rows, 1 << 30, [7, 9])
    assert big.dtype == object and big[3, 0] == (1 << 75) - 7
    assert W.deviations(big)[3] is None and W.deviations(W.offsets(rows[:2], 3, [1, 1])) == [53, 380 ** 2 + 383 ** 2]


def test_solver_on_hard_matrices():
    rng = np.random.default_rng(7)
    for trial in range(150):
        d = int(rng.integers(1, 24))
        s = np.sort(rng.choice([1.0, 1.0, 1 + 1e-9, 1 + 1e-14, 2.0, 3.0, 1e-6], d))[::-1]
        left, right = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
        r = np.linalg.qr((left * s) @ right, mode="r")
        model = W.solved(r, 1, [0] * d, d)
        k = len(model.eigenvalues)
        assert k == d
        assert np.abs(np.sqrt(model.eigenvalues) - s).max() < 1e-12
        assert np.abs(model.directions.T @ model.directions - np.eye(k)).max() < 1e-11
        assert np.abs(r.T @ r @ model.directions - model.directions * model.eigenvalues).max() < 1e-11


def test_dqds_keeps_tiny_values():
    """Graded bidiagonals: every value to high relative accuracy, where the covariance would lose it."""
    diagonal, above = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([1e-3, 1e-8, 1e-13])
    got = np.sqrt(W.squared_singular_values(diagonal, above))
    assert math.isclose(np.prod(got), np.prod(diagonal), rel_tol=1e-13)
