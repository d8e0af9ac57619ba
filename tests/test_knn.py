"""Grid k-NN equals brute force, including copies, clusters, far points and tiny training sets."""

import numpy as np
import pytest

from tallyzone.operators import knn
from tallyzone.operators.knn import knn_neighbors, knn_vote


def _brute(train, queries, k):
    out = {}
    for qid, qlat, qlon in queries:
        d = [((qlat - t[1]) * (qlat - t[1]) + (qlon - t[2]) * (qlon - t[2]), t[0], t[3]) for t in train]
        d.sort()
        out[qid] = [(x[1], x[2]) for x in d[:k]]
    return out


def _as32(x):
    return float(np.float32(x))


def _points(seed, n_train, n_query):
    rng = np.random.default_rng(seed)
    train = []
    tid = 0
    # uniform background
    for _ in range(n_train // 2):
        train.append((tid, _as32(40.5 + rng.random() * 0.4), _as32(-74.2 + rng.random() * 0.5),
                      int(rng.integers(10001, 10020))))
        tid += 1
    # dense cluster
    for _ in range(n_train // 3):
        train.append((tid, _as32(40.7 + rng.normal() * 1e-4), _as32(-73.9 + rng.normal() * 1e-4),
                      int(rng.integers(10001, 10004))))
        tid += 1
    # many exact copies of one coordinate pair
    for _ in range(n_train - len(train)):
        train.append((tid, _as32(40.6), _as32(-74.0), int(rng.integers(10005, 10008))))
        tid += 1
    queries = []
    for qid in range(n_query):
        kind = qid % 4
        if kind == 0:
            queries.append((qid, _as32(40.5 + rng.random() * 0.4), _as32(-74.2 + rng.random() * 0.5)))
        elif kind == 1:
            queries.append((qid, _as32(40.7 + rng.normal() * 3e-4), _as32(-73.9 + rng.normal() * 3e-4)))
        elif kind == 2:
            queries.append((qid, _as32(40.6 + rng.normal() * 1e-5), _as32(-74.0)))
        else:
            queries.append((qid, _as32(rng.uniform(-10, 60)), _as32(rng.uniform(-120, 10))))
    return train, queries


@pytest.mark.parametrize("seed,k,leaf", [(1, 5, 32), (3, 7, 32), (4, 3, 2)])
def test_grid_equals_brute_force(spark, seed, k, leaf, monkeypatch):
    monkeypatch.setattr(knn, "TILE", leaf)
    train, queries = _points(seed, 900, 120)
    tdf = spark.createDataFrame(train, "tid long, lat double, lon double, zip int")
    qdf = spark.createDataFrame(queries, "qid long, lat double, lon double")
    got = {}
    for r in knn_neighbors(tdf, qdf, k).collect():
        got.setdefault(r["qid"], []).append((r["j"], r["tid"], r["zip"]))
    want = _brute(train, queries, k)
    assert set(got) == set(want)
    for qid, rows in got.items():
        rows.sort()
        assert [(t, z) for _, t, z in rows] == want[qid], qid


def test_candidates_stay_few_next_to_a_dense_cluster(spark):
    # 20,000 points in one cluster and 400 queries outside it: the whole product would be 8,000,000 rows
    rng = np.random.default_rng(7)
    train = [(i, _as32(40.7 + rng.normal() * 2e-4), _as32(-73.9 + rng.normal() * 2e-4), 10001) for i in range(20_000)]
    queries = [(i, _as32(40.0 + rng.random() * 1.5), _as32(-74.6 + rng.random() * 1.5)) for i in range(400)]
    tdf = spark.createDataFrame(train, "tid long, lat double, lon double, zip int")
    qdf = spark.createDataFrame(queries, "qid long, lat double, lon double")
    per = knn.candidates(tdf, qdf, 5).groupBy("qlat", "qlon").count().agg({"count": "max"}).first()[0]
    assert per <= 3000


def test_vote_ties_smallest_zip(spark):
    nb = spark.createDataFrame(
        [(1, 1, 10, 10005), (1, 2, 11, 10003), (1, 3, 12, 10005), (1, 4, 13, 10003), (1, 5, 14, 10009),
         (2, 1, 10, 10002)],
        "qid long, j int, tid long, zip int")
    got = {r["qid"]: r["zip"] for r in knn_vote(nb).collect()}
    assert got == {1: 10003, 2: 10002}


def test_fewer_training_points_than_k(spark):
    tdf = spark.createDataFrame([(1, 40.0, -74.0, 10001), (2, 40.1, -74.0, 10002)],
                                "tid long, lat double, lon double, zip int")
    qdf = spark.createDataFrame([(7, 40.09, -74.0)], "qid long, lat double, lon double")
    rows = sorted((r["j"], r["tid"]) for r in knn_neighbors(tdf, qdf, 5).collect())
    assert rows == [(1, 2), (2, 1)]


def test_no_training_points(spark):
    tdf = spark.createDataFrame([], "tid long, lat double, lon double, zip int")
    qdf = spark.createDataFrame([(7, 40.09, -74.0)], "qid long, lat double, lon double")
    assert knn_neighbors(tdf, qdf, 5).count() == 0


def test_query_copies_share_one_search(spark):
    train, _ = _points(5, 600, 0)
    tdf = spark.createDataFrame(train, "tid long, lat double, lon double, zip int")
    same = [(qid, _as32(40.65), _as32(-74.05)) for qid in range(200)]
    qdf = spark.createDataFrame(same + [(999, _as32(40.7), _as32(-73.9))], "qid long, lat double, lon double")
    got = {}
    for r in knn_neighbors(tdf, qdf, 5).collect():
        got.setdefault(r["qid"], []).append((r["j"], r["tid"]))
    want = _brute(train, same[:1] + [(999, _as32(40.7), _as32(-73.9))], 5)
    assert len(got) == 201
    for qid, rows in got.items():
        ref = want[0] if qid != 999 else want[999]
        assert [t for _, t in sorted(rows)] == [t for t, _ in ref]


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_coord = st.tuples(st.integers(0, 40), st.integers(0, 40))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(train=st.lists(st.tuples(_coord, st.integers(10001, 10006)), min_size=1, max_size=60),
       queries=st.lists(_coord, min_size=1, max_size=15),
       k=st.integers(1, 6), scale=st.sampled_from([1e-5, 1e-3, 0.1]))
def test_random_grid_equals_brute_force(spark, train, queries, k, scale):
    # lattice points (many exact ties and copies) at several scales
    tr = [(i, _as32(40.0 + a * scale), _as32(-74.0 + b * scale), z) for i, ((a, b), z) in enumerate(train)]
    qs = [(i, _as32(40.0 + a * scale + scale / 3), _as32(-74.0 + b * scale)) for i, (a, b) in enumerate(queries)]
    tdf = spark.createDataFrame(tr, "tid long, lat double, lon double, zip int")
    qdf = spark.createDataFrame(qs, "qid long, lat double, lon double")
    got = {}
    for r in knn_neighbors(tdf, qdf, k).collect():
        got.setdefault(r["qid"], []).append((r["j"], r["tid"]))
    want = _brute(tr, qs, k)
    assert {q: [t for _, t in sorted(v)] for q, v in got.items()} == {q: [t for t, _ in v] for q, v in want.items()}
