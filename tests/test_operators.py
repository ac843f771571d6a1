import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import runtime
from vecspark.operators import deletes, orphans, paging, search, stats
from vecspark.plans import requests
from vecspark.functions import vectors


def points(spark, rows):
    return spark.createDataFrame(rows, "point_id string, document_id string, embedding array<float>, extra string")


ROWS = [("p1", "d1", [1.0, 0.0], "x"), ("p2", "d2", [1.0, 0.0], "x"), ("p3", "dx", [0.9, 0.1], "x"), ("p4", "d1", [-1.0, 0.0], "x"), ("p5", "d1", None, "x")]


def test_top_k_ties_zero_negative(spark):
    p = points(spark, ROWS + [("p0", "d1", [0.0, 0.0], "x")])
    got = search.top_k(p, [1.0, 0.0], 4).collect()
    assert [r["point_id"] for r in got] == ["p0", "p1", "p2", "p3"]  # NaN first, ties by id
    assert search.top_k(p, [1.0, 0.0], 0).count() == 0
    assert search.top_k(p, [1.0, 0.0], 99).count() == 5
    assert search.top_k(p, [1.0, 0.0], 99).collect()[-1]["relevance_score"] == -1.0
    with pytest.raises(ValueError):
        search.top_k(p, [1.0, 0.0], -1)


def test_orphans_use_up_places_and_structs_keep_both_sides(spark):
    docs = spark.createDataFrame([("d1", "m1"), ("d2", "m2")], "document_id string, content_md5 string")
    got = search.search(points(spark, ROWS), docs, [1.0, 0.0], 3).collect()
    assert [r["point"]["point_id"] for r in got] == ["p1", "p2"]
    assert "embedding" not in got[0]["point"].asDict() and got[0]["document"]["content_md5"] == "m1"
    plan = search.search(points(spark, ROWS), docs, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("at_once", [4096, 3])
def test_batch_equals_single(spark, monkeypatch, at_once):
    monkeypatch.setattr(search, "QUERY_ELEMENTS", at_once * 8)
    rng = np.random.RandomState(0)
    x = rng.normal(size=(120, 8))
    rows = [(f"p{i:03d}", "d", [float(v) for v in r], "x") for i, r in enumerate(x)]
    p = points(spark, rows + rows[:30] + [("bad", "d", [1.0], "x"), ("nul", "d", None, "x")]).repartition(5)
    q = spark.createDataFrame(
        [(i, [float(v) for v in rng.normal(size=8)], k) for i, k in enumerate([5, 1, None, 0, 7, 200])] + [(99, None, 3), (98, [0.0] * 8, 3)],
        "request_id long, query_vector array<float>, top_k int",
    )
    got = {}
    for r in search.batch_top_k(p, q, dim=8).collect():
        got.setdefault(r["request_id"], {})[r["rank_no"]] = r["point_id"]
    assert {i: len(v) for i, v in got.items()} == {0: 5, 1: 1, 2: 5, 3: 5, 4: 7, 5: 120}
    v = q.where("request_id = 4").first()["query_vector"]
    single = [r["point_id"] for r in search.top_k(p.where("size(embedding) = 8").distinct(), v, 7).collect()]
    assert [got[4][k] for k in range(1, 8)] == single
    assert search.batch_top_k(p, q.limit(0), dim=8).count() == 0


def test_keyset(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i % 2 else "b") for i in range(10)], "id string, s string")

    def ids(**k):
        return [r["id"] for r in paging.keyset(df, "id", **k).collect()]

    assert ids(limit=3) == ["k0", "k1", "k2", "k3"]
    assert ids(limit=3, after="k3", before="k5") == ["k4", "k5", "k6", "k7"]  # before is ignored
    assert ids(limit=3, before="k3", after="k9", order="desc") == ["k2", "k1", "k0"]
    assert ids(limit=2, s="a", after="k1") == ["k3", "k5", "k7"]
    for bad in ({"order": "up"}, {"limit": -1}):
        with pytest.raises(ValueError):
            ids(**bad)


def test_delete_predicates_are_null_safe(spark):
    df = spark.createDataFrame([("a", "d1", "m1"), ("b", None, "m2"), ("c", "d1", None)], "point_id string, document_id string, content_md5 string")
    assert df.where(deletes.any_in(document_id=["d1"], point_id=[])).count() == 2
    assert df.where(~deletes.any_in(document_id=["d1"], content_md5=None)).count() == 1
    assert df.where(deletes.any_in(point_id=[])).count() == 0
    assert [r[0] for r in df.where(deletes.outdated("d1", "new")).collect()] == ["a"]


@pytest.mark.parametrize("n", [2, 3, 19, 100])
def test_query_times(spark, n):
    v = [float((i * 7919) % 101) for i in range(n)]
    r = stats.query_times(spark.createDataFrame([(x,) for x in v] + [(None,)], "t double"), "t").first()
    want = statistics.quantiles(v, n=20)[18]
    assert r["queries"] == n and r["median"] == statistics.median(v) and r["min"] == min(v)
    assert abs(r["p95"] - min(max(v), want)) < 1e-9
    assert stats.query_times(spark.createDataFrame([], "t double"), "t").first()["queries"] == 0


def test_request_routes(spark):
    b64 = vectors.encode_base64([0.5] * 64)
    rows = [
        (1, "plain text", None, None, "embed"), (2, b64, None, None, "base64"), (3, b64, None, " Plaintext ", "embed"),
        (4, "internationalize", None, None, "embed"), (5, "internationalize", None, "base64", "invalid"), (6, "text", None, "VECTOR", "invalid"),
        (7, None, [1.0] * 64, "plaintext", "vector"), (8, "", None, None, "invalid"), (9, None, None, None, "invalid"), (10, "x", None, "odd", "embed"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "request_id long, query string, query_vector array<float>, encoding string")
    got = {r["request_id"]: r for r in requests.dispatch(df).collect()}
    assert {i: r["route"] for i, r in got.items()} == {r[0]: r[4] for r in rows}
    assert got[2]["vector"] == [0.5] * 64 and got[7]["vector"] == [1.0] * 64 and got[1]["vector"] is None


PT = "pt-0000000003e8-0000-7000-8000-000000000000"  # one second after the epoch


def orphan_frames(spark, pts, res, store):
    return (
        spark.createDataFrame(pts, "point_id string, document_id string, content_md5 string, ref_field string"),
        spark.createDataFrame(res, "result_id string, document_id string, searched_at timestamp, key string"),
        spark.createDataFrame(store, "document_id string, content_md5 string, created_at long"),
        spark.createDataFrame([("gone", "x")], "document_id string, reason string"),
        spark.createDataFrame([("soon",), ("gone",)], "document_id string"),
    )


def test_orphans(spark):
    import datetime as dt

    when = dt.datetime(2031, 5, 31, 23, 59, 59)
    pts = [(PT, " A ", "M1", "x"), (PT, " A ", "M1", "x"), ("pt-00000000-0001", "gone", None, "x"), ("pt-00000000-0002", "soon", "m9", "x"),
           ("pt-00000000-0003", "none", " m1", "x"), ("pt-00000000-0004", None, None, "x")]
    res = [("r1", "late", when, "k"), ("r2", None, when, "k"), ("r3", "a", when, "k"), ("r4", "void", None, "k")]
    store = [("a", "m1", 1), ("LATE", "m2", 4_000_000_000), ("late2", None, None)]
    got = {tuple(r) for r in orphans.orphan_references(*orphan_frames(spark, pts, res, store)).collect()}
    assert got == {
        ("points", "document_id", "pt-00000000-0001", "removed", "1970-01"), ("points", "document_id", "pt-00000000-0002", "pending", "1970-01"),
        ("points", "document_id", "pt-00000000-0003", "missing", "1970-01"), ("points", "content_md5", "pt-00000000-0002", "missing", "1970-01"),
        ("search_results", "document_id", "r1", "late", "2031-05"), ("search_results", "document_id", "r4", "missing", None),
    }


def test_orphans_hot_key_and_empty(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_SHARE", 3)
    pts = [(f"pt-00000000-{i:04x}", "hot" if i % 3 else f"n{i}", None, "x") for i in range(300)]
    args = orphan_frames(spark, pts, [], [])
    assert orphans.orphan_references(*args).count() == 300
    assert orphans.orphan_report(orphans.orphan_references(*args)).first()["orphans"] == 300
    assert orphans.orphan_references(*(a.limit(0) for a in args)).count() == 0


def test_join_groups_splits_hot_keys(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert runtime.join_groups(rows, groups, "k", "n", 40_000).count() == 40_000


def test_approximate_search(spark):
    from vecspark.operators.ann import CosineIndex

    rng = np.random.RandomState(4)
    x = rng.normal(size=(300, 8))
    rows = [(f"p{i:03d}", "d", [float(v) for v in r], "x") for i, r in enumerate(x)]
    p = points(spark, rows + [("z", "d", [0.0] * 8, "x"), ("n", "d", None, "x"), ("s", "d", [1.0], "x")])
    index = CosineIndex(p, 8)
    hits = 0
    for q in range(5):
        v = [float(t) for t in x[q] + rng.normal(size=8) * 0.05]
        got = index.search(v, 5).collect()
        want = {r["point_id"] for r in search.top_k(points(spark, rows), v, 5).collect()}
        assert got[0]["point_id"] == f"p{q:03d}" and len(got) == 5 and got[0]["relevance_score"] > 0.98
        hits += len(want & {r["point_id"] for r in got})
    assert hits >= 20
    assert index.search([1.0] * 8, 0).count() == 0
    for bad in ([1.0], [0.0] * 8):
        with pytest.raises(ValueError):
            index.search(bad, 1)
