import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import _common, itq_neighbours, registry


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 24))
    near = x[:40] + r.normal(scale=0.02, size=(40, 24))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(np.concatenate([x, near]))]
    rows += [(1000 + i, rows[5][1], 1) for i in range(20)] + [(7, rows[7][1], 2)]
    odd = [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, [1.0] * 23 + [None], 0), (2004, [float("inf")] * 24, 0), (2005, [1.0, 2.0], 0), (2006, [], 0), (None, rows[9][1], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = itq_neighbours.near_duplicates(table).collect()
    v = np.array([x[1] for x in rows] + [rows[9][1]], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [x[0] for x in rows] + [None]
    linked = v @ v.T >= 0.95
    want = sorted(repr((i, int(linked[k].sum()) - 1)) for k, i in enumerate(ids))
    mine = sorted(repr((r.vec_id, r.n_links)) for r in got if not (r.vec_id or 0) >= 2000)
    assert mine == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if (r.vec_id or 0) >= 2000)
    assert {r.component_id for r in got if r.vec_id in (5, 305, 1003)} == {5}
    assert itq_neighbours.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8, 0.9, 0.99])
def test_vectors_with_a_common_direction(spark, shared):
    r = np.random.default_rng(11)
    one = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, d = (1000, 64) if shared > 0.95 else (3000, 64)
    x = one(math.sqrt(shared) * one(r.normal(size=d)) + math.sqrt(1 - shared) * one(r.normal(size=(n, d))))
    way = r.normal(size=(n, d))
    way = one(way - (way * x).sum(1, keepdims=True) * x)
    cos = r.uniform(0.951, 0.96, size=(n, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * way]).astype(np.float32)
    got = itq_neighbours.near_duplicates(spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    u = one(v.astype(np.float64))
    want, mine = int((u @ u.T >= 0.95).sum()) - 2 * n, sum(r.n_links for r in got)
    assert want >= 2 * n and 0.96 * want <= mine <= want


def test_every_length_has_its_links(spark):
    r = np.random.default_rng(12)
    rows = []
    for d, n in ((8, 40), (24, 60), (32, 20)):
        x = r.normal(size=(n, d))
        rows += [(1000 * d + i, v.tolist()) for i, v in enumerate(np.concatenate([x, x + r.normal(scale=0.01, size=x.shape)]).astype(np.float32))]
    got = {r.vec_id: r for r in itq_neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for i, v in unit.items():
        assert got[i].n_links == sum(len(w) == len(v) and w @ v >= 0.95 for j, w in unit.items() if j != i) >= 1
    assert all(got[1000 * d + n + i].component_id < 1000 * d + n for d, n in ((8, 40), (24, 60), (32, 20)) for i in range(n))


def test_vectors_without_an_id_link_others(spark):
    r = np.random.default_rng(13)
    x = r.normal(size=(40, 16))
    way = x[1] - (x[1] @ x[0]) / (x[0] @ x[0]) * x[0]
    a, b = x[0] / np.linalg.norm(x[0]), way / np.linalg.norm(way)
    turned = lambda t: (math.cos(t) * a + math.sin(t) * b).tolist()
    rows = [(1, turned(0.0)), (None, turned(0.3)), (9, turned(0.6))] + [(100 + i, v.tolist()) for i, v in enumerate(x[2:])]
    got = {r.vec_id: r for r in itq_neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in (1, None, 9)] == [1, 2, 1]
    assert got[1].component_id == got[9].component_id == 1 and got[None].component_id is None


def test_layout_meets_the_recall_it_promises():
    for n in (10, 10**4, 10**9):
        s, m, far = itq_neighbours.layout(n)
        p = itq_neighbours.flip_rate(0.95)
        meet = (1 - p) ** s + s * p * (1 - p) ** (s - 1)
        assert 1 - (1 - meet) ** m >= 0.98 and far < m * s and 2**s >= n or s == 8


def test_stages_keep_the_columns_and_act_on_what_they_get(spark, docs):
    now, seen = docs.select("doc_id", "text", "lang", "source", "n_chars"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "").collect(), now.schema)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = now.collect()
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert not ids("language_id") & {400, 401, 402, 406} and 405 in ids("language_id")
    assert ids("line_dedup") == ids("language_id")
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert ids("jaccard_join") <= ids("line_dedup")
    last = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert last.count() == now.count() and last.where("not intact").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "source_mix", "pieces"]


def test_stages_on_an_empty_table(spark, empty):
    now = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "")
        assert out.count() == 0


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert math.isclose(itq_neighbours.flip_rate(0), 0.5)


def test_hot_keys_are_dealt_to_many_tasks(spark, monkeypatch):
    left = spark.range(3000).selectExpr("id", "case when id < 2000 then 7 when id < 2100 then null else id end as k")
    right = _common.saved(left.where("k is not null").groupBy("k").agg(F.count("*").alias("m")), "right")
    monkeypatch.setattr(_common, "HOT", 10)
    got = _common.joined_on(left, right, ["k"], "m", F.col("id"), "left")
    assert sorted((r.id, r.k, r.m) for r in got.collect()) == [(i, *((7, 2000) if i < 2000 else (None, None) if i < 2100 else (i, 1))) for i in range(3000)]
    assert sorted(r.id for r in _common.joined_on(left, right, ["k"], "m", F.col("id")).collect()) == [*range(2000), *range(2100, 3000)]


def test_intermediate_tables_can_be_cleaned(spark):
    path = _common.fresh(spark, "x")
    spark.range(3).write.parquet(path)
    _common.clean(spark)
    assert not os.path.exists(path.removeprefix("file://")) and not _common._made
