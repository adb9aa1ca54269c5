"""The registered queries themselves, over a folder of tables, against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from test_counts import brute_components, brute_scores, brute_windows
from test_rows import spans

from siftwell.llm import cube, gif, piece_lattice, registry


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(21)
    x = r.normal(size=(200, 16))
    x = np.concatenate([x, x[:30] + r.normal(scale=0.05, size=(30, 16)), x[:5]])
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


@pytest.fixture(scope="module")
def folder(spark, docs, empty, vectors, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/full/documents.parquet")
    empty.write.parquet(f"{at}/none/documents.parquet")
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    v.write.parquet(f"{at}/full/embeddings.parquet")
    v.limit(0).write.parquet(f"{at}/none/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def rows(spark, folder):
    found = {}

    def get(n):
        name = next(x for x in registry.QUERIES if x.startswith(f"op{n}_"))
        if n not in found:
            found[n] = registry.QUERIES[name](spark, f"{folder}/full").collect()
        return found[n]

    return get


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, folder, name):
    out = registry.QUERIES[name](spark, f"{folder}/none")
    assert out.collect() == [] and len(out.columns) >= 3


def test_op1(rows, pairs):
    want = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, round(s, 5)) for i, s in brute_scores(pairs))
    assert sorted((r.doc_id, r.held_out, round(r.score, 5)) for r in rows(1)) == want


def test_op2(rows, pairs):
    texts = {i: t or "" for i, t, _, _ in pairs}
    for r in rows(2):
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans(texts[r.doc_id]))
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_op3(rows, pairs):
    sizes, target = {}, {}
    for i, t, _, s in pairs:
        sizes.setdefault(s, []).append(len((t or "").encode().split()))
    by_id = {i: s for i, _, _, s in pairs}
    taken = {}
    for r in rows(3):
        s = by_id[r.doc_id]
        assert r.source_size == sum(sizes[s]) and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        target[s], taken[s] = r.target, taken.get(s, 0) + r.taken
    assert sum(target.values()) == pytest.approx(1.5 * sum(map(sum, sizes.values())))
    for s in sizes:
        assert target[s] <= 2 * sum(sizes[s]) + 1e-6 and abs(taken[s] - target[s]) <= max(0.02 * target[s], max(sizes[s]) / 2)


def test_op5(rows, pairs):
    texts = {i: (t or "").encode() for i, t, _, _ in pairs}
    for r in rows(5):
        raw = texts[r.doc_id]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = gif.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        counts = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8).tolist()
        frames = math.ceil(len(payload) / 64 / gif.FRAME_ROWS)
        assert r.feature == f"{frames}:{frames * 100}:{'/'.join(map(str, counts))}"


def test_op6(rows, vectors):
    x = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    least = np.arange(len(x))
    for _ in range(len(x)):
        now = np.array([least[near[i]].min() for i in range(len(x))])
        if (now == least).all():
            break
        least = now
    want = [(i, int(near[i].sum()) - 1, int(least[i]), bool(least[i] == i)) for i in range(len(x))]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows(6)) == want


def test_op7(rows, pairs):
    v = piece_lattice.load(piece_lattice.default_vocabulary())
    texts = {i: t for i, t, _, _ in pairs}
    for r in rows(7):
        t = texts[r.doc_id]
        ways = piece_lattice.segmented(v, t, 4) if t else []
        ids = np.frombuffer(ways[0][1], np.int32).tolist() if ways else []
        assert r.intact and r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.score == pytest.approx(ways[0][0] / 1e6 if ways else 0.0)


def test_op8(rows, pairs):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows(8)) == brute_components(pairs)


def test_op9(rows, pairs):
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_windows(pairs, 35))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows(9)) == want


def test_op10(rows, pairs):
    texts = {i: t for i, t, _, _ in pairs}
    for r in rows(10):
        has = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred in ("en", "de")) if has else (r.lang_pred == "und" and r.score == 0)


def test_targets_against_sql(spark, docs):
    import duckdb

    sized = docs.selectExpr("source", "coalesce(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) as size").groupBy("source").agg({"size": "sum", "*": "count"})
    sources = sized.selectExpr("source", "`count(1)` as n", "`sum(size)` as source_size")
    got = {r.source: r.target for r in cube.targets(sources).collect()}
    rows_ = [(r.source, r.source_size) for r in sources.collect()]
    values = ", ".join(f"({'NULL' if s is None else repr(s)}, {n})" for s, n in rows_)
    want = duckdb.sql(f"""
        WITH s AS (SELECT *, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM (VALUES {values}) t(source, size)),
        r AS (SELECT *, 2.0 * size / w AS ratio FROM s),
        o AS (SELECT *, (1.5 * sum(size) OVER () - coalesce(sum(2.0 * size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r)
        SELECT source, CASE WHEN ratio <= level THEN 2.0 * size ELSE w * (SELECT level FROM o WHERE ratio > level ORDER BY ratio LIMIT 1) END FROM o""").fetchall()
    assert got == {s: pytest.approx(t) for s, t in want}
