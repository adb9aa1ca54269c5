"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the centred, normalised vectors is learned on a bounded sample so that signs of the rotated components
make balanced binary codes (iterative quantisation); further rotations from other starts give further bits. The code is
cut into tables of s bits, s being the logarithm of the number of vectors, so a bucket holds few. Vectors meet if
their keys in some table differ in one bit at most: the one with a 0 there asks for the bucket with a 1. Candidates
whose whole codes are too far apart for the threshold go; the rest are reranked by the cosine of the vectors themselves in
double precision. At the threshold a pair meets with probability RECALL: the number of tables and the most differing bits are
taken from pairs at the threshold that are made from the sample and coded by the learned projection itself, since centring
widens the angles of vectors with a common direction. Where that takes about as many buckets as there are vectors, every vector is compared with every other.

Equal vectors form one class and go on as one; links between different vectors are counted all, as n_links asks for.

Nulls: a vector that is null or zero or has a null or non-finite component links with nothing. Vectors of different lengths
do not link; each length has a rotation and tables of its own. A null vec_id counts in the links of others, but has no component.
Ties: a cosine of exactly the threshold links. Very long vectors take memory a row, nothing else. Extra columns, whatever their
names, are left out. Classes are known by 64-bit hashes.
Empty table: empty result. Repeated rows are vectors of their own. The sample (SAMPLE vectors of a length) trains the rotation only;
every vector is indexed.
"""

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import joined_on, saved, table
from ._components import components

COSINE, RECALL, SAMPLE, STEPS = 0.95, 0.98, 4096, 40
#: Pairs at the threshold of each kind that size the tables; vectors that all others are compared with at once.
PAIRS, BLOCK = 4096, 8192


def flip_rate(cosine: float) -> float:
    """The share of bits in which two vectors at this cosine differ, as for random hyperplanes."""
    return math.acos(cosine) / math.pi


def layout(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a table, tables, most differing bits of a whole code) for n vectors."""
    s = max(8, math.ceil(math.log2(max(2, n))))
    p = flip_rate(cosine)
    meet = (1 - p) ** s + s * p * (1 - p) ** (s - 1)
    m = max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    bits = m * s
    return s, m, math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))


def learned(x: np.ndarray, bits: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of so many columns): blocks of rotations that bring the vectors near the corners of a cube."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    centred = x - mean
    values, axes = np.linalg.eigh(centred.T @ centred)
    blocks, left = [], bits
    while left > 0:
        width = min(left, x.shape[1])
        main = axes[:, np.argsort(-values)[:width]]
        v = centred @ main
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(STEPS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        blocks.append(main @ turn)
        left -= width
    return mean, np.concatenate(blocks, 1)


def at_threshold(x: np.ndarray, cosine: float, seed: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at this cosine: vectors of the sample moved any way, and moved along differences of other vectors."""
    rng = np.random.default_rng(seed)
    a, b, c = (x[rng.integers(0, len(x), PAIRS)] for _ in range(3))
    out = []
    for way in (rng.standard_normal(a.shape), b - c):
        way = way - (way * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(way, axis=1)
        some = size > 1e-6
        out.append((a[some], cosine * a[some] + math.sqrt(1 - cosine * cosine) * way[some] / size[some, None]))
    return [p for p in out if len(p[0])]


def _meeting(u: np.ndarray, s: int) -> np.ndarray:
    """Whether each pair's keys differ in one bit at most in some table; u has the differing bits."""
    return (u.reshape(len(u), -1, s).sum(2) <= 1).any(1)


def fitted(x: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int, np.ndarray, np.ndarray] | None:
    """(bits of a table, tables, most differing bits of a code, mean, projection) for n vectors like the sample x.

    layout() is where it starts; tables are added until the made pairs meet often enough. The code has the bits of
    layout()'s tables. None: so many tables cost more than comparing all vectors.
    """
    s, m, far = layout(n, cosine, recall)
    code = s * m
    mean, projection = learned(x, code)
    differ = lambda p, q, w: ((p - mean) @ w >= 0) != ((q - mean) @ w >= 0)
    pairs = at_threshold(x, cosine)
    first = [differ(p, q, projection) for p, q in pairs]
    met = [_meeting(u, s) for u in first]
    apart = [u.sum(1) for u in first]
    far = max([far, *(max(int(k.max()), math.ceil(k.mean() + 4.5 * k.std())) for k in apart)])
    while any(k.mean() < recall for k in met):
        more = max(1, min(m // 4, 2048 // s))
        if 2 * (m + more) * (s + 1) > n or (m + more) * s > 1 << 16:
            return None
        new = learned(x, s * more, 6 + m)[1]
        met = [k | _meeting(differ(p, q, new), s) for k, (p, q) in zip(met, pairs, strict=True)]
        projection, m = np.concatenate([projection, new], 1), m + more
    return s, m, far, mean, projection


def _normal(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(classes: DataFrame, mean: np.ndarray, projection: np.ndarray, s: int, m: int, code: int) -> DataFrame:
    """(rep, keys, code): the key of each table, and the code, so many first bits, in words of 63 bits."""
    shared = classes.sparkSession.sparkContext.broadcast((mean, projection))

    def run(batches):
        mean, projection = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bit = (_normal(batch.column("embedding").to_pylist()) - mean) @ projection >= 0
            keys = bit.reshape(len(bit), m, s) @ (1 << np.arange(s, dtype=np.int64))
            words = [bit[:, a : min(code, a + 63)] @ (1 << np.arange(min(63, code - a), dtype=np.int64)) for a in range(0, code, 63)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(np.stack(words, 1).tolist(), pa.list_(pa.int64()))], names=["rep", "keys", "code"])

    return classes.select("rep", "embedding").mapInArrow(run, "rep bigint, keys array<bigint>, code array<bigint>")


def candidates(codes: DataFrame, s: int, far: int) -> DataFrame:
    """(a, b) of classes that meet in some table and whose codes differ in at most `far` bits."""
    each = codes.select("rep", "code", F.posexplode("keys").alias("t", "key"))
    ones = F.transform(F.filter(F.sequence(F.lit(0), F.lit(s - 1)), lambda b: F.col("key").bitwiseAND(_bit(b)) == 0), lambda b: F.col("key").bitwiseOR(_bit(b)))
    asks = each.select("t", F.col("rep").alias("x"), F.col("code").alias("cx"), F.col("key").alias("own"), F.explode(F.concat(F.array("key"), ones)).alias("key"))
    met = each.join(asks, ["t", "key"]).where((F.col("own") != F.col("key")) | (F.col("x") < F.col("rep")))
    apart = F.aggregate(F.zip_with("code", "cx", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, c: a + c)
    return met.where(apart <= far).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def every_link(classes: DataFrame, n: int, cosine: float) -> DataFrame:
    """(a, b, ma, mb) as reranked() of all pairs of n classes: a block of them at a time goes to every task."""
    spark = classes.sparkSession
    blocks = math.ceil(n / BLOCK)
    block = F.pmod(F.xxhash64("rep", F.lit(9)), F.lit(blocks))
    out = []
    for k in range(blocks):
        rows = classes.where(block == k).select("rep", "m", "embedding").collect()
        if not rows:
            continue
        own = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.float64))
        out.append(saved(classes.select("rep", "m", "embedding").mapInArrow(_against(spark.sparkContext.broadcast(own), cosine), "a bigint, b bigint, ma bigint, mb bigint"), "links"))
    return functools.reduce(DataFrame.union, out)


def _against(shared, cosine: float):
    def run(batches):
        reps, ms, y = shared.value
        ny = np.linalg.norm(y, axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rep, m = (part.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "m"))
                x = np.array(part.column("embedding").to_pylist(), np.float64)
                nx = np.linalg.norm(x, axis=1)
                i, j = np.nonzero((x / nx[:, None]) @ (y / ny[:, None]).T >= cosine - 1e-9)
                some = rep[i] < reps[j]
                i, j = i[some], j[some]
                some = (x[i] * y[j]).sum(1) / (nx[i] * ny[j]) >= cosine
                i, j = i[some], j[some]
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (rep[i], reps[j], m[i], ms[j])], names=["a", "b", "ma", "mb"])

    return run


def _bit(b):
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def reranked(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, ma, mb) with the classes' sizes, of pairs at this cosine or above."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("va", "vb"))
            near = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            yield batch.select(["a", "b", "ma", "mb"]).filter(pa.array(near))

    side = lambda z: classes.select(F.col("rep").alias(z), F.col("m").alias(f"m{z}"), F.col("embedding").alias(f"v{z}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", "va", "vb").mapInArrow(run, "a bigint, b bigint, ma bigint, mb bigint")


def linked(usable: DataFrame, chosen: list, cosine: float) -> DataFrame:
    """(a, b, ma, mb) of classes of one length at this cosine or above; chosen is a sample of their vectors."""
    n = usable.count()
    found = fitted(_normal(chosen), n, cosine)
    if found is None:
        return every_link(usable, n, cosine)
    s, m, far, mean, projection = found
    codes = saved(coded(usable, mean, projection, s, m, s * layout(n, cosine)[1]), "codes")
    return saved(reranked(saved(candidates(codes, s, far), "candidates"), usable, cosine), "links")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    v = F.col(embedding)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = plain.withColumns({"h": F.when(F.col("sound"), F.xxhash64("embedding")), "g": F.when(F.col("sound"), F.xxhash64("embedding", F.lit(1)))})
    # a class goes by a number of its own, as one whose vectors have no vec_id links others too
    rep = F.xxhash64("h", "g").alias("rep")
    classes = keyed.where("sound").groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("embedding").alias("embedding"))
    classes = saved(classes.select(rep, "h", "g", "least", "m", "embedding"), "classes")
    size = F.size("embedding")
    lengths = sorted(r[0] for r in classes.groupBy(size.alias("d")).count().where("count > 1").collect())
    links = classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("m").alias("ma"), F.col("m").alias("mb")).limit(0)
    for d in lengths:
        usable = classes.where(size == d)
        chosen = [r[0] for r in usable.select("embedding", F.xxhash64("rep", F.lit(6)).alias("o"), "rep").orderBy("o", "rep").limit(sample).collect()]
        found = linked(usable, chosen, cosine)
        links = found if d == lengths[0] else links.union(found)
    roots = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    others = links.select(F.col("a").alias("rep"), F.col("mb").alias("o")).union(links.select("b", "ma")).groupBy("rep").agg(F.sum("o").alias("others"))
    known = classes.select("rep", "h", "g", "least", "m").join(others, "rep", "left").join(roots, "rep", "left")
    n_links = (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    known = saved(known.select("rep", "h", "g", "least", "m", n_links, F.coalesce("root", "rep").alias("part")), "known")
    least = saved(known.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("w")), "least")
    known = saved(joined_on(known.drop("least"), least, ["part"], "w", F.col("rep")).select("h", "g", "m", "n_links", "component_id"), "known")
    out = joined_on(keyed.select("vec_id", "h", "g"), known, ["h", "g"], "m", F.col("vec_id"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_itq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
c AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(m.least, v.vec_id)) AS component_id, coalesce(m.least, v.vec_id) >= v.vec_id AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""
