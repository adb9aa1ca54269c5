"""N-gram Jaccard join with several global token orders.

A document is its set of word shingles. Under any global order of shingles, two sets with Jaccard similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each. The orders here are by frequency class, rare first, and
within a class by a hash, another for each order. Candidates share a prefix shingle under the first order, at places
that leave room for the needed overlap; those that share none under some other order are dropped before the sets
themselves are compared, exactly.

Equal sets form one class and go on as one. Within the documents of a prefix shingle, all are first compared with the
one that has it earliest; afterwards only pairs of different components are, so that a large group of near copies
does not become all its pairs. So components are whole, but links inside a component that is already found are not all
produced, and their number for a document is not given.

Nulls: a null or empty text has no shingles and links with nothing; a text with fewer words than a shingle is one
shingle. A null doc_id counts as no id: the component takes the smallest other. Empty table: empty result. Repeated rows link
with each other. Ties in an order go by the shingle's hash, so a set has one prefix. Very long texts are taken whole; their
sets travel only to the candidates that are left after all orders. Extra columns, whatever their names, are left out.
Shingles and classes are known by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _exchange as X
from ._common import joined_on, saved, table, trimmed
from ._components import components
from ._tokens import U, as_bytes, mix, pair, words

WORDS, PERCENT, ORDERS = 5, 80, 3
#: Frequencies are counted by this many leading bits of a shingle's hash; they only set the order.
CELL_BITS = 40


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    if len(h) < size:
        if not len(h):
            return h
        whole = mix(h[:1], 30 + len(h))
        for w in h[1:]:
            whole = pair(whole, np.array([w], np.uint64), 31)
        return whole
    s = h[: len(h) - size + 1]
    for k in range(1, size):
        s = pair(s, h[k : len(h) - size + 1 + k], 9)
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def _sets(group: pa.Table, size: int) -> list[np.ndarray]:
    h, n = words(as_bytes(group.column("text")), lower=True)
    stops = np.cumsum(n).tolist()
    return [shingles(h[a:b], size) for a, b in zip([0, *stops], stops, strict=False)]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _ranked(tokens: np.ndarray, cls: np.ndarray, order: int, p: int) -> np.ndarray:
    """The first p tokens under an order, as (class, hash) in one number."""
    rank = cls << U(58) | mix(tokens, 40 + order) >> U(6)
    return np.sort(np.partition(rank, p - 1)[:p])


DOCS = "doc_id {}, node bigint, n_shingles bigint, shingles binary, first binary, others binary"


def _described(placed: DataFrame, answers: DataFrame, size: int, percent: int, kind: str) -> DataFrame:
    """Each document with the class of its set; and, if one of its prefix shingles occurs elsewhere, what the join needs."""

    def run(group: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        sets = _sets(group, size) if group.num_rows else []
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        cls = X.joined(counts, 0)[X.located(flat >> U(64 - CELL_BITS))[1]] if len(flat) else flat
        at = 0
        for key, s in zip(group.column("doc_id").to_pylist(), sets, strict=True):
            n = len(s)
            c, at = cls[at : at + n], at + n
            if not n:
                out.append((key, None, 0, None, None, None))
                continue
            lanes = np.array([np.bitwise_xor.reduce(mix(s, 21)), np.sum(mix(s, 22))], np.uint64)
            node = int(pair(lanes[:1], lanes[1:], n).view(np.int64)[0])
            p = prefix_length(n, percent)
            if np.count_nonzero(c < 2) >= p:
                out.append((key, node, n, None, None, None))
                continue
            others = [_ranked(s, c, k, p) for k in range(1, ORDERS)]
            out.append((key, node, n, X.pack(s), X.pack(_ranked(s, c, 0, p)), b"".join(x.tobytes() for x in others)))
        return pa.table([pa.array(col, t) for col, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names=names)

    names = ["doc_id", "node", "n_shingles", "shingles", "first", "others"]
    types = [X.arrow_type(placed, "doc_id"), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return placed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(trimmed(run), DOCS.format(kind))


def _classes(group: pa.Table) -> pa.Table:
    """Frequency classes: 1 for once, 2 for twice or thrice, and so on by powers of two."""
    asked = group.to_pylist()
    found = [(X.unpack(x["keys"]), X.numbers(x["counts"])) for x in asked]
    _, places, sums = X.totals(found)
    cls = np.frexp(sums.astype(np.float64))[1].astype(np.uint64)
    return X.rows([(x["batch"], 0, x["range"], X.pack_numbers(cls[p])) for x, p in zip(asked, places, strict=True)], X.ANSWERED)


def _postings(batches):
    """A row for each prefix shingle of frequency class 2 and more, with its place in the order."""
    for batch in batches:
        for node, n, first in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "first")), strict=True):
            t = X.unpack(first)
            at = np.flatnonzero(t >> U(58) >= 2)
            yield pa.RecordBatch.from_arrays([pa.array(t[at].view(np.int64)), pa.array(np.full(len(at), node, np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(at.astype(np.int32))], names=["token", "node", "n", "pos"])


def _fits(percent: int):
    """Sizes and places at which the overlap can still reach percent of the union."""
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & ((100 + percent) * rest >= percent * (F.col("a.n") + F.col("b.n")))


def _agreed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix shingle under each of the other orders too; only prefixes travel for that."""

    def run(batches):
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in ("oa", "ob")), strict=True)
            split = lambda x: np.frombuffer(x, np.uint64).reshape(ORDERS - 1, -1)
            keep = [all(_meet(x, y) for x, y in zip(split(oa), split(ob), strict=True)) for oa, ob in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("others").alias(f"o{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "oa", "ob").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the other orders' filters and whose sets are similar."""

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            a, b = [], []
            for i in range(batch.num_rows):
                sa, sb = X.unpack(cols["sa"][i]), X.unpack(cols["sb"][i])
                both = _meet(sa, sb)
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    a.append(cols["a"][i])
                    b.append(cols["b"][i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    side = lambda x: classes.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    near = saved(_agreed(pairs, classes), "candidates")
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of two sorted arrays."""
    if not len(x) or not len(y):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): similar pairs of classes (node, n, shingles, first, others) that connect all that is connected."""
    post = saved(classes.select("node", "n", "first").mapInArrow(_postings, "token bigint, node bigint, n int, pos int"), "postings")
    hubs = post.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    hubs = saved(hubs.select("token", "m", F.struct("hub.*").alias("a")), "hubs")
    star = joined_on(post.select("token", F.struct("pos", "node", "n").alias("b")), hubs, ["token"], "m", F.col("b.node"))
    star = star.where("a.node <> b.node").where(_fits(percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    found = saved(_verified(star, classes, percent), "links")
    parts = components(found)
    # pairs across components: those of a hub are done
    root = post.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marked = joined_on(root, hubs.select("token", "m", F.col("a.node").alias("hub")), ["token"], "m", F.col("node")).drop("m").where("node <> hub")
    marked = saved(marked, "marked")
    mixed = marked.groupBy("token").agg(F.min("root").alias("main"), F.max("root").alias("most"), F.count("*").alias("m")).where("main <> most").select("token", "main", "m")
    open_ = saved(joined_on(marked, saved(mixed, "mixed"), ["token"], "m", F.col("node")).drop("m"), "open")
    minor = open_.where("root <> main")
    across = minor.alias("a").join(open_.alias("b"), "token").where("a.root <> b.root").where("b.root = b.main or a.node < b.node").where(_fits(percent))
    across = across.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    return found.union(saved(_verified(across, classes, percent), "links"))


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    total = X.total_bytes(docs, text)
    n, k = X.batches_for(total), X.range_bits(total)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = X.dealt(plain, F.pmod(X.any_row("doc_id", "text"), F.lit(n)), n)

    def keys(group: pa.Table):
        return [(0, *X.distinct(np.concatenate([np.zeros(0, np.uint64), *_sets(group, size)]) >> U(64 - CELL_BITS)))]

    answers = X.exchanged(X.ask(placed, keys, k, CELL_BITS), _classes, k, CELL_BITS)
    each = saved(_described(placed, answers, size, percent, docs.schema[doc_id].dataType.simpleString()), "sets")
    first = lambda c: F.first(c).alias(c)
    about = [F.count("*").alias("m"), F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("n")]
    classes = saved(each.where("shingles is not null").groupBy("node").agg(*about, first("shingles"), first("first"), first("others")), "classes")
    roots = components(links(classes, percent))
    # one row a class, then one a component: the join back to the documents is one of equal sets
    parts = saved(classes.select("node", "m", "least").join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")), "parts")
    least = saved(parts.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("w")), "least")
    known = saved(joined_on(parts.select("node", "m", "part"), least, ["part"], "w", F.col("node")).select("node", "m", "component_id"), "known")
    out = joined_on(each.select("doc_id", "n_shingles", "node"), known, ["node"], "m", F.col("doc_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
s AS (SELECT doc_id, count(*) OVER f AS many, n, string_agg(word, ' ') OVER f AS sh, i FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
d AS (SELECT DISTINCT doc_id, sh FROM s WHERE many = 5 OR (n < 5 AND i = 1)),
c AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_common FROM d x JOIN d y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * n_common >= 80 * (ca.n + cb.n - n_common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(c.n, 0) AS n_shingles, least(t.doc_id, coalesce(m.least, t.doc_id)) AS component_id
FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN m ON m.a = t.doc_id
"""
