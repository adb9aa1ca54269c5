"""Deleted interpolation: bigram, unigram and uniform estimates mixed by context-frequency buckets.

P(w | u) = l2(b) c(u w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of c(u), a power of two.
Counts come from the training documents; the weights l(b) are learned by expectation-maximisation on a fold of the
training documents, against counts from which that whole fold is deleted. The last stage counts all training documents.

Nulls: a null text is empty, and so has one token, the end; doc_id null counts as the text "" for its fold. Empty table: empty
result. Without training documents the model is uniform. Repeated rows count each. Ties: there is nothing to choose, equal
texts get equal scores. Very long texts are scored whole; memory is that of one batch, which one text may fill. Extra
columns, whatever their names, are left out. doc_id may be of any type. Words are known by 64-bit hashes.

For expectation-maximisation the estimates of the deleted fold are counted in classes of a quarter of an octave (GRID); the
scores themselves are not rounded.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _exchange as X
from ._common import saved, table, trimmed
from ._tokens import as_bytes, pair, words

FOLDS, HELD, DELETED = 10, 0, 1
BUCKETS, STEPS, GRID = 48, 80, 4
_START, _END = np.uint64(0x51AB5C9D2E6F7083), np.uint64(0xA7C15E3F9B2D4861)
UNI, BI = 0, 1


def _sequence(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with one end a text, the token before each, and the tokens of each text."""
    h, n = words(as_bytes(group.column("text")), lower=True)
    n = n + 1
    stop = np.cumsum(n)
    seq = np.full(int(stop[-1]), _END)
    inner = np.ones(len(seq), bool)
    inner[stop - 1] = False
    seq[inner] = h
    before = np.concatenate([[_START], seq[:-1]])
    before[stop[:-1]] = _START
    return seq, before, n


def _keys(group: pa.Table):
    seq, before, _ = _sequence(group)
    return [(UNI, *X.distinct(seq)), (BI, *X.distinct(pair(before, seq)))]


def _answer(group: pa.Table) -> pa.Table:
    """Counts of the training documents and, for the batches of the deleted fold, those without it.

    A row of batch -1 has the tokens and distinct tokens of both, as numbers of eight bytes.
    """
    out = []
    for kind in (UNI, BI):
        mine = group.filter(pa.compute.equal(group.column("kind"), kind)).to_pylist()
        if not mine:
            continue
        fold = [x["batch"] % 3 for x in mine]  # 0: held out, 1: deleted, 2: the rest
        found = [(X.unpack(x["keys"]), X.numbers(x["counts"])) for x in mine]
        keys, places, _ = X.totals(found)
        rest, all_ = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for f, p, (_, c) in zip(fold, places, found, strict=True):
            if f:
                all_[p] += c
            if f == 2:
                rest[p] += c
        for x, f, p in zip(mine, fold, places, strict=True):
            out.append((x["batch"], kind, x["range"], X.pack_numbers(all_[p])))
            if f == 1:
                out.append((x["batch"], kind + X.KINDS, x["range"], X.pack_numbers(rest[p])))
        if kind == UNI:
            out.append((-1, UNI, mine[0]["range"], np.array([all_.sum(), (all_ > 0).sum(), rest.sum(), (rest > 0).sum()], ">u8").tobytes()))
    return X.rows(out, X.ANSWERED)


def _counted(group: pa.Table, answers: pa.Table, kind_step: int, starts: int):
    """For each token: c(before token), c(before), c(token)."""
    seq, before, n = _sequence(group)
    place = X.located(seq)[1]
    single = X.joined(answers, UNI + kind_step).astype(np.float64)[place]
    both = X.joined(answers, BI + kind_step).astype(np.float64)[X.located(pair(before, seq))[1]]
    context = np.concatenate([[0.0], single[:-1]])
    context[np.concatenate([[0], np.cumsum(n)[:-1]])] = starts
    return both, context, single, n


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def _grid(values: np.ndarray) -> np.ndarray:
    """Logarithm to a quarter of an octave; -1000 for 0."""
    out = np.full(len(values), -1000, np.int64)
    some = values > 0
    out[some] = np.round(np.log2(values[some]) * GRID)
    return out


def learned(events: list, vocabulary: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by bucket from (bucket, log f2, log f1, number) by expectation-maximisation.

    Each weight starts even and gets one pseudo-event, so none is 0; a bucket without events takes the weights of all
    events; the bucket of unseen contexts has no bigram estimate and gives its weight to the others.
    """
    b = np.array([e[0] for e in events], np.int64)
    n = np.array([e[3] for e in events], np.float64)
    power = lambda q: np.where(q == -1000, 0.0, 2.0 ** (q / GRID))
    f = np.stack([power(np.array([e[1] for e in events], np.float64)), power(np.array([e[2] for e in events], np.float64)), np.full(len(events), 1 / (vocabulary + 1))], 1)

    def em(where: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(STEPS):
            share = f[where] * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[where, None]).sum(0) + 1
            w /= w.sum()
        return w

    overall = em(np.arange(len(events)), np.full(3, 1 / 3)) if len(events) else np.full(3, 1 / 3)
    out = np.stack([em(at, np.full(3, 1 / 3)) if len(at := np.flatnonzero(b == k)) else overall for k in range(BUCKETS)])
    out[0, 0] = 0
    out[0] /= out[0].sum()
    return out


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS
    kind = F.when(fold == HELD, 0).when(fold == DELETED, 1).otherwise(2)
    size = X.total_bytes(docs, text)
    n, k = X.batches_for(size), X.range_bits(size)
    part = F.pmod(X.any_row(F.col(doc_id), F.col(text)), F.when(kind == 2, n).otherwise(-(-n // 8))).cast("int")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = X.dealt(plain, (part * 3 + kind), n)
    answers = saved(X.exchanged(X.ask(placed, _keys, k), _answer, k, lanes=3), "counts")

    number = lambda i: F.coalesce(F.sum(F.conv(F.hex(F.substring("counts", 8 * i + 1, 8)), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("long")
    total, vocabulary, total_rest = answers.where("batch = -1").agg(*(number(i) for i in range(3))).first()
    starts = {r[0]: r[1] for r in docs.groupBy(kind.alias("k")).count().collect()}
    starts_rest, starts_all = starts.get(2, 0), starts.get(1, 0) + starts.get(2, 0)

    def events(group: pa.Table, mine: pa.Table) -> pa.Table:
        both, context, single, _ = _counted(group, mine, X.KINDS, starts_rest)
        f2 = np.divide(both, context, out=np.zeros(len(both)), where=context > 0)
        cells = np.stack([_bucket(context), _grid(f2), _grid(single / max(total_rest, 1))], 1)
        cells, count = np.unique(cells, axis=0, return_counts=True)
        return pa.table({"b": cells[:, 0], "q2": cells[:, 1], "q1": cells[:, 2], "n": count.astype(np.int64)})

    deleted = placed.where("batch % 3 = 1").groupBy("batch").cogroup(answers.where("batch % 3 = 1").groupBy("batch"))
    grid = deleted.applyInArrow(trimmed(events), "b bigint, q2 bigint, q1 bigint, n bigint").groupBy("b", "q2", "q1").agg(F.sum("n"))
    weights = learned([tuple(r) for r in grid.orderBy("b", "q2", "q1").collect()], vocabulary)

    def score(group: pa.Table, mine: pa.Table) -> pa.Table:
        if not group.num_rows:
            return out.empty_table()
        both, context, single, n_tokens = _counted(group, mine, 0, starts_all)
        w = weights[_bucket(context)]
        f2 = np.divide(both, context, out=np.zeros(len(both)), where=context > 0)
        p = w[:, 0] * f2 + w[:, 1] * single / max(total, 1) + w[:, 2] / (vocabulary + 1)
        base = np.log10((single + 0.1) / (total + 0.1 * (vocabulary + 1)))
        first = np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
        size = group.num_rows
        return pa.table(
            [group.column("doc_id"), pa.array(np.full(size, group.column("batch")[0].as_py() % 3 == 0)), pa.array(n_tokens), pa.array(np.add.reduceat((single > 0).astype(np.int64), first)),
             pa.array(np.full(size, total, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))],
            schema=out,
        )

    out = pa.schema([("doc_id", X.arrow_type(placed, "doc_id")), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    answered = answers.where("batch >= 0")
    return placed.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(trimmed(score), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
