"""Global counts of 64-bit keys for whole batches of documents.

Documents are dealt once into batches by a hash and written as a table bucketed by batch. A batch asks for the counts
of its distinct keys: one row for each key range that it touches, the sorted keys packed as deltas. The task of a key
range adds up what all batches hold and answers each with counts in the order asked. The answers meet their batch
again by its number; the bucketed documents need no further shuffle. A key that a third of all documents hold costs
one entry a batch, so no key, however frequent, makes a large task.

A range is of about RANGE_BYTES of text, so there are more of them for more text, but a batch never sends more than
2^DIGIT rows a kind: beyond that many ranges the keys travel in steps of DIGIT bits. At each step the batches of a group
of 2^DIGIT meet, one task for each range so far; it adds up their equal keys, asks for them as one batch of the next
step, and deals the answers out again. So a step costs rows in proportion to the text, and each task holds about as
many keys as one batch.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import fresh, fresh_table, release, saved, trimmed

#: Bytes of text of a batch and of a range, the least number of batches and of bits of a range, and the most buckets of a table.
BATCH_BYTES, RANGE_BYTES, LEAST, LEAST_BITS, MOST_BUCKETS = 8_000_000, 4_000_000, 12, 4, 50_000
#: Bits of a range that one step adds.
DIGIT = 10

ASK = "batch bigint, kind int, range bigint, keys binary, counts binary"
ANSWER = "batch bigint, kind int, range bigint, counts binary"
ASKED = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERED = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("counts", pa.binary())])
#: An answer of kind k is about the keys asked for as kind k modulo KINDS.
KINDS = 10


def batches_for(n_bytes: int) -> int:
    return max(LEAST, -(-n_bytes // BATCH_BYTES))


def range_bits(n_bytes: int) -> int:
    return max(LEAST_BITS, (-(-n_bytes // RANGE_BYTES) - 1).bit_length())


def any_row(*columns: Column) -> Column:
    """A number that deals rows out evenly even where many share an id."""
    return F.xxhash64(*columns)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def dealt(rows: DataFrame, batch: Column, n: int) -> DataFrame:
    """rows with a column batch, as a table in the shared folder bucketed by it."""
    spark = rows.sparkSession
    n = min(n, MOST_BUCKETS)
    name = fresh_table(spark, "dealt")
    placed = rows.withColumn("batch", batch.cast("int")).repartition(n, "batch")
    placed.write.bucketBy(n, "batch").option("path", fresh(spark, name)).option("compression", "zstd").saveAsTable(name)
    release(spark)
    return spark.table(name)


U = np.uint64


def pack(sorted_keys: np.ndarray) -> bytes:
    """Ascending uint64 as deltas, byte plane by byte plane without the empty ones."""
    return _planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    if not len(values):
        return b"\0"
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def pack_numbers(values: np.ndarray) -> bytes:
    return _planes(values)


def numbers(data: bytes) -> np.ndarray:
    width = data[0]
    if not width:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def located(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[False], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new)
    return keys[~new] if not len(keys) else keys[np.concatenate([[0], np.flatnonzero(new)])], place


def asked(batch: int, kind: int, keys: np.ndarray, counts: np.ndarray, shift: int) -> list[tuple]:
    """Rows of ASK for sorted distinct keys, one for each range: the keys that agree but for their last `shift` bits."""
    if not len(keys):
        return []
    r = keys >> U(shift) if shift < 64 else np.zeros(len(keys), np.uint64)
    edges = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(keys)]
    return [(batch, kind, int(r[a]), pack(keys[a:b]), pack_numbers(counts[a:b])) for a, b in zip(edges, edges[1:], strict=False)]


def rows(found: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*found, strict=True) if found else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def first_shift(k: int, bits: int = 64) -> int:
    """How far asked() shifts the keys of the batches themselves, for 2^k ranges."""
    return bits - min(k, DIGIT)


def ask(placed: DataFrame, keys_of: Callable[[pa.Table], list[tuple[int, np.ndarray, np.ndarray]]], k: int, bits: int = 64) -> DataFrame:
    """keys_of gives (kind, sorted distinct keys, counts) of a batch."""
    shift = first_shift(k, bits)

    def run(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        return rows([x for kind, keys, counts in keys_of(group) for x in asked(batch, kind, keys, counts, shift)], ASKED)

    return placed.groupBy("batch").applyInArrow(trimmed(run), ASK)


def exchanged(asks: DataFrame, answer: Callable[[pa.Table], pa.Table], k: int, bits: int = 64, lanes: int = 1, subset: bool = False) -> DataFrame:
    """The answers to the batches' asks; `answer` works on all rows of a range.

    Batches are added up only with those that agree modulo `lanes`. An answer has a number for each key asked for or,
    with subset, is itself the keys that count. Rows of negative batches are no answers and pass through.
    """
    return _step(asks, answer, k, bits, lanes, subset, min(k, DIGIT)).withColumn("batch", F.col("batch").cast("int"))


def _step(asks: DataFrame, answer, k: int, bits: int, lanes: int, subset: bool, done: int) -> DataFrame:
    if done == k:
        return asks.repartition(min(1 << k, MOST_BUCKETS), "range").groupBy("range").applyInArrow(trimmed(answer), ANSWER)
    group = F.floor(F.col("batch") / (lanes << DIGIT)).cast("long")
    up = (F.call_function("shiftleft", group, F.lit(done)) + F.col("range")) * lanes + F.pmod("batch", F.lit(lanes))
    asks = saved(asks.withColumn("up", up), "asks")
    now = min(k, done + DIGIT)

    def merge(mine: pa.Table) -> pa.Table:
        out = []
        for kind, found in sorted(_by_kind(mine).items()):
            keys, _, sums = totals([(unpack(x["keys"]), numbers(x["counts"])) for x in found])
            out += asked(found[0]["up"], kind, keys, sums, bits - now)
        return rows(out, ASKED)

    def deal(mine: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for kind, found in _by_kind(mine).items():
            own = [unpack(x["keys"]) for x in found]
            all_keys, places, _ = totals([(x, np.zeros(len(x), np.uint64)) for x in own])
            for other in {x for x in answers.column("kind").to_pylist() if x % KINDS == kind}:
                if subset:
                    counting = np.isin(all_keys, answered_keys(answers, other))  # once for the group, not once a batch
                    out += [(x["batch"], other, x["range"], pack(o[counting[p]])) for x, o, p in zip(found, own, places, strict=True)]
                else:
                    counts = joined(answers, other)
                    out += [(x["batch"], other, x["range"], pack_numbers(counts[p])) for x, p in zip(found, places, strict=True)]
        return rows(out, ANSWERED)

    merged = asks.groupBy("up").applyInArrow(trimmed(merge), ASK)
    answers = _step(merged, answer, k, bits, lanes, subset, now)
    answers = saved(answers, "answers")
    dealt_out = asks.groupBy("up").cogroup(answers.where("batch >= 0").groupBy("batch")).applyInArrow(trimmed(deal), ANSWER)
    return dealt_out.union(answers.where("batch < 0"))


def _by_kind(rows_: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for x in rows_.to_pylist():
        out.setdefault(x["kind"], []).append(x)
    return out


def answered_keys(answers: pa.Table, kind: int) -> np.ndarray:
    """All keys that answers of a kind hold, ascending."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("range")
    return np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in mine.column("counts").to_pylist())])


def totals(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of several (keys, counts): the distinct keys, where each one's keys are among them, and the sums."""
    all_keys = distinct(np.concatenate([k for k, _ in found]))[0]
    places = [np.searchsorted(all_keys, k) for k, _ in found]
    sums = np.zeros(len(all_keys), np.uint64)
    for p, (_, c) in zip(places, found, strict=True):
        sums[p] += c
    return all_keys, places, sums


def joined(answers: pa.Table, kind: int) -> np.ndarray:
    """The answers of a kind in the order of the batch's keys."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("range")
    parts = [numbers(x) for x in mine.column("counts").to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def total_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
