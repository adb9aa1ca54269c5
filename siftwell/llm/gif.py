"""GIF media columns: an exact 8-bit encoder and a decoder of LZW code streams, palettes, disposal and transparency.

encode() stores a byte payload as grey samples of a GIF89a, 64 samples a row, in frames of at most FRAME_ROWS rows;
decode() reads any GIF87a or GIF89a: global and local palettes, interlace, frame offsets, transparent indices, the four
disposal methods and frame delays, and gives timed RGBA frames. frames() and stored() apply them to DataFrames.

Nulls: a null text counts as empty, whose payload is 64 zero bytes; a null GIF gives no frames. A broken GIF raises
ValueError with the reason, also where a code stream has fewer samples than its image. Empty table: empty result. Repeated
rows and ties: equal texts give equal bytes. Very long texts are stored whole, in as many frames as they need; memory is
that of one GIF. Extra columns pass through; those named like a result are replaced.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ._common import table

ROW, FRAME_ROWS, DELAY_CS, BINS = 64, 1024, 10, 8
#: Rows of an Arrow batch that this module returns.
BATCH = 256


@dataclass
class Frame:
    """One frame as shown: the composed canvas, and the rectangle that the frame's own image covered."""

    start_ms: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray

    def patch(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _widths(n: int, least: int) -> np.ndarray:
    """Bits of the first n codes after a clear code; the reader's table grows by one with each but the first."""
    top = (1 << least) + 1 + np.arange(n)
    return np.clip(np.frexp(top.astype(np.float64))[1], least + 1, 12)


_RUN = _widths(4096, 8)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples; the table starts anew whenever it is full."""
    codes: list[int] = [256]
    starts: list[int] = [1]
    add, known, after, rest = codes.append, {}, 258, iter(data)
    held = next(rest, None)
    if held is not None:
        for b in rest:
            key = held << 8 | b
            if key in known:
                held = known[key]
                continue
            add(held)
            known[key] = after
            after += 1
            held = b
            if after == 4096:
                add(256)
                starts.append(len(codes))
                known, after = {}, 258
        add(held)
    add(257)
    bits = np.concatenate([[9], *(_RUN[: b - a] for a, b in zip(starts, [*starts[1:], len(codes)], strict=True))])
    each = np.unpackbits(np.array(codes, dtype="<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(each[np.arange(16) < bits[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, wanted: int) -> bytes:
    """At most `wanted` indices of a code stream.

    The widths of the codes between two clear codes depend on their number alone, so they are cut out at once.
    """
    if not 1 <= least <= 11:
        raise ValueError(f"LZW code size {least}")
    clear = 1 << least
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8)
    schedule = _RUN if least == 8 else _widths(4096, least)
    simple = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    known, before, out = simple.copy(), b"", []
    total, at, n, size = len(stream) * 8, 0, 0, 0
    while size < wanted and at < total:
        bits = schedule[n:] if n < 4096 else np.full(4096, 12)
        place = at + np.cumsum(bits) - bits
        fits = int(np.searchsorted(place + bits, total, "right"))
        if not fits:
            break
        bits, place = bits[:fits], place[:fits]
        byte = place >> 3
        word = raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16
        codes = word >> (place & 7) & ((1 << bits) - 1)
        marks = np.flatnonzero((codes & ~1) == clear)
        stop = int(marks[0]) if len(marks) else fits
        first = len(out)
        before = _strings(codes[:stop].tolist(), known, before, out)
        size += sum(map(len, out[first:]))
        if stop == fits:
            at, n = int(place[-1] + bits[-1]), n + fits
        elif codes[stop] == clear + 1:
            break
        else:
            at, n = int(place[stop] + bits[stop]), 0
            known, before = simple.copy(), b""
    return b"".join(out)[:wanted]


def _strings(codes: list[int], known: list[bytes], before: bytes, out: list[bytes]) -> bytes:
    """Append what the codes stand for; before: the string of the code before, empty after a clear code."""
    put, learn, room = out.append, known.append, 4096 - len(known)
    start = 0
    if not before and codes:
        if codes[0] >= len(known):
            raise ValueError("LZW code that the table lacks")
        before = known[codes[0]]
        put(before)
        start = 1
    for c in codes[start : start + room]:
        try:
            now = known[c]
        except IndexError:
            if c != len(known):
                raise ValueError("LZW code that the table lacks") from None
            now = before + before[:1]
        put(now)
        learn(before + now[:1])
        before = now
    for c in codes[start + room :]:
        before = known[c]
        put(before)
    return before


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode(payload: bytes) -> bytes:
    """A GIF whose frames hold the payload, a positive multiple of 64 bytes, as indices of a grey palette."""
    rows = len(payload) // ROW
    if not rows or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        high = min(FRAME_ROWS, rows - top)
        part = payload[top * ROW : (top + high) * ROW]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, ROW, high, 0) + b"\x08" + _blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames in order, each as composed on the canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index, clock = 0, 0, None, 0
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                how, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = how >> 2 & 7, index if how & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        own, at = _palette(data, at + 9, flags)
        colours = own if own is not None else shared
        if colours is None:
            raise ValueError("an image without a palette")
        stream, after = _sub_blocks(data, at + 1)
        found = lzw_decode(stream, data[at], w * h)
        if len(found) < w * h:
            raise ValueError(f"the code stream ends after {len(found)} of {w * h} samples")
        flat = np.frombuffer(found, np.uint8).reshape(h, w)
        at = after
        if flags & 0x40:
            order = [y for a, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, step)]
            image = np.empty_like(flat)
            image[order] = flat
        else:
            image = flat
        before = canvas.copy() if disposal == 3 else None
        space = canvas[top : top + h, left : left + w]
        image = image[: space.shape[0], : space.shape[1]]
        table_ = np.zeros((256, 4), np.uint8)
        table_[: len(colours), :3], table_[:, 3] = colours, 255
        shown = table_[image]
        if clear_index is None:
            space[:] = shown
        else:
            solid = image != clear_index
            space[solid] = shown[solid]
        yield Frame(clock * 10, delay * 10, disposal, left, top, *space.shape[1::-1], canvas.copy() if disposal in (2, 3) else canvas)
        clock += delay
        if disposal == 2:
            space[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def histogram(pixels: np.ndarray, channel: int) -> list[int]:
    """Counts of visible pixels in BINS equal ranges of a channel."""
    return np.bincount((pixels[..., channel] >> 5)[pixels[..., 3] > 0], minlength=BINS).tolist()


def stored(df: DataFrame, text: str) -> DataFrame:
    """df with n_bytes, the length of the text in UTF-8, and media, its GIF, in place of the text; columns that have these
    names already are replaced."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                raw = [(x or "").encode() for x in part.column("text").to_pylist()]
                media = [encode(x.ljust(max(ROW, -(-len(x) // ROW) * ROW), b"\0")) for x in raw]
                kept = [part.column(i) for i in inner]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=names)

    kept = df.drop(text, "n_bytes", "media")
    names = [*kept.columns, "n_bytes", "media"]
    inner = [f"_{i}" for i in range(len(kept.columns))]
    given = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept.columns, inner, strict=True)], F.col(text).alias("text"))
    return given.mapInArrow(run, kept.withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(b"")}).schema)


FRAMES = "frame int, start_ms bigint, delay_ms bigint, disposal int, width int, height int, pixels binary, red array<bigint>, green array<bigint>, blue array<bigint>"


def frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row for each frame: its time, the composed RGBA pixels of the canvas, and colour histograms."""

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(key).to_pylist(), batch.column(media).to_pylist(), strict=True):
                if data is None:
                    continue
                rows = [(k, i, f.start_ms, f.delay_ms, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), *(histogram(f.canvas, c) for c in range(3))) for i, f in enumerate(decode(data))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    schema = StructType([StructField("key", df.schema[key].dataType), *StructType.fromDDL(FRAMES).fields])
    arrow = to_arrow_schema(schema)
    return df.select(key, media).mapInArrow(run, schema)


DIGEST = "doc_id {}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _read_back(data: bytes) -> tuple[bytes, str]:
    """The stored payload, and frames:milliseconds:histogram of the samples over all frames."""
    parts, bins, ms, n = [], np.zeros(BINS, np.int64), 0, 0
    for f in decode(data):
        samples = f.patch()
        parts.append(samples[..., 0].tobytes())
        bins += histogram(samples, 0)
        ms, n = ms + f.delay_ms, n + 1
    return b"".join(parts), f"{n}:{ms}:{'/'.join(map(str, bins.tolist()))}"


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for key, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                payload, feature = _read_back(data)
                out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    media = stored(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "text")
    return media.mapInArrow(run, DIGEST.format("bigint"))
