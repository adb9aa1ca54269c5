"""Words of many texts as 64-bit hashes, by array operations only."""

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64 over x plus a seed."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(mix(a, seed) + b, seed)


def bounds(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a byte array that begins and ends with a space."""
    edges = np.flatnonzero(np.diff(_SPACE[joined].view(np.int8))) + 1
    return edges[0::2], edges[1::2]


def hashed(joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) each; the array needs eight bytes after the last end."""
    eights = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64), 7)
    todo, at = None, start
    while True:
        n = np.minimum(left, 8).astype(np.uint64)
        word = eights[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * n))
        if todo is None:
            h = mix(h + word, 11)
        else:
            h[todo] = mix(h[todo] + word, 11)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8


def words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    hashes, counts, part, size = [], [], [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t) + 1
        if size >= _CHUNK or i == len(texts) - 1:
            joined = np.frombuffer(b" " + b" ".join(part) + b" " * 9, np.uint8)
            if lower:
                joined = _LOWER[joined]
            start, end = bounds(joined)
            hashes.append(hashed(joined, start, end))
            stops = np.cumsum([len(x) + 1 for x in part])
            counts.append(np.diff(np.searchsorted(start, stops + 1), prepend=0))
            part, size = [], 0
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]
