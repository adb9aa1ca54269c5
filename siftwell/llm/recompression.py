"""Substring dedup by recompression: removal of words covered by a repeated window of consecutive words.

Rounds replace runs of one symbol by a symbol, and pairs whose first symbol is on the left side and whose second is on
the right by a symbol. Names and sides are hashes of what a symbol stands for, so they agree over the whole corpus
without a lookup, and equal substrings have equal symbols but for a margin at each end. The margin of each window
follows from its own symbols: a symbol at its left end may belong to a larger one only if it is on the right side,
and so on. After the rounds, symbols that occur once in the corpus rule out each window that holds one inside its
margin. The remaining windows, and those whose margins meet, are compared by a hash of all their words.

Nulls: a null text has no words. Empty table: empty result. Repeated rows repeat each other. Words are known by 64-bit
hashes, windows by 64-bit hashes of those. Whole texts of any length; memory is that of one batch of documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _exchange as X
from ._common import table, trimmed
from ._tokens import U, as_bytes, mix, pair, words

WINDOW = 35
#: b: runs, p: pairs.
ROUNDS = "bpppbpp"
_BASE = 0xD6E8FEB86659FD93


class Parsed:
    """The symbols of a batch after the rounds, and for each window the part of it that its words alone determine."""

    def __init__(self, h: np.ndarray, n: np.ndarray, window: int, rounds: str = ROUNDS):
        total, stops = len(h), np.cumsum(n)
        names, start = h, np.arange(total)
        opens = np.zeros(total + 1, bool)
        opens[stops] = opens[0] = True  # word positions at which a text begins
        room = np.repeat(stops, n) - start
        self.at = np.flatnonzero(room >= window)
        left, right = self.at, self.at + window
        for r, kind in enumerate(rounds if total else ""):
            end = np.append(start[1:], total)
            first = opens[start]
            to_left, to_right = np.full(total + 1, total), np.zeros(total + 1, np.int64)
            if kind == "b":
                new = first.copy()
                new[1:] |= names[1:] != names[:-1]
                heads = np.flatnonzero(new)
                length = np.diff(heads, append=len(names))
                run = np.cumsum(new) - 1
                to_left[start], to_right[end] = end[heads + length - 1][run], start[heads][run]
                names = np.where(length > 1, pair(names[heads], length.astype(np.uint64), 2), names[heads])
            else:
                on_left = (mix(names, 100 + r) & U(1)).astype(bool)
                to_left[start], to_right[end] = np.where(on_left, start, end), np.where(on_left, start, end)
                tied = np.zeros(len(names), bool)  # with the symbol before
                tied[1:] = on_left[:-1] & ~on_left[1:] & ~first[1:]
                heads = np.flatnonzero(~tied)
                follow = np.minimum(heads + 1, len(names) - 1)
                double = tied[follow] & (follow > heads)
                names = np.where(double, pair(names[heads], names[follow], 3), names[heads])
            start = start[heads]
            left, right = to_left[left], to_right[right]
        self.names, self.start, self.left, self.right, self.total = names, start, left, right, total

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that can be repeated, given for each symbol whether it is."""
        once = np.concatenate([[0], np.cumsum(~repeated)])
        place = np.zeros(self.total + 1, np.int64)
        place[self.start], place[self.total] = np.arange(len(self.start)), len(self.start)
        inside = self.left < self.right
        return self.at[~inside | (once[place[np.where(inside, self.right, 0)]] == once[place[np.where(inside, self.left, 0)]])]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base & 0xFFFFFFFFFFFFFFFF))
    out[:1] = 1
    return np.cumprod(out)


def window_hashes(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hashes of the windows that start at these words, the same wherever the window stands."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, 5) * _powers(_BASE, len(h)))])
    return mix((sums[at + window] - sums[at]) * _powers(pow(_BASE, -1, 1 << 64), len(h))[at], 6)


def _words(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return words(as_bytes(group.column("text")), lower=False)


def _sums(group: pa.Table):
    asked = group.to_pylist()
    found = [(X.unpack(x["keys"]), X.numbers(x["counts"])) for x in asked]
    keys, places, sums = X.totals(found)
    return asked, found, places, sums


def _flags(group: pa.Table) -> pa.Table:
    asked, _, places, sums = _sums(group)
    return X.rows([(x["batch"], 0, x["range"], X.pack_numbers((sums[p] > 1).astype(np.uint64))) for x, p in zip(asked, places, strict=True)], X.ANSWERED)


def _repeated(group: pa.Table) -> pa.Table:
    asked, found, places, sums = _sums(group)
    return X.rows([(x["batch"], 1, x["range"], X.pack(k[sums[p] > 1])) for x, (k, _), p in zip(asked, found, places, strict=True)], X.ANSWERED)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words that stay, joined by one space."""
    size = X.total_bytes(docs, text)
    n, k = X.batches_for(size), X.range_bits(size)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = X.dealt(plain, F.pmod(X.any_row("doc_id", "text"), F.lit(n)), n)

    def symbols(group: pa.Table):
        p = Parsed(*_words(group), window)
        return [(0, *X.distinct(p.names))]

    def windows(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return X.rows([], X.ASKED)
        h, counts = _words(group)
        p = Parsed(h, counts, window)
        repeated = X.joined(answers, 0).astype(bool)[X.located(p.names)[1]]
        keys, times = X.distinct(window_hashes(h, p.candidates(repeated), window))
        return X.rows(X.asked(group.column("batch")[0].as_py(), 1, keys, times, X.first_shift(k)), X.ASKED)

    def remove(group: pa.Table, answers: pa.Table) -> pa.Table:
        texts = as_bytes(group.column("text"))
        h, counts = words(texts, lower=False)
        known = X.answered_keys(answers, 1)
        stops = np.cumsum(counts)
        at = np.flatnonzero(np.repeat(stops, counts) - np.arange(len(h)) >= window)
        if len(known):
            w = window_hashes(h, at, window)
            at = at[known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w]
        else:
            at = at[:0]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], stops])])
        kept = []
        for t, a, b, r in zip(texts, stops - counts, stops, removed, strict=True):
            parts = t.split()
            kept.append(b" ".join(parts if not r else [x for x, g in zip(parts, gone[a:b].tolist(), strict=True) if not g]))
        return pa.table([group.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    by_batch = lambda df: df.groupBy("batch")
    flags = X.exchanged(X.ask(placed, symbols, k), _flags, k)
    wanted = by_batch(placed).cogroup(by_batch(flags)).applyInArrow(trimmed(windows), X.ASK)
    repeated = X.exchanged(wanted, _repeated, k, subset=True)
    kind = docs.schema[doc_id].dataType.simpleString()
    return by_batch(placed).cogroup(by_batch(repeated)).applyInArrow(trimmed(remove), f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
k AS (SELECT r, i, word, CASE WHEN count(*) OVER f = 35 THEN string_agg(word, ' ') OVER f END AS win FROM w WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
c AS (SELECT r, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS twice FROM k),
g AS (SELECT r, i, word, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN s USING (r)
"""
