"""Language ID with a linear-chain conditional random field over words.

Each word has lexicon, affix and letter n-gram features, hashed into TABLE rows of weights a language; transitions between
the languages of neighbouring words are learned too. A chain is a line of text, however long. Forward-backward gives each
word's probability of each language; a text takes the language with the largest mean over its words, weighted by their
lengths, and that mean is its score. segments() labels code-switched words.

Long chains are worked on in blocks of BLOCK words and long texts in pieces of PIECE bytes: the messages that cross a border
are carried over exactly, by the products of the transfer matrices between, so no transition is lost. Memory is that of one
piece, or of the longest word.

Training: segments of SEGMENT words drawn from at most SAMPLE labelled documents of each language (the least hashes of
doc_id), of each a passage of at most PASSAGE characters, spliced so that languages meet inside a chain. All three bounds
are parameters of the fit; prediction reads whole texts.

Nulls: a text that is null or has no letter is `und` with score 0; so is every text if no label was learned. A null
lang is not learned from. Empty table: empty result. Ties go to the language first by code point. Repeated rows get
equal results. Very long texts are read whole. A column of the table that has the name of a result is replaced; others
pass through untouched.
"""

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table
from ._tokens import U, bounds, hashed, mix

#: Messages are scaled every SCALE words, of which the likeliest language of each has 1, the others e^-60 at least.
TABLE_BITS, BLOCK, SCALE, GRAMS = 18, 128, 4, (1, 2, 3, 4)
SAMPLE, PASSAGE, SEGMENTS, SEGMENT, EPOCHS, RATE = 300, 20_000, 8000, 24, 4, 0.2
#: Share of language changes in training; bytes of a piece of text; bytes of distinct words whose n-grams are held at once;
#: words whose scores are kept for the next pieces.
SWITCH, PIECE, CHUNK, KNOWN = 0.15, 1 << 19, 1 << 17, 200_000

# letters and all bytes beyond ASCII stay, the line feed stays as a mark of its own, all else separates words
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x80:] = np.arange(0x80, 256)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


class Words:
    """The words of some lower-case texts: the distinct ones, and chains over all of them."""

    def __init__(self, raw: list[bytes]):
        source = np.frombuffer(b" " + b" ".join(raw) + b" " * 9, np.uint8)
        self.joined = _MAP[source]
        start, end = bounds(self.joined)
        self.size = end - start
        stops = np.cumsum([len(x) + 1 for x in raw]) + 1
        self.n = np.diff(np.searchsorted(start, stops), prepend=0)
        breaks = np.concatenate([np.flatnonzero(source == 0x0A), stops[:-1] - 1]) if len(raw) else np.zeros(0, np.int64)
        line = np.searchsorted(np.sort(breaks), start)
        new = np.concatenate([[True], line[1:] != line[:-1]]) if len(start) else np.zeros(0, bool)
        self.chain = np.flatnonzero(new)
        self.length = np.diff(self.chain, append=len(start))
        h = hashed(self.joined, start, end)
        _, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        self.start, self.end, self.hash = start[first], end[first], h[first]

    def features(self, which: np.ndarray | slice = slice(None)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the table, word) of the features of these distinct words, one kind after another, each in the
        order of words: the word itself, and its n-grams with the spaces around it, those with a space being its affixes."""
        start, end, h = self.start[which], self.end[which], self.hash[which]
        yield (mix(h, 50) >> U(64 - TABLE_BITS)).astype(np.int32), np.arange(len(start), dtype=np.int32)
        span = end - start + 2
        begin = np.cumsum(span) - span
        at = np.repeat(start - 1 - begin, span) + np.arange(span.sum())
        word = np.repeat(np.arange(len(start), dtype=np.int32), span)
        left = np.repeat(end + 1, span) - at  # letters and spaces from here to the end of the word
        code = np.zeros(len(at), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            code = code << U(8) | self.joined[np.minimum(at + n - 1, len(self.joined) - 1)].astype(np.uint64)
            if n in GRAMS:
                here = left >= n
                yield (mix(code[here], 50 + n) >> U(64 - TABLE_BITS)).astype(np.int32), word[here]

    def chunks(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """These distinct words in parts of about CHUNK bytes each; a longer word is a part of its own."""
        stops, a = np.cumsum((self.end - self.start)[which] + 2), 0
        while a < len(stops):
            b = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + CHUNK, "right")))
            yield which[a:b]
            a = b


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def _rows_scaled(x: np.ndarray) -> np.ndarray:
    return x / (x @ np.ones(x.shape[1]))[:, None]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray

    #: Scores of words met before, by ascending hash; None while the weights still change.
    known: tuple[np.ndarray, np.ndarray] | None = None

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of the distinct words by language."""
        out, todo = np.zeros((len(w.start), len(self.langs)), np.float32), np.arange(len(w.start))
        if self.known is not None and len(self.known[0]):
            h, scores = self.known
            at = np.minimum(np.searchsorted(h, w.hash), len(h) - 1)
            met = h[at] == w.hash
            out[met], todo = scores[at[met]], np.flatnonzero(~met)
        for part in w.chunks(todo):
            for rows, owner in w.features(part):
                if len(owner):
                    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    out[part[owner[first]]] += np.add.reduceat(self.weights[rows], first, axis=0)
        if self.known is not None and len(todo):
            h, scores = self.known if len(self.known[0]) + len(todo) <= KNOWN else (w.hash[:0], out[:0])
            h, scores = np.concatenate([h, w.hash[todo]]), np.concatenate([scores, out[todo]])
            order = np.argsort(h, kind="stable")
            self.known = h[order], scores[order]
        return out

    def likelihoods(self, w: Words) -> np.ndarray:
        """Of each word in order, up to a factor, the likelihood of each language."""
        e = self.emissions(w)
        return np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0)).astype(np.float64)[w.word] if len(e) else e.astype(np.float64)

    def transfer(self, e: np.ndarray, at: np.ndarray, size: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Of each block of words the product of its moves and likelihoods, scaled; an opening block has no move before it.

        The blocks come in falling order of size.
        """
        move, k = np.exp(self.moves), e.shape[1]
        out = np.repeat(np.eye(k)[None], len(at), 0)
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, side="left"))
            now = out[:m] if not t and opening[:m].all() else out[:m] @ move
            if not t:
                now = np.where(opening[:m, None, None], out[:m], now)
            out[:m] = _scaled(now * e[at[:m] + t][:, None, :])
        return out

    def posteriors(self, w: Words, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Of each word the probability of each language; if asked, also the expected moves.

        before: the message of the words before, if the first chain goes on from there; after: that of the words after,
        if the last chain goes on.
        """
        e, k = self.likelihoods(w), len(self.langs)
        if not len(e):
            return e, np.zeros((k, k)) if pairs else None
        blocks = -(-w.length // BLOCK)
        chain = np.repeat(np.arange(len(blocks)), blocks)
        inner = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = w.chain[chain] + inner * BLOCK
        size = np.minimum(w.length[chain] - inner * BLOCK, BLOCK)
        opening = inner == 0
        into, outof = np.ones((len(at), k)), np.ones((len(at), k))
        if before is not None:
            opening[0], into[0] = False, before
        if after is not None:
            outof[-1] = after
        many = np.flatnonzero(blocks[chain] > 1)
        if len(many):
            by_size = many[np.argsort(-size[many], kind="stable")]
            product = np.empty((len(at), k, k))
            product[by_size] = self.transfer(e, at[by_size], size[by_size], opening[by_size])
            for j in many.tolist():
                if inner[j]:
                    into[j] = into[j - 1] @ product[j - 1]
                    into[j] /= into[j].sum()
            for j in many[::-1].tolist():
                if inner[j] + 1 < blocks[chain[j]]:
                    outof[j] = product[j + 1] @ outof[j + 1]
                    outof[j] /= outof[j].sum()
        # by place in the block, so that the words of one step lie together
        order = np.argsort(-size, kind="stable")
        at, size, opening, into, outof = at[order], size[order], opening[order], into[order], outof[order]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()  # blocks longer than t
        here = np.concatenate([at[:m] + t for t, m in enumerate(alive)])
        steps, move = e[here], np.exp(self.moves)
        ahead, back = np.empty_like(steps), np.empty_like(steps)
        now, place = np.where(opening[:, None], 1.0, into @ move), 0
        for t, m in enumerate(alive):
            now = (now[:m] @ move if t else now) * steps[place : place + m]
            if t % SCALE == 0:
                now = _rows_scaled(now)
            ahead[place : place + m] = now
            place += m
        later = np.zeros((0, k))
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            place -= m
            now = np.concatenate([later, outof[len(later) : m]])
            if t % SCALE == 0:
                now = _rows_scaled(now)
            back[place : place + m] = now
            later = (now * steps[place : place + m]) @ move.T
        p = np.empty_like(e)
        p[here] = _rows_scaled(ahead * back)
        expected = None
        if pairs:
            a, z = np.empty_like(e), np.empty_like(e)
            a[here], z[here] = ahead, back * steps
            inside = np.ones(len(e), bool)
            inside[w.chain] = False
            i = np.flatnonzero(inside)
            prior, behind = a[i - 1], z[i]
            expected = move * ((prior / ((prior @ move) * behind).sum(1, keepdims=True)).T @ behind)
        return p, expected

    def mass(self, w: Words, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Of each text the probability of each language, summed over its words by their lengths."""
        out = np.zeros((len(w.n), len(self.langs)))
        some = np.flatnonzero(w.n)
        if len(some):
            p = self.posteriors(w, False, before, after)[0] * w.size[:, None]
            out[some] = np.add.reduceat(p, (np.cumsum(w.n) - w.n)[some], axis=0)
        return out

    def long_mass(self, raw: bytes) -> np.ndarray:
        """mass() of one long text, piece by piece: the first pass finds the messages at the borders, the second the sums."""
        pieces, k = list(cut(raw)), len(self.langs)
        ends, products = [], []
        for piece, goes_on in pieces:
            w = Words([piece])
            if not len(w.word):
                ends.append((goes_on, False))
                products.append((None, None))
                continue
            e = self.likelihoods(w)
            first, last = (self._through(e, int(w.chain[c]), int(w.length[c]), not (c == 0 and goes_on)) for c in (0, len(w.chain) - 1))
            ends.append((goes_on, len(w.chain) == 1))
            products.append((first, last))
        into: list = [None] * len(pieces)
        now = None  # the message of the last chain so far
        for i, (goes_on, single) in enumerate(ends):
            into[i] = now if goes_on else None
            last = products[i][1]
            if last is None:
                continue
            now = (now if goes_on and single and now is not None else np.ones(k)) @ last
            now = now / now.sum()
        total, later = np.zeros(k), None
        for i in range(len(pieces) - 1, -1, -1):
            w = Words([pieces[i][0]])
            total += self.mass(w, into[i], later)[0]
            goes_on, single = ends[i]
            first = products[i][0]
            if not goes_on or first is None:
                later = None
            else:
                later = first @ (later if single and later is not None else np.ones(k))
                later = later / later.sum()
        return total

    def _through(self, e: np.ndarray, start: int, length: int, opening: bool) -> np.ndarray:
        """transfer() of one whole chain."""
        at = np.arange(start, start + length, BLOCK)
        size = np.minimum(start + length - at, BLOCK)
        first = np.zeros(len(at), bool)
        first[0] = opening
        out = None
        for x in self.transfer(e, at, size, first):
            out = x if out is None else _scaled((out @ x)[None])[0]
        return out


def cut(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """Pieces of a text of about PIECE bytes, cut between words, and whether a piece goes on in the line of the one before."""
    a, size = 0, len(raw)
    while a < size or not size:
        b = min(size, a + PIECE)
        while b < size:  # to the first separator that follows a word
            marks = _MAP[np.frombuffer(raw, np.uint8, min(PIECE, size - b + 1), b - 1)] == 0x20
            found = np.flatnonzero(marks[1:] & ~marks[:-1])
            if len(found):
                b += int(found[0])
                break
            b += len(marks) - 1
        gap = np.frombuffer(raw, np.uint8, b - a, a)
        word = _MAP[gap] != 0x20
        lead = int(word.argmax()) if word.any() else len(gap)
        yield raw[a:b], a > 0 and not (gap[:lead] == 0x0A).any()
        if not size:
            return
        a = b


def train(texts: list[tuple[str, str]], seed: int = 10) -> Model:
    """From (lang, text): stochastic gradient steps on the likelihood of spliced segments, with AdaGrad."""
    langs = sorted({lang for lang, _ in texts}, key=lambda x: x.encode())
    k = len(langs)
    model = Model(langs, np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k)))
    if not k:
        return model
    rng = np.random.default_rng(seed)
    by_lang = {lang: [w for x, t in texts if x == lang for w in t.split()] for lang in langs}
    usable = [i for i, lang in enumerate(langs) if by_lang[lang]]
    if not usable:
        return model
    parts = [[0, *itertools.accumulate(map(_parts, by_lang[lang]))] for lang in langs]
    square, square_moves = np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
    for _ in range(EPOCHS * SEGMENTS // 100):
        chains, labels = [], []
        for _ in range(100):
            line, gold, left = [], [], SEGMENT
            while left > 0:
                y = int(rng.choice(usable))
                n = min(left, int(rng.geometric(SWITCH)) + 2)
                source = by_lang[langs[y]]
                at = int(rng.integers(max(1, len(source) - n)))
                line += source[at : at + n]
                gold += [y] * (parts[y][at + min(n, len(source) - at)] - parts[y][at])
                left -= n
            chains.append(" ".join(line))
            labels += gold
        w = Words([x.lower().encode() for x in chains])
        gold = np.array(labels)
        if len(gold) != len(w.word) or not len(gold):
            continue
        p, expected = model.posteriors(w, pairs=True)
        p[np.arange(len(gold)), gold] -= 1
        inner = np.ones(len(gold), bool)
        inner[w.chain] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
        by_word = np.zeros((int(w.word.max()) + 1, k))
        np.add.at(by_word, w.word, p)
        features, owner = (np.concatenate(x) for x in zip(*w.features(), strict=True))
        order = np.argsort(features, kind="stable")
        rows = features[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows, step = rows[first], np.add.reduceat(by_word[owner[order]], first, axis=0)
        step = step / 100 + 1e-5 * model.weights[rows]
        square[rows] += step**2
        model.weights[rows] -= RATE * step / np.sqrt(square[rows])
        step = (expected - seen) / 100
        square_moves += step**2
        model.moves -= RATE * step / np.sqrt(square_moves)
    return model


@functools.lru_cache(1 << 16)
def _parts(word: str) -> int:
    """The words of the field that a blank-separated word holds."""
    return len(re.findall(rb"[a-z\x80-\xff]+", word.lower().encode()))


def fitted(docs: DataFrame, doc_id: str, text: str, lang: str, may_learn: Column, sample: int = SAMPLE, passage: int = PASSAGE) -> Model:
    """A model of a passage each of at most `sample` documents a language among those that may be learned from.

    The passage starts at a place that follows from the document's hash.
    """
    order = F.xxhash64(F.col(doc_id), F.lit(10))
    usable = docs.where(may_learn & F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), order.alias("o"), F.col(text).alias("text"))
    # hashes are spread evenly, so four times the sample lies below this share of their range: few rows of a language meet
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n"))
    below = F.lit(-(2.0**63)) + F.lit(2.0**64) * share
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    near = usable.select("lang", "o", "id").join(counts, "lang").where(F.col("o") <= below)
    least = Window.partitionBy("lang").orderBy("o", "id")
    chosen = near.withColumn("at", F.row_number().over(least)).where(F.col("at") <= sample).select("lang", "o", "id").distinct()
    n = F.length("text")
    begin = F.when(n > passage, F.pmod("o", n - passage + 1)).otherwise(0)
    part = F.substring(F.col("text"), (begin + 1).cast("int"), F.lit(passage)).alias("text")
    # at most sample rows a language, and with the lang in the key none of another one that shares a doc_id
    same = (F.col("c.o") == F.col("u.o")) & F.col("c.id").eqNullSafe(F.col("u.id")) & (F.col("c.lang") == F.col("u.lang"))
    found = usable.alias("u").join(F.broadcast(chosen.alias("c")), same, "left_semi").select("o", "lang", part)
    nth = Window.partitionBy("lang").orderBy("o", "text")
    rows = found.withColumn("at", F.row_number().over(nth)).where(F.col("at") <= 2 * sample).orderBy("o", "lang", "text").collect()
    return train([(r.lang, r.text) for r in rows if r.text])


def predicted(docs: DataFrame, model: Model, text: str = "text", names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, in columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*names_out)
    inner = [f"_{i}" for i in range(len(kept.columns))]
    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept.columns, inner, strict=True)], F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches):
        model = shared.value
        model.known = model.known or (np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = zip(part.column("text").to_pylist(), part.column("letter").to_pylist(), strict=True)
                langs, scores = _labels(model, [t if o else "" for t, o in texts])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in inner), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*inner, "lang", "score"])

    schema = given.select(*inner, F.lit("").alias("lang"), F.lit(0.0).alias("score")).schema
    return given.mapInArrow(run, schema).toDF(*kept.columns, *names_out)


def _labels(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    mass, part, size = [], [], 0
    for i, t in enumerate(texts):
        raw = t.lower().encode()
        long = len(raw) > PIECE
        if not long:
            part.append(raw)
            size += len(raw)
        if part and (long or size >= PIECE or i == len(texts) - 1):
            mass.append(model.mass(Words(part)))
            part, size = [], 0
        if long:
            mass.append(model.long_mass(raw)[None])
    found = np.concatenate([np.zeros((0, len(model.langs))), *mass])
    total = found.sum(1).tolist()
    best = found.argmax(1).tolist()
    langs = [model.langs[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
    return langs, [min(1.0, float(found[j, b]) / t) if t > 0 else 0.0 for j, (b, t) in enumerate(zip(best, total, strict=True))]


def segments(model: Model, text: str) -> list[tuple[str, int]]:
    """The runs of words of one language in a text, each with its number of words."""
    w = Words([text.lower().encode()])
    out: list[tuple[str, int]] = []
    if model.langs and len(w.word):
        for y in model.posteriors(w)[0].argmax(1).tolist():
            lang = model.langs[y]
            out = [*out[:-1], (lang, out[-1][1] + 1)] if out and out[-1][0] == lang else [*out, (lang, 1)]
    return out


def fold(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fitted(docs, "doc_id", "text", "lang", fold("doc_id") != 1)
    held = docs.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "text")
    return predicted(held, model).select("doc_id", "held_out", "lang_pred", "score")
