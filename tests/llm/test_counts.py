"""Language-model scores, repeated windows and similar sets against brute force."""

import collections
import hashlib
import math
import time
import zlib

import numpy as np

from siftwell.llm import _exchange, deleted_interpolation, jaccard_join, recompression
from siftwell.llm._tokens import words as token_hashes


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_words_agree_with_split(pairs):
    raw = [(t or "").encode() for _, t, _, _ in pairs] + [b"\x1c\x85 a\x0bb \xc2\xa0", b"A" * 40 + b" " + b"A" * 41]
    h, n = token_hashes(raw, lower=True)
    lists = [x.lower().split() for x in raw]
    assert n.tolist() == [len(x) for x in lists]
    seen = {}
    for value, word in zip(h.tolist(), (w for x in lists for w in x), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (_exchange.unpack(_exchange.pack(keys)) == keys).all()
    assert len(_exchange.unpack(_exchange.pack(keys[:0]))) == 0
    parts = _exchange.asked(3, 0, keys, np.ones(len(keys), np.int64), 61)
    assert [p[2] for p in parts] == sorted({int(x) >> 61 for x in keys})
    assert (np.concatenate([_exchange.unpack(p[3]) for p in parts]) == keys).all()


def test_rows_of_a_batch_do_not_grow_with_the_text():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2))
    sent = [len(_exchange.asked(0, 0, keys, np.ones(len(keys), np.int64), _exchange.first_shift(_exchange.range_bits(n)))) for n in (10**12, 10**13, 10**14)]
    assert sent == [1024] * 3


def in_steps(monkeypatch):
    """The exchange in four steps of one bit, as for far more text."""
    monkeypatch.setattr(_exchange, "DIGIT", 1)


def test_scores_by_an_exchange_in_steps(docs, monkeypatch):
    want = sorted(map(repr, deleted_interpolation.scored(docs).collect()))
    in_steps(monkeypatch)
    assert sorted(map(repr, deleted_interpolation.scored(docs).collect())) == want


def test_repeated_windows_by_an_exchange_in_steps(docs, pairs, monkeypatch):
    in_steps(monkeypatch)
    rows = recompression.without_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute_windows(pairs, 35)


def test_similar_sets_by_an_exchange_in_steps(docs, pairs, monkeypatch):
    in_steps(monkeypatch)
    rows = jaccard_join.joined(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(pairs)


def test_a_step_deals_out_to_many_batches_in_time(spark, monkeypatch):
    """One group of 512 batches: a search of all its keys for each batch would take minutes."""
    monkeypatch.setattr(_exchange, "DIGIT", 9)
    monkeypatch.setattr(_exchange, "MOST_BUCKETS", 4)
    rng = np.random.default_rng(2)
    keys = [np.unique(rng.integers(0, 1 << 54, 2000).astype(np.uint64)) for _ in range(512)]
    times = [rng.integers(1, 3, len(x)).astype(np.uint64) for x in keys]
    asks = spark.createDataFrame([(b, 1, 0, _exchange.pack(x), _exchange.pack_numbers(t)) for b, (x, t) in enumerate(zip(keys, times, strict=True))], _exchange.ASK)
    began = time.monotonic()
    rows = _exchange.exchanged(asks, recompression._repeated, 10, subset=True).collect()
    assert time.monotonic() - began < 60
    assert [r.batch for r in sorted(rows, key=lambda r: r.batch)] == list(range(512))
    for r in rows:
        assert (_exchange.unpack(r.counts) == keys[r.batch][times[r.batch] > 1]).all()


def test_ids_that_are_no_numbers(spark, pairs):
    named = spark.createDataFrame([(f"d{i}", t) for i, t, _, _ in pairs], "doc_id string, text string")
    for f in (deleted_interpolation.scored, recompression.without_repeats, jaccard_join.joined):
        assert sorted(r.doc_id for r in f(named).select("doc_id").collect()) == sorted(f"d{i}" for i, *_ in pairs)


def test_scores(docs, pairs):
    rows = deleted_interpolation.scored(docs).collect()
    tokens = [(i, [*split(t, True), None]) for i, t, _, _ in pairs]
    counts = collections.Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    trained = [r for r in rows if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


def test_weights_are_the_maximum_of_the_held_out_likelihood():
    events = [(3, 0, -4, 60), (3, -1000, -8, 40), (0, -1000, -4, 10)]
    w = deleted_interpolation.learned(events, 100)
    assert np.allclose(w.sum(1), 1) and (w[:, 1:] > 0).all() and w[0, 0] == 0
    f = np.array([[1, 0.5, 1 / 101], [0, 0.25, 1 / 101]])
    value = lambda x: (np.log(f @ x) * [60, 40]).sum()
    grid = max(value(np.array([a, b, 1 - a - b])) for a in np.linspace(0.01, 0.98, 80) for b in np.linspace(0.01, 0.99 - a, 40) if a + b < 1)
    assert value(w[3]) > grid - 0.5


def test_scores_of_an_empty_table(empty):
    assert deleted_interpolation.scored(empty).count() == 0


def brute_windows(pairs, window):
    lists = [split(t) for _, t, _, _ in pairs]
    counts = collections.Counter(tuple(w[k : k + window]) for w in lists for k in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(pairs, lists, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out)


def test_repeated_windows(docs, pairs):
    rows = recompression.without_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute_windows(pairs, 35)


def test_repeated_windows_in_runs_and_periods(spark):
    texts = ["a " * 100, "a b " * 40, "b a " * 18 + "c", "a " * 34, "x " + "a " * 35, " ".join(map(str, range(35))), " ".join(map(str, range(35))) + " z"]
    pairs = [(i, t, None, None) for i, t in enumerate(texts)]
    rows = recompression.without_repeats(spark.createDataFrame([(i, t) for i, t, _, _ in pairs], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == brute_windows(pairs, 35)


def test_no_repeated_window_is_ruled_out():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 30, 400).astype(np.uint64)
    for _ in range(40):
        a, n = int(rng.integers(0, 360)), 35
        left, right = rng.integers(0, 30, 50).astype(np.uint64), rng.integers(0, 30, 50).astype(np.uint64)
        h = np.concatenate([body, left, body[a : a + n], right])
        p = recompression.Parsed(h, np.array([len(body), 100 + n]), n)
        names, counts = np.unique(p.names, return_counts=True)
        found = set(p.candidates(np.isin(p.names, names[counts > 1])).tolist())
        assert a in found and len(body) + 50 in found


def test_windows_of_an_empty_table(empty):
    assert recompression.without_repeats(empty).count() == 0


def brute_components(pairs):
    sets = []
    for i, t, _, _ in pairs:
        w = split(t, True)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both and 100 * both >= 80 * len(sets[x][1] | sets[y][1]):
                root[max(find(x), find(y))] = min(find(x), find(y))
    least = collections.defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    return sorted((i, len(s), min(least[find(x)])) for x, (i, s) in enumerate(sets))


def test_similar_sets(docs, pairs):
    rows = jaccard_join.joined(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(pairs)


def test_similar_sets_of_an_empty_table(empty):
    assert jaccard_join.joined(empty).count() == 0


def test_hash_of_kept_text(docs):
    r = recompression.without_repeats(docs.where("doc_id = 401")).first()
    assert hashlib.sha256(r.kept.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def brute_scores(pairs):
    """The model's probabilities by plain counting: bigrams, unigrams and a uniform share, weights by expectation-maximisation."""
    tokens = [(i, [w.decode() for w in split(t, True)] + [None]) for i, t, _, _ in pairs]
    fold = lambda i: zlib.crc32(str(i).encode()) % 10

    def counted(chosen):
        one, two, starts = collections.Counter(), collections.Counter(), 0
        for ws in chosen:
            one.update(ws)
            two.update(zip(["<s>", *ws], ws, strict=False))
            starts += 1
        return one, two, starts, sum(one.values())

    def estimates(ws, c):
        one, two, starts, n = c
        for u, w in zip(["<s>", *ws], ws, strict=False):
            context = starts if u == "<s>" else one[u]
            yield context, two[u, w] / context if context else 0.0, one[w] / max(n, 1)

    training = counted([ws for i, ws in tokens if fold(i)])
    rest = counted([ws for i, ws in tokens if fold(i) > 1])
    v = len(training[0])
    events = collections.Counter()
    grid = lambda x: round(math.log2(x) * 4) if x > 0 else -1000
    for i, ws in tokens:
        if fold(i) == 1:
            events.update((min(math.frexp(c)[1], 47), grid(f2), grid(f1)) for c, f2, f1 in estimates(ws, rest))

    def em(cells):
        w = [1 / 3] * 3
        for _ in range(80):
            now = [1.0] * 3
            for (_, q2, q1), n in cells:
                f = [a * (2.0 ** (q / 4) if q != -1000 else 0.0) for a, q in zip(w[:2], (q2, q1), strict=True)] + [w[2] / (v + 1)]
                now = [a + n * x / sum(f) for a, x in zip(now, f, strict=True)]
            w = [a / sum(now) for a in now]
        return w

    overall = em(list(events.items()))
    weights = {}
    for b in range(48):
        mine = [e for e in events.items() if e[0][0] == b]
        weights[b] = em(mine) if mine else overall
    weights[0] = [0.0, weights[0][1] / sum(weights[0][1:]), weights[0][2] / sum(weights[0][1:])]
    out = []
    for i, ws in tokens:
        score = 0.0
        for c, f2, f1 in estimates(ws, training):
            a, b, u = weights[min(math.frexp(c)[1], 47)]
            score += math.log10(a * f2 + b * f1 + u / (v + 1))
        out.append((i, score))
    return out


def test_scores_against_plain_counting(docs, pairs):
    got = sorted((r.doc_id, r.score) for r in deleted_interpolation.scored(docs).collect())
    want = sorted(brute_scores(pairs))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-6)
