"""N-best segmentation into the pieces of a given vocabulary, and exact decoding.

The lattice of a text has an edge for each vocabulary piece that matches, and byte pieces for characters that none
covers. Viterbi scores forward from the start are exact heuristics for an A* search backward from the end, which
therefore pops complete segmentations in order of score. No piece has a space after another character, so a lattice
falls apart before each run of spaces and around characters that only byte pieces cover; the parts are searched once
each, and the best segmentations of a text are merged from the parts with the least loss at their second choice.

Scores are whole numbers of a millionth, so equal sums are equal. For a vocabulary of merges, whose stored scores are
ranks, a piece of rank r counts as probability in proportion to 1 / (r + 2.7), Zipf's law; `stored` takes the
scores of the file as they are.

Nulls: a null text stays null: no pieces, score 0. An empty text has no pieces. Empty table: empty result. Repeated rows
get equal results. Ties: in an order that depends on the text alone. Texts of any length are read whole: a part that
is longer than PART characters falls apart where no piece crosses, which loses no segmentation, and what is still longer
is searched as it is, outside the cache. Decoding gives the text back byte by byte. Extra columns pass through; those named
ids, nbest or intact are replaced.
"""

import heapq
import math
import re
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import table

SPACE, LITERAL = "▁", "▁"
N_BEST, PART, CACHE, UNIT = 4, 256, 250_000, 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces with their numbers and scores; bytes_of gives what a number stands for."""

    ids: dict[str, tuple[int, int]]
    byte_ids: list[int]
    byte_score: int
    bytes_of: list[bytes]
    split: str
    trie: dict
    longest: int
    cache: dict = field(default_factory=dict, repr=False, compare=False)
    old: dict = field(default_factory=dict, repr=False, compare=False)
    ways: dict = field(default_factory=dict, repr=False, compare=False)


def load(path: str, scores: str = "zipf") -> Vocabulary:
    """The vocabulary of a model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    ids, byte_ids, bytes_of = {}, [0] * 256, [b""] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            bytes_of[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i)):
            score = model.get_score(i) if scores == "stored" else -math.log(max(0.0, -model.get_score(i)) + 2.7)
            ids[piece] = (i, round(score * UNIT))
            bytes_of[i] = piece.replace(SPACE, " ").encode()
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece has a space after another character")
    bare = "".join(c for c in map(chr, range(0x20)) if not any(c in p for p in ids))
    split = f"[{re.escape(bare)}]|{SPACE}*[^{SPACE}{re.escape(bare)}]+|{SPACE}+"
    return Vocabulary(ids, byte_ids, min(s for _, s in ids.values()) - 10 * UNIT, bytes_of, split, _trie(ids), max(map(len, ids)))


def _trie(ids: dict[str, tuple[int, int]]) -> dict:
    """Nested dictionaries by character; "" holds a piece's (number, score)."""
    root: dict = {}
    for piece, found in ids.items():
        at = root
        for c in piece:
            at = at.setdefault(c, {})
        at[""] = found
    return root


def _bytes_edge(v: Vocabulary, char: str) -> tuple[tuple[int, ...], int]:
    raw = char.encode()
    return tuple(v.byte_ids[b] for b in raw), v.byte_score * len(raw)


def viterbi(v: Vocabulary, part: str) -> tuple[int, int, bytes]:
    """Of a part: the best score, its lead over the second best (-1: there is no second), and the best numbers.

    The second best leaves the best path at some place for the next best edge into it, and is at its best from
    there back to the start.
    """
    size, root, longest, ids = len(part), v.trie, v.longest, v.ids
    ahead: list = [None] * (size + 1)
    ahead[0] = 0
    second: list = [None] * (size + 1)
    via: list = [None] * (size + 1)
    for i in range(size):
        base = ahead[i]
        if base is None:
            continue
        node, j = root, i
        for c in part[i : i + longest]:
            node = node.get(c)
            if node is None:
                break
            j += 1
            found = node.get("")
            if found is not None:
                score = base + found[1]
                old = ahead[j]
                if old is None:
                    ahead[j], via[j] = score, (i, found[0])
                elif score > old:
                    ahead[j], second[j], via[j] = score, old, (i, found[0])
                elif second[j] is None or score > second[j]:
                    second[j] = score
        if part[i] not in ids:
            piece, cost = _bytes_edge(v, part[i])
            score, j = base + cost, i + 1
            if ahead[j] is None:
                ahead[j], via[j] = score, (i, piece)
            elif second[j] is None or score > second[j]:
                second[j] = score
    lead, numbers, at = -1, [], size
    while at:
        if second[at] is not None:
            loss = ahead[at] - second[at]
            if lead < 0 or loss < lead:
                lead = loss
        at, piece = via[at]
        if isinstance(piece, tuple):
            numbers += piece[::-1]
        else:
            numbers.append(piece)
    numbers.reverse()
    return ahead[size], lead, struct.pack(f"<{len(numbers)}i", *numbers)


def _forward(v: Vocabulary, part: str) -> list[int]:
    """The best score from the start to each place of a part."""
    ahead: list = [0] + [None] * len(part)
    for i in range(len(part)):
        base, node = ahead[i], v.trie
        for j, c in enumerate(part[i : i + v.longest], i + 1):
            node = node.get(c)
            if node is None:
                break
            found = node.get("")
            if found is not None and (ahead[j] is None or base + found[1] > ahead[j]):
                ahead[j] = base + found[1]
        if part[i] not in v.ids:
            score = base + _bytes_edge(v, part[i])[1]
            if ahead[i + 1] is None or score > ahead[i + 1]:
                ahead[i + 1] = score
    return ahead


def _into(v: Vocabulary, part: str, at: int):
    """(start, score, piece) of the edges that end at a place."""
    for start in range(max(0, at - v.longest), at):
        found = v.ids.get(part[start:at])
        if found is not None:
            yield start, found[1], found[0]
    if part[at - 1] not in v.ids:
        piece, cost = _bytes_edge(v, part[at - 1])
        yield at - 1, cost, piece


def n_best(v: Vocabulary, part: str, n: int) -> list[tuple[int, bytes]]:
    """The n best segmentations of a part, best first: (score, numbers as little-endian 32-bit integers).

    Of equal totals the one nearest to the start goes first, so each search goes straight there; a branch that n others
    already match or beat is not kept.
    """
    size, ahead = len(part), _forward(v, part)
    out: list[tuple[int, bytes]] = []
    heap, turn, least = [(-ahead[size], size, 0, 0, ())], 1, [ahead[size]]
    while heap:
        total, at, _, behind, tail = heapq.heappop(heap)
        if not at:
            numbers: list[int] = []
            while tail:
                piece, tail = tail
                numbers += piece if isinstance(piece, tuple) else (piece,)
            out.append((-total, struct.pack(f"<{len(numbers)}i", *numbers)))
            if len(out) == n:
                break
            continue
        onward = False
        for start, score, piece in _into(v, part, at):
            whole = behind + score + ahead[start]
            if whole == -total and not onward:
                onward = True
            elif len(least) < n:
                heapq.heappush(least, whole)
            elif whole > least[0]:
                heapq.heapreplace(least, whole)
            else:
                continue
            heapq.heappush(heap, (-whole, start, turn, behind + score, (piece, tail)))
            turn += 1
    return out


def _uncrossed(v: Vocabulary, part: str) -> list[str]:
    """A part cut at the places that no piece crosses: each of its segmentations is one of every cut's."""
    out, start, reach, root = [], 0, 0, v.trie
    for i in range(len(part)):
        if i and reach <= i:
            out.append(part[start:i])
            start = i
        node = root
        for j, c in enumerate(part[i : i + v.longest], i + 1):
            node = node.get(c)
            if node is None:
                break
            if j > reach and "" in node:
                reach = j
    out.append(part[start:])
    return out


def _literal(v: Vocabulary) -> tuple[int, int, bytes]:
    piece, cost = _bytes_edge(v, SPACE)
    return cost, -1, struct.pack(f"<{len(piece)}i", *piece)


def _parts(v: Vocabulary, text: str) -> tuple[list[str], list[tuple[int, int, bytes]]]:
    """The parts of a text in order, and viterbi() of each."""
    found = re.findall(v.split, SPACE + text.replace(" ", SPACE)) if SPACE not in text else _with_literals(v, text)
    if max(map(len, found)) > PART:
        found = [x for p in found for x in (_uncrossed(v, p) if len(p) > PART else (p,))]
    young, old, out = v.cache, v.old, []
    for p in found:
        best = young.get(p)
        if best is None:
            best = old.get(p)
            if best is None:
                best = _literal(v) if p is LITERAL else viterbi(v, p)
            if p is not LITERAL and len(p) <= PART:
                young[p] = best
            if len(young) >= CACHE:
                v.old = old = young
                v.cache = young = {}
        out.append(best)
    return found, out


def _with_literals(v: Vocabulary, text: str) -> list[str]:
    """A space sign that is part of the text goes by its bytes, so that decoding can tell it from a space."""
    sections = [s.replace(" ", SPACE) for s in text.split(SPACE)]
    out = re.findall(v.split, SPACE + sections[0])
    for s in sections[1:]:
        out += [LITERAL, *re.findall(v.split, s)]
    return out


def segmented(v: Vocabulary, text: str, n: int = N_BEST) -> list[tuple[int, bytes, list]]:
    """(score, numbers, changes) of the n best segmentations of a text; the first has the best of each part, and
    changes lists (numbers, numbers of the best) of the parts in which another differs from it."""
    names, parts = _parts(v, text) if text else ([], [])
    best = sum([p[0] for p in parts])
    # only the n - 1 parts with the least lead can differ from their best in the n best
    close = heapq.nsmallest(n - 1, [(p[1], i) for i, p in enumerate(parts) if p[1] >= 0])
    options = []
    for _, i in close:
        options.append(_choices(v, names[i], parts[i], n))
    # the n best over some parts need only the n best over the parts before
    ways: list[tuple[int, tuple[int, ...]]] = [(0, ())]
    for choices in options:
        ways = heapq.nsmallest(n, ((loss + c[0], (*picks, j)) for loss, picks in ways for j, c in enumerate(choices)))
    numbers = [p[2] for p in parts]
    out = []
    for loss, picks in ways:
        taken = zip(close, options, picks, strict=True)
        changes = [(i, c[j][1]) for (_, i), c, j in taken if c[j][1] != numbers[i]]
        own = numbers.copy() if changes else numbers
        for i, x in changes:
            own[i] = x
        out.append((best - loss, b"".join(own), [(x, numbers[i]) for i, x in changes]))
    return out


def _choices(v: Vocabulary, name: str, part: tuple[int, int, bytes], n: int) -> list[tuple[int, bytes]]:
    """(loss, numbers) of the n best segmentations of a part, the best one as viterbi() has it."""
    found = v.ways.get((name, n))
    if found is None:
        score, _, top = part
        found = [(0, top), *((score - x, numbers) for x, numbers in n_best(v, name, n) if numbers != top)][:n]
        if len(name) <= PART:
            if len(v.ways) >= CACHE // 10:
                v.ways.clear()
            v.ways[name, n] = found
    return found


def decode(v: Vocabulary, numbers: bytes) -> str:
    return _surface(v, numbers)[1:].decode()


def _surface(v: Vocabulary, numbers: bytes) -> bytes:
    return b"".join([v.bytes_of[i] for i in memoryview(numbers).cast("i")])


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, scores: str = "zipf", n: int = N_BEST) -> DataFrame:
    """docs without the text but with ids, the best segmentation's piece numbers; nbest, the scores of the best n, best
    first; and intact, whether each of them decodes to the text. Columns that have these names already are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_vocabulary(), scores))

    def run(batches):
        v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, stops, best, intact = [], [0], [], []
                for t in part.column("text").to_pylist():
                    ways = segmented(v, t or "", n)
                    numbers = ways[0][1]
                    flat.append(numbers)
                    stops.append(stops[-1] + len(numbers) // 4)
                    best.append([w[0] / UNIT for w in ways] if t is not None else None)
                    intact.append((decode(v, numbers) if numbers else "") == (t or "") and all(_surface(v, a) == _surface(v, b) for w in ways for a, b in w[2]))
                values = pa.Array.from_buffers(pa.int32(), stops[-1], [None, pa.py_buffer(b"".join(flat))])
                ids = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values)
                kept = [part.column(i) for i in inner]
                yield pa.RecordBatch.from_arrays([*kept, ids, pa.array(best, pa.list_(pa.float64())), pa.array(intact)], names=names)

    kept = docs.drop(text, "ids", "nbest", "intact")
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("ids array<int>, nbest array<double>, intact boolean").fields])
    names = schema.names
    inner = [f"_{i}" for i in range(len(kept.columns))]
    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept.columns, inner, strict=True)], F.col(text).alias("text"))
    return given.mapInArrow(run, schema)


def op7_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), F.coalesce(F.get("nbest", F.lit(0)), F.lit(0.0)).alias("score"), F.array_join(F.transform("nbest", lambda x: x.cast("decimal(38,6)").cast("string")), ",").alias("nbest"), "intact")
