"""Mixing sources to target weights by the cube method.

Each source has a target in words. A document is taken floor(r) times, r = target / size of its source, and once more
with probability r - floor(r). These fractional probabilities are moved through the null space of two constraints of
the source, its words and its documents, until almost all are 0 or 1 (flight phase). Blocks of a source move apart
from each other; each leaves at most two fractions, which meet in the blocks of the next level. When one block of a
source is left, its last fractions are settled (landing phase).

Nulls: a null source is a source of its own, last in order; a null text has size 0. Empty table: empty result.
Ties and repeated rows are units of their own. Documents of size 0 take 0 words. Reruns agree, whatever the
partitions: blocks and random steps derive from hashes of doc_id, which may be of any type. Very long texts count whole.
Extra columns, whatever their names, are left out. Sources are numbered range by range, so neither they nor documents
meet in one task.

The landing draws the last fractions of a source with their own probabilities. What it leaves off the word target is then
mended by exchanges inside the last block (_swap); they move inclusion probabilities a little, as the README states.
"""

import bisect
import itertools
import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, parts, saved, table

#: Weights of the sources in order, the share of all words to take, and the most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK = 512
EPS = 1e-9


def numbered(sources: DataFrame) -> DataFrame:
    """sources with `at`, the place of each in the order of code points, null last, from 0.

    Ranges of names are numbered apart and moved on by the number of sources in the ranges before.
    """
    placed = sources.repartitionByRange(parts(sources.sparkSession), F.col("source").asc_nulls_last())
    placed = saved(placed.withColumn("range", F.spark_partition_id()), "sources")
    counts = sorted(tuple(r) for r in placed.groupBy("range").count().collect())  # one row a task
    before = dict(zip([r for r, _ in counts], itertools.accumulate([0, *[n for _, n in counts]]), strict=False))
    starts = F.create_map(*[F.lit(x) for r, n in before.items() for x in (r, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    within = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return placed.withColumn("at", F.row_number().over(within) - 1 + starts[F.col("range")]).drop("range")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size): words shared by weight, none above most times
    its size, the excess reshared by weight until none is above. A round is one sum over the sources still below."""
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("at") % len(weights)]
    s = numbered(sources).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    s = saved(s.drop("at"), "weights")
    number, size, weight_sum = s.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    level, left, full = 0.0, (size or 0) * share, None
    while number:
        now = left / weight_sum if weight_sum else level
        level, above = max(level, now), s.where((F.col("cap") <= F.col("weight") * now))
        found = above.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if found[0] == full:
            break
        full = found[0]
        total = s.agg(F.sum("weight")).first()[0]
        left, weight_sum = size * share - (found[1] or 0) * most, total - (found[2] or 0)
        if full == number:
            break
    return s.select("source", "n", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(float(level))).alias("target"))


def _flight(sizes: list[int], x: list[float], draw: random.Random, land: bool) -> None:
    """Moves x in place until at most two fractions are left, or none if land."""
    active: list[int] = []
    start = list(x)

    def move(units: list[int], u: list[float]) -> None:
        up = min((1 - x[i]) / v if v > 0 else x[i] / -v for i, v in zip(units, u, strict=True) if v)
        down = min(x[i] / v if v > 0 else (1 - x[i]) / -v for i, v in zip(units, u, strict=True) if v)
        step = up if draw.random() * (up + down) < down else -down
        for i, v in zip(units, u, strict=True):
            x[i] += step * v
            if x[i] < EPS:
                x[i] = 0.0
            elif x[i] > 1 - EPS:
                x[i] = 1.0

    for k in range(len(x)):
        if not 0 < x[k] < 1:
            continue
        active.append(k)
        while len(active) == 3 or len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            if len(active) == 2:
                move(active, [1.0, -1.0])
            else:
                a, b, c = (sizes[i] for i in active)
                u = [b - c, c - a, a - b]
                scale = max(map(abs, u))
                move(active, [v / scale for v in u] if scale else [1.0, -1.0, 0.0])
            active = [i for i in active if 0 < x[i] < 1]
    if land:
        _land(sizes, x, active, draw)
        _swap(sizes, start, x)


def _land(sizes: list[int], x: list[float], active: list[int], draw: random.Random) -> None:
    """Settles the last two fractions or one at random, each with its own probability; of the ways to draw two together
    the one whose words are expected to stay nearer to the target."""
    if len(active) < 2:
        for i in active:
            x[i] = float(draw.random() < x[i])
        return
    i, j = active
    p, q = x[i], x[j]
    off = [abs((v - p) * sizes[i] + (w - q) * sizes[j]) for v, w in ((0, 0), (0, 1), (1, 0), (1, 1))]
    # the chance of both may lie between these; the expectation is linear in it
    both = max(0.0, p + q - 1) if off[0] + off[3] >= off[1] + off[2] else min(p, q)
    u = draw.random()
    x[i] = float(u < p)
    x[j] = float(u < both or p <= u < p + q - both)


def _swap(sizes: list[int], start: list[float], x: list[float]) -> None:
    """Exchanges of a taken and a left unit of the last block, as long as one brings the words nearer to the target;
    while they are more than a two-hundredth away, a unit may also come or go without another."""
    wanted = sum(o * a for o, a in zip(start, sizes, strict=True))
    for _ in range(len(x)):
        over = sum(v * a for v, a in zip(x, sizes, strict=True)) - wanted
        alone = [(0, -1)] if abs(over) > wanted / 200 else []
        left = sorted([(sizes[i], i) for i in range(len(x)) if x[i] == 0 and 0 < start[i] < 1] + alone)
        best = (abs(over), None)
        for a, i in [(sizes[i], i) for i in range(len(x)) if x[i] == 1 and 0 < start[i] < 1] + alone:
            at = bisect.bisect(left, (a - over, -1))
            for b, j in left[max(0, at - 1) : at + 1]:
                best = min(best, (abs(over + b - a), (i, j)), key=lambda t: t[0])
        if best[1] is None:
            return
        for i, v in zip(best[1], (0.0, 1.0), strict=True):
            if i >= 0:
                x[i] = v


def _blocks(group: pa.Table) -> pa.Table:
    group = group.sort_by([("size", "descending"), ("order", "ascending"), ("doc_id", "ascending")])
    x = group.column("x").to_pylist()
    first = group.slice(0, 1).to_pylist()[0]
    _flight(group.column("size").to_pylist(), x, random.Random(f"{first['source']}:{first['level']}:{first['block']}"), first["blocks"] == 1)
    return group.set_column(group.schema.get_field_index("x"), "x", pa.array(x, pa.float64()))


def selected(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, x) with each x moved to 0 or 1, source by source."""
    undecided = (F.col("x") > 0) & (F.col("x") < 1)
    open_, done, level = units, [], 0
    while True:
        counts = open_.where(undecided).groupBy("source").agg(F.count("*").alias("m"))
        if level and not counts.limit(1).count():
            break
        dealt = _joined(open_, counts)
        blocks = F.ceil(F.coalesce("m", F.lit(1)) / block).cast("int")
        order = F.xxhash64(F.col("doc_id"), F.lit(level))
        dealt = dealt.select("doc_id", "source", "size", "x", order.alias("order"), F.lit(level).alias("level"), blocks.alias("blocks"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("order"), F.col("blocks")).cast("int"))
        moving = dealt.where(undecided).groupBy("source", "block").applyInArrow(_blocks, dealt.schema)
        after = saved(moving.select("doc_id", "source", "size", "x"), "cube")
        done += [open_.where(~undecided).select("doc_id", "source", "size", "x"), after.where(~undecided)]
        open_, level = after.where(undecided), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on source, null equal to null. One row a source on the right: broadcast while it is small, and
    beyond that Spark splits the tasks of large sources."""
    r = right.withColumnRenamed("source", "__source")
    return left.join(r, left["source"].eqNullSafe(r["__source"]), "left").drop("__source")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each document is taken."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "sizes")
    rates = saved(targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + EPS)
    part = F.greatest(rate - whole, F.lit(0.0))
    units = _joined(sized, rates.select("source", F.when(part < EPS, F.lit(0.0)).otherwise(part).alias("x")))
    chosen = selected(units)
    return _joined(chosen, rates).select("doc_id", "source", "size", "source_size", "target", (whole + F.col("x")).cast("long").alias("copies"))


def op3_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
