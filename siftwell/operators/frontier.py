"""What to look at next: ordering, template caps, permuted paths, replay plans, and reach over captured pages."""

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from . import filters, urls
from .reduce import first_per_class


def ordered(targets: DataFrame) -> DataFrame:
    """Targets (url, depth, seed, permuted, passive_source, seq) with their score, best first."""
    return _scored(targets).orderBy(*_order())


def placed(targets: DataFrame) -> DataFrame:
    """All targets as ordered() has them, with their place from 1."""
    return _scored(targets).withColumn("place", F.row_number().over(Window.orderBy(*_order())).cast("long"))


def _scored(targets: DataFrame) -> DataFrame:
    return targets.withColumn("score", urls.target_score(F.col("url")))


def _order() -> list:
    return [F.col("seed").desc(), F.col("depth"), F.col("passive_source") != "", F.col("permuted"), F.col("score").desc(), F.col("seq")]


def unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    """(url): the distinct addresses that are not among those visited, fragments aside."""
    plain = lambda df: df.select(urls.without_fragment(F.col("url")).alias("url"))
    return plain(found).distinct().join(plain(visited), "url", "left_anti")


def template_sample(targets: DataFrame, order: list, k: int = 3, url: str = "url") -> DataFrame:
    """The first k addresses of each template."""
    return first_per_class(targets.withColumn("template", urls.template_key(F.col(url))), ["template"], order, k)


def permuted(found: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """(url, score): the path variants of an origin's addresses under the levels of its other ones, neither known nor assets.

    An origin with one address makes none. With `most` an origin gives at most its 4 * most + 64 best, by score and address.
    Of a path's variants that give the same path the one with the likelier mount counts.
    """
    each = found.select(urls.without_fragment(F.col("url")).alias("url")).distinct().withColumn("origin", urls.origin(F.col("url")))
    each = each.where(urls.scheme(F.col("url")).isin("http", "https"))
    many = each.groupBy("origin").agg(F.count("*").alias("n")).where("n > 1").select("origin")
    each = each.join(many, "origin").persist(StorageLevel.DISK_ONLY)
    levels = each.select("origin", F.explode(urls.levels(F.col("url"))).alias("level")).distinct()
    levels = levels.withColumns({"api": urls.interface(F.lower("level")), "last": urls.last_of_level(F.col("level"))}).persist(StorageLevel.DISK_ONLY)
    variants = each.select("origin", F.explode(urls.path_variants(F.col("url"))).alias("v"))
    worth = F.when(F.col("v.mount"), 500).otherwise(0) - 150 * F.col("v.trimmed")
    paths = variants.groupBy("origin", F.col("v.path").alias("path"), F.col("v.query").alias("query")).agg(F.max_by("v", worth).alias("v"))
    paths = paths.where(filters.crawlable(F.concat(F.lit("/"), "path"))).select("origin", "path", "query", *urls.variant_scores(F.col("v")))
    seen = known.select(urls.without_fragment(F.col("url")).alias("url")).union(each.select("url")).distinct()
    new = _crossed(levels, paths, seen)
    if most is not None:
        new = first_per_class(new, ["origin"], [F.col("score").desc(), "url"], 4 * most + 64)
    return new.select("url", "score")


#: Pairs of a level and a path that a task makes, about; sides of the blocks that they are dealt in; levels that a path carries.
PAIRS, SIDE, CARRIED = 1 << 20, 1 << 10, 64


def _cuts(whole: str, least: int) -> Column:
    """(head, tail) of a path at each of its segments from the given one; a head ends with a slash or is empty."""
    upto = lambda x, i: F.concat(F.array_join(F.slice(x, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise(""))
    cut = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: i >= least), lambda i: F.struct(upto(x, i).alias("head"), F.array_join(F.slice(x, i + 1, F.size(x)), "/").alias("tail")))
    return F.filter(let(F.split(F.col(whole), "/"), cut), lambda c: c["tail"] != "")


def _crossed(levels: DataFrame, paths: DataFrame, seen: DataFrame) -> DataFrame:
    """(origin, url, score): all levels of an origin with all its paths, each address once with its best score, no seen one.

    The pairs are as many as levels times paths, so they are made in blocks of even size, are never exchanged, and no task
    holds them. Two pairs give one address only if one path is the end of the other one and the rest ends a level. Only such
    paths, and those that are seen under many levels, are grouped, those with the same last segment in one task.
    """
    keys = ["origin", "path", "query"]
    site = F.col("url").alias("url"), urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("full"), urls.query(F.col("url")).alias("query")
    search = F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise("")
    parsed = seen.select(*site).where(F.col("full").startswith("/") & (F.col("url") == F.concat("origin", "full", search)))
    parsed = parsed.join(levels.select("origin").distinct(), "origin", "left_semi").select("origin", "query", F.substring(F.col("full"), 2, 1 << 30).alias("whole"))
    cuts = parsed.select("origin", "query", "whole", F.explode(_cuts("whole", 0)).alias("c")).select("origin", "query", "whole", F.concat(F.lit("/"), "c.head").alias("level"), F.col("c.tail").alias("path"))
    cuts = cuts.join(levels, ["origin", "level"], "left_semi").join(paths, keys, "left_semi").persist(StorageLevel.DISK_ONLY)
    number = cuts.groupBy(*keys).agg(F.count("*").alias("n"))
    skip = cuts.join(number.where(F.col("n") <= CARRIED), keys).groupBy(*keys).agg(F.collect_list("level").alias("skip"))
    ends = levels.select("origin", F.explode(_cuts("level", 1)).alias("c")).select("origin", F.col("c.tail").alias("head")).distinct()
    alike = paths.select(*keys, F.explode(_cuts("path", 1)).alias("c")).select("origin", "query", F.col("path").alias("longer"), F.col("c.head").alias("head"), F.col("c.tail").alias("path"))
    alike = alike.join(paths, keys, "left_semi").join(ends, ["origin", "head"], "left_semi").select("origin", "query", F.explode(F.array("path", "longer")).alias("path"))
    grouped = alike.select(*keys).union(number.where(F.col("n") > CARRIED).select(*keys)).distinct().withColumn("grouped", F.lit(True))
    paths = paths.join(grouped, keys, "left").join(skip, keys, "left").withColumn("grouped", F.coalesce("grouped", F.lit(False))).persist(StorageLevel.DISK_ONLY)

    many = levels.groupBy("origin").agg(F.count("*").alias("n_levels"))
    sizes = paths.groupBy("origin").agg(F.count_if("grouped").alias("n_grouped"), F.count_if(~F.col("grouped")).alias("n_plain")).join(many, "origin")
    pairs = sizes.agg(*[F.coalesce(F.sum(F.col("n_levels").cast("double") * F.col(c)), F.lit(0.0)) for c in ("n_plain", "n_grouped")]).first()
    least = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = [max(least, math.ceil(x / PAIRS)) for x in pairs]
    parts = lambda n, by: F.greatest(F.ceil(F.col(n) / by), F.lit(1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    score = F.when(F.col("api"), F.col("under_api")).otherwise(F.col("elsewhere")) + F.when(F.col("last") == "", -50).when(F.col("last") == F.col("first"), -3000).otherwise(200)
    url = F.concat("origin", "level", "path", search)

    sides = sizes.select("origin", parts("n_plain", SIDE).alias("a"), parts("n_levels", SIDE).alias("b"))
    block = ["origin", "i", "j"]
    left = paths.where(~F.col("grouped")).join(sides, "origin").withColumns({"i": F.pmod(F.xxhash64("path", "query"), "a").cast("int"), "j": every("b")}).drop("a", "b")
    right = levels.join(sides, "origin").withColumn("j", F.pmod(F.xxhash64("level"), "b").cast("int")).withColumn("i", every("a")).drop("a", "b")
    plain = left.repartition(tasks[0], *block).join(right.repartition(tasks[0], *block).hint("merge"), block)
    plain = plain.where(F.col("skip").isNull() | ~F.array_contains("skip", F.col("level"))).select("origin", url.alias("url"), score.alias("score"))
    if not pairs[1]:
        return plain

    deals = sizes.select("origin", parts("n_grouped", PAIRS / F.col("n_levels")).alias("a"))
    block = ["origin", "i"]
    some = paths.where("grouped").drop("skip", "grouped").withColumn("known", F.lit(False))
    met = cuts.join(some, keys, "left_semi").select("origin", F.col("whole").alias("path"), "query").distinct()  # stand for themselves, under the root
    left = some.unionByName(met.withColumn("known", F.lit(True)), allowMissingColumns=True).join(deals, "origin")
    left = left.withColumn("i", F.pmod(F.xxhash64("query", F.regexp_extract("path", "([^/]*/?)\\z", 1)), "a").cast("int")).drop("a")
    right = levels.join(deals, "origin").withColumn("i", every("a")).drop("a")
    both = left.repartition(tasks[1], *block).join(right.repartition(tasks[1], *block).hint("merge"), block).where(~F.col("known") | (F.col("level") == "/"))
    once = both.groupBy(*block, url.alias("url")).agg(F.max(score).alias("score"), F.bool_or("known").alias("known"))
    return plain.unionByName(once.where(~F.col("known")).select("origin", "url", "score"))


def best(candidates: DataFrame, k: int, once: bool = False) -> DataFrame:
    """The k best distinct addresses, by score and then by address. With `once` each address is there once, as permuted() has it,
    and nothing is grouped."""
    each = candidates.select("url", "score") if once else candidates.groupBy("url").agg(F.max("score").alias("score"))
    return each.orderBy(F.col("score").desc(), "url").limit(k)


def replay_plan(params: DataFrame, levels: DataFrame, most: int = 500) -> DataFrame:
    """(origin, level, params): which parameters would meet which levels of their origin, at most so many; a plan, never sent.

    params and levels have the step at which each was met. Pairs come in the order of the later step of the two; of one step
    new parameters meet the older levels first. Only the first `most` parameters and levels of an origin can be in the plan,
    so no origin makes more than their product.
    """
    first = lambda rows, c: first_per_class(rows.groupBy("origin", c).agg(F.min("step").alias("step")), ["origin"], ["step", c], most).select("origin", c, "step", "rank")
    p, lv = first(params.select("origin", F.btrim("params", F.lit(" \t\n\r\f\x0b")).alias("params"), "step").where("params <> ''"), "params"), first(levels, "level")
    both = p.withColumnsRenamed({"step": "ps", "rank": "pr"}).join(lv.withColumnsRenamed({"step": "ls", "rank": "lr"}), "origin")
    late = F.greatest("ps", "ls")
    order = ["origin", late, F.col("ls") >= F.col("ps"), F.when(F.col("ls") >= F.col("ps"), F.col("lr")).otherwise(F.col("pr")), F.when(F.col("ls") >= F.col("ps"), F.col("pr")).otherwise(F.col("lr"))]
    return both.orderBy(*order).limit(most).select("origin", "level", "params")


def reached(spark, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(url, depth) of pages within `depth` links of the seeds, over captured links (source, value)."""
    edges = edges.persist(StorageLevel.DISK_ONLY)  # found once, met at every depth
    seen = seeds.select("url", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front, edges["source"] == front["url"]).select(F.col("value").alias("url")).distinct()
        front = step.join(seen, "url", "left_anti").select("url", F.lit(d).alias("depth"))
        seen = seen.union(front)
    return seen


def suppressed_contexts(matches: DataFrame, least: int = 8) -> DataFrame:
    """Sources of a bundle's module table: those with `least` pairs ./x and ./x.js and more, with the members of the pairs."""
    local = matches.where(F.col("value").startswith("./")).select("source", "value").distinct()
    stem = F.regexp_replace("value", r"\.(?:js|mjs|cjs)$", "")
    stems = local.where(stem != F.col("value")).select("source", stem.alias("stem"), F.col("value").alias("file"))
    pairs = stems.join(local, (stems["source"] == local["source"]) & (stems["stem"] == local["value"])).select(stems["source"], "stem", "file")
    many = pairs.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("source")
    return pairs.join(many, "source").select("source", F.explode(F.array("stem", "file")).alias("value")).distinct()


def without_listed(artifacts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Artifacts whose source ends with none of the listed suffixes: an equality join on the ends of the lengths that the list has."""
    listed = suffixes.select("suffix").where("suffix <> ''").distinct()
    lengths = sorted(r[0] for r in listed.select(F.length("suffix")).distinct().collect())
    if not lengths:
        return artifacts
    ends = F.array_distinct(F.array(*[F.right(F.col("source"), F.lit(n)) for n in lengths]))
    hit = artifacts.select("source").distinct().withColumn("suffix", F.explode(ends)).join(listed, "suffix", "left_semi").select("source").distinct()
    return artifacts.join(hit, "source", "left_anti")
