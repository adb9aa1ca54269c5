"""The crawl over captured responses: findings of each page, the links between pages, and the walk from a seed.

Nothing is fetched: a page that was not captured is met and counted, and leads nowhere. A walk is a loop of joins, one for
each level; each level is a table of its own, so a lost executor or a stopped driver costs one level.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, filters, findings, posts, reduce, responses, scan, urls
from .frontier import template_sample
from .rules import Rule

#: A response is (url, status, content_type, body, link, location); link and location are headers or null.
PAGE_MATCH = ("page", *scan.MATCH)
VERSION = 3


def _rows(df: DataFrame, page: Column, source: Column, pattern: str, value: Column, params: Column | None = None) -> DataFrame:
    return df.select(page.alias("page"), source.alias("source"), F.lit(pattern).alias("pattern"), value.alias("value"), (params if params is not None else F.lit("")).alias("params"), F.lit("info").alias("severity"), F.lit(0).cast("long").alias("ord"), F.lit(-1).alias("line_no"))


def readable(captured: DataFrame) -> DataFrame:
    """Responses that hold text, at most 64 MiB of each, marked as markup or script."""
    some = captured.where(F.col("body").isNotNull() & ~filters.binary_content_type(F.coalesce("content_type", F.lit(""))))
    kind = F.coalesce("content_type", F.lit(""))
    script = responses.script_content(kind) | scan_name_is_script(F.col("url"))
    return some.withColumns({"body": responses.capped(F.col("body")), "is_html": responses.html_content(F.col("url"), kind), "is_js": script})


def scan_name_is_script(url: Column) -> Column:
    from ..sources.artifacts import is_script

    return is_script(url)


def _links(read: DataFrame) -> DataFrame:
    page = F.col("source")
    pages = read.where("is_html")
    out = _rows(extract.page_links(pages.withColumnRenamed("body", "html")), page, page, "endpoint_url", F.col("value"))
    out = out.unionByName(_rows(extract.forms(pages.withColumnRenamed("body", "html")), page, page, "post_url", F.col("value"), F.col("params")))
    return out.unionByName(_rows(extract.link_headers(read.where("link is not null")), page, page, "endpoint_url", F.col("value")))


def inline_artifacts(read: DataFrame) -> DataFrame:
    """The inline scripts of markup as artifacts (page, source, ord, body, is_js); their source is inline.js."""
    each = read.where("is_html").select(F.col("url").alias("page"), F.posexplode(extract.inline_scripts(F.col("body"))).alias("n", "body"))
    return each.where(F.trim("body") != "").select("page", F.concat("page", F.lit("\x1f"), F.col("n").cast("string")).alias("source"), F.col("n").cast("long").alias("ord"), "body", F.lit(True).alias("is_js"))


def page_matches(captured: DataFrame, rules: list[Rule] | None = None, safe: bool = False) -> DataFrame:
    """PAGE_MATCH rows of every captured response: of markup the rules over its lines, links, forms and inline scripts with
    their endpoints; of all else the rules with endpoints; of both the Link headers."""
    read = readable(captured)
    art = read.select(F.col("url").alias("source"), F.lit(0).cast("long").alias("ord"), "body", "is_js", "is_html")
    markup = findings.scan_rules(art.where("is_html"), rules, safe) if not safe else findings.scan_rules(art.limit(0), rules, safe)
    other = findings.scan_with_endpoints(art.where("not is_html").drop("is_html"), rules, safe)
    whole = markup.select(*scan.MATCH).unionByName(other).withColumn("page", F.col("source"))
    inline = findings.scan_with_endpoints(inline_artifacts(read).drop("page"), rules, safe).withColumn("page", F.substring_index("source", "\x1f", 1)).withColumn("source", F.lit("inline.js"))
    return whole.select(*PAGE_MATCH).unionByName(inline.select(*PAGE_MATCH)).unionByName(_links(read).select(*PAGE_MATCH))


def page_posts(captured: DataFrame) -> DataFrame:
    """PAGE_MATCH rows of requests by POST only: forms, and the requests of scripts and inline scripts."""
    read = readable(captured)
    pages = read.where("is_html")
    out = _rows(extract.forms(pages.withColumnRenamed("body", "html")), F.col("source"), F.col("source"), "post_url", F.col("value"), F.col("params"))
    for art, page, source in (
        (read.where("is_js and not is_html").select(F.col("url").alias("source"), "body", "is_js"), F.col("source"), F.col("source")),
        (inline_artifacts(read).select("source", "body", "is_js"), F.substring_index("source", "\x1f", 1), F.lit("inline.js")),
    ):
        found = posts.scan_posts(art).select(page.alias("page"), source.alias("source"), "pattern", "value", "params", "severity", F.lit(0).cast("long").alias("ord"), F.lit(-1).alias("line_no"))
        out = out.unionByName(found.distinct())
    return out.select(*PAGE_MATCH)


def script_edges(captured: DataFrame, host: str, external: bool = False) -> DataFrame:
    """(page, url): scripts that markup loads and modules that scripts import, in the scope of a host or all."""
    read = readable(captured)
    based = read.where("is_html").withColumn("base", extract.document_base(F.col("body"), F.col("url")))
    each = based.select(F.col("url").alias("page"), "base", F.explode(extract.script_sources(F.col("body"))).alias("src"))
    loads = urls.resolved(each, "base", "src", "url").select("page", "url")
    loads = loads if external else loads.where(filters.same_scope(F.lit(host), urls.host(F.col("url"))))
    imports = findings.imports_in_scope(read.where("is_js and not is_html"), host, external=external)
    return loads.union(imports.select(F.col("url").alias("page"), F.col("value").alias("url"))).distinct()


@dataclass(frozen=True)
class Options:
    """depth -1: no limit of depth. pages: the page budget. sample: pages of a template, 0 for all."""

    depth: int = 2
    pages: int = 200
    sample: int = 3
    same_host: bool = True


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def saved_levels(spark: SparkSession, store: str, seed: str) -> int:
    """How many whole levels a store holds for this seed; 0 for another seed. Another version is an error."""
    if not _exists(spark, f"{store}/meta/_SUCCESS"):
        return 0
    version, known = spark.read.parquet(f"{store}/meta").first()
    if version != VERSION:
        raise ValueError(f"a store of version {version}, not {VERSION}")
    n = 0
    while known == seed and _exists(spark, f"{store}/level={n}/_SUCCESS"):
        n += 1
    return n


def walk(spark: SparkSession, edges: DataFrame, seed: str, store: str, options: Options = Options()) -> DataFrame:
    """(url, depth, score, place) of the pages that a crawl of this seed admits, over links (page, url), level by level.

    Of a level the pages not met before are taken, the first `sample` of each template over all levels, best score first,
    until the budget is spent. Levels that the store holds whole are not walked again.
    """
    seed = seed.split("#")[0]
    done = saved_levels(spark, store, seed)
    if not done:
        spark.createDataFrame([(VERSION, seed)], "version int, seed string").write.mode("overwrite").parquet(f"{store}/meta")
        first = spark.createDataFrame([(seed,)], "url string").select("url", urls.template_key(F.col("url")).alias("template"), F.lit(0).alias("depth"), urls.target_score(F.col("url")).alias("score"), F.lit(1).cast("long").alias("place"))
        first.write.mode("overwrite").parquet(f"{store}/level=0")
        done = 1
    level = lambda d: spark.read.parquet(f"{store}/level={d}")
    seen = level(0)
    for d in range(1, done):
        seen = seen.unionByName(level(d))
    depth, admitted = done - 1, seen.count()
    while admitted < options.pages and (options.depth < 0 or depth < options.depth):
        depth += 1
        links = edges.join(level(depth - 1).select(F.col("url").alias("page")), "page").select("url").distinct()
        if options.same_host:
            links = links.where(filters.same_scope(urls.host(F.lit(seed)), urls.host(F.col("url"))))
        new = links.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), urls.target_score(F.col("url")).alias("score"))
        order = [F.col("score").desc(), "url"]
        new = template_sample(new, order, options.sample) if options.sample else new.withColumns({"template": urls.template_key(F.col("url")), "rank": F.lit(1)})
        if options.sample:
            had = seen.groupBy("template").agg(F.count("*").alias("had"))
            new = new.join(had, "template", "left").where(F.col("rank") + F.coalesce("had", F.lit(0)) <= options.sample)
        # the budget bounds what is left, so its places are given in one task
        taken = new.orderBy(*order).limit(options.pages - admitted)
        placed = reduce.first_per_class(taken.withColumn("one", F.lit(1)).drop("rank"), ["one"], order, options.pages)
        placed.select("url", "template", "depth", "score", (F.col("rank") + admitted).cast("long").alias("place")).write.mode("overwrite").parquet(f"{store}/level={depth}")
        n = level(depth).count()
        if not n:
            break
        seen, admitted = seen.unionByName(level(depth)), admitted + n
    return seen.select("url", "depth", "score", "place")


def removed(spark: SparkSession, store: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crawl_findings(admitted: DataFrame, matches: DataFrame) -> DataFrame:
    """The findings of admitted pages, unique, with the strongest severity of each value."""
    kept = matches.join(admitted.select(F.col("url").alias("page"), "place"), "page").withColumn("ord", F.col("place"))
    return reduce.keep_top_severity(reduce.unique(kept.select(*scan.MATCH)))


def counters(admitted: DataFrame, captured: DataFrame, edges: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of a crawl's counts: pages admitted, captured, missing and failed (no 2xx or 3xx status), links of admitted
    pages with repeats, and findings."""
    met = admitted.select("url").join(captured.select("url", "status"), "url", "left")
    ok = F.col("status").between(200, 399)
    pages = met.agg(F.count("*").alias("enqueued"), F.count("status").alias("fetched"), F.count_if(F.col("status").isNull()).alias("missing"), F.count_if(F.col("status").isNotNull() & ~ok).alias("failed"))
    links = edges.join(admitted.select(F.col("url").alias("page")), "page").agg(F.count("*").alias("targets"))
    return pages.join(links).join(matches.agg(F.count("*").alias("matches")))  # three rows of one value each


def hints_of(targets: DataFrame, hints: DataFrame) -> DataFrame:
    """(url, kind, name, provenance): the hints (scope, kind, name, provenance) of each target's host, www. and case aside."""
    plain = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    keyed = hints.select(plain(F.col("scope")).alias("h"), "kind", "name", "provenance")
    return targets.select("url", plain(urls.host(F.col("url"))).alias("h")).join(keyed, "h").drop("h")


def rendered_matches(states: DataFrame, requests: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """PAGE_MATCH rows of captured browser states (page_url, state_no, html) and requests (page_url, method, url, body).

    States of equal structure count once a page. Requests by POST are post_url with their body, others endpoint_url.
    """
    from .verdicts import structural_cap

    once = structural_cap(states, "page_url", "html", "state_no", 1)
    shown = once.select(F.col("page_url").alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("location"))
    page, sent = F.col("page_url"), requests.where(F.upper("method") == "POST")
    out = page_matches(shown, rules).unionByName(_rows(sent, page, page, "post_url", F.col("url"), F.coalesce("body", F.lit(""))))
    return out.unionByName(_rows(requests.where(F.upper("method") != "POST"), page, page, "endpoint_url", F.col("url"))).distinct()
