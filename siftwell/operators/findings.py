"""Findings of whole artifacts: rules, rebuilt values, endpoints and requests together, their filters, and what to crawl."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, filters, frontier, headers, literals, reduce, urls
from .rules import Rule, default_rules
from .scan import MATCH, scan

#: Patterns by use.
GATHERED = "gathered_url"
REQUESTS = ("post_url", "post_path")
WITH_BODY = (*REQUESTS, "put_url", "put_path", "patch_url", "patch_path")
FOLLOWED = ("endpoint_url", "endpoint_path", *REQUESTS, "path")
BLANK = " \t\n\r\f\x0b"


def looks_like_json(body: Column) -> Column:
    return F.ltrim(body, F.lit(BLANK)).rlike(r"^[{\[]")


def _valid(pattern: Column, value: Column) -> Column:
    return F.when(pattern == "endpoint_url", filters.endpoint_url(value)).otherwise(filters.endpoint_path(value))


def endpoint_matches(artifacts: DataFrame, body: str = "body") -> DataFrame:
    """MATCH rows of the valid endpoints of scripts and JSON bodies, distinct in an artifact."""
    some = artifacts.where(F.col("is_js") | looks_like_json(F.col(body)))
    each = some.select("source", "ord", F.explode(extract.endpoints(F.col(body))).alias("raw"))
    pattern = F.when(extract.is_absolute(F.col("raw")), "endpoint_url").otherwise("endpoint_path")
    out = each.select("source", pattern.alias("pattern"), F.btrim("raw", F.lit(BLANK)).alias("value"), F.lit("").alias("params"), F.lit("info").alias("severity"), "ord", F.lit(-1).alias("line_no"))
    return out.where(_valid(F.col("pattern"), F.col("value"))).distinct()


def scan_rules(artifacts: DataFrame, rules: list[Rule] | None = None, safe: bool = False, body: str = "body") -> DataFrame:
    """The rules and http_header over the lines of artifacts; in safe mode only scripts, and only rules made for them."""
    rules = default_rules() if rules is None else rules
    some = artifacts.where("is_js") if safe else artifacts
    chosen = [r for r in rules if r.script] if safe else rules
    return scan(some, chosen, body).unionByName(headers.scan_headers(some, body))


def scan_with_endpoints(artifacts: DataFrame, rules: list[Rule] | None = None, safe: bool = False, body: str = "body") -> DataFrame:
    """All findings of artifacts (source, ord, body, is_js), as MATCH rows: rules over lines; for scripts also over rebuilt
    values, one of equal ones in an artifact; and the endpoints of scripts and JSON bodies."""
    rules = default_rules() if rules is None else rules
    chosen = [r for r in rules if r.script] if safe else rules
    js = artifacts.where("is_js")
    plain = scan_rules(artifacts.where(~F.col("is_js")), rules, safe, body)
    both = scan_rules(js, rules, safe, body).unionByName(literals.scan_values(js, chosen, True, body).withColumn("line_no", F.lit((1 << 31) - 1)))
    keys = ["source", "ord", "pattern", "value", "params"]
    once = both.groupBy(*keys).agg(F.min(F.struct("line_no", "severity")).alias("o")).select(*keys, "o.severity", "o.line_no").select(*MATCH)
    return plain.select(*MATCH).unionByName(once).unionByName(endpoint_matches(artifacts, body).select(*MATCH))


def only_endpoints(matches: DataFrame) -> DataFrame:
    """Valid endpoints, one of each (pattern, value) with its white space gone, the first by ord and line."""
    some = matches.where(F.col("pattern").startswith("endpoint_")).withColumn("value", F.btrim("value", F.lit(BLANK)))
    return _first(some.where(_valid(F.col("pattern"), F.col("value"))), ["pattern", "value"])


def only_requests(matches: DataFrame) -> DataFrame:
    """Requests and gathered addresses, one of each (pattern, value, params)."""
    return _first(matches.where(F.col("pattern").isin(*REQUESTS, GATHERED)), ["pattern", "value", "params"])


def only_gathered(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("pattern") == GATHERED)


def _first(matches: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in matches.columns if c not in keys]
    order = F.struct("ord", "line_no", *[c for c in rest if c not in ("ord", "line_no")])
    return matches.groupBy(*keys).agg(F.min(order).alias("o")).select(*[F.col(c) if c in keys else F.col(f"o.{c}") for c in matches.columns])


def request_params(matches: DataFrame) -> DataFrame:
    """(source, params): distinct parameters of requests with a body."""
    p = F.btrim("params", F.lit(BLANK))
    return matches.where(F.col("pattern").isin(*WITH_BODY)).select("source", p.alias("params")).where("params <> ''").distinct()


def base_of(source: Column, page: Column) -> Column:
    """What a finding's relative address is resolved against: its script if that is an address, else the page."""
    return F.when(urls.scheme(source).isin("http", "https") & (urls.authority(source) != ""), source).otherwise(page)


def crawl_targets(matches: DataFrame, page: str = "page", same_host: bool = True) -> DataFrame:
    """(page, url): distinct addresses that findings (page, source, pattern, value) lead to: web ones, in the page's scope, no
    assets, and no members of a bundle's module table."""
    some = matches.where(F.col("pattern").isin(*FOLLOWED)).withColumn("raw", F.btrim("value", F.lit(BLANK))).where("raw <> ''")
    tables = frontier.suppressed_contexts(some.where(F.col("pattern").isin("endpoint_path", "post_path", "path") & (F.col("source") != "") & ~F.col("raw").rlike("[?#]")).select("source", F.col("raw").alias("value")))
    some = some.join(tables.withColumnRenamed("value", "raw"), ["source", "raw"], "left_anti")
    # one resolution for each distinct pair of base and reference
    pairs = some.select(F.col(page).alias("page"), base_of(F.col("source"), F.col(page)).alias("base"), "raw").distinct()
    out = pairs.withColumn("url", urls.without_fragment(urls.resolve(F.col("base"), F.col("raw")))).where(urls.scheme(F.col("url")).isin("http", "https"))
    if same_host:
        out = out.where(filters.same_scope(urls.host(F.col("page")), urls.host(F.col("url"))))
    return out.where(filters.crawlable(urls.path(F.col("url")))).select("page", "url").distinct()


def imports_in_scope(scripts: DataFrame, host: str, url: str = "url", body: str = "body", external: bool = False) -> DataFrame:
    """(url, value): imports of scripts, resolved; web ones in the scope of a host, or all."""
    each = scripts.select(F.col(url).alias("url"), F.explode(extract.imports(F.col(body))).alias("raw"))
    out = each.select("url", urls.resolve(F.col("url"), F.col("raw")).alias("value")).where(urls.scheme(F.col("value")).isin("http", "https"))
    return out if external else out.where(filters.same_scope(F.lit(host), urls.host(F.col("value"))))


def ranked_unique(matches: DataFrame) -> DataFrame:
    return reduce.ranked(reduce.keep_top_severity(reduce.unique(matches)))
