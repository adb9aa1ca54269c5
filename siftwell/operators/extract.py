"""Endpoints, links, requests and documents about a site, from bodies and headers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters, urls

#: What marks an address in markup and scripts.
ATTRIBUTE = r"""(?is)\b(?:href|src|action|formaction|data-url|data-href|data-src)\s*=\s*["']([^"'>\s]+)["']"""
SRCSET = r"""(?is)\bsrcset\s*=\s*["']([^"']+)["']"""
CSS_URL = r"""(?is)url\(\s*["']?([^)'"\s]+)["']?\s*\)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""
SCRIPT_SRC = r"""(?is)<script[^>]+src=["']([^"']+)['"]"""
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
IMPORT = r"""(?m)import\s+(?:[^"']+\s+from\s+)?['"]([^'"\n]+)['"]"""
DYNAMIC_IMPORT = r"""(?m)import\(\s*['"]([^'"\n]+)['"]\s*\)"""
QUOTED = "(?i)[\"'`](?:\\$\\{[^}]+\\})*((?:(?:https?|wss?):)?//[^\"'`\\s]+|\\.?\\.?/[^\"'`\\s]+)[\"'`]"
BARE = "(?i)(?:\\bfetch|\\baxios(?:\\.\\w+)?|\\$\\.(?:ajax|get|post)|\\.(?:get|post|put|patch|delete|open|request|ajax))\\s*\\(\\s*[\"'`]([a-z0-9_][a-z0-9_.-]*(?:/[a-z0-9_.-]+)+)(?:[?#][^\"'`]*)?[\"'`]"
SOCKET = "(?i)(?:new\\s+)?(?:WebSocket|EventSource)\\s*\\(\\s*[\"'`]((?:\\$\\{[^}]+\\})*[^\"'`\\s]+)[\"'`]"
NOT_NAVIGATED = ("javascript:", "mailto:", "tel:", "data:", "blob:", "about:", "sms:", "callto:")
ASSET_RELS = ("stylesheet", "icon", "shortcut", "apple-touch-icon", "mask-icon", "manifest", "preload", "prefetch", "dns-prefetch", "preconnect", "modulepreload", "prerender", "pingback", "self", "canonical")
FORM = r"(?is)<form\b[^>]*>.*?</form>"
FIELD = r"""(?is)<(?:input|select|textarea|button)\b[^>]*?\bname\s*=\s*["']([^"']+)["']"""


def all_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def entities(text: Column) -> Column:
    """Six entities, the ampersand last."""
    out = text
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(c))
    return out


def document_base(html: Column, page: Column) -> Column:
    href = entities(F.btrim(F.regexp_extract(html, BASE, 1)))
    resolved = urls.resolve(page, href)
    return F.when((href != "") & ~filters.template_placeholder(href) & urls.scheme(resolved).isin("http", "https"), resolved).otherwise(page)


def srcset(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda v: F.regexp_extract(v, r"^\s*(\S+)", 1)), lambda v: v != "")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, value): distinct absolute links of each page."""
    lower, none = F.lower(F.col(html)), F.array().cast("array<string>")
    based = F.contains(lower, F.lit("<base"))
    body = F.when(based, F.regexp_replace(F.col(html), r"(?is)<base\b[^>]*>", " ")).otherwise(F.col(html))
    sets = F.when(F.contains(lower, F.lit("srcset")), F.flatten(F.transform(all_of(body, SRCSET), srcset))).otherwise(none)
    styles = F.when(F.contains(lower, F.lit("url(")), all_of(body, CSS_URL)).otherwise(none)
    raw = F.array_distinct(F.transform(F.concat(all_of(body, ATTRIBUTE), sets, styles), lambda x: entities(F.btrim(x))))
    base = F.when(based, document_base(F.col(html), F.col(url))).otherwise(F.col(url))
    # the page is read before the links are dealt out, so it does not travel with each of them
    read = pages.select(F.col(url).alias("source"), base.alias("base"), raw.alias("refs"))
    each = read.select("source", "base", F.explode("refs").alias("ref"))
    ref = F.col("ref")
    skip = (ref == "") | ref.startswith("#") | filters.template_placeholder(ref)
    for s in NOT_NAVIGATED:
        skip = skip | F.lower(ref).startswith(s)
    out = urls.resolved(each.where(~skip), "base", "ref", "value").select("source", "value")
    return out.where(urls.scheme(F.col("value")).isin("http", "https") & (urls.authority(F.col("value")) != "")).distinct()


def inline_scripts(html: Column) -> Column:
    return all_of(html, SCRIPT)


def script_sources(html: Column) -> Column:
    return all_of(html, SCRIPT_SRC)


def imports(script: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(all_of(script, IMPORT), all_of(script, DYNAMIC_IMPORT))))


def endpoints(body: Column) -> Column:
    """Distinct endpoints of a script in order, cut before an interpolation."""
    raw = F.concat(all_of(body, QUOTED), all_of(body, BARE), all_of(body, SOCKET))
    return F.array_distinct(F.filter(F.transform(raw, lambda v: F.substring_index(v, "${", 1)), lambda v: v != ""))


def is_absolute(value: Column) -> Column:
    return value.rlike("^(?:https?:|wss?:)?//")


def forms(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, value, params) of forms sent by POST: where they go, and their distinct fields as name=&name=."""
    each = pages.select(F.col(url).alias("source"), F.explode(all_of(F.col(html), FORM, 0)).alias("form"))
    tag = F.regexp_extract("form", r"(?is)^<form\b([^>]*)>", 1)
    attribute = lambda name: entities(F.btrim(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1)))
    fields = F.array_join(F.transform(F.array_distinct(all_of(F.col("form"), FIELD)), lambda n: F.concat(n, F.lit("="))), "&")
    where = F.when(attribute("action") == "", F.col("source")).otherwise(urls.resolve(F.col("source"), attribute("action")))
    return each.where(F.lower(attribute("method")) == "post").select("source", where.alias("value"), fields.alias("params")).distinct()


def link_headers(rows: DataFrame, url: str = "url", header: str = "link") -> DataFrame:
    """(source, value): navigable targets of Link headers."""
    entry = r"<([^>]+)>((?:\s*;\s*[^;,]+)*)"
    each = rows.select(F.col(url).alias("source"), F.explode(all_of(F.col(header), entry, 0)).alias("e"))
    ref, params = F.btrim(F.regexp_extract("e", entry, 1)), F.regexp_extract("e", entry, 2)
    rel = F.lower(F.btrim(F.concat(F.regexp_extract(params, r'(?i)\brel\s*=\s*"([^"]*)"', 1), F.regexp_extract(params, r'(?i)\brel\s*=\s*([^";,\s]+)', 1))))
    open_ = (rel == "") | F.exists(F.split(rel, r"\s+"), lambda x: ~x.isin(*ASSET_RELS))
    out = each.where((ref != "") & ~filters.template_placeholder(ref) & open_).select("source", urls.resolve(F.col("source"), ref).alias("value"))
    return out.where(urls.scheme(F.col("value")).isin("http", "https")).distinct()


def source_map_reference(body: Column, header: Column) -> Column:
    last = F.try_element_at(all_of(body, r"""sourceMappingURL=([^\s'"]+)"""), F.lit(-1))
    return F.coalesce(F.nullif(F.btrim(header), F.lit("")), F.btrim(F.regexp_replace(last, r"\*/$", "")))


def source_map_files(maps: DataFrame, raw: str = "raw", most: int = 5000) -> DataFrame:
    """(path, content) of at most `most` sources that a source map embeds."""
    parsed = F.from_json(F.col(raw), "version int, sources array<string>, sourcesContent array<string>, sourceRoot string")
    each = maps.select(parsed.alias("m")).select("m.sourceRoot", F.posexplode(F.slice(F.arrays_zip("m.sources", "m.sourcesContent"), F.lit(1), F.lit(most))).alias("i", "s"))
    root = F.coalesce("sourceRoot", F.lit(""))
    name = F.when((root != "") & ~F.col("s.sources").rlike("^(?:[a-z]+:)?/"), F.concat(F.regexp_replace(root, "/$", ""), F.lit("/"), F.col("s.sources"))).otherwise(F.col("s.sources"))
    return each.where("s.sourcesContent is not null").select(name.alias("path"), F.col("s.sourcesContent").alias("content"))


def data_uri(uri: Column) -> Column:
    """The text of a data URI: base64, or percent-encoded with plus signs as they are."""
    body = F.regexp_extract(uri, r"(?s)^data:[^,]*,(.*)$", 1)
    plain = F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    coded = F.unbase64(F.regexp_replace(body, "=+$", "")).cast("string")
    return F.when(F.regexp_extract(uri, "^data:([^,]*),", 1).rlike("(?i);base64$"), coded).otherwise(plain)


def robots(rows: DataFrame, site: str = "origin", body: str = "body") -> DataFrame:
    """(origin, kind, value): directories, sitemaps, and the longest crawl delay of the * group, at most 30 seconds."""
    from pyspark.sql.window import Window

    each = rows.select(F.col(site).alias("origin"), F.posexplode(F.split(F.col(body), "\n")).alias("n", "raw"))
    each = each.withColumn("line", F.btrim(F.col("raw"), F.lit(" \t\r"))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    pick = lambda p: F.regexp_extract("line", p, 1)
    agent = F.nullif(pick(r"(?i)^user-agent\s*:\s*(\S+)"), F.lit(""))
    group = F.coalesce(F.last(agent, ignorenulls=True).over(Window.partitionBy("origin").orderBy("n")), F.lit("*"))
    each = each.withColumns({"group": group, "map": pick(r"(?i)^sitemap\s*:\s*(\S+)"), "delay": pick(r"(?i)^crawl-delay\s*:\s*([0-9]*\.?[0-9]+)"), "dir": F.regexp_replace(pick(r"(?i)^(?:dis)?allow\s*:\s*(\S+)"), "[*$].*$", "")})
    dirs = each.where((F.col("dir") != "/") & F.col("dir").startswith("/")).select("origin", F.lit("dir").alias("kind"), F.concat("origin", "dir").alias("value"))
    maps = each.where("map <> ''").select("origin", F.lit("sitemap").alias("kind"), F.col("map").alias("value"))
    delay = each.where("delay <> '' and group = '*'").groupBy("origin").agg(F.least(F.max(F.col("delay").cast("double")), F.lit(30.0)).alias("d"))
    return dirs.union(maps).distinct().union(delay.select("origin", F.lit("delay").alias("kind"), F.col("d").cast("string").alias("value")))


def sitemap_locations(body: Column) -> Column:
    return F.transform(all_of(body, r"(?is)<loc>\s*(.*?)\s*</loc>"), entities)


def is_graphql(url: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(urls.path(url)), "/"), F.array(F.lit("graphql"), F.lit("graphiql"), F.lit("graphql-api")))


def graphql_summary(body: Column) -> Column:
    """What an introspection response says: the number of own types and the names of the roots; null if nothing."""
    name = "struct<name:string>"
    parsed = F.from_json(body, f"data struct<__schema:struct<queryType:{name},mutationType:{name},subscriptionType:{name},types:array<struct<name:string,kind:string>>>>")
    s = parsed["data"]["__schema"]
    own = F.size(F.filter(F.coalesce(s["types"], F.array().cast("array<struct<name:string,kind:string>>")), lambda t: ~t["name"].startswith("__")))
    root = lambda label, field: F.when(s[field]["name"] != "", F.concat(F.lit(f"{label}="), s[field]["name"]))
    text = F.concat_ws(" ", F.lit("introspection=enabled"), F.concat(F.lit("types="), own), root("query", "queryType"), root("mutation", "mutationType"), root("subscription", "subscriptionType"))
    return F.when(s["queryType"].isNotNull() | s["mutationType"].isNotNull() | (F.size(s["types"]) > 0), text)
