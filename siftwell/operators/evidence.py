"""Evidence about captured flows and archived addresses: what a value points at, where code ran, what to look at next."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters, urls
from .reduce import first_per_class, fingerprint
from .scripts import valid_hint_name

#: Limits of archived addresses, and extensions of documents and of other files.
LONGEST_URL, LONGEST_PATH, MOST_SEGMENTS = 4096, 2048, 64
DOCUMENTS = ("html", "htm", "xhtml", "php", "asp", "aspx", "jsp", "do", "action")
FILES = (
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "json", "map", "css", "xml", "txt", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico",
    "woff", "woff2", "ttf", "eot", "pdf", "zip", "gz", "tar", "mp3", "mp4", "webm", "wasm",
)


def passive_candidates(hits: DataFrame, seed: str, most: int = 100) -> DataFrame:
    """(url, provider, names, score) of archived addresses (provider, raw_url, seq) of the seed's host, moved to the
    seed's origin without their query, best first: by score, length of the path, and address."""
    s = F.lit(seed)
    raw = F.btrim("raw_url")
    bare = lambda h: F.regexp_replace(h, r"\.$", "")
    p = urls.path(raw)
    parts = F.split(F.btrim(p, F.lit("/")), "/")
    fits = (
        (F.octet_length(raw) <= LONGEST_URL) & urls.scheme(raw).isin("http", "https") & (bare(urls.host(raw)) == bare(urls.host(s))) & (p != "") & (p != "/")
        & (F.octet_length(p) <= LONGEST_PATH) & ~p.contains("\\") & ~p.rlike(r"\p{Cntrl}") & (F.size(parts) <= MOST_SEGMENTS)
        & ~F.exists(parts, lambda x: F.regexp_replace(x, "(?i)%2e", ".").isin(".", "..")) & filters.crawlable(p)
    )
    names = F.filter(F.transform(F.split(urls.query(raw), "&"), lambda x: F.substring_index(x, "=", 1)), valid_hint_name)
    live = F.concat(F.regexp_replace(urls.origin(s), "//[^@/]*@", "//"), p)
    kept = hits.where(fits).select(live.alias("url"), "provider", "seq", F.array_sort(F.array_distinct(names)).alias("names"))
    once = first_per_class(kept, ["url"], ["seq", "provider"], 1).select("url", "provider", "names", urls.target_score(F.col("url")).alias("score"))
    return once.orderBy(F.col("score").desc(), F.octet_length(urls.path(F.col("url"))), "url").limit(most)


def document_seeds(matches: DataFrame, seed: str, external: bool = False, most: int = 50) -> DataFrame:
    """(url) of matched addresses in scope that look like documents, in order of appearance."""
    s = F.lit(seed)
    found = matches.where(F.col("pattern").isin("gathered_url", "endpoint_url", "endpoint_path")).where(F.btrim("value") != "")
    each = found.select("ord", urls.resolve(s, F.col("value")).alias("url"))
    each = each.select("ord", F.when(urls.path(F.col("url")) == "", F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("url"))
    ext = F.substring(urls.extension(urls.path(F.col("url"))), 2, 20)
    document = ~urls.path(F.col("url")).rlike(urls.API_PATH) & ~ext.isin(*FILES)
    scope = F.lit(True) if external else filters.same_scope(urls.host(s), urls.host(F.col("url")))
    kept = each.where(urls.scheme(F.col("url")).isin("http", "https") & document & scope & (F.col("url") != s))
    return kept.groupBy("url").agg(F.min("ord").alias("ord")).orderBy("ord", "url").limit(most).select("url")


def url_evidence(value: Column, page: Column, marker: Column) -> Column:
    """What a navigated value is: its kind, scheme and origin, whether it runs, and the part that holds the marker."""
    v = F.btrim(value)
    kind = (
        F.when(v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "absolute").when(v.startswith("//"), "protocol_relative").when(v.startswith("/"), "root_relative")
        .when(v.startswith("?"), "query_relative").when(v.startswith("#"), "fragment_relative").otherwise("path_relative")
    )
    full = F.when(v.startswith("#"), F.concat(urls.without_fragment(page), v)).otherwise(urls.resolve(page, v))
    web = urls.scheme(full).isin("http", "https")
    runs = urls.scheme(full).isin("javascript", "vbscript") | v.rlike(r"(?i)^data\s*:\s*text/(?:html|javascript)")
    where = (
        F.when(F.contains(urls.scheme(full), marker), "scheme").when(web & F.contains(F.regexp_extract(urls.authority(full), "^([^@]*)@", 1), marker), "credentials")
        .when(web & F.contains(urls.authority(full), marker), "authority").when(web & F.contains(urls.path(full), marker), "path")
        .when(web & F.contains(urls.query(full), marker), "query").when(F.contains(F.regexp_extract(v, "#(.*)$", 1), marker), "fragment").when(F.contains(v, marker), "opaque").otherwise("")
    )
    return F.struct(kind.alias("kind"), urls.scheme(full).alias("scheme"), F.coalesce(runs, F.lit(False)).alias("executable"), (web & (urls.origin(full) == urls.origin(page))).alias("same_origin"), where.alias("component"))


def stack_frames(stack: Column, most: int = 8) -> Column:
    """(function, url, line, column) of the web frames of a stack, the innermost first."""
    at = F.transform(F.split(stack, "\n"), lambda x: F.regexp_replace(F.btrim(x), "^at ", ""))
    place = r"^(?:(.*?)\s+\()?((?:https?)://.*):(\d+):(\d+)\)?$"
    one = lambda x: F.struct(F.regexp_extract(x, place, 1).alias("function"), F.regexp_extract(x, place, 2).alias("url"), F.regexp_extract(x, place, 3).cast("int").alias("line"), F.regexp_extract(x, place, 4).cast("int").alias("column"))
    return F.slice(F.transform(F.filter(at, lambda x: x.rlike(place)), one), F.lit(1), F.lit(most))


def flow_triage(context: Column, confirmed: Column, url: Column) -> Column:
    """confirmed, worth_review or likely_benign; url is (resolved, executable, same_origin)."""
    navigates = F.when(~F.coalesce(url["resolved"], F.lit(False)) | url["executable"] | ~url["same_origin"], "worth_review").otherwise("likely_benign")
    return F.when(confirmed, "confirmed").when(context == "url", navigates).otherwise("worth_review")


def flow_identity(kind: Column, origin: Column, page: Column, script: Column, source: Column, sink: Column, context: Column) -> Column:
    """The fingerprint of a flow: the page counts only where no script location is known."""
    return fingerprint(kind, origin, F.when(script == "", page).otherwise(""), source, sink, context, script)
