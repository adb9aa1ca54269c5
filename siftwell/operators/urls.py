"""URLs: parts, resolution, scope, template keys, levels and scores, all as Column functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Extensions by yield, and path words of an interface.
RICH = ("js", "mjs", "cjs", "jsx", "ts", "tsx", "json", "map", "xml", "yaml", "yml", "env", "txt", "config", "ini", "properties")
PAGES = ("html", "htm", "xhtml", "shtml", "php", "asp", "aspx", "jsp", "jspx", "do", "action", "cfm")
API_PATH = r"(?i)(?:^|/)(?:api|graphql|graphiql|gql|rest|rpc|v[0-9]+|oauth2?|auth|token|gateway|internal|admin|config|settings|swagger|openapi|actuator|debug)(?:/|$|\.)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^[^@]*@", ""), r":[0-9]*$", ""))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_dots(p: Column) -> Column:
    """RFC 3986 removal of dot segments from an absolute path."""
    return let(F.split(F.regexp_replace(p, "^/", ""), "/"), lambda x: let(_without_dots(x), lambda kept: _path(kept, F.element_at(x, -1))))


def _without_dots(segments: Column) -> Column:
    none = F.array().cast("array<string>")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.aggregate(segments, none, lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))


def _path(kept: Column, last: Column) -> Column:
    closing = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closing)


def parts(url: Column) -> Column:
    """All parts at once, and the query with its question mark where there is one."""
    u = without_fragment(url)
    mark = F.when(F.instr(u, "?") > 0, F.concat(F.lit("?"), query(u))).otherwise(F.lit(""))
    return F.struct(u.alias("all"), scheme(u).alias("scheme"), authority(u).alias("authority"), path(u).alias("path"), mark.alias("search"))


def resolve(base: Column, ref: Column) -> Column:
    """The reference against the base, without its fragment."""
    return let(parts(base), lambda b: let(parts(F.btrim(ref)), lambda r: _resolved(b, r)))


def _resolved(b: Column, r: Column) -> Column:
    site = F.concat(b["scheme"], F.lit("://"), b["authority"])
    folder = F.regexp_replace(F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), "[^/]*$", "")
    full = F.when(r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))
    return (
        F.when(r["scheme"] != "", r["all"])
        .when(r["all"].startswith("//"), F.concat(b["scheme"], F.lit(":"), r["all"]))
        .when(r["path"] == "", F.concat(site, b["path"], F.when(r["search"] != "", r["search"]).otherwise(b["search"])))
        .otherwise(F.concat(site, F.when(full.contains("/."), without_dots(full)).otherwise(full), r["search"]))
    )


def resolved(df: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """df with the column out, the reference against the base as resolve() has it, by plain columns that Spark compiles: for
    many rows. Dot segments are looked at only where there are some."""
    b, r = without_fragment(F.col(base)), without_fragment(F.btrim(F.col(ref)))
    names = {"__bs": scheme(b), "__ba": authority(b), "__bp": path(b), "__r": r}
    d = df.withColumns(names).withColumns({"__rs": scheme(F.col("__r")), "__rp": path(F.col("__r"))})
    site, search = F.concat("__bs", F.lit("://"), "__ba"), F.regexp_extract(F.col("__r"), r"^[^?]*(\?.*)$", 1)
    folder = F.regexp_replace(F.when(F.col("__bp") == "", F.lit("/")).otherwise(F.col("__bp")), "[^/]*$", "")
    d = d.withColumn("__full", F.when(F.col("__rp").startswith("/"), F.col("__rp")).otherwise(F.concat(folder, "__rp")))
    value = (
        F.when(F.col("__rs") != "", F.col("__r")).when(F.col("__r").startswith("//"), F.concat("__bs", F.lit(":"), "__r"))
        .when(F.col("__rp") == "", F.concat(site, F.col("__bp"), F.when(search != "", search).otherwise(F.regexp_extract(b, r"^[^?]*(\?.*)$", 1))))
        .otherwise(F.concat(site, F.when(F.col("__full").contains("/."), without_dots(F.col("__full"))).otherwise(F.col("__full")), search))
    )
    return d.withColumn(out, value).drop("__bs", "__ba", "__bp", "__r", "__rs", "__rp", "__full")


#: Segments that are data: digits, an UUID, a date, eight hexadecimal digits and more.
DATA = (r"^\d+\z", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", r"^\d{4}([-/]\d{1,2}){0,2}\z", r"(?i)^[0-9a-f]{8,}\z")


def variable_segment(s: Column) -> Column:
    """Data, or twelve bytes and more with a digit."""
    out = (F.octet_length(s) >= 12) & s.rlike("[0-9]")
    for p in DATA:
        out = out | s.rlike(p)
    return out


def template_key(url: Column) -> Column:
    """Host and path with {} for data, and the sorted names of the query."""
    parts = F.transform(F.split(path(url), "/"), lambda s: F.when(variable_segment(s), F.lit("{}")).otherwise(s))
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query(url), "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))))
    return F.concat(authority(url), F.array_join(parts, "/"), F.when(query(url) != "", F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))


def extension(p: Column) -> Column:
    return F.regexp_extract(F.lower(F.substring_index(p, "/", -1)), r"(\.[^.]*)\z", 1)


def target_score(url: Column) -> Column:
    """How much a fetch of the address is likely to yield."""
    return let(F.lower(path(url)), lambda p: let(extension(p), lambda ext: _score(p, ext)))


def _score(p: Column, ext: Column) -> Column:
    rich, page = (["." + x for x in names] for names in (RICH, PAGES))
    return F.when(ext.isin(*rich), 100).when(p.rlike(API_PATH), 90).when(ext == "", 70).when(ext.isin(*page), 40).otherwise(50)


def level(url: Column) -> Column:
    """The directory of a path, with the closing slash."""
    p = path(url)
    return F.when(p == "", F.lit("/")).otherwise(F.regexp_replace(p, "[^/]*$", ""))


def levels(url: Column) -> Column:
    """The level and all above it, up to the root."""

    def of(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: F.when(i == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/"), F.lit("/"))))

    return let(F.filter(F.split(level(url), "/"), lambda x: x != ""), of)


#: First segments that are likely mounts, beside v and a number.
MOUNTS = (
    "api", "rest", "rpc", "legacy", "old", "public", "private", "static", "assets", "asset", "scripts", "script", "js", "src", "dist", "build",
    "app", "web",
)
VARIANT = "struct<path:string,query:string,trimmed:int,mount:boolean>"


def _plain(segment: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)


def likely_mount(segment: Column) -> Column:
    return let(F.lower(_plain(segment)), lambda s: s.isin(*MOUNTS) | s.rlike("^v[0-9]+\\z"))


def path_variants(url: Column) -> Column:
    """Of an address, as VARIANT: its path, the path after a likely mount, its last two segments, and for files and interfaces
    its last one; a closing slash and the query stay. Of equal ones the first counts."""
    p = F.regexp_replace(path(url), "^/", "")

    def of(segments: Column) -> Column:
        n, end = F.size(segments), F.when(p.endswith("/"), "/").otherwise("")
        tail = lambda k: F.concat(F.array_join(F.slice(segments, F.greatest(n - k + 1, F.lit(1)), k), "/"), end)
        one = lambda text, trimmed, mount: F.struct(text.alias("path"), query(url).alias("query"), trimmed.cast("int").alias("trimmed"), F.lit(mount).alias("mount"))
        made = F.array(
            one(p, F.lit(0), False),
            F.when((n > 1) & likely_mount(F.get(segments, F.lit(0))), one(tail(n - 1), F.lit(1), True)),
            F.when(n > 2, one(tail(F.lit(2)), n - 2, False)),
            F.when((n > 1) & target_score(url).isin(100, 90), one(tail(F.lit(1)), n - 1, False)),
        )
        some = F.filter(made, lambda v: v.isNotNull())
        return F.filter(some, lambda v, i: F.array_position(F.transform(some, lambda x: x["path"]), v["path"]) == i + 1)

    return F.when(p != "", let(F.split(F.regexp_replace(p, "/$", ""), "/"), of))


def interface(p: Column) -> Column:
    return p.rlike(API_PATH)


def last_of_level(under: Column) -> Column:
    return F.lower(_plain(F.substring_index(F.regexp_replace(under, "/$", ""), "/", -1)))


def variant_scores(variant: Column) -> list[Column]:
    """Of a variant, how promising it is under a level that is an interface and elsewhere, and its first segment: crossing branches
    helps, repeating a segment hurts, which is seen when it meets a level. A level ends with a slash, so no word of API_PATH and
    no extension reaches over its end."""
    p = F.lower(F.concat(F.lit("/"), variant["path"]))
    slashes = F.length(variant["path"]) - F.length(F.replace(variant["path"], F.lit("/"), F.lit("")))
    own = F.when(variant["mount"], 500).otherwise(0) - variant["trimmed"] * 150 - slashes * 5
    first = F.lower(_plain(F.substring_index(F.btrim(variant["path"], F.lit("/")), "/", 1)))
    under_api = F.when(extension(p).isin(*["." + x for x in RICH]), 100).otherwise(90)
    return [(under_api * 100 + own).alias("under_api"), (_score(p, extension(p)) * 100 + own).alias("elsewhere"), first.alias("first")]
