"""What a captured response is and says: kinds of bodies, form values, well-known documents, rate limits."""

import gzip
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, filters, urls

#: Documents that sites publish at known places.
STANDARD_PATHS = (
    "/.well-known/openid-configuration", "/.well-known/oauth-authorization-server", "/.well-known/oauth-protected-resource",
    "/.well-known/security.txt", "/.well-known/apple-app-site-association", "/apple-app-site-association",
    "/.well-known/assetlinks.json", "/.well-known/nodeinfo", "/.well-known/host-meta", "/.well-known/host-meta.json",
    "/.well-known/change-password",
)
MOST_SITEMAPS, MOST_URLS, MOST_INFLATED = 20, 500, 32 << 20

#: What fills a field of a type, or else one whose name, id or placeholder has one of the words.
BY_TYPE = {
    "email": "test@example.com", "password": "Password123!", "number": "42", "range": "42", "tel": "5555550123", "url": "https://example.com",
    "date": "2024-01-01", "datetime-local": "2024-01-01T12:00", "month": "2024-01", "week": "2024-W01", "time": "12:00", "color": "#3366cc",
    "search": "test",
}
BY_WORD = (
    (("email", "e-mail"), "test@example.com"), (("password", "passwd", "pwd"), "Password123!"), (("phone", "tel", "mobile"), "5555550123"),
    (("zip", "postal"), "12345"), (("url", "website", "http"), "https://example.com"), (("first name", "firstname", "fname"), "Test"),
    (("last name", "lastname", "lname", "surname"), "User"), (("username", "user name", "login", "handle"), "testuser"),
    (("name",), "Test User"), (("city", "town"), "Springfield"), (("state", "province"), "CA"), (("country",), "US"),
    (("company", "organization", "organisation"), "Example Inc"), (("age",), "30"), (("amount", "price", "qty", "quantity", "number"), "1"),
    (("date", "dob", "birthday"), "2024-01-01"), (("message", "comment", "description", "bio", "about"), "test message"),
)


def html_content(url: Column, content_type: Column) -> Column:
    path = F.when(urls.path(url) != "", urls.path(url)).otherwise(url)
    return F.lower(content_type).contains("html") | urls.extension(path).isin(".html", ".htm")


def script_content(content_type: Column) -> Column:
    return F.lower(F.substring_index(content_type, ";", 1)).rlike("javascript|ecmascript")


def redirect(status: Column, location: Column) -> Column:
    return status.between(300, 399) & (F.coalesce(location, F.lit("")) != "")


def still_exists(status: Column) -> Column:
    """Whether a status says that an archived path is still there."""
    return status.between(200, 399) | status.isin(401, 403, 405)


def parameter_type(body: Column) -> Column:
    """The content type that a body of parameters looks like."""
    return F.when(F.btrim(body, F.lit(" \t\n\r\f\x0b")).rlike(r"^[{\[]"), "application/json").otherwise("application/x-www-form-urlencoded")


def form_value(kind: Column, name: Column, field_id: Column, placeholder: Column, other: str = "test") -> Column:
    """A plausible value of a field by its type, else by words in its name, id and placeholder."""
    hint, out = F.lower(F.concat_ws(" ", name, field_id, placeholder)), F.lit(other)
    for words, value in reversed(BY_WORD):
        out = F.when(hint.rlike("|".join(words)), value).otherwise(out)
    plain = F.lower(F.btrim(kind))
    for k, value in BY_TYPE.items():
        out = F.when(plain == k, value).otherwise(out)
    return out


def capped(body: Column, most: int = 64 << 20) -> Column:
    """At most so many bytes of a body."""
    cut = F.regexp_replace(F.substring(body.cast("binary"), 1, most).cast("string"), "\ufffd+\\z", "")
    return F.when(F.octet_length(body) > most, cut).otherwise(body)


def looks_like_sitemap(url: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(F.lower(url), "[?#].*$", ""), r"\.gz$", "")
    return p.endswith("sitemap.xml") | (p.endswith(".xml") & p.contains("sitemap"))


def inflate(data: bytes | None) -> bytes | None:
    """Unpacked if it is a gzip stream, at most MOST_INFLATED bytes of it; None if one that can't be read."""
    if data is None or data[:2] != b"\x1f\x8b":
        return data
    try:
        out = zlib.decompressobj(31)
        found = out.decompress(data, MOST_INFLATED)
        return found if out.eof or len(found) == MOST_INFLATED else None
    except (zlib.error, gzip.BadGzipFile):
        return None


def inflated(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows with the binary body unpacked where it is a gzip stream; other rows never reach Python."""
    packed = F.col(body).isNotNull() & (F.hex(F.substring(body, 1, 2)) == "1F8B")
    rest = [c for c in rows.columns if c != body]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([inflate(x) for x in batch.column(body).to_pylist()], pa.binary())
            yield batch.set_column(batch.schema.get_field_index(body), body, found)

    ordered = rows.select(*rest, body)
    return ordered.where(~packed).union(ordered.where(packed).mapInArrow(run, ordered.schema)).select(rows.columns)


def sitemap_entries(rows: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(url, value, is_map) of the locations of captured sitemaps: of an index all are maps, of a set none, else by their name."""
    lower = F.lower(F.col(body))
    each = rows.select(F.col(url).alias("url"), lower.contains("<sitemapindex").alias("index"), lower.contains("<urlset").alias("set"), F.explode(extract.sitemap_locations(F.col(body))).alias("value"))
    return each.where("value <> ''").select("url", "value", (F.col("index") | (~F.col("set") & looks_like_sitemap(F.col("value")))).alias("is_map"))


def sitemap_pages(captured: DataFrame, roots: DataFrame, host: str, most_maps: int = MOST_SITEMAPS, most: int = MOST_URLS) -> DataFrame:
    """(value): pages in the scope of a host that captured sitemaps name, from the roots through their indexes.

    Maps are met level by level, at most most_maps of them in order of level and address, and at most `most` pages are
    given in order of address; both are the feature's limits.
    """
    entries = sitemap_entries(captured)
    inside = filters.same_scope(F.lit(host), urls.host(F.col("value")))
    children = entries.where("is_map").where(inside).select("url", "value").distinct()
    seen = roots.select("url").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, most_maps):
        step = children.join(front, "url").select(F.col("value").alias("url")).distinct().join(seen, "url", "left_anti")
        front = step.withColumn("depth", F.lit(depth))
        if front.isEmpty():
            break
        seen = seen.union(front)
    fetched = captured.select("url").join(seen, "url").orderBy("depth", "url").limit(most_maps)
    pages = entries.where(~F.col("is_map")).join(fetched.select("url"), "url").where(inside)
    return pages.select("value").distinct().orderBy("value").limit(most)


def standard_urls(origins: DataFrame) -> DataFrame:
    """(url) of the known places of each origin."""
    return origins.select("origin", F.explode(F.array(*[F.lit(p) for p in STANDARD_PATHS])).alias("path")).select(F.concat("origin", "path").alias("url"))


def index_urls(rows: DataFrame, body: str = "body") -> DataFrame:
    """(url) of archive index bodies in both forms: an array of rows whose first names the columns, and lines of objects."""
    text = F.btrim(F.col(body), F.lit(" \t\r\n"))
    table = rows.where(text.startswith("[")).select(F.from_json(text, "array<array<string>>").alias("t"))
    at = F.array_position(F.get("t", F.lit(0)), "original").cast("int")
    from_rows = table.where(at > 0).select(F.explode(F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda r: F.get(r, at - 1))).alias("url"))
    lines = rows.where(~text.startswith("[")).select(F.explode(F.split(F.col(body), "\r?\n")).alias("line"))
    from_lines = lines.select(F.from_json("line", "url string")["url"].alias("url"))
    return from_rows.union(from_lines).where("url <> ''")


#: Seconds of the least backoff, the least epoch that is taken as a time, and clean responses before a gap is halved.
LEAST_BACKOFF, LEAST_EPOCH, STREAK = 0.5, 1_000_000_000, 5
HTTP_DATE = r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$"


def _date(value: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(F.regexp_extract(value, HTTP_DATE, 1), F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")))


def reset_at(value: Column, now: Column) -> Column:
    """The second at which a rate limit's window ends, from seconds to wait, an epoch or a date; null if none of these."""
    v = F.btrim(value)
    n = v.try_cast("long")
    return F.coalesce(F.when(n <= 0, now).when(n > LEAST_EPOCH, n).otherwise(now + n), _date(v))


def budget_spacing(remaining: Column, reset: Column, now: Column) -> Column:
    """Seconds to wait before the next request so that what remains lasts until the reset."""
    window = reset_at(reset, now) - now
    known = F.when(window <= 0, 0.0).when(remaining <= 0, window).otherwise(window / (remaining + 1))
    return F.coalesce(known, F.when(remaining <= 0, LEAST_BACKOFF).otherwise(0.0)).cast("double")


def throttled(responses: DataFrame, base: float = 0.0, most: float = 30.0) -> DataFrame:
    """(host, seq, gap): the gap in seconds before the next request to a host, after each of its responses (host, seq, slowed).

    A slowed response doubles the gap, to LEAST_BACKOFF at least and `most` at most; STREAK clean ones in a row halve it,
    to the base at least. A fold over the responses of one host in order: a plan of pacing, nothing is sent.
    """
    steps = responses.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("seq", "slowed"))).alias("r"))
    state = F.struct(F.lit(base).alias("gap"), F.lit(0).alias("ok"), F.array().cast("array<struct<seq:bigint,gap:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        ok = F.when(x["slowed"] | (a["gap"] <= base), 0).otherwise(a["ok"] + 1)
        eased = F.greatest(a["gap"] / 2, F.lit(base))
        gap = F.when(x["slowed"], F.least(F.greatest(a["gap"] * 2, F.lit(LEAST_BACKOFF)), F.lit(most))).when(ok >= STREAK, eased).otherwise(a["gap"])
        left = F.when(ok >= STREAK, 0).otherwise(ok)
        return F.struct(gap.alias("gap"), left.alias("ok"), F.concat(a["out"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), gap.alias("gap")))).alias("out"))

    return steps.select("host", F.explode(F.aggregate("r", state, step, lambda a: a["out"])).alias("x")).select("host", "x.seq", "x.gap")
