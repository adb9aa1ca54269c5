"""Dedup, ranking, fingerprints and summaries of matches."""

import hashlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rules import SEVERITIES


def severity_rank(severity: Column) -> Column:
    """high 4, medium 3, low 2, info 1, else 0, whatever the case and the white space around."""
    plain, out = F.lower(F.btrim(severity, F.lit(" \t\n\r\f\x0b"))), F.lit(0)
    for i, s in enumerate(reversed(SEVERITIES)):
        out = F.when(plain == s, i + 1).otherwise(out)
    return out


def unique(matches: DataFrame) -> DataFrame:
    """The first match of each (pattern, value, params), by ord, line and source; the rest of its columns with it."""
    keys = ["pattern", "value", "params"]
    rest = [c for c in matches.columns if c not in keys]
    order = F.struct("ord", "line_no", "source", *[c for c in rest if c not in ("ord", "line_no", "source")])
    return matches.groupBy(*keys).agg(F.min(order).alias("o")).select(*[F.col(c) if c in keys else F.col(f"o.{c}") for c in matches.columns])


def keep_top_severity(matches: DataFrame) -> DataFrame:
    """Rows whose severity is the highest among those of their value; an empty value takes no part."""
    best = matches.groupBy("value").agg(F.max(severity_rank(F.col("severity"))).alias("__best"))
    return matches.join(best, "value").where((F.col("value") == "") | (severity_rank(F.col("severity")) == F.col("__best"))).select(matches.columns)


def ranked(matches: DataFrame) -> DataFrame:
    """By severity, gathered addresses last, then in order of appearance."""
    return matches.orderBy(F.col("pattern") == "gathered_url", severity_rank(F.col("severity")).desc(), "ord", "line_no", "pattern", "value", "params")


def fingerprint(*parts: Column) -> Column:
    """32 hexadecimal digits of SHA-256 over the parts, separated by the unit separator."""
    return F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary"), 256), F.lit(32))


def fingerprinted(matches: DataFrame) -> DataFrame:
    return matches.withColumn("fingerprint", fingerprint(*[F.col(c) for c in ("pattern", "value", "params", "severity", "source")]))


def _quoted(text: Column) -> Column:
    """A JSON string with the three markup characters and the two line separators escaped."""
    out = F.to_json(F.struct(text.alias("v")))
    out = F.substring(out, F.lit(6), F.length(out) - 6)
    for c in ("<", ">", "&", " ", " "):
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def canonical(matches: DataFrame) -> DataFrame:
    """One JSON object a match, its columns in fixed order, params left out where empty."""
    params = F.when(F.col("params") != "", F.concat(F.lit(',"params":'), _quoted(F.col("params")))).otherwise("")
    text = F.concat(F.lit('{"pattern":'), _quoted(F.col("pattern")), F.lit(',"value":'), _quoted(F.col("value")), params, F.lit(',"severity":'), _quoted(F.col("severity")), F.lit("}"))
    return matches.withColumn("json", text)


def checksum(matches: DataFrame) -> DataFrame:
    """One row: SHA-256 of the array of all canonical matches in order.

    The value is defined over one long text, so it is hashed in order: ranges of the sorted matches are joined by Spark, and
    the driver feeds one range after another to the hash, holding one range at a time.
    """
    spark = matches.sparkSession
    order = ["pattern", "value", "params", "severity"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = canonical(matches).select(*order, "json").persist(StorageLevel.DISK_ONLY)  # the ranges are sampled first
    rows = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    digest, first = hashlib.sha256(b"["), True
    for row in rows.select("json").toLocalIterator(prefetchPartitions=False):
        digest.update((b"" if first else b",") + row.json.encode())
        first = False
    digest.update(b"]")
    found.unpersist()
    return spark.createDataFrame([(digest.hexdigest(),)], "checksum string")


def order_free_digest(matches: DataFrame) -> DataFrame:
    """One row that equal sets of matches share, whatever their order: the sum of their 128-bit hashes and their number. It is
    summed where the rows are, for reports too large to be hashed in order."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5(F.col("json").cast("binary")), at, 16), 16, 10).cast("decimal(38,0)"))
    return canonical(matches).agg(F.count("*").alias("n"), F.coalesce(half(1), F.lit(0)).cast("string").alias("left"), F.coalesce(half(17), F.lit(0)).cast("string").alias("right"))


def by_severity(matches: DataFrame) -> DataFrame:
    """(severity, n) with all four severities, 0 where there is none."""
    spark = matches.sparkSession
    bands = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = matches.groupBy("severity").agg(F.count("*").alias("n"))
    return bands.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def short_params(params: Column) -> Column:
    """White space collapsed; beyond 100 bytes the first 97 and three dots."""
    p = F.regexp_replace(params, r"[ \t\n\r\f]+", " ")
    return F.when(F.octet_length(p) > 100, F.concat(F.left(p, F.lit(97)), F.lit("..."))).otherwise(p)


def fails(matches: DataFrame, least: str) -> bool:
    """Whether a match has this severity or a higher one."""
    wanted = len(SEVERITIES) - SEVERITIES.index(least)
    return not matches.where(severity_rank(F.col("severity")) >= wanted).limit(1).isEmpty()


def first_per_class(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each class."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hints(rows: DataFrame) -> DataFrame:
    """Source hints merged by scope, kind and name; only the four kinds, their provenance joined and sorted."""
    kept = rows.where(F.col("kind").isin("url_query", "local_storage", "session_storage", "cookie"))
    return kept.groupBy("scope", "kind", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenance")))).alias("provenance"))
