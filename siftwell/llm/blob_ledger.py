"""Secret scans over an incremental blob ledger (native: DataFrame functions only).

Every historical version of a file is addressed by the SHA-256 of its content. The ledger holds one row for each
(blob, rule, rule version) that has been scanned, hits or not. A run scans only the pairs that the ledger lacks,
appends them, and joins the findings back to every path at which a blob occurs.

Nulls: a null content counts as empty. Empty table: empty result. Repeated rows: scanned once, reported once a row.
Very long texts are scanned whole. Ties: spans that start together go in the rules' order. Extra columns of the input,
whatever their names, are left out. A null path is a path like others. A failed run may leave pairs in the ledger twice;
both rows say the same, and compacted() makes them one.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import fresh, table


@dataclass(frozen=True)
class Rule:
    """A hit counts if its group has at least `least` characters; failing hits still consume their text."""

    name: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The patterns and least lengths of the scan contract, in their order.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)

LEDGER = "blob string, rule string, spans array<struct<start:bigint,stop:bigint>>"


def addressed(versions: DataFrame, path: str, content: str) -> DataFrame:
    """(path, blob, content): content-addresses each version."""
    text = F.coalesce(F.col(content), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("content"))


def _pieces(rule: Rule):
    """Lengths (before, hit, counted group) of the hits in order; the text after the last hit has null as its hit."""
    c, pattern = F.col("content"), F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    hits = F.regexp_extract_all(c, pattern, F.lit(0))
    counted = F.regexp_extract_all(c, pattern, F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(lengths(F.split(c, rule.pattern, -1)).alias("gap"), lengths(hits).alias("hit"), lengths(counted).alias("counted"))
    return F.when(c.rlike(rule.pattern), zipped)


def scan(pairs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, spans) for blobs with their unseen rules; positions in code points, the end exclusive.

    The rows stay with their blob, so neither the running sum nor the grouping needs a shuffle beyond the one
    that made the blobs distinct.
    """
    todo = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), F.when(F.array_contains("unseen", r.key), _pieces(r)).alias("pieces")) for r in rules])
    each = pairs.select("blob", "unseen", F.explode(todo).alias("t")).where(F.array_contains("unseen", F.col("t.rule")))
    rows = each.select("blob", "t.rule", "t.least", F.posexplode_outer("t.pieces").alias("at", "p"))
    run = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("p.gap").cast("long") + F.coalesce(F.col("p.hit"), F.lit(0))).over(run)
    rows = rows.withColumn("stop", stop)
    hit = F.when(F.col("p.counted") >= F.col("least"), F.struct((F.col("stop") - F.col("p.hit")).alias("start"), F.col("stop")))
    return rows.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(hit)).alias("spans"))


def update(spark: SparkSession, versions: DataFrame, ledger: str, rules=RULES, path: str = "path", content: str = "content") -> DataFrame:
    """Scan what the ledger at this path lacks, append it, and return (path, blob, rule, spans) for every version.

    The ledger is read first; a blob whose pairs are all known is dropped before its content is looked at.
    """
    known = _ledger(spark, ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = addressed(versions, path, content).groupBy("blob").agg(F.first("content").alias("content"))
    unseen = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    pairs = blobs.join(known, "blob", "left").select("blob", "content", unseen.alias("unseen")).where(F.size("unseen") > 0)
    scan(pairs, rules).write.mode("append").parquet(ledger)
    found = _ledger(spark, ledger).where(F.col("rule").isin([r.key for r in rules]))
    wide = found.groupBy("blob").agg(*[F.first(F.when(F.col("rule") == r.key, F.col("spans")), ignorenulls=True).alias(r.name) for r in rules])
    return addressed(versions, path, content).drop("content").join(wide, "blob")


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(ledger)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def compacted(spark: SparkSession, ledger: str, to: str) -> None:
    """Write the ledger to another path with one row for each pair."""
    _ledger(spark, ledger).groupBy("blob", "rule").agg(F.first("spans").alias("spans")).write.parquet(to)


def joined_spans(rules=RULES):
    """kind:start:end of all rules by start, then in the rules' order, joined by commas."""
    tagged = [_each(r.name, k) for k, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _each(name: str, k: int):
    return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.lit(name).alias("kind"), s["stop"].alias("stop")))


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = update(spark, docs, fresh(spark, "ledger"), RULES, "doc_id", "text")
    spans = joined_spans()
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(r.name).cast("long").alias(f"n_{r.name}") for r in RULES],
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r(k, kind, pat, grp, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
  (2, 'hex', '[0-9a-f]+', 0, 16)),
a AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, 12 AS least, string_split_regex(t, (SELECT pat FROM r WHERE k = 0)) AS gaps, regexp_extract_all(t, (SELECT pat FROM r WHERE k = 0), 0) AS hits, regexp_extract_all(t, (SELECT pat FROM r WHERE k = 0), 2) AS counted FROM d
  UNION ALL SELECT doc_id, 1, 'access', 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM d WHERE contains(t, 'AKIA')
  UNION ALL SELECT doc_id, 2, 'hex', 16, string_split_regex(t, '[0-9a-f]{16,}'), regexp_extract_all(t, '[0-9a-f]{16,}', 0), regexp_extract_all(t, '[0-9a-f]{16,}', 0) FROM d),
e AS (SELECT doc_id, k, kind, least, hits, counted, gaps, unnest(range(1, len(hits) + 1)) AS i FROM a WHERE len(hits) > 0),
s AS (SELECT doc_id, k, kind,
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b,
  length(hits[i]) AS n FROM e WHERE length(counted[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
