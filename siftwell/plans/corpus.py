"""Queries that scan the text tables with the rules."""

from pyspark.sql import functions as F

from ..operators import filters, headers, reduce, rules, scan
from ..sources import sinks
from ..sources.artifacts import from_table
from ._book import Book, literal

B = Book()
QUERIES, ORACLE_SQL = B.queries, B.sql

#: The scans use all default rules and http_header; SQL has those that it can express. The tests hold the rest against brute force.
RULES = rules.default_rules()
PLAIN = [r for r in rules.default_rules() if r.name not in ("path", "ipv6")]
KEYWORDS = ["api[_-]?key", "account[_-]?(name|key)?", "zendesk[_-]?password", "github[_-]?token", r"[\w_-]*?secret[\w_-]*?", r"[\w_-]*?token[\w_-]*?", r"[\w_-]*?password[\w_-]*?"]
NEVER = "(" + ", ".join(literal(w) for w in filters.NEVER_SECRET) + ")"
SECRET_SQL = f"(strlen(trim(x, '\"''` ')) >= 6 AND lower(trim(x, '\"''` ')) NOT IN {NEVER} AND NOT regexp_matches(trim(x, '\"''` '), '^[a-z]+(?:-[a-z]+)+$'))"
CREDENTIAL = "regexp_extract({v}, '^[^:=]*[:=][ \\t\"''`]*([A-Za-z0-9_-]*)', 1)"


def _documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_table(d, F.col("doc_id").cast("string"), "text", "doc_id")


def _is_secret(v: str) -> str:
    return SECRET_SQL.replace("(x,", f"({CREDENTIAL.format(v=v)},")


def _rule_sql(r: rules.Rule) -> str:
    p = literal(r.pattern)
    if r.name == "ipv4":
        return f"""SELECT source, ord, line_no, 'ipv4' AS pattern, hits[i] AS value, 'info' AS severity FROM (
          SELECT *, string_split_regex(line, {p}) AS gaps, regexp_extract_all(line, {p}) AS hits, unnest(range(1, len(regexp_extract_all(line, {p})) + 1)) AS i FROM l)
          WHERE NOT regexp_matches(CASE WHEN i > 1 THEN hits[i - 1] ELSE '' END || gaps[i], '(?:\\.|[0-9][ ,]?)$') AND NOT regexp_matches(gaps[i + 1] || coalesce(hits[i + 1], ''), '^(?:\\.|[ ,]?[0-9])')"""
    keep = f" WHERE {_is_secret('value')}" if r.secret_value else ""
    return f"SELECT * FROM (SELECT source, ord, line_no, {literal(r.name)} AS pattern, unnest(regexp_extract_all(line, {p}, 0)) AS value, '{r.severity}' AS severity FROM l){keep}"


def scan_sql(table: str, key: str, text: str, rule_list) -> str:
    union = " UNION ALL ".join(_rule_sql(r) for r in rule_list)
    return f"""l AS (SELECT source, ord, line, i - 1 AS line_no FROM (SELECT CAST({key} AS VARCHAR) AS source, CAST({key} AS BIGINT) AS ord, unnest(string_split_regex({text}, '\\r?\\n')) AS line,
      generate_subscripts(string_split_regex({text}, '\\r?\\n'), 1) AS i FROM {table} WHERE {text} IS NOT NULL)),
      m AS (SELECT source, ord, line_no, pattern, value, '' AS params, severity FROM ({union})),
      u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY pattern, value, params ORDER BY ord, line_no, source) = 1),
      r AS (SELECT *, CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS rank FROM u),
      k AS (SELECT * FROM r QUALIFY value = '' OR rank = max(rank) OVER (PARTITION BY value))"""


DOC_SQL = scan_sql("documents", "doc_id", "text", PLAIN)


def _scanned(artifacts, once=True):
    return (scan.scan_distinct if once else scan.scan)(artifacts, RULES).unionByName(headers.scan_headers(artifacts))


def _found(spark, sf_dir):
    return _scanned(_documents(spark, sf_dir), once=False)  # to bring equal bodies together moves all of them, which costs more


def _kept(spark, sf_dir):
    return reduce.keep_top_severity(reduce.unique(_found(spark, sf_dir)))


@B.add("scan_default_rules", f"WITH {DOC_SQL} SELECT source, CAST(line_no AS BIGINT) AS line_no, pattern, value, severity FROM m")
def scan_default_rules(spark, sf_dir):
    return _found(spark, sf_dir).select("source", F.col("line_no").cast("long"), "pattern", "value", "severity")


@B.add("scan_prefiltered", f"WITH {DOC_SQL} SELECT source, CAST(line_no AS BIGINT) AS line_no, pattern, value FROM m")
def scan_prefiltered(spark, sf_dir):
    """The same scan without the dedup of bodies."""
    return _scanned(_documents(spark, sf_dir), once=False).select("source", F.col("line_no").cast("long"), "pattern", "value")


@B.add("scan_strict_rules", f"WITH {scan_sql('documents', 'doc_id', 'text', rules.strict_rules())} SELECT source, pattern, value FROM m")
def scan_strict_rules(spark, sf_dir):
    return scan.scan(_documents(spark, sf_dir), rules.strict_rules()).select("source", "pattern", "value")


@B.add("scan_keyword_rules", f"WITH {scan_sql('documents', 'doc_id', 'text', rules.keyword_rules(KEYWORDS))} SELECT source, pattern, value FROM m")
def scan_keyword_rules(spark, sf_dir):
    return scan.scan(_documents(spark, sf_dir), rules.keyword_rules(KEYWORDS)).select("source", "pattern", "value")


@B.add("scan_pages", f"WITH {scan_sql('pages', 'page_id', 'html', PLAIN)} SELECT source, pattern, value FROM m")
def scan_pages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return _scanned(from_table(p, F.col("page_id").cast("string"), "html", "page_id")).select("source", "pattern", "value")


@B.add("scan_conversations", f"WITH {scan_sql('(SELECT conv_id * 1000 + turn AS k, text FROM conversations)', 'k', 'text', PLAIN)} SELECT source, pattern, value FROM m")
def scan_conversations(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return _scanned(from_table(c, F.col("k").cast("string"), "text", "k")).select("source", "pattern", "value")


@B.add("findings_unique", f"WITH {DOC_SQL} SELECT source, pattern, value, params, severity FROM u")
def findings_unique(spark, sf_dir):
    return reduce.unique(_found(spark, sf_dir)).select("source", "pattern", "value", "params", "severity")


@B.add("findings_value_max_severity", f"WITH {DOC_SQL} SELECT source, pattern, value, severity FROM k")
def findings_value_max_severity(spark, sf_dir):
    return _kept(spark, sf_dir).select("source", "pattern", "value", "severity")


@B.add("findings_ranked", f"WITH {DOC_SQL} SELECT source, pattern, value, params, severity FROM k ORDER BY rank DESC, ord, line_no, pattern, value")
def findings_ranked(spark, sf_dir):
    return reduce.ranked(_kept(spark, sf_dir)).select("source", "pattern", "value", "params", "severity")


@B.add("findings_top20", f"WITH {DOC_SQL} SELECT source, pattern, value, severity FROM k ORDER BY rank DESC, ord, line_no, pattern, value LIMIT 20")
def findings_top20(spark, sf_dir):
    return reduce.ranked(_kept(spark, sf_dir)).select("source", "pattern", "value", "severity").limit(20)


@B.add("finding_fingerprint", f"WITH {DOC_SQL} SELECT pattern, value, substr(sha256(pattern || chr(31) || value || chr(31) || params || chr(31) || severity || chr(31) || source), 1, 32) AS fingerprint FROM k")
def finding_fingerprint(spark, sf_dir):
    return reduce.fingerprinted(_kept(spark, sf_dir)).select("pattern", "value", "fingerprint")


def _go_json(c: str) -> str:
    return f"""replace(replace(replace(CAST(to_json({c}) AS VARCHAR), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"""


CANONICAL = f"""'{{"pattern":' || {_go_json('pattern')} || ',"value":' || {_go_json('value')} || CASE WHEN params <> '' THEN ',"params":' || {_go_json('params')} ELSE '' END || ',"severity":' || {_go_json('severity')} || '}}'"""


@B.add("results_checksum", f"WITH {DOC_SQL} SELECT sha256('[' || coalesce(string_agg({CANONICAL}, ',' ORDER BY pattern, value, params, severity), '') || ']') AS checksum FROM k")
def results_checksum(spark, sf_dir):
    return reduce.checksum(_kept(spark, sf_dir))


@B.add("severity_summary", f"WITH {DOC_SQL} SELECT s.severity, count(k.value) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN k ON k.severity = s.severity GROUP BY s.severity")
def severity_summary(spark, sf_dir):
    return reduce.by_severity(_kept(spark, sf_dir))


@B.add("findings_by_rule", f"WITH {DOC_SQL} SELECT pattern, count(*) AS n, count(DISTINCT value) AS n_values FROM m GROUP BY pattern")
def findings_by_rule(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@B.add("findings_by_lang_source", f"WITH {DOC_SQL} SELECT d.lang, d.source, count(*) AS n FROM m JOIN documents d ON d.doc_id = m.ord GROUP BY d.lang, d.source")
def findings_by_lang_source(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ord"), "lang", F.col("source").alias("site"))
    return _found(spark, sf_dir).join(d, "ord").groupBy("lang", F.col("site").alias("source")).agg(F.count("*").alias("n"))


@B.add("findings_with_labels", f"WITH {DOC_SQL} SELECT t.quality, t.toxic, count(*) AS n FROM m JOIN labels t ON t.doc_id = m.ord GROUP BY t.quality, t.toxic")
def findings_with_labels(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "ord")
    return _found(spark, sf_dir).join(t, "ord").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@B.add("body_exact_dups", "SELECT sha256(text) AS body, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def body_exact_dups(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("body")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@B.add("safe_mode_rules", "SELECT pattern, severity FROM (VALUES " + ", ".join(f"({literal(r.name)}, '{r.severity}')" for r in rules.default_rules() if r.name not in (*rules.NOT_SCRIPT, "phone", "ipv6", "path", "ipv4") or r.name == "long_secret") + ") t(pattern, severity)")
def safe_mode_rules(spark, sf_dir):
    return spark.createDataFrame([(r.name, r.severity) for r in rules.default_rules() if r.script], "pattern string, severity string")


FINGERPRINT = "substr(sha256(pattern || chr(31) || value || chr(31) || params || chr(31) || severity || chr(31) || source), 1, 32)"


@B.add("json_lines", f"""WITH {DOC_SQL} SELECT '{{"type":"match","pattern":' || to_json(pattern) || ',"value":' || to_json(value) || ',"severity":"' || severity || '","source":' || to_json(source) || ',"fingerprint":"' || {FINGERPRINT} || '"}}' AS value FROM k""")
def json_lines(spark, sf_dir):
    return sinks.json_lines(_kept(spark, sf_dir))


@B.add("json_envelope", f"""WITH {DOC_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY rank, ord DESC, line_no DESC, pattern DESC, value DESC) = 1 AS last FROM k)
  SELECT '{{"checksum":"' || sha256('[' || coalesce(string_agg({CANONICAL}, ',' ORDER BY pattern, value, params, severity), '') || ']') || '","scan_time":"","results":[' AS value FROM k
  UNION ALL SELECT '{{"pattern":' || to_json(pattern) || ',"value":' || to_json(value) || ',"severity":"' || severity || '"}}' || CASE WHEN last THEN '' ELSE ',' END FROM o UNION ALL SELECT ']}}'""")
def json_envelope(spark, sf_dir):
    return sinks.envelope(_kept(spark, sf_dir))
