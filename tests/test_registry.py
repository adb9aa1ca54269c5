"""Registered queries agree with their SQL on the smallest tables, and the package stands without the llm folders."""

import os
import subprocess
import sys
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell.plans import cases, registry
from siftwell.sources import artifacts, sinks
from siftwell.streaming import scan_stream

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
#: One of each kind; the rest runs in the driver's comparison.
CHECKED = sorted(cases.QUERIES) + ["findings_ranked", "results_checksum", "page_links", "template_sample", "page_structural_sig", "provider_tokens", "robots_parse", "wildcard_suppression", "method_table", "reflection_context", "page_forms", "link_header"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[x] for x in columns)) for r in df.collect())
    r = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    theirs = sorted(repr(tuple(row[names.index(x)] for x in columns)) for row in r.fetchall())
    assert sorted(names) == columns and mine == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_orders_are_whole(spark, tmp_path):
    spark.createDataFrame([(i, f"https://h.test/a{i}", "") for i in range(70)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["frontier_order_whole"](spark, str(tmp_path)).collect()
    assert sorted(r.place for r in got) == list(range(1, 71)) and {r.page_id for r in got} == set(range(70))
    rows = registry.QUERIES["gathered_last_whole"](spark, DATA).collect()
    assert len(rows) == 11 and [r.place for r in rows if r.pattern == "gathered_url"] == [11]
    for name in ("frontier_order_whole", "gathered_last_whole"):
        test_query_agrees_with_sql(spark, name)


def test_table_scans_find_paths_long_addresses_and_headers(spark, tmp_path):
    lines = ["log in /var/log/app.log", "peer 2001:db8::17 up", "h = {headers: {'X-Tenant': 'blue'}}", "xhr.setRequestHeader('X-Trace', 'on')"]
    want = {("path", "/var/log/app.log"), ("ipv6", "2001:db8::17"), ("http_header", "X-Tenant: blue"), ("http_header", "X-Trace: on")}
    text = "\n".join(lines)
    spark.createDataFrame([(1, text, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("scan_default_rules", "scan_prefiltered", "scan_pages", "scan_conversations", "findings_unique", "findings_value_max_severity", "findings_ranked"):
        got = {(r.pattern, r.value.strip()) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == want, name
    assert {r.severity: r.n for r in registry.QUERIES["severity_summary"](spark, str(tmp_path)).collect()} == {"high": 0, "medium": 0, "low": 2, "info": 2}


def test_it_stands_without_the_llm_folders(tmp_path):
    for d in ("siftwell", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{d}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "siftwell/llm"], check=True)
    code = "import __spark_entry__ as e; assert 'findings_ranked' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.js").write_text("x='a@b.example'")
    (tmp_path / "b.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("d/e.html", "<p>")
        z.writestr("f.png", "no")
    got = {(r.source.split("/")[-1], r.is_js) for r in artifacts.from_files(spark, str(tmp_path)).collect()}
    assert got == {("a.js", True), ("e.html", False)}


def test_lists(spark, tmp_path):
    (tmp_path / "t").write_text("# c\n\n https://a.test \nb\n")
    assert [r[0] for r in artifacts.targets(spark, str(tmp_path / "t")).collect()] == ["https://a.test", "b"]
    (tmp_path / "i.json").write_text('{"url":"https://a.test"}\nbroken\n')
    assert artifacts.captured_index(spark, str(tmp_path / "i.json")).count() == 1


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x@y.example\nz"), ("b", 1, "x@y.example")], "source string, ord long, body string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scan_stream.responses(spark, str(tmp_path / "in"), "source string, ord long, body string")
    scan_stream.run(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r.pattern, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("email", "x@y.example")]


def test_report(spark, tmp_path):
    m = spark.createDataFrame([("a", "email", "x@y.example", "", "info", 0, 0)], "source string, pattern string, value string, params string, severity string, ord int, line_no int")
    sinks.write_json_lines(m, str(tmp_path / "o"))
    line = spark.read.json(str(tmp_path / "o")).select("type", "value", F.length("fingerprint").alias("n")).first()
    assert tuple(line) == ("match", "x@y.example", 32)
