"""Reports: JSON lines with their records before and after, the JSON document, text with snippets."""

import json
import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dom import in_order
from ..operators.reduce import checksum, fingerprinted, ranked, severity_rank, short_params

#: Record types, and what a summary counts.
SCHEMA, META, MATCH, SUMMARY = "siftwell.jsonl.1", "scan_meta", "match", "scan_summary"
BANDS = ("high", "medium", "low", "info")
RULE = "─" * 40


def json_lines(matches: DataFrame, show_source: bool = True) -> DataFrame:
    """(value): one JSON object a finding, with its fingerprint; params and source only where there are some."""
    some = lambda c: F.nullif(c, F.lit(""))
    source = some(F.col("source")) if show_source else F.lit(None).cast("string")
    fields = F.struct(F.lit(MATCH).alias("type"), "pattern", "value", some(short_params(F.col("params"))).alias("params"), "severity", source.alias("source"), "fingerprint")
    return fingerprinted(matches).select(F.to_json(fields).alias("value"))


def meta_line(matches: DataFrame, scan_time: str) -> DataFrame:
    fields = F.struct(F.lit(META).alias("type"), F.lit(SCHEMA).alias("schema_version"), F.lit(scan_time).alias("scan_time"), "checksum")
    return checksum(matches).select(F.to_json(fields).alias("value"))


def summary(matches: DataFrame, dom: DataFrame | None = None, reflections: DataFrame | None = None) -> DataFrame:
    """One row of counts: findings in all, by kind, and by severity over all kinds."""
    kinds = {"match": matches, "dom": dom, "reflection": reflections}
    each = None
    for kind, rows in kinds.items():
        part = (rows if rows is not None else matches.limit(0)).select(F.lit(kind).alias("kind"), F.lower("severity").alias("severity"))
        each = part if each is None else each.union(part)
    counted = each.groupBy("kind", "severity").count()
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0)).cast("long")
    every = F.coalesce(F.sum("count"), F.lit(0)).cast("long")
    return counted.agg(every.alias("total_findings"), *[n(F.col("kind") == k).alias(f"{k}_findings") for k in kinds], *[n(F.col("severity") == s).alias(s) for s in BANDS])


def summary_line(matches: DataFrame, dom: DataFrame | None = None, reflections: DataFrame | None = None) -> DataFrame:
    bands = F.struct(*[F.col(s) for s in BANDS]).alias("findings_by_severity")
    fields = F.struct(F.lit(SUMMARY).alias("type"), F.lit(SCHEMA).alias("schema_version"), "total_findings", "match_findings", "dom_findings", "reflection_findings", bands)
    return summary(matches, dom, reflections).select(F.to_json(fields).alias("value"))


def records(findings: DataFrame) -> DataFrame:
    """(value): finding rows of pages or reflections as JSON objects, empty and missing fields left out, in order."""
    shown = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in findings.dtypes if c != "ord"]
    return in_order(findings).select(F.to_json(F.struct(*shown)).alias("value"))


def report_lines(matches: DataFrame, scan_time: str, dom: DataFrame | None = None, reflections: DataFrame | None = None) -> DataFrame:
    """(place, value): the whole report: the meta record, findings by severity, flows, reflections, and the summary."""
    parts = [meta_line(matches, scan_time), json_lines(ranked(matches)), *(records(x) for x in (dom, reflections) if x is not None), summary_line(matches, dom, reflections)]
    out = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("place"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def write_json_lines(matches: DataFrame, path: str) -> None:
    """Findings by severity, one file a range of them, in the order of the files."""
    ordered = matches.withColumn("__rank", severity_rank(F.col("severity"))).orderBy(F.col("__rank").desc(), "ord", "line_no", "pattern", "value", "params")
    json_lines(ordered).write.mode("overwrite").text(path)


def write_report(path: str, matches: DataFrame, scan_time: str, dom: DataFrame | None = None, reflections: DataFrame | None = None) -> None:
    """The report as folders of text files whose names are in its order."""
    meta_line(matches, scan_time).write.mode("overwrite").text(f"{path}/0-meta")
    write_json_lines(matches, f"{path}/1-matches")
    for name, rows in (("2-dom", dom), ("3-reflections", reflections)):
        if rows is not None:
            records(rows).write.mode("overwrite").text(f"{path}/{name}")
    summary_line(matches, dom, reflections).write.mode("overwrite").text(f"{path}/4-summary")


def envelope_lines(matches: DataFrame, scan_time: str = "", show_source: bool = False) -> DataFrame:
    """(place, value): the lines of one JSON document, the checksum before the results; the results are never one value, so the
    document is written like any table, in the order of place."""
    matches = matches.persist(StorageLevel.DISK_ONLY)  # read for the checksum, the last row and the rows
    source = [F.nullif("source", F.lit("")).alias("source")] if show_source else []
    fields = F.struct("pattern", "value", F.nullif(short_params(F.col("params")), F.lit("")).alias("params"), "severity", *source)
    rank = F.struct(F.lit(1).alias("part"), (F.col("pattern") == "gathered_url").alias("late"), (-severity_rank(F.col("severity"))).alias("rank"), "ord", "line_no", "pattern", "value", "params")
    rows = matches.select(rank.alias("place"), F.to_json(fields).alias("json"))
    last = rows.agg(F.max("place").alias("last"))
    body = rows.join(F.broadcast(last)).select("place", F.concat("json", F.when(F.col("place") == F.col("last"), "").otherwise(",")).alias("value"))
    edge = lambda part: F.struct(F.lit(part).alias("part"), F.lit(False).alias("late"), F.lit(0).alias("rank"), F.lit(0).cast(matches.schema["ord"].dataType).alias("ord"), F.lit(0).cast(matches.schema["line_no"].dataType).alias("line_no"), *[F.lit("").alias(c) for c in ("pattern", "value", "params")])
    head = checksum(matches).select(edge(0).alias("place"), F.concat(F.lit('{"checksum":"'), "checksum", F.lit(f'","scan_time":{json.dumps(scan_time)},"results":[')).alias("value"))
    tail = head.select(edge(2).alias("place"), F.lit("]}").alias("value"))
    return head.union(body).union(tail)


def envelope(matches: DataFrame) -> DataFrame:
    """(value): the lines of envelope_lines() in order."""
    return envelope_lines(matches).orderBy("place").select("value")


def pretty(matches: DataFrame, show_source: bool = False) -> DataFrame:
    """(value): one line a finding, by severity, gathered addresses last: [pattern] (severity) value params=..."""
    p = short_params(F.col("params"))
    lead = F.concat(F.col("source"), F.lit(": ")) if show_source else F.lit("")
    text = F.concat(lead, F.lit("["), "pattern", F.lit("] ("), "severity", F.lit(") "), "value", F.when(p != "", F.concat(F.lit(" params="), p)).otherwise(""))
    return ranked(matches).select(text.alias("value"))


#: What stays whole when a script is laid out: strings, comments, then single characters.
_PIECE = re.compile(r"""(?s)(?P<whole>"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)|//[^\n]*|/\*.*?(?:\*/|$))|(?P<blank>\s+)|(?P<mark>[{};()])|(?P<text>[^\s{};()"'`/]+|/)""")


def laid_out(script: str) -> str:
    """A script on indented lines, broken after { } and ;, but not inside brackets, strings and comments. For display."""
    lines: list[str] = []
    now, depth, nested = "", 0, 0

    def close() -> None:
        nonlocal now
        if now.strip():
            lines.append(now.rstrip())
        now = "  " * depth

    for m in _PIECE.finditer(script):
        piece = m[0]
        if m["blank"]:
            now += " " if now.strip() and not now.endswith(" ") else ""
            continue
        if piece == "}":
            depth = max(0, depth - 1)
            close()
            now = "  " * depth + "}"
            continue
        now += piece
        nested = max(0, nested + (piece == "(") - (piece == ")"))
        if piece == "{":
            depth += 1
            close()
        elif piece == ";" and not nested:
            close()
        elif piece == ";":
            now += " "
    close()
    return "\n".join(lines)


#: Styles of a highlighted snippet, and the words that have one.
STYLES = {"comment": "\033[90m", "string": "\033[32m", "number": "\033[33m", "keyword": "\033[35m", "literal": "\033[36m", "match": "\033[1;4;31m", "frame": "\033[90m"}
RESET = "\033[0m"
KEYWORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super "
    "switch throw try typeof var void while with yield let static async await of from as get set"
).split()
LITERALS = "true false null undefined NaN Infinity this".split()
_TOKEN = re.compile(r"""(?s)(?P<comment>//[^\n]*|/\*.*?(?:\*/|$))|(?P<string>"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$))|(?P<number>\.?\d[\w$.]*)|(?P<name>[A-Za-z_$][\w$]*)""")


def styles(script: str) -> list[str]:
    """The style of each character: comment, string, number, keyword, literal, or none."""
    out = [""] * len(script)
    for m in _TOKEN.finditer(script):
        kind = m.lastgroup if m.lastgroup != "name" else "keyword" if m[0] in KEYWORDS else "literal" if m[0] in LITERALS else ""
        out[m.start() : m.end()] = [kind] * len(m[0])
    return out


def rendered(raw: str, value: str, colour: bool = False) -> str:
    """A snippet laid out with line numbers; with colour its words are styled and the value stands out."""
    text = laid_out(raw)
    if not text:
        return ""
    style = styles(text)
    at = text.find(value) if value else -1
    if at >= 0:
        style[at : at + len(value)] = ["match"] * len(value)
    paint = lambda kind, s: f"{STYLES[kind]}{s}{RESET}" if colour and kind and s else s
    lines, start = text.split("\n"), 0
    width, out = len(str(len(lines))), [f"    {paint('frame', f'┌─ snippet {RULE}')}"]
    for i, line in enumerate(lines):
        runs, kinds = [], style[start : start + len(line)]
        for j, kind in enumerate(kinds):
            if j and kind == kinds[j - 1]:
                runs[-1][1] += line[j]
            else:
                runs.append([kind, line[j]])
        out.append(f"    {paint('frame', f'{i + 1:>{width}} │')} " + "".join(paint(k, s) for k, s in runs))
        start += len(line) + 1
    return "\n".join([*out, f"    {paint('frame', f'└─{RULE}')}", ""])


def with_snippets(matches: DataFrame, colour: bool = False) -> DataFrame:
    """matches with the snippet (column raw) of each laid out, in a column rendered."""
    from ..operators.scripts import explode_with

    keyed = matches.withColumn("__k", F.struct(*matches.columns))
    out = explode_with(keyed.select("__k", F.to_json(F.struct("raw", "value")).alias("j")), "__k", "j", lambda j: [(rendered(*(json.loads(j).get(c) or "" for c in ("raw", "value")), colour),)], "rendered string")
    return out.select("__k.*", "rendered")


def banner(version: str, colour: bool = False) -> str:
    """The first line of a text report."""
    name = f"siftwell v{version}"
    return f"{STYLES['string']}{name}{RESET}" if colour else name


def pretty_flows(findings: DataFrame) -> DataFrame:
    """(value): the flows, sinks and messages of pages in order, one text of some lines each."""
    m = F.col("message")
    sure = F.when(F.col("confirmed"), "/confirmed").otherwise("")
    source = F.when(F.col("source_kind").isNotNull(), F.concat("source_kind", F.when(F.col("source_name") != "", F.concat(F.lit("["), "source_name", F.lit("]"))).otherwise(""), F.lit(" -> "))).otherwise("")
    sink = F.when(F.col("sink").isNotNull(), F.concat("sink", F.lit("(arg "), F.col("argument").cast("string"), F.lit(")"))).otherwise("")
    said = lambda name, c: F.concat(F.lit(f" {name}="), m[c].cast("string"))
    message = F.when(m.isNotNull(), F.concat(said("listeners", "listener_count"), said("origin_checked", "origin_checked"), said("source_checked", "source_checked"), said("reaches_sink", "reaches_sink"))).otherwise("")
    reason = F.concat(F.lit("\n    triage="), F.col("triage.verdict"), F.lit(" reason="), F.col("triage.reason"))
    text = F.concat(F.lit("["), "type", F.lit("] ("), "severity", F.lit("/"), "confidence", sure, F.lit(") "), source, sink, message, F.lit("\n    page="), "page_url", reason)
    return in_order(findings).select(text.alias("value"))


def pretty_reflections(findings: DataFrame) -> DataFrame:
    """(value): reflections in order, one text of some lines each."""
    more = F.when(F.col("seen_on_routes") > 1, F.concat(F.lit(" (+"), (F.col("seen_on_routes") - 1).cast("string"), F.lit(" more route(s))"))).otherwise("")
    chars = F.when(F.size("unfiltered") > 0, F.concat(F.lit("\n    unfiltered="), F.array_join("unfiltered", " "))).otherwise("")
    text = F.concat(F.lit("[reflection] ("), "severity", F.lit("/"), "confidence", F.lit(") GET["), "parameter", F.lit("] -> "), "context", F.lit("\n    url="), "page_url", more, F.lit(" occurrences="), F.col("occurrences").cast("string"), chars, F.lit("\n    triage="), "verdict")
    return in_order(findings).select(text.alias("value"))


def pretty_report(matches: DataFrame, scan_time: str, dom: DataFrame | None = None, reflections: DataFrame | None = None) -> DataFrame:
    """(place, value): the whole report as text: findings, gathered addresses, the checksum, flows and reflections."""
    spark, late = matches.sparkSession, F.col("pattern") == "gathered_url"
    title = lambda t: spark.createDataFrame([(t,)], "value string")
    parts = [pretty(matches.where(~late)), title("=== Gathered URLs ===") if not matches.where(late).isEmpty() else None, pretty(matches.where(late)), checksum(matches).select(F.concat(F.lit("[scan] checksum="), "checksum", F.lit(f" scan_time={scan_time}")).alias("value"))]
    for name, rows, show in (("DOM", dom, pretty_flows), ("Reflection", reflections, pretty_reflections)):
        parts += [title(f"=== {name} Findings ==="), show(rows)] if rows is not None else []
    out = None
    for i, part in enumerate(p for p in parts if p is not None):
        one = part.select(F.lit(i).alias("place"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def whole_document(matches: DataFrame, scan_time: str, dom: DataFrame | None = None, reflections: DataFrame | None = None) -> DataFrame:
    """(part, value): the lines of the JSON document with flows and reflections, part by part; the document's own fields only
    where there are neither."""
    parts = [envelope_lines(matches, scan_time).orderBy("place").select("value")]
    if dom is not None or reflections is not None:
        parts[0] = envelope_lines(matches, scan_time).orderBy("place").select(F.regexp_replace("value", r"^\]\}$", "]").alias("value"))
        for name, rows in (("dom_findings", dom), ("reflection_findings", reflections)):
            if rows is not None:
                parts += [matches.sparkSession.createDataFrame([(f',"{name}":[',)], "value string"), _listed(rows), matches.sparkSession.createDataFrame([("]",)], "value string")]
        parts.append(matches.sparkSession.createDataFrame([("}",)], "value string"))
    out = None
    for i, part in enumerate(parts):
        one = part.select(F.lit(i).alias("part"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def _listed(findings: DataFrame) -> DataFrame:
    """records() with a comma after all but the last."""
    last = findings.agg(F.max(F.struct((-severity_rank(F.col("severity"))).alias("r"), "fingerprint")).alias("last"))
    marked = findings.join(F.broadcast(last)).withColumn("__comma", F.struct((-severity_rank(F.col("severity"))).alias("r"), F.col("fingerprint")) != F.col("last")).drop("last")
    shown = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in marked.dtypes if c not in ("ord", "__comma")]
    return in_order(marked).select(F.concat(F.to_json(F.struct(*shown)), F.when(F.col("__comma"), ",").otherwise("")).alias("value"))


#: Levels of what a run says of itself; nothing goes to its results.
def narrator(level: int, write=None):
    """say(level, text) that writes the texts of at most this level, to standard error if nothing else is given."""
    import sys

    out = write or (lambda text: print(text, file=sys.stderr))
    return lambda at, text: out(f"[{at}] {text}") if at <= level else None
