"""What scripts send: requests by POST, header names, source hints, and values put together from literals.

These walk balanced brackets, which no regular expression does; each takes whole bodies in Arrow batches.
"""

import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

_PAIRS = {"(": ")", "[": "]", "{": "}"}


def balanced(text: str, start: int) -> str:
    """The expression at start: a bracket up to its counterpart, or all up to the next comma or closing bracket; strings
    count as one."""
    stack, quote, i = [], "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in _PAIRS:
            stack.append(_PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack and text[start] in _PAIRS:
                return text[start : i + 1]
        elif not stack and c in ",)]};":
            break
        i += 1
    return text[start:i].strip()


#: Where a script names an input, by kind: addresses, reads of parameters, storage and cookies, bodies.
_Q, _WORD = "[\"'`]", r"[A-Za-z_$][A-Za-z0-9_$]*"
IN_QUERY = re.compile(r"[?&]([A-Za-z_$][A-Za-z0-9_$@.\-\[\]]{0,127})=")
PARAM_READ = re.compile(rf"(?i)\b({_WORD})\s*\.\s*(?:get|getAll|has)\s*\(\s*{_Q}([A-Za-z_$][A-Za-z0-9_$@.\-\[\]]{{0,127}}){_Q}")
PARAM_NAMES = (re.compile(rf"(?i)\b(?:const|let|var)\s+({_WORD})\s*=\s*(?:new\s+URLSearchParams\b|[^;\n]{{0,120}}\buseSearchParams\s*\()"), re.compile(rf"(?i)\b(?:const|let|var)\s*\[\s*({_WORD})[^\]]*\]\s*=\s*\buseSearchParams\s*\("))
ROUTED = (
    re.compile(r"(?i)\b(?:router|route|searchParams|queryParams)\s*\.\s*(?:query\s*\.\s*)?([A-Za-z_$][A-Za-z0-9_$@.\-]{0,127})"),
    re.compile(rf"(?i)\b(?:router|route|searchParams|queryParams)(?:\s*\.\s*query)?\s*\[\s*{_Q}([A-Za-z_$][A-Za-z0-9_$@.\-\[\]]{{0,127}}){_Q}\s*\]"),
)
STORED = tuple((kind, re.compile(rf"(?i)\b(?:window\s*\.\s*)?{name}\s*(?:\.\s*(?:getItem|setItem|removeItem)\s*\(\s*|\[\s*){_Q}([^\"'`]{{1,128}}){_Q}")) for kind, name in (("local_storage", "localStorage"), ("session_storage", "sessionStorage")))
COOKIE_READ = re.compile(rf"(?i)\b(?:Cookies|cookieStore)\s*\.\s*(?:get|has)\s*\(\s*{_Q}([^\"'`]{{1,128}}){_Q}")
JSON_BODY = re.compile(r"(?is)\bJSON\s*\.\s*stringify\s*\(\s*\{([^{}]{0,1000})\}\s*\)")
BODY_KEY = re.compile(rf"(?i)\b(?:formData|body|payload|params)\s*\.\s*(?:append|set)\s*\(\s*{_Q}([^\"'`]{{1,128}}){_Q}")
OBJECT_KEY = re.compile(r"""(?:^|[{,]\s*)(?:["']([^"']{1,128})["']|([A-Za-z_$][A-Za-z0-9_$@.\-]{0,127}))\s*:""")
URL_HINT, ACCESS_HINT, REQUEST_HINT = "javascript_url", "javascript_access", "javascript_request"
LONGEST_EXPRESSION = 16 << 10

#: A body without any of these names no input.
MAY_HINT = r"(?i)[?&][A-Za-z_$][^=\s]{0,127}=|\.\s*(?:get|getAll|has)\s*\(|router|route\b|searchParams|queryParams|Storage|JSON\s*\.\s*stringify|\.\s*(?:append|set)\s*\("


def expression_names(raw: str) -> list[str]:
    """Sorted names of parameters in a body's expression, its first 16 KiB: of a query, and keys of objects."""
    text = raw.strip()[:LONGEST_EXPRESSION]
    found = set(IN_QUERY.findall("?" + text.removeprefix("?"))) | {a or b for a, b in OBJECT_KEY.findall(text)} if text else set()
    return sorted(x for x in found if valid_hint(x))


def query_names(url: str) -> list[str]:
    """Sorted names in the query of an address."""
    query = url.strip().partition("#")[0].partition("?")[2]
    names = {unquote_plus(x.split("=", 1)[0]) for x in query.split("&") if x and ";" not in x}
    return sorted(x for x in names if valid_hint(x))


def source_hints(text: str) -> list[tuple[str, str, str]]:
    """Distinct (kind, name, provenance) of the inputs that a script reads."""
    from .posts import post_requests

    out: dict[tuple[str, str, str], None] = {}

    def add(kind: str, names, where: str) -> None:
        out.update(dict.fromkeys((kind, n, where) for n in names if valid_hint(n)))

    readers = {"searchparams", "urlsearchparams", "queryparams"} | {x.lower() for p in PARAM_NAMES for x in p.findall(text)}
    reads = [name for who, name in PARAM_READ.findall(text) if who.lower() in readers or any(w in who.lower() for w in ("search", "query", "param"))]
    add("url_query", IN_QUERY.findall(text), URL_HINT)
    add("url_query", reads + [x for p in ROUTED for x in p.findall(text) if x.lower() not in ("query", "get", "has")], ACCESS_HINT)
    for kind, p in STORED:
        add(kind, p.findall(text), ACCESS_HINT)
    add("cookie", COOKIE_READ.findall(text), ACCESS_HINT)
    add("url_query", [n for x in JSON_BODY.findall(text) for n in expression_names(x)] + BODY_KEY.findall(text), REQUEST_HINT)
    for url, params in post_requests(text):
        add("url_query", query_names(url), URL_HINT)
        add("url_query", expression_names(params), REQUEST_HINT)
    return list(out)


def scan_hints(artifacts: DataFrame, body: str = "body") -> DataFrame:
    """(source, kind, name, provenance) of script artifacts."""
    return explode_with(artifacts.where(F.col("is_js") & F.col(body).rlike(MAY_HINT)), "source", body, source_hints, "kind string, name string, provenance string")


def valid_hint(name: str) -> bool:
    return 0 < len(name.encode()) <= 128 and not re.search(r"[\x00-\x20\x7f&=#?/%\\\"'`]", name)


def valid_hint_name(name: Column) -> Column:
    return (name != "") & (F.octet_length(name) <= 128) & ~name.rlike("[\\x00-\\x20\\x7f&=#?/%\\\\\"'`]")


def explode_with(df: DataFrame, key: str, body: str, function, fields: str) -> DataFrame:
    """(key, fields) with one row for each tuple that function gives for a body; a null body gives none."""
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for k, b in zip(batch.column(key).to_pylist(), batch.column(body).to_pylist(), strict=True):
                if b is not None:
                    rows += [(k, *(x if isinstance(x, tuple) else (x,))) for x in function(b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.select(key, body).mapInArrow(run, schema)


def snippet(body: Column, value: Column, radius: int = 200) -> Column:
    """The first occurrence of a value with so many bytes around it, dots where the text goes on; null if it is not there."""
    raw, sought = body.cast("binary"), value.cast("binary")
    before = F.octet_length(F.call_function("substring_index", body, value, F.lit(1)))
    start = F.greatest(before - radius, F.lit(0))
    stop = F.least(before + F.octet_length(sought) + radius, F.octet_length(raw))
    # a character that the window cuts reads as replacement marks, which go
    text = F.regexp_replace(F.substring(raw, start + F.lit(1), stop - start).cast("string"), "^\ufffd+|\ufffd+\\z", "")
    return F.when(F.contains(body, value), F.concat(F.when(start > 0, "…").otherwise(""), text, F.when(stop < F.octet_length(raw), "…").otherwise("")))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or the time until an HTTP date; null if neither, 0 at least."""
    seconds = value.try_cast("long")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0))), F.when(date.isNotNull(), F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0))))
