"""HTTP headers in scripts: raw lines, entries of header maps, setter calls, indexed assignments and member calls.

A match's name is judged by its form. Setters and indexed assignments name the header map themselves. A bare entry
counts only inside a header map: one opened by an anchor before it, or an object whose direct entries give evidence
enough. Raw lines and member calls need a name that is a header wherever it stands. Positions are bytes of a line.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import lines
from .scripts import explode_with

#: Names that are headers wherever they stand.
DISTINCT = (
    "authorization", "proxy-authorization", "www-authenticate", "proxy-authenticate", "content-type", "content-length",
    "content-encoding", "content-disposition", "content-language", "content-range", "content-location", "content-md5",
    "accept-encoding", "accept-language", "accept-charset", "accept-ranges", "accept-patch", "cache-control", "if-match",
    "if-none-match", "if-modified-since", "if-unmodified-since", "if-range", "last-modified", "retry-after", "etag", "set-cookie",
    "cookie", "user-agent", "referer", "transfer-encoding", "keep-alive", "proxy-connection", "max-forwards", "dnt",
    "content-security-policy", "content-security-policy-report-only", "strict-transport-security", "referrer-policy",
    "permissions-policy", "feature-policy", "expect-ct", "upgrade-insecure-requests", "cross-origin-opener-policy",
    "cross-origin-embedder-policy", "cross-origin-resource-policy", "access-control-allow-origin",
    "access-control-allow-methods", "access-control-allow-headers", "access-control-allow-credentials",
    "access-control-expose-headers", "access-control-max-age", "access-control-request-method",
    "access-control-request-headers", "sec-fetch-mode", "sec-fetch-site", "sec-fetch-dest", "sec-fetch-user",
    "sec-websocket-key", "sec-websocket-accept", "sec-websocket-version", "sec-websocket-protocol",
)

#: Names of the custom shape that are directives, character sets or sizes.
NOT_CUSTOM = (
    "x-data", "x-show", "x-model", "x-modelable", "x-on", "x-bind", "x-if", "x-for", "x-text", "x-html", "x-init", "x-ref",
    "x-cloak", "x-effect", "x-ignore", "x-teleport", "x-spread", "x-transition", "x-cp1250", "x-cp1251", "x-cp1252", "x-cp1253",
    "x-cp1254", "x-cp1255", "x-cp1256", "x-cp1257", "x-cp1258", "x-mac-cyrillic", "x-mac-roman", "x-mac-ukrainian", "x-euc-jp",
    "x-sjis", "x-gbk", "x-big5", "x-x-big5", "x-user-defined", "x-unicode20utf8", "x-obsolete", "x-small", "x-large", "x-height",
    "x-axis",
)

#: Names of properties and methods that no form makes a header.
NEVER = (
    "enumerable", "configurable", "writable", "value", "get", "set", "prototype", "constructor", "__proto__", "append", "delete",
    "entries", "foreach", "has", "keys", "values",
)

#: Evidence of custom names, and bare words that are no values.
SECURITY = ("api-key", "apikey", "auth", "credential", "csrf", "secret", "signature", "token", "xsrf")
FAMILIES = (
    "x-amz-", "x-b3-", "x-client-", "x-contentful-", "x-correlation-", "x-datadog-", "x-firebase-", "x-forwarded-", "x-goog-",
    "x-launchdarkly-", "x-newrelic-", "x-nextjs-", "x-remix-", "x-request-", "x-sentry-", "x-service-", "x-tenant-", "x-trace-",
    "x-tt-", "x-user-", "x-wix-",
)
SCHEMES = ("basic ", "bearer ", "digest ", "token ")
NO_VALUE = ("case", "else", "function", "if", "null", "return", "switch", "undefined", "void")
FLAGS = ("!0", "!1", "false", "true")

#: The forms, in order, and the anchors of a header map.
_Q, _S = b"[\"'`]", rb"[\t\n\f\r ]"
_N = rb"([a-z][a-z0-9-]{2,62})"
_V = b"(\"[^\"\\r\\n]{1,256}\"|'[^'\\r\\n]{1,256}'|`[^`\\r\\n]{1,256}`|[^\\t\\n\\f\\r ,;{}()\\[\\]\"'`=][^\\t\\n\\f\\r ,;{}()\\[\\]\"'`]{0,255})"
_MAPS = rb"(?:headers|(?:my|request|response|default|extra|custom|common|http|auth|api|raw)[_-]?headers)"
RAW = re.compile(b"(?i)" + _Q + _N + b":[ \\t]*([^\"'`\\r\\n]{1,256})" + _Q)
PAIR = re.compile(b"(?i)" + _Q + rb"?\b" + _N + _Q + b"?" + _S + b"*:" + _S + b"*" + _V)
SETTER = re.compile(b"(?i)(?:set(?:Request)?Header|\\b" + _MAPS + rb"\b" + _S + rb"*\." + _S + b"*(?:set|append|add))" + _S + rb"*\(" + _S + b"*" + _Q + _N + _Q + _S + b"*," + _S + b"*" + _V)
INDEXED = re.compile(rb"(?i)\b" + _MAPS + rb"\b" + _S + rb"*(?:\." + _S + b"*[a-z]+" + _S + rb"*)?\[" + _S + b"*" + _Q + _N + _Q + _S + rb"*\]" + _S + b"*=" + _S + b"*" + _V)
MEMBER = re.compile(rb"(?i)\." + _S + b"*(?:set|append)" + _S + rb"*\(" + _S + b"*" + _Q + _N + _Q + _S + b"*," + _S + b"*" + _V)
ANCHOR = re.compile(rb"(?i)\b" + _MAPS + rb"\b" + _S + b"*[:=]" + _S + rb"*\{|\bnew" + _S + b"+headers" + _S + rb"*\(" + _S + rb"*\{")
#: How far before a name its anchor may stand, and how large an anonymous map may be.
ANCHOR_REACH, MAP_REACH = 256, 2048

_TOKEN = re.compile(rb"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|/\*.*?\*/|//|/\*|["'`{}()\[\]]""")
_BROKEN = (b'"', b"'", b"`", b"//", b"/*")

#: A line without any of these has no header of any form.
MAY_HOLD = "(?i)header|x-[a-z0-9]|" + "|".join(sorted(DISTINCT))


def custom(name: str) -> bool:
    return len(name) >= 5 and name not in NOT_CUSTOM and re.fullmatch(r"x-[a-z0-9]+(?:-[a-z0-9]+)*", name) is not None


def cleaned(value: bytes) -> str:
    v = value.decode("utf-8", "replace").strip().strip("\"'`").strip()
    for end in (r"\r\n", r"\n", r"\r"):
        v = v.removesuffix(end)
    return v.strip()


def _quoted(raw: bytes) -> bool:
    return raw.strip()[:1] in (b'"', b"'", b"`") and raw.strip() != b""


def useful(raw: bytes) -> bool:
    return raw.strip() != b"" and (_quoted(raw) or cleaned(raw).lower() not in NO_VALUE)


def _open_objects(text: bytes, start: int, end: int) -> list[int] | None:
    """Where the objects open at `end` begin, seen from start; None if a string or comment reaches over the end."""
    out: list[int] = []
    for m in _TOKEN.finditer(text, start, end):
        if m[0] in _BROKEN:
            return None
        if m[0] == b"{":
            out.append(m.start())
        elif m[0] == b"}" and out:
            out.pop()
    return out


def enclosing(text: bytes, at: int) -> tuple[int, int] | None:
    """The object of at most MAP_REACH bytes around a name: its first and last byte."""
    begin = max(0, at - MAP_REACH)
    end = at - 1 if at > begin and text[at - 1 : at] in (b'"', b"'", b"`") else at
    opened = _open_objects(text, begin, end)
    if not opened:
        return None
    depth = 0
    for m in _TOKEN.finditer(text, opened[-1], opened[-1] + MAP_REACH + 1):
        if m[0] in _BROKEN:
            return None
        depth += (m[0] == b"{") - (m[0] == b"}")
        if not depth and m[0] == b"}":
            return opened[-1], m.start()
    return None


def in_anchored_map(text: bytes, at: int) -> bool:
    """Whether the nearest anchor before a name opens a map that is still open there."""
    begin = max(0, at - ANCHOR_REACH)
    last = None
    for last in ANCHOR.finditer(text[begin:at]):  # noqa: B007
        pass
    if last is None:
        return False
    span, depth = text[begin + last.end() : at].rstrip(b"\"'`"), 1
    for m in re.finditer(rb"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|["'`{}()\[\]]""", span):
        if m[0] in (b'"', b"'", b"`"):
            return False
        depth += (m[0] in b"{([") - (m[0] in b"})]") if len(m[0]) == 1 else 0
        if depth <= 0:
            return False
    return True


def evidence(name: str, raw: bytes) -> int:
    """How much an entry of an anonymous object says that it is a map of headers: 2 is enough."""
    value = cleaned(raw).lower()
    if custom(name):
        return 2 if any(w in name for w in SECURITY) else int(name.startswith(FAMILIES))
    if name not in DISTINCT or not _quoted(raw) and value in FLAGS:
        return 0
    if name in ("authorization", "proxy-authorization"):
        return 2 * (value.startswith(SCHEMES) or "token" in value or "credential" in value)
    if name == "content-type":
        return int(any(w in value for w in ("/", "contenttype", "mime")))
    return int(_quoted(raw) or len(value) > 1)


def in_anonymous_map(text: bytes, at: int) -> bool:
    around = enclosing(text, at)
    if around is None:
        return False
    found: dict[str, int] = {}
    for m in PAIR.finditer(text[around[0] : around[1] + 1]):
        name = m[1].decode().lower()
        inner = enclosing(text, around[0] + m.start(1))
        if inner and inner[0] == around[0] and name not in NEVER and not found.get(name) and useful(m[2]):
            found[name] = evidence(name, m[2])
    return sum(found.values()) >= 2


def http_headers(line: str) -> list[str]:
    """Distinct `Name: value` of a line, form by form."""
    text, out = line.encode(), {}
    known = lambda name: name in DISTINCT or custom(name)
    for form in (RAW, PAIR, SETTER, INDEXED, MEMBER):
        for m in form.finditer(text):
            name = m[1].decode().lower()
            if name in NEVER or not useful(m[2]) or not cleaned(m[2]):
                continue
            at = m.start(1)
            if form in (SETTER, INDEXED) or (in_anchored_map(text, at) or in_anonymous_map(text, at) if form is PAIR else known(name)):
                out[f"{m[1].decode()}: {cleaned(m[2])}"] = None
    return list(out)


def scan_headers(artifacts: DataFrame, body: str = "body") -> DataFrame:
    """http_header in every line, as MATCH rows; low."""
    some = artifacts.where(F.col(body).rlike("[:(\\[]"))  # few bodies of prose, and one quick search
    each = lines(some, body).where(F.col("line").rlike("[:(\\[]") & F.col("line").rlike(MAY_HOLD))
    found = explode_with(each.select(F.struct("source", "ord", "line_no").alias("at"), "line"), "at", "line", http_headers, "value string")
    return found.select("at.source", F.lit("http_header").alias("pattern"), "value", F.lit("").alias("params"), F.lit("low").alias("severity"), "at.ord", "at.line_no")
