"""Predicates against false positives, as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import let

#: Words that are never secrets.
NEVER_SECRET = (
    "function", "undefined", "prototype", "constructor", "arguments", "boolean", "default", "disabled", "readonly", "required",
    "autofocus", "placeholder", "autocomplete", "nodename", "nodetype", "innerhtml", "classname", "children", "current", "password",
    "username", "checkbox", "textarea", "onchange", "onsubmit", "returnvalue", "stringify", "typeof", "instanceof", "tostring",
    "valueof", "element", "document", "location", "navigator", "properties", "object", "array", "string", "number", "symbol",
    "promise", "error", "window", "global", "buffer", "regexp", "weakmap", "weakset", "reflect", "proxy",
)

#: Member names that make a one-segment path a script fragment.
MEMBERS = (
    "test", "exec", "call", "apply", "bind", "then", "catch", "finally", "join", "split", "match", "matchall", "replace", "replaceall",
    "slice", "splice", "substr", "substring", "push", "pop", "shift", "unshift", "concat", "indexof", "lastindexof", "includes",
    "foreach", "filter", "reduce", "reduceright", "keys", "values", "entries", "find", "findindex", "findlast", "some", "every",
    "sort", "reverse", "flat", "flatmap", "fill", "copywithin", "trim", "trimstart", "trimend", "padstart", "padend", "repeat",
    "normalize", "charat", "charcodeat", "codepointat", "startswith", "endswith", "tolowercase", "touppercase", "tostring",
    "valueof", "hasownproperty", "isprototypeof", "tofixed", "toprecision", "prototype", "constructor",
)

#: Hosts of documentation and libraries.
NOISE_HOSTS = (
    "w3.org", "react.dev", "reactjs.org", "vuejs.org", "angular.io", "github.com", "githubusercontent.com", "github.io",
    "gitlab.com", "npmjs.com", "nodejs.org", "jquery.com", "lodash.com", "momentjs.com", "quilljs.com", "mozilla.org",
    "schema.org", "json-schema.org", "gnu.org", "apache.org", "opensource.org", "creativecommons.org",
)

#: Extensions that no crawl follows.
ASSETS = (
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "tiff", "woff", "woff2", "ttf", "eot", "otf", "mp4", "webm", "mp3",
    "wav", "ogg", "avi", "mov", "mkv", "zip", "gz", "tar", "rar", "7z", "bz2", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
)


#: Types of bodies that hold no text.
BINARY_TYPES = (
    "application/pdf", "application/zip", "application/gzip", "application/x-gzip", "application/x-tar", "application/x-bzip2",
    "application/x-rar-compressed", "application/x-7z-compressed", "application/vnd.ms-fontobject", "application/x-font-ttf",
    "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint",
)


def credential_value(match: Column) -> Column:
    """The word after the first : or = of a match."""
    return F.regexp_extract(match, "^[^:=]*[:=][ \\t\"'`]*([A-Za-z0-9_-]*)", 1)


def secret_like(value: Column) -> Column:
    """Six bytes and more, no common word, no words joined by hyphens."""
    plain = lambda v: (F.octet_length(v) >= 6) & ~F.lower(v).isin(*NEVER_SECRET) & ~v.rlike("^[a-z]+(?:-[a-z]+)+\\z")
    return let(F.btrim(value, F.lit("\"'` ")), plain)


def credential_like(match: Column) -> Column:
    return secret_like(credential_value(match))


def path_like(match: Column) -> Column:
    """No metacharacter or regex escape, no lone member access, and a segment of two bytes and more with a letter."""
    s = F.btrim(match, F.lit(" \t\n\f\r\x0b"))
    parts = F.filter(F.transform(F.split(s, r"[\\]"), lambda x: F.btrim(x)), lambda x: x != "")
    parts = F.when(s.contains("\\"), parts).otherwise(F.filter(F.transform(F.split(s, "/"), lambda x: F.btrim(x)), lambda x: x != ""))
    member = F.lower(F.substring_index(F.get(parts, F.lit(0)), ".", -1)).isin(*MEMBERS) & F.get(parts, F.lit(0)).contains(".")
    plain = ~s.rlike(r"""["'()\[\]{}<>*+?]""") & ~s.rlike(r"\\[swdb./]")
    return (s != "") & plain & ~(F.coalesce(member, F.lit(False)) & (F.size(parts) == 1)) & F.exists(parts, lambda x: (F.octet_length(x) >= 2) & x.rlike("[A-Za-z]"))


def host_name(host: Column) -> Column:
    """Two labels and more of lower-case letters, digits and hyphens, the last of two letters and more."""
    return host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}\z")


_NOISE = r"(?:^|\.)(?:" + "|".join(n.replace(".", r"\.") for n in NOISE_HOSTS) + r")\z"
_DOTTED = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"


def endpoint_url(url: Column) -> Column:
    """An address with a real host: no loopback, local or noise name."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"[\[\]]", ""))
    named = lambda h: host_name(h) & ~h.endswith(".local") & ~h.rlike(_NOISE)
    real = lambda h: F.when(h.rlike(_DOTTED), ~h.startswith("127.") & (h != "0.0.0.0")).otherwise(named(h))
    return ~url.contains("...") & let(host, real)


def endpoint_path(path: Column) -> Column:
    """A rooted, ./ or ../ path, or one of several segments, without empty or dot segments and metacharacters."""
    rest = F.when(path.startswith("../"), F.substring(path, 3, 1 << 30)).when(path.startswith("./"), F.substring(path, 2, 1 << 30)).otherwise(path)
    parts = F.split(F.btrim(rest, F.lit("/")), "/")
    shape = F.when(rest.startswith("/"), rest.rlike("^/[A-Za-z0-9_~-]")).otherwise(rest.contains("/") & rest.rlike("^[A-Za-z0-9_~-]"))
    return (path != "") & ~path.rlike("[<>()\\[\\]{}\\\\*,&|^$`\"' \\t]") & ~path.endswith(".") & shape & F.forall(parts, lambda x: ~x.isin("", ".", ".."))


def crawlable(path: Column) -> Column:
    """Whether the last segment of a URL's path has no extension of an asset."""
    ext = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"\.([^.]*)\z", 1))
    return ~ext.isin(*ASSETS)


def same_scope(base: Column, other: Column) -> Column:
    """Equal hosts, or a host below the base, www. aside."""
    b, o = (F.regexp_replace(F.lower(x), r"^www\.", "") for x in (base, other))
    return (o == b) | o.endswith(F.concat(F.lit("."), b))


def template_placeholder(text: Column) -> Column:
    return text.rlike("[{}<>]")


def binary_content_type(content_type: Column) -> Column:
    """Media, fonts and archives; an empty type and octet-stream stay."""
    t = F.lower(F.btrim(F.substring_index(content_type, ";", 1)))
    return t.rlike("^(?:image|audio|video|font)/") | t.isin(*BINARY_TYPES)
