"""String values of scripts: quoted literals with their escapes read, and sums of literals.

Reading escapes needs a small parser, so it runs over whole bodies in Arrow batches; values that a body holds as they are need
no second scan, so only those put together or escaped go to the rules again, and bodies without a backslash or a plus
beside a quote never reach Python.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import Rule
from .scan import scan
from .scripts import explode_with

#: Literals, assignments, and the escapes of a literal in double quotes.
LITERAL = re.compile(r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^\\`])*`""")
ASSIGNED = re.compile(r"(?m)(?:var|let|const)\s+\w+\s*=\s*([^;\n]+)")
SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.))", re.S)
#: A body without any of these has no value that it does not hold as it is.
MAY_BUILD = r"""\\|["'`]\s*\+|\+\s*["'`]"""


def decoded(literal: str) -> str:
    """What a literal stands for. Escapes count in double quotes, and in single quotes around one character; where one is not
    known, in longer single quotes, and in a literal over several lines, only the quotes go."""
    bare = literal.strip("'\"`")
    inner, quote = literal[1:-1], literal[:1]
    if quote not in ('"', "'", "`") or literal[-1] != quote:
        return bare
    if quote == "`":
        return inner.replace("\r", "") if len(literal) > 1 and "`" not in inner else bare
    out = _unescaped(inner, quote) if len(literal) > 1 and "\n" not in inner else None
    return bare if out is None or quote == "'" and len(out) != 1 else out


def _unescaped(inner: str, quote: str) -> str | None:
    out, at, raw = bytearray(), 0, re.sub(ESCAPE, "", inner)
    if "\\" in raw or quote in raw:
        return None
    for m in ESCAPE.finditer(inner):
        out += inner[at : m.start()].encode()
        byte, short, long, octal, simple = m.groups()
        other = "'" if quote == '"' else '"'
        if simple is not None and (simple not in SIMPLE or simple == other):
            return None
        code = int(short or long, 16) if short or long else None
        if code is not None and (code > 0x10FFFF or 0xD800 <= code < 0xE000) or octal and int(octal, 8) > 255:
            return None
        out += bytes([int(byte, 16)]) if byte else bytes([int(octal, 8)]) if octal else (chr(code) if code is not None else SIMPLE[simple]).encode()
        at = m.end()
    return (out + inner[at:].encode()).decode("utf-8", "replace")


def _sum(expression: str) -> str | None:
    """The joined literals of a sum; it is cut at each plus, also inside a literal, and a part counts if a literal is in it."""
    parts = [p.strip() for p in expression.split("+")]
    return "".join(decoded(p) for p in parts) if all(LITERAL.search(p) for p in parts) else None


def values(text: str) -> list[str]:
    """Sorted distinct values of literals and of assigned sums."""
    found = {decoded(x) for x in LITERAL.findall(text)}
    return sorted(found | {s for x in ASSIGNED.findall(text) if (s := _sum(x)) is not None})


def reconstructed(text: str) -> list[str]:
    """Those values that the text does not hold as they are."""
    found = {v for x in LITERAL.findall(text) if "\\" in x and (v := decoded(x)) not in x}
    found |= {s for x in ASSIGNED.findall(text) if "+" in x and (s := _sum(x)) is not None}
    return sorted(v for v in found if v not in text)


def scan_values(artifacts: DataFrame, rules: list[Rule] | None = None, rebuilt: bool = True, body: str = "body") -> DataFrame:
    """The rules over the values of each artifact (source, ord, body) in place of its lines; one value is one line."""
    some = artifacts.where(F.col(body).rlike(MAY_BUILD)) if rebuilt else artifacts
    each = explode_with(some.select(F.struct("source", "ord").alias("at"), body), "at", body, reconstructed if rebuilt else values, "value string")
    lines = each.select("at.source", "at.ord", F.col("value").alias("body"))
    return scan(lines, rules, whole=True)
