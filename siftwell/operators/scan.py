"""The rule scan: artifacts to lines to matches."""

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.regex import required_any, required_literal, required_some, to_java
from . import filters
from .rules import DEFAULT, Rule, default_rules

MATCH = ("source", "pattern", "value", "params", "severity", "ord", "line_no")


#: What every match of a rule without a plain literal contains, as a pattern that fails fast.
GATES = {"long_secret": "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32}", "ipv4": r"[0-9]\.[0-9]", "phone": "[0-9]{3}-[0-9]{3}-[0-9]{4}", "ipv6": ":[0-9a-fA-F]*:", "discord_bot_token": r"\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27}"}


def lines(artifacts: DataFrame, body: str = "body") -> DataFrame:
    """artifacts with line_no and line instead of the body; a carriage return before a line feed goes."""
    rest = [c for c in artifacts.columns if c != body]
    return artifacts.select(*rest, F.posexplode(F.split(F.col(body), "\r?\n")).alias("line_no", "line"))


def _hits(rule: Rule, line: Column) -> Column:
    gate = GATES.get(rule.name)
    found = _found(rule, line) if rule.keep is None else F.filter(_found(rule, line), rule.keep)
    return F.when(line.rlike(gate), found) if gate else found


def _found(rule: Rule, line: Column) -> Column:
    pattern = to_java(rule.pattern)
    if rule.name == "ipv4":
        return _ipv4(line, pattern)
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    if rule.name == "path":
        return _paths(line, pattern)
    if rule.secret_value:
        found = F.filter(found, filters.credential_like)
    if rule.name == "ipv6":
        found = F.filter(found, ipv6_like)
    literal = required_literal(rule.pattern)
    if literal is None:
        return found if rule.name in GATES else F.when(line.rlike(pattern), found)
    return F.when((F.lower(line) if literal[1] else line).contains(literal[0]), found)


def _around(line: Column, pattern: str) -> Column:
    """(hit, text before, text after) of each match, the texts reaching over the match next to it."""
    gaps, hits = F.split(line, pattern, -1), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))

    def one(h: Column, i: Column) -> Column:
        before = F.concat(F.coalesce(F.when(i > 0, F.get(hits, i - 1)), F.lit("")), F.get(gaps, i))
        after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit("")))
        return F.struct(h.alias("hit"), before.alias("before"), after.alias("after"))

    return F.when(line.rlike(pattern), F.transform(hits, one))


def _ipv4(line: Column, pattern: str) -> Column:
    """Dotted quads that border no dot and no other number."""
    kept = F.filter(_around(line, pattern), lambda s: ~s["before"].rlike(r"(?:\.|[0-9][ ,]?)\z") & ~s["after"].rlike(r"^(?:\.|[ ,]?[0-9])"))
    return F.transform(kept, lambda s: s["hit"])


def _paths(line: Column, pattern: str) -> Column:
    """Paths that no character of a regular expression follows."""
    kept = F.filter(_around(line, pattern), lambda s: filters.path_like(s["hit"]) & ~(s["hit"].contains("/") & s["after"].rlike(r"^[\\|$^*+(\[]")))
    return F.transform(kept, lambda s: s["hit"])


def ipv6_like(text: Column) -> Column:
    """A full or once shortened address of three groups and more that is no loopback, unspecified or mapped one."""
    t = F.btrim(text)
    groups = F.filter(F.split(t, ":"), lambda g: g != "")
    n = F.size(groups)
    short = t.contains("::") & (F.size(F.split(t, "::")) == 2)
    shape = F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}\\z"))
    edges = (~t.startswith(":") | t.startswith("::")) & (~t.endswith(":") | t.endswith("::"))
    return shape & edges & ~t.contains(":::") & F.when(short, n <= 7).otherwise((n == 8) & ~t.contains("::")) & (n >= 3) & ~F.coalesce(_zeros_then_one(groups), F.lit(False)) & ~_mapped(t, groups)


def _mapped(t: Column, groups: Column) -> Column:
    """Whether an address of eight groups, written out, starts with five zeros and ffff: one of the older protocol."""
    missing = F.greatest(8 - F.size(groups), F.lit(0))
    before = F.filter(F.split(F.substring_index(t, "::", 1), ":"), lambda g: g != "")
    full = F.when(t.contains("::"), F.concat(before, F.array_repeat(F.lit("0"), missing), F.slice(groups, F.size(before) + 1, F.size(groups) + 1))).otherwise(groups)
    return F.array_join(F.transform(full, lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", ""))), ":").rlike("^(?:0:){5}ffff:")


def _zeros_then_one(groups: Column) -> Column:
    value = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    return value.rlike("^0(?::0)*(?::1)?\\z")


def _words(rule: Rule) -> tuple[list[str], bool] | None:
    """Literals of which every match of the rule contains one, and whether their case is free."""
    some = required_some(rule.pattern)
    if some is None and (any_of := required_any(rule.pattern)):
        some = any_of, False
    return some


def _gate(rule: Rule, body: Column, lower: Column) -> Column:
    """What every body with a match of the rule fulfils, as far as that is cheap to see."""
    if rule.name in GATES:
        return body.rlike(GATES[rule.name])
    if rule.name == "path":
        return body.rlike(r"[/\\]")
    if (some := _words(rule)) is not None:
        return functools.reduce(Column.__or__, [(lower if some[1] else body).contains(x) for x in some[0]])
    # to a pattern without anchors the end of a line is like the end of a text, so what matches a line matches the body
    anchored = re.search(r"[\^$]|\\[AzZ]", re.sub(r"\\[^AzZ]|\[\^?\]?[^\]*\]", "", rule.pattern))
    return F.lit(True) if anchored else body.rlike(to_java(rule.pattern))


#: What plain prose is mostly without and most rules need: a line without it meets none of these rules, and one search tells.
MARK = r'[_@:/="\\0-9-]|\.[A-Za-z]|[A-Z]{2}'
#: Rules whose matches hold a mark beside their literal.
MARKED = {DEFAULT[n] for n in ("jwt", "aws_secret", "api_key", "token", "password", "hashicorp_vault_token")}


def _is_marked(rule: Rule) -> bool:
    """Whether every line with a match of the rule has a mark."""
    if rule.name in GATES or rule.name == "path":
        return rule.name != "long_secret"
    some = _words(rule)
    return rule.pattern in MARKED or some is not None and all(re.search(MARK, x) for x in some[0])


def _fits(rules: list[Rule], body: Column, whole: bool) -> Column:
    """Which rules can match in a body, by number; the rules that need a mark are looked for in the lines that have one."""
    marked = [_is_marked(r) for r in rules]
    pick = lambda text, of: let(F.lower(text), lambda lower: F.array_compact(F.array(*[F.when(_gate(r, text, lower), F.lit(i)) for i, r in enumerate(rules) if marked[i] == of])))
    text = body if whole else F.array_join(F.filter(F.split(body, "\n"), lambda x: x.rlike(MARK)), "\n")
    none = F.array().cast("array<int>")
    first = F.when(body.rlike(MARK), let(text, lambda t: pick(t, True))).otherwise(none) if any(marked) else none
    return F.concat(first, pick(body, False)) if not all(marked) else first


def scan(artifacts: DataFrame, rules: list[Rule] | None = None, body: str = "body", whole: bool = False) -> DataFrame:
    """Every match of every rule in every line, as MATCH rows; artifacts has source, ord and the body. With `whole` a body is
    one line, whatever it holds.

    One pass over a body tells which rules can match in it at all; its lines then meet those rules only, a row each.
    """
    rules = rules if rules is not None else default_rules()
    if not rules:
        return artifacts.select("source", *[F.lit("").alias(c) for c in MATCH[1:5]], "ord", F.lit(0).alias("line_no")).limit(0)
    text = artifacts.select("source", "ord", F.col(body).alias("body"))
    some = text.withColumn("fits", _fits(rules, F.col("body"), whole)).where(F.size("fits") > 0)
    if whole:
        parts = some.select("source", "ord", "fits", F.lit(0).alias("line_no"), F.col("body").alias("line"))
    else:
        parts = some.select("source", "ord", "fits", F.posexplode(F.split("body", "\r?\n")).alias("line_no", "line"))
    each = parts.where(F.col("line") != "").select("source", "ord", "line_no", "line", F.explode("fits").alias("rule"))
    found = None
    for i, r in enumerate(rules):
        hits = _hits(r, F.col("line"))
        found = F.when(F.col("rule") == i, hits) if found is None else found.when(F.col("rule") == i, hits)
    each = each.select("source", "ord", "line_no", "rule", F.explode(found).alias("value"))
    said = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))
    return each.select("source", said([r.name for r in rules]).alias("pattern"), "value", F.lit("").alias("params"), said([r.severity for r in rules]).alias("severity"), "ord", "line_no")


def scan_distinct(artifacts: DataFrame, rules: list[Rule] | None = None, body: str = "body") -> DataFrame:
    """As scan(), but each distinct body is scanned once and its matches are joined back to all its sources."""
    keyed = artifacts.withColumn("__sha", F.sha2(F.col(body).cast("binary"), 256))
    once = keyed.groupBy("__sha").agg(F.first(body).alias(body)).select(F.col("__sha").alias("source"), F.lit(0).cast("long").alias("ord"), body)
    found = scan(once, rules, body).withColumnRenamed("source", "__sha").drop("ord")
    return found.join(keyed.select("source", "ord", "__sha"), "__sha").select(*MATCH)


def entropy_matches(artifacts: DataFrame, least: float = 4.5, body: str = "body") -> DataFrame:
    """Runs of 20 and more base64 characters whose Shannon entropy reaches `least` bits; high."""
    hits = F.regexp_extract_all(F.col("line"), F.lit("[A-Za-z0-9+/=]{20,}"), F.lit(0))
    each = lines(artifacts, body).select("source", "ord", F.explode(F.array_distinct(hits)).alias("value"))
    return each.withColumn("entropy", shannon(F.col("value"))).where(F.col("entropy") >= least).select("source", F.lit("entropy").alias("pattern"), "value", F.lit("").alias("params"), F.lit("high").alias("severity"), "ord", "entropy")


def shannon(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def part(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / F.length(text)
        return -p * F.log2(p)

    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a + part(c))
