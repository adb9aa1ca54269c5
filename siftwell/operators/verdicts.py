"""Verdicts over captured responses: signatures, catch-alls, methods, flows and reflections. Nothing is ever sent."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .reduce import fingerprint, first_per_class

_SPACE = r"[ \t\n\r\f\x0b]+"


def page_signature(status: Column, body: Column) -> Column:
    """status|words|lines."""
    words = F.size(F.filter(F.split(body, _SPACE), lambda w: w != ""))
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return F.concat_ws("|", status.cast("string"), words.cast("string"), lines.cast("string"))


def bucket(n: Column) -> Column:
    """Binary digits of a count; 0 for 0."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n.cast("long"))))


def structural_signature(body: Column) -> Column:
    """Sorted tag:bucket pairs; without tags the bucket of the length in bytes. One sort, then runs of equal tags."""

    def runs(tags: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(tags) - 1), lambda i: (i == 0) | (F.get(tags, i) != F.get(tags, i - 1)))
        return let(new, lambda at: F.array_join(F.transform(at, lambda i, k: F.concat(F.get(tags, i), F.lit(":"), bucket(F.coalesce(F.get(at, k + 1), F.size(tags)) - i).cast("string"))), ";"))

    found = F.array_sort(F.transform(F.regexp_extract_all(body, F.lit("(?i)<([a-z][a-z0-9]*)"), F.lit(1)), lambda t: F.lower(t)))
    return let(found, lambda tags: F.when(F.size(tags) == 0, F.concat(F.lit("len:"), bucket(F.octet_length(body)).cast("string"))).otherwise(runs(tags)))


def structural_cap(pages: DataFrame, host: str, body: str, order: str, k: int = 3) -> DataFrame:
    """The first k pages of each host and structural signature."""
    return first_per_class(pages.withColumn("signature", structural_signature(F.col(body))), [host, "signature"], [order], k)


def catch_all(control: DataFrame, keys: tuple[str, ...] = ("level", "shape"), least: int = 2) -> DataFrame:
    """(*keys, signature) that so many control responses and more share: what a place answers to anything.

    The keys tell what is learned: a level, a level and the shape of the name, a level and a method, or all three.
    """
    signed = control.withColumn("signature", page_signature(F.col("status"), F.col("body")))
    return signed.groupBy(*keys, "signature").count().where(F.col("count") >= least).drop("count")


def not_catch_all(pages: DataFrame, learned: DataFrame) -> DataFrame:
    """Pages (level, shape, signature, seed) that aren't what their level answers to anything; the seed stays."""
    plain = learned.where("shape = ''").select("level", "signature").distinct()
    shaped = learned.where("shape <> ''")
    rest = pages.where("not seed").join(plain, ["level", "signature"], "left_anti").join(shaped, ["level", "shape", "signature"], "left_anti")
    return pages.where("seed").unionByName(rest.select(pages.columns))


def working_methods(probes: DataFrame, learned: DataFrame) -> DataFrame:
    """(url, method): 2xx or 3xx that is no catch-all; where GET works, no OPTIONS and nothing that answers as GET does."""
    signed = probes.withColumn("signature", page_signature(F.col("status"), F.col("body"))).where("status >= 200 and status < 400")
    ok = signed.join(learned.select("level", "method", "signature"), ["level", "method", "signature"], "left_anti")
    get = ok.where("method = 'GET'").select("url", F.col("signature").alias("get"))
    both = ok.join(get, "url", "left")
    return both.where("get is null or method = 'GET' or (method <> 'OPTIONS' and signature <> get)").select("url", "method")


def gathered(methods: DataFrame, params: DataFrame) -> DataFrame:
    """(url, summary): methods=GET,POST and the parameters of the address."""
    m = methods.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct((F.col("method") != "GET").alias("o"), F.col("method").alias("m")))), lambda x: x["m"]), ",").alias("m"))
    both = m.join(params, "url", "left")
    return both.select("url", F.concat(F.lit("methods="), F.col("m"), F.when(F.coalesce("params", F.lit("")) != "", F.concat(F.lit(" params="), F.col("params"))).otherwise("")).alias("summary"))


def replay_changed(probes: DataFrame) -> DataFrame:
    """(url, method) whose answer with parameters differs from the one without."""
    signed = probes.withColumn("signature", page_signature(F.col("status"), F.col("body")))
    bare = signed.where("not with_params").select("url", "method", F.col("signature").alias("bare"))
    return signed.where("with_params").join(bare, ["url", "method"]).where("signature <> bare").select("url", "method").distinct()


def flow_verdict(context: Column, confirmed: Column) -> Column:
    """(severity, confidence) of a flow into a sink."""
    pair = lambda s, c: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    return (
        F.when(confirmed, pair("high", "certain")).when(context.isin("js", "script-url"), pair("high", "high"))
        .when(context.isin("html", "attribute"), pair("medium", "high")).when(context == "url", pair("low", "high")).otherwise(pair("low", "medium"))
    )


def flow_fingerprint(*parts: Column) -> Column:
    return fingerprint(*parts)


def interesting_messages(rows: DataFrame) -> DataFrame:
    """Message findings with a listener, a sink or a send across origins; findings of other kinds stay."""
    return rows.where("kind <> 'web_message' or listener_count > 0 or reaches_sink or cross_origin")


def _last(text: Column, needle: str) -> Column:
    """Where the needle begins last; 0 if nowhere."""
    at = F.instr(F.reverse(text), needle[::-1])
    return F.when(at > 0, F.length(text) - at - len(needle) + 2).otherwise(0)


def reflection_context(body: Column, position: Column) -> Column:
    """Where a marker at a 1-based position stands: comment, script, attribute or text."""
    before = F.left(F.lower(body), position - 1)
    tag = F.regexp_replace(before, "<script(?![ >\\t\\n\\r]|\\z)", "<other_")
    return (
        F.when(_last(before, "<!--") > _last(before, "-->"), "html_comment").when(_last(tag, "<script") > _last(before, "</script"), "script")
        .when(_last(before, "<") > _last(before, ">"), "html_attr").otherwise("html_text")
    )


def unfiltered(middle: Column) -> Column:
    """The characters of markup and quotes that came back as they were."""
    return F.filter(F.array(*[F.lit(c) for c in "<>\"'`"]), lambda c: F.contains(middle, c))


def reflection_verdict(context: Column, chars: Column) -> Column:
    """(severity, confidence, verdict) of a reflection."""
    has = lambda *cs: F.arrays_overlap(chars, F.array(*[F.lit(c) for c in cs]))
    say = lambda s, c, v: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("confidence"), F.lit(v).alias("verdict"))
    breaks, kept = say("medium", "high", "worth_review"), say("low", "medium", "likely_benign")
    return (
        F.when(context == "script", F.when(has('"', "'", "`"), breaks).otherwise(say("low", "medium", "worth_review")))
        .when(context == "html_text", F.when(has("<") & has(">"), breaks).otherwise(kept))
        .when(context == "html_attr", F.when(has('"', "'"), breaks).otherwise(kept))
        .when(context == "html_comment", F.when(has("<") & has(">"), say("low", "medium", "worth_review")).otherwise(say("info", "medium", "likely_benign")))
        .otherwise(say("low", "low", "worth_review"))
    )


def beyond_control(found: DataFrame, control: DataFrame) -> DataFrame:
    """Reflections (route, param, context, chars) that the control of their route doesn't show as well."""
    c = control.select("route", "context", F.col("chars").alias("shown"))
    covered = found.join(c, ["route", "context"], "left").where(F.col("shown").isNotNull() & (F.size(F.array_except("chars", "shown")) == 0))
    return found.join(covered.select("route", "param", "context").distinct(), ["route", "param", "context"], "left_anti")
