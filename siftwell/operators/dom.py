"""Findings of instrumented pages and of reflected parameters: their rows, verdicts, identities and merging.

All work on captured observations; nothing is probed. Raw observations have kind, sink, argument, context, value,
probe_id, source_kind, source_name, discovered, transform, stack, url and message, the last two null where there is none.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import urls, verdicts
from .reduce import first_per_class, severity_rank

#: Source and sink families, names for several, and ranks of confidence.
SOURCES = ("url_query", "url_fragment", "referrer", "window_name", "form_input", "cookie", "local_storage", "session_storage", "web_message")
SINKS = ("innerHTML", "outerHTML", "insertAdjacentHTML", "document.write", "srcdoc", "eval", "Function", "setTimeout", "script.src", "navigation", "event-handler")
ALIASES = {"url_full": ("url_query", "url_fragment"), "location": ("url_query", "url_fragment")}
CONFIDENCES = ("certain", "high", "medium", "low")
PREVIEW, EXCERPT = 160, 40
#: How the tokens of a capture begin; hexadecimal digits follow.
MARK = "probe"
FRAME = "array<struct<function:string,url:string,line:int,column:int>>"


def chosen_sources(names: list[str]) -> list[str]:
    """Families that a list of names and aliases stands for, in the order of SOURCES; an unknown name is an error."""
    wanted = {y for x in names for y in ALIASES.get(x, (x,))}
    if unknown := wanted - set(SOURCES):
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return [s for s in SOURCES if s in wanted]


def preview(value: Column) -> Column:
    """A value of at most PREVIEW bytes, dots where it goes on."""
    cut = F.regexp_replace(F.substring(value.cast("binary"), 1, PREVIEW).cast("string"), "�+\\z", "")
    return F.when(F.octet_length(value) > PREVIEW, F.concat(cut, F.lit("…"))).otherwise(value)


def scheme_or_https(url: Column) -> Column:
    return F.when(urls.scheme(url) != "", urls.scheme(url)).otherwise("https")


def site(url: Column) -> Column:
    return F.when(urls.authority(url) != "", F.concat(urls.scheme(url), F.lit("://"), urls.authority(url))).otherwise(url)


def route(url: Column) -> Column:
    return F.when(urls.path(url) != "", urls.path(url)).otherwise("/")


def confidence_rank(confidence: Column) -> Column:
    plain, out = F.lower(F.trim(confidence)), F.lit(0)
    for i, c in enumerate(reversed(CONFIDENCES)):
        out = F.when(plain == c, i + 1).otherwise(out)
    return out


def markers(values: DataFrame, tokens: DataFrame, mark: str = MARK) -> DataFrame:
    """(id, value) with each of the tokens (token, kind, name) that is in the value, as it is or once percent-decoded.

    Tokens are cut out of the value and met by equality, so neither side grows with the other.
    """
    found = lambda text: F.regexp_extract_all(text, F.lit(rf"{mark}[0-9a-f]+"), F.lit(0))
    decoded = F.coalesce(F.try_url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), F.col("value"))
    each = values.select("id", F.explode(F.concat(
        F.transform(F.array_distinct(found(F.col("value"))), lambda t: F.struct(t.alias("token"), F.lit("").alias("transform"))),
        F.transform(F.array_except(F.array_distinct(found(decoded)), found(F.col("value"))), lambda t: F.struct(t.alias("token"), F.lit("url_decoded").alias("transform"))),
    )).alias("m"))
    return each.select("id", "m.token", "m.transform").join(tokens, "token")


def locations(frames: Column) -> Column:
    """url:line:column of the frames that have an address."""
    some = F.filter(F.coalesce(frames, F.array().cast(FRAME)), lambda f: f["url"] != "")
    return F.transform(some, lambda f: F.concat_ws(":", f["url"], f["line"].cast("string"), f["column"].cast("string")))


def _terminated(*parts: Column) -> Column:
    return F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f")) for p in parts])


def _digest(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(32))


def identity(f: dict[str, Column]) -> Column:
    """The fingerprint of a finding: its type, site, source, sink, context and code; the page only where no code is known."""
    listeners = F.array_join(F.array_sort(F.array_distinct(locations(f["message"]["listener_locations"]))), "|")
    script = F.coalesce(F.get(locations(f["stack"]), F.lit(0)), F.lit(""))
    known = F.when(f["message"].isNotNull(), listeners != "").otherwise(script != "")
    message = F.when(listeners != "", F.concat(F.lit("listeners:"), listeners)).when(F.coalesce(f["message"]["sent_to"], F.lit("")) != "", F.concat(F.lit("leak:"), f["message"]["sent_to"])).otherwise(f["message"]["identity"])
    none = F.lit("")
    text = F.concat(
        _terminated(f["type"], site(f["target"])),
        F.when(known, none).otherwise(_terminated(F.lit("page"), route(f["page_url"]), f["frame_url"])),
        F.when(f["source_kind"].isNull(), none).otherwise(_terminated(F.lit("src"), f["source_kind"], f["source_name"])),
        F.when(f["sink"].isNull(), none).otherwise(_terminated(F.lit("sink"), f["sink"], f["argument"])),
        _terminated(F.lit("ctx"), f["context"], F.lit("loc"), script),
        F.when(f["message"].isNull(), none).otherwise(_terminated(F.lit("msg"), message)),
    )
    return _digest(text)


def triage(f: dict[str, Column]) -> Column:
    """(verdict, reason) of a finding from the evidence it has; only controlled execution is confirmed."""
    say = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason") if isinstance(reason, Column) else F.lit(reason).alias("reason"))
    m, u = f["message"], f["url"]
    message = (
        F.when(m["reaches_sink"], say("worth_review", "message data reached a security-sensitive sink"))
        .when(F.coalesce(m["sent_to"], F.lit("")) != "", say("worth_review", "URL-derived data was sent to a cross-origin message target"))
        .when((m["listener_count"] > 0) & ~m["origin_checked"], say("worth_review", "a message listener consumed data without visible origin validation; review where the data flows"))
        .when(m["probe_generated"], say("likely_benign", "scanner probe was observed, but its data did not reach a security-sensitive sink"))
        .otherwise(say("info", "message activity was observed without a security-sensitive effect"))
    )
    part = F.concat(F.lit("direct destination stayed same-origin and the marker remained in the URL "), u["component"])
    link = (
        F.when(~F.coalesce(u["resolved"], F.lit(False)), say("worth_review", "controllable data reached a navigation target whose destination could not be classified"))
        .when(u["executable"], say("worth_review", "navigation resolved to an executable URL scheme; execution was not confirmed"))
        .when(~u["same_origin"], say("worth_review", "controllable data reached a cross-origin navigation target"))
        .when(u["component"].isin("query", "fragment"), say("likely_benign", part))
        .otherwise(say("likely_benign", "direct destination stayed same-origin and no executable scheme was observed"))
    )
    flow = (
        F.when(f["context"].isin("js", "script-url"), say("worth_review", "controllable data reached a JavaScript execution context"))
        .when(f["context"].isin("html", "attribute"), say("worth_review", "controllable data reached a markup-capable context; execution was not confirmed"))
        .when(f["context"] == "url", link)
        .otherwise(say("worth_review", "controllable data reached a security-sensitive browser API"))
    )
    return (
        F.when(f["confirmed"], say("confirmed", "controlled execution was confirmed")).when((f["type"] == "web_message") & m.isNotNull(), message)
        .when(f["type"] == "dom_flow", flow).otherwise(say("info", "sink activity was observed without evidence of attacker control"))
    )


MESSAGE = "struct<listener_count:int,origin_checked:boolean,origin_checked_listeners:int,source_checked:boolean,source_checked_listeners:int,data_shape:string,reaches_sink:boolean,probe_generated:boolean,sent_to:string,identity:string,listener_locations:array<struct<function:string,url:string,line:int,column:int>>>"
URL = "struct<resolved:boolean,scheme:string,same_origin:boolean,component:string,executable:boolean>"
RAW = f"target string, page_url string, frame_url string, frame_path string, kind string, sink string, argument int, context string, value string, probe_id string, source_kind string, source_name string, discovered array<string>, transform string, trigger string, phase string, interaction string, stack {FRAME}, url {URL}, message {MESSAGE}"
KEPT = ("target", "page_url", "frame_url", "frame_path", "type", "context", "value_preview", "sink", "argument", "source_kind", "source_name", "discovered", "probe_id", "transform", "trigger", "phase", "interaction", "stack", "url", "message", "confirmed", "severity", "confidence")


def mapped(raw: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Finding rows of raw observations; a flow whose probe ran, listed in confirmed (probe_id), is confirmed."""
    if confirmed is not None:
        raw = raw.join(confirmed.select("probe_id", F.lit(True).alias("__ran")).distinct(), "probe_id", "left")
    ran = F.coalesce(F.col("__ran"), F.lit(False)) if confirmed is not None else F.lit(False)
    kind, m = F.col("kind"), F.col("message")
    flow, message = kind == "flow", kind == "message"
    sure = flow & (F.coalesce("probe_id", F.lit("")) != "") & ran
    judged = verdicts.flow_verdict(F.col("context"), sure)
    telling = m["reaches_sink"] | (F.coalesce(m["sent_to"], F.lit("")) != "") | ((m["listener_count"] > 0) & ~m["origin_checked"])
    only = lambda when, c: F.when(when, F.col(c))
    out = raw.select(
        "target", "page_url", F.when(F.coalesce("frame_url", F.lit("")) == "", F.col("page_url")).otherwise(F.col("frame_url")).alias("frame_url"), "frame_path",
        F.when(flow, "dom_flow").when(message, "web_message").otherwise("dom_sink").alias("type"), F.coalesce("context", F.lit("")).alias("context"), preview(F.col("value")).alias("value_preview"),
        only(flow | (kind == "sink"), "sink").alias("sink"), only(flow | (kind == "sink"), "argument").alias("argument"), only(flow, "source_kind").alias("source_kind"), only(flow, "source_name").alias("source_name"),
        F.when(flow, F.array_sort(F.array_distinct(F.coalesce("discovered", F.array().cast("array<string>"))))).alias("discovered"), only(flow, "probe_id").alias("probe_id"), "transform", "trigger", "phase",
        F.when(flow & (F.col("trigger") != "page_load"), F.col("interaction")).alias("interaction"), "stack", only(flow, "url").alias("url"), only(message, "message").alias("message"),
        sure.alias("confirmed"),
        F.when(flow, judged["severity"]).when(message & telling, "low").otherwise("info").alias("severity"),
        F.when(flow, judged["confidence"]).when(message | (kind == "sink"), "medium").otherwise("low").alias("confidence"),
    )
    return assessed(out)


def assessed(findings: DataFrame) -> DataFrame:
    f = {c: F.col(c) for c in findings.columns}
    return findings.withColumns({"triage": triage(f), "fingerprint": identity(f)})


def confirm(findings: DataFrame, probes: DataFrame) -> DataFrame:
    """Findings with the flows of these probes (probe_id, context) confirmed: high and certain, in the context that ran."""
    ran = probes.select("probe_id", F.col("context").alias("__context")).groupBy("probe_id").agg(F.min("__context").alias("__context"))
    hit = F.col("__context").isNotNull() & (F.col("type") == "dom_flow")
    met = findings.drop("triage", "fingerprint").join(ran, "probe_id", "left")
    context = F.when(hit & (F.col("__context") != ""), F.col("__context")).otherwise(F.col("context"))
    out = met.withColumns({"severity": F.when(hit, "high").otherwise(F.col("severity")), "confidence": F.when(hit, "certain").otherwise(F.col("confidence")), "confirmed": hit | F.col("confirmed"), "context": context})
    return assessed(out.select(*KEPT))


def first_given(column: str) -> Column:
    """Of a group the value of the first row in order that has one."""
    some = (F.col(column).isNotNull()) & (F.col(column) != "")
    return F.min_by(F.when(some, F.col(column)), F.when(some, F.col("ord"))).alias(column)


def primary_trigger(triggers: Column) -> Column:
    has = lambda t: F.array_contains(triggers, t)
    return F.when(has("post_message"), "post_message").when(has("interaction"), "interaction").when(has("page_load"), "page_load").otherwise(F.coalesce(F.get(triggers, F.lit(0)), F.lit("")))


def merged(findings: DataFrame) -> DataFrame:
    """Findings (mapped() rows with ord) merged by fingerprint: the least page with its frame, the strongest severity and
    confidence, all triggers, the first value, stack and message evidence given, the routes where there are several; judged anew."""
    m = F.col("message")
    seen = F.when(m.isNotNull(), F.col("ord"))
    given = lambda c: F.min_by(F.when(m[c] != "", m[c]), F.when(m[c] != "", F.col("ord")))
    either = lambda c: F.coalesce(F.bool_or(m[c]), F.lit(False)).alias(c)
    placed = F.size(m["listener_locations"]) > 0
    message = F.struct(
        F.max(m["listener_count"]).alias("listener_count"), either("origin_checked"), F.max(m["origin_checked_listeners"]).alias("origin_checked_listeners"), either("source_checked"),
        F.max(m["source_checked_listeners"]).alias("source_checked_listeners"), F.coalesce(given("data_shape"), F.lit("")).alias("data_shape"), either("reaches_sink"), either("probe_generated"),
        F.coalesce(given("sent_to"), F.lit("")).alias("sent_to"), F.min_by(m["identity"], seen).alias("identity"), F.min_by(F.when(placed, m["listener_locations"]), F.when(placed, F.col("ord"))).alias("listener_locations"),
    )
    least = F.min(F.struct("page_url", "ord", "frame_url", "frame_path")).alias("page")
    same = [F.min_by(c, "ord").alias(c) for c in ("target", "type", "context", "sink", "argument", "source_kind", "source_name", "discovered", "probe_id", "phase")]
    framed = F.size("stack") > 0
    out = findings.groupBy("fingerprint").agg(
        least, *same, first_given("value_preview"), first_given("transform"), first_given("interaction"),
        F.min_by(F.when(framed, F.col("stack")), F.when(framed, F.col("ord"))).alias("stack"), F.min_by("url", F.when(F.col("url").isNotNull(), F.col("ord"))).alias("url"),
        F.when(F.max(m.isNotNull()), message).alias("message"), F.bool_or("confirmed").alias("confirmed"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"),
        F.array_sort(F.collect_set(F.when(F.col("trigger") != "", F.col("trigger")))).alias("triggers"), F.count_distinct(route(F.col("page_url"))).alias("routes"),
    )
    out = out.withColumns({"page_url": F.col("page.page_url"), "frame_url": F.col("page.frame_url"), "frame_path": F.col("page.frame_path"), "trigger": primary_trigger(F.col("triggers")), "seen_on_pages": F.when(F.col("routes") > 1, F.col("routes"))})
    return out.drop("page", "routes").withColumn("triage", triage({c: F.col(c) for c in out.columns}))


def in_order(findings: DataFrame) -> DataFrame:
    """By severity, then by fingerprint; of flows and reflections alike."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "fingerprint")


def reflection_identity(target: Column, parameter: Column, context: Column) -> Column:
    return _digest(_terminated(F.lit("reflection"), site(target), parameter, context))


def reflections_merged(findings: DataFrame) -> DataFrame:
    """Reflections (ord, target, page_url, parameter, context, occurrences, unfiltered, value_preview, discovered_by, severity,
    confidence, notes) merged by site, parameter and context, and judged anew."""
    each = findings.withColumn("fingerprint", reflection_identity(F.col("target"), F.col("parameter"), F.col("context")))
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    out = each.groupBy("fingerprint").agg(
        *[F.min_by(c, "ord").alias(c) for c in ("target", "parameter", "context")], F.min("page_url").alias("page_url"), F.max("occurrences").alias("occurrences"), joined("unfiltered"), joined("discovered_by"),
        first_given("value_preview"), first_given("notes"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.max_by("confidence", confidence_rank(F.col("confidence"))).alias("confidence"),
        F.count_distinct(route(F.col("page_url"))).alias("routes"),
    )
    out = out.withColumn("seen_on_routes", F.when(F.col("routes") > 1, F.col("routes"))).drop("routes")
    return out.withColumn("verdict", verdicts.reflection_verdict(F.col("context"), F.col("unfiltered"))["verdict"])


def query_names(url: Column) -> Column:
    pairs = F.filter(F.split(urls.query(url), "&"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda x: F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.substring_index(x, "=", 1)))))


def reflection_routes(targets: DataFrame, most: int | None = None) -> DataFrame:
    """(url): of targets (url, ord) the first of each scheme, host, path and set of parameter names; at most so many."""
    u = urls.without_fragment(F.trim("url"))
    some = targets.select(u.alias("url"), "ord").where(urls.scheme(F.col("url")).isin("http", "https") & (urls.host(F.col("url")) != ""))
    key = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")), urls.path(F.col("url")))
    first = some.groupBy(key.alias("k"), query_names(F.col("url")).alias("names")).agg(F.min(F.struct("ord", "url")).alias("o")).select("o.url", "o.ord")
    return (first if most is None else first.orderBy("ord", "url").limit(most)).select("url")


def reflection_label(url: Column, parameter: Column) -> Column:
    """The address with the tested parameter there and empty, the query in the order of its names."""
    pairs = F.filter(F.split(urls.query(url), "&"), lambda x: (x != "") & (F.substring_index(x, "=", 1) != parameter))
    given = F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))
    every = F.array_sort(F.concat(given, F.array(F.concat(parameter, F.lit("=")))))
    return F.concat(urls.scheme(url), F.lit("://"), urls.authority(url), urls.path(url), F.lit("?"), F.array_join(every, "&"))


def excerpt(body: Column, at: Column) -> Column:
    """What stands around a byte position of a body, on one line."""
    raw = body.cast("binary")
    start, stop = F.greatest(at - EXCERPT, F.lit(0)), F.least(at + EXCERPT, F.octet_length(raw))
    text = F.regexp_replace(F.substring(raw, start + 1, stop - start).cast("string"), "[\n\r\t]", " ")
    return preview(F.trim(text))


def occurrences(probes: DataFrame, most: int = 16) -> DataFrame:
    """(id, n, at, context, unfiltered) of the places of a marker in bodies (id, body, pre, suf), the first `most`, each judged on
    its own: where it stands, and which characters between the marker's halves came back as they were sent."""
    parts = F.split(F.col("body"), F.regexp_replace("pre", r"([^A-Za-z0-9])", r"\\$1"), most + 1)
    before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.call_function("array_join", F.slice(parts, F.lit(1), k), F.col("pre")))
    each = probes.where(F.contains("body", F.col("pre")) & (F.col("pre") != "")).select("id", "body", "pre", "suf", F.posexplode(before).alias("n", "b"))
    rest = F.substring(F.col("body"), F.length("b") + F.length("pre") + F.lit(1), F.lit(256))
    middle = F.when(F.contains(rest, F.col("suf")), F.call_function("substring_index", rest, F.col("suf"), F.lit(1)))
    found = F.when(middle.isNull(), F.array().cast("array<string>")).otherwise(verdicts.unfiltered(middle))
    context = verdicts.reflection_context(F.col("body"), F.length("b") + 1)
    return each.select("id", "n", F.octet_length("b").alias("at"), context.alias("context"), found.alias("unfiltered"))


def listener_evidence(source: Column) -> Column:
    """What the source of a message listener shows: whether it looks at the origin and at the sender, and the keys it reads."""
    origin = source.rlike(r"\.origin\b|\borigin\s*[=!]==?")
    keys = F.array_distinct(F.regexp_extract_all(source, F.lit(r"(?:event|e|msg|ev|m)\.data\.([A-Za-z_$][\w$]*)"), F.lit(1)))
    shape = F.when(F.size(keys) > 0, F.concat(F.lit("{"), F.array_join(F.slice(keys, F.lit(1), F.lit(8)), ", "), F.lit("}"))).otherwise("")
    return F.struct(origin.alias("origin_checked"), source.rlike(r"\.source\b").alias("source_checked"), shape.alias("data_shape"))


def leaks(messages: DataFrame, mark: str = MARK) -> DataFrame:
    """Messages (page_url, data, target_origin) that carry a marker or the page's host and go to any site or another one,
    with sent_to and identity."""
    target = F.coalesce("target_origin", F.lit(""))
    carries = F.contains("data", F.lit(mark)) | F.contains(F.col("data"), urls.authority(F.col("page_url")))
    away = (target == "*") | (target.contains("/") & ~target.startswith(site(F.col("page_url"))))
    return messages.where(carries & away).withColumns({"sent_to": target, "identity": F.concat(F.lit("leak|"), target)})


#: The context in which a hooked sink reads its argument; other sinks have none.
CONTEXTS = {
    "innerHTML": "html", "outerHTML": "html", "insertAdjacentHTML": "html", "document.write": "html", "document.writeln": "html", "srcdoc": "html",
    "eval": "js", "Function": "js", "setTimeout": "js", "setInterval": "js", "script.src": "url", "location": "url", "window.open": "url",
    "navigation": "url", "event-handler": "attribute",
}


def sink_context(sink: Column) -> Column:
    """The context of a sink by its family or name; of setAttribute by the attribute's name."""
    name = F.lower(F.regexp_extract(sink, r"setAttribute\((.*)\)$", 1))
    out = F.when(name == "srcdoc", "html").when(name.startswith("on"), "attribute").when(name != "", "url").otherwise("")
    for k, v in CONTEXTS.items():
        out = F.when(sink == k, v).otherwise(out)
    return out


def probe_plan(pages: DataFrame, hints: DataFrame, sources: list[str] | None = None, most: int = 1000, per_page: int = 100) -> DataFrame:
    """(url, kind, name, place): which inputs of which pages a scan would mark, at most so many; a plan, nothing is sent.

    Of a page first the names in its own query, then those that hints (scope, kind, name) of its host give, then the inputs
    without a name; of each source family that is chosen.
    """
    chosen = list(SOURCES) if sources is None else sources
    plain = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    own = pages.select("url", F.explode(query_names(F.col("url"))).alias("name")).select("url", F.lit(0).alias("order"), F.lit("url_query").alias("kind"), "name")
    keyed = hints.select(plain(F.col("scope")).alias("h"), "kind", "name").distinct()
    hinted = pages.select("url", plain(urls.host(F.col("url"))).alias("h")).join(keyed, "h").select("url", F.lit(1).alias("order"), "kind", "name")
    bare = pages.select("url", F.explode(F.array(*[F.lit(s) for s in ("url_fragment", "referrer", "window_name")])).alias("kind")).select("url", F.lit(2).alias("order"), "kind", F.lit("").alias("name"))
    every = own.union(hinted).union(bare).where(F.col("kind").isin(*chosen)).groupBy("url", "kind", "name").agg(F.min("order").alias("order"))
    placed = first_per_class(every, ["url"], ["order", "kind", "name"], per_page)
    return placed.orderBy("url", "rank").limit(most).select("url", "kind", "name", F.col("rank").cast("long").alias("place"))


def reflection_plan(routes: DataFrame, names: DataFrame, per_request: int = 25) -> DataFrame:
    """(url, batch, names): the parameters (scope, name) that each request of a reflection scan would try, so many at once, the
    control name `(any)` with each; a plan, nothing is sent."""
    plain = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    own = routes.select("url", F.explode(query_names(F.col("url"))).alias("name"))
    hinted = routes.select("url", plain(urls.host(F.col("url"))).alias("h")).join(names.select(plain(F.col("scope")).alias("h"), "name"), "h").select("url", "name")
    each = own.union(hinted).distinct()
    placed = each.withColumn("at", F.row_number().over(Window.partitionBy("url").orderBy("name")) - 1)
    batch = F.floor(F.col("at") / per_request).cast("int")
    return placed.groupBy("url", batch.alias("batch")).agg(F.concat(F.array_sort(F.collect_list("name")), F.array(F.lit("(any)"))).alias("names"))


def _strength(context: Column, chars: Column) -> Column:
    return severity_rank(verdicts.reflection_verdict(context, chars)["severity"]) * 100 + F.size(chars)


def chosen_reflections(found: DataFrame, control: DataFrame) -> DataFrame:
    """(route, param, n, context, unfiltered, severity, confidence, verdict) of the strongest occurrence of each parameter
    (route, param, n, context, unfiltered) that the control of its route (route, context, unfiltered) does not show as well.

    A context of the control counts with all the characters that came back there. Where the control itself reflects with a
    medium severity or more, the route has a row for the parameter `(any)`.
    """
    shown = control.groupBy("route", "context").agg(F.array_distinct(F.flatten(F.collect_set("unfiltered"))).alias("shown"))
    met = found.join(shown, ["route", "context"], "left")
    open_ = met.where(F.col("shown").isNull() | (F.size(F.array_except("unfiltered", "shown")) > 0)).drop("shown")
    echo = control.withColumn("n", F.row_number().over(Window.partitionBy("route").orderBy("context", "unfiltered"))).select("route", F.lit("(any)").alias("param"), "n", "context", "unfiltered")
    strong = severity_rank(verdicts.reflection_verdict(F.col("context"), F.col("unfiltered"))["severity"]) >= severity_rank(F.lit("medium"))
    each = open_.select(echo.columns).unionByName(echo.where(strong))
    best = F.max_by(F.struct("n", "context", "unfiltered"), F.struct(_strength(F.col("context"), F.col("unfiltered")), -F.col("n")))
    out = each.groupBy("route", "param").agg(best.alias("o")).select("route", "param", "o.*")
    return out.select("*", verdicts.reflection_verdict(F.col("context"), F.col("unfiltered")).alias("v")).select(*out.columns, "v.severity", "v.confidence", "v.verdict")


def suppressed_echoes(found: DataFrame, control: DataFrame) -> DataFrame:
    """(route, n): how many parameters of a route reflect nothing beyond its control."""
    kept = chosen_reflections(found, control).select("route", "param")
    return found.select("route", "param").distinct().join(kept, ["route", "param"], "left_anti").groupBy("route").agg(F.count("*").alias("n"))
