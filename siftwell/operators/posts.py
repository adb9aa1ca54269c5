"""Requests by POST that a script makes, and the parameters of account flows.

Each form is one pattern and a function from a match to (address, parameters). The forms walk brackets, which no regular
expression does, so they run over whole bodies in Arrow batches; MAY_POST tells on the JVM which bodies need that.
"""

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scripts import balanced, explode_with

#: The forms of requests.
Q = "['\"`]"
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
FETCH = re.compile(rf"(?is)fetch\s*\(\s*{Q}([^'\"`]+){Q}\s*,\s*\{{([^}}]*\}})")
FETCH_NAMED = re.compile(rf"(?is)fetch\s*\(\s*{Q}([^'\"`]+){Q}\s*,\s*({NAME})\s*\)")
CALLS = tuple(re.compile(rf"(?is){start}\.post\s*\(\s*{Q}([^'\"`]+){Q}(?:\s*,\s*([^)]+))?\)") for start in ("axios", r"\$", rf"\b{NAME}(?:\.{NAME})*"))
QUEST = re.compile(r"(?is)fetchQuest\(([^,)]+)(?:,\s*([^)]*))?\)")
QUEST_PATHS = ("/v1/q/", "/v2/q/", "/api/q/", "/quest/")
AJAX = re.compile(r"(?is)\$\.ajax\s*\(\s*\{([^}]*)\}\s*\)")
XHR = re.compile(rf"(?is)({NAME})\.open\(\s*['\"]POST['\"]\s*,\s*['\"]([^'\"]+)['\"]")
OBJECT = re.compile(rf"(?is)(?:const|let|var)\s+({NAME})\s*=\s*{{([^}}]*)}}")
NODE_NAMED = re.compile(rf"(?is)(?:const|let|var)\s+({NAME})\s*=\s*(https?\.request)\(\s*({NAME})")
NODE = (re.compile(r"(?is)(https?\.request)\(\s*{([^}]*)}"), re.compile(r"(?is)(https?\.request)\([^,]+,\s*\{([^}]*)\}"))
IS_POST = re.compile(rf"(?is)method\s*:\s*{Q}POST{Q}")
NODE_POST = re.compile(r"(?is)method\s*:\s*['\"]POST['\"]")
AJAX_POST = re.compile(rf"(?is)(?:type|method)\s*:\s*{Q}POST{Q}")
BODY = re.compile(r"(?is)body\s*:\s*([^,}]+)(?:,|\})")
AJAX_URL, AJAX_DATA = re.compile(rf"url\s*:\s*{Q}([^'\"`]+){Q}"), re.compile(r"data\s*:\s*([^,}]+)")
PART = {k: re.compile(rf"(?is){v}\s*:\s*['\"]([^'\"]+)['\"]") for k, v in (("host", "host(?:name)?"), ("path", "path"), ("protocol", "protocol"))}
FUNCTION = rf"\s*[:=]\s*(?:async\s+)?(?:function\s*\([^)]*\)|(?:\([^)]*\)|{NAME})\s*=>)"
SUBMITS = tuple(re.compile(x) for x in (rf"(?is)onSubmit{FUNCTION}", rf"(?is)(?:handle|on)(?:Submit|Login|SignIn|Auth){FUNCTION}", r"(?is)(?:event|e)\.preventDefault\s*\(\s*\)"))
AUTH_PATH = re.compile(rf"(?is){Q}(/(?:auth|login|signin|sign-in|authenticate|account/sign-in|api/idm|api/hyper-document)[A-Za-z0-9_/\-]*){Q}")
API_PATH = re.compile(rf"(?is){Q}(/api/[A-Za-z0-9_/\-]+){Q}")
NEXT_PATH = re.compile(rf"(?is){Q}(/api/auth/[A-Za-z0-9_/\-\[\]]+){Q}")
SIGN_IN = re.compile(rf"(?is)signIn\s*\(\s*{Q}([^'\"`]+){Q}(?:\s*,\s*([^)]+))?\)")
MUTATION = re.compile(r"(?is)mutation\s+(?:login|signin|authenticate|auth)[^{]*\{")
GRAPHQL_PATHS, GRAPHQL_PARAMS = ("/graphql", "/api/graphql", "/gql"), "query, variables, operationName"
AUTH_WORDS = ("auth", "login", "signin", "sign-in")
NEAR = 500

#: What an address of an account flow usually takes; the first line whose word is in the address counts.
FLOWS = (
    (("idm", "identity"), "phone, password, code (OTP)"),
    (("3p", "third-party"), "app_secret, callback, environment"),
    (("oauth", "authorize"), "client_id, redirect_uri, response_type, scope"),
    (("token",), "grant_type, code, client_id, client_secret"),
    (("login", "signin", "authenticate"), "username/email, password"),
    (("register", "signup"), "email, password, name, phone"),
    (("verify",), "code, token"),
    (("forgot", "reset"), "email/phone, token, new_password"),
)

#: Names of account parameters in objects, form data and fields.
ACCOUNT_OBJECT = re.compile(r"\{([^}]*(?:email|username|password|token)[^}]*)\}")
ACCOUNT_KEYS = {k: re.compile(rf"(?i)(?:{v})\s*:\s*[^,}}]+") for k, v in (("email", "email|mail|user(?:name)?"), ("password", "password|pass(?:word)?|pwd"), ("token", "token|csrf|authenticity_token"), ("username", "username|user"))}
APPENDED = re.compile(r"\.append\s*\(\s*['\"](\w+)['\"]")
ACCOUNT_WORDS = "email username password token user pass"
FIELDS = re.compile(r"""(?i)(?:name|id)\s*=\s*["'](\w+)["'].*?type\s*=\s*["'](?:password|email|text)["']""")

#: A body without any of these has no request of any form.
MAY_POST = r"(?i)fetch|\.post\s*\(|\$\.ajax|\.open\(|https?\.request|preventDefault|submit|/api/|signIn|mutation|on(?:Login|Auth)|handle(?:Login|Auth)"


def account_params(endpoint: str) -> str:
    lower = endpoint.lower()
    return next((params for words, params in FLOWS if any(w in lower for w in words)), "")


def account_params_column(endpoint: Column) -> Column:
    out, lower = F.lit(""), F.lower(endpoint)
    for words, params in reversed(FLOWS):
        out = F.when(lower.rlike("|".join(words)), params).otherwise(out)
    return out


def nearby_params(context: str) -> str:
    """Names of account parameters in a piece of a script, sorted."""
    found = set()
    if obj := ACCOUNT_OBJECT.search(context):
        found |= {k for k, p in ACCOUNT_KEYS.items() if p.search(obj[1])}
    found |= {x for x in APPENDED.findall(context) if x.lower() in ACCOUNT_WORDS}
    found |= set(FIELDS.findall(context))
    return "inferred: " + ", ".join(sorted(found)) if found else ""


def _first(pattern: re.Pattern, text: str) -> str:
    m = pattern.search(text)
    return m[1].strip() if m else ""


def _argument(text: str, m: re.Match) -> str:
    return balanced(text, m.start(2)) if m[2] is not None else ""


def _fetches(text: str) -> Iterator[tuple[str, str]]:
    for m in FETCH.finditer(text):
        if IS_POST.search(m[2]):
            yield m[1], _first(BODY, m[2]) or nearby_params(text[max(0, m.start() - NEAR) : m.end() + NEAR])
    objects: dict[str, str] = {}
    for m in OBJECT.finditer(text):
        objects.setdefault(m[1], m[2])
    for m in FETCH_NAMED.finditer(text):
        if IS_POST.search(objects.get(m[2], "")):
            yield m[1], _first(BODY, objects[m[2]])


def _calls(text: str) -> Iterator[tuple[str, str]]:
    for form in CALLS:
        for m in form.finditer(text):
            yield m[1], _argument(text, m)
    for m in QUEST.finditer(text):
        named, quoted = m[1].strip(), re.search(rf"{Q}([^'\"`]+){Q}", m[1])
        known = next((named[named.index(p) :] for p in QUEST_PATHS if p in named), named)
        yield quoted[1] if quoted else re.split("['\"`+]", known)[0] or known, _argument(text, m)
    for m in AJAX.finditer(text):
        if AJAX_POST.search(m[1]) and (url := AJAX_URL.search(m[1])):
            yield url[1], _first(AJAX_DATA, m[1])
    for m in XHR.finditer(text):
        yield m[2], _first(re.compile(re.escape(m[1]) + r"\.send\(((?:[^()]+|\([^()]*\))*)\)"), text[m.end() :])
    for m in SIGN_IN.finditer(text):
        if m[1].startswith(("/", "http")):
            yield m[1], _argument(text, m)


def _address(call: str, obj: str, own: bool) -> str:
    """The address of a request given by parts; own: whether the object's protocol counts."""
    host, path, protocol = (_first(PART[k], obj) for k in ("host", "path", "protocol"))
    said = protocol.removesuffix(":") if own else ""
    return f"{said or ('http' if call.lower().startswith('http.') else 'https')}://{host}{path}" if host else path


def _by_parts(text: str) -> Iterator[tuple[str, str]]:
    objects = {m[1]: m[2] for m in OBJECT.finditer(text) if NODE_POST.search(m[2])}  # the last one counts
    for m in NODE_NAMED.finditer(text):
        if m[3] in objects:
            yield _address(m[2], objects[m[3]], True), _first(re.compile(re.escape(m[1]) + r"\.(?:write|end)\(([^)]*)\)"), text[m.end() :])
    for form in NODE:
        for m in form.finditer(text):
            if NODE_POST.search(m[2]):
                yield _address(m[1], m[2], False), ""


def _routes(text: str) -> Iterator[tuple[str, str]]:
    paths = []
    if any(p.search(text) for p in SUBMITS):
        paths += AUTH_PATH.findall(text) + [x for x in API_PATH.findall(text) if any(w in x.lower() for w in AUTH_WORDS)] + NEXT_PATH.findall(text)
    for m in API_PATH.finditer(text):
        near = text[max(0, m.start() - NEAR) : m.start() + NEAR]
        if re.search("(?i)post|method", near) or "body:" in near or "data:" in near:
            paths.append(m[1])
    for x in paths:
        yield x, account_params(x)
    if MUTATION.search(text):
        for x in GRAPHQL_PATHS:
            if x in text:
                yield x, GRAPHQL_PARAMS


def post_requests(text: str) -> list[tuple[str, str]]:
    """Distinct (address, parameters) of all forms, in the order of forms and places."""
    return list(dict.fromkeys(x for form in (_fetches, _calls, _by_parts, _routes) for x in form(text)))


def scan_posts(artifacts: DataFrame, body: str = "body") -> DataFrame:
    """(source, pattern, value, params, severity) of the requests in script artifacts: post_url or post_path, distinct."""
    some = artifacts.where(F.col("is_js") & F.col(body).rlike(MAY_POST))
    found = explode_with(some, "source", body, post_requests, "value string, params string")
    value, params = F.trim("value"), F.trim("params")
    pattern = F.when(F.col("value").rlike("^(?:https?:)?//"), "post_url").otherwise("post_path")
    return found.select("source", pattern.alias("pattern"), value.alias("value"), params.alias("params"), F.lit("info").alias("severity")).distinct()
