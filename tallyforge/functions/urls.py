"""Functions on e-mail addresses, URLs and user agents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.registry import WrongArguments, function
from tallyforge.plans import values as V
from tallyforge.plans.values import Val

_STRINGS = T.ArrayType(T.StringType())
_ADDRESS = r"^\s*(?:\"?([^\"<>]*?)\"?\s*<([^<>@\s]+@[^<>@\s]+)>|([^<>@\s,;]+@[^<>@\s,;]+))\s*$"


def _email(s):
    return F.lower(F.nullif(F.concat(F.regexp_extract(s, _ADDRESS, 2), F.regexp_extract(s, _ADDRESS, 3)), F.lit("")))


@function("email", args=(1, 1))
def email(ctx, a):
    return V.text(_email(V.as_text(a)))


@function("emailname", args=(1, 1))
def emailname(ctx, a):
    return V.text(F.nullif(F.trim(F.regexp_extract(V.as_text(a), _ADDRESS, 1)), F.lit("")))


@function("emaildomain", args=(1, 1))
def emaildomain(ctx, a):
    return V.text(F.substring_index(_email(V.as_text(a)), "@", -1))


# A URL may come without its scheme. Bad escapes and blanks make it none.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://)?"


def _whole(s):
    """The URL with a scheme, null if it can't be one."""
    ok = (s != "") & ~s.rlike(r"\s") & ~F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)", 1).contains("%")
    schemed = F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), s).when(s.startswith("/"), F.concat(F.lit("http://"), s)).otherwise(F.concat(F.lit("http://"), s))
    return F.when(ok, schemed)


def _part(u, i):
    """1 authority, 2 path, 3 query."""
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)\??([^#]*)", i)


def _host(s):
    h = F.lower(F.regexp_replace(F.regexp_replace(_part(_whole(s), 1), r"^[^@]*@", ""), r":\d+$", ""))
    return F.when(h.contains("."), h)


def _domain(s):
    return F.substring_index(_host(s), ".", -2)


def _each(xs, f):
    every = F.concat(*(F.coalesce(V.as_list(x), F.array().cast("array<string>")) for x in xs))
    out = F.filter(F.transform(every, f), lambda x: x.isNotNull())
    return Val(F.when(F.size(out) > 0, out), _STRINGS)


@function("host", args=(1, 1))
def host(ctx, a):
    return V.text(_host(V.as_text(a)))


@function("hosts", args=(1, None))
def hosts(ctx, *xs):
    return _each(xs, _host)


@function("domain", args=(1, 1))
def domain(ctx, a):
    """The last two labels of the host."""
    return V.text(_domain(V.as_text(a)))


@function("domains", args=(1, None))
def domains(ctx, *xs):
    return _each(xs, _domain)


@function("path", args=(1, 1))
def path(ctx, a):
    s = F.lower(V.as_text(a))
    filed = F.when(s.startswith("file://"), F.concat(F.lit("//"), F.substr(s, F.lit(8))))
    return V.text(F.coalesce(filed, F.nullif(_part(_whole(s), 2), F.lit(""))))


def _decoded(s):
    return F.try_url_decode(s)


def _parameter(url, key):
    pairs = F.split(_part(_whole(url), 3), "&")
    hit = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == key)
    value = F.get(hit, F.lit(0))
    return F.when(key != "", F.nullif(_decoded(F.regexp_replace(value, "^[^=]*=?", "")), F.lit("")))


@function("qs", "qsl", args=(2, 2))
def qs(ctx, a, key):
    """Of the URL in lower case, so the value is too."""
    return V.text(_parameter(F.lower(V.as_text(a)), V.as_text(key)))


@function("qs2", args=(2, 2))
def qs2(ctx, a, key):
    return V.text(_parameter(V.as_text(a), V.as_text(key)))


@function("urldecode", args=(1, 1))
def urldecode(ctx, a):
    return V.text(_decoded(V.as_text(a)))


@function("urlmain", args=(1, 1))
def urlmain(ctx, a):
    u = _whole(V.as_text(a))
    return V.text(F.concat(_part(u, 1), _part(u, 2)))


def _with_query(u, kept, scheme: bool):
    base = F.concat(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://)", 1) if scheme else F.lit(""), _part(u, 1), _part(u, 2))
    return F.when(u.isNotNull(), F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


@function("urlminusqs", args=(2, 2))
def urlminusqs(ctx, a, key):
    u, k = _whole(V.as_text(a)), V.as_text(key)
    kept = F.filter(F.split(_part(u, 3), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != k))
    return V.text(F.when(k != "", _with_query(u, kept, True)))


@function("url.matchqs", args=(1, None))
def matchqs(ctx, a, *patterns):
    """Host and path, with the parameters whose names match a pattern."""
    if not all(p.is_literal for p in patterns):
        raise WrongArguments("patterns are literals")
    u = _whole(V.as_text(a))
    kept = F.array().cast("array<string>")
    if patterns:
        rule = "^(" + "|".join(str(p.value).replace("*", ".*") if ".*" not in str(p.value) else str(p.value) for p in patterns) + ")"
        kept = F.array_sort(F.filter(F.split(_part(u, 3), "&"), lambda p: (p != "") & F.substring_index(p, "=", 1).rlike(rule)))
    return V.text(_with_query(u, kept, False))


#: Browsers by the token that names them, the telling ones first.
_BROWSERS = [("Edg", "Edge"), ("Edge", "Edge"), ("OPR", "Opera"), ("Opera", "Opera"), ("Firefox", "Firefox"), ("CriOS", "Chrome"), ("Chrome", "Chrome"), ("Safari", "Safari"), ("MSIE", "Internet Explorer")]
_BOTS = r"(?i)bot\b|bot/|crawl|spider|slurp|curl/|wget/"


def _agent(s):
    inside = F.split(F.regexp_extract(s, r"\(([^)]*)\)", 1), r";\s*")
    name = version = F.lit("")
    for token, label in reversed(_BROWSERS):
        hit = s.rlike(rf"\b{token}[/ ][0-9]")
        name = F.when(hit, F.lit(label)).otherwise(name)
        version = F.when(hit, F.regexp_extract(s, rf"\b{token}[/ ]([0-9][0-9.]*)", 1)).otherwise(version)
    os = F.get(F.filter(inside, lambda x: x.rlike(r"(?i)linux|windows|mac os|android|iphone os|cros|bsd")), F.lit(0))
    words = {
        "mozilla": F.regexp_extract(s, r"Mozilla/([0-9.]+)", 1),
        "platform": F.coalesce(F.get(inside, F.lit(0)), F.lit("")),
        "os": F.coalesce(os, F.lit("")),
        "engine": F.regexp_extract(s, r"\b(AppleWebKit|Gecko|Trident|Presto)/", 1),
        "engine_version": F.regexp_extract(s, r"\b(?:AppleWebKit|Gecko|Trident|Presto)/([0-9.]+)", 1),
        "browser": name,
        "browser_version": version,
        "bot": s.rlike(_BOTS).cast("string"),
        "mobile": s.rlike("(?i)mobile|android|iphone|ipad").cast("string"),
    }
    return words


@function("useragent", args=(2, 2))
def useragent(ctx, a, part):
    s = V.as_text(a)
    words = _agent(s)
    if not part.is_literal:
        raise WrongArguments("the part is a literal")
    if part.value not in words:
        return V.text(F.lit(None).cast("string"))
    return V.text(F.when(s != "", words[part.value]))


@function("useragent.map", args=(1, 1))
def useragent_map(ctx, a):
    s = V.as_text(a)
    pairs = [x for k, v in _agent(s).items() for x in (F.lit(k), v)]
    return Val(F.when(s != "", F.create_map(*pairs)), T.MapType(T.StringType(), T.StringType()))
