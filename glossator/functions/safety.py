"""Predicates that tell reserved or fictional values from ones that could be real."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, col, whole

DOMAINS = ("example.com", "example.org", "example.net")
EMAIL = r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
URL = r"(?i)https?://[^\s<>\"]+"
PRIVATE_KEY = r"-+BEGIN [A-Z ]*PRIVATE KEY-+"
CREDENTIAL = "|".join([r"\bAKIA[0-9A-Z]{16}\b", r"\b(?:sk-|gh[opusr]_)[A-Za-z0-9_-]{20,}\b", r"\beyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,}){2}\b"])
REASONS = {"email": "unreserved e-mail domain", "url": "unreserved URL host", "malformed": "malformed URL", "key": "private key", "credential": "credential", "term": "forbidden term", "value": "value not shown to be reserved"}

_VERIFIERS: dict[str, Callable[[Column], Column]] = {}


def register_verifier(plugin: str, verifier: Callable[[Column], Column], replace: bool = False) -> None:
    """Attach to a value plugin a test, from Column to Column, that holds only for values known to be reserved."""
    if plugin in _VERIFIERS and not replace:
        raise ValueError(f"verifier {plugin} exists")
    _VERIFIERS[plugin] = verifier


def registered_verifiers() -> tuple[str, ...]:
    return tuple(sorted(_VERIFIERS))


def reserved_host(host: Column, domains: Sequence[str] = DOMAINS) -> Column:
    """Whether a host is one of the domains or below one."""
    name = casefold(F.rtrim(F.trim(host), F.lit(".")))
    found = F.lit(False)
    for d in domains:
        found = found | (name == d) | name.endswith("." + d)
    return F.coalesce(found, F.lit(False))


def text_reasons(text: str | Column, domains: Sequence[str] = DOMAINS, terms: Sequence[str] = ()) -> Column:
    """Sorted distinct reasons for which a text is unsafe; empty for a null text."""
    t = col(text)
    hosts = F.regexp_extract_all(t, F.lit(EMAIL), F.lit(1))
    urls = F.transform(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), lambda u: F.try_parse_url(u, F.lit("HOST")))
    tests = [
        (F.exists(hosts, lambda h: ~reserved_host(h, domains)), "email"),
        (F.exists(urls, lambda h: h.isNotNull() & ~reserved_host(h, domains)), "url"),
        (F.exists(urls, lambda h: h.isNull()), "malformed"),
        (t.rlike(PRIVATE_KEY), "key"),
        (t.rlike(CREDENTIAL), "credential"),
        *((casefold(t).contains(casefold(F.lit(x))), "term") for x in terms),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(test, F.lit(REASONS[k])) for test, k in tests)))))


def verified(value: Column, plugin: str) -> Column:
    return F.coalesce(_VERIFIERS[plugin](value), F.lit(False)) if plugin in _VERIFIERS else F.lit(False)


def allowed_value(value: Column, label: Column, plugins: dict[str, str], prefixes: Sequence[str], mode: str = "either") -> Column:
    """Whether a value has an allowed prefix, passes its label's verifier, or either."""
    if mode not in ("prefix", "verifier", "either"):
        raise ValueError(f"unknown mode {mode}")
    start = F.lit(False)
    for p in prefixes:
        start = start | F.startswith(value, F.lit(p))
    proof = F.lit(False)
    for name, plugin in plugins.items():
        proof = proof | ((label == name) & verified(value, plugin))
    return {"prefix": start, "verifier": proof, "either": start | proof}[mode]


def record_reasons(text: str, annotations: str, plugins: dict[str, str], prefixes: Sequence[str], domains: Sequence[str] = DOMAINS, terms: Sequence[str] = (), mode: str = "either") -> Column:
    """Reasons of the text and of the values annotated in it."""
    bad = F.exists(F.col(annotations), lambda a: ~allowed_value(a["text"], a["entity_type"], plugins, prefixes, mode))
    value = F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(REASONS["value"]))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(text_reasons(text, domains, terms), value))


def luhn_invalid(digits: Column) -> Column:
    return ~F.call_function("luhn_check", digits)


def _ip(value: Column) -> Column:
    v = F.trim(value)
    v4 = whole(v, r"(?:192\.0\.2|198\.51\.100|203\.0\.113)\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)")
    return v4 | whole(F.lower(v), r"2001:0?db8(?::[0-9a-f]{1,4}){6}|2001:0?db8:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,4})?(?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,4})?)")


for _name, _test in {
    "reserved_email": lambda v: whole(F.trim(v), r"[^@\s]+@[^@\s]+") & reserved_host(F.regexp_extract(F.trim(v), "@(.*)$", 1)),
    "reserved_phone_nanp": lambda v: whole(F.trim(v), r"(?:\(\d{3}\) |\d{3}-)555-01\d{2}"),
    "card_shaped_invalid": lambda v: whole(F.trim(v), r"\d{4}(?:-\d{4}){3}") & luhn_invalid(F.replace(F.trim(v), F.lit("-"), F.lit(""))),
    "documentation_ip": _ip,
    "never_issued_ssn_shape": lambda v: whole(F.trim(v), r"9\d{2}-\d{2}-\d{4}"),
}.items():
    register_verifier(_name, _test)
