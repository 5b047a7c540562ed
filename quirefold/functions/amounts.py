"""Monetary amounts under a named number format (AMT-*), as one expression without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import collapse

# Policies with the separators that may group thousands and those that may mark decimals.
POLICIES = {
    "cord_mixed_v1": (".,", ".,"),
    "dot_decimal_comma_grouping": (",", "."),
    "comma_decimal_dot_grouping": (".", ","),
}
DEFAULT_POLICY = "cord_mixed_v1"
#: What every accepted amount looks like, for a first test by one expression.
LIKELY = r"(?i)^\s*(?:rp\.?|idr|php|₱)?\s*[0-9][0-9.,]*\s*$"
MARKER = r"(?i)^(rp\.?|idr|php|₱)\s*"


def shape(policy: str) -> tuple[str, str]:
    """Regexes of whole numbers and of numbers with two decimals that a policy accepts."""
    groups, decimals = POLICIES[policy]
    grouped = {g: rf"\d{{1,3}}(?:\{g}\d{{3}})+" for g in groups}
    whole = "|".join([r"\d+", *grouped.values()])
    parts = [rf"(?:{'|'.join([r'\d+', *(v for g, v in grouped.items() if g != d)])})\{d}\d\d" for d in decimals]
    return rf"^(?:{whole})$", rf"^(?:{'|'.join(parts)})$"


def amount(text: Column, policy: str = DEFAULT_POLICY, currency: str = "unspecified") -> Column:
    """AMT-01 to 03: struct(parse_status, normalized_amount, currency, reason) of one candidate string.

    The text should be NFKC already (see text.clean). Null and blank give no_candidate. Digits are never guessed: a
    string outside the policy's grammar is ambiguous, unsupported or parse_failed, with the reason.
    """
    whole, cents = shape(policy)

    def judge(v: Column) -> Column:
        raw, mark, body = v["raw"], v["mark"], v["body"]
        return let(
            F.struct(raw.alias("raw"), mark.alias("mark"), body.alias("body"), body.rlike(whole).alias("whole"), body.rlike(cents).alias("cents")),
            lambda x: let(_outcome(x), lambda o: _result(x, o, currency)),
        )

    def split(raw: Column) -> Column:
        return let(F.struct(raw.alias("raw"), F.lower(F.regexp_extract(raw, MARKER, 1)).alias("mark"), F.regexp_replace(raw, MARKER, "").alias("body")), judge)

    return let(collapse(F.coalesce(text, F.lit(""))), split)


def _outcome(x: Column) -> Column:
    """struct(status, reason): the first check that applies."""
    body = x["body"]
    checks = [
        (x["raw"] == "", "no_candidate", None),
        (body == "", "parse_failed", "currency_marker_only"),
        (x["whole"] | x["cents"], "ok", None),
        (body.contains("%"), "unsupported", "percentage"),
        (body.rlike(r"^[-+(−]|[-)]$|−"), "unsupported", "sign_or_refund"),
        (body.contains(" "), "ambiguous", "multiple_or_spaced_amounts"),
        (~body.rlike(r"^[0-9.,]+$"), "parse_failed", "non_numeric_characters"),
    ]
    out = None
    for test, status, reason in checks:
        pair = F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
        out = F.when(test, pair) if out is None else out.when(test, pair)
    return out.otherwise(F.struct(F.lit("ambiguous").alias("status"), F.lit("separator_grammar").alias("reason")))


def _value(body: Column, cents: Column) -> Column:
    """The normalized amount of a body that is one."""
    digits = F.regexp_replace(F.when(cents, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body), "[.,]", "")
    integer, fraction = F.regexp_replace(digits, "^0+(?=.)", ""), F.right(body, F.lit(2))
    return F.when(~cents | (fraction == "00"), integer).otherwise(F.concat(integer, F.lit("."), fraction))


def _result(x: Column, o: Column, currency: str) -> Column:
    body, mark, ok = x["body"], x["mark"], o["status"] == "ok"
    value = _value(body, x["cents"])
    unit = F.when(mark.startswith("rp") | (mark == "idr"), "IDR").when(mark.isin("php", "₱"), "PHP").otherwise(currency)
    return F.struct(o["status"].alias("parse_status"), F.when(ok, value).alias("normalized_amount"), unit.alias("currency"), o["reason"].alias("reason"))


def _body(text: Column) -> Column:
    return F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), MARKER, "")


def normalized(text: Column, policy: str = DEFAULT_POLICY) -> Column:
    """amount()'s normalized_amount alone, for a fraction of the work."""
    whole, cents = shape(policy)
    return let(_body(text), lambda b: F.when(b.rlike(whole), _value(b, F.lit(False))).when(b.rlike(cents), _value(b, F.lit(True))))


def is_amount(text: Column, policy: str = DEFAULT_POLICY) -> Column:
    """FIL-06: the text alone is an amount."""
    return _body(text).rlike("|".join(shape(policy)))


def reason(text: Column, policy: str = DEFAULT_POLICY) -> Column:
    """amount()'s reason alone; what is an amount has none, and is told by one expression."""
    return F.when(~is_amount(text, policy), amount(text, policy)["reason"])
