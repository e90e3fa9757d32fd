"""Validators, lookalike patterns and text normalising as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it: optimisers would copy a plain expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(key: Column, salt: str, n: int) -> Column:
    """A number below n from the md5 of key and salt: stands for a random choice and is the same in any engine."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(n)


def choose(options: list[str], key: Column, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (pick(key, salt, len(options)) + 1).cast("int"))


def card_valid(v: Column) -> Column:
    """Luhn over ASCII digits after spaces and hyphens go; no length rule; empty is false."""
    digits = F.regexp_replace(v, "[ -]", "")
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False)), F.lit(False))


def _mod97(v: Column) -> Column:
    """Remainder of the alphanumeric string, letters as 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(v, ""), F.lit(0), lambda a, c: step(a, c))


def iban_valid(v: Column) -> Column:
    s = F.upper(F.regexp_replace(v, "[ -]", ""))
    shape = s.rlike("^[0-9A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}$")
    return F.coalesce(F.when(shape, _mod97(F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))) == 1).otherwise(F.lit(False)), F.lit(False))


def ssn_valid(v: Column) -> Column:
    d = F.regexp_replace(v, "[ -]", "")
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    ok = d.rlike("^[0-9]{9}$") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    return F.coalesce(ok, F.lit(False))


def known_non_pii(v: Column) -> Column:
    """Hashes, UUIDs, MACs, and 16 or more hex digits with a letter once spaces and hyphens go."""
    p = L.VALUE_PATTERNS
    bare = F.regexp_replace(v, "[ -]", "")
    shaped = v.rlike(rf"^(?:{L.HEX}{{64}}|{L.HEX}{{40}}|{L.HEX}{{32}})$") | v.rlike(p["uuid"]) | v.rlike(p["mac"])
    return F.coalesce(shaped | (bare.rlike(rf"^{L.HEX}{{16,}}$") & bare.rlike("[a-fA-F]")), F.lit(False))


def lookalike_value(v: Column) -> Column:
    """Name of the first pattern that the whole value has, else null."""
    s, out = F.regexp_replace(v, r"^\s+|\s+$", ""), F.lit(None).cast("string")
    for name, pattern in reversed(L.VALUE_PATTERNS.items()):
        hit = s.rlike(pattern) & s.rlike("[a-fA-F]") if name in L.NEEDS_LETTER else s.rlike(pattern)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def lookalike_text(v: Column) -> Column:
    """Name of the first pattern found anywhere in the text, else null. '.' and '$' know only the line feed."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(L.TEXT_PATTERNS.items()):
        hit = v.rlike(f"(?d){pattern}")
        # Its lookaheads are tried at every place: only texts that can match are asked.
        out = F.when(v.contains("::") & hit if name == "ipv6_compressed" else hit, F.lit(name)).otherwise(out)
    return out


def span_passes(s: Column) -> Column:
    """A typed validator decides alone; other types fail only as known non-PII; a missing value passes."""
    v, kind = s["value"], s["type"]
    typed = F.when(kind == "credit_card_number", card_valid(v)).when(kind == "ssn", ssn_valid(v)).when(kind == "iban", iban_valid(v)).otherwise(~known_non_pii(v))
    return F.when(v.isNull() | (v == ""), F.lit(True)).otherwise(typed)


def validate_spans(spans: Column) -> Column:
    return F.filter(spans, span_passes)


def drop_lookalikes(spans: Column) -> Column:
    return F.filter(spans, lambda s: lookalike_value(s["value"]).isNull())


def account_class(v: Column) -> Column:
    """Type of an account number, by the first validator that accepts it; null beyond ASCII."""
    s = F.regexp_replace(v, r"^\s+|\s+$", "")
    return F.when(s.rlike(r"^[\x00-\x7f]+$"), F.when(card_valid(s), F.lit("credit_card_number")).when(iban_valid(s), F.lit("iban")).when(ssn_valid(s), F.lit("ssn")))


def template_error(text: Column, positive: Column, detected: Column) -> Column:
    """Null for a good template, else why it is refused. detected: number of values that the rule detector finds in it."""
    braces = text.contains("{{") | text.contains("}}")
    names = F.regexp_extract_all(text, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1))
    unknown = F.size(F.array_except(F.transform(names, F.trim), F.array(*map(F.lit, L.TYPES)))) > 0
    return (
        F.when(positive & ~braces, F.lit("no placeholder"))
        .when(~positive & braces, F.lit("placeholder in negative"))
        .when(unknown, F.lit("unknown placeholder"))
        .when(positive & (F.size(names) == 0), F.lit("malformed placeholder"))
        .when(detected > 0, F.lit("contains a value"))
    )


def normalize(v: Column) -> Column:
    """Word characters in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(v, F.lit("")), r"[^\p{L}\p{N}_]", ""))


def has_subsequence(query: Column, string: Column) -> Column:
    """Whether all characters of string occur in query in their order; the empty string always does."""
    walk = F.aggregate(F.split(string, ""), F.lit(0), lambda at, c: F.when(at < 0, F.lit(-1)).otherwise(_next(query, c, at)))
    return F.when(F.length(string) == 0, F.lit(True)).otherwise(walk >= 0)


def _next(query: Column, c: Column, at: Column) -> Column:
    found = F.call_function("locate", c, query, at + 1)
    return F.when(found > 0, found).otherwise(F.lit(-1))
