"""Character-level and context-level text attacks as Column expressions; spans keep exact code-point offsets."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .checks import choose, let, pick
from .spans import SPAN


# --- characters --------------------------------------------------------------------------------------


def homoglyph(v: Column) -> Column:
    return F.translate(v, L.HOMOGLYPH_FROM, L.HOMOGLYPH_TO)


def _some(v: Column, proba: float, key: Column | None, change: Callable[[Column, Column], Column]) -> Column:
    """change(character, place from 0) for the characters that a coin of `proba` picks by key and place; the others stay."""
    if key is None:
        raise ValueError("a key is needed to pick characters")
    hit = lambda i: pick(F.concat_ws("|", key.cast("string"), (i + 1).cast("string")), "char", 10_000) < round(proba * 10_000)
    return F.array_join(F.transform(F.split(v, ""), lambda c, i: F.when(hit(i), change(c, i)).otherwise(c)), "")


def emojify(v: Column, proba: float = 1.0, key: Column | None = None) -> Column:
    if proba < 1:
        return _some(v, proba, key, lambda c, i: emojify(c))
    return F.translate(F.regexp_replace(v, "([0-9])", f"$1{L.KEYCAP}"), L.LOWER + L.UPPER + "@", L.SQUARED + L.SQUARED + L.AT_EMOJI)


def char_to_word(v: Column, language: str = "english", separator: str = "", around: str = "()") -> Column:
    """around: the two characters on the sides of a word; separator goes before it."""
    left, right = f"{separator}{around[:1]}", around[1:]
    table = dict(zip(L.DIGITS, L.NUMBER_WORDS[language])) | L.SYMBOL_WORDS
    words = F.create_map(*[F.lit(x) for c, w in table.items() for x in (c, f"{left}{w}{right}")])
    other_digit = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]$"
    one = lambda c: F.coalesce(F.try_element_at(words, c), F.when(c.rlike(other_digit), F.concat(F.lit(left), c, F.lit(right))), c)
    return F.array_join(F.transform(F.split(v, ""), one), "")


def smart_split(v: Column) -> Column:
    return F.regexp_extract_all(v, F.lit("[a-zA-Z0-9]+|[^a-zA-Z0-9]"), F.lit(0))


def split_token(t: Column) -> Column:
    """Letters stay whole; else pieces of three, and a last single character takes one from the piece before."""
    n = F.length(t)
    borrow, last = (n % 3 == 1) & (n > 3), F.ceil(n / 3).cast("int") - 1

    def piece(i: Column) -> Column:
        start = i * 3 + 1 - F.when(borrow & (i == last), 1).otherwise(0)
        return F.substr(t, start, F.when(borrow & (i >= last - 1), 2).otherwise(3))

    return F.when(t.rlike(r"^\p{L}+$"), F.array(t)).otherwise(F.transform(F.sequence(F.lit(0), last), piece))


def chunking(v: Column) -> Column:
    """Quoted pieces joined by plus signs; one piece stays bare, an empty text empty."""

    def quoted(parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.concat(F.lit('"'), F.array_join(parts, '" + "'), F.lit('"'))).otherwise(F.array_join(parts, ""))

    return let(F.flatten(F.transform(smart_split(v), split_token)), quoted)


def invisible(v: Column, char: str, proba: float = 1.0, key: Column | None = None) -> Column:
    """A combining mark after each letter or digit; a zero-width character between characters."""
    if proba < 1:
        last = F.length(v) - 1
        mark = (lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.concat(c, F.lit(char))).otherwise(c)) if char in L.COMBINING else (lambda c, i: F.when(i < last, F.concat(c, F.lit(char))).otherwise(c))
        return _some(v, proba, key, mark)
    if char in L.COMBINING:
        return F.regexp_replace(v, r"([\p{L}\p{N}])", f"$1{char}")
    return F.array_join(F.split(v, ""), char)


def separated(v: Column, separator: str, proba: float = 1.0, key: Column | None = None) -> Column:
    if proba < 1:
        return _some(v, proba, key, lambda c, i: F.when(i > 0, F.concat(F.lit(separator), c)).otherwise(c))
    return F.array_join(F.split(v, ""), separator)


def _by_pick(options: list[str], key: Column, salt: str, make: Callable[[str], Column]) -> Column:
    """make(option) for the option chosen for key."""
    chosen = choose(options, key, salt)
    out = make(options[-1])
    for o in options[:-1]:
        out = F.when(chosen == o, make(o)).otherwise(out)
    return out


def fuzz_value(v: Column, technique: str, key: Column) -> Column:
    """One value under a technique; key picks language, character or separator."""
    if technique == "homoglyph":
        return homoglyph(v)
    if technique == "emojify":
        return emojify(v)
    if technique == "chunking":
        return chunking(v)
    if technique == "char_to_word":
        return _by_pick(list(L.NUMBER_WORDS), key, technique, lambda o: char_to_word(v, o))
    if technique == "invisible_chars":
        return _by_pick(L.ZERO_WIDTH + L.COMBINING, key, technique, lambda o: invisible(v, o))
    if technique == "separators":
        return _by_pick(L.SEPARATORS, key, technique, lambda o: separated(v, o))
    if technique == "baseline":
        return v
    raise ValueError(f"unknown technique {technique!r}")


# --- spans -------------------------------------------------------------------------------------------


def rewrite_spans(text: Column, spans: Column, fuzz: Callable[[Column], Column], proba: float = 1.0, key: Column | None = None, update_spans: bool = True) -> Column:
    """struct<text,spans>: each span's slice is replaced by fuzz(slice); spans ascend and do not overlap.

    proba: share of spans that are rewritten, picked by key and place. update_spans=False leaves the spans as they were.
    """
    if proba < 1 and key is None:
        raise ValueError("a key is needed to pick spans")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("cur"), F.array().cast(f"array<{SPAN}>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(text, acc["cur"] + 1, s["start"] - acc["cur"])
        old = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        new, keep = fuzz(old), F.lit(None).cast("string")
        if proba < 1:
            hit = pick(F.concat_ws("#", key.cast("string"), F.size(acc["done"]).cast("string")), "span", 10_000) < round(proba * 10_000)
            new, keep = F.when(hit, new), s["value_fuzzy"]

        def placed(x: Column) -> Column:
            put = F.coalesce(x["n"], x["o"])
            begin = F.length(acc["out"]) + F.length(x["b"])
            moved = s.withField("start", begin.cast("int")).withField("end", (begin + F.length(put)).cast("int")).withField("value_fuzzy", F.coalesce(x["n"], keep))
            return F.struct(F.concat(acc["out"], x["b"], put).alias("out"), s["end"].alias("cur"), F.array_append(acc["done"], moved.cast(SPAN)).alias("done"))

        return let(F.struct(before.alias("b"), old.alias("o"), new.alias("n")), placed)

    end = lambda acc: F.struct(F.concat(acc["out"], F.substr(text, acc["cur"] + 1, F.length(text))).alias("text"), (acc["done"] if update_spans else spans.cast(f"array<{SPAN}>")).alias("spans"))
    return F.aggregate(spans, start, step, end)


def fuzz_spans(text: Column, spans: Column, technique: str, key: Column) -> Column:
    return rewrite_spans(text, spans, lambda v: fuzz_value(v, technique, F.concat_ws("#", key.cast("string"), v)))


def ascending(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def shift_spans(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("start", (s["start"] + by).cast("int")).withField("end", (s["end"] + by).cast("int")))


# --- context -----------------------------------------------------------------------------------------


def name_pattern(names: list[str]) -> str:
    """Whole words in list order, spaces free: the first alternative that fits wins."""
    return "|".join(rf"\b{re.sub(r'\.', r'\\.', n).replace(' ', r'[\s_-]*')}\b" for n in names)


def replace_names(text: Column, replace_with: str = "emoji") -> Column:
    for kind, new in L.REPLACEMENTS[replace_with].items():
        text = F.regexp_replace(text, f"(?i){name_pattern(L.VARIATIONS[kind])}", new)
    return text


def term_pattern(terms: list[str]) -> str:
    longest = sorted(set(terms), key=lambda t: (-len(t), t))
    return r"(?i)\b(?:" + "|".join(longest) + r")\b"


def fuzz_terms(text: Column, types: Column, method: str = "homoglyph") -> Column:
    """Whole-word terms of the types present, through homoglyph or emojify; longer terms first."""
    fuzz = {"homoglyph": homoglyph, "emojify": emojify}[method]

    def through(kind: str) -> Callable[[Column], Column]:
        pattern = term_pattern(L.TERMS[kind] + L.UNIVERSAL_TERMS)

        def changed(t: Column) -> Column:
            pieces, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
            new = F.array_join(F.zip_with(pieces, hits, lambda p, h: F.concat(p, F.coalesce(fuzz(h), F.lit("")))), "")
            return F.when(F.array_contains(types, kind), new).otherwise(t)

        return changed

    for kind in L.TYPES:
        text = let(text, through(kind))
    return text


def locate_again(text: Column, spans: Column) -> Column:
    """Spans at the next place of their value after the one before; one that is not found keeps its old place."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast(f"array<{SPAN}>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        v = F.coalesce(s["value_fuzzy"], s["value"])
        at = F.call_function("locate", v, text, acc["last"] + 1)
        end = (at - 1 + F.length(v)).cast("int")
        moved = s.withField("start", (at - 1).cast("int")).withField("end", end).cast(SPAN)
        return F.struct(F.when(at > 0, end).otherwise(acc["last"]).alias("last"), F.array_append(acc["done"], F.when(at > 0, moved).otherwise(s.cast(SPAN))).alias("done"))

    return F.aggregate(spans, start, step, lambda acc: acc["done"])


def supportive_context(text: Column, spans: Column, replace_with: str = "emoji", method: str = "homoglyph", surrounding: bool = True, update_spans: bool = True) -> Column:
    """struct<text,spans>: names replaced, then terms near values fuzzed, then spans located again."""
    if replace_with not in L.REPLACEMENTS or method not in ("homoglyph", "emojify"):
        raise ValueError("unsupported replacement or method")
    new = replace_names(text, replace_with)
    if surrounding:
        new = fuzz_terms(new, F.transform(spans, lambda s: s["type"]), method)
    return let(new, lambda t: F.struct(t.alias("text"), (locate_again(t, spans) if update_spans else spans.cast(f"array<{SPAN}>")).alias("spans")))


def affix(text: Column, spans: Column, key: str) -> Column:
    """struct<text,spans>: the affix before or after every span."""
    if key not in L.AFFIXES:
        raise ValueError(f"unknown affix {key!r}")
    words, before = L.AFFIXES[key]
    extra, ordered = len(words) + 1, ascending(spans)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        upto = s["start"] if before else s["end"]
        cut = F.concat(acc["out"], F.substr(text, acc["cur"] + 1, upto - acc["cur"]), F.lit(f"{words} " if before else f" {words}"))
        return F.struct(cut.alias("out"), upto.alias("cur"))

    new = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["cur"] + 1, F.length(text))))
    moved = F.transform(ordered, lambda s, i: s.withField("start", (s["start"] + (i + (1 if before else 0)) * extra).cast("int")).withField("end", (s["end"] + (i + (1 if before else 0)) * extra).cast("int")))
    return F.struct(new.alias("text"), moved.cast(f"array<{SPAN}>").alias("spans"))


def educational_frame(spans: Column, key: Column) -> Column:
    """A sentence on the format of the first typed span."""
    kind = F.try_element_at(F.transform(F.filter(spans, lambda s: F.coalesce(s["type"], F.lit("")) != ""), lambda s: s["type"]), F.lit(1))
    out = F.when(kind.isNull(), F.lit("")).otherwise(F.lit(L.GENERIC_FRAME))
    for t, frames in L.FRAMES.items():
        out = F.when(kind == t, choose(frames, key, "frame")).otherwise(out)
    return out


def inject_prefix(text: Column, spans: Column, key: str, by: Column) -> Column:
    """struct<text,spans>: a prompt-injection prefix; by picks the educational sentence."""
    if key != "pi_educational_framing" and key not in L.PREFIXES:
        raise ValueError(f"unknown prompt injection {key!r}")
    prefix = educational_frame(spans, by) if key == "pi_educational_framing" else F.lit(L.PREFIXES[key])
    return F.struct(F.concat(prefix, text).alias("text"), shift_spans(spans, F.length(prefix)).cast(f"array<{SPAN}>").alias("spans"))


def content_attack(text: Column, spans: Column, technique: str, by: Column) -> Column:
    """One named context attack."""
    if technique == "supportive_context":
        return supportive_context(text, spans)
    if technique.startswith("affix_"):
        return affix(text, spans, technique)
    if technique.startswith("pi_"):
        return inject_prefix(text, spans, technique, by)
    raise ValueError(f"unknown technique {technique!r}")
