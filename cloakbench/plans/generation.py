"""Queries on generated prompts and corpora, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attacks as A
from ..functions import lexicon as L
from ..functions import pools as P
from ..functions import spans as S
from ..operators import corpus, prompts
from .queries import _PIECES, _SQUARES, SQL_HOMOGLYPH, VALUES, _clean_positives, q, query, sql_choose, sql_list, sql_pick, table, texts


def sql_weighted(options: dict, key: str, salt: str) -> str:
    low, cases, names = 0.0, [], list(options)
    for name in names[:-1]:
        low += options[name]
        cases.append(f"WHEN {sql_pick(key, salt, prompts.PARTS)} < {round(low * prompts.PARTS)} THEN {q(str(name))}")
    return f"CASE {' '.join(cases)} ELSE {q(str(names[-1]))} END"


def sql_drawn(pool: list[str], n: str, key: str, salt: str) -> str:
    return f"list_transform(list_sort(list_transform({sql_list(pool)}, lambda x: {{'h': md5(concat_ws('|', CAST({key} AS VARCHAR), {q(salt)}, x)), 'v': x}})), lambda s: s.v)[1:{n}]"


def keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("uid"))


# --- attributes --------------------------------------------------------------------------------------

_TOPICS = sql_drawn(P.TOPICS, f"{sql_pick('uid', 'n_topics', 2)} + 1", "uid", "topic")
_OPENER = f"CASE WHEN {sql_pick('uid', 'pool', 2)} = 0 THEN {sql_choose(P.LOWERCASE_OPENERS, 'uid', 'opener')} ELSE {sql_choose(P.TITLECASE_OPENERS, 'uid', 'opener')} END"
_KEYS = "k AS (SELECT c_custkey AS uid FROM customer)"


@query(
    "prompt_attributes",
    f"WITH {_KEYS} SELECT uid, array_to_string({_TOPICS}, ',') AS topics, {sql_choose(P.TONES, 'uid', 'tone')} AS tone, {sql_weighted(P.LENGTHS, 'uid', 'length')} AS length, {_OPENER} AS opener, {sql_choose(P.SCENARIOS, 'uid', 'scenario')} AS scenario FROM k",
)
def prompt_attributes(spark, d):
    a = prompts.attributes(F.col("uid"))
    return keys(spark, d).select("uid", F.array_join(a["topics"], ",").alias("topics"), *[a[n].alias(n) for n in ("tone", "length", "opener", "scenario")])


_ONE = sql_choose(L.TYPES, "uid", "one")
_MORE = f"list_sort({sql_drawn(L.TYPES, sql_pick('uid', 'n_types', 2) + ' + {0}', 'uid', 'types').replace('{', '{{').replace('}', '}}').replace('{{0}}', '{0}')})"
_MIX = f"""{_KEYS}, b AS (SELECT uid, {sql_weighted(P.PII_MIX, 'uid', 'bucket')} AS bucket FROM k),
mix AS (SELECT uid, bucket, CASE bucket WHEN 'single' THEN [{_ONE}] WHEN 'cluster' THEN list_transform(range(0, {sql_pick('uid', 'n_same', 2)} + 2), lambda i: {_ONE}) WHEN 'multi' THEN {_MORE.format(2)} ELSE {_MORE.format(4)} END AS types FROM b)"""


@query("pii_mix", f"WITH {_MIX} SELECT uid, bucket, array_to_string(types, ',') AS types FROM mix")
def pii_mix(spark, d):
    return keys(spark, d).select("uid", prompts.pii_mix(F.col("uid")).alias("m")).select("uid", "m.bucket", F.array_join("m.types", ",").alias("types"))


@query("lookalike_mix", f"WITH {_KEYS} SELECT uid, array_to_string(list_sort({sql_drawn(P.LOOKALIKES, 'CAST(' + sql_weighted(P.LOOKALIKE_COUNTS, 'uid', 'n_lookalikes') + ' AS BIGINT)', 'uid', 'lookalike')}), ',') AS kinds FROM k")
def lookalike_mix(spark, d):
    return keys(spark, d).select("uid", F.array_join(prompts.lookalikes(F.col("uid")), ",").alias("kinds"))


_ABOUT = f"{_OPENER} || ' ' || replace({q(prompts.SUBJECTS)}, '{{}}', ({_TOPICS})[1]) || '.'"
_asked = lambda names: f"replace({sql_choose(prompts.CONNECTORS, 'uid', 'connector')}, '{{}}', {names})"
_CLOSING = f"nullif({sql_choose(prompts.CLOSINGS, 'uid', 'closing')}, '')"
_TEMPLATE = f"concat_ws(' ', {_ABOUT}, {_asked("array_to_string(list_transform(types, lambda t: " + q("{{") + " || t || " + q("}}") + "), ', ')")}, {_CLOSING})"


@query("generate_inputs", f"WITH {_MIX} SELECT uid, uid % 3 <> 0 AS positive, CASE WHEN uid % 3 <> 0 THEN {_TEMPLATE} ELSE {sql_choose(prompts.PLAIN, 'uid', 'plain')} END AS template, CAST(NULL AS VARCHAR) AS error FROM mix")
def generate_inputs(spark, d):
    return prompts.generated_inputs(keys(spark, d).withColumn("positive", F.col("uid") % 3 != 0))


#: VALUES for any key column: customer keys become keys of placeholders.
_PLACES = f"""{_MIX}, places AS (SELECT uid, unnest(types) AS type, unnest(range(0, len(types))) AS i FROM mix),
customer_k AS (SELECT uid * 10 + i AS c_custkey, 'user#' || CAST(uid * 10 + i AS VARCHAR) AS c_name FROM places),
{VALUES[: VALUES.index('kinds AS')].strip().rstrip(',').replace('FROM customer)', 'FROM customer_k)')},
filled AS (SELECT p.uid, p.i, p.type, CASE p.type {" ".join(f"WHEN '{t}' THEN m.{t}" for t in L.TYPES)} END AS v FROM places p JOIN made m ON m.uid = p.uid * 10 + p.i),
joined AS (SELECT uid, string_agg(v, ', ' ORDER BY i) AS vs, count(*) AS n, arg_min(v, i) AS first_value FROM filled GROUP BY uid)"""
_FILLED = f"concat_ws(' ', {_ABOUT}, {_asked('vs')}, {_CLOSING})"


@query("inject_values", f"WITH {_PLACES} SELECT uid, {_FILLED} AS llm_input, n AS n_spans, first_value, CAST(length({_ABOUT}) + 1 + instr({sql_choose(prompts.CONNECTORS, 'uid', 'connector')}, '{{}}') - 1 AS BIGINT) AS first_start FROM joined")
def inject_values(spark, d):
    rows = keys(spark, d).select("uid", prompts.fill(prompts.input_template(F.col("uid"), F.lit(True)), F.col("uid")).alias("x"))
    s = F.col("x.spans")
    return rows.select("uid", F.col("x.text").alias("llm_input"), F.size(s).cast("long").alias("n_spans"), s[0]["value"].alias("first_value"), s[0]["start"].cast("long").alias("first_start"))


_H, _S = "md5(CAST(uid AS VARCHAR))", "sha256(CAST(uid AS VARCHAR))"


@query(
    "mock_values",
    f"""WITH {VALUES} SELECT uid, substr(credit_card_number, 1, 15) || CAST((CAST(substr(credit_card_number, 16, 1) AS INTEGER) + 1 + {sql_pick('uid', 'card', 9)}) % 10 AS VARCHAR) AS invalid_card,
    substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4) || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12) AS uuid, {_S} AS sha256, {_H} AS md5,
    {" || ':' || ".join(f"substr({_H}, {i}, 2)" for i in (1, 3, 5, 7, 9, 11))} AS mac, 'SN-' || upper(substr({_H}, 1, 10)) AS serial, '1Z' || upper(substr({_H}, 3, 16)) AS tracking, 'sk-' || substr({_S}, 1, 32) AS api_key, false AS card_valid FROM made""",
)
def mock_values(spark, d):
    from ..functions.checks import card_valid

    made = prompts.mock_values(F.col("uid"))
    return keys(spark, d).select("uid", *[c.alias(n) for n, c in made.items()]).withColumn("card_valid", card_valid(F.col("invalid_card")))


_PERTURBED = f"""CASE {sql_pick('uid', 'perturb', 4)} WHEN 0 THEN CASE WHEN instr(t, ' ') > 0 THEN substr(t, 1, instr(t, ' ')) || ' ' || substr(t, instr(t, ' ') + 1) ELSE t END WHEN 1 THEN t || ' [end]' WHEN 2 THEN lower(substr(t, 1, 1)) || substr(t, 2) ELSE t END"""


@query(
    "mock_responses",
    f"""WITH {VALUES} SELECT uid, {_PERTURBED} AS fuzzy_text, ({sql_pick('uid', 'score', 71)} + 30) / 100.0::DOUBLE AS score, {sql_pick('uid', 'exists', 10)} < 8 AS value_exists, 'The build ' || {_S} || ' failed.' AS hard_negative FROM texts""",
)
def mock_responses(spark, d):
    k, t = F.col("uid"), F.col("llm_input")
    field = lambda schema, name: F.get_json_object(prompts.mock_response(schema, t, k), f"$.{name}")
    return texts(spark, d).select("uid", field("pii_fuzzer_schema", "fuzzy_text").alias("fuzzy_text"), field("pii_comparison", "score").cast("double").alias("score"), field("pii_exists_validation", "result").cast("boolean").alias("value_exists"), field("hard_negative_schema", "llm_input").alias("hard_negative"))


@query(
    "flatten_responses",
    f"""WITH {VALUES} SELECT uid, CASE WHEN uid % 7 > 0 THEN 'true' END AS pii_detected, CASE WHEN uid % 7 > 0 THEN ({sql_pick('uid', 'proba', 31)} + 70) / 100.0::DOUBLE END AS predicted_proba, CASE WHEN uid % 7 > 0 THEN v END AS first_value, CASE WHEN uid % 7 > 0 THEN CAST(length(a) AS BIGINT) ELSE -1 END AS first_start, CAST(NULL AS DOUBLE) AS perplexity FROM texts""",
)
def flatten_responses(spark, d):
    """Answers of the structured-output detector as columns; every seventh is no JSON."""
    own = F.filter(S.resolve_overlaps(S.detect(F.col("llm_input"))), lambda s: s["start"] == F.array_min(F.transform(S.resolve_overlaps(S.detect(F.col("llm_input"))), lambda x: x["start"])))
    answer = prompts.mock_response("llm_pii_detector_schema", F.col("llm_input"), F.col("uid"))
    rows = texts(spark, d).select("uid", "llm_input", F.when(F.col("uid") % 7 == 0, F.lit("{oops")).otherwise(answer).alias("response"), own[0].alias("own"))
    flat = prompts.flatten_responses(rows)
    first = F.array_sort(F.filter("spans", lambda s: s["value"] == F.col("own")["value"]), lambda a, b: a["start"] - b["start"])[0]
    return flat.select("uid", F.col("pii_detected").cast("string").alias("pii_detected"), "predicted_proba", first["value"].alias("first_value"), F.coalesce(first["start"].cast("long"), F.lit(-1)).alias("first_start"), "perplexity")


# --- corpora -----------------------------------------------------------------------------------------

_BULK = f"""WITH {VALUES}, u AS (SELECT texts.uid, kind, t, v, a, z, w, text, {sql_pick('texts.uid', 'category', 10000)} AS u, md5(CAST(texts.uid AS VARCHAR)) AS h, {sql_pick('texts.uid', 'look', 4)} AS look FROM texts LEFT JOIN documents ON doc_id = texts.uid),
hard AS (SELECT *, CASE look WHEN 0 THEN 'The build artefact has the checksum ' || h || '.' WHEN 1 THEN 'Trace id ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || ' was slow.'
  WHEN 2 THEN 'The switch with address ' || {" || ':' || ".join(f"substr(h, {i}, 2)" for i in (1, 3, 5, 7, 9, 11))} || ' is down.' ELSE 'Part SN-' || upper(substr(h, 1, 10)) || ' arrived.' END AS hn FROM u),
bulk AS (SELECT uid, CASE WHEN u < 9000 THEN 'negative' WHEN u < 9500 THEN 'positive' ELSE 'hard_negative' END AS category,
  CASE WHEN u < 9000 THEN coalesce(text, 'How do I reverse a linked list in Python?') WHEN u < 9500 THEN t ELSE hn END AS llm_input, CASE WHEN u >= 9000 AND u < 9500 THEN v END AS first_value, CASE WHEN u >= 9000 AND u < 9500 THEN CAST(length(a) AS BIGINT) ELSE -1 END AS first_start,
  CASE WHEN u >= 9000 AND u < 9500 THEN CASE WHEN w IS NULL THEN 1 ELSE 2 END ELSE 0 END AS n_spans FROM hard)"""


@query("corpus_bulk", _BULK + " SELECT * FROM bulk")
def corpus_bulk(spark, d):
    s = F.try_element_at("pii_spans", F.lit(1))
    return corpus.bulk(table(spark, d, "customer"), table(spark, d, "documents")).select("uid", "category", "llm_input", s["value"].alias("first_value"), F.coalesce(s["start"].cast("long"), F.lit(-1)).alias("first_start"), F.size("pii_spans").alias("n_spans"))


@query("bulk_resume", _BULK + " SELECT uid, category, llm_input FROM bulk WHERE uid % 3 <> 0")
def bulk_resume(spark, d):
    """What is left to generate after a third of the rows exists."""
    whole = corpus.bulk(table(spark, d, "customer"), table(spark, d, "documents"))
    return corpus.bulk_rest(whole.where("uid % 3 = 0"), table(spark, d, "customer"), table(spark, d, "documents")).select("uid", "category", "llm_input")


_BERNOULLI = f"""WITH {VALUES}, c AS (SELECT uid, CASE WHEN {sql_pick('uid', 'bernoulli', 10000)} < 3000 THEN 'positive' WHEN {sql_pick('uid', 'hard', 10)} = 0 THEN 'hard_negative' ELSE 'negative' END AS category FROM texts)"""


@query("bernoulli_dataset", _BERNOULLI + " SELECT row_number() OVER (ORDER BY category <> 'positive', uid) - 1 AS uid, uid AS source_uid, category FROM c")
def bernoulli_dataset(spark, d):
    """The older generator: a coin for each row, rows with values first, ids dense from 0."""
    return corpus.bernoulli(table(spark, d, "customer"), table(spark, d, "documents"), 0.3).select("uid", F.col("input_id").alias("source_uid"), "category")


@query("pii_first", _BULK + " SELECT row_number() OVER (ORDER BY n_spans = 0, uid) - 1 AS uid, uid AS source_uid, n_spans > 0 AS has_pii FROM bulk")
def pii_first(spark, d):
    whole = corpus.bulk(table(spark, d, "customer"), table(spark, d, "documents"))
    return corpus.pii_first(whole.withColumn("source_uid", F.col("uid"))).select("uid", "source_uid", (F.size("pii_spans") > 0).alias("has_pii"))


@query("baseline_categories", "SELECT c_custkey AS uid, ['negative', 'positive', 'hard_negative'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS category FROM customer WHERE c_custkey % 4 < 3")
def baseline_categories(spark, d):
    names = F.array(*map(F.lit, [*L.CATEGORIES, "other"]))
    rows = keys(spark, d).withColumn("category", F.element_at(names, (F.col("uid") % 4 + 1).cast("int")))
    return corpus.baseline_categories(rows)


# --- attacks over whole rows -------------------------------------------------------------------------


def sql_fuzz(v: str, technique: str, key: str) -> str:
    """The value expression v under a technique; key is the SQL of the row's key."""
    by = f"{key} || '#' || {v}"
    pick_of = lambda options, make: "CASE " + sql_choose(options, by, technique) + " " + " ".join(f"WHEN {q(o)} THEN {make(o)}" for o in options) + " END"
    chars = f"string_split({v}, '')"
    if technique == "homoglyph":
        return SQL_HOMOGLYPH.format(v)
    if technique == "emojify":
        return f"translate(regexp_replace({v}, '([0-9])', '\\1{L.KEYCAP}', 'g'), {q(L.LOWER + L.UPPER + '@')}, {q(_SQUARES)})"
    if technique == "chunking":
        pieces = _PIECES.replace("(v, '[a-zA-Z0-9]+", f"({v}, '[a-zA-Z0-9]+")
        return f"CASE WHEN len(flatten({pieces})) > 1 THEN '\"' || array_to_string(flatten({pieces}), '\" + \"') || '\"' ELSE array_to_string(flatten({pieces}), '') END"
    if technique == "char_to_word":

        def words(language: str) -> str:
            known = dict(zip(L.DIGITS, L.NUMBER_WORDS[language])) | L.SYMBOL_WORDS
            return f"array_to_string(list_transform({chars}, lambda c: CASE c " + " ".join(f"WHEN {q(k)} THEN {q(f'({w})')}" for k, w in known.items()) + " ELSE c END), '')"

        return pick_of(list(L.NUMBER_WORDS), words)
    if technique == "invisible_chars":
        return pick_of(L.ZERO_WIDTH + L.COMBINING, lambda o: f"regexp_replace({v}, '([\\p{{L}}\\p{{N}}])', '\\1{o}', 'g')" if o in L.COMBINING else f"array_to_string({chars}, '{o}')")
    if technique == "separators":
        return pick_of(L.SEPARATORS, lambda o: f"array_to_string({chars}, '{o}')")
    return v


_FUZZED = f"""{VALUES}, top AS (SELECT max(uid) AS top FROM pos),
fz0 AS ({" UNION ALL ".join(f"SELECT {n + 1} AS step, {q(t)} AS technique, uid, kind, a, z, v, w, {sql_fuzz('v', t, 'uid')} AS fv, {sql_fuzz('w', t, 'uid')} AS fw FROM pos" for n, t in enumerate(L.FUZZY_TECHNIQUES))}),
fz AS (SELECT fz0.*, top + row_number() OVER (ORDER BY step, uid) AS fuid, a || fv || z || CASE WHEN w IS NULL THEN '' ELSE ' Also write to ' || fw || '.' END AS t, length(a) AS s1, length(a || fv) AS e1, length(a || fv || z || ' Also write to ') AS s2, length(a || fv || z || ' Also write to ' || fw) AS e2 FROM fz0, top)"""


@query(
    "corpus_fuzzy",
    f"""WITH {_FUZZED} SELECT fuid AS uid, uid AS input_id, technique, t AS llm_input, CAST(s1 AS BIGINT) AS first_start, CAST(e1 AS BIGINT) AS first_end, fv AS first_fuzzy, v AS first_value,
    CASE WHEN w IS NOT NULL THEN CAST(s2 AS BIGINT) ELSE -1 END AS second_start, CASE WHEN w IS NOT NULL THEN fw END AS second_fuzzy FROM fz""",
)
def corpus_fuzzy(spark, d):
    s, more = F.col("pii_spans")[0], F.try_element_at("pii_spans", F.lit(2))
    rows = corpus.derived_positives(corpus.with_fuzzy(_clean_positives(spark, d)))
    return rows.select("uid", "input_id", F.col("attack_target.pii")[0].alias("technique"), "llm_input", s["start"].cast("long").alias("first_start"), s["end"].cast("long").alias("first_end"), s["value_fuzzy"].alias("first_fuzzy"), s["value"].alias("first_value"), F.coalesce(more["start"].cast("long"), F.lit(-1)).alias("second_start"), more["value_fuzzy"].alias("second_fuzzy"))


def _sql_terms(t: str, kind: str) -> str:
    p = q(A.term_pattern(L.TERMS[kind] + L.UNIVERSAL_TERMS))
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, {p}), regexp_extract_all({t}, {p})), lambda x: x[1] || coalesce({SQL_HOMOGLYPH.format('x[2]')}, '')), '')"


def sql_supportive(name: str, source: str, replace_with: str = "emoji") -> str:
    """CTEs that rewrite t and locate again: source has t, kind, w, f1, s1, e1, f2, s2, e2 (f: the text to find)."""
    text = "t"
    for kind, new in L.REPLACEMENTS[replace_with].items():
        text = f"regexp_replace({text}, {q('(?i)' + A.name_pattern(L.VARIATIONS[kind]))}, {q(new)}, 'g')"
    out, last = [f"{name}0 AS (SELECT * REPLACE ({text} AS t) FROM {source})"], f"{name}0"
    for n, kind in enumerate(L.TYPES, 1):
        here = "kind = 'email' OR w IS NOT NULL" if kind == "email" else f"kind = '{kind}'"
        out.append(f"{name}{n} AS (SELECT * REPLACE (CASE WHEN {here} THEN {_sql_terms('t', kind)} ELSE t END AS t) FROM {last})")
        last = f"{name}{n}"
    out.append(f"{name}6 AS (SELECT *, instr(t, f1) AS at1 FROM {last})")
    out.append(f"{name}7 AS (SELECT * REPLACE (CASE WHEN at1 > 0 THEN at1 - 1 ELSE s1 END AS s1, CASE WHEN at1 > 0 THEN at1 - 1 + length(f1) ELSE e1 END AS e1), CASE WHEN at1 > 0 THEN at1 - 1 + length(f1) ELSE 0 END AS last1 FROM {name}6)")
    out.append(f"{name}8 AS (SELECT *, instr(substr(t, last1 + 1), f2) AS at2 FROM {name}7)")
    out.append(f"{name} AS (SELECT * EXCLUDE (at1, at2, last1) REPLACE (CASE WHEN at2 > 0 THEN last1 + at2 - 1 ELSE s2 END AS s2, CASE WHEN at2 > 0 THEN last1 + at2 - 1 + length(f2) ELSE e2 END AS e2) FROM {name}8)")
    return ",\n".join(out)


_PLAIN = f"{VALUES}, plain AS (SELECT uid, kind, w, t, v AS f1, length(a) AS s1, length(a || v) AS e1, w AS f2, length(a || v || z || ' Also write to ') AS s2, length(a || v || z || ' Also write to ' || w) AS e2 FROM texts)"

for _words in L.REPLACEMENTS:
    query(
        "ctx_supportive" if _words == "emoji" else f"ctx_supportive_{_words}",
        f"WITH {_PLAIN}, {sql_supportive('sc', 'plain', _words)} SELECT uid, t AS llm_input, f1 AS value, CAST(s1 AS BIGINT) AS start, CAST(e1 AS BIGINT) AS \"end\" FROM sc UNION ALL SELECT uid, t, f2, CAST(s2 AS BIGINT), CAST(e2 AS BIGINT) FROM sc WHERE f2 IS NOT NULL",
    )(
        lambda spark, d, words=_words: texts(spark, d)
        .withColumn("x", A.supportive_context(F.col("llm_input"), F.col("pii_spans"), words))
        .select("uid", F.col("x.text").alias("llm_input"), F.explode("x.spans").alias("s"))
        .select("uid", "llm_input", F.col("s.value").alias("value"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))
    )


def sql_content(name: str, source: str, technique: str, key: str) -> str:
    """One CTE for an affix or a prefix over the columns of sql_supportive."""
    if technique.startswith("affix_"):
        words, before = L.AFFIXES[technique]
        n, put = len(words) + 1, q(f"{words} " if before else f" {words}")
        c1, c2 = ("s1", "s2") if before else ("e1", "e2")
        one = f"substr(t, 1, {c1}) || {put} || substr(t, {c1} + 1)"
        two = f"substr(t, 1, {c1}) || {put} || substr(t, {c1} + 1, {c2} - {c1}) || {put} || substr(t, {c2} + 1)"
        k1, k2 = (n, 2 * n) if before else (0, n)
        return f"{name} AS (SELECT * REPLACE (CASE WHEN f2 IS NULL THEN {one} ELSE {two} END AS t, s1 + {k1} AS s1, e1 + {k1} AS e1, s2 + {k2} AS s2, e2 + {k2} AS e2) FROM {source})"
    if technique == "pi_educational_framing":
        prefix = "CASE kind " + " ".join(f"WHEN '{t}' THEN {sql_choose(f, key, 'frame')}" for t, f in L.FRAMES.items()) + " END"
    else:
        prefix = q(L.PREFIXES[technique])
    return f"{name}p AS (SELECT *, {prefix} AS pre FROM {source}), {name} AS (SELECT * EXCLUDE (pre) REPLACE (pre || t AS t, s1 + length(pre) AS s1, e1 + length(pre) AS e1, s2 + length(pre) AS s2, e2 + length(pre) AS e2) FROM {name}p)"


def _sql_adversarial() -> str:
    parts = [f"{_FUZZED}, src AS (SELECT fuid AS uid, uid AS input_id, technique, kind, w, t, fv AS f1, s1, e1, fw AS f2, s2, e2 FROM fz)", sql_supportive("sc", "src")]
    ends = []
    for n, names in enumerate(L.CONTENT_TECHNIQUES):
        last = "sc"
        for m, technique in enumerate(names[1:]):
            parts.append(sql_content(f"c{n}_{m}", last, technique, "uid"))
            last = f"c{n}_{m}"
        ends.append(f"SELECT {n + 1} AS step, {q('+'.join(names))} AS context, uid, input_id, technique, t, f1, s1, e1, f2, s2 FROM {last}")
    parts.append("every AS (" + " UNION ALL ".join(ends) + "), mx AS (SELECT max(fuid) AS mx FROM fz)")
    return "WITH " + ",\n".join(parts) + " SELECT mx + row_number() OVER (ORDER BY uid, step) AS uid, input_id, technique, context, t AS llm_input, CAST(s1 AS BIGINT) AS first_start, CAST(e1 AS BIGINT) AS first_end, CASE WHEN f2 IS NOT NULL THEN CAST(s2 AS BIGINT) ELSE -1 END AS second_start FROM every, mx"


@query("corpus_adversarial", _sql_adversarial())
def corpus_adversarial(spark, d):
    """Every clean positive under every character attack under every list of context attacks."""
    whole = corpus.with_content(corpus.with_fuzzy(_clean_positives(spark, d)))
    s, more = F.col("pii_spans")[0], F.try_element_at("pii_spans", F.lit(2))
    rows = whole.where("size(attack_target.context) > 0")
    return rows.select("uid", "input_id", F.col("attack_target.pii")[0].alias("technique"), F.array_join("attack_target.context", "+").alias("context"), "llm_input", s["start"].cast("long").alias("first_start"), s["end"].cast("long").alias("first_end"), F.coalesce(more["start"].cast("long"), F.lit(-1)).alias("second_start"))
