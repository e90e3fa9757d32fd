"""Queries on model backends, filters, parameters of attacks and tables in and out, and the same in SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attacks as A
from ..functions import checks as C
from ..functions import lexicon as L
from ..functions import spans as S
from ..operators import adaptive, backends, corpus, ratios, sampling
from ..sources import tables
from .generation import keys, sql_fuzz
from .queries import (
    DATA, LOOK_CTE, PREDICTED, QUERIES, SQL, TEST_QUOTAS, VALUES, _CASES, _clean_positives, _plain, dataset, looks, predictions, q, query, sql_choose, sql_list, sql_pick, table, texts, values,
)

# --- models ------------------------------------------------------------------------------------------

_LOOKS = f"regexp_matches(llm_input, {q('(?i)' + backends.LOOKS)})"
for _model in [m for m in L.MODELS if any(m.startswith(f) for f in backends.FAMILIES)]:
    _token = backends.FAMILIES[backends.family_of(_model)][3]
    query(
        f"detect_{_model.replace('-', '_').replace('.', '_')}",
        f"WITH {DATA} SELECT uid, {q(_model)} AS model, CAST(CASE WHEN {_LOOKS} THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN {_LOOKS} THEN 'pii' END AS type, round(exp({-backends.OFFLINE_LOGPROBS[_token]}::DOUBLE), 6) AS perplexity FROM dataset",
    )(
        lambda spark, d, m=_model: backends.detect_with(dataset(spark, d), m).select("uid", "model", F.size("prediction").cast("long").alias("n"), F.try_element_at("prediction", F.lit(1))["type"].alias("type"), F.round("perplexity", 6).alias("perplexity"))
    )

QUERIES["guard_backend"] = lambda spark, d: backends.detect_with(dataset(spark, d), "qwen-guard-4b").select("uid", "model", F.size("prediction").cast("long").alias("n"))
SQL["guard_backend"] = f"WITH {DATA} SELECT uid, 'qwen-guard-4b' AS model, CAST(CASE WHEN {_LOOKS} THEN 1 ELSE 0 END AS BIGINT) AS n FROM dataset"

_ENTITIES = f"""e0 AS (SELECT uid, llm_input, regexp_split_to_array(llm_input, {q(f"(?:{backends.MAILS})|(?:{backends.RUNS})")}) AS p, regexp_extract_all(llm_input, {q(f"(?:{backends.MAILS})|(?:{backends.RUNS})")}) AS h FROM dataset),
e1 AS (SELECT *, unnest(range(1, len(h) + 1)) AS j FROM e0),
ents AS (SELECT uid, h[j] AS value, contains(h[j], '@') AS mail, CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM e1)"""


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("uid", "model", F.explode("prediction").alias("s")).select("uid", "model", F.col("s.type").alias("type"), F.col("s.value").alias("value"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


for _model in backends.NER:
    query(
        f"detect_{_model.replace('-', '_')}",
        f"WITH {DATA}, {_ENTITIES} SELECT uid, {q(_model)} AS model, CASE WHEN mail THEN 'email' ELSE 'phone_number' END AS type, value, start, start + length(value) AS \"end\" FROM ents WHERE NOT regexp_matches(lower(value), 'email|e-addy')",
    )(lambda spark, d, m=_model: _spans(backends.detect_with(dataset(spark, d), m)))

_LUHN_ALL = "regexp_full_match({0}, '[0-9]+') AND list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 0 THEN TRY_CAST({0}[i] AS INTEGER) WHEN TRY_CAST({0}[i] AS INTEGER) > 4 THEN 2 * TRY_CAST({0}[i] AS INTEGER) - 9 ELSE 2 * TRY_CAST({0}[i] AS INTEGER) END)) % 10 = 0"
_DIGITS = "replace(value, '-', '')"
_ACCOUNT = f"""CASE WHEN mail THEN 'email' WHEN {_LUHN_ALL.format(_DIGITS)} THEN 'credit_card_number' WHEN length({_DIGITS}) = 9 AND substr({_DIGITS}, 1, 3) NOT IN ('000', '666') AND substr({_DIGITS}, 1, 3) < '900' AND substr({_DIGITS}, 4, 2) <> '00' AND substr({_DIGITS}, 6, 4) <> '0000' THEN 'ssn' ELSE 'account_number' END"""


@query("detect_openai_privacy_filter", f"WITH {DATA}, {_ENTITIES} SELECT uid, 'openai-privacy-filter' AS model, {_ACCOUNT} AS type, value, start, start + length(value) AS \"end\" FROM ents")
def detect_privacy(spark, d):
    return _spans(backends.detect_with(dataset(spark, d), backends.PRIVACY))


_P = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-1.5::DOUBLE) + exp(-1.9::DOUBLE)))"


@query("detect_llama_3_2_1b", f"WITH {DATA} SELECT uid, CAST(CASE WHEN {_LOOKS} THEN 1 ELSE 0 END AS BIGINT) AS n, round(1.0 / {_P}, 6) AS perplexity FROM dataset")
def detect_slm(spark, d):
    """A small model's first token; safe texts have their top logit on a safe token."""
    return backends.detect_with(dataset(spark, d), backends.SLM).select("uid", F.size("prediction").cast("long").alias("n"), F.round("perplexity", 6).alias("perplexity"))


@query("detect_gpt_4o_mini", f"WITH {DATA}, {_ENTITIES} SELECT uid, 'gpt-4o-mini' AS model, CASE WHEN mail THEN 'email' ELSE 'phone_number' END AS type, value, start, start + length(value) AS \"end\", 1.25::DOUBLE AS perplexity FROM ents")
def detect_llm(spark, d):
    got = backends.detect_with(dataset(spark, d), backends.LLM)
    return _spans(got).join(got.select("uid", "perplexity"), "uid")


@query("detect_presidio_fuzzy")
def detect_fuzzy(spark, d):
    """Rule and tolerant recognisers, overlaps resolved, IBANs that fail their check dropped."""
    return _spans(backends.detect_with(dataset(spark, d), "presidio-fuzzy"))


def _failing():
    def model(batch: list[str]) -> list[str]:
        if any("uid 7" in t for t in batch):
            raise RuntimeError("out of memory " * 20)
        return ["safe" for _ in batch]

    return model


@query("skip_on_error", "SELECT 'llama-guard-3-8b' AS model, substr(repeat('out of memory ', 20), 1, 80) AS reason")
def skip_on_error(spark, d):
    """A batch that fails: its model is skipped with a reason of 80 characters."""
    rows = keys(spark, d).select("uid", F.concat(F.lit("uid "), F.col("uid").cast("string")).alias("llm_input"))
    return backends.skipped_models(backends.detect_with(rows, "llama-guard-3-8b", _failing, keep_errors=True))


@query("left_padding", "WITH t AS (SELECT c_custkey AS uid, c_custkey // 32 AS batch, c_custkey % 5 + 1 AS n FROM customer), m AS (SELECT batch, max(n) AS most FROM t GROUP BY batch) SELECT uid, t.batch, most AS width, most - n AS padding, n * uid AS total FROM t JOIN m ON t.batch = m.batch")
def left_padding(spark, d):
    rows = backends.batches_of(keys(spark, d)).withColumn("ids", F.array_repeat(F.col("uid").cast("int"), (F.col("uid") % 5 + 1).cast("int")))
    sums = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    padded = backends.left_padded(rows)
    return padded.select("uid", "batch", F.size("ids").cast("long").alias("width"), (F.size("mask") - sums("mask")).alias("padding"), sums("ids").alias("total"))


# --- filters -----------------------------------------------------------------------------------------


@query("score_threshold", f"WITH {VALUES} SELECT uid, v AS value FROM pos WHERE uid % 10 >= 3")
def score_threshold(spark, d):
    hits = F.array(S.span(F.col("v"), None, None, F.col("kind"), None, (F.col("uid") % 10) / F.lit(10.0)))
    return values(spark, d).select("uid", F.explode(S.above(hits)).alias("s")).select("uid", F.col("s.value").alias("value"))


@query("null_text_guard", f"WITH {VALUES} SELECT uid, CAST(CASE WHEN uid % 3 = 0 THEN 0 WHEN w IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n FROM texts")
def null_text_guard(spark, d):
    rows = texts(spark, d).withColumn("llm_input", F.when(F.col("uid") % 3 != 0, F.col("llm_input")))
    found = backends.detect_with(rows, "presidio").select("uid", S.resolve_overlaps(F.col("prediction")).alias("p"))
    return found.select("uid", F.size("p").cast("long").alias("n"))


@query("edit_budgets", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {d}, {s}, {round(ratios.LOOSE[k][1] / (s + d + 1) ** 2, 2)}::DOUBLE)" for k, p in {"iban": [(1, 0), (0, 1)], "ssn": [(1, 0), (2, 0), (0, 1), (1, 1)], "email": [(1, 0), (0, 1)], "credit_card_number": [(1, 0), (3, 0), (0, 3), (0, 4), (2, 2)]}.items() for d, s in p) + ") t(type, deletions, substitutions, score)")
def edit_budgets(spark, d):
    return ratios.budget_table(spark)


def _sql_text_case(text: str) -> str:
    def test(name: str, p: str) -> str:
        if name == "ipv6_compressed":  # RE2 has no lookahead: a letter a-f in the text stands for it
            return f"contains({text}, '::') AND regexp_matches({text}, {q(p.replace('(?=.*?[a-fA-F])', ''))}) AND regexp_matches({text}, '[a-fA-F]')"
        return f"regexp_matches({text}, {q(_plain(p))})"

    return "CASE " + " ".join(f"WHEN {test(n, p)} THEN '{n}'" for n, p in L.TEXT_PATTERNS.items()) + " END"


SQL["hard_negative_input"] = f"SELECT doc_id, {_sql_text_case('text')} AS pattern FROM documents"


@query("hard_negative_cases", f"WITH {LOOK_CTE} SELECT uid, {_sql_text_case(chr(40) + q('Trace ') + ' || value || ' + q(' was slow.') + ')')} AS pattern FROM looks")
def hard_negative_cases(spark, d):
    """Each kind of lookalike inside a sentence."""
    return looks(spark, d).select("uid", C.lookalike_text(F.concat(F.lit("Trace "), "value", F.lit(" was slow."))).alias("pattern"))


# --- parameters of attacks ---------------------------------------------------------------------------

for _language in L.NUMBER_WORDS:
    _known = dict(zip(L.DIGITS, L.NUMBER_WORDS[_language])) | L.SYMBOL_WORDS
    _case = "CASE c " + " ".join(f"WHEN {q(k)} THEN {q(f'_[{w}]')}" for k, w in _known.items()) + " ELSE c END"
    query(f"atk_words_{_language}", f"WITH {VALUES} SELECT uid, array_to_string(list_transform(string_split(v, ''), lambda c: {_case}), '') AS value FROM pos")(
        lambda spark, d, o=_language: values(spark, d).select("uid", A.char_to_word(F.col("v"), o, separator="_", around="[]").alias("value"))
    )

_PART = f"CAST(('0x' || substr(md5(concat_ws('|', CAST(uid AS VARCHAR), CAST(i AS VARCHAR), 'char')), 1, 8)) AS BIGINT) % 10000 < 4000"


def _sql_partial(one: str) -> str:
    return f"array_to_string(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN {_PART} THEN {one} ELSE v[i] END), '')"


@query(
    "atk_partial",
    f"""WITH {VALUES} SELECT uid, {_sql_partial(f"translate(regexp_replace(v[i], '([0-9])', '{chr(92)}1{L.KEYCAP}', 'g'), {q(L.LOWER + L.UPPER + '@')}, {q(L.SQUARED + L.SQUARED + L.AT_EMOJI)})")} AS emojified,
    {_sql_partial("CASE WHEN i > 1 THEN ';' || v[i] ELSE v[i] END")} AS separated, {_sql_partial("CASE WHEN i < length(v) THEN v[i] || '​' ELSE v[i] END")} AS invisible FROM pos""",
)
def atk_partial(spark, d):
    """Each character is attacked by a coin of 0.4."""
    v, k = F.col("v"), F.col("uid")
    return values(spark, d).select("uid", A.emojify(v, 0.4, k).alias("emojified"), A.separated(v, ";", 0.4, k).alias("separated"), A.invisible(v, "​", 0.4, k).alias("invisible"))


@query(
    "atk_rewrite_options",
    f"""WITH {VALUES}, f AS (SELECT *, {sql_pick("uid || '#0'", "span", 10000)} < 5000 AS hit FROM pos)
    SELECT uid, a || CASE WHEN hit THEN upper(v) ELSE v END || z AS llm_input, CAST(length(a) AS BIGINT) AS start, CASE WHEN hit THEN upper(v) END AS value_fuzzy FROM f WHERE w IS NULL""",
)
def atk_rewrite_options(spark, d):
    """Only spans that a coin of 0.5 picks are rewritten."""
    rows = texts(spark, d).where("size(pii_spans) = 1").withColumn("x", A.rewrite_spans(F.col("llm_input"), F.col("pii_spans"), F.upper, proba=0.5, key=F.col("uid")))
    return rows.select("uid", F.col("x.text").alias("llm_input"), F.col("x.spans")[0]["start"].cast("long").alias("start"), F.col("x.spans")[0]["value_fuzzy"].alias("value_fuzzy"))


for _t in L.FUZZY_TECHNIQUES:
    query(
        f"fuzz_{_t}",
        f"""WITH {VALUES}, f AS (SELECT *, {sql_fuzz('v', _t, 'uid')} AS fv, {sql_fuzz('w', _t, 'uid')} AS fw FROM pos)
        SELECT uid, a || fv || z || CASE WHEN w IS NULL THEN '' ELSE ' Also write to ' || fw || '.' END AS llm_input, v AS value, fv AS value_fuzzy, CAST(length(a) AS BIGINT) AS start FROM f
        UNION ALL SELECT uid, a || fv || z || ' Also write to ' || fw || '.', w, fw, CAST(length(a || fv || z || ' Also write to ') AS BIGINT) FROM f WHERE w IS NOT NULL""",
    )(
        lambda spark, d, t=_t: texts(spark, d)
        .withColumn("x", A.fuzz_spans(F.col("llm_input"), F.col("pii_spans"), t, F.col("uid")))
        .select("uid", F.col("x.text").alias("llm_input"), F.explode("x.spans").alias("s"))
        .select("uid", "llm_input", F.col("s.value").alias("value"), F.col("s.value_fuzzy").alias("value_fuzzy"), F.col("s.start").cast("long").alias("start"))
    )

for _key in L.PREFIXES:
    query(f"ctx_{_key}", f"WITH {VALUES} SELECT uid, {q(L.PREFIXES[_key])} || t AS llm_input, CAST(length(a) + {len(L.PREFIXES[_key])} AS BIGINT) AS start FROM texts")(
        lambda spark, d, k=_key: texts(spark, d).withColumn("x", A.inject_prefix(F.col("llm_input"), F.col("pii_spans"), k, F.col("uid"))).select("uid", F.col("x.text").alias("llm_input"), F.col("x.spans")[0]["start"].cast("long").alias("start"))
    )


# --- samples, adaptive attacks -----------------------------------------------------------------------


@query(
    "sample_report",
    f"""WITH {DATA}, q AS (SELECT bucket, count(*) AS pool, count(DISTINCT cell) AS cells, CASE bucket {_CASES} END AS quota FROM bucketed GROUP BY bucket)
    SELECT bucket, pool, CASE WHEN quota < 1099511627776 THEN quota ELSE -1 END AS cap, CASE WHEN bucket LIKE 'adv%' THEN least(pool, greatest(quota, cells)) ELSE least(pool, quota) END AS sampled FROM q""",
)
def sample_report(spark, d):
    got = sampling.sample_report(dataset(spark, d), TEST_QUOTAS)
    return got.withColumn("cap", F.coalesce("cap", F.lit(-1)))


@query(
    "adaptive_first_steps",
    f"""WITH {VALUES}, a AS (SELECT uid AS attack_id, v AS pii, kind AS pii_type, 'My ' || kind || ' is ' || v AS input FROM pos, (SELECT unnest(['none', 'attacks']) AS aware))
    SELECT attack_id, input, 'plain' AS detector, CAST(regexp_matches(input, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|@') AS INTEGER) AS detected FROM a UNION ALL SELECT attack_id, input, 'loose', CAST(regexp_matches(input, '([0-9][^0-9A-Za-z_]{{0,3}}){{9}}') AS INTEGER) FROM a""",
)
def adaptive_first_steps(spark, d):
    """The first iteration of every attack, at both awareness levels: both detectors answer."""
    traces = adaptive.experiment(values(spark, d).select(F.col("uid").alias("attack_id"), F.col("v").alias("pii"), F.col("kind").alias("pii_type")), max_iters=1)
    return traces.select("attack_id", "input", "detector", "detected")


# --- tables in and out -------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster; a temporary one only where no folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "cloakbench-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", f"WITH {DATA} SELECT uid, category, coalesce(cell, '') AS cell, llm_input || chr(10) || '\"quoted\", ' || uid AS llm_input, v AS value FROM bucketed")
def csv_round_trip(spark, d):
    """Nested columns go out as JSON and come back, with line feeds and quotes in the text."""
    rows = dataset(spark, d).withColumn("llm_input", F.concat("llm_input", F.lit('\n"quoted", '), F.col("uid").cast("string")))
    path = scratch(spark, "csv")
    tables.append_csv(spark, rows.where("uid % 2 = 0"), path)
    tables.append_csv(spark, rows.where("uid % 2 = 1"), path)
    back = tables.read_csv(spark, path, tables.DATASET_CSV)
    return back.select("uid", "category", sampling.cell().alias("cell"), "llm_input", F.col("pii_spans")[0]["value"].alias("value"))


@query("csv_uids", f"WITH {DATA} SELECT uid FROM dataset")
def csv_uids(spark, d):
    """One column of the exchange format."""
    path = scratch(spark, "csv-uids")
    tables.write_csv(dataset(spark, d), path)
    return tables.read_csv(spark, path, tables.DATASET_CSV).select("uid")


@query("model_folders", f"WITH {PREDICTED} SELECT uid, model FROM predictions WHERE model <> 'wildguard-7b' OR uid % 2 = 0")
def model_folders(spark, d):
    """Appended by model, then one model's folder replaced."""
    path, rows = scratch(spark, "predictions"), predictions(spark, d)
    tables.append_predictions(rows.where("uid % 3 = 0"), path)
    tables.append_predictions(rows.where("uid % 3 <> 0"), path)
    tables.replace_models(rows.where("model = 'wildguard-7b' AND uid % 2 = 0"), path)
    return tables.read_predictions(spark, path).select("uid", "model")


@query("damaged_files", f"WITH {PREDICTED} SELECT uid, model FROM predictions WHERE model = 'presidio'")
def damaged_files(spark, d):
    """A folder with a file that is no Parquet: the rest is read."""
    path = scratch(spark, "damaged")
    rows = predictions(spark, d)
    tables.append_predictions(rows.where("model = 'presidio'"), path)
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.mode("append").text(f"{path}/model=wildguard-7b")
    tables.rename_suffix(spark, f"{path}/model=wildguard-7b", ".txt", ".parquet")
    return tables.read_predictions(spark, path, rows.drop("model").schema).select("uid", "model")


@query("detection_resume", f"WITH {DATA} SELECT uid, 'presidio' AS model, CAST(count(*) AS BIGINT) AS times FROM dataset GROUP BY uid")
def detection_resume(spark, d):
    """A stopped detection run goes on with the rows that it lacks; no row is predicted twice."""
    from .runner import run_detection

    path, rows = scratch(spark, "resume"), dataset(spark, d)
    tables.append_predictions(backends.detect_with(rows.where("uid % 3 = 0"), "presidio"), path)
    run_detection(spark, rows, path, ["presidio"])
    return tables.read_predictions(spark, path).groupBy("uid", "model").agg(F.count("*").alias("times"))
