import hashlib
import os
import random
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakbench.llm import decontam, exact_dedup, features, html_extract, lm_score, mixing, quality_fm, simhash, similar, substring_dedup, token_output, toxicity_pu

DOCS = "doc_id long, text string, source string, n_chars long, id string"
LONG = "word " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(0)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 5, 40]))), f"s{k % 3}", 5, "x") for k in range(60)]
    rows += [(100, None, "s0", None, None), (101, "", None, 0, "x"), (None, "no id here", "s1", 3, "x"), (102, LONG, "s1", None, "x"), (103, LONG.upper(), "s2", 1, "x")]
    rows += [(104, "same row", "s0", 1, "x")] * 3 + [(105, "é É same", None, 1, "x"), (106, "é é SAME", "s0", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(spark, docs, keep):
    got = exact_dedup.groups(docs, keep=keep).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(low(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == docs.count()
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == ((max if keep == "max" else min)(ids) if ids else None)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_hot_text(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.groups(rows, hot_share=0.01, salts=7).where("text_sha256 = sha2('hot', 256)").collect()
    assert len(got) == 134 and {(r.keep_id, r.group_size) for r in got} == {(399, 134)} and sum(r.kept for r in got) == 1


def test_exact_dedup_groups_come_from_sorted_neighbours(spark, docs):
    """With hashes that all collide only the comparison of neighbours keeps the texts apart."""
    same = exact_dedup.F.xxhash64
    try:
        exact_dedup.F.xxhash64 = lambda *c: F.lit(7).cast("long") if c == ("norm",) else same(*c)
        got = exact_dedup.groups(docs).collect()
    finally:
        exact_dedup.F.xxhash64 = same
    assert sorted((r.text_sha256, r.group_size, str(r.keep_id), r.kept) for r in got) == sorted((r.text_sha256, r.group_size, str(r.keep_id), r.kept) for r in exact_dedup.groups(docs).collect())


def test_mixing(spark, docs):
    got = mixing.plan(docs).collect()
    words = {}
    for r in got:
        words.setdefault(r.source, [0, 0, r.target, r.source_size])
        words[r.source][0] += r.size
        words[r.source][1] += r.taken
        assert r.taken <= 2 * r.size
    total = sum(w[0] for w in words.values())
    assert sum(w[2] for w in words.values()) == pytest.approx(1.5 * total)
    for size, taken, target, said in words.values():
        assert said == size and target <= 2 * size
    again = mixing.plan(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r.copies for r in got)


def test_mixing_comes_near(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    for r in mixing.plan(rows).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("aim")).collect():
        assert abs(r.t - r.aim) <= 50


def test_mixing_draws_by_inclusion_odds(spark):
    """The sample follows the Pareto rank over each document's own inclusion odds: other odds, another sample."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 100 + 1).cast("int")).alias("text"))
    taken = {}
    for by_size in (True, False):
        got = mixing.plan(rows, budget=0.3, by_size=by_size).collect()
        taken[by_size] = {r.doc_id for r in got if r.taken}
        assert abs(sum(r.taken for r in got) - got[0].target) <= 1
        # By hand: fractions of the source that inclusion odds of min(1, c w) give, w the power of two below the size.
        w = {r.doc_id: 2 ** (r.size.bit_length() - 1) if by_size else 1 for r in got}
        low, high = 0.0, 1.0
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1, c * w[r.doc_id]) * r.size for r in got) < got[0].target else (low, c)

        def rank(r):
            u = (int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = c * w[r.doc_id]
            return 0 if p >= 1 else u / (1 - u) / (p / (1 - p))

        first, words = set(), 0
        for r in sorted(got, key=rank):
            words += r.size
            if words > got[0].target:
                break
            first.add(r.doc_id)
        assert len(first ^ taken[by_size]) <= 2
    assert len(taken[True] ^ taken[False]) > 200 and len(taken[True]) < len(taken[False])


def test_mixing_certain_documents(spark):
    """A document whose odds reach 1 is always in."""
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), F.when(F.col("id") < 2, 400).otherwise(4)).alias("text"))
    got = {r.doc_id: r.taken for r in mixing.plan(rows, budget=0.75).collect()}
    assert got[0] == got[1] == 400 and 0 < sum(v for k, v in got.items() if k > 1) < 792


def fingerprint(text):
    import xxhash

    w = low(text).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    rows = docs.collect()
    fp = [fingerprint(r.text) for r in rows]
    nodes = sorted(set(fp))
    part = reached([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 2], nodes)
    least = defaultdict(lambda: None)
    for r, f in zip(rows, fp):
        if r.doc_id is not None:
            least[part[f]] = r.doc_id if least[part[f]] is None else min(least[part[f]], r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least[part[f]])) for r, f in zip(rows, fp))
    got = simhash.components(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.dedup(docs).collect()
    assert len([r for r in kept if r.doc_id is not None]) == len({v for v in least.values() if v is not None})


@pytest.mark.parametrize("longest", [1, 64])
def test_simhash_crowded_lists(spark, longest):
    rng, center = random.Random(1), random.Random(2).getrandbits(64)
    near = {center}
    for _ in range(150):
        near.add(rng.choice(sorted(near)) ^ 1 << rng.randrange(64))
    nodes = sorted(near | {rng.getrandbits(64) for _ in range(50)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(n),) for n in nodes], "fp long"), longest).collect()
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in got]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    every = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert reached(links, nodes) == reached(every, nodes)


def jaccard_sets(text, n=5):
    w = low(text).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_similar(spark, docs):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.choice([30, 60, 120]))] for _ in range(12)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
        rows.append((1000 + k, " ".join(w)))
    sets = [jaccard_sets(t) for _, t in rows]
    nodes = sorted(set(sets), key=lambda s: sorted(s))
    close = [(i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    part, place = reached(close, range(len(nodes))), {s: i for i, s in enumerate(nodes)}
    least = {}
    for (d, _), s in zip(rows, sets):
        c = part[place[s]]
        least[c] = min((x for x in (d, least.get(c)) if x is not None), default=None)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.components(frame).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(d), str(least[part[place[s]]])) for (d, _), s in zip(rows, sets))


def test_similar_long_texts(spark):
    """Over PARITY shingles: wide bits of one and of two widths, links kept and others ruled out."""
    rng = random.Random(8)
    rows = []
    for n in (1500, 2040, 4110):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for changes in (0, n // 150, n // 60, n // 20):
            w = list(base)
            for k in range(changes):
                w[k * n // changes] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base[: n * 85 // 100])))
    sets = [jaccard_sets(t) for _, t in rows]
    close = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    part = reached(close, range(len(rows)))
    got = similar.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == part and 3 < len(set(part.values())) < len(rows)


def test_pipeline_links_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(120)]
    edited = [*words[:40], "other", *words[41:80], "again", *words[81:]]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert (fingerprint(" ".join(words)) ^ fingerprint(" ".join(edited))).bit_count() > 2
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, frame, "").collect()) == [1, 3]


def test_pipeline_links_by_simhash_and_similarity(spark):
    """1 and the row without identifier are near by fingerprint alone, that row and 2 by similarity alone; 3 is apart."""
    import corpus_pipeline

    def text(a, b, tail):
        return " ".join(["red", "green", "blue"] * 200 + [f"{a}{k}" for k in range(60)] + [f"{b}{k}" for k in range(tail)])

    rows = [(1, text("x", "y", 0)), (None, text("z", "u", 0)), (2, text("z", "u", 0).replace("red green blue ", "", 199)), (3, "some other text of its own")]
    one, bridge, two = (fingerprint(t) for _, t in rows[:3])
    sets = [jaccard_sets(t) for _, t in rows[:3]]
    like = lambda a, b: len(a & b) / len(a | b)
    assert (one ^ bridge).bit_count() <= 2 < (bridge ^ two).bit_count() and like(sets[0], sets[1]) < 0.8 <= like(sets[1], sets[2])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.with_simhash(frame).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (2, 1), (3, 3)}
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, frame.where("doc_id > 0 OR doc_id IS NULL"), "").collect()
    assert {r.doc_id for r in kept} == {1, 3, None}


ITEMS = [
    (1, "Alice has 12 apples and buys 5 more apples at the market, so Alice pays 12 dollars in total today."), (2, None), (3, "too short"), (4, ""),
    (5, "rivers run slowly to the sea"), (6, "12 34 56 78 90 11 13 15 17"), (7, "In 1969 Neil walked 3 km over dust, Neil then drove 3 km more back to the lander."),
]
CASES = [
    (1, "intro text here. Then Bob has 7 apples and buys 9 more apples at the market, so Bob pays 7 euros in total today. bye"),
    (2, "Then Bob has 7 apples and buys 9 more apples at the market, so Carl pays 8 euros in total today."),
    (3, None), (4, ""), (5, "nothing to see"), (None, ITEMS[0][1]), (6, ITEMS[0][1].lower()), (6, "other text"),
    (7, "They say rivers run slowly to the sea, always."), (8, "rivers run quickly to the sea"), (9, "The list 12 34 56 78 90 11 13 15 17 ends."), (10, "99 34 56 78 90 11 99 15 17"),
    (11, "In 1975 Olga walked 8 m over dust, Olga then drove 8 m more back to the lander. In 1980 Ivan walked 2 m over dust, Ivan then drove 2 m more back to the lander."),
    (12, "In 1975 Olga walked 8 m over dust, Ivan then drove 2 m more back to the lander."), (13, "too short"),
    (14, "Dan has 7 apples and buys 9 more apples at the market, so"), (14, "Eve then said so Dan pays 8 euros in total today."),
]


_read = {}


def judged(text, items, width=8, coverage=0.5, shortest=3):
    """Brute force: item -> windows covered."""
    import regex

    strip = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w)

    def read(t):
        if t not in _read:
            _read[t] = read_now(t)
        return _read[t]

    def read_now(t):
        raw = [w.decode() for w in (t or "").encode().split() if regex.search(r"[\p{L}\p{N}]", w.decode())]
        canon = []
        for k, w in enumerate(raw):
            before, plain = raw[k - 1] if k else ".", strip(w).lower()
            if regex.search(r"\p{Nd}", w):
                canon.append("<num>")
            elif regex.match(r"[^\p{L}\p{N}]*\p{Lu}\p{Ll}", w) and not regex.search(r"[.!?][^\p{L}\p{N}]*$", before):
                canon.append("<name>")
            elif regex.search(r"\p{Nd}", before) and plain in decontam.UNITS:
                canon.append("<unit>")
            else:
                canon.append(plain)
        return [strip(w).lower() for w in raw], canon

    low_doc, canon_doc = read(text)
    out, placed = {}, {}

    def places_of(line, w):
        """Windows of the document by content."""
        if (id(line), w) not in placed:
            placed[id(line), w] = defaultdict(list)
            for j in range(len(line) - w + 1):
                placed[id(line), w][tuple(line[j : j + w])].append(j)
        return placed[id(line), w]

    for item, t in items:
        low_item, canon_item = read(t)
        w = min(width, len(low_item))
        if w < shortest:
            continue
        holders = {"<num>", "<name>", "<unit>"}
        places = [i for i in range(len(low_item) - w + 1) if 2 * sum(x not in holders for x in canon_item[i : i + w]) >= w]
        a, b = (canon_doc, canon_item) if places else (low_doc, low_item)
        places = places or list(range(len(low_item) - w + 1))
        shifts = defaultdict(set)
        for i in places:
            for j in places_of(a, w).get(tuple(b[i : i + w]), []):
                shifts[j - i].add(i)
        good = {}
        for s, own in shifts.items():
            values = defaultdict(set)
            for i in own:
                for k in range(i, i + w):
                    if canon_item[k] in holders:
                        values[low_item[k]].add(low_doc[k + s])
            if all(len(v) == 1 for v in values.values()):
                good[s] = (own, values)
        if not good:
            continue
        merged = defaultdict(set)
        for _, values in good.values():
            for k, v in values.items():
                merged[k] |= v
        if any(len(v) > 1 for v in merged.values()):
            hit = max(len(own) for own, _ in good.values())
        else:
            hit = len(set().union(*(own for own, _ in good.values())))
        if hit >= coverage * len(places):
            out[item] = hit
    return out


def test_decontamination(spark):
    bench, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame(CASES, "doc_id long, text string")
    rows = decontam.matches(docs, bench).collect()
    got = {(str(r.id), r.item, r.matched) for r in rows}
    assert got == {(str(d), item, n) for d, t in CASES for item, n in judged(t, ITEMS).items()}
    assert {(d, i) for d, i, _ in got} == {("1", 1), ("None", 1), ("7", 5), ("9", 6), ("11", 7)}
    assert {tuple(r) for r in rows} == {tuple(r) for r in decontam.matches(docs, bench, listed_windows=0).collect()}
    assert {r.changed for r in rows if r.id == 1} == {4}
    assert sorted(str(r.doc_id) for r in decontam.decontaminate(docs, bench).collect()) == sorted(str(d) for d, t in CASES if not judged(t, ITEMS))
    clashing = docs.withColumnsRenamed({"doc_id": "key"}).withColumn("row", F.lit(1))
    assert decontam.decontaminate(clashing, bench, id_col="key").columns == ["key", "text", "row"]


def test_decontamination_changed_questions(spark):
    """Items of the test data with other numbers, names and units, in two out of three cases consistently."""
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    cases = []
    for n, (_, t) in enumerate(items * 2):
        put, words = {}, []
        for w in t.split():
            core = w.strip(".,!?;:()\"'")
            if any(c.isdigit() for c in core):
                new = str(rng.randint(10, 99)) if n % 3 == 0 else put.setdefault(core, str(rng.randint(100, 999)))
                w = w.replace(core, new)
            words.append(w)
        cases.append((n, "Before it. " + " ".join(words) + " After it."))
    got = {(r.id, r.item, r.matched) for r in decontam.matches(spark.createDataFrame(cases, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got and got == {(d, item, n) for d, t in cases for item, n in judged(t, items).items()}


def test_decontamination_brute_force(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {(r.id, r.item, r.matched) for r in decontam.matches(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert got == {(r.doc_id, item, n) for r in docs.collect() for item, n in judged(r.text, items).items()}
    assert {(r.doc_id, i) for r in docs.collect() for i, t in items if t in (r.text or "")} <= {g[:2] for g in got}


def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if tuple(w[i : i + length]) in seen:
                gone[i : i + length] = [True] * length
            seen.add(tuple(w[i : i + length]))
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("length, seed", [(20, 8), (6, 3), (5, 5)])
def test_substring_dedup(spark, length, seed):
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(80)] + [(500, None), (501, ""), (502, "a " * 90), (503, "a " * 90)]
    want = brute_repeats(rows, length)
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, seed_words=seed).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_substring_dedup_edges(spark, docs):
    assert substring_dedup.repeats(docs).count() == docs.count()


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 1025, 3000):
        for high in (1, 2, 300, 50_000, 1 << 33, 1 << 63):
            ids = rng.integers(0, high, n).astype(np.uint64)
            data = token_output.to_bytes([None, 7], [n, 0], ids)
            named, lengths, back = token_output.from_bytes(data)
            assert named == [None, 7] and lengths.tolist() == [n, 0] and (back == ids).all()
            if n > 2048:
                assert (token_output.block_of(data, 1) == ids[1024:2048]).all()


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_output.default_tokenizer())
    odd = ["don't I'LL 'S", "Ünïcode ÀÉ ß 12345", "á Σίσυφος ΟΔΟΣ", "x y z w", "<|endoftext|> hi", "日本語 😀", "İ ǅ", " \t\n"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(200 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = token_output.round_trip(rows, token_output.default_tokenizer(), shard_ids=50).orderBy("start").collect()
    texts = defaultdict(list)
    for r in rows.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [2]
        texts[r.doc_id].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        start += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and len(got) == rows.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>Head&amp;line</h1><p>First  paragraph,
with <b>bold</b>&nbsp;text.<br><p>Second one.</p></article><div class="comments"><p>nice!</p></div><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<nav>" * 50)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(rows).collect()}
    text = "Head&line\nFirst paragraph, with bold text.\nSecond one."
    assert got[1] == (text, len(text)) and got[2] == got[3] == ("", 0) and len(got) == 5
    pages, labels = html_extract.drawn(200, 77)
    net = html_extract._net[()]
    right = [((html_extract._run(net, *html_extract._embed(net, [p]))[0][:, 0] > 0) == (y > 0)).mean() for p, y in zip(pages, labels)]
    assert np.mean(right) > 0.97


def test_html_blocks_keep_text():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><p>Next.</p>") == ["Let x=2 hold.", "Next."]
    assert texts("<p>A <object data=x>fallback</object> b.</p><noscript><p>No script.</p></noscript>") == ["A fallback b.", "No script."]
    assert texts("<p>One <svg width=1 /> two.</p><p>Three.</p><svg><text>in</text><text>svg</text></svg>") == ["One two.", "Three.", "in svg"]
    for tag in ("svg", "math", "object", "noscript", "iframe", "template", "style"):
        assert " ".join(texts(f"<p>One.</p><{tag}><p>Two.</p><p>Three.</p>")) == "One. Two. Three."
    assert texts("<p>One.</p><script>x</script><style>y</style><template>z</template><p>Two.</p>") == ["One.", "Two."]


def test_html_vectors_hash_every_word():
    text = " ".join(f"w{k}" for k in range(200))
    assert [len(w) for w in html_extract.vectors(html_extract.blocks(f"<p>{text}</p>"))[1]] == [200]


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    size = quality_fm.BUCKETS + quality_fm.DENSE
    m = quality_fm.Model(0.1, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(quality_fm.DENSE), np.ones(quality_fm.DENSE))
    index, value, stats = quality_fm.featurize("one two two three", None)
    i = np.concatenate((index, quality_fm.BUCKETS + np.arange(quality_fm.DENSE)))
    x = np.concatenate((value, m.dense(stats) / np.sqrt(quality_fm.DENSE)))
    pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert quality_fm.score_row(m, index, value, stats) == pytest.approx(float(features.sigmoid(np.float64(m.w0 + m.w[i] @ x + pairs))))


@pytest.mark.parametrize("module, query, label, least", [(quality_fm, "op6_quality_fm", "quality", 0.95), (toxicity_pu, "op9_toxicity_nnpu", "toxic", 0.7)])
def test_classifiers_held_out(spark, module, query, label, least):
    d = "/root/testdata/sf0.01"
    got = getattr(module, query)(spark, d).collect()
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.score, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    above = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y == 1 and z == 0]
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and np.mean(above) > least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_squeezed_numbers():
    rng = np.random.default_rng(0)
    for x in ([], [0], [65534], [65535], [65536, 131071, 131072], *[np.unique(rng.integers(0, toxicity_pu.BUCKETS, n)) for n in (3, 50, 5000)]):
        assert (toxicity_pu.unsqueezed(toxicity_pu.squeezed(np.array(x, np.int64))) == x).all()


def test_unlabelled_risk_covers_every_row(spark):
    """Loss, gradient and spread against plain sums over all rows, with copies."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 8))) for _ in range(60)]
    sets += [sets[0]] * 30 + [np.zeros(0, np.int64)] * 20
    named = {tuple(x): k for k, x in enumerate(sets)}
    rows = [(k, toxicity_pu.squeezed(x), named[tuple(x)], 0) for k, x in enumerate(sets)]
    feats = spark.createDataFrame(rows, "id long, f binary, m1 long, m2 long").repartition(5)
    chosen, w, bias = np.array([1, 4, 9, 16, 25, 36]), np.array([0.5, -1, 2, 0.1, -0.3, 1.5]), -0.4
    x = np.array([[float(c in s) for c in chosen] for s in sets])
    f = x @ w + bias
    unlabelled = toxicity_pu.Unlabelled(feats, chosen)
    loss, by_bias, by_weight = unlabelled.risk(bias, w)
    p = features.sigmoid(f)
    assert loss == pytest.approx(np.logaddexp(0, f).mean()) and by_bias == pytest.approx(p.mean()) and np.allclose(by_weight, x.T @ p / len(f))
    sums, n = unlabelled.spread(w)
    assert n.sum() == len(f) and (sums * n).sum() / len(f) == pytest.approx((x @ w).mean(), abs=0.01)
    counts, total = toxicity_pu.unlabelled_shares(feats, chosen)
    assert total == len(named) and counts.tolist() == [sum(c in s for s in named) for c in chosen]


def test_only_equal_features_count_once(spark):
    """Texts of mostly the same words are rows of their own in the shares, copies are not."""
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    texts = [" ".join([*words, "x" + "abcdefghij"[k]]) for k in range(10)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:1] * 20)], "doc_id long, text string")
    counts, n = toxicity_pu.unlabelled_shares(toxicity_pu.featured(docs), toxicity_pu.featurize(" ".join(["wordaa", "xa"])))
    assert n == 10 and sorted(set(counts.tolist())) == [1, 10]


def test_nnpu_clipped_step(spark):
    """Where the estimated loss on negatives is below 0 the step goes up its gradient instead."""

    class Fixed:
        size = 1

        def risk(self, bias, w):
            return 0.0, 0.25, np.array([0.5])

        def spread(self, w):
            return np.zeros(1), np.ones(1)

    _, w = toxicity_pu.nnpu([np.array([0])], Fixed(), 0.5, steps=1, rate=0.01, decay=0.0)
    # pi E_pos[l(-f)] > 0 = E_unl: the gradient is + pi sigmoid(f) - 0.5 for the weight.
    s = 1 / (1 + np.exp(-1.0))
    assert np.sign(1 - w[0]) == np.sign(0.5 * s - 0.5)


def test_classifier_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_fm.score(docs, quality_fm.train(docs, none)).collect()} == {0.5}
    assert quality_fm.keep_good(docs, quality_fm.train(docs, none)).count() == docs.count()
    model = toxicity_pu.train(docs, none, F.lit(True))
    assert toxicity_pu.score(docs, model).count() == docs.count() and toxicity_pu.score(empty, model).count() == 0


def test_lm(spark, docs, empty):
    text = "the cat sat on the mat and the dog sat on the rug"
    rows = spark.createDataFrame([(k, " ".join([text] * 30)) for k in range(8)], "doc_id long, text string")
    model = lm_score.fit(rows, passes=60)
    other = spark.createDataFrame([(1, text), (2, "rug the on mat sat dog the the and the sat on cat"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(other, model).collect()}
    assert got[1].log_prob > got[2].log_prob and got[1].n_tokens == 13 and (got[3].n_tokens, got[3].log_prob) == (0, 0.0)
    # By hand: each token's class and place in it from the two words on each side, then the word in its output.
    c, net = [lm_score.PAD] * 2 + model.outputs[lm_score.buckets_of(text)].astype(int).tolist() + [lm_score.PAD] * 2, model.net
    total = 0.0
    for k, bucket in enumerate(lm_score.buckets_of(text), 2):
        h = np.tanh(np.concatenate([net.e[c[k + o]] for o in (-2, -1, 1, 2)]) @ net.w1 + net.b1)
        cls, mem = divmod(c[k], lm_score.MEMBERS)
        for z, own in ((h @ net.wc + net.bc, cls), (h @ net.wm[cls] + net.bm[cls], mem)):
            total += z[own] - np.log(np.exp(z).sum())
        total += model.log_in_output[bucket]
    assert got[1].log_prob == pytest.approx(total, rel=1e-4, abs=1e-4)
    assert lm_score.score(docs, lm_score.fit(docs)).count() == docs.count()
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(0)
    _, _, mass = lm_score.assign(rng.integers(0, 9, lm_score.BUCKETS).astype(float))
    net = lm_score.start_net(mass)
    line = np.concatenate([np.array([5, 9, k, 70, 4000], np.uint16) for k in range(lm_score.OUTPUTS)])
    assert np.exp(lm_score.log_probs(net, line, np.arange(2, len(line), 5)).astype(float)).sum() == pytest.approx(1, rel=1e-3)


def test_lm_gradients(spark):
    """A step's direction against differences of the loss."""
    rng = np.random.default_rng(1)
    _, _, mass = lm_score.assign(rng.integers(0, 9, lm_score.BUCKETS).astype(float))
    net = lm_score.start_net(mass)
    context, target = rng.integers(0, lm_score.OUTPUTS, (40, 4)), rng.integers(0, 300, 40)
    line = np.concatenate([[c[0], c[1], t, c[2], c[3]] for c, t in zip(context, target)]).astype(np.uint16)
    loss = lambda n: -lm_score.log_probs(n, line, np.arange(2, len(line), 5)).astype(float).mean()
    trainer, got = lm_score.Trainer(net, 0.01), []
    trainer.opt.step = lambda p, g: got.extend(g)
    trainer.step(context, target)
    for name, g in zip(lm_score.Net._fields, got):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        sides = []
        for by in (0.02, -0.02):
            moved = getattr(net, name).copy()
            moved[at] += by
            sides.append(loss(net._replace(**{name: moved})))
        assert (sides[0] - sides[1]) / 0.04 == pytest.approx(float(g[at]), rel=0.05), name


def test_lm_does_not_depend_on_partitions(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    nets = [lm_score.fit(rows.repartition(n)).net for n in (2, 7)]
    start = lm_score.start_net(lm_score.assign(lm_score._counted(rows.select("text")))[2])
    for a, b, s in zip(*nets, start):
        assert np.allclose(a, b, atol=1e-5) and (a != s).any()


def test_lm_trains_on_all_positions(spark):
    long = " ".join(f"w{k}" for k in range(lm_score.SLICE + 3))
    rows = spark.createDataFrame([(1, "one two three"), (2, long), (3, None)], "h long, text string")
    made = lm_score._slices(rows, np.arange(lm_score.BUCKETS, dtype=np.uint16)).collect()
    seen = {1: [], 2: []}
    for r in sorted(made, key=lambda r: (r.h, r.part)):
        seen[r.h].extend(np.frombuffer(r.line, "<u2")[2:-2].tolist())
    assert seen[1] == lm_score.buckets_of("one two three").astype(np.uint16).tolist() and seen[2] == lm_score.buckets_of(long).astype(np.uint16).tolist()


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (exact_dedup.groups(empty), mixing.plan(empty), mixing.mix(empty), simhash.components(empty), simhash.dedup(empty), decontam.matches(empty, bench), substring_dedup.repeats(empty), token_output.round_trip(empty, token_output.default_tokenizer())):
        assert frame.count() == 0


def test_uncovered_windows_of_many_lines():
    """Lines hashed as one give the windows that each gives alone, short lines and those at a document's edges among them."""
    rng, length, seed = random.Random(6), 20, 8
    lines, spans, want = [], [], []
    for k in range(300):
        words = [b"w%d" % rng.randrange(50) for _ in range(rng.choice([8, 19, 20, 21, 32, 32, 32]))]
        before = rng.randrange(0, len(words) - seed + 1)
        at = before + rng.randrange(5)
        low = at - before + rng.randrange(0, 6)
        high = rng.choice([low, at - before + len(words) - rng.randrange(0, 6)])
        lines.append(words)
        spans.append((low, high, at, before))
        if len(words) >= length:
            h = substring_dedup._word_hashes(words)
            grams, least = substring_dedup._seeds(h, length, seed)
            for s in range(max(0, before - length + seed), min(before, len(words) - length) + 1):
                start = s + at - before
                if least[s] == grams[before] and (start < low or start + length > high):
                    want.append((k, start, *substring_dedup._windows(h, length)[s].tolist()))
    own, starts, w = substring_dedup.uncovered(lines, *np.array(spans, np.int32).T, length, seed)
    assert want and list(zip(own.tolist(), starts.tolist(), *w.T.tolist())) == want
    assert len(substring_dedup.uncovered(lines[:0], *np.zeros((4, 0), np.int32), length, seed)[0]) == 0


def test_masked_lm_softmax_by_columns():
    """A column a position, stable for logits far from 0."""
    rng = np.random.default_rng(2)
    h, w, b, own = rng.normal(size=(7, 3)).astype(np.float32), 200 * rng.normal(size=(3, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32), rng.integers(0, 5, 7)
    z = lm_score._logits(h, w, b)
    want = (h @ w + b).astype(float)
    want -= want.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    assert z.shape == (5, 7)
    assert np.allclose(lm_score._softmax(z.copy()), np.exp(want).T, atol=1e-4)
    assert np.allclose(lm_score._own_log(z, own), want[np.arange(7), own], rtol=1e-3, atol=1e-3)


def test_words_of_letters_are_not_split():
    """Equal to the tokenizer's own ids; only words with other characters, or longer than the letters tried, reach the pattern."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(token_output.default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    encoder, seen = token_output.Encoder(spec), []
    split = encoder.pieces_of
    encoder.pieces_of = lambda line: seen.append(line) or split(line)
    words = ["Plain", "ÉTÉ", "straße", "ÿ", "x" * 58, "y" * 59, "it's", "a1", "×", "end.", "Ωmega", "'s"]
    texts = [" ".join(words), "only words Of Letters", "", None, "".join(words)]
    ids, counts = encoder.encode_batch(pa.array(texts))
    want = [Tokenizer.from_str(spec).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [k for w in want for k in w]
    assert sorted("\n".join(seen).split()) == sorted(["y" * 59, "it's", "a1", "×", "end.", "'s"])


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert got and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{d}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    saved = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), str(tmp_path / name.split()[0])
        stage(spark, docs, d).write.parquet(out)
        docs = spark.read.parquet(out)
        saved[name] = (before, docs.collect())
        assert name.startswith("token") or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = saved["SimHash near-dedup"]
    sets = [jaccard_sets(r.text) for r in before]
    links = [(a.doc_id, before[j].doc_id) for i, a in enumerate(before) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert {r.doc_id for r in after} == set(reached(links, [r.doc_id for r in before]).values())
    before, after = saved["benchmark decontamination"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not judged(r.text, items)}
    before, after = saved["mixing sources to target weights"]
    words, source = {r.doc_id: len((r.text or "").encode().split()) for r in before}, {r.doc_id: r.source for r in before}
    assert all(n <= 2 for n in Counter(r.doc_id for r in after).values())
    aims = {r.source: r.target for r in mixing.plan(spark.createDataFrame(before)).select("source", "target").distinct().collect()}
    for s in set(source.values()):
        size = sum(n for k, n in words.items() if source[k] == s)
        aim = aims[s]
        assert abs(sum(words[r.doc_id] for r in after if r.source == s) - aim) <= max(n for k, n in words.items() if source[k] == s) and aim <= 2 * size
    before, after = saved["token-ID / binary output"]
    whole = Tokenizer.from_file(token_output.default_tokenizer())
    made = [(r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in before]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == Counter((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in made)


def test_pipeline_stages_on_odd_tables(spark, docs, empty):
    """Nulls, repeated identifiers, extra columns and no rows pass every stage."""
    import corpus_pipeline

    for rows in (docs, empty):
        most = 2 * rows.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, "/root/testdata/sf0.001")
            n = out.count()
            assert n <= most and (rows is docs or not n), name
            assert name.startswith("token") or out.columns == rows.columns


def test_html_edges(spark):
    long = "<article>" + "<p>word word word word.</p>" * 3000 + "</article>"
    rows = spark.createDataFrame([(1, "u", long, "a", 1), (2, "u", PAGE, "b", 2), (2, "u", PAGE, "c", 3)], "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.extract(rows).orderBy("page_id").collect()
    assert [len(r.text.split("\n")) for r in got] == [3000, 3, 3] and got[1] == got[2]
    assert html_extract.extract(rows, keep=("page_id",)).columns == ["page_id", "text", "n_chars"]
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_html_equals_the_article(spark):
    """On generated pages with one article, its text and no other comes out, white space aside."""
    import html
    import re

    squeeze = lambda t: re.sub(r"\s", "", t)
    found = {r.page_id: r.text for r in html_extract.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    right = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.findall(r"<article[^>]*>(.*?)</article>", r.html or "", re.S)
        if len(article) == 1:
            want = html.unescape(re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]+>", "", article[0], flags=re.S))
            total, right = total + 1, right + (squeeze(want) == squeeze(found[r.page_id]))
    assert total > 200 and right >= total - 1


CHILDREN = """
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "40").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.checkpoint.dir", "file://{at}/shared").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
corpus_pipeline.mix(spark, docs, "").write.parquet("file://{at}/out")
print("rows", spark.read.parquet("file://{at}/out").count())
"""


def test_pipeline_starts_few_processes(tmp_path):
    """A chmod first on the path notes its calls: until it runs, each such child counts as a second JVM of the executor's size."""
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/calls\nexec {shutil.which("chmod")} "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}", "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", CHILDREN.format(at=tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert re.search("rows [1-9]", ran.stdout), ran.stderr[-2000:]
    calls = (tmp_path / "calls").read_text().splitlines() if (tmp_path / "calls").exists() else []
    assert not [c for c in calls if c.endswith(".crc")]
    tasks = Counter(c.split("/_temporary/")[0] for c in calls if "/attempt_" in c and "/part-" not in c)
    assert all(n <= 2 for n in tasks.values()), tasks
