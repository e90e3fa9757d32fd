"""Token ids as Simple-8b shards: encode, write in ascending id order, read back.

`write` deals the documents to ranges of their identifier, sorts each range, encodes with a tokenizers file, appends an end
id to each document and packs runs of documents into shards of about `shard_ids` ids. A shard is one self-contained byte
string (layout below), stored as one row of a Parquet dataset with its place, so any file system that Spark knows can hold
it and the committer drops what lost tasks leave. `read` decodes the shards; a document's start comes from sums per task
and per shard, so nothing passes through one task but one row a task.

Shard layout, little-endian: magic S8B1; u32 block size; u64 counts of documents, ids, words, blocks, escapes; then
arrays: i64 document ids, u8 null flags, u64 ids per document, u64 first word per block, u64 escapes, u64 words.
A word has its selector in the top 4 bits and ids from the low bits up. No word crosses a block, so a block decodes alone;
an id of 2**60 or more is stored in the escapes, its word holds the escape's number.

Defined cases: null text counts as empty and has only the end id; null document ids come first; rows that share a document
id are neighbours, ordered by their text's hash, and are all written; extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, give_back, small_batches, stash_root

#: Fixed values, by selector: ids in a word and their bits. Selector 0 is an escape, 15 a run of zeros.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
WIDTH = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
FULLEST_FIRST = [15, *range(1, 15)]
HEAD = struct.Struct("<4sIQQQQQ")
PIECES_KEPT = 200_000  # entries of a worker's cache, in a young and an old generation each
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(k) for k in range(0xDF, 0x100) if k != 0xF7)
AT_ONCE = 6 << 20  # bytes of text that a worker encodes together, or one document


def pack(ids: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of u64 ids. All blocks advance together, a word at a time each."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n, none = len(ids), np.zeros(0, np.uint64)
    if not n:
        return none, none, none
    if int(ids.max()) < 1 << 53:
        bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # bit lengths, exact below 2**53
    else:
        bits = np.array([int(x).bit_length() for x in ids], np.uint8)
    # Widest id among the next 2**k ids, past the end too wide for any.
    top = {1: np.concatenate((bits, np.full(128, 255, np.uint8)))}
    for k in (1, 2, 4, 8, 16, 32):
        top[2 * k] = top[k].copy()
        np.maximum(top[k][:-k], top[k][k:], out=top[2 * k][:-k])
    left = np.resize(np.arange(block, 0, -1, dtype=np.int32), n)
    least, choice, open_ = bits.min(), np.zeros(n, np.uint8), np.ones(n, bool)
    for s in FULLEST_FIRST:
        if WIDTH[s] < least:
            continue
        c, half = int(COUNT[s]), 1 << (int(COUNT[s]).bit_length() - 1)
        fits = np.maximum(top[half][:n], top[half][c - half : c - half + n]) <= np.uint8(WIDTH[s])
        fits &= open_
        fits &= left >= c
        choice[fits] = s
        open_ ^= fits
    at, ends, starts = np.arange(0, n, block), np.minimum(np.arange(block, n + block, block), n), []
    while len(at):
        starts.append(at)
        at = at + COUNT[choice[at]]
        at, ends = at[at < ends], ends[at < ends]
    starts = np.sort(np.concatenate(starts))
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        own = np.flatnonzero(chosen == s)
        for k in range(int(COUNT[s])):
            words[own] |= ids[starts[own] + k] << np.uint64(k * int(WIDTH[s]))
    own = np.flatnonzero(chosen == 0)
    words[own] |= np.arange(len(own), dtype=np.uint64)
    return words, np.searchsorted(starts, np.arange(0, n, block)).astype(np.uint64), ids[starts[own]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[chosen])
    out, starts = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64), ends - COUNT[chosen]
    for s in range(1, 15):
        own = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(WIDTH[s])) - 1)
        for k in range(int(COUNT[s])):
            out[starts[own] + k] = words[own] >> np.uint64(k * int(WIDTH[s])) & mask
    own = np.flatnonzero(chosen == 0)
    out[starts[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, block: int = 1024) -> bytes:
    words, firsts, escapes = pack(ids, block)
    head = HEAD.pack(b"S8B1", block, len(doc_ids), len(ids), len(words), len(firsts), len(escapes))
    named = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([head, named.tobytes(), nulls.tobytes(), np.array(lengths, "<u8").tobytes(), *(x.astype("<u8").tobytes() for x in (firsts, escapes, words))])


def _parts(data: bytes):
    magic, block, docs, ids, words, blocks, escapes = HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b shard")
    at, out = HEAD.size, []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks), ("<u8", escapes), ("<u8", words)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return block, ids, *out


def from_bytes(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids)."""
    _, n, named, nulls, lengths, _, escapes, words = _parts(data)
    ids = unpack(words, escapes)
    if len(ids) != n or int(lengths.sum()) != n:
        raise ValueError("damaged shard: counts differ")
    return [None if z else int(d) for d, z in zip(named, nulls)], lengths.astype(np.int64), ids


def block_of(data: bytes, k: int) -> np.ndarray:
    """Block k alone, by its offset."""
    _, _, _, _, _, firsts, escapes, words = _parts(data)
    end = int(firsts[k + 1]) if k + 1 < len(firsts) else len(words)
    return unpack(words[int(firsts[k]) : end], escapes)


class Kept(dict):
    """What make(key) gives, kept in two generations: a full young one becomes the old one, whose used entries come back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The picked segments of flat in turn."""
    n = lengths[pick]
    ends = np.cumsum(n)
    at = np.repeat((starts[pick] - ends + n).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class Encoder:
    """encode_batch(texts): ids equal to the tokenizer's own, as one array and the count of each text.

    Where the file lower-cases, splits by a pattern that no white space passes, and merges bytes, the distinct words of a
    batch are split once and each piece goes to the same model without the tokenizer's own normalising, which takes
    most of its time; pieces are kept from batch to batch. Where the pattern leaves letters together, a word of letters alone is one
    piece and needs no split. Words beyond ASCII and U+00C0-U+00FF, texts with a special
    token and other kinds of tokenizer take its encode().
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        made = json.loads(spec)
        kinds = lambda part, many: [x["type"] for x in (made.get(part) or {}).get(many, [])]
        self.by_word = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"] and made["model"]["type"] == "BPE" and not made.get("post_processor")
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        if not self.by_word:
            return
        import regex

        pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces_of = regex.compile(f"\n|{pattern}").findall
        self.plain = regex.compile(r"[\x21-\x7eÀ-ÿ]*").fullmatch
        self.all_plain = regex.compile(r"[\n\x21-\x7eÀ-ÿ]*").fullmatch
        # Bytes as the printable characters that byte-level vocabularies use: printable bytes are themselves, the rest follow from U+0100.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.one_piece = rf"^[A-Za-zÀ-ÖØ-öø-ÿ]{{1,{len(LETTERS)}}}$" if self.pieces_of(LETTERS) == [LETTERS] else r"^\n$"
        model = self.whole.model

        def ids_of(piece: str) -> bytes:
            # Printable ASCII is shown as it is.
            shown = piece if piece.isascii() and piece.isprintable() else "".join(map(table.__getitem__, piece.encode()))
            return array("I", [t.id for t in model.tokenize(shown)]).tobytes()

        self.pieces = Kept(ids_of, PIECES_KEPT)

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text]))[0]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, count of each)."""
        import pyarrow.compute as pc

        one = pc.match_substring_regex(words, self.one_piece)
        each = list(map(self.pieces.__getitem__, pc.utf8_lower(words.filter(one)).to_pylist()))
        rest, more = self._split_words(words.filter(pc.invert(one)).to_pylist())
        one, counts = one.to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
        counts[one], counts[~one] = np.array(list(map(len, each)), np.int64) // 4, more
        starts = np.zeros(len(words), np.int64)
        for own in (one, ~one):
            starts[own] = np.cumsum(counts[own]) - counts[own]
        flat = np.frombuffer(b"".join(each), "<u4")
        starts[~one] += len(flat)
        return np.concatenate((flat, rest)), starts, counts

    def _split_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in turn, count of each)."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        line = "\n".join(words)
        odd = {} if self.all_plain(line) else {k: self.slow(w) for k, w in enumerate(words) if not self.plain(w)}
        if odd:
            line = "\n".join("" if k in odd else w for k, w in enumerate(words))
        number: dict[str, int] = {"\n": 0}
        seq = np.array([number.setdefault(p, len(number)) for p in self.pieces_of(line.lower())], np.int32)
        each = [b"", *map(self.pieces.__getitem__, list(number)[1:])]
        flat = np.frombuffer(b"".join(each), "<u4")
        lengths = np.array(list(map(len, each)), np.int32) // 4
        starts = np.cumsum(lengths) - lengths
        ids = _gather(flat, starts, lengths, seq)
        upto = np.concatenate(([0], np.cumsum(lengths[seq])))[np.concatenate((np.flatnonzero(seq == 0), [len(seq)]))]
        counts = np.diff(upto, prepend=0)
        if odd:
            parts = np.split(ids, upto[:-1])
            parts = [odd.get(k, x) for k, x in enumerate(parts)]
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)))
        return ids.astype(np.uint32), counts

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.string()), "")
        own = {}
        if not self.by_word:
            own = {k: self.slow(t.as_py()) for k, t in enumerate(texts)}
        else:
            for s in self.special:
                for k in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)):
                    own[int(k)] = self.slow(texts[int(k)].as_py())
        if own:
            texts = pc.if_else(pa.array([k in own for k in range(len(texts))]), "", texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pick = coded.indices.to_numpy()
        if len(pick) and self.by_word:
            flat, starts, counts = self._words(coded.dictionary)
            ids = _gather(flat, starts, counts, pick)
            upto = np.concatenate(([0], np.cumsum(counts[pick])))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        else:
            ids, upto = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if own:
            parts = [own.get(k, ids[upto[k] : upto[k + 1]]) for k in range(len(texts))]
            return np.concatenate(parts) if parts else ids, np.array(list(map(len, parts)), np.int64)
        return ids, np.diff(upto)


_encoders: dict[int, Encoder] = {}


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 19, block: int = 1024) -> None:
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; a tokenizer file is a few MB whatever the input
        spec = spark.sparkContext.broadcast(f.read())
    key = zlib.crc32(spec.value.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(spec.value))
        part, seq, named, lengths, got, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(got).astype(np.uint64)
            row = [[part], [seq], [len(named)], [len(ids)], [to_bytes(named, lengths, ids, block)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "n_docs", "n_ids", "shard"])

        for b in batches:
            sizes = np.cumsum(np.array([len(t.as_buffer() or b"") if t.is_valid else 0 for t in b.column(1)], np.int64))
            at = 0
            while at < b.num_rows:
                until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
                ids, counts = encoder.encode_batch(b.column(1).slice(at, until - at))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                ends = np.cumsum(counts + 1)
                first = 0
                for k, doc_id in enumerate(b.column(0).slice(at, until - at).to_pylist()):
                    named.append(doc_id)
                    lengths.append(int(counts[k]) + 1)
                    held += lengths[-1]
                    if held >= shard_ids:
                        got.append(ids[first : ends[k]])
                        first = ends[k]
                        yield flush()
                        seq, named, lengths, got, held = seq + 1, [], [], [], 0
                got.append(ids[first:].copy())
                at = until
                del ids
                give_back()  # the words of a slice leave as much free memory as the caches hold
        if named:
            yield flush()
        give_back()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie")
    with small_batches(spark, 4_000, "16m"):
        rows.select("id", "text").mapInArrow(run, "part int, seq int, n_docs long, n_ids long, shard binary").write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document, from the shards: doc_id, start, n_tokens, ids_crc32, and with ids=True the ids."""
    shards = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                named, lengths, all_ids = from_bytes(data.as_py())
                ends, small = np.cumsum(lengths), all_ids.astype("<u4")
                cut = [small[e - n : e] for e, n in zip(ends, lengths)]
                cols = [pa.array([part] * len(named), pa.int32()), pa.array([seq] * len(named), pa.int32()), pa.array(named, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = shards.select("part", "seq", "shard").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = shards.select("part", "seq", "n_ids")
    # One row a write task, so its size is bounded by the number of partitions.
    tasks = counts.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    begin = counts.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("inner")).join(F.broadcast(tasks), "part")
    begin = begin.select("part", "seq", (F.col("base") + F.col("inner")).alias("begin"))
    out = rows.join(begin, ["part", "seq"])
    return out.select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **how) -> DataFrame:
    """Write docs below the shared folder and read the files back."""
    path = f"{stash_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path, end_id, **how)
    return read(docs.sparkSession, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_tokenizer(), end_id=2)
