"""Passages of benchmark items in documents, by a hash set of 10-word windows.

A benchmark whose table of windows fits ``most_bytes`` is broadcast: its words
as one array of 64-bit hashes, and for each window length the windows' hashes,
sorted, with their places in it.  Each document's windows are looked up, first
in a bit map of these hashes, and every hit is verified on its words.  A larger
benchmark is not broadcast, but for a map of its windows' bits; windows that
pass it, few but the benchmark's own, are joined by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import cut, table
from pairloom.llm.shingles import WordHashes

WINDOW = 10
#: Bytes of the table of windows up to which it is broadcast; 22 for each word, so a benchmark of about 17 MB.
MOST_BYTES = 64_000_000
BYTES_A_WORD, BYTES_AN_ITEM = 22, 100
#: Bits of the map that windows of documents pass before they are joined: 8 for each window of the benchmark, within these.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29
_P = np.array([xxhash.xxh3_64_intdigest(b"window", seed=i) | 1 for i in range(WINDOW)], dtype=np.uint64)
#: ASCII digits and letters, lower-cased, and everything beyond ASCII stay; all else parts words.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, hit_words array<int>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def _sums(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    total = words[:n] * _P[0]
    for i in range(1, size):
        total += words[i : n + i] * _P[i]
    return total


class _OfSize:
    """The windows of one length: sorted hashes, their places in the word array, and a bit map of the hashes' first bits."""

    def __init__(self, size: int, hashes: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.size, self.hashes, self.places = size, hashes[order], places[order]
        self.shift = np.uint64(64 - max(6, int(8 * len(hashes)).bit_length()))
        self.map = np.zeros(1 << int(61 - self.shift), np.uint8)
        at = hashes >> self.shift
        np.bitwise_or.at(self.map, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return np.flatnonzero(self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


class Windows:
    """The windows of all items; items that repeat an id are one item."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        hashes = WordHashes()
        self.names: list[str] = []
        own, begins, n = [], [], 0
        numbers: dict[str, int] = {}
        item, sizes = [], []
        for name, text in items:
            words = words_of(text)
            if words:
                if name not in numbers:
                    numbers[name] = len(self.names)
                    self.names.append(name)
                own.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                begins.append(n)
                item.append(numbers[name])
                sizes.append(min(WINDOW, len(words)))
                n += len(words)
        self.words = np.concatenate(own) if own else np.empty(0, np.uint64)
        self.begins, self.item = np.array(begins, np.uint32), np.array(item, np.uint32)
        self.by_size = []
        for size in sorted(set(sizes)):
            mine = [(b, w) for b, w, s in zip(begins, own, sizes, strict=True) if s == size]
            places = np.concatenate([np.arange(b, b + len(w) - size + 1, dtype=np.uint32) for b, w in mine])
            self.by_size.append(_OfSize(size, np.concatenate([_sums(w, size) for _, w in mine]), places))

    def find(self, words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, set[str]]:
        """Which words are in an occurrence of a window, and the items whose windows occur."""
        n = len(words)
        hit, items = np.zeros(n, bool), set()
        w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        for known in self.by_size:
            size = known.size
            if n < size:
                continue
            sums = _sums(w, size)
            at = known.maybe(sums)
            lo, hi = np.searchsorted(known.hashes, sums[at], "left"), np.searchsorted(known.hashes, sums[at], "right")
            for i in np.flatnonzero(lo < hi):
                places = known.places[lo[i] : hi[i]].astype(np.int64)
                same = (self.words[places[:, None] + np.arange(size)] == w[at[i] : at[i] + size]).all(axis=1)
                if same.any():
                    hit[at[i] : at[i] + size] = True
                    items.update(self.item[np.searchsorted(self.begins, places[same], "right") - 1].tolist())
        return hit, {self.names[i] for i in items}


def _emit(batch: pa.RecordBatch, rows: list[tuple[int, np.ndarray, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.array([int(h.sum()) for _, h, _ in rows], pa.int64()),
            pa.array([len(i) for _, _, i in rows], pa.int64()),
            pa.array([i for _, _, i in rows], pa.list_(pa.string())),
            pa.array([np.flatnonzero(h).tolist() for _, h, _ in rows], pa.list_(pa.int32())),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items", "hit_words"],
    )


def _broadcast_windows(benchmark: DataFrame, item: str, text: str):
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).collect()
    return benchmark.sparkSession.sparkContext.broadcast(Windows(sorted(((r["i"], r["t"]) for r in rows), key=str)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(words_of(t.as_py())) for t in batch.column(0)], pa.int64())], ["n"])


def fits(benchmark: DataFrame, text: str, most_bytes: int) -> bool:
    """Whether the items' texts, and the table of their windows, are of at most ``most_bytes`` together."""
    words = benchmark.select(text).mapInArrow(_count, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    held = benchmark.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("n")).first()
    return words * BYTES_A_WORD + (held["bytes"] or 0) + held["n"] * BYTES_AN_ITEM <= most_bytes


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items and hit_words (places of hit words) of every row of ``docs``.

    Null and empty texts have no words; items without words have no windows;
    items that repeat an id are one item; a null item id reads as ''.  Keys may
    be null and rows may repeat, each is judged by its own text.  Very long
    texts are gone over whole.  Other columns are not read.  Without items,
    nothing is hit; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    if not fits(benchmark, text, most_bytes):
        return _by_join(docs, benchmark, item, text)
    windows = _broadcast_windows(benchmark, item, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = words_of(t.as_py())
                hit, items = windows.value.find(words, hashes)
                rows.append((len(words), hit, sorted(items)))
            yield _emit(batch, rows)

    return docs.mapInArrow(scan, SCHEMA)


def _windows_of(words: list[bytes], hashes: WordHashes, sizes: list[int], bits: int, passes: np.ndarray | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """Place, size, bit and 128-bit hash of the windows, of those that ``passes`` lets through if it is given."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    for size in sizes:
        if len(words) >= size:
            bit = (_sums(w, size) * _P[size - 1] >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
            at = np.arange(len(bit)) if passes is None else np.flatnonzero(passes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            for i in at.tolist():
                yield i, size, int(bit[i]), xxhash.xxh3_128_digest(b" ".join(words[i : i + size]))


def _bit_map(known: DataFrame, bits: int) -> np.ndarray:
    """The bits of all windows: set in Spark, a row for each 32,768 of them, so at most ``bits`` / 8 bytes come to the driver."""
    place = F.col("bit") + 1  # the functions number from 1
    rows = known.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["b"]), np.uint8)
        begin = (r["k"] - 1) * len(part)
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return out


def _text_key(text: str) -> F.Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text))


def _joined_hits(docs: DataFrame, benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(doc_id, t, item, at, size) of the windows of ``docs`` (doc_id, t, _text) that are a benchmark's, whatever its size: windows meet in a join on their hash."""

    n_words = benchmark.select(text).mapInArrow(_count, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = min(max(1 << (8 * n_words).bit_length(), LEAST_BITS), MOST_BITS)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, schema = WordHashes(), pa.schema([("item", pa.string()), ("size", pa.int32()), ("bit", pa.int64()), ("h", pa.binary())])
        for batch in batches:
            out = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                out += [(name, size, bit, h) for _, size, bit, h in _windows_of(words, hashes, [min(WINDOW, len(words))] if words else [], bits)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("_text"))
    known = cut(named.mapInArrow(of_items, "item string, size int, bit long, h binary").distinct())
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # ten values at most
    passes = docs.sparkSession.sparkContext.broadcast(_bit_map(known, bits))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, schema = WordHashes(), pa.schema([("doc_id", pa.int64()), ("t", pa.binary()), ("at", pa.int32()), ("size", pa.int32()), ("h", pa.binary())])
        for batch in batches:
            for doc, t, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = [{"doc_id": doc, "t": t, "at": i, "size": s, "h": h} for i, s, _, h in _windows_of(words_of(whole), hashes, sizes, bits, passes.value)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    # Few windows but those of the benchmark pass the map, so texts aren't compared for repeats before they are read.
    likely = docs.where("t IS NOT NULL").mapInArrow(of_docs, "doc_id long, t binary, at int, size int, h binary")
    return cut(likely.join(known.drop("bit"), ["size", "h"]).select("doc_id", "t", "item", "at", "size").distinct())


def _by_join(docs: DataFrame, benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """What contamination gives, for a benchmark of any size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(words_of(t.as_py())) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "t", "n_words"])

    tagged = docs.select("doc_id", _text_key("_text").alias("t"), "_text")
    thin = cut(tagged.mapInArrow(count, "doc_id long, t binary, n_words long"))
    found = _joined_hits(tagged, benchmark, item, text)
    places = found.select("doc_id", "t", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("w")).distinct()
    hits = places.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list("w")).alias("hit_words"))
    items = found.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hits.alias("x").join(items.alias("y"), F.expr("x.doc_id <=> y.doc_id AND x.t = y.t")).select("x.doc_id", "x.t", "hit_words", "items")
    return (
        thin.alias("a")
        .join(both.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.t = b.t"), "left")
        .select("a.doc_id", "n_words", F.coalesce("hit_words", F.expr("cast(array() as array<int>)")).alias("hit_words"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
        .select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hit_words")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs`` without a word in any occurrence of a benchmark window, with all columns.

    Null and empty texts stay; rows that repeat stay or go alike; very long
    texts are gone over whole; an empty table gives no rows.
    """
    if not fits(benchmark, text, most_bytes):
        one = docs.select(F.lit(None).cast("long").alias("doc_id"), _text_key(text).alias("t"), F.col(text).alias("_text"))
        bad = _joined_hits(one, benchmark, item, text).select(F.col("t").alias("_t")).distinct()
        return docs.alias("d").join(bad.alias("b"), _text_key(f"d.`{text}`") == F.col("b._t"), "left_anti").select("d.*")
    windows = _broadcast_windows(benchmark, item, text)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([not windows.value.find(words_of(t), hashes)[0].any() for t in texts], dtype=bool)

    return docs.where(clean(text))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
b AS (SELECT item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS h
       FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS h
       FROM (SELECT r, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, item_id, i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.h = bw.h),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
