"""Probability of a text by context-tree weighting, learnt from a corpus.

A text is its words, parted by single spaces and closed by an end mark, as
bytes.  Each byte is eight binary decisions.  For each decision, which has the
bits decided before it, there is a tree over the bytes that precede, nearest
first, DEPTH deep.  A node estimates the next bit from its own counts of the
training texts (Krichevsky-Trofimov), and is weighted against the nodes one byte
deeper: both share the probability of all that they saw equally before it.  So
a bit's probability is a mixture of the estimates of all depths.

Counts are of grams: DEPTH bytes and the one that follows.  They are gathered in
blocks of the input, a block's distinct grams once, and summed by gram; no task
and no driver has them all, and they grow with the corpus.  Weights go up the
trees and probabilities come down again: over grams with the same nearest bytes
in one task, and over the levels above by one aggregate and one join a level.
Each block then gets the probabilities of its own grams, and its texts are read
against these.  Grams that no training text has take part with counts of zero,
so they need no rule of their own.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.shared import cut, shared_folder, spread, table, text_batches

#: Bytes of context; with the byte that follows, a gram is a long.
DEPTH = 5
#: Bytes of context that all grams of a subtree share.
TOP = 3
#: Closes a text; no word has it.  It also stands for what precedes a text.
END = b"\n"
#: Bytes that are looked up at once.
SPAN = 1 << 18
#: Bytes of a scan's parts that are put together in a block.
BLOCK_BYTES = 64 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte at each of 64 places, and the bit that words have and grams don't.
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, (64, 256), dtype=np.uint64)
_WORD = np.uint64(1 << 62)


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def grams_of(data: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte from the DEPTH-th on; the byte is the lowest, its nearest context the next one."""
    n = len(data) - DEPTH
    out = np.zeros(n, np.int64)
    for j in range(DEPTH + 1):
        out <<= 8
        out |= data[j : j + n]
    return out


class GramTable:
    """Numbers of distinct grams, by open addressing, for many grams at once."""

    def __init__(self, room: int = 1 << 16) -> None:
        self.grams = np.zeros(0, np.int64)
        self._size = 0
        self._room(room)

    def _room(self, room: int) -> None:
        self._shift = np.uint64(64 - (room.bit_length() - 1))
        self._mask = room - 1
        self._keys = np.full(room, -1, np.int64)
        self._slots = np.zeros(room, np.int32)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * _MIX) >> self._shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The number of each gram, -1 where it has none."""
        at = self._home(grams)
        seen = self._keys[at]
        found = seen == grams
        out = np.where(found, self._slots[at], np.int32(-1))
        left = np.flatnonzero(~found & (seen != -1))
        while len(left):
            at[left] = (at[left] + 1) & self._mask
            seen = self._keys[at[left]]
            same = seen == grams[left]
            out[left[same]] = self._slots[at[left[same]]]
            left = left[~same & (seen != -1)]
        return out

    def add(self, grams: np.ndarray) -> None:
        """Number grams, all different and none of them known, onwards."""
        self.grams = np.concatenate([self.grams, grams])
        if 10 * len(self.grams) > 7 * self._mask:
            self._room(1 << (10 * len(self.grams) // 7).bit_length())
            grams = self.grams
        first = len(self.grams) - len(grams)
        at, left = self._home(grams), np.arange(len(grams))
        while len(left):
            free = self._keys[at[left]] == -1
            # Of several for one place the last one written has it.
            self._keys[at[left[free]]] = grams[left[free]]
            mine = self._keys[at[left]] == grams[left]
            self._slots[at[left[mine]]] = first + left[mine]
            left = left[~mine]
            at[left] = (at[left] + 1) & self._mask


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in streams one after another, and a number for each, the sum of one for each byte at its place.

    Numbers are of 61 bits, above all grams; of n different words two have the
    same number with odds below n * n / 2**62.
    """
    ends = (data == 32) | (data == END[0])
    begins = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    values = np.where(ends, np.uint64(0), _BYTES[place & 63, data])
    far = place > 63
    if far.any():
        values[far] *= np.power(_MIX, (place[far] >> 6).astype(np.uint64))
    sums = np.add.reduceat(values, begins) if len(begins) else np.zeros(0, np.uint64)
    some = ~ends[begins]
    return begins[some], ((sums[some] >> np.uint64(3)) | _WORD).astype(np.int64)


def _pieces(stream: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of pieces of about SPAN bytes that end where a word does."""
    at = 0
    while at < len(stream):
        to = at + SPAN
        if to < len(stream):
            to = (stream.rfind(b" ", at, to) + 1) or (stream.find(b" ", to) + 1) or len(stream)
        else:
            to = len(stream)
        yield at, to
        at = to


def _spans(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of about SPAN bytes of the streams at a time: grams, the stream of each, numbers of words, the stream of each."""
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def given() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = np.arange(DEPTH, ends[-1])
        part = np.searchsorted(ends, at, side="right")
        # What precedes a part belongs to it as context alone.
        own = at - np.concatenate([[0], ends[:-1]])[part] >= DEPTH
        owner = np.array(owners)[part[own]]
        begins, words = words_of(data[at[own]])
        return grams_of(data)[own], owner, words, owner[begins]

    for i, s in enumerate(streams):
        whole = END * DEPTH + s
        for at, to in _pieces(s):
            parts.append(whole[at : to + DEPTH])
            owners.append(i)
            held += len(parts[-1])
            if held >= SPAN:
                yield given()
                parts, owners, held = [], [], 0
    if parts:
        yield given()


def log_kt(zeros, ones, log):
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones.

    Of columns or of arrays, with their function ``log``.
    """

    def log_gamma(x):
        # Stirling's series at x + 8, and back by the recurrence.
        z = x + 8.0
        series = (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * z) - 1 / (360.0 * z * z * z) + 1 / (1260.0 * z * z * z * z * z)
        below = x
        for i in range(1, 8):
            below = below * (x + float(i))
        return series - log(below)

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Subtrees:
    """The nodes, TOP to DEPTH deep, over some grams that are all that have their TOP nearest bytes.

    A node's key is its context and, in the lowest byte, the bits decided, led by a one.
    """

    def __init__(self, grams: np.ndarray, seen: np.ndarray) -> None:
        symbol, context = grams & 255, grams >> 8
        eight = [((context << 8) | (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1) for j in range(8)]
        keys, self.bits = np.concatenate([k for k, _ in eight]), np.concatenate([b for _, b in eight])
        keys, self.at = np.unique(keys, return_inverse=True)
        many = np.tile(seen, 8)
        zeros = np.bincount(self.at, np.where(self.bits == 0, many, 0), len(keys))
        ones = np.bincount(self.at, np.where(self.bits == 1, many, 0), len(keys))
        #: From DEPTH up: zeros, ones, the share of a node's own estimate, and the node's place among those one byte less deep.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        stays, whole = np.ones(len(keys)), log_kt(zeros, ones, np.log)
        for depth in range(DEPTH, TOP, -1):
            above, up = np.unique(keys & (256**depth - 1), return_inverse=True)
            self.levels.append((zeros, ones, stays, up))
            deeper = np.bincount(up, whole, len(above))
            zeros, ones = np.bincount(up, zeros, len(above)), np.bincount(up, ones, len(above))
            own, keys = log_kt(zeros, ones, np.log), above
            stays = 1 / (1 + np.exp(np.minimum(deeper - own, 700)))
            whole = np.logaddexp(own, deeper) - math.log(2)
        self.keys, self.zeros, self.ones, self.deeper = keys, zeros, ones, deeper

    def log10p(self, p0: np.ndarray, p1: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Each gram's probability, from the mixtures down to TOP of ``self.keys`` and what is left to deeper nodes."""
        for zeros, ones, stays, up in reversed(self.levels):
            share, total = rest[up] * stays, zeros + ones + 1
            p0, p1 = p0[up] + share * (zeros + 0.5) / total, p1[up] + share * (ones + 0.5) / total
            rest = rest[up] * (1 - stays)
        return np.log10(np.where(self.bits == 0, p0[self.at], p1[self.at])).reshape(8, -1).sum(axis=0)


def _near(gram: Column) -> Column:
    """The TOP nearest bytes of a gram's context."""
    return F.shiftright(gram, 8).bitwiseAND(F.lit(256**TOP - 1))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows ordered by their first column, near, some SPAN at a time and never with a part of those that share it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= SPAN:
            rows = pa.Table.from_batches(held)
            near = rows.column(0).to_numpy()
            begin = int(np.searchsorted(near, near[-1]))
            if begin:
                yield rows.slice(0, begin)
            held = rows.slice(begin).to_batches()
            n = len(rows) - begin
    if n:
        yield pa.Table.from_batches(held)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches):
        t = Subtrees(rows["gram"].to_numpy(), rows["seen"].to_numpy())
        yield from pa.table({"node": t.keys, "n0": t.zeros, "n1": t.ones, "deeper": t.deeper}).to_batches(SPAN)


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches):
        of_gram = pc.is_valid(rows["gram"])
        own, above = rows.filter(of_gram), rows.filter(pc.invert(of_gram))
        t = Subtrees(own["gram"].to_numpy(), own["seen"].to_numpy())
        order = np.argsort(above["node"].to_numpy())
        mixed = [above[c].to_numpy()[order] for c in ("p0", "p1", "rest")]
        yield from pa.table({"gram": own["gram"], "log10p": t.log10p(*mixed)}).to_batches(SPAN)


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram and log10p, the probability of its last byte after the others, from ``counts``: gram, seen (0 and more), each gram once.

    Grams that share their TOP nearest bytes are in one task, a small share of
    all, which works out their subtrees; the levels above are aggregates and joins.
    """
    near = counts.withColumn("near", _near(F.col("gram")))
    ordered = near.select("near", "gram", "seen").repartition("near").sortWithinPartitions("near")
    level = ordered.mapInArrow(_up, "node long, n0 double, n1 double, deeper double")
    levels: list[DataFrame] = []
    for depth in range(TOP, -1, -1):
        own = level.withColumn("own", log_kt(F.col("n0"), F.col("n1"), F.log))
        gap = F.col("own") - F.col("deeper")
        whole = F.greatest("own", "deeper") + F.log1p(F.exp(-F.abs(gap))) - math.log(2)
        levels.append(cut(own.select("node", "n0", "n1", (1 / (1 + F.exp(-gap))).alias("stays"), whole.alias("whole"))))
        if depth:
            # The oldest byte of the context goes.
            parent = F.col("node").bitwiseAND(F.lit(256**depth - 1))
            level = levels[-1].groupBy(parent.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("whole").alias("deeper"))
    above = None
    for depth, level in enumerate(reversed(levels)):
        if above is None:
            mixed = level.withColumns({"p0": F.lit(0.0), "p1": F.lit(0.0), "rest": F.lit(1.0)})
        else:
            mixed = level.withColumn("up", F.col("node").bitwiseAND(F.lit(256**depth - 1))).join(above.withColumnRenamed("node", "up"), "up")
        share, total = F.col("rest") * F.col("stays"), F.col("n0") + F.col("n1") + 1.0
        above = mixed.select(
            "node",
            (F.col("p0") + share * (F.col("n0") + 0.5) / total).alias("p0"),
            (F.col("p1") + share * (F.col("n1") + 0.5) / total).alias("p1"),
            (F.col("rest") * (1 - F.col("stays"))).alias("rest"),
        )
    both = near.unionByName(above.withColumn("near", _near(F.col("node"))), allowMissingColumns=True)
    both = both.select("near", "gram", "seen", "node", "p0", "p1", "rest").repartition("near").sortWithinPartitions("near")
    return both.mapInArrow(_down, "gram long, log10p double")


INDEXED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("item", pa.int64()), ("seen", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])


def _streams(texts: pa.Array) -> list[bytes]:
    return [stream_of(t.as_py().encode().lower().split() if t.is_valid else []) for t in texts]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts (kind 1) of one task, which are a block, and then its items (kind 0): distinct grams and words, with how often texts that aren't held out have them."""
    block, key = TaskContext.get().partitionId(), pa.null()
    items, seen = GramTable(), np.zeros(0, np.int64)

    def rows(n: int, kind: int, **columns: pa.Array) -> pa.RecordBatch:
        given = {"block": pa.array(np.full(n, block)), "kind": pa.array(np.full(n, kind, np.int32))} | columns
        schema = pa.schema([*INDEXED, pa.field("_key", key)])
        return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    for batch in batches:
        key = batch.schema.field(0).type
        yield rows(len(batch), 1, _key=batch.column(0), held_out=batch.column(1), text=batch.column(2).cast(pa.string()))
        learns = ~batch.column(1).to_numpy(zero_copy_only=False)
        for grams, owner, words, word_owner in _spans(_streams(batch.column(2))):
            for some, whose in ((grams, owner), (words, word_owner)):
                at = items.find(some)
                new = np.unique(some[at < 0])
                if len(new):
                    items.add(new)
                    seen = np.concatenate([seen, np.zeros(len(new), np.int64)])
                    at = np.where(at < 0, items.find(some), at)
                seen += np.bincount(at[learns[whose]], minlength=len(seen))
    for at in range(0, len(items.grams), SPAN):
        some = items.grams[at : at + SPAN]
        yield rows(len(some), 0, item=pa.array(some), seen=pa.array(seen[at : at + SPAN]))


def _same(ids: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of equal ids."""
    ends = np.concatenate([np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(0, np.int64)
    return [(int(b), int(e)) for b, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ids) else []


def _read(key: str, kind: str, tokens: int, distinct: int, ends: int) -> tuple[Callable, str]:
    """Reads blocks: first a block's table, then its texts, scored against it."""

    def scored(part: pa.RecordBatch, items: GramTable, values: np.ndarray) -> pa.RecordBatch:
        streams = _streams(part["text"])
        n, known, base, score = np.zeros((4, len(streams)))
        for grams, owner, words, word_owner in _spans(streams):
            score += np.bincount(owner, values[items.find(grams)], minlength=len(n))
            seen = values[items.find(words)]
            n += np.bincount(word_owner, minlength=len(n))
            known += np.bincount(word_owner, seen > 0, minlength=len(n))
            base += np.bincount(word_owner, np.log10(seen + 1), minlength=len(n))
        base += math.log10(ends + 1) - (n + 1) * math.log10(tokens + distinct + 1)
        columns = [
            part["_key"],
            part["held_out"],
            pa.array((n + 1).astype(np.int64)),
            pa.array((known + (ends > 0)).astype(np.int64)),
            pa.array(np.full(len(n), tokens)),
            pa.array(base),
            pa.array(score),
            pa.array(-score / math.log10(2) / np.array([len(s) for s in streams])),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, parts, items, values = None, [], GramTable(), np.zeros(0)
        for batch in batches:
            blocks = np.asarray(batch["block"])
            for begin, end in _same(blocks * 2 + np.asarray(batch["kind"])):
                if blocks[begin] != of:
                    of, parts = blocks[begin], []
                part = batch.slice(begin, end - begin)
                if not part["kind"][0].as_py():
                    parts.append((part["item"].to_numpy(), part["value"].to_numpy()))
                    continue
                if parts:
                    found, values, items = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), GramTable()
                    items.add(found)
                    parts = []
                yield scored(part, items, values)

    return run, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``.

    The rows for which ``held_out`` isn't true are learnt from, and are scored,
    too.  A text's tokens are its words, A-Z in lower case, and one end; base_score is the
    logarithm (of base 10) of their probability by counts of tokens, one added to
    each; score is that of the context trees, of the same words parted by single
    spaces and closed.  Null counts as the empty text, whose only token is the
    end.  Texts are scored whole, very long ones a span at a time.  Rows that
    repeat are learnt from, and scored, each; other columns are not read; an
    empty table gives no rows.

    The texts are written once to the shared folder, with the block (the scan's
    partition) that each is in.  A worker holds the distinct grams and words of
    one block.
    """
    spark = docs.sparkSession
    text_batches(spark)
    frame = spread(docs.select(F.col(key).alias("_key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text")))
    kind = frame.schema["_key"].dataType.simpleString()
    folder = f"{shared_folder(spark)}/context-tree-{uuid.uuid4().hex}"
    # Parts that are small are put together, so that a block's grams, most of which all blocks have, are not too many for its texts.
    parts = frame.rdd.getNumPartitions()
    together = max(1, BLOCK_BYTES // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if parts > spark.sparkContext.defaultParallelism and together > 1:
        frame = frame.coalesce(-(-parts // together))
    frame.mapInArrow(_indexed, f"block long, kind int, item long, seen long, held_out boolean, text string, _key {kind}").write.parquet(folder)
    indexed = spark.read.parquet(folder)
    texts, items = indexed.where("kind = 1"), indexed.where("kind = 0").select("block", "item", "seen")
    counts = cut(items.groupBy("item").agg(F.sum("seen").alias("seen")))
    is_word = F.col("item") >= int(_WORD)
    total = counts.where(is_word).agg(F.sum("seen").alias("n"), F.count_if(F.col("seen") > 0).alias("v")).first()
    ends = texts.where(~F.col("held_out")).count()
    run, schema = _read(key, kind, (total["n"] or 0) + ends, total["v"] + (ends > 0), ends)
    grams = gram_scores(counts.where(~is_word).withColumnRenamed("item", "gram")).select(F.col("gram").alias("item"), F.col("log10p").alias("value"))
    values = grams.unionByName(counts.where(is_word).select("item", F.col("seen").cast("double").alias("value")))
    known = items.select("block", "item").join(values, "item").withColumn("kind", F.lit(0))
    rows = texts.select("block", "kind", "_key", "held_out", "text").unionByName(known, allowMissingColumns=True)
    return (
        rows.select("block", "kind", "_key", "held_out", "text", "item", "value")
        .repartitionById(max(1, frame.rdd.getNumPartitions()), F.col("block").cast("int"))
        .sortWithinPartitions("block", "kind")
        .mapInArrow(run, schema)
    )


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, learning from six in seven."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).drop("bits_per_byte")
