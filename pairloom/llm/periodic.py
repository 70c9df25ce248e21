"""Periodic runs of words in texts, by seeds that are extended along diagonals.

In a run with period q the words q apart are the same, so along the diagonal of
lag q at least max(6 - q, 3q) words in a row agree: the overlap that is
guaranteed.  Lags are dealt into bands a to b, and a band's k-grams have the
length k that its lags guarantee.  All places of a k-gram in a document are
indexed, and a place and the next one with the same k-gram are a seed if their
lag is in the band.  The next place is enough: b is (k + 1) / 2 at most, so if a
k-gram came again within a run sooner than one period later, the two copies
would overlap so far that the run had a smaller period.  So every place of a run
from which k words agree is a seed, and occurrence pairs are no more than words.

A seed is extended both ways while the words agree.  For each lag a table has
the place up to which its diagonal is covered, and seeds before that place are
not extended again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import table, text_batches

#: A run has at least so many words, and at least so many periods.
LEAST, TIMES = 6, 4
#: Documents are indexed together until they have so many words; a longer one is indexed alone.
WORDS = 400_000
#: Words compared at first when a seed is extended.
STEP = 64
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def bands(longest: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, k) for all lags that a run in ``longest`` words can have."""
    a = 1
    while max(LEAST, TIMES * a) <= longest:
        k = min(max(LEAST - q, (TIMES - 1) * q) for q in (a, a + 1, a + 2))
        yield a, (k + 1) // 2, k
        a = (k + 1) // 2 + 1


class Grams:
    """Numbers of the k-grams that occur more than once, equal just where the k-grams are.

    A k-gram is two overlapping halves, and can only be repeated where both are,
    so each level looks at what is left of the one below.
    """

    def __init__(self, words: np.ndarray) -> None:
        places = np.arange(len(words))
        self._size = len(words)
        self._levels = [self._repeated(places, words)]

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a repeated k-gram begins, and its number."""
        j = k.bit_length() - 1
        while len(self._levels) <= j:
            self._levels.append(self._joined(self._levels[-1], 1 << (len(self._levels) - 1)))
        level = self._levels[j]
        if k > 1 << j:
            level = self._joined(level, k - (1 << j))
        at = np.flatnonzero(level >= 0)
        return at, level[at]

    def _joined(self, level: np.ndarray, gap: int) -> np.ndarray:
        at = np.flatnonzero((level[:-gap] >= 0) & (level[gap:] >= 0))
        return self._repeated(at, level[at] * self._size + level[at + gap])

    def _repeated(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.full(self._size, -1, np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        number = np.cumsum(new) - 1
        many = (np.bincount(number) > 1)[number] if len(number) else new
        out[at[order[many]]] = number[many]
        return out


def _agree(words: np.ndarray, i: int, lag: int) -> int:
    """The first place from i on whose word isn't that ``lag`` later."""
    end, step = len(words) - lag, STEP
    while i < end:
        to = min(i + step, end)
        apart = words[i:to] != words[i + lag : to + lag]
        at = int(apart.argmax())
        if apart[at]:
            return i + at
        i, step = to, step * 2
    return end


def _agree_back(words: np.ndarray, i: int, lag: int) -> int:
    """The first of the agreeing places that end before i."""
    step = STEP
    while i > 0:
        to = max(i - step, 0)
        apart = (words[to:i] != words[to + lag : i + lag])[::-1]
        at = int(apart.argmax())
        if apart[at]:
            return i - at
        i, step = to, step * 2
    return 0


def find_runs(documents: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document (numbers of its words), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    lengths = np.array([len(d) for d in documents], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    if not begins[-1]:
        return found
    # A number stands for a word in one document, so nothing agrees over the end of one.
    words = np.concatenate(documents) + np.repeat(np.arange(len(documents)) * (max(int(d.max(initial=0)) for d in documents) + 1), lengths)
    grams = Grams(words)
    for a, b, k in bands(int(lengths.max())):
        at, number = grams.places(k)
        if not len(at):
            break  # longer ones aren't repeated either
        ordered = np.sort(number * len(words) + at)
        place, number = ordered % len(words), ordered // len(words)
        lag = np.diff(place)
        seeds = np.flatnonzero((number[1:] == number[:-1]) & (lag >= a) & (lag <= b))
        ordered = np.sort(lag[seeds] * len(words) + place[seeds])
        covered: dict[int, int] = {}
        # Of seeds side by side on a diagonal only the first can be uncovered.
        for key in ordered[np.concatenate([[True], np.diff(ordered) != 1])[: len(ordered)]].tolist():
            q, i = divmod(key, len(words))
            if i < covered.get(q, 0):
                continue
            start, end = _agree_back(words, i, q), _agree(words, i, q)
            covered[q] = end
            length = end - start + q
            if length >= max(LEAST, TIMES * q):
                of = int(np.searchsorted(begins, start, side="right")) - 1
                found[of].append((start - int(begins[of]), length, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def words_of(text: str | None, key: object = None) -> list[bytes]:
    return text.encode().split() if text else []


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: Callable[[str | None, object], list[bytes]] = words_of, texts: bool = False) -> DataFrame:
    """Key, n_words, runs, collapsed_sha256 and, if ``texts``, collapsed of every row of ``docs``.

    A run is a stretch of consecutive words with smallest period q, of at least
    LEAST words and TIMES periods, that no neighbouring word extends.  ``runs``
    has (start, length, period) by start, then period.  ``collapsed`` are the
    words, joined by one space, that are not in a run behind its first period.
    ``words`` gives a row's words from text and key.  Null and empty texts have
    no words, no runs, and an empty collapsed text.  Documents are whole however
    long: a document takes some 60 bytes a word while it is worked on.  Rows that
    repeat get a row each; other columns are not read; an empty table gives no
    rows.
    """
    text_batches(docs.sparkSession)
    frame = docs.select(key, F.col(text).alias("_text"))
    kind = frame.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string, collapsed string"

    def some(rows: list[list[bytes]]) -> Iterator[tuple[int, list[dict[str, int]], str, str | None]]:
        numbers: dict[bytes, int] = {}
        ids = [np.array([numbers.setdefault(w, len(numbers)) for w in row], np.int64) for row in rows]
        for row, runs in zip(rows, find_runs(ids), strict=True):
            kept = row if not runs else [row[i] for i in np.flatnonzero(kept_words(len(row), runs)).tolist()]
            collapsed = b" ".join(kept)
            as_rows = [{"start": s, "length": n, "period": q} for s, n, q in runs]
            yield len(row), as_rows, hashlib.sha256(collapsed).hexdigest(), collapsed.decode() if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows: list[list[bytes]] = []
            held = 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(words(t.as_py(), k.as_py()))
                held += len(rows[-1])
                if held >= WORDS:
                    out.extend(some(rows))
                    rows, held = [], 0
            out.extend(some(rows))
            n, runs, digests, collapsed = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(digests, pa.string()), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "runs", "collapsed_sha256", "collapsed"])

    found = frame.mapInArrow(run, schema)
    return found if texts else found.drop("collapsed")


def planted(text: str | None, key: object) -> list[bytes]:
    """The words of a document; those of one in ten, by the checksum of its id, go round from some place on."""
    words = words_of(text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


def op12_periodic(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents with planted ones: their number, the one of most periods, and digests of runs and collapsed text."""
    found = periodic_runs(table(spark, sf_dir, "documents"), words=planted)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    most = F.aggregate(
        "runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_most", most).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_most.start").alias("start"),
        F.col("_most.length").alias("length"),
        F.col("_most.period").alias("period"),
        F.expr("1000 * _most.length div _most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
