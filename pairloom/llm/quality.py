"""Document quality by weak supervision.

Rules look at counts of a text and vote good, bad or abstain.  How far each
rule is to be believed is not set by hand: expectation-maximisation over all
documents' votes estimates the share of good documents and, for each rule, how
often its vote is right on good ones and on several kinds of bad ones.  The posterior probability of
being good then decides, so one failed rule does not reject a document.

Votes are counted by pattern: with R rules there are at most 3**R patterns
however many documents there are, so the estimation runs on that small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import cut, table
from pairloom.llm.shingles import WordHashes

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name, counts to the ratio, bad below, good from, good to, bad above; between good and bad a rule abstains.
RULES = (
    ("length", lambda c: c["n_words"], 50, 80, np.inf, np.inf),
    ("word_length", lambda c: c["word_chars"] / max(c["n_words"], 1), 2.0, 3.0, 10.0, 14.0),
    ("symbols", lambda c: c["n_symbols"] / max(c["n_words"], 1), 0, 0, 0.1, 0.3),
    ("symbol_share", lambda c: c["n_symbols"] / max(c["word_chars"], 1), 0, 0, 0.03, 0.08),
    ("repeated_lines", lambda c: c["n_dup_lines"] / max(c["n_lines"], 1), 0, 0, 0.1, 0.3),
    ("repeated_words", lambda c: c["n_repeat_words"] / max(c["n_words"], 1), 0, 0, 0.2, 0.4),
    ("distinct_words", lambda c: c["n_distinct"] / max(min(c["n_words"], 400), 1), 0.1, 0.25, np.inf, np.inf),
    ("capitals", lambda c: c["n_upper"] / max(c["word_chars"], 1), 0, 0, 0.2, 0.5),
    ("exclamations", lambda c: c["n_exclaim"] / max(c["n_words"], 1), 0, 0, 0.1, 0.3),
)

#: Mean, and documents it weighs as much as, of a rule's accuracy on good documents, on its own bad kind and on others.
PRIOR = ((0.98, 50), (0.9, 10), (0.2, 5))


def counts_of(text: str | None, hashes: WordHashes) -> dict[str, int]:
    """Counts of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    repeat = distinct = 0
    if n:
        w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        distinct = len(np.unique(w))
        if n >= 3 and distinct < n:
            _, inverse, times = np.unique(w[:-2] * _P[0] + w[1:-1] * _P[1] + w[2:] * _P[2], return_inverse=True, return_counts=True)
            again = times[inverse] > 1
            covered = np.zeros(n, bool)
            for i in range(3):
                covered[i : n - 2 + i] |= again
            repeat = int(covered.sum())
    return {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, _BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "n_lines": len(lines),
        "n_distinct": distinct,
        "n_upper": len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        "n_exclaim": raw.count(b"!"),
    }


def votes_of(counts: dict[str, int]) -> int:
    """The votes as one number, a digit to base 3 for each rule: 0 abstains, 1 bad, 2 good."""
    pattern = 0
    for _, ratio, bad_below, good_from, good_to, bad_above in RULES:
        x = ratio(counts)
        vote = 1 if x < bad_below or x > bad_above else 2 if good_from <= x <= good_to else 0
        pattern = pattern * 3 + vote
    return pattern


def base_failed(counts: dict[str, int]) -> bool:
    return counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]


def posteriors(patterns: list[tuple[int, int]], settled: float = 1e-9) -> dict[int, float]:
    """P(good | votes) for each pattern of ``patterns`` (pattern, documents), by expectation-maximisation.

    A document is good or of one of as many bad kinds as there are rules.  Given
    that a rule votes, it is right with probability a on good documents and b on
    those of a kind.  A kind begins as what one rule sees (b 0.9) and others
    mostly don't (0.3), so rare kinds are found beside common ones: what tells a
    kind from errors of a rule is that other rules see it more often than good
    documents.  Bad votes that no other rule bears out are errors, and a falls
    as low as they say (to 0.5, as below it a vote would turn against its own
    meaning).  PRIOR has what is believed before any document is seen; it weighs
    as much as a few documents and so gives way to the data.  Each round makes
    the data likelier; it ends when no estimate moves by more than ``settled``.
    """
    patterns = sorted(patterns)
    if not patterns:
        return {}
    code, weight = np.array([p for p, _ in patterns]), np.array([n for _, n in patterns], float)
    n = len(RULES)
    digits = np.stack([code // 3 ** (n - 1 - i) % 3 for i in range(n)], axis=1)
    good, bad = (digits == 2).astype(float), (digits == 1).astype(float)
    own = np.eye(n, dtype=bool)
    (a_mean, a_docs), (own_mean, own_docs), (mean, docs) = PRIOR
    b_docs = np.where(own, own_docs, docs)
    b_bad = np.where(own, own_mean, mean) * b_docs
    share, a, b = np.array([0.8, *[0.2 / n] * n]), np.full(n, a_mean), np.where(own, 0.9, 0.3)
    moved = 1.0
    while moved > settled:
        before = np.concatenate([share, a, b.ravel()])
        log_good = good @ np.log(a) + bad @ np.log(1 - a)
        log_bad = good @ np.log(1 - b).T + bad @ np.log(b).T
        log_p = np.log(share) + np.column_stack([log_good, log_bad])
        p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        of = p * weight[:, None]
        share = (of.sum(axis=0) + 1) / (weight.sum() + n + 1)
        a = np.clip((of[:, 0] @ good + a_mean * a_docs) / (of[:, 0] @ (good + bad) + a_docs), 0.5, 0.999)
        b = np.clip((of[:, 1:].T @ bad + b_bad) / (of[:, 1:].T @ (good + bad) + b_docs), 0.01, 0.99)
        moved = np.abs(np.concatenate([share, a, b.ravel()]) - before).max()
    return dict(zip(code.tolist(), p[:, 0].tolist(), strict=True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = [counts_of(t.as_py(), hashes) for t in batch.column(1)]
        columns = [pa.array([r[c] for r in rows], pa.int64()) for c in COUNTS]
        columns += [pa.array([base_failed(r) for r in rows], pa.bool_()), pa.array([votes_of(r) for r in rows], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *COUNTS, "base_failed", "votes"])


def _fit(votes: DataFrame) -> dict[int, float]:
    """``votes`` has a column votes; at most 3**R counted patterns reach the driver."""
    return posteriors([(r["votes"], r["n"]) for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()])


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Key, counts, base_failed, votes, probability and kept of every row of ``docs``.

    A row is kept if it passes the base (50 words or more, at most half of them
    in repeated three-word windows) and its posterior probability of being good
    is ``least`` or more.  Null and empty texts have no words and fail the base.
    Null keys and repeated rows are judged like any others; a probability of
    just ``least`` is kept; very long texts are counted whole; other columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, votes int"
    rows = cut(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(_features, schema))
    found = spark.createDataFrame(list(_fit(rows).items()), "votes int, probability double")
    return rows.join(F.broadcast(found), "votes", "left").select(
        F.col("doc_id").alias(key), *COUNTS, "base_failed", "votes", "probability", (~F.col("base_failed") & (F.col("probability") >= least)).alias("kept")
    )


def quality_filter(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.

    The texts are gone over twice, once to count votes and once to filter, and
    never shuffled.  Null, empty and blank texts go; rows that repeat stay or go
    alike; an empty table gives no rows.
    """

    @F.pandas_udf("int")
    def votes(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        return pd.Series([votes_of(counts_of(t, hashes)) for t in texts], dtype="int32")

    good = {v for v, p in _fit(docs.select(votes(text).alias("votes"))).items() if p >= least}

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        counts = [counts_of(t, hashes) for t in texts]
        return pd.Series([not base_failed(c) and votes_of(c) in good for c in counts], dtype=bool)

    return docs.where(kept(text))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and weak-supervision verdict of all documents."""
    return quality(table(spark, sf_dir, "documents"))
