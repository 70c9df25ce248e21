"""Token counts of a document's sections, from one encoding of the whole document.

Encoding sections one by one counts other tokens than the document has.  Here
the whole text is encoded once; the tokens' lengths give their character
spans, and each span is joined to the sections it overlaps.  A token that lies
in several sections is counted once, by a stated rule:

* ``first``: to the section in which the token begins,
* ``last``: to the section in which it ends,
* ``most``: to the section that has most of its characters, the earlier of equal ones.

A token that ends within a character (byte-level tokens may) counts that
character as its own.  Sections tile the text, so the counts of a document's
sections add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import table

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_sections(text: str) -> np.ndarray:
    """Where the sections begin, in characters: after each line feed that is followed by something."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero(points == 10) + 1
    return np.concatenate([[0], starts[starts < len(points)]])


class ByteTokens:
    """A byte-level BPE with the byte length of each id."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_file, "rb") if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        at = np.cumsum((raw & 0xC0) != 0x80) - 1  # by byte, the character it belongs to
        return at[begins], at[ends - 1] + 1


_loaded: dict[str, ByteTokens] = {}


def attribute(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and border-crossing tokens of each section; sections begin at ``starts``."""
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = first != last
    home = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        stops = np.append(starts[1:], length)
        for k in np.flatnonzero(crossing):
            within = range(first[k], last[k] + 1)
            home[k] = max(within, key=lambda s: (min(stops[s], ends[k]) - max(starts[s], begins[k]), -s))
    return np.bincount(home, minlength=len(starts)), np.bincount(home[crossing], minlength=len(starts))


def public_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def section_tokens(docs: DataFrame, ranks_file: str | Callable[[], str], pattern: str, rule: str = "first", sections: Callable[[str], np.ndarray] = line_sections, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each section of each row of ``docs``: its span, its tokens, and those of them that cross a border.

    Null and empty texts have one empty section without tokens.  Keys may be
    null and rows may repeat; very long texts are encoded whole; sections that
    share a token's characters equally are decided between by ``rule``; other
    columns are not read; an empty table gives no rows.  ``ranks_file`` is a
    path, or a function that finds it in the worker.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = ranks_file if isinstance(ranks_file, str) else ranks_file()
        if path not in _loaded:
            _loaded[path] = ByteTokens(path, pattern)
        tokens = _loaded[path]
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), []
            owners: list[int | None] = []
            for doc, t in zip(keys, batch.column(1), strict=True):
                t = t.as_py() or ""
                starts = sections(t) if t else np.zeros(1, np.int64)
                none = np.zeros(len(starts), np.int64)
                n, crossing = attribute(*tokens.spans(t), starts, len(t), rule) if t else (none, none)
                parts.append((np.arange(len(starts)), starts, np.append(starts[1:], len(t)), n, crossing))
                owners += [doc] * len(starts)
            joined = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners, pa.int64()), pa.array(joined[0], pa.int32()), *[pa.array(c, pa.int64()) for c in joined[1:]]],
                ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, SCHEMA)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents; a token belongs to the line in which it begins."""
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_ranks, public_tokenizers.PATTERN, "first")
