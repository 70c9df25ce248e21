"""URL rules by a bit-parallel wildcard automaton.

Every rule is one or more glob patterns over the canonical URL, which is a dot,
the host in lower case and the path.  In a glob, ``*`` stands for any run of
characters but ``/``, ``**`` for any run, ``?`` for one character, anything
else for itself; a pattern has to cover the whole URL.  All patterns lie side
by side in one row of bits, a bit for each place between their characters, cut
into 64-bit words.  One byte of a URL moves all patterns of a whole batch of
URLs at once: ``D = ((D << 1) & B[c]) | (D & S[c])``, with B the places that c
leads to and S the places that a star keeps for c.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import table

#: verdict, host and path of each rule; fixed by contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Globs that block where no rule fits: hosts that sell links, and files that are not pages.
BLOCK_GLOBS = ("*.spam-*/**", "*.*-pills.*/**", "**.exe", "**.zip", "**.jpg", "**.png")


@dataclass(frozen=True)
class Pattern:
    glob: str
    verdict: str
    rule: str | None  # as it is shown; None for a glob of the method's own


def patterns_of(rules=RULES, block_globs=BLOCK_GLOBS) -> list[Pattern]:
    """Patterns by rank: the first that fits decides.  Longer rules come first, blocks before allows, globs last."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    out = [Pattern(f"*.{_quoted(host)}{_quoted(path)}**", verdict, host + path) for verdict, host, path in ranked]
    return out + [Pattern(g, "block", None) for g in block_globs]


def _quoted(text: str) -> str:
    if set(text) & set("*?"):
        raise ValueError(f"a rule is plain text: {text}")
    return text


class ShiftAnd:
    """All globs at once; ``match`` gives which of them cover each URL."""

    def __init__(self, globs: list[str]) -> None:
        moves: list[tuple[str, set[int] | None]] = []  # for each place, the bytes that lead to it
        loops: list[str] = []  # for each place, "" or the star that stands there
        self.starts, self.ends = [], []
        for glob in globs:
            self.starts.append(len(moves))
            moves.append(("", set()))
            loops.append("")
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    wide = raw[i : i + 2] == b"**"
                    loops[-1] = "**" if wide or loops[-1] == "**" else "*"
                    i += 2 if wide else 1
                    continue
                moves.append(("", None if raw[i : i + 1] == b"?" else {raw[i]}))
                loops.append("")
                i += 1
            self.ends.append(len(moves) - 1)
        self.words = (len(moves) + 63) // 64
        self.B = np.zeros((256, self.words), np.uint64)
        self.S = np.zeros((256, self.words), np.uint64)
        for place, ((_, leads), star) in enumerate(zip(moves, loops, strict=True)):
            word, bit = place // 64, np.uint64(1 << place % 64)
            for c in range(256):
                if leads is None or c in leads:
                    self.B[c, word] |= bit
                if star == "**" or star == "*" and c != ord("/"):
                    self.S[c, word] |= bit
        self.first = np.zeros(self.words, np.uint64)
        for place in self.starts:
            self.first[place // 64] |= np.uint64(1 << place % 64)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each glob.  URLs are taken by length, so the batch shrinks as they end."""
        n = len(urls)
        state = np.repeat(self.first[None, :], n, axis=0)
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = -lengths[order]  # ascending, for searchsorted
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        text = np.frombuffer(b"".join(urls), np.uint8)
        live = state[order]
        for i in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(sorted_lengths, -i, "left"))  # those longer than i
            c = text[starts[:k] + i]
            d = live[:k]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            live[:k] = (shifted & self.B[c]) | (d & self.S[c])
        state[order] = live
        ends = np.array(self.ends)
        return (state[:, ends // 64] >> (ends % 64).astype(np.uint64)) & np.uint64(1) == 1


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "replace").lower().decode("utf-8"), slash + path


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, otherwise: str = "allow", key: str = "page_id", url: str = "url", block: int = 4096) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    of those that fit, the longest decides (of equally long ones a block).
    Where none fits, rule is null and a URL is blocked if a glob of
    ``block_globs`` covers it, else the verdict is ``otherwise``.  Null URLs and
    those without ``://`` have empty host and path and get ``otherwise``.  Keys
    may be null and rows may repeat; other columns are not read; an empty table
    gives no rows.  ``block`` URLs are simulated at a time.
    """
    ranked = patterns_of(rules, block_globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([p.glob for p in ranked])
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
                fits = automaton.match([f".{h}{p}".encode() if h or p else b"" for h, p in parts])
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
                chosen = [ranked[i] if i >= 0 else None for i in first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([h for h, _ in parts], pa.string()),
                        pa.array([p for _, p in parts], pa.string()),
                        pa.array([c.rule if c else None for c in chosen], pa.string()),
                        pa.array([c.verdict if c else otherwise for c in chosen], pa.string()),
                    ],
                    ["page_id", "host", "path", "rule", "verdict"],
                )

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("_url")).mapInArrow(run, SCHEMA)


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1), '') AS path FROM a),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT b.*, (SELECT max_by(struct_pack(rule := h || p, verdict := verdict), length(h || p)) FROM r
                   WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p)) AS best FROM b)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches('.' || host || path, '^[^/]*\.spam-[^/]*/') OR regexp_matches('.' || host || path, '^[^/]*\.[^/]*-pills\.[^/]*/')
                                     OR regexp_matches(path, '\.(exe|zip|jpg|png)$') OR (path = '' AND regexp_matches('.' || host, '\.(exe|zip|jpg|png)$')) THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
