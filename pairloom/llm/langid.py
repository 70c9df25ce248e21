"""Language of a text by cross-parsing entropy.

A sample of each language's texts becomes a suffix automaton.  A text is parsed
against it into the longest phrases that occur in the sample: the more foreign
the language, the more phrases.  The language that needs the fewest phrases,
normalised by the text's length, is the text's.

Parsing runs over many texts at once: one step moves every text of a batch by
one character in every language.  Each character of the samples is a symbol of
its own.  Moves by the most frequent ones are a table of states by symbols;
those by all others, of which a state has few, are looked up by state and
symbol in a sorted list.  A long text is parsed in blocks beside short ones:
each block from its own start first, then again from the state in which the
block before it ends, up to the place where both parses agree.  So the phrases
are those of the whole text, wherever blocks begin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.shared import table

#: The sample of a language: at most so many texts, of longer ones a piece of so many characters, and no further one when they
#: have so many characters together.
SAMPLE_TEXTS, PIECE, SAMPLE_CHARS = 150, 3_000, 45_000
#: Symbols with a column in the table of moves; results do not depend on it.
COLUMNS = 62
#: Characters of a block, and of its beginning, after which two parses of it mostly agree.
BLOCK, MARK = 1024, 96
#: Blocks parsed side by side.
LANES = 2048
_PHRASE = np.int32(1 << 30)
#: A letter, then letters and the marks that belong to them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def letters_of(text: str | None) -> str:
    """Runs of letters and their marks in lower case, parted by single spaces."""
    return " ".join(_WORD.findall(text.lower())) if text else ""


class SuffixAutomaton:
    """All substrings of a sequence of symbols; ``next[state]`` maps a symbol to a state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, symbol: int) -> None:
        new = self._state({}, self.length[self.last] + 1, 0)
        p = self.last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
        self.last = new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


class CrossParser:
    """Phrase counts of texts against the samples of several languages."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        clean = {k: [letters_of(t) for t in v] for k, v in samples.items()}
        seen: dict[str, int] = {}
        for texts in clean.values():
            for t in texts:
                for c in t:
                    seen[c] = seen.get(c, 0) + 1
        letters = sorted(seen, key=lambda c: (-seen[c], c))
        self.width = min(len(letters), COLUMNS) + 2
        pad = self.width - 1  # between the symbols with a column and the others
        self.symbol = np.zeros(0x110000, np.int32)  # 0: any character that is in no sample
        for i, c in enumerate(letters, 1):
            self.symbol[ord(c)] = i if i < pad else i + 1
        self.others = max(len(letters) + 2 - self.width, 0)
        tables = []
        for language in self.languages:
            automaton = SuffixAutomaton()
            for t in clean[language]:
                for s in self.symbols(t):
                    automaton.add(int(s))
                automaton.add(-1)  # no phrase runs over the end of a sample text
            tables.append(automaton.next)
        base = 0
        self.roots, parts = [], []
        keys: list[int] = []
        targets: list[int] = []
        begins = []
        for states in tables:
            # A character that does not lengthen the phrase begins the next one: that move is marked with
            # _PHRASE.  One more state stands for no phrase, at the start and after a character not in the sample.
            idle = base + len(states)
            begin = np.full(self.width + self.others, idle, np.int32) | _PHRASE
            for s, to in states[0].items():
                if s >= 0:
                    begin[s] = (base + to) | _PHRASE
            begins.append(begin[self.width :])
            moves = np.repeat(begin[None, : self.width], len(states) + 1, axis=0)
            for i, following in enumerate(states):
                for s, to in following.items():
                    if s >= self.width:
                        keys.append((base + i) * self.others + s - self.width)
                        targets.append(base + to)
                    elif s >= 0:
                        moves[i, s] = base + to
            moves[:, pad] = np.arange(base, idle + 1)  # padding moves nothing
            self.roots.append(idle)
            parts.append(moves)
            base = idle + 1
        self.moves = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.begins = np.array(begins, np.int32)

    def symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each whole text needs: a row for each text, a column for each language."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            s = self.symbols(t)
            for at in range(0, len(s), BLOCK):
                blocks.append(s[at : at + BLOCK])
                owner.append(i)
        if not blocks:
            return out
        n = len(blocks)
        whose = np.array(owner)
        idle = np.array(self.roots, np.int32)
        begin = np.repeat(idle[:, None], n, axis=1)  # the state each block was parsed from
        end, count, mark, upto = (np.zeros((len(idle), n), np.int32) for _ in range(4))

        def whole(which: np.ndarray) -> None:
            for mine, lane in self._lanes([blocks[b] for b in which]):
                b = which[mine]
                mark[:, b], upto[:, b] = self._parse(lane[:MARK], begin[:, b])
                end[:, b], rest = self._parse(lane[MARK:], mark[:, b])
                count[:, b] = upto[:, b] + rest

        whole(np.arange(n))
        follows = np.flatnonzero(whose[1:] == whose[:-1]) + 1
        while True:
            # Blocks whose predecessor has come to end elsewhere than they were parsed from.
            changed = follows[(begin[:, follows] != end[:, follows - 1]).any(axis=0)]
            if not len(changed):
                break
            begin[:, changed] = end[:, changed - 1]
            again = []
            for mine, lane in self._lanes([blocks[b][:MARK] for b in changed]):
                b = changed[mine]
                state, some = self._parse(lane, begin[:, b])
                agrees = (state == mark[:, b]).all(axis=0)
                at = b[agrees]
                count[:, at] += some[:, agrees] - upto[:, at]
                upto[:, at] = some[:, agrees]
                again.append(b[~agrees])
            whole(np.concatenate(again))
        np.add.at(out, whose, count.T)
        return out

    def _lanes(self, blocks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of like length side by side: their numbers, and symbols by place and block, padded at the end."""
        order = np.array(sorted(range(len(blocks)), key=lambda k: -len(blocks[k])), np.int64)
        for at in range(0, len(order), LANES):
            mine = order[at : at + LANES]
            lane = np.full((len(blocks[mine[0]]), len(mine)), self.width - 1, np.int32)
            for k, b in enumerate(mine):
                lane[: len(blocks[b]), k] = blocks[b]
            yield mine, lane

    def _moved(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The moves from ``state`` (languages by texts), some of them by symbols without a column."""
        other = symbols >= self.width
        moved = np.empty_like(state)
        moved[:, ~other] = self.moves[state[:, ~other] * np.int32(self.width) + symbols[~other]]
        s = symbols[other] - self.width
        key = state[:, other].astype(np.int64) * self.others + s
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        moved[:, other] = np.where(self.keys[at] == key, self.targets[at], self.begins[:, s])
        return moved

    def _parse(self, lane: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the given states: the states (languages by texts) after all places, and the phrases that began."""
        count = np.zeros(state.shape, np.int32)
        others = (lane >= self.width).any(axis=1)
        for symbols, some in zip(lane, others, strict=True):
            if some:
                moved = self._moved(state, symbols)
            else:
                moved = self.moves[state * np.int32(self.width) + symbols]
            count += moved >> np.int32(30)
            state = moved & (_PHRASE - np.int32(1))
        return state, count


def training_sample(docs: DataFrame, trains: Column, lang: str = "lang", text: str = "text") -> dict[str, list[str]]:
    """A bounded sample of the labelled rows for which ``trains`` holds, by language.

    Different texts are drawn by their hash, whatever their length, and of a
    longer one a piece of PIECE characters from a place that the hash names, until
    there are SAMPLE_TEXTS of them or they have SAMPLE_CHARS characters together.
    Rows are counted first, so that only those with a hash small enough to be
    drawn are ranked, few of each language wherever they lie.
    """
    h = F.xxhash64(text)
    begin = F.pmod(h, F.greatest(F.length(text) - PIECE, F.lit(0)) + 1) + 1
    rows = docs.where(trains & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), h.alias("h"), F.substr(text, begin.cast("int"), F.lit(PIECE)).alias("t")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[str]] = {}
    share = 4.0 * SAMPLE_TEXTS
    todo = sorted(sizes)
    while todo:
        limits = {k: min(share / sizes[k], 1.0) for k in todo}
        known = docs.sparkSession.createDataFrame(list(limits.items()), "lang string, share double")
        few = rows.join(F.broadcast(known), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share")).drop("share")
        ranked = few.dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        drawn: dict[str, list[str]] = {k: [] for k in todo}
        for r in ranked.where(F.col("k") <= SAMPLE_TEXTS).orderBy("lang", "k").collect():
            if sum(map(len, drawn[r["lang"]])) < SAMPLE_CHARS:
                drawn[r["lang"]].append(r["t"])
        # Where copies left too few different texts below the limit, it is raised.
        full = lambda k: len(drawn[k]) >= SAMPLE_TEXTS or sum(map(len, drawn[k])) >= SAMPLE_CHARS
        whole = lambda k: limits[k] >= 1.0
        done = [k for k in todo if full(k) or whole(k)]
        out |= {k: drawn[k] for k in done}
        todo = [k for k in todo if k not in done]
        share *= 16
    return out


_parsers: dict[str, CrossParser] = {}


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    Rows whose crc32(key as text) mod 3 is 1 are held out; a null key is not
    held out.  Only other rows' text and non-null lang are learnt from; neither
    key nor lang is an input of a prediction.  Null texts and texts without
    letters, and all texts if there is nothing to learn from, get ``und`` and
    score 0.  Score is how much fewer phrases the language needs than the next
    best, as a share of the latter's (1 if there is one language only); ties go
    to the language that sorts first.  Letters are those of the Unicode
    categories L*, with the marks M* that follow them.  Texts are parsed whole,
    very long ones in blocks whose phrases run over the cuts.  Rows that repeat
    get a row each; other columns are not read; an empty table gives no rows.
    Languages are as many as automata fit in a worker (about 15 MB each).
    """
    held_out = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
    sample = docs.sparkSession.sparkContext.broadcast(training_sample(docs, ~held_out, lang, text))

    fitted = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fitted not in _parsers:  # one parser for each worker process
            _parsers.clear()
            _parsers[fitted] = CrossParser(sample.value)
        parser = _parsers[fitted]
        for batch in batches:
            clean = [letters_of(t.as_py()) for t in batch.column(2)]
            found = parser.phrases(clean)
            langs, scores = [], []
            for t, row in zip(clean, found, strict=True):
                if not t or not len(row):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                ranked = np.sort(row)
                langs.append(parser.languages[int(row.argmin())])
                scores.append(1.0 if len(row) == 1 else float((ranked[1] - ranked[0]) / ranked[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("_text")).mapInArrow(run, SCHEMA)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return language_id(table(spark, sf_dir, "documents"))
