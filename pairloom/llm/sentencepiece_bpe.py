"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A BPE vocabulary gives every prefix of a text one last token: the token t whose
own merges, next to the last token of what precedes t, are exactly the merges
that the text would make.  So a table of last tokens is filled from left to
right: an automaton lists the tokens that end at each place, and the first one
that is compatible with the last token before it is stored.  The ids are then
read backwards through the table.

Compatibility of two neighbours is decided by undoing their merges from the
latest back: if at any time the two inner halves would have been joined by an
earlier merge than those still standing, the pair can't occur.

No piece of the vocabulary has a space mark after another character, and
characters that occur in no longer piece never merge, so a text falls apart
into chunks whose ids don't depend on each other; chunks repeat, and their ids
are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import table

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Decoder:
    """The pieces of a model, and the text of ids."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        self.plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.special = set(range(size)) - set(self.plain) - set(self.bytes_of)
        shown = [p.replace(SPACE, " ") for p in self.pieces]
        self.raw = [b"" if i in self.special else bytes([self.bytes_of[i]]) if i in self.bytes_of else p.encode() for i, p in enumerate(shown)]
        self.score = {i: model.get_score(i) for i in self.plain}

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; a mark at the very beginning is dropped, bytes that are no UTF-8 become U+FFFD."""
        lead = 0
        while first and lead < len(ids) and ids[lead] in self.special:
            lead += 1
        ids = ids[lead:] if lead else ids
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_broken(ids, first)
        return text[1:] if first and len(ids) and self.pieces[ids[0]][0] == SPACE and ids[0] not in self.special else text

    def _decode_broken(self, ids: list[int], first: bool) -> str:
        out, held = [], bytearray()
        for k, i in enumerate(ids):
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                continue
            if held:
                out.append(_text_of(held))
                held = bytearray()
            if i not in self.special:
                p = self.pieces[i]
                out.append((p[1:] if first and k == 0 and p[0] == SPACE else p).replace(SPACE, " "))
        return "".join(out) + (_text_of(held) if held else "")


class PieceBpe(Decoder):
    """A sentencepiece model of type BPE with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model_file: str, most_chunks: int = 200_000, most_pairs: int = 300_000) -> None:
        super().__init__(model_file)
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        plain = self.plain
        self.rank = {self.pieces[i]: (-self.score[i], i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) or (p[0] == SPACE and p[1:2] == SPACE and p.strip(SPACE)) for p in self.rank):
            raise ValueError("a piece has a space mark after another character, or two before a word")
        ranks = [r for p, (r, _) in self.rank.items() if p.strip(SPACE) and len(p) > 1]
        if len(set(ranks)) < len(ranks):
            raise ValueError("two pieces have the same score")
        self._build(most_chunks, most_pairs)

    def _build(self, most_chunks: int, most_pairs: int) -> None:
        letters = {c for p in self.rank if len(p) > 1 for c in p} - {SPACE}
        # Tokens are numbered by rank of merge, single characters first; halves[t] are the two tokens merged into t.
        self.text = sorted(letters | {SPACE})
        self.number = {c: i for i, c in enumerate(self.text)}
        self.halves = [(i, i) for i in range(len(self.text))]
        self.joined: dict[tuple[int, int], int] = {}
        words = sorted((p for p in self.rank if len(p) > 1 and p.strip(SPACE)), key=lambda p: self.rank[p])
        for p in words:
            parts = self._merge(list(p), self.number)
            if len(parts) == 2:  # else no merges lead to this piece
                pair = (self.number[parts[0]], self.number[parts[1]])
                self.number[p] = self.joined[pair] = len(self.text)
                self.text.append(p)
                self.halves.append(pair)
        self.automaton = ahocorasick.Automaton()
        for p, t in self.number.items():
            self.automaton.add_word(p, t)
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.text]
        self.id_of = [self.ids.get(p) for p in self.text]
        inner = "".join(map(re.escape, sorted(letters)))
        self.chunks = re.compile(f"{SPACE}+[{inner}]*|[{inner}]+|.", re.DOTALL)
        self.compatible_pairs: dict[int, bool] = {}
        self.most_pairs = most_pairs
        self.known = Chunks(self, most_chunks)

    @staticmethod
    def _merge(parts: list[str], number: dict[str, int]) -> list[str]:
        """Merges of a short string by rank among the tokens numbered so far."""
        while len(parts) > 1:
            best = min(((number[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in number), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether tokens ``left`` and ``right`` can stand side by side."""
        key = left << 32 | right
        known = self.compatible_pairs.get(key)
        if known is None:
            if len(self.compatible_pairs) >= self.most_pairs:
                self.compatible_pairs.clear()
            known = self.compatible_pairs[key] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        singles = self._singles
        before = len(self.text)  # merges of the border pair numbered below this would have come first
        while True:
            if self.joined.get((left, right), before) < before:
                return False
            # The later of the two last merges is undone; of equal merges the right one is later.
            if left > right and left >= singles:
                before, left = left, self.halves[left][1]
            elif right >= singles:
                before, right = right + 1, self.halves[right][0]
            elif left >= singles:
                before, left = left, self.halves[left][1]
            else:
                return self.joined.get((left, right), before) >= before

    @property
    def _singles(self) -> int:
        return len(self.text) - len(self.joined)

    def last_tokens(self, chunk: str) -> list[int]:
        """Tokens of a chunk of mergeable characters, by the prefix table."""
        n = len(chunk)
        last = [-1] * (n + 1)  # by place, the last token of the prefix that ends there
        lengths, fits = self.lengths, self.compatible_pairs
        for end, token in self.automaton.iter(chunk):
            if last[end + 1] >= 0:
                continue
            begin = end + 1 - lengths[token]
            if begin == 0:
                last[end + 1] = token
            else:
                left = last[begin]
                known = fits.get(left << 32 | token)
                if self.compatible(left, token) if known is None else known:
                    last[end + 1] = token
        out, at = [], n
        while at:
            out.append(last[at])
            at -= lengths[last[at]]
        out.reverse()
        return out

    def spaces(self, n: int) -> list[str]:
        """Pieces of n space marks in a row.  Their scores may be equal, and then the leftmost pair merges first."""
        parts: list[str | None] = [SPACE] * n
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and (whole := parts[i] + parts[j]) in self.rank:
                heapq.heappush(heap, (self.rank[whole][0], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            nxt[j] = -1
            offer(prv[i])
            offer(i)
        return [p for p in parts if p]

    def encode_chunk(self, chunk: str) -> list[int]:
        word = chunk.lstrip(SPACE)
        marks = len(chunk) - len(word)
        out: list[str] = []
        if marks <= 1 and word and word[0] in self.number:
            ids = [self.id_of[t] for t in self.last_tokens(chunk)]
            if None not in ids:
                return ids
        if word and word[0] in self.number:
            tokens = [self.text[t] for t in self.last_tokens(SPACE * bool(marks) + word)]
            if marks and tokens[0] != SPACE:
                marks -= 1
            elif marks:
                tokens = tokens[1:]
            out = [*self.spaces(marks), *tokens]
        else:
            out = [*self.spaces(marks), *word]
        ids = []
        for p in out:
            i = self.ids.get(p)
            ids += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8")]
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for c in self.split(text) for i in self.encode_chunk(c)]

    def split(self, text: str) -> list[str]:
        """The chunks of the normalised text: a space mark in front, and in place of each space."""
        return self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _text_of(held: bytearray) -> str:
    """Each byte that begins no whole character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(held[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Chunks(dict):
    """Chunk to (number of ids, ids as text, decoded text), in two generations.

    When the young one holds ``most`` chunks it becomes the old one; what is
    asked for again comes back from there, so frequent chunks stay.
    """

    def __init__(self, model: PieceBpe, most: int) -> None:
        super().__init__()
        self.model, self.most, self.old = model, most, {}

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        value = self.old.get(chunk) or self._work_out(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def _work_out(self, chunk: str) -> tuple[int, str, str]:
        model = self.model
        ids = model.encode_chunk(chunk)
        return len(ids), ",".join(map(str, ids)), model.decode(ids, first=False)


#: A model's file, or a function that finds it where it is called, so that workers look in their own file system.
ModelFile = str | Callable[[], str]
_models: dict[str, PieceBpe] = {}


def file_of(model_file: ModelFile) -> str:
    return model_file if isinstance(model_file, str) else model_file()


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_of(model_file: ModelFile) -> PieceBpe:
    """One model for each worker process."""
    path = file_of(model_file)
    if path not in _models:
        _models[path] = PieceBpe(path)
    return _models[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def round_trip(model: PieceBpe, text: str) -> tuple[int, str, str]:
    """Number of ids, ids as text, and the text that they decode to."""
    found = [model.known[c] for c in model.split(text)]
    decoded = "".join([f[2] for f in found])
    return sum([f[0] for f in found]), ",".join([f[1] for f in found]), decoded[1:] if found else ""


def piece_digests(docs: DataFrame, model_file: ModelFile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, of every whole text.

    Null counts as empty: no ids, empty digests.  Keys may be null and rows may
    repeat; very long texts are encoded whole, chunk by chunk; other columns are
    not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in batches:
            rows = [(n, _sha(i), _sha(d)) for n, i, d in (round_trip(model, t.as_py() or "") for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.string()), pa.array([d for _, _, d in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, SCHEMA)


def encode_column(docs: DataFrame, model_file: ModelFile, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text in a further column ``into`` (replaced if it is there); null and empty texts give none."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = PieceBpe(file_of(model_file), most_chunks=60_000)  # one a task: the worker may go on with other stages
        for texts in batches:
            yield pd.Series([np.fromstring(round_trip(model, t)[1], np.int32, sep=",") if t else np.empty(0, np.int32) for t in texts])

    return docs.withColumn(into, ids(text))


def decode_column(docs: DataFrame, model_file: ModelFile, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in a further column ``into``; null gives the empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Decoder(file_of(model_file))
        for rows in batches:
            yield pd.Series([model.decode(r.tolist()) if r is not None else "" for r in rows], dtype=object)

    return docs.withColumn(into, text(ids))


def round_trip_columns(docs: DataFrame, model_file: ModelFile, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and the text that these ids give, in one pass, so with one worker and one model a core.

    Null and empty texts have no ids and give the empty text; columns of these names are replaced.
    """

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = PieceBpe(file_of(model_file), most_chunks=30_000, most_pairs=150_000)  # one a task: the worker may go on with other stages
        for texts in batches:
            found = [np.fromstring(round_trip(model, t)[1], np.int32, sep=",") if t else np.empty(0, np.int32) for t in texts]
            yield pd.DataFrame({"ids": found, "decoded": [model.decode(i.tolist()) for i in found]})

    pair = f"_pair_{uuid.uuid4().hex}"
    rows = docs.withColumn(pair, both(text))
    return rows.withColumns({ids: F.col(f"{pair}.ids"), decoded: F.col(f"{pair}.decoded")}).drop(pair)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents."""
    return piece_digests(table(spark, sf_dir, "documents"), public_model)
