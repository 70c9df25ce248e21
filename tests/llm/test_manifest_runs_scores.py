"""Manifest, periodic runs and context trees against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import context_tree, merkle, periodic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, item long"
LONG = "lorem ipsum dolor sit amet " * 8000
DOCS = [
    (1, "the cat\nsat on the mat", "en", "a", 5, "x", 1),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", 1),
    (3, "", "en", "a", 0, "y", 2),
    (None, "the cat sat\n\n on the mat", "fr", None, 5, "x", 1),
    (5, LONG, "de", "b", 1, "x", 1),
    (6, " \t\n\x0b ", "de", "\U0001f389", 1, "x", 1),
    (8, "日本語 の é x\x00y A\x85b", "en", "￿", 1, "x", 1),
    (9, "one two one two one two one two one two x x x x x x y", "en", "", 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


# Manifest


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text) -> str:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _digest(*(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def _levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_manifest(rows, changed) -> list[tuple]:
    by_source: dict = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[1]), _leaf(row, changed(row)), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for rank, (_, _, leaf, now, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            node, proof = now, ""
            for levels, place in ((trees[s], rank), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 3 * 3 : place // 3 * 3 + 3]
                    before, after = run[: place % 3], run[place % 3 + 1 :]
                    node, proof, place = _digest(*before, node, *after), proof + "".join(before + after), place // 3
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], _digest(proof), node, node == top[-1][0]))
    return sorted(out, key=repr)


def _verified(docs) -> list[tuple]:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = merkle.verify(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def _tampered(row):
    tampers = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
    return row[1].replace("\n", "") if row[1] is not None and tampers else row[1]


def test_manifest_on_odd_rows(docs):
    assert _verified(docs) == plain_manifest(DOCS, _tampered)


@pytest.mark.parametrize("n", [1, 3, 4, 81, 82, 700])
def test_manifest_of_sizes(spark, n):
    rng = random.Random(n)
    sources = [None, "a", "b", "é"] if n > 3 else ["a"]
    # Two thirds of the rows are in one source.
    rows = [(i, rng.choice(["a\nb", "c", None]), "en", "hot" if rng.random() < 0.66 else rng.choice(sources), i % 7) for i in rng.sample(range(5 * n), n)]
    found = _verified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert found == plain_manifest(rows, _tampered)


def test_some_requests_and_lost_leaves(spark, docs):
    even = merkle.ranked(docs.select(merkle.tree_of("source").alias("tree"), "doc_id", F.sha2("source", 256).alias("digest")).where("source = 'a'"), "doc_id", "digest")
    store = merkle.manifest(even)
    asked = spark.createDataFrame([("+a", 1, "second"), ("+a", 99, "none"), ("+zz", 0, "none")], "tree string, rank long, name string")
    found = merkle.prove(store, asked).collect()
    assert [(r["name"], r["rank"]) for r in found if r["digest"]] == [("second", 1)]
    assert merkle.prove(store, asked.limit(0)).count() == 0


def test_manifest_of_nothing(docs):
    assert merkle.verify(docs.limit(0)).count() == 0
    with_none = merkle.verify(docs.where("doc_id = 1"))
    assert with_none.select("verified", "subroot", "leaf").first()[:2] == (True, with_none.first()["leaf"])


# Periodic runs


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            begin = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - begin + q
            smaller = any(all(words[x] == words[x + p] for x in range(begin, begin + length - p)) for p in range(1, q))
            if i > begin and length >= max(6, 4 * q) and not smaller:
                out.append((begin, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        documents = []
        for _ in range(rng.randint(1, 5)):
            n, letters = rng.randint(0, 110), rng.choice([1, 2, 3, 20])
            words = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                begin = rng.randrange(n)
                period, end = rng.randint(1, max(1, (n - begin) // 3)), rng.randint(begin, n)
                for x in range(begin + period, end):
                    words[x] = words[x - period]
            documents.append(words)
        found = periodic.find_runs([np.array(d, np.int64) for d in documents])
        assert found == [plain_runs(d) for d in documents]


def test_bands_cover_every_lag():
    lags = [q for a, b, k in periodic.bands(4000) for q in range(a, b + 1)]
    assert lags[:1000] == list(range(1, 1001))
    assert all(k <= max(6 - q, 3 * q) and 2 * q - 1 <= k for a, b, k in periodic.bands(4000) for q in range(a, b + 1))


def test_runs_on_odd_rows(docs, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS", 10)
    found = {(r["doc_id"], r["n_words"]): r for r in periodic.periodic_runs(docs, texts=True).collect()}
    assert len(found) == len(DOCS) - 1  # one row is repeated
    for doc_id, text, *_ in DOCS:
        words = text.encode().split() if text else []
        row = found[doc_id, len(words)]
        runs = [(r["start"], r["length"], r["period"]) for r in row["runs"]]
        assert runs == ([(0, 40000, 5)] if doc_id == 5 else plain_runs(words))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_planted_runs_of_documents(spark):
    rows = periodic.op12_periodic(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for row in rows:
        words = periodic.planted(docs[row["doc_id"]], row["doc_id"])
        if len(words) > 500:
            continue
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


# Context trees


class PlainTree:
    """Counts of every context and bit prefix, and what follows from them, node by node."""

    def __init__(self, texts: list[list[bytes]], depth: int) -> None:
        self.depth, self.counts, kids = depth, {}, {}
        for words in texts:
            s = context_tree.END * depth + context_tree.stream_of(words)
            for i in range(depth, len(s)):
                bits = 1
                for j in range(7, -1, -1):
                    for d in range(depth + 1):
                        self.counts.setdefault((s[i - d : i], bits), [0, 0])[s[i] >> j & 1] += 1
                    bits = bits * 2 + (s[i] >> j & 1)
        for context, bits in self.counts:
            if context:
                kids.setdefault((context[1:], bits), []).append((context, bits))
        own = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in self.counts.items()}
        whole, self.stays = {}, {}
        for k in sorted(self.counts, key=lambda k: -len(k[0])):
            if len(k[0]) == depth:
                whole[k], self.stays[k] = own[k], 1.0
                continue
            deeper = sum(whole[x] for x in kids[k])
            whole[k] = float(np.logaddexp(own[k], deeper)) - math.log(2)
            self.stays[k] = math.exp(own[k] - math.log(2) - whole[k])

    def log10p(self, context: bytes, symbol: int) -> float:
        total, bits = 0.0, 1
        for j in range(7, -1, -1):
            bit, rest, p = symbol >> j & 1, 1.0, 0.0
            for d in range(self.depth + 1):
                k = (context[self.depth - d :], bits)
                if k not in self.counts:
                    p += rest / 2
                    break
                n = self.counts[k]
                p += rest * self.stays[k] * (n[bit] + 0.5) / (sum(n) + 1)
                rest *= 1 - self.stays[k]
            total, bits = total + math.log10(p), bits * 2 + bit
        return total


def test_scores_of_odd_rows(docs, spark, monkeypatch):
    monkeypatch.setattr(context_tree, "SPAN", 700)  # long texts and tables come in several parts
    rows = [r if r[0] != 5 else (5, LONG[:3000], *r[2:]) for r in DOCS]
    held = lambda doc_id: doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
    table = spark.createDataFrame([*rows, (21, "one two never seen", "en", "a", 1, "x", 1)], SCHEMA)
    found = context_tree.score_texts(table, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    words = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in table.collect()]
    train = [w for k, w in words if not held(k)]
    assert len(found) == len(words) and 0 < len(train) < len(words)
    tree, depth = PlainTree(train, context_tree.DEPTH), context_tree.DEPTH
    counts: dict = {None: len(train)}
    for row in train:
        for w in row:
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values())
    want = []
    for k, row in words:
        s = context_tree.END * depth + context_tree.stream_of(row)
        c = [counts.get(w, 0) for w in [*row, None]]
        base = sum(math.log10((x + 1) / (n + len(counts) + 1)) for x in c)
        want.append((k, held(k), len(c), sum(x > 0 for x in c), n, base, sum(tree.log10p(s[i - depth : i], s[i]) for i in range(depth, len(s)))))
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted((tuple(r)[:7] for r in found), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-8)
    assert all(r["bits_per_byte"] > 0 for r in found)


def test_probabilities_of_all_bytes_add_up(spark):
    grams = spark.createDataFrame([(int.from_bytes(b"\nabab" + bytes([x]), "big"), 5 if x == 97 else 0) for x in range(256)], "gram long, seen long")
    found = [r["log10p"] for r in context_tree.gram_scores(grams).collect()]
    assert len(found) == 256 and sum(10**x for x in found) == pytest.approx(1, rel=1e-9)


def test_scores_without_training_or_rows(docs):
    alone = context_tree.score_texts(docs.where("doc_id = 9"), F.lit(True)).first()
    assert (alone["n_known"], alone["train_tokens"], alone["base_score"]) == (0, 0, 0.0) and alone["bits_per_byte"] == pytest.approx(8)
    assert context_tree.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_gram_table():
    rng = np.random.default_rng(3)
    table, known = context_tree.GramTable(8), {}
    for _ in range(40):
        new = np.setdiff1d(rng.integers(0, 1 << 48, 50), table.grams)
        table.add(new)
        known |= {int(g): len(known) + i for i, g in enumerate(new)}
        asked = np.concatenate([rng.choice(table.grams, 30), rng.integers(1 << 48, 1 << 49, 10)])
        assert table.find(asked).tolist() == [known.get(int(g), -1) for g in asked]


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rows = context_tree.op11_context_tree(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 1.05 * rows[1]
