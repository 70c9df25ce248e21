"""The pipeline against a plain version without Spark, and on odd rows."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline

import plain


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def one_of_each(docs):
    sets, label = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old = label[a]
                label = [label[b] if x == old else x for x in label]
    least = {}
    for d, x in zip(docs, label, strict=True):
        least[x] = min(d["doc_id"], least.get(x, d["doc_id"]))
    return [d for d, x in zip(docs, label, strict=True) if d["doc_id"] == least[x]]


def windows(items):
    out = {}
    for text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        size = min(10, len(w))
        out.setdefault(size, set()).update(tuple(w[i : i + size]) for i in range(len(w) - size + 1) if size)
    return out


def is_clean(text, known):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return not any(tuple(w[i : i + size]) in found for size, found in known.items() if size for i in range(len(w) - size + 1))


def test_the_whole_pipeline(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = [r.asDict() for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()]
    items = [r["text"] for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()]
    counts = [plain.counts(d["text"]) for d in docs]
    good = plain.good_probability(Counter(map(plain.votes, counts)))
    docs = [d for d, c in zip(docs, counts, strict=True) if not plain.base_failed(c) and good[plain.votes(c)] >= 0.5]
    docs = one_of_each(docs)
    known = windows(items)
    docs = [d for d in docs if is_clean(d["text"], known)]
    want = {}
    for d in docs:
        text = plain.redacted(d["text"])
        want[d["doc_id"]] = (text, len(text), d["lang"], d["source"], library.encode(text), True)
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"], r["source"], r["token_ids"], r["decodes"]) for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert got == want and 0 < len(got) < 200


def test_stages_take_odd_rows(spark):
    clean = " ".join(f"Word{i}" for i in range(90)) + "."
    rows = [(1, clean, "en", "a", 1), (1, clean, "en", "a", 1), (2, clean + " more", None, None, None), (None, clean.lower() + " x", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, clean.replace("Word", "Other") + " token = abcdefgh", "en", "a", 3),
            (2, " ".join(f"long{i}" for i in range(60_000)), "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_blob": F.lit(1), "kept": F.lit("x"), "_spans": F.lit(2), "decoded": F.lit("own"), "text_key": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(DATA))
        assert docs.columns[: len(before)] == before, name
        assert stage(spark, docs.where("false"), str(DATA)).count() == 0
        docs = docs.checkpoint()
    found = docs.collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 1, 1, 2, 5] and {r["decoded"] for r in found} == {"own"}
    assert next(r["text"] for r in found if r["doc_id"] == 5).endswith("[assign]") and all(r["decodes"] for r in found)


def test_a_run_that_was_ended_goes_on(spark, tmp_path, monkeypatch):
    def killed(*_):
        raise RuntimeError("killed")

    stages = list(corpus_pipeline.STAGES)
    cut_short = [*stages[:2], ("benchmark_decontamination", killed)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", cut_short)
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(DATA), str(tmp_path / "run"))
    # The stages that were done are not called again.
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(stages[0][0], killed), (stages[1][0], killed), *stages[2:]])
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(DATA), str(tmp_path / "run")).collect()}
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert got == {r["doc_id"] for r in corpus_pipeline.run(spark, str(DATA)).collect()} and got
