"""Whole queries against plain versions, and what a small input costs."""

from __future__ import annotations

import re
from collections import Counter

import plain
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pairloom.llm import decontaminate as dec
from pairloom.llm import langid, quality
from pairloom.llm import secrets as ledger_of


def test_the_whole_quality_query(spark):
    rows = quality.quality(spark.read.parquet(str(DATA / "documents.parquet"))).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    counts = {k: plain.counts(t) for k, t in texts.items()}
    good = plain.good_probability(Counter(plain.votes(c) for c in counts.values()))
    assert len(rows) == len(texts)
    for r in rows:
        c = counts[r["doc_id"]]
        assert all(r[name] == c[name] for name in quality.COUNTS) and r["base_failed"] == plain.base_failed(c)
        assert r["probability"] == pytest.approx(good[plain.votes(c)], abs=1e-6)
        assert r["kept"] == (not plain.base_failed(c) and good[plain.votes(c)] >= 0.5)


def test_a_small_scan_names_its_blobs(spark, tmp_path, monkeypatch):
    ledger = str(tmp_path / "ledger")
    many = spark.range(300).select(F.concat(F.lit("token = abcdef"), F.col("id").cast("string")).alias("text"))
    ledger_of.update_ledger(many, ledger)
    one = many.limit(1)
    blobs = one.select(F.sha2("text", 256).alias("blob"))
    plan = ledger_of.known_spans(spark, ledger, blobs)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix", plan) and re.search(r"PushedFilters: \[[^\]]*blob", plan)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = ledger_of._ledger_rows(spark, ledger, blobs)
        assert len(read.collect()) == 1
        scan = read._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
        assert scan.apply("numFiles").value() == 1 < 16 == len(spark.read.parquet(ledger).inputFiles())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for named in (ledger_of.NAMED, 0):  # by name, and by semi-join
        monkeypatch.setattr(ledger_of, "NAMED", named)
        assert ledger_of.known_spans(spark, ledger, blobs).count() == 1
        found = ledger_of.findings(one.select(F.lit(1).alias("doc_id"), "text"), ledger).collect()
        assert len(found) == 1 and len(found[0]["spans"]) == 1 and spark.read.parquet(ledger).count() == 300


def test_items_without_words_count_too(spark):
    bench = spark.createDataFrame([(str(i), "?" * 1000) for i in range(50)], "item_id string, text string")
    assert dec.fits(bench, "text", 60_000) and not dec.fits(bench, "text", 50_000)


def test_only_likely_windows_are_joined(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(50)] + [(99, "a b c d e f g h i j k l")], "doc_id long, _text string")
    bench = spark.createDataFrame([("q", "b c d e f g h i j k")], "item_id string, text string")
    tagged = docs.select("doc_id", F.unhex(F.md5("_text")).alias("t"), "_text")
    found = dec._joined_hits(tagged, bench, "item_id", "text").collect()
    assert [(r["doc_id"], r["item"], r["at"], r["size"]) for r in found] == [(99, "q", 1, 10)]
    known = dec._bit_map(spark.createDataFrame([(5,), (5,), (40_000,), (262_143,)], "bit long"), 1 << 18)
    assert {i * 8 + b for i in range(len(known)) for b in range(8) if known[i] >> b & 1} == {5, 40_000, 262_143}


def test_long_texts_are_learnt_from_like_short_ones(spark):
    rows = spark.createDataFrame([(i, ("abc " if i % 2 else "xyz ") * (10 if i % 2 else 5000), "en") for i in range(40)], "doc_id long, text string, lang string")
    sample = langid.training_sample(rows, F.lit(True))["en"]
    assert any(t.startswith("abc") for t in sample) and any("xyz" in t for t in sample) and max(map(len, sample)) <= langid.PIECE
