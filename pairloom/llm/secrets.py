"""Secrets in documents, by an incremental ledger of blobs.

A text is a blob, addressed by the SHA-256 of its bytes; a document's versions
and copies are paths to blobs.  The ledger is a table of (blob, rules that have
gone over it, what they found).  A scan takes each blob of the input once, asks
the ledger which rule versions have not seen it, runs these alone, appends what
it found (also when that is nothing), and joins findings back to every path.
A second scan of the same texts therefore reads no text with any rule, and a
new version of one rule runs that rule alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import BROADCAST_ROWS, cut, shared_folder, table

Span = tuple[str, int, int]


def _assign(text: str) -> Iterator[tuple[int, int]]:
    if not _KEY.search(text):
        return
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield m.span()


#: Fixed by contract: the keys in either case (of ASCII letters), the separator and the value.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: What each of those has to have: the key's end and its separator.
_KEY = re.compile(r"""(?i:[dtny])["']?\x20*[:=]""", re.ASCII)
#: The greedy runs with 20 and 24 characters or more are the matches of the contract's patterns that do not fail.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")

#: Kind, version and finder, in the order in which spans with the same start are listed.
RULES = (
    ("assign", 1, _assign),
    ("access", 1, lambda t: (m.span() for m in _ACCESS.finditer(t)) if "AKIA" in t else ()),
    ("hex", 1, lambda t: (m.span() for m in _HEX.finditer(t))),
    ("pem", 1, lambda t: (m.span() for m in _PEM.finditer(t)) if "-----BEGIN" in t else ()),
    ("github", 1, lambda t: (m.span() for m in _GITHUB.finditer(t))),
)
BASE = ("assign", "access", "hex")
#: Characters of a blob's address that name its folder of the ledger, and blobs up to which they are named in a filter.
PREFIX, NAMED = 1, 1000
LEDGER = "blob string, rules array<string>, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def rule_names() -> list[str]:
    return [f"{kind}@{version}" for kind, version, _ in RULES]


def find(text: str, rules: set[str]) -> list[Span]:
    """Spans in code points, end exclusive, by start and then kind as listed in RULES."""
    found = [(start, order, kind, end) for order, (kind, version, finder) in enumerate(RULES) if f"{kind}@{version}" in rules for start, end in finder(text)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = batch.column(1).to_pylist()
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py(), set(r))] for t, r in zip(batch.column(2), rules, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rules, pa.list_(pa.string())), pa.array(spans, _SPANS)], ["blob", "rules", "spans"])


def _blob(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _ledger_rows(spark, ledger: str, blobs: DataFrame | None) -> DataFrame:
    """The ledger's rows for ``blobs`` (distinct), or all.

    Few blobs are named in the filter: their prefixes pick folders, and they
    themselves the parts of sorted files that are read, so what a small input
    costs doesn't grow with the ledger.  More of them meet the ledger in a semi-join.
    """
    rows = spark.read.schema(f"{LEDGER}, prefix string").parquet(ledger)
    if blobs is None:
        return rows
    few = [r["blob"] for r in blobs.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return rows.where(F.col("prefix").isin(*{b[:PREFIX] for b in few}) & F.col("blob").isin(*few)) if few else rows.limit(0)
    side = F.broadcast(blobs) if blobs.count() <= BROADCAST_ROWS // 4 else blobs
    return rows.join(side, "blob", "left_semi")


def update_ledger(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame | None:
    """Scan what the ledger at path ``ledger`` (made if it is not there) has not seen of the texts of ``docs``.

    Returns the blobs of ``docs``, or None if the ledger is new and so has no others.
    """
    spark = docs.sparkSession
    names = F.array(*map(F.lit, rule_names()))
    texts = docs.select(_blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blobs = None
    if _exists(spark, ledger):
        blobs = cut(texts.select("blob").distinct())
        seen = _ledger_rows(spark, ledger, blobs).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        rules = F.array_except(names, F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        due = cut(blobs.join(seen, "blob", "left").select("blob", rules.alias("rules")).where(F.size("rules") > 0))
        n = due.count()
        if not n:
            return blobs
        texts = texts.join(F.broadcast(due) if n <= BROADCAST_ROWS // 4 else due, "blob")
    else:
        texts = texts.withColumn("rules", names)
    unseen = texts.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("_text").alias("_text"))
    found = unseen.select("blob", "rules", "_text").mapInArrow(_scan, LEDGER).withColumn("prefix", F.substring("blob", 1, PREFIX))
    found.repartition("prefix").sortWithinPartitions("prefix", "blob").write.mode("append").partitionBy("prefix").parquet(ledger)
    return blobs


def known_spans(spark, ledger: str, blobs: DataFrame | None = None) -> DataFrame:
    """blob and spans that the present rule versions found, in order, for ``blobs`` (distinct), or every blob of the ledger."""
    present = F.array(*map(F.lit, rule_names()))
    known = _ledger_rows(spark, ledger, blobs).where(F.arrays_overlap("rules", present))
    # A row's spans are what its own rules found; those of rules that are no longer present are left out.
    kinds = F.transform(F.array_intersect("rules", present), lambda r: F.substring_index(r, "@", 1))
    known = known.withColumn("spans", F.filter("spans", lambda s: F.array_contains(kinds, s["kind"])))
    order = F.array(*[F.lit(k) for k, _, _ in RULES])
    # A blob has a row for each scan that brought it a new rule, so few.
    spans = known.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
    ranked = F.transform("all", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))
    return spans.select("blob", F.array_sort(ranked).alias("spans"))


def findings(docs: DataFrame, ledger: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, blob and spans of every row of ``docs``, of the present rule versions.

    Null counts as the empty text.  Rows that repeat, or share a text, each get
    its spans; spans with the same start are in the order of RULES; very long
    texts are scanned whole; keys may be null; other columns are not read; an
    empty table gives no rows.
    """
    blobs = update_ledger(docs, ledger, text)
    spans = cut(known_spans(docs.sparkSession, ledger, blobs))  # staged, so that the join can split a blob that many rows share
    return docs.select(F.col(key).alias("doc_id"), _blob(text).alias("blob")).join(spans, "blob", "left").select("doc_id", "blob", "spans")


def new_ledger(spark) -> str:
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def cover(text: str, spans: list[Span]) -> str:
    """The text with ``[kind]`` in place of each span; spans that overlap are replaced as one, by the first one's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """``docs`` with what the ledger's rules found replaced in the text; all other columns stay, a null text stays null.

    Only blobs with findings are joined back.  They are broadcast if they are
    few; else the texts are shuffled by blob.
    """
    blobs = update_ledger(docs, ledger, text)
    found = cut(known_spans(docs.sparkSession, ledger, blobs).where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")))

    @F.pandas_udf("string")
    def covered(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cover(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS // 20 else found
    columns = [covered(f"d.`{c}`", "f._spans").alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    return docs.alias("d").join(side.alias("f"), _blob(f"d.`{text}`") == F.col("f._blob"), "left").select(*columns)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents, from a new ledger."""
    return _digest(findings(table(spark, sf_dir, "documents"), new_ledger(spark)))


def secrets_second_scan(spark, sf_dir: str) -> DataFrame:
    """The same from a ledger that has seen the benchmark's texts, and then the documents: no text is scanned any more."""
    ledger, docs = new_ledger(spark), table(spark, sf_dir, "documents")
    update_ledger(table(spark, sf_dir, "benchmark"), ledger)
    update_ledger(docs, ledger)
    return _digest(findings(docs, ledger))


def _digest(found: DataFrame) -> DataFrame:
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _spans_sql(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    """Spans of one kind: matches are set between chr(1) and chr(2), which no text of the tables has, and counted off."""
    return f"""SELECT r, '{kind}' AS kind, {order} AS o, s, s + length(m) AS e FROM (
  SELECT r, split_part(p[i], chr(2), 1) AS m, (list_sum(list_transform(p[1:i - 1], lambda x: length(x))) - (i - 2))::BIGINT AS s
  FROM (SELECT r, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT r, string_split(regexp_replace(t, {pattern}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM d))) WHERE {keep}"""


_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token"))
_ASSIGN_SQL = f"""'(?:{_EITHER}|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
OP5_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
f AS ({_spans_sql("assign", 0, _ASSIGN_SQL, f"length(regexp_extract(m, {_ASSIGN_SQL}, 1)) >= 6")}
  UNION ALL {_spans_sql("access", 1, "'AKIA[A-Z0-9]+'", "length(m) >= 20")}
  UNION ALL {_spans_sql("hex", 2, "'[0-9a-f]+'", "length(m) >= 24")}
  UNION ALL {_spans_sql("pem", 3, "'-----BEGIN [A-Z ]*PRIVATE KEY-----'")}
  UNION ALL {_spans_sql("github", 4, "'gh[pousr]_[A-Za-z0-9]{36,}'")})
SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o IS NOT NULL), '') AS spans
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id
"""
