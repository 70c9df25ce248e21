"""A Merkle manifest of a table: content-addressed pages of digests, and proofs by descending them.

Rows are the leaves of a tree for each group, in order; every three consecutive
nodes become their parent, until one is left, the group's root; the roots of
the groups are the leaves of one more tree, whose root stands for the table.

The store holds pages.  A page is the part of a tree under one node, up to four
levels deep: records that lead from a digest to its children's digests.  It is
looked up by the digest of its top node.  A request names a leaf by tree and
rank.  Requests descend together: each page that one of them needs is read
once, the digits of the rank to base three pick the child at each level, and the
children not picked are kept.  A page's part of the path is reversed and put
before the part above it, so that a path leads from the leaf to the root.

Ranks, pages and descents are all keyed by tree and rank, and a page has at
most 81 leaves, so a group with most of the rows is many pages like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.shared import BROADCAST_ROWS, cut, table

FAN = 3
#: Levels and leaves of a page.
HEIGHT = 4
PAGE = FAN**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest_of(*values: Column) -> Column:
    """SHA-256 in hex of the values one after another: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def tree_of(group: str) -> Column:
    """A group as a text that is never null and sorts as the group does, null first."""
    return F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column tree) with their rank in their tree, from 0, and n, the rows of the tree.

    Rows are dealt out by ranges of tree and order; a row's number within its
    range, less that of the first row of its tree there, is added to the tree's
    rows in earlier ranges.
    """
    keys = ["tree", *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    totals = placed.groupBy("_range", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        totals.select(
            "_range",
            "tree",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
            F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
        )
    )
    side = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    return placed.join(side, ["_range", "tree"]).withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_range", "_offset")


def _runs(level: Column) -> Column:
    """The nodes of a level in runs of three, the last one of what is left."""
    last = F.floor((F.size(level) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(level, i * FAN + 1, FAN))


def _records(digests: Column, children: Column) -> Column:
    return F.transform(digests, lambda d, i: F.struct(d.alias("digest"), children[i].alias("children")))


def _pages(nodes: DataFrame) -> DataFrame:
    """The pages over ``nodes`` (tree, rank, digest, n): tree, page, n of the next round, digest, height and records."""
    many = lambda level: F.ceil(F.col("n") / FAN**level) > 1  # noqa: E731  # nodes of the whole tree at that level
    pages = (
        nodes.groupBy("tree", F.expr(f"rank div {PAGE}").alias("page"), "n")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("_leaves"))
        .withColumn("_0", F.col("_leaves.digest"))
    )
    for level in range(HEIGHT):
        pages = pages.withColumn(f"_r{level}", _runs(F.col(f"_{level}"))).withColumn(
            f"_{level + 1}",
            F.when(many(level), F.transform(F.col(f"_r{level}"), lambda c: F.sha2(F.array_join(c, ""), 256))).otherwise(F.col(f"_{level}")),
        )
    none = F.array().cast("array<struct<digest:string,children:array<string>>>")
    records = F.flatten(F.array(*[F.when(many(x), _records(F.col(f"_{x + 1}"), F.col(f"_r{x}"))).otherwise(none) for x in range(HEIGHT)]))
    height = reduce(lambda a, b: a + b, [many(level).cast("int") for level in range(HEIGHT)])
    return pages.select(
        "tree",
        "page",
        F.ceil(F.col("n") / PAGE).alias("n"),
        F.col(f"_{HEIGHT}")[0].alias("digest"),
        height.alias("height"),
        F.array_distinct(records).alias("records"),
    )


def _forest(leaves: DataFrame) -> list[DataFrame]:
    """Pages of all trees over ``leaves`` (tree, rank, digest, n), by round; in the last round of a tree n is 1."""
    nodes, rounds = leaves.select("tree", "rank", "digest", "n"), []
    left = nodes.agg(F.max("n")).first()[0] or 0
    while left:
        rounds.append(cut(_pages(nodes)))
        nodes = rounds[-1].where("n > 1").select("tree", F.col("page").alias("rank"), "digest", "n")
        left = 0 if left <= PAGE else -(-left // PAGE)
    return rounds


@dataclass(frozen=True)
class Manifest:
    """Pages of the groups' trees and of the tree above them, by round, and the digest of the whole table (None: no rows)."""

    root: str | None
    trees: list[DataFrame]
    top: list[DataFrame]


def _roots(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.where("n = 1").select("tree", "digest") for p in rounds])


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest over ``leaves``: tree, rank (gapless from 0), digest, n.  Equal leaves are leaves of their own."""
    trees = _forest(leaves)
    if not trees:
        return Manifest(None, [], [])
    heads = ranked(_roots(trees).select(F.lit("").alias("tree"), F.col("tree").alias("_of"), "digest"), "_of")
    top = _forest(heads)
    return Manifest(top[-1].where("n = 1").first()["digest"], trees, top)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _descend(records: Column, digest: Column, height: Column, slot: Column) -> Column:
    """The digest of the page's leaf ``slot`` and the path from it to the page's top."""

    def step(state: Column, level: Column) -> Column:
        digit = F.floor(slot / F.pow(F.lit(float(FAN)), level - 1)).cast("int") % FAN
        return _let(
            F.filter(records, lambda r: r["digest"] == state["digest"])[0]["children"],
            lambda kids: F.struct(
                kids[digit].alias("digest"),
                F.concat(
                    F.array(
                        F.struct(
                            F.array_join(F.slice(kids, F.lit(1), digit), "").alias("before"),
                            F.array_join(F.slice(kids, digit + 2, F.lit(FAN)), "").alias("after"),
                        )
                    ),
                    state["path"],
                ).alias("path"),
            ).cast(f"struct<digest:string,path:{PATH}>"),
        )

    levels = F.filter(F.array(*[F.lit(x) for x in range(HEIGHT, 0, -1)]), lambda x: x <= height)
    start = F.struct(digest.alias("digest"), F.array().cast(PATH).alias("path")).cast(f"struct<digest:string,path:{PATH}>")
    return F.aggregate(levels, start, step)


def _proved(rounds: list[DataFrame], requests: DataFrame, starts: DataFrame) -> DataFrame:
    """``requests`` (tree, rank, others) with digest, path and the columns of ``starts`` (tree, digest, path, others) but digest.

    ``starts`` has the roots from which to descend, with the path above them.
    """
    mine = [c for c in requests.columns if c not in ("tree", "rank")]
    kept = [c for c in starts.columns if c not in ("tree", "digest")]
    wanted = [requests.select("tree", "rank", F.struct(*[F.col(c) for c in mine]).alias("of") if mine else F.lit(None).alias("of"))]
    for _ in rounds[1:]:
        up = wanted[-1].select("tree", F.expr(f"rank div {PAGE}").alias("rank")).distinct()
        wanted.append(up.withColumn("of", F.lit(None)))
    at = None
    for number in reversed(range(len(rounds))):
        heads = rounds[number].where("n = 1").select("tree", F.col("page").alias("rank")).join(starts, "tree")
        at = heads if at is None else at.unionByName(heads)
        asked = wanted[number].groupBy("tree", F.expr(f"rank div {PAGE}").alias("page")).agg(F.collect_list(F.struct("rank", "of")).alias("asked"))
        store = rounds[number].dropDuplicates(["digest"]).select("digest", "height", "records")
        found = (
            at.withColumnRenamed("rank", "page")
            .join(asked, ["tree", "page"])
            .join(store, "digest")
            .withColumn("a", F.explode("asked"))
            .withColumn("hit", _descend(F.col("records"), F.col("digest"), F.col("height"), F.col("a.rank") % PAGE))
        )
        rest = [F.col(c) for c in kept if c != "path"]
        path = F.concat("hit.path", "path").alias("path")
        if number:
            # Only the roots of pages further down; kept once, as two joins begin from them.
            at = cut(found.select("tree", F.col("a.rank").alias("rank"), F.col("hit.digest").alias("digest"), path, *rest))
        else:
            at = found.select("tree", F.col("a.rank").alias("rank"), *[F.col(f"a.of.{c}").alias(c) for c in mine], F.col("hit.digest").alias("digest"), path, *rest)
    return at


def prove(store: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, rank, others) with the leaf's digest, its path to the root of the table and subroot, its tree's root.

    A path has for each level the digests before and after the node among its
    parent's children, joined.  A request for a leaf that isn't there gives no row.
    """
    heads = _roots(store.trees).withColumn("of", F.col("tree"))
    places = ranked(heads.select(F.lit("").alias("tree"), "of", F.col("digest").alias("subroot")), "of").drop("n")
    above = store.top[-1].where("n = 1").select("tree", "digest", F.array().cast(PATH).alias("path"))
    starts = cut(_proved(store.top, places, above).select(F.col("of").alias("tree"), "digest", "path", "subroot"))
    return _proved(store.trees, requests, starts)


def fold(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def verify(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """A manifest of ``docs`` by ``group`` in order of ``key``, and the proof of every row against it.

    Columns: key, leaf, subroot, root, proof_sha256, folded_root, verified.  A
    row's leaf is the digest of ``columns``; ``changed``, if given, is the text
    that is found in place of the row's own when it is verified.  Only digests
    leave the scan.  Rows that repeat a key are ordered by leaf, null keys come
    first, and equal rows are leaves of their own with proofs of their own.
    Nulls in any column, empty and very long texts are hashed as they are.
    Columns that are not named take no part.  An empty table gives no rows.
    """
    own = [F.col(c) for c in columns]
    found = [changed if c == text else F.col(c) for c in columns]
    thin = docs.select(
        tree_of(group).alias("tree"),
        F.col(key).alias("key"),
        digest_of(*own).alias("digest"),
        (F.when(F.col(text).eqNullSafe(changed), F.lit(None)).otherwise(digest_of(*found)) if changed is not None else F.lit(None).cast("string")).alias("now"),
    )
    leaves = cut(ranked(thin, "key", "digest"))
    store = manifest(leaves)
    if store.root is None:
        return leaves.selectExpr(
            f"key AS `{key}`", "digest AS leaf", "digest AS subroot", "digest AS root", "digest AS proof_sha256", "digest AS folded_root", "true AS verified"
        )
    proofs = prove(store, leaves.select("tree", "rank", "key", "now"))
    return proofs.select(
        F.col("key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(store.root).alias("root"),
        siblings_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("path"), F.coalesce("now", "digest")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """All documents' proofs, those with an even checksum of their id verified without their line ends."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return verify(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


#: CRC-32 of the ids is worked out as in the SQL of the shards; levels and folds are recursive.
OP13_SQL = """
WITH RECURSIVE t(r, i, c) AS (
    SELECT 0, i, i::BIGINT FROM range(256) x(i)
    UNION ALL
    SELECT r + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE r < 8
), crc(v) AS (SELECT list(c ORDER BY i) FROM t WHERE r = 8),
d AS (
    SELECT doc_id, source, lang, n_chars, text,
           xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) % 2 = 0 AS even
    FROM documents, crc
), h AS (
    SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
           CASE WHEN even THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) ELSE leaf END AS now
    FROM (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                 || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head FROM d)
), l AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM h
), s(source, level, nodes) AS (
    SELECT source, 0, list(leaf ORDER BY rank) FROM l GROUP BY source
    UNION ALL
    SELECT source, level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM s WHERE len(nodes) > 1
), sub AS (
    SELECT source, nodes[1] AS subroot, level AS levels, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place FROM s WHERE len(nodes) = 1
), u(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY place) FROM sub
    UNION ALL
    SELECT level + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) FROM u WHERE len(nodes) > 1
), f(doc_id, leaf, subroot, source, levels, place, rank, level, node, proof) AS (
    SELECT doc_id, leaf, subroot, sub.source, levels, place, rank, 0, now, '' FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source
    UNION ALL
    SELECT doc_id, leaf, subroot, source, levels, place, rank, level + 1, sha256(pre || node || post), proof || pre || post
    FROM (
        SELECT f.*, array_to_string(nodes[pos // 3 * 3 + 1:pos], '') AS pre, array_to_string(nodes[pos + 2:pos // 3 * 3 + 3], '') AS post
        FROM (SELECT *, CASE WHEN level < levels THEN rank // (3 ** level)::BIGINT ELSE place // (3 ** (level - levels))::BIGINT END AS pos FROM f) f
        JOIN (SELECT source, level, nodes, false AS above FROM s WHERE len(nodes) > 1 UNION ALL SELECT sub.source, levels + u.level, nodes, true FROM u, sub WHERE len(nodes) > 1) n
          ON n.level = f.level AND n.source IS NOT DISTINCT FROM f.source AND n.above = (f.level >= f.levels)
    )
), ends AS (SELECT source, levels + (SELECT max(level) FROM u) AS top FROM sub)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS verified
FROM f JOIN ends ON f.source IS NOT DISTINCT FROM ends.source AND level = top
"""
