"""Near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets.

1. Each text becomes its set of five-word shingles, 128 minima of that set, 32
   band keys of 4 minima each, and the minima's low 4 bits packed in 8 longs.
   Texts with equal sets are one class from here on, with the smallest doc_id;
   where rows repeat a doc_id with other texts, further classes get a number.
2. Classes that share a band key are candidates.  A bucket is never expanded
   into all its pairs.  First its members are compared with its smallest one,
   and what is linked is joined.  Members of buckets that are not one component
   after that are dealt into new buckets, by the rare shingles that any link
   between them has to share (_open_members).  Small buckets are compared pair
   by pair across components; in large ones those outside the bucket's main
   component are cut into blocks, and all members are compared with them in
   groups of bounded size.  So every pair of candidates is compared, or linked
   through others, or cannot be linked.
3. A candidate pair is kept if its estimated similarity, from the bit counts
   of the packed signatures corrected for chance collisions, is not far below
   the threshold (0.2, which is over five standard errors), and its set sizes
   allow the threshold.  What is left is decided on the whole sets.

Two things can miss a link, both by chance of the minima: with similarity 0.75
a pair shares no band with probability (1 - 0.75**4)**32, which is 5e-6, and
its estimate (standard error 0.04) is below the threshold less 0.2 with a
probability below 1e-6.  Pairs that the first step misses may still meet in the
buckets of the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.components import connected_components
from pairloom.llm.shared import BROADCAST_ROWS, cut, table
from pairloom.llm.shingles import MinHasher, WordHashes, shingle_set

SIGNED = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"
SETS = "id long, k1 long, k2 long, n long, shingles array<long>"
#: Members up to which a bucket is compared pair by pair, and bytes of sets on either side of a group for larger ones.
SMALL, BLOCK_BYTES = 50, 8_000_000
#: How far below the threshold an estimate may be.
SLACK = 0.2


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    values = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(a), int(b)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, hashes, none = MinHasher(), WordHashes(), np.empty(0, np.int64)
    for batch in batches:
        n, keys, sigs, bands = [], [], [], []
        for text in batch.column(1):
            found = shingle_set(text.as_py(), hashes)
            n.append(len(found))
            if len(found):
                low = hasher.minima(found)
                keys.append(_set_key(found))
                sigs.append(hasher.packed(low))
                bands.append(hasher.band_keys(low))
            else:
                keys.append((0, 0))
                sigs.append(none)
                bands.append(none)
        k = np.array(keys, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), _long_lists(sigs), _long_lists(bands)],
            ["doc_id", "text_key", "n_shingles", "k1", "k2", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(text.as_py(), hashes) for text in batch.column(1)]
        k = np.array([_set_key(s) for s in sets], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([len(s) for s in sets], pa.int64()), _long_lists(sets)], ["id", "k1", "k2", "n", "shingles"]
        )


def _estimate(bits: int = 4, k: int = 128) -> F.Column:
    """Similarity from the lanes that differ in sig_a and sig_b, corrected for lanes equal by chance."""
    words = k * bits // 64
    differ = F.lit(0)
    for i in range(words):
        x = F.col("sig_a")[i].bitwiseXOR(F.col("sig_b")[i])
        shift = 1
        while shift < bits:
            x = x.bitwiseOR(F.shiftright(x, shift))
            shift *= 2
        lane_ends = int(sum(1 << j for j in range(0, 64, bits)))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(lane_ends)))
    chance = 1.0 / (1 << bits)
    return ((k - differ) / k - chance) / (1 - chance)


class _Store:
    """Shingle sets of classes, worked out from the texts when first asked for."""

    def __init__(self, docs: DataFrame, repeated: DataFrame | None) -> None:
        self.docs, self.repeated, self.parts = docs, repeated, []

    def of(self, ids: DataFrame) -> DataFrame:
        """The sets of at least ``ids(id)``; ids that fit are broadcast, others are joined by shuffling."""
        for part in self.parts:
            ids = ids.join(part.select("id"), "id", "left_anti")
        ids = cut(ids)
        n = ids.count()
        if n or not self.parts:
            at = ids if self.repeated is None else ids.join(self.repeated, "id", "left").select(F.coalesce("doc_id", "id").alias("id")).distinct()
            keys = F.broadcast(at) if n <= BROADCAST_ROWS else at
            read = self.docs.join(keys, self.docs["doc_id"] == keys["id"], "left_semi").mapInArrow(_sets, SETS)
            if self.repeated is not None:
                # Of the texts of a repeated doc_id only those that are a class's own; each has its class's number.
                own = self.repeated.withColumnRenamed("id", "_own")
                whose = self.repeated.select("doc_id").distinct()
                once = read.join(whose, read["id"] == whose["doc_id"], "left_anti")
                more = read.join(own, (read["id"] == own["doc_id"]) & (read["k1"] == own["k1"]) & (read["k2"] == own["k2"]))
                read = once.unionByName(more.select(F.col("_own").alias("id"), read["k1"], read["k2"], "n", "shingles"))
            self.parts.append(cut(read.select("id", "n", "shingles")))
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.union(part)
        return out


def _with_component(members: DataFrame, components: DataFrame) -> DataFrame:
    return members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _first_pairs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's smallest id."""
    least = cut(members.groupBy("bucket").agg(F.min("id").alias("a")))
    return members.join(least, "bucket").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def _open_members(live: DataFrame, store: _Store, percent: int) -> DataFrame:
    """Members of buckets that still have several components, in new buckets: the rare shingles that a link needs.

    Order a set of n shingles by how many of these members have them, rare ones
    first.  A link takes at least percent of n in common, so two linked sets
    have one of their n - ceil(n * percent / 100) + 1 first shingles in common.
    Shingles of one member only are in nobody else's set and make no bucket;
    their number also bounds what two sets can have in common: s = n less
    those, and a link asks for s * (100 + percent) >= percent * (both sizes).
    So texts that share a passage but not three quarters of their words, and
    copies with too many edits, leave here without being compared.
    """
    mixed = cut(live.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket"))
    ids = cut(live.join(mixed, "bucket").select("id").distinct())
    sets = store.of(ids).join(ids, "id").dropDuplicates(["id"])
    rows = sets.select("id", "n", F.explode("shingles").alias("bucket"))
    often = rows.groupBy("bucket").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(often, "bucket", "left").withColumns(
        {
            "place": F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "bucket")),
            "s": F.count("df").over(Window.partitionBy("id")),
        }
    )
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    able = F.col("s") * (100 + percent) * 100 >= F.col("n") * percent * (100 + percent)  # a partner has at least percent of n
    return cut(ranked.where(F.col("df").isNotNull() & (F.col("place") <= first) & able).select("bucket", "id", "n", "s"))


def _small_pairs(live: DataFrame, percent: int) -> DataFrame:
    """The pairs of different components of each bucket of at most SMALL members: at most SMALL for each member."""
    small = live.where(F.col("m") <= SMALL).select("bucket", "id", "component", "n", "s")
    able = f"least(x.s, y.s) * {100 + percent} >= (x.n + y.n) * {percent}"
    pairs = small.alias("x").join(small.alias("y"), F.expr(f"x.bucket = y.bucket AND x.id < y.id AND x.component <> y.component AND {able}"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _large_links(live: DataFrame, sigs: DataFrame, store: _Store, percent: int) -> DataFrame:
    """Links between the components of larger buckets.

    Each bucket's most frequent component is its main one; members of all
    others are odd.  Odd members are dealt into blocks of about BLOCK_BYTES, by
    that bucket of theirs which has most, so that a block meets few others.  A
    member goes to the blocks that have odd members of its buckets, once to
    each, and the members of a block are split by a salt, with a copy of the
    block for each part.  A group is one block and one part, so it is bounded, and it
    returns links, at most one for an odd member and a component; rows are
    members, not pairs.
    """
    large = live.where(F.col("m") > SMALL).select("bucket", "id", "component", "n")
    size = F.col("n") * 8 + 100  # the bytes of a set and its signature
    parts = large.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum(size).alias("bytes"))
    most = F.struct("k", "component")
    main = cut(parts.groupBy("bucket").agg(F.max_by("component", most).alias("main"), (F.sum("bytes") - F.max_by("bytes", most)).alias("odd")))
    odd = large.join(main, "bucket").where("component <> main")
    odd = cut(odd.select("bucket", "id", "odd", F.xxhash64("bucket", F.pmod(F.xxhash64("id"), F.ceil(F.col("odd") / BLOCK_BYTES))).alias("block")))
    blocks = odd.groupBy("id").agg(F.max_by("block", F.struct("odd", "bucket")).alias("block"))
    wanted = cut(odd.select("bucket", "id").join(blocks, "id").select("bucket", "block").distinct())
    runs = cut(large.join(wanted, "bucket").select("id", "n", "block").distinct())
    salts = runs.groupBy("block").agg(F.ceil(F.sum(size) / BLOCK_BYTES).alias("salts"))
    sets = store.of(runs.select("id").distinct()).dropDuplicates(["id"]).select("id", "shingles")
    rows = cut(large.select("id", "component").distinct().join(sets, "id").join(sigs.select("id", "sig"), "id"))
    copies = blocks.join(salts, "block").select("id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    split = runs.join(salts, "block").select("id", "block", F.pmod(F.hash("id").cast("long"), "salts").alias("salt"))
    names = ["block", "salt", "id", "component", "sig", "shingles"]

    def group(at: DataFrame, side: str):
        named = rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns))
        at = at.select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "block", "salt")))
        return at.join(named, f"{side}_id").select(*(f"{side}_{c}" for c in names)).groupBy(f"{side}_block", f"{side}_salt")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _links_between(left.rename_columns(names), right.rename_columns(names), percent)

    links = group(copies, "a").cogroup(group(split, "b")).applyInArrow(compare, "a long, b long, component long")
    return cut(links.groupBy("a", "component").agg(F.min("b").alias("b")).select("a", "b"))


def _links_between(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Rows of ``left`` linked with rows of ``right`` of other components: by size and estimate, then on whole sets."""
    ids, components = left["id"].to_numpy(), left["component"].to_numpy()
    sets, others = _arrays(left["shingles"]), _arrays(right["shingles"])
    sizes = np.array([len(s) for s in sets], np.int64)
    sigs = np.array(_arrays(left["sig"])).reshape(len(sets), -1)
    found: dict[tuple[int, int], int] = {}
    for id_, component, sig, own in zip(right["id"].to_pylist(), right["component"].to_pylist(), _arrays(right["sig"]), others, strict=True):
        likely = (components != component) & (np.minimum(sizes, len(own)) * 100 >= np.maximum(sizes, len(own)) * percent)
        at = np.flatnonzero(likely)
        at = at[_similar(sigs[at], sig) >= percent / 100 - SLACK]
        for i in at.tolist():
            if (i, component) not in found:
                both = len(np.intersect1d(sets[i], own, assume_unique=True))
                if both * 100 >= (sizes[i] + len(own) - both) * percent:
                    found[i, component] = id_
    a = ids[[i for i, _ in found]] if found else ids[:0]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(list(found.values()), pa.int64()), "component": pa.array([c for _, c in found], pa.int64())})


def _arrays(lists: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in lists]


def _similar(sigs: np.ndarray, sig: np.ndarray, bits: int = 4, k: int = 128) -> np.ndarray:
    """What _estimate gives, of each row of ``sigs`` with one signature."""
    x = sigs ^ sig
    shift = 1
    while shift < bits:
        x = x | (x >> np.uint64(shift))
        shift *= 2
    differ = np.bitwise_count(x & np.uint64(sum(1 << j for j in range(0, 64, bits)))).sum(axis=1, dtype=np.int64)
    chance = 1.0 / (1 << bits)
    return ((k - differ) / k - chance) / (1 - chance)


def _verify(pairs: DataFrame, sigs: DataFrame, store: _Store, percent: int) -> DataFrame:
    """The pairs that are linked: first by estimate and size, then by whole sets."""
    side = lambda s: sigs.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    likely = cut(
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .where(_estimate() >= percent / 100 - SLACK)
        .select("a", "b")
        .distinct()
    )
    sets = store.of(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    whole = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles").alias(f"set_{s}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    linked = likely.join(whole("a"), "a").join(whole("b"), "b").where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent)
    return cut(linked.select("a", "b").distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``; with ``text_key`` also xxhash64 of its text.

    Rows are linked if 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest key reachable.  Null, empty and blank
    texts have no shingles and are linked with nothing.  Rows that repeat a key
    are judged each by its own text.  A null key is linked with nothing: its
    component is null, and it is kept.  Very long texts have as many shingles as
    they have.  Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    signed = cut(docs.withColumn("text_key", F.xxhash64("_text")).mapInArrow(_sign, SIGNED))
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo")))
    key = F.struct("k1", "k2")
    several = cut(known.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select(F.col("doc_id").alias("lo")))
    repeated = None
    if not several.isEmpty():
        # The first class of a repeated doc_id is called by it, the others by a hash.
        place = F.row_number().over(Window.partitionBy("lo").orderBy("k1", "k2"))
        mine = classes.join(several, "lo", "left_semi").withColumn("id", F.when(place == 1, F.col("lo")).otherwise(F.xxhash64("lo", "k1", "k2")))
        repeated = cut(mine.select(F.col("lo").alias("doc_id"), "k1", "k2", "id"))
        others = repeated.select("k1", "k2", "id")
        classes = cut(classes.join(others, ["k1", "k2"], "left").withColumn("id", F.coalesce("id", "lo")))
    else:
        classes = classes.withColumn("id", F.col("lo"))
    nodes = cut(
        signed.join(classes.select("k1", "k2", "id", F.col("lo").alias("doc_id")), ["k1", "k2", "doc_id"])
        .select("id", F.col("n_shingles").alias("n"), "sig", "bands")
        .dropDuplicates(["id"])
    )
    members = nodes.select("id", F.explode("bands").alias("bucket"))
    # Aggregates are staged before they are joined back: then the join has its own shuffle, and a bucket with many members is split.
    shared = cut(members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket"))
    members = cut(members.join(shared, "bucket"))
    sigs = nodes.select("id", "n", "sig")
    store = _Store(docs, repeated)
    edges = _verify(_first_pairs(members), sigs, store, percent)
    components = connected_components(edges)
    live = _with_component(_open_members(_with_component(members, components), store, percent), components)
    sizes = cut(live.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi"))
    live = cut(live.join(sizes.select("bucket", "m"), "bucket"))
    links = _verify(_small_pairs(live, percent), sigs, store, percent)
    if not sizes.where(F.col("m") > SMALL).isEmpty():
        links = links.union(_large_links(live, sigs, store, percent))
    # Only links between components are left, so only components are joined now.
    of = lambda s: components.select(F.col("id").alias(s), F.col("component").alias(f"{s}_at"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_at", "a").alias("a"), F.coalesce("b_at", "b").alias("b"))
    joined = connected_components(between).withColumnsRenamed({"id": "at", "component": "end"})
    merged = classes.select("k1", "k2", "id", "lo").join(components, "id", "left").withColumn("at", F.coalesce("component", "id"))
    merged = merged.join(joined, "at", "left").select("k1", "k2", "lo", F.coalesce("end", "at").alias("root"))
    if repeated is not None:  # a component is named after its smallest doc_id, not its smallest number
        merged = cut(merged)
        roots = cut(merged.groupBy("root").agg(F.min("lo").alias("least")))
        merged = merged.join(roots, "root").select("k1", "k2", F.col("least").alias("root"))
    found = signed.join(merged.select("k1", "k2", "root"), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("root")), F.col("doc_id")))
    columns = ["doc_id", "n_shingles", component.alias("component_id"), *(["text_key"] if text_key else [])]
    return found.select(*columns).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs by common shingles, then reachability; exact, so it also shows that no link is missed.
OP2_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
