"""Near-duplicate detection with min-max hashing.

A document's set is its distinct word shingles. Each permutation of the shingle
hashes keeps both its minimum and its maximum, so that half as many hash
evaluations give a signature of the same length (each position agrees with the
probability of the Jaccard similarity, and the two of a permutation never
coincide by chance, which lowers the variance). Bands of the signature are
buckets of candidates; every link is confirmed on the full sets.

Documents with equal sets form a class; only one of each class goes on. With
bands of 4 out of 96 positions a pair at similarity 0.8 meets in no bucket with
probability 3e-6, at 0.85 with 2e-8.

Linking without all pairs: what is asked for are components, so in every bucket
all members are compared with one hub (the least class): first every class with
the least of its hubs, then only with those hubs that are not in its component
yet. With these components known, a bucket is finished if all its members are in one. In
the others only *stragglers*, members outside the bucket's largest component, are
compared with members of other components: in buckets of at most ``SMALL``
members as pairs, and only where the triangle inequality of the Jaccard distance
to the hub allows a link. Members of larger open buckets meet again by their rarest
shingles (prefix filter, exact): those of a shingle with at most ``SMALL`` members
as pairs of fitting sizes, those of more frequent ones in blocks of their bucket, a
block of stragglers as an inverted index that the others stream past, which counts a
member's overlaps with the whole block at once and keeps one link per straggler and
component. No pair that could join two components is left out, so the result is
that of confirming every candidate pair.

At scale: signatures are a map; classes collapse copies (a third of all rows as
copies is one row after partial aggregation); buckets are narrow rows; texts
travel only for classes that share a bucket, once per class and once per hub
they are compared with; a hub of many members is salted by the size of their
sets, and the members of a large bucket are dealt to tasks of ``SALT_MEMBERS``;
comparing streams over sorted rows with one hub's set or one block in memory.
Members of large open buckets cost one narrow row per shingle; texts that share any
part of their shingles, but not their rarest ones, meet no further. What remains
quadratic are classes of large buckets that have a shingle among their rarest which
many texts of other components have there too: those travel once per block of at
most ``BLOCK`` stragglers and ``BLOCK_SHINGLES`` shingles, text and all.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased. Edge cases: fewer
words than a shingle make one shingle of the whole sequence; null, empty and
blank texts have no set, are linked with nothing (not even each other) and are
kept; an empty table gives no rows; very long texts are sets like any other, one in memory at a time; a null id is never the least of a group unless all are null; repeated rows
share their class; extra columns are kept by ``deduplicate``, ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, cut, dropped, mixed, release, scratch, stored, texts_of, translated, windows_hash, with_counts
from .graph import components

PERMUTATIONS = 48
BAND_ROWS = 4
BATCH_BYTES = 2 << 20
SALT_SHINGLES = 200_000
SMALL, BLOCK, SALT_MEMBERS = 32, 512, 4000
BLOCK_SHINGLES = 400_000


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(translated(texts_of(column), LOWER))
    hashes, offsets = words.hashes(), words.offsets
    grams = windows_hash(hashes, width)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed(windows_hash(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(sets: list[np.ndarray], permutations: int, seed: int = 1) -> np.ndarray:
    """Rows of 2 x permutations values: minimum and maximum under each permutation. No set may be empty."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k, a in enumerate(odd):
        moved = values * a
        moved ^= moved >> np.uint64(32)
        moved *= a
        out[:, 2 * k] = np.minimum.reduceat(moved, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(moved, starts)
    return out


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """Bucket keys; a band of four rows has the minimum and maximum of two permutations."""
    n = signature.shape[1] // rows
    out = np.empty((len(signature), n), np.uint64)
    for k in range(n):
        key = np.full(len(signature), k + 1, np.uint64)
        for x in range(rows):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k * rows + x])
        out[:, k] = key
    return out.view(np.int64)


SIGNED_SCHEMA = "doc_id bigint, text_hash bigint, class binary, n_shingles bigint, bands array<bigint>"


def signed(docs: DataFrame, doc_id: str, text: str, width: int, permutations: int, rows: int) -> DataFrame:
    """One narrow row per document: its class, the size of its set and its bucket keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text"), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                keys = bands_of(signatures([sets[k] for k in full], permutations), rows)
                for k, row in zip(full, keys, strict=True):
                    bands[k] = row
            values = [batch.column("doc_id"), batch.column("text_hash"), pa.array([class_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "text_hash", "class", "n_shingles", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(sign, SIGNED_SCHEMA)


COMPARED_SCHEMA = "hub binary, member binary, shared bigint, united bigint"


def compared(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """From distinct (hub, member) classes: sizes of intersection and union of their sets."""
    load = pairs.join(classes.select(F.col("class").alias("member"), "n_shingles"), "member")
    salts = load.groupBy("hub").agg(F.ceil(F.sum("n_shingles") / SALT_SHINGLES).alias("salts"))
    dealt = load.join(salts, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.col("salts")).alias("salt"))
    hubs = dealt.select("hub", "salt").distinct().join(texts.withColumnRenamed("class", "hub"), "hub").select("hub", "salt", F.lit(None).cast("binary").alias("member"), "text")
    members = dealt.join(texts.withColumnRenamed("class", "member"), "member").select("hub", "salt", "member", "text")
    rows = hubs.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in cut(batches, "text", BATCH_BYTES):
            out = []
            sets = shingle_sets(batch.column("text"), width)
            for h, m, s in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), sets, strict=True):
                if m is None:
                    if class_of(s) == h:
                        hub, own = h, s
                elif h == hub and class_of(s) == m:
                    at = np.searchsorted(own, s)
                    at[at == len(own)] = 0
                    shared = int(np.count_nonzero(own[at] == s))
                    out.append((h, m, shared, len(own) + len(s) - shared))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["hub", "member", "shared", "united"])

    return rows.select("hub", "member", "text").mapInArrow(compare, COMPARED_SCHEMA)


class Block:
    """Sets as an inverted index: which of them have a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        by = np.argsort(tokens, kind="stable")
        self.tokens, first = np.unique(tokens[by], return_index=True)
        self.owner, self.ends = owner[by], np.append(first, len(tokens))
        self.sizes = np.array([len(s) for s in sets])

    def shared(self, one: np.ndarray) -> np.ndarray:
        """The number of shingles that each set of the block has in common with ``one``."""
        at = np.minimum(np.searchsorted(self.tokens, one), len(self.tokens) - 1)
        at = at[self.tokens[at] == one]
        n = self.ends[at + 1] - self.ends[at]
        spots = np.repeat(self.ends[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        return np.bincount(self.owner[spots], minlength=len(self.sizes))


def block_links(stragglers: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between (bucket, class, root, n) stragglers of n shingles and the members of their buckets, one for each straggler, component and task at least where there is one."""
    blocks = stragglers.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    salts = members.groupBy("bucket").agg(F.ceil(F.count("*") / SALT_MEMBERS).alias("salts"))
    hashed = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "class"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = stragglers.join(blocks, "bucket").join(salts, "bucket").select("bucket", hashed(1, "blocks").alias("block"), each("salts").alias("salt"), F.lit(0).alias("side"), "class", "root")
    right = members.join(blocks, "bucket").join(salts, "bucket").select("bucket", each("blocks").alias("block"), hashed(2, "salts").alias("salt"), F.lit(1).alias("side"), "class", "root")
    rows = left.unionByName(right).join(texts, "class").repartition("bucket", "block", "salt").sortWithinPartitions("bucket", "block", "salt", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, names, roots, sets, block, told = None, [], [], [], None, set()
        for batch in cut(batches, "text", BATCH_BYTES):
            out = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "salt")), strict=True))
            found = shingle_sets(batch.column("text"), width)
            for key, side, name, root, s in zip(keys, *(batch.column(c).to_pylist() for c in ("side", "class", "root")), found, strict=True):
                if key != unit:
                    unit, names, roots, sets, block, told = key, [], [], [], None, set()
                if class_of(s) != name:
                    continue
                if side == 0:
                    names.append(name)
                    roots.append(root)
                    sets.append(s)
                    continue
                if not names:
                    continue
                block = block or Block(sets)
                shared = block.shared(s)
                for k in np.flatnonzero(100 * shared >= percent * (block.sizes + len(s) - shared)).tolist():
                    if roots[k] != root and (k, root) not in told:
                        told.add((k, root))
                        out.append((names[k], name))
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["u", "v"])

    return rows.mapInArrow(compare, "u binary, v binary")


def prefix_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between members of different components of large open buckets, stored rows (bucket, class, root, top).

    Prefix filter: with all shingles in one order, here those of one component
    first, then from rare to frequent, two linked sets of n and m shingles share one
    among the first n - ceil(n * percent / 100) + 1 of the one and those of the other.
    What all texts have in common is in no prefix. Classes that share a prefix's
    shingle with at most ``SMALL`` are compared as pairs; those with a more frequent
    one meet the others of that kind in blocks of their buckets.
    """
    open_ = members.select("class", "root").distinct()
    sets = stored(shingled(open_.join(texts, "class"), width), "open-sets")
    places = sets.select("class", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    several = places.groupBy("shingle").agg(F.count("*").alias("counts"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    several = stored(several.select("shingle", "counts"), "shared-shingles")
    order = F.array_sort(F.collect_list(F.struct("counts", "shingle")))
    rows = with_counts(places, several, "shingle").groupBy("class", "root", "n").agg(order.alias("order"))
    left = F.expr(f"greatest(0, size(order) - ({percent} * n + 99) div 100 + 1)")  # of the prefix, after the shingles of one component
    rows = rows.select("class", "root", "n", F.explode(F.slice("order", F.lit(1), left.cast("int"))).alias("s")).select("class", "root", "n", F.col("s.shingle").alias("bucket"))
    rows = stored(rows, "prefixes")
    parts = rows.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    groups = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("k").alias("members")).where("parts > 1")
    rows = stored(rows.join(groups.select("bucket", "members"), "bucket"), "prefix-groups")
    small, large = rows.where(F.col("members") <= SMALL), rows.where(F.col("members") > SMALL)
    right = small.select("bucket", *(F.col(c).alias(f"{c}_2") for c in ("class", "root", "n")))
    fits = F.lit(100) * F.least("n", "n_2") >= F.lit(percent) * F.greatest("n", "n_2")
    pairs = small.join(right, "bucket").where((F.col("class") < F.col("class_2")) & (F.col("root") != F.col("root_2")) & fits)
    pairs = pairs.select(F.col("class").alias("hub"), F.col("class_2").alias("member")).distinct()
    sizes = sets.select("class", F.size("shingles").alias("n_shingles"))
    found = compared(pairs, texts, sizes, width).where(f"100 * shared >= {percent} * united").select(F.col("hub").alias("u"), F.col("member").alias("v"))
    frequent = stored(large.select("class", "n").distinct(), "frequent-prefixes")
    if not frequent.head(1):
        return found
    again = members.join(frequent, "class")
    return found.unionByName(block_links(again.where("root <> top"), again, texts, width, percent))


def shingled(texts: DataFrame, width: int) -> DataFrame:
    """(class, root, shingles) of (class, root, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text"), width)
            kept = [k for k, (s, name) in enumerate(zip(sets, batch.column("class").to_pylist(), strict=True)) if class_of(s) == name]
            shingles = pa.array([sets[k].view(np.int64) for k in kept], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(kept, pa.int64())), batch.column("root").take(pa.array(kept, pa.int64())), shingles], ["class", "root", "shingles"])

    return texts.select("class", "root", "text").mapInArrow(split, "class binary, root binary, shingles array<bigint>")


LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27


def marked(df: DataFrame, key, keys: DataFrame, own) -> DataFrame:
    """df, which must not have the names used here, with __marked: true wherever its key is among those of the stored tables ``keys``, and by chance for others.

    A bitmap of 16 bits a key, at most 2 ** 27 (two million rows, 32 MB), is
    broadcast, so that rows that cannot meet a key need no shuffle; a join decides
    on the rest. With more keys than bits everything is marked, and the join does all.
    """
    n = keys.count()
    if n > MOST_BITS:
        return df.withColumn("__marked", F.lit(True))
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * n).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(size))
    bits = keys.select(place(own).alias("__place")).selectExpr("__place div 64 AS __word", "shiftleft(1L, cast(__place % 64 AS int)) AS __bit")
    bitmap = bits.groupBy("__word").agg(F.expr("bit_or(__bit)").alias("__bits"))
    rows = df.withColumn("__place", place(key)).withColumn("__word", F.expr("__place div 64")).join(F.broadcast(bitmap), "__word", "left")
    return rows.withColumn("__marked", F.expr("coalesce(__bits & shiftleft(1L, cast(__place % 64 AS int)), 0L) <> 0")).drop("__place", "__word", "__bits")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", width=5, percent=80, permutations=PERMUTATIONS, band_rows=BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, class, component_id (the least id of its component), kept (has that id), copied (its class has several rows) and chosen (of the kept ones those with the least text hash).

    Linked are documents with 100 x shared >= percent x united shingles.
    """
    spark = docs.sparkSession
    with scratch(spark) as own:
        rows = own.keep(stored(signed(docs, doc_id, text, width, permutations, band_rows), "signed"))
        least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least_row")
        classes = rows.where("class IS NOT NULL").groupBy("class").agg(least_row, F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        classes = stored(classes.select("class", "least_row.doc_id", "least_row.text_hash", "n_rows", "n_shingles", "bands"), "classes")
        keys = classes.select("class", F.explode("bands").alias("bucket"))
        shared_keys = stored(keys.groupBy("bucket").agg(F.min("class").alias("hub"), F.count("*").alias("counts")).where("counts > 1"), "shared-buckets")
        members = stored(with_counts(keys, shared_keys, "bucket").select("bucket", "class", "hub"), "buckets")
        dropped(shared_keys)
        release(spark)

        wanted = stored(members.select("class").distinct().join(classes.select("class", "doc_id"), "class"), "bucket-classes")
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        source = marked(source, F.col("doc_id"), wanted, F.col("doc_id")).where("__marked").select("doc_id", "text")
        texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"])).select("class", "text")
        texts = stored(texts, "bucket-texts")
        release(spark)

        # each member with the least of its hubs, then with the others that are not in its component yet
        linked = F.expr(f"100 * shared >= {percent} * united")
        once = members.where("class <> hub").groupBy("class").agg(F.min("hub").alias("hub")).select("hub", F.col("class").alias("member"))
        once = stored(compared(once, texts, classes, width).distinct(), "compared-once")
        roots = stored(components(once.where(linked).select(F.col("hub").alias("u"), F.col("member").alias("v"))), "roots-once")
        of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        pairs = members.where("class <> hub").select("hub", F.col("class").alias("member")).distinct().join(of("hub"), "hub", "left").join(of("member"), "member", "left")
        pairs = pairs.where(F.coalesce("hub_root", "hub") != F.coalesce("member_root", "member")).select("hub", "member").join(once.select("hub", "member"), ["hub", "member"], "left_anti")
        rest = stored(compared(pairs, texts, classes, width).distinct(), "compared-rest")
        first = once.unionByName(rest)
        links = rest.where(linked).select(F.col("hub").alias("u"), F.col("member").alias("v"))
        if rest.where(linked).head(1):
            roots = stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)), "roots")

        near = members.join(first.select("hub", F.col("member").alias("class"), (F.col("shared") / F.col("united")).alias("likeness")), ["hub", "class"], "left")
        near = near.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        near = near.select("bucket", "class", F.coalesce("likeness", F.when(F.col("class") == F.col("hub"), F.lit(1.0))).alias("likeness"), F.coalesce("root", "class").alias("root"))
        near = stored(near, "members-with-roots")
        parts = near.groupBy("bucket", "root").agg(F.count("*").alias("n"))
        largest = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("counts"), F.max(F.struct("n", "root")).alias("top")).where("parts > 1")
        largest = stored(largest.select("bucket", "counts", F.col("top.root").alias("top")), "largest-parts")
        near = stored(with_counts(near, largest, "bucket").withColumnRenamed("counts", "members"), "open-buckets")
        small, large = near.where(F.col("members") <= SMALL), near.where(F.col("members") > SMALL)
        right = small.select("bucket", *(F.col(c).alias(f"{c}_2") for c in ("class", "likeness", "root")))
        apart = F.coalesce(F.abs(F.col("likeness") - F.col("likeness_2")) <= 1 - percent / 100 + 1e-9, F.lit(True))
        cross = small.where("root <> top").join(right, "bucket").where((F.col("root") != F.col("root_2")) & apart)
        cross = cross.select(F.least("class", "class_2").alias("hub"), F.greatest("class", "class_2").alias("member")).distinct()
        cross = cross.join(first.select("hub", "member"), ["hub", "member"], "left_anti")
        more = compared(cross, texts, classes, width).where(linked).select(F.col("hub").alias("u"), F.col("member").alias("v"))
        if large.head(1):
            more = more.unionByName(prefix_links(large.select("bucket", "class", "root", "top"), texts, width, percent))
        more = stored(more, "more-links")
        if more.head(1):
            roots = stored(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "roots")
        dropped(members, texts, near)
        release(spark)

        named = classes.select("class", "doc_id", "text_hash", "n_rows").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "class")).alias("least"))
        named = named.join(least, "root").select("class", F.col("least.doc_id").alias("component_id"), F.when(F.col("class") == F.col("least.class"), F.col("least.text_hash")).alias("least_hash"), (F.col("n_rows") > 1).alias("copied"))
        named = own.keep(stored(named, "components"))
    out = rows.select("doc_id", "text_hash", "class", "n_shingles").join(named, "class", "left")
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    chosen = F.col("class").isNull() | F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("least_hash")), F.lit(False))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("chosen", chosen).drop("least_hash")


def deduplicate(docs: DataFrame, doc_id="doc_id", text="text", width=5, percent=80, permutations=PERMUTATIONS, band_rows=BAND_ROWS) -> DataFrame:
    """The rows of docs that are kept, unchanged: of each component one row with the least id (then the least text hash, then the least row as JSON)."""
    pair = [F.col("doc_id").alias("__dedup_id"), F.col("text_hash").alias("__dedup_hash")]
    with scratch(docs.sparkSession) as own:
        found = near_duplicates(docs, doc_id, text, width, percent, permutations, band_rows)
        gone = own.keep(stored(found.where("NOT chosen").select(*pair).distinct(), "duplicates"))
        again = found.where("chosen AND copied").select(*pair).groupBy("__dedup_id", "__dedup_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        again = own.keep(stored(again, "repeated-rows"))
    looked = gone.unionByName(again)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # helper names cannot meet the caller's
    rows = docs.select(whole, F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    rows = marked(rows, F.col("id"), looked, F.col("__dedup_id"))
    same = F.col("id").eqNullSafe(F.col("__dedup_id")) & (F.col("hash") == F.col("__dedup_hash"))
    out = rows.where("NOT __marked").select("row").unionByName(rows.where("__marked").join(looked, same, "left_anti").select("row"))
    if again.head(1):
        repeated = rows.where("__marked").join(again, same)
        out = out.unionByName(repeated.groupBy("__dedup_id", "__dedup_hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select("row.*")


def op6_minhash(spark, sf_dir):
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT r, array_to_string(w[k:k + 2], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(k) WHERE len(w) > 0
), n AS (
  SELECT r, count(*) AS n FROM g GROUP BY r
), p AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r
), l AS (
  SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
  SELECT r AS x, r AS y FROM t UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y
), c AS (
  SELECT reach.x AS r, min(t.doc_id) AS component_id FROM reach JOIN t ON t.r = reach.y GROUP BY reach.x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM t LEFT JOIN n USING (r) JOIN c USING (r)
"""
