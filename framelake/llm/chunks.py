"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes: each step shifts the hash left by one bit and
adds a random value of the byte, so that 16 bits remember exactly the last 16
bytes. A chunk ends where the top ``mask_bits`` bits are zero, at least
``min_size`` bytes after its start, at a code point's border, or at ``max_size``
(then at the last border). Boundaries depend on the bytes just before them, so
an insertion moves only the chunks around it. Chunks are deduplicated by a
128-bit digest over the whole corpus: the first occurrence (least doc_id, then
text hash, then place) stays, and every later one is a repeat and is removed.
``min_run`` can spare runs of repeats with fewer bytes (0: none is spared); a run
that covers its whole document is removed at any length.

All boundaries of a batch are found at once: the rolling hash is a sum of
shifted table values, which four doublings give for every byte.

At scale: one scan leaves the digests, about 22 bytes per chunk. Their first
halves are counted with partial aggregation (a passage in a third of all
documents is one row per task); places of halves that occur once go no further
than one equi-join, and those of a hot half or digest get its row by a bounded
broadcast; whole digests and first occurrences are made up among the rest, and what
meets again per document is bounded by the document's own chunks.

Edge cases: null and empty texts have no chunks; a text shorter than
``min_size`` is one chunk; rows with the same id and text count as one document,
and all its rows show the same result; a null id comes after all others; ties in id
go to the lesser text hash, then the earlier place; an empty table gives no rows; very
long texts are chunked whole; extra columns are kept by ``without_repeats`` and
ignored by ``chunk_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, raw, release, scratch, stored, texts_of, with_counts

MIN_SIZE, MASK_BITS, MAX_SIZE, MIN_RUN = 16, 5, 256, 0
BATCH_BYTES = 4 << 20
GEAR = np.random.default_rng(4).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, over the last 16 bytes."""
    out = GEAR[data]
    for step in (1, 2, 4, 8):
        moved = out.copy()
        moved[step:] += out[:-step] << np.uint16(step)
        out = moved
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray, min_size=MIN_SIZE, mask_bits=MASK_BITS, max_size=MAX_SIZE) -> list[list[int]]:
    """The ends of the chunks of each text, from its start."""
    border = np.ones(len(data) + 1, bool)
    border[:-1] = (data & 0xC0) != 0x80
    ends = np.flatnonzero(gear(data) >> np.uint16(16 - mask_bits) == 0) + 1
    ends = ends[border[ends]]
    first = np.searchsorted(ends, offsets[:-1], side="right")
    last = np.searchsorted(ends, offsets[1:], side="left")
    out = []
    for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        found, start = [], a
        for e in [*ends[i:j].tolist(), b]:
            while e - start > max_size:
                stop = start + max_size
                while not border[stop]:
                    stop -= 1
                found.append(stop - a)
                start = stop
            if e - start >= min_size or (e == b and b > start):
                found.append(e - a)
                start = e
        out.append(found)
    return out


CHUNKED_SCHEMA = "doc_id bigint, text_hash bigint, ends array<int>, high array<bigint>, low array<bigint>"


def chunked(docs: DataFrame, doc_id="doc_id", text="text", min_size=MIN_SIZE, mask_bits=MASK_BITS, max_size=MAX_SIZE) -> DataFrame:
    """One row per document: the ends of its chunks and the two halves of their digests."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            data, offsets = raw(texts_of(batch.column("text")))
            whole, ends = data.tobytes(), boundaries(data, offsets, min_size, mask_bits, max_size)
            digests, counts = [], [0]
            for a, found in zip(offsets.tolist(), ends, strict=False):
                start = a
                for e in found:
                    digests.append(xxhash.xxh3_128_digest(whole[start : a + e]))
                    start = a + e
                counts.append(len(digests))
            halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            borders = pa.array(counts, pa.int32())
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(ends, pa.list_(pa.int32())), *(pa.ListArray.from_arrays(borders, pa.array(halves[:, k])) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "ends", "high", "low"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(split, CHUNKED_SCHEMA)


def chunk_repeats(docs: DataFrame, doc_id="doc_id", text="text", min_run=MIN_RUN, **sizes) -> DataFrame:
    """One row per document: doc_id, text_hash, n_bytes, n_chunks, n_repeats (chunks that occur earlier), starts and ends of what is removed."""
    rows = stored(chunked(docs, doc_id, text, **sizes), "chunks")
    many = rows.select(F.explode("high").alias("high")).groupBy("high").agg(F.count("*").alias("counts")).where("counts > 1")
    many = stored(many, "repeated-halves")
    release(docs.sparkSession)
    places = rows.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("high", "low")).alias("k", "d")).select("doc_id", "text_hash", "k", "d.high", "d.low")
    places = stored(with_counts(places, many, "high").drop("counts"), "repeated-places")
    dropped(many)
    release(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "k")
    first = places.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("counts")).where("counts > 1")
    first = stored(first.select("high", "low", "first", "counts"), "first-places")
    later = with_counts(places, first, "high", "low").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("k") == F.col("first.k"))))
    later = later.groupBy(F.col("doc_id").alias("later_id"), F.col("text_hash").alias("later_hash")).agg(F.collect_set("k").alias("later"))
    same = F.col("doc_id").eqNullSafe(F.col("later_id")) & (F.col("text_hash") == F.col("later_hash"))
    joined = rows.select("doc_id", "text_hash", "ends").join(later, same, "left").drop("later_id", "later_hash")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, h, ends, later in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "ends", "later")), strict=True):
                starts, found = [0, *ends[:-1]], []
                for k in sorted(later or ()):
                    if found and found[-1][1] == starts[k]:
                        found[-1][1] = ends[k]
                    else:
                        found.append([starts[k], ends[k]])
                found = [x for x in found if x[1] - x[0] >= min_run or x == [0, ends[-1]]]
                out.append((i, h, ends[-1] if ends else 0, len(ends), len(later or ()), [a for a, _ in found], [b for _, b in found]))
            types = (*[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "text_hash", "n_bytes", "n_chunks", "n_repeats", "starts", "ends"])

    return joined.mapInArrow(spans, "doc_id bigint, text_hash bigint, n_bytes bigint, n_chunks bigint, n_repeats bigint, starts array<bigint>, ends array<bigint>")


def without_repeats(docs: DataFrame, doc_id="doc_id", text="text", min_run=MIN_RUN, **sizes) -> DataFrame:
    """All rows of docs, their repeated runs cut out of the text."""
    with scratch(docs.sparkSession) as own:
        found = chunk_repeats(docs, doc_id, text, min_run, **sizes).where("size(starts) > 0")
        found = own.keep(stored(found.select(F.col("doc_id").alias("__chunk_id"), F.col("text_hash").alias("__chunk_hash"), F.col("starts").alias("__chunk_starts"), F.col("ends").alias("__chunk_ends")).distinct(), "chunk-spans"))
    same = docs[doc_id].cast("long").eqNullSafe(found["__chunk_id"]) & (F.xxhash64(docs[text]) == found["__chunk_hash"])
    joined = docs.join(found, same, "left").select(*(docs[c] for c in docs.columns), "__chunk_starts", "__chunk_ends")
    names = list(docs.columns)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, text):
            texts = batch.column(text).to_pylist()
            for k, (a, b) in enumerate(zip(batch.column("__chunk_starts").to_pylist(), batch.column("__chunk_ends").to_pylist(), strict=True)):
                if a:
                    data = texts[k].encode()
                    texts[k] = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)], strict=True)).decode()
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(trim, docs.schema)


def op4_chunks(spark, sf_dir):
    rows = chunk_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    spans = F.concat_ws(",", F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string"))))
    return rows.select("doc_id", "n_bytes", "n_chunks", "n_repeats", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), spans.alias("spans"))
