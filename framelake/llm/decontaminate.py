"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document, as search engines do: a *segment* is a few
megabytes of documents and holds, for each of their terms, the ascending list
of positions (one running number over the segment's words). Segments are rows of
a stored table; building and searching them needs no shuffle, and a lost task is
one segment's work.

A search takes windows of query terms. In each segment a window starts from the
posting list of its rarest term there, moved back by the term's offset, and is
intersected with the offset-adjusted lists of its other terms from rare to
frequent by binary search in the (term, position) order; all windows go through
each step together. What is left are exact phrase matches. With ``slop`` > 0,
proximity matches are returned too: all terms of the window, in any order,
within its width plus slop words.

At scale: the work per segment is bounded by its size and the queries. The
benchmark is collected only in blocks of about ``block_bytes`` of text, whose
number follows from a count, and travels as arrays of word numbers (12 bytes a
word); with more than one block, every segment is searched for each block and the
hits are united per document, told apart by its segment's number and its place in
it. ``without_contaminated`` only filters rows: it stores no index, searches each
segment in the task that made it, and stores what is left between the passes of
several blocks. A term that fills a third of all rows is never the start of an intersection
unless a window has no other.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased.
A window is ``window`` consecutive words of an item; an item with fewer words,
but not none, is one window.

Edge cases: null and empty texts have no words and are never contaminated;
repeated items count once by their id; an item without an id marks words but is
not listed or counted; an empty benchmark marks nothing; an empty table gives no
rows; repeated documents and ids, null ones too, are judged row by row; a very long
text is a segment of its own; of rarest terms with equal counts the first in the
window begins; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, small_batches, stored, texts_of, translated

WINDOW = 10
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
"""Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space."""

SEGMENT_SCHEMA = "segment bigint, doc_ids array<bigint>, ends array<bigint>, terms array<binary>, term_ends array<bigint>, positions array<int>"
SEGMENT_ARROW = pa.schema([
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("term_ends", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


def _postings(texts: pa.Array) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray, np.ndarray]:
    """(ends of the texts in words, terms, ends of their lists, positions) of a segment."""
    words = Words(translated(texts_of(texts), FOLDED))
    order = np.argsort(words.codes, kind="stable").astype(np.int32)
    return words.offsets[1:], words.dictionary, np.cumsum(np.bincount(words.codes, minlength=len(words.dictionary))), order


def build_index(docs: DataFrame, doc_id="doc_id", text="text", segment_bytes=SEGMENT_BYTES) -> DataFrame:
    """Segments of the positional inverted index, one row each, numbered by task and place in it. Store it before several searches are joined."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in cut(batches, "text", segment_bytes):
            number += 1
            values = (number, batch.column("doc_id").to_pylist(), *_postings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SEGMENT_ARROW, strict=True)], schema=SEGMENT_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(build, SEGMENT_SCHEMA)


class Queries:
    """Windows of items as arrays: the items' words as numbers, each window's first place and width, and the ids of equal items."""

    def __init__(self, items: list[tuple], window: int | None = None):
        """``items``: (words, ids); a window is ``window`` consecutive words, or a whole item that has fewer (None: always the whole item)."""
        ids: dict[tuple[bytes, ...], set] = {}
        for words, own in items:
            if words:
                ids.setdefault(tuple(words), set()).update(own)
        number: dict[bytes, int] = {}
        self.words = np.array([number.setdefault(w, len(number)) for words in ids for w in words], np.int32)
        self.vocabulary = list(number)
        sizes = np.array([len(words) for words in ids], np.int64)
        widths = sizes if window is None else np.minimum(sizes, window)
        counts = sizes - widths + 1
        self.item = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
        self.width = widths[self.item].astype(np.int32)
        self.start = (np.arange(counts.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)).astype(np.int32)
        self.ids = [sorted(own - {None}) for own in ids.values()]

    def known(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words as codes of a segment's terms (-1: not there), and the numbers of the windows that have all of theirs."""
        found = codes[self.words] if len(codes) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(found >= 0)])
        return found, np.flatnonzero(total[self.start + self.width] - total[self.start] == self.width)


class Segment:
    """A segment in memory: posting lists, and their union in (term, position) order for binary search."""

    def __init__(self, row: dict):
        self.number, self.doc_ids, self.terms, self.ends = row["segment"], row["doc_ids"], row["terms"], row["ends"]
        self.term_ends, self.positions = row["term_ends"], row["positions"]
        self.starts = np.concatenate([[0], self.term_ends[:-1]]).astype(np.int64) if len(self.term_ends) else np.zeros(0, np.int64)
        self.frequency = self.term_ends - self.starts
        self.ordered = (np.repeat(np.arange(len(self.terms), dtype=np.int64), self.frequency) << 32) | self.positions

    def codes(self, vocabulary: list[bytes]) -> np.ndarray:
        """The number of each word among the segment's terms, -1 for those it does not have."""
        return pc.fill_null(pc.index_in(pa.array(vocabulary, pa.binary()), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def exact(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position of its first word) of every occurrence within one document."""
        words, known = queries.known(self.codes(queries.vocabulary))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for width in np.unique(queries.width[known]).tolist():
            numbers = known[queries.width[known] == width]
            codes = words[queries.start[numbers][:, None] + np.arange(width)]
            rare = np.argsort(self.frequency[codes], axis=1, kind="stable")
            first = np.take_along_axis(codes, rare[:, :1], 1)[:, 0]
            count = self.frequency[first]
            which = np.repeat(np.arange(len(numbers)), count)
            at = self.positions[np.repeat(self.starts[first] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] - rare[which, 0]
            ok = at >= 0
            which, at = which[ok], at[ok].astype(np.int64)
            for step in range(1, width):
                offset = rare[which, step]
                wanted = (codes[which, offset] << 32) | (at + offset)
                spot = np.searchsorted(self.ordered, wanted)
                ok = spot < len(self.ordered)
                ok[ok] = self.ordered[spot[ok]] == wanted[ok]
                which, at = which[ok], at[ok]
            inside = np.searchsorted(self.ends, at, side="right") == np.searchsorted(self.ends, at + width - 1, side="right")
            out.append((numbers[which[inside]], at[inside]))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def near(self, queries: Queries, slop: int) -> list[tuple[int, int, int]]:
        """(window number, start, end) of the shortest spans of at most its width plus slop words of one document that hold every distinct term of a window, one for each place of the rarest."""
        words, known = queries.known(self.codes(queries.vocabulary))
        out = set()
        for number in known.tolist():
            width, start = int(queries.width[number]), int(queries.start[number])
            codes = dict.fromkeys(words[start : start + width].tolist())
            lists = sorted((self.positions[self.starts[c] : self.term_ends[c]] for c in codes), key=len)
            most = width + slop
            for p in lists[0].tolist():
                doc = int(np.searchsorted(self.ends, p, side="right"))
                lo, hi = max(p - most + 1, int(self.ends[doc - 1]) if doc else 0), min(p + most - 1, int(self.ends[doc]) - 1)
                events = sorted((int(q), k) for k, x in enumerate(lists) for q in x[np.searchsorted(x, lo) : np.searchsorted(x, hi, side="right")])
                last: dict[int, int] = {}
                best = None
                for q, k in events:
                    last[k] = q
                    if len(last) == len(lists):
                        first = min(last.values())
                        if first <= p <= q and q - first < most and (best is None or q - first < best[1] - 1 - best[0]):
                            best = (first, q + 1)
                if best:
                    out.add((number, *best))
        return sorted(out)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            arrays = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("ends", "term_ends", "positions")}
            yield Segment({"segment": row["segment"].as_py(), "doc_ids": row["doc_ids"].as_py(), "terms": row["terms"].values, **arrays})


SPANS_SCHEMA = "segment bigint, k int, doc_id bigint, n_words bigint, starts array<bigint>, stops array<bigint>, items array<bigint>"
SPANS_ARROW = pa.schema([("segment", pa.int64()), ("k", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def search(index: DataFrame, queries: Queries | list[tuple], slop: int = 0, only_hits: bool = False) -> DataFrame:
    """For each document of the index (or each that is hit) its words hit as united spans [start, stop), word numbers of the document, and the items met.

    ``queries`` are ``Queries`` or a list of (words, ids), each one window.
    """
    shared = index.sparkSession.sparkContext.broadcast(queries if isinstance(queries, Queries) else Queries(queries))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for segment in _segments(batches):
            n = len(segment.doc_ids)
            which, at = segment.exact(queries)
            found = list(zip(which.tolist(), at.tolist(), (at + queries.width[which]).tolist(), strict=True))
            if slop:
                found += segment.near(queries, slop)
            spans: list[list] = [[] for _ in range(n)]
            items: list[set] = [set() for _ in range(n)]
            owner = np.searchsorted(segment.ends, [a for _, a, _ in found], side="right").tolist()
            for d, (k, a, b) in zip(owner, found, strict=True):
                spans[d].append((a, b))
                items[d].update(queries.ids[queries.item[k]])
            base = np.concatenate([[0], segment.ends[:-1]]).tolist() if n else []
            wanted = [d for d in range(n) if spans[d]] if only_hits else range(n)
            rows = [(segment.number, d, segment.doc_ids[d], int(segment.ends[d]) - base[d], [(a - base[d], b - base[d]) for a, b in united(spans[d])], sorted(items[d])) for d in wanted]
            columns = list(zip(*((*r[:4], [a for a, _ in r[4]], [b for _, b in r[4]], r[5]) for r in rows), strict=True)) or [[]] * len(SPANS_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, SPANS_ARROW, strict=True)], schema=SPANS_ARROW)

    return index.mapInArrow(find, SPANS_SCHEMA)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, item_id, item_text, window, block_bytes) -> Iterator[Queries]:
    """The benchmark's windows, collected in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield Queries([(words_of(r["text"]), [r["item"]]) for r in part.collect()], window)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """The rows of docs that no window of the benchmark occurs in: each task indexes a segment, searches it and lets it go, so that no index is stored and no text is shuffled. A pass for each block of the benchmark."""

    def cleaned(queries: Queries):
        shared = docs.sparkSession.sparkContext.broadcast(queries)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut(batches, text, SEGMENT_BYTES):
                ends, terms, term_ends, positions = _postings(batch.column(text))
                segment = Segment({"segment": 0, "doc_ids": [], "ends": ends, "terms": terms, "term_ends": term_ends, "positions": positions})
                hit = np.searchsorted(segment.ends, segment.exact(shared.value)[1], side="right")
                if len(hit):
                    left = np.ones(batch.num_rows, bool)
                    left[hit] = False
                    batch = batch.filter(pa.array(left))
                yield batch

        return clean

    small_batches(docs.sparkSession)
    left = docs
    for block, queries in enumerate(_blocks(benchmark, item_id, item_text, window, block_bytes)):
        left = (stored(left, "clean") if block else left).mapInArrow(cleaned(queries), docs.schema)
    return left


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, slop=0, block_bytes=BLOCK_BYTES) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items (ascending ids) and contaminated."""
    index = stored(build_index(docs, doc_id, text), "index")
    found, blocks = None, 0
    for queries in _blocks(benchmark, item_id, item_text, window, block_bytes):
        rows = search(index, queries, slop, only_hits=blocks > 0)
        found, blocks = rows if found is None else found.unionByName(rows), blocks + 1
    merged = lambda column: F.sort_array(F.array_distinct(F.flatten(F.collect_list(column))))
    if blocks > 1:
        spans = F.flatten(F.collect_list(F.arrays_zip("starts", "stops")))
        found = found.groupBy("segment", "k").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), merged("items").alias("items"))
    else:
        found = found.withColumn("spans", F.arrays_zip("starts", "stops"))
    # spans in order of their start: the words of each that no earlier span has
    state = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(
        "spans", state,
        lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0).cast("long"), x["stops"] - F.greatest(x["starts"], s["end"]))).alias("hit"), F.greatest(s["end"], x["stops"]).alias("end")),
        lambda s: s["hit"],
    )
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), "items")
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def digest_of_items(items):
    """Lower-case hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string")))), 256)


def op9_decontamination(spark, sf_dir):
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest_of_items("items").alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS g
  FROM (SELECT item_id, w[k:k + 9] AS x FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM t, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n
), m AS (
  SELECT dw.r, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r
), s AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""
