"""Substring dedup with suffix arrays.

Removed is every byte that a string of ``length`` bytes covers which also starts
anywhere else in the corpus.

1. *Anchors.* In every window of ``length`` bytes the gram of ``GRAM`` bytes with
   the least hash (the rightmost of equals) is the window's anchor. Equal windows
   have equal anchors at equal offsets, so a window whose anchor gram occurs only
   once cannot repeat. One scan leaves about one anchor per 170 bytes.
2. *Shards.* Texts with a repeated anchor are ordered by their least repeated
   anchor, so that texts that share passages come together. Only the zones of
   repeated anchors are looked at; a shard holds a bounded number of their bytes,
   and a long text's zones go to several shards.
3. *Suffix arrays.* In each shard Larsson-Sadakane refinement sorts the suffixes
   of the zones: groups of suffixes that agree on h bytes are split by the groups
   of the suffixes h bytes further on, h doubles, and groups of one are left
   alone. Kasai's recurrence (each common prefix is at least the one of the
   suffix before, less one) gives the common prefixes of neighbours; only where
   it does not already tell the value are bytes compared. Runs of neighbours that
   share ``length`` bytes are the shard's repeats.
4. *Merging.* A window whose anchor also occurs in other shards goes, once per
   shard, with a 128-bit fingerprint and in fingerprint order, to the merge: each
   shard's sorted list is cut at the borders of the ranges by binary search, and
   in each range every list is looked up by binary search among the fingerprints
   that several shards have. Windows whose anchors are all in the shard are done.
   With many shards, groups of them are merged before the ranges are.

At scale: copies collapse to one text before anything else (a text with a second
copy is covered as a whole); anchors and fingerprints of a hot passage are summed
with partial aggregation (counts of hot anchors reach their rows by a bounded
broadcast), or arrive once per shard and range and are brought together in groups
of ``SALT_SHARDS`` shards first; the text moves twice, and only where it has a
repeated anchor the second time; range count follows from the number of
fingerprints. A task holds one text and the working arrays of a piece
(60 bytes for each of its bytes), a shard (55 bytes a byte) or a range.

Edge cases: null texts are empty; an empty table gives no rows; a text of fewer
than ``length`` bytes keeps all bytes, copies of it too; matches never cross
documents; overlapping occurrences in one text count; a long text is read in
overlapping pieces and takes part in several shards; repeated rows are copies;
ties need no order, since all occurrences are removed; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, mixed, raw, release, scratch, stored, texts_of, with_counts

LENGTH, GRAM = 400, 64
BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
RANGE_WINDOWS, ROW_WINDOWS = 500_000, 1 << 16
SALT_SHARDS = 4096
PLACE_BITS = 24  # places in a piece
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_VALUES = np.random.default_rng(9).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEPARATOR = 0xFF  # never a byte of UTF-8


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive bytes: differences of prefix sums of random values times powers of an odd base."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    sums = np.full(len(data) + 1, base, np.uint64)
    sums[0], sums[1] = 0, 1
    np.cumprod(sums[1:], out=sums[1:])
    sums[1:] *= _VALUES[which][data]
    np.cumsum(sums, out=sums)
    out = sums[width:] - sums[:n]
    back = sums[:n]
    back[:] = pow(base, -1, 1 << 64)
    back[0] = 1
    np.cumprod(back, out=back)
    out *= back
    return mixed(out)


def _anchors_of_piece(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, place, hash, first window, last window) of the anchors of the windows that start in [lo, hi); all places in data."""
    hashes = rolling(data[lo : hi + length - 1], gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    places = (mask - (least & mask)).astype(np.int32)
    del least
    first, stop = np.maximum(offsets[:-1], lo), np.minimum(offsets[1:] - length + 1, hi)
    texts = np.flatnonzero(stop > first)
    first, counts = first[texts], (stop - first)[texts]
    owner = np.repeat(texts, counts)
    starts = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    at = places[starts - lo]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]])[: len(head)] - 1
    return owner[head], at[head].astype(np.int64) + lo, hashes[at[head]], starts[head], starts[tail]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE_BYTES) -> tuple[np.ndarray, ...]:
    """(text number, hash, first window, last window) of each anchor; windows by their start in the text.

    Works on overlapping pieces, so that memory does not grow with a text; the
    anchor of a window does not depend on the piece.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = len(data) - length + 1
    parts = [_anchors_of_piece(data, offsets, lo, min(lo + piece, windows), length, gram) for lo in range(0, windows, piece)]
    owner, at, hashes, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])  # an anchor's windows can be on both sides of a border
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(at)]])[: len(head)] - 1
    owner = owner[head]
    return owner, hashes[head], first[head] - offsets[owner], last[tail] - offsets[owner]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) by Larsson-Sadakane refinement, both of 32 bits."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(8)
        key[: max(0, n - k)] |= data[k:]
    key <<= np.uint64(8)
    # the number of bytes left, up to 7, orders suffixes that end before the others differ
    key |= np.minimum(np.arange(n, 0, -1, dtype=np.int32), 7).astype(np.uint8)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    same = key[1:] == key[:-1]
    del key
    start = np.arange(n, dtype=np.int32)
    start[1:][same] = 0
    np.maximum.accumulate(start, out=start)
    rank = np.empty(n, np.int32)
    rank[order] = start
    del start
    tied = np.zeros(n, bool)
    tied[1:] |= same
    tied[:-1] |= same
    active, h = np.flatnonzero(tied).astype(np.int32), 7
    while len(active):
        suffix = order[active]
        both = rank[suffix].astype(np.int64)
        both *= n + 1
        further = suffix + np.int32(h)
        inside = further < n
        both[inside] += rank[further[inside]] + np.int32(1)
        del further, inside
        by = np.argsort(both).astype(np.int32)
        suffix, both = suffix[by], both[by]
        del by
        order[active] = suffix
        same = both[1:] == both[:-1]
        del both
        start = active.copy()
        start[1:][same] = 0
        rank[suffix] = np.maximum.accumulate(start, out=start)
        tied = np.zeros(len(active), bool)
        tied[1:] |= same
        tied[:-1] |= same
        active = active[tied]
        h = min(2 * h, n)
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the bytes it shares with the suffix before it in the suffix array.

    Kasai's recurrence: with equal bytes before both, the value is exactly one
    less than that of the suffix one byte earlier; elsewhere bytes are compared.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    told = np.zeros(n, bool)
    told[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (data[:-1] == data[np.maximum(before[1:], 1) - 1])
    told[1:] &= before[:-1] == before[1:] - 1
    shared = np.zeros(n, np.int32)
    left = np.flatnonzero(~told & (before >= 0)).astype(np.int32)
    a, b = left, before[left]
    del before
    eight = np.zeros(n, np.uint64)
    for k in range(min(8, n)):
        eight[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    while len(a):
        equal = (eight[a] == eight[b]) & (np.maximum(a, b) + 8 <= n)
        rest = ~equal
        if rest.any():
            x, y = a[rest], b[rest]
            more = np.zeros(len(x), np.int32)
            open_ = np.ones(len(x), bool)
            for k in range(8):
                open_ &= np.maximum(x, y) + k < n
                open_ &= data[np.minimum(x + k, n - 1)] == data[np.minimum(y + k, n - 1)]
                more += open_
            shared[left[rest]] += more
        left, a, b = left[equal], a[equal] + np.int32(8), b[equal] + np.int32(8)
        shared[left] += 8
        inside = (a < n) & (b < n)
        left, a, b = left[inside], a[inside], b[inside]
    del eight
    i = np.arange(n, dtype=np.int32)
    source = np.maximum.accumulate(np.where(told, np.int32(0), i))
    return np.where(told, shared[source] - (i - source), shared)


def _united(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans, in order of their starts, as one."""
    if not len(starts):
        return starts, stops
    reach = np.maximum.accumulate(stops)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return starts[first], reach[np.concatenate([first[1:], [len(starts)]]) - 1]


class Unit:
    """Zones of repeated anchors of one text: what a shard holds of it."""

    def __init__(self, text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
        self.hashes, self.counts, self.first, self.last = hashes, counts, first, last
        self.starts, self.stops = _united(first, last + length)
        gap = np.array([SEPARATOR], np.uint8)
        self.data = np.concatenate([x for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True) for x in (text[a:b], gap)])


def units_of(text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, most: int) -> Iterator[Unit]:
    """The zones of a text as units of about ``most`` bytes; a long text makes several, which share only the bytes of windows that cross a cut."""
    by = np.argsort(first)
    hashes, counts, first, last = hashes[by], counts[by], first[by], last[by]
    reach = np.concatenate([[0], last[:-1] + length])
    piece = np.cumsum(last + length - np.maximum(first, reach) + 1) // most
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)], strict=True):
        yield Unit(text, hashes[a:b], counts[a:b], first[a:b], last[a:b], length)


def shard_repeats(units: list[Unit], length: int = LENGTH) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
    """A shard's own repeats and what it sends to the merge.

    Returns the spans of each unit, and (two fingerprints, unit number, window,
    whether an answer is wanted) of the windows for the merge.
    """
    own, number = np.unique(np.concatenate([u.hashes for u in units]), return_inverse=True)
    occurrences = np.bincount(number, minlength=len(own))
    windows_at, windows_unit, windows_start, windows_open, total = [], [], [], [], 0
    for t, unit in enumerate(units):
        elsewhere = occurrences[np.searchsorted(own, unit.hashes)] < unit.counts
        zone = np.searchsorted(unit.starts, unit.first, side="right") - 1
        base = total + np.concatenate([[0], np.cumsum(unit.stops - unit.starts + 1)[:-1]])
        total += len(unit.data)
        sizes = unit.last - unit.first + 1
        at = np.repeat(unit.first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        windows_at.append((at - np.repeat(unit.starts[zone] - base[zone], sizes)).astype(np.int32))
        windows_start.append(at)
        windows_unit.append(np.full(len(at), t, np.int32))
        windows_open.append(np.repeat(elsewhere, sizes))
    data = np.concatenate([u.data for u in units])
    order, rank = suffix_array(data)
    shared = common_prefixes(data, order, rank)
    close = shared[order] >= length
    del shared
    head = np.arange(len(order), dtype=np.int32)
    head[close] = 0
    np.maximum.accumulate(head, out=head)
    again = close.copy()
    again[:-1] |= close[1:]
    del order, close
    at, unit, start, elsewhere = map(np.concatenate, (windows_at, windows_unit, windows_start, windows_open))
    del windows_at, windows_unit, windows_start, windows_open
    place = rank[at]
    del rank
    repeated = again[place]
    borders = np.searchsorted(unit, np.arange(len(units) + 1))
    spans = []
    for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        mine = start[lo:hi][repeated[lo:hi]]
        spans.append(_united(mine, mine + length))
    # once per shard: windows without a repeat here, and of each class of repeats the first member that a merge may concern
    send = np.flatnonzero(elsewhere)
    _, once = np.unique(head[place[send]], return_index=True)
    del head, place
    send = send[once]
    at = at[send]
    return spans, (rolling(data, length, 0)[at], rolling(data, length, 1)[at], unit[send].astype(np.int64), start[send], ~repeated[send])


SCAN_SCHEMA = "doc_id bigint, key binary, n_bytes bigint, hashes array<bigint>, first array<bigint>, last array<bigint>"
ANSWER_SCHEMA = "shard string, number bigint, window bigint"
SHARD_SCHEMA = "shard string, keys array<binary>, texts array<int>, starts array<bigint>, stops array<bigint>, high array<bigint>, low array<bigint>, places array<bigint>"
SHARD_ARROW = pa.schema([("shard", pa.string()), ("keys", pa.list_(pa.binary())), ("texts", pa.list_(pa.int32())), *((c, pa.list_(pa.int64())) for c in ("starts", "stops", "high", "low", "places"))])


def scanned(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """One narrow row per document: the SHA-256 of its text, its bytes and its anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            data, offsets = raw(texts_of(batch.column("text")))
            owner, hashes, first, last = anchors(data, offsets, length)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (hashes.view(np.int64), first, last)]
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(offsets)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_bytes", "hashes", "first", "last"])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("key")).mapInArrow(scan, SCAN_SCHEMA)


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """The values of an array column, row by row, as views of one buffer."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def sharded(candidates: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """For each shard of the stored candidates a row with its units' keys and spans, and rows of at most ``ROW_WINDOWS`` sorted fingerprints for the merge."""

    def shard(keys: list[bytes], units: list[Unit]) -> Iterator[pa.RecordBatch]:
        spans, (high, low, unit, start, wanted) = shard_repeats(units, length)
        by = np.argsort(high)
        place = np.where(wanted, (unit << 32) | start, -1)[by]
        high, low = high[by].view(np.int64), low[by].view(np.int64)
        number = np.repeat(np.arange(len(units)), [len(a) for a, _ in spans])
        name = hashlib.sha256(b"".join(keys) + np.array([u.first[0] for u in units]).tobytes()).hexdigest()
        rows = [(name, keys, number, np.concatenate([a for a, _ in spans]), np.concatenate([b for _, b in spans]), [], [], [])]
        rows += [(name, [], [], [], [], *(v[a : a + ROW_WINDOWS] for v in (high, low, place))) for a in range(0, len(high), ROW_WINDOWS)]
        for row in rows:  # a batch each: none is large in the JVM
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units, size = [], [], 0
        for batch in cut(batches, "text", shard_bytes):
            data, offsets = raw(texts_of(batch.column("text")))
            for k, found in enumerate(zip(*(_lists(batch, c) for c in ("hashes", "counts", "first", "last")), strict=True)):
                for unit in units_of(data[offsets[k] : offsets[k + 1]], *found, length, shard_bytes):
                    if units and size + len(unit.data) > shard_bytes:
                        yield from shard(keys, units)
                        keys, units, size = [], [], 0
                    keys.append(batch.column("key")[k].as_py())
                    units.append(unit)
                    size += len(unit.data)
        if units:
            yield from shard(keys, units)

    return candidates.select("key", "text", "hashes", "counts", "first", "last").mapInArrow(work, SHARD_SCHEMA)


def _many(high: np.ndarray, low: np.ndarray, several: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct fingerprints in order, and which of them come more than once or are marked as such."""
    by = np.lexsort((low, high))
    high, low = high[by], low[by]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(high))) > 1
    if several is not None and len(first):
        many |= np.logical_or.reduceat(several[by], first)
    return high[first], low[first], many


def _answers(table: pa.Table, high: np.ndarray, low: np.ndarray) -> pa.Table:
    """(shard, number, window) of the places that ask, in lists whose fingerprints are among the given sorted ones."""
    out: list[list[np.ndarray]] = [[], [], []]
    for k, (own_high, own_low, places) in enumerate(zip(*(_lists(table, c) for c in ("high", "low", "places")), strict=True)):
        own_high, own_low = own_high.view(np.uint64), own_low.view(np.uint64)
        first, last = np.searchsorted(high, own_high), np.searchsorted(high, own_high, side="right")
        hit = np.zeros(len(own_high), bool)
        while len(open_ := np.flatnonzero(~hit & (first < last))):
            hit[open_] = low[first[open_]] == own_low[open_]
            first[open_] += 1
        found = places[hit & (places >= 0)]
        for column, v in zip(out, (np.full(len(found), k, np.int32), found >> 32, found & 0xFFFFFFFF), strict=True):
            column.append(v)
    index, number, window = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return pa.table([table.column("shard").combine_chunks().cast(pa.string()).take(pa.array(index)), pa.array(number), pa.array(window)], ["shard", "number", "window"])


def merged(shards: DataFrame, salt_shards: int = SALT_SHARDS) -> DataFrame:
    """(shard, unit number, window) of the windows that other shards have too.

    A fingerprint of a hot passage comes once from every shard. Beyond
    ``salt_shards`` shards, lists of one range are therefore first brought
    together in groups of shards, which leave each fingerprint once and whether
    several lists have it; a range then joins what its groups left.
    """
    total, n_shards = shards.agg(F.sum(F.size("high")), F.count_distinct("shard")).first()
    bits = max(0, ((total or 0) // RANGE_WINDOWS).bit_length())
    salts = -(-n_shards // salt_shards)
    lists = "high array<bigint>, low array<bigint>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
        for batch in batches:
            for shard, high, low, places in zip(batch.column("shard").to_pylist(), *(_lists(batch, c) for c in ("high", "low", "places")), strict=True):
                cuts = [0, *np.searchsorted(high.view(np.uint64), borders).tolist(), len(high)]
                rows = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                values = ([r for r, _, _ in rows], [shard] * len(rows), *([v[a:b] for _, a, b in rows] for v in (high, low, places)))
                types = (pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["range", "shard", "high", "low", "places"])

    def of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tuple(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("high", "low"))

    def merge(table: pa.Table) -> pa.Table:
        high, low, many = _many(*of(table))
        return _answers(table, high[many], low[many])

    def group(table: pa.Table) -> pa.Table:
        high, low, many = _many(*of(table))
        return pa.table([table.column("range").slice(0, 1).combine_chunks(), *(pa.array([v.view(np.int64)], pa.list_(pa.int64())) for v in (high, low)), pa.array([many], pa.list_(pa.bool_()))], ["range", "high", "low", "several"])

    def join(table: pa.Table) -> pa.Table:
        high, low, many = _many(*of(table), table.column("several").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        return pa.table([table.column("range").slice(0, 1).combine_chunks(), *(pa.array([v[many].view(np.int64)], pa.list_(pa.int64())) for v in (high, low))], ["range", "high", "low"])

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        return _answers(table, *of(known))

    dealt = shards.select("shard", "high", "low", "places").mapInArrow(deal, f"range bigint, shard string, {lists}, places array<bigint>")
    if salts <= 1:
        return dealt.groupBy("range").applyInArrow(merge, ANSWER_SCHEMA)
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)))
    groups = dealt.groupBy("range", "salt").applyInArrow(group, f"range bigint, {lists}, several array<boolean>")
    known = groups.groupBy("range").applyInArrow(join, f"range bigint, {lists}")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.groupBy("range", "salt").cogroup(known.groupBy("range", "salt")).applyInArrow(answer, ANSWER_SCHEMA)


def united_windows(found: DataFrame, length: int) -> DataFrame:
    """Windows (shard, number, window) as united spans (shard, number, starts, stops) of each unit."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_united(w, w + length) for w in map(np.sort, _lists(batch, "windows"))]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("number"), *(pa.array([x[k] for x in spans], pa.list_(pa.int64())) for k in range(2))], ["shard", "number", "starts", "stops"])

    return found.groupBy("shard", "number").agg(F.collect_list("window").alias("windows")).mapInArrow(unite, "shard string, number bigint, starts array<bigint>, stops array<bigint>")


def repeats(docs: DataFrame, doc_id="doc_id", text="text", length=LENGTH, shard_bytes=SHARD_BYTES, salt_shards=SALT_SHARDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs as arrays starts and stops."""
    spark = docs.sparkSession
    with scratch(spark) as own:
        found = stored(scanned(docs, doc_id, text, length), "anchors")
        rows = own.keep(stored(found.select("doc_id", "key", "n_bytes"), "documents"))
        texts = found.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("first_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("hashes", "first", "last")))
        unique = stored(texts, "text-anchors")
        texts = own.keep(stored(unique.select("key", "copies"), "texts"))
        dropped(found)
        release(spark)
        found = unique.select("key", "first_id", F.explode(F.arrays_zip("hashes", "first", "last")).alias("a")).select("key", "first_id", "a.*")
        many = stored(found.groupBy("hashes").agg(F.count("*").alias("counts")).where("counts > 1"), "anchor-counts")
        known = with_counts(found, many, "hashes")
        known = known.groupBy("key", "first_id").agg(F.min("hashes").alias("least"), *(F.collect_list(c).alias(c) for c in ("hashes", "counts", "first", "last")))
        known = stored(known.withColumnRenamed("key", "known_key"), "repeated-anchors")
        dropped(unique, many)
        release(spark)

        body = F.coalesce(F.col(text), F.lit(""))
        source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))).alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("key")).where(F.octet_length("text") >= length)
        candidates = source.join(known, (source["doc_id"] == known["first_id"]) & (source["key"] == known["known_key"]))
        candidates = candidates.select("key", "text", "least", "hashes", "counts", "first", "last").repartitionByRange("least", "key").sortWithinPartitions("least", "key")
        candidates = stored(candidates, "candidates")
        dropped(known)
        release(spark)
        shards = stored(sharded(candidates, length, shard_bytes), "shards")
        elsewhere = stored(merged(shards, salt_shards), "merged")
        release(spark)
        keys = shards.select("shard", F.posexplode("keys").alias("number", "key"))
        here = shards.select("shard", F.explode(F.arrays_zip("texts", "starts", "stops")).alias("s")).select("shard", F.col("s.texts").cast("long").alias("number"), "s.starts", "s.stops")
        here = here.groupBy("shard", "number").agg(F.collect_list("starts").alias("starts"), F.collect_list("stops").alias("stops"))
        spans = here.unionByName(united_windows(elsewhere, length))
        spans = spans.join(keys, ["shard", "number"]).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut(batches, "text"):
                out = []
                whole, offsets = raw(texts_of(batch.column("text")))
                for k, (key, starts, stops) in enumerate(zip(batch.column("key").to_pylist(), _lists(batch, "starts"), _lists(batch, "stops"), strict=True)):
                    by = np.argsort(starts)
                    starts, stops = _united(starts[by], stops[by])
                    data = whole[offsets[k] : offsets[k + 1]]
                    kept = b"".join(data[a:b].data for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(data)], strict=True))
                    out.append((key, len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, stops))
                types = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])

        done = candidates.select("key", "text").join(spans, "key").mapInArrow(finish, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, stops array<bigint>")
        done = own.keep(stored(done.dropDuplicates(["key"]), "trimmed"))
    per_text = texts.select("key", "copies").join(done, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", "key", "n_bytes").join(per_text, "key").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("stops", none)).alias("stops"),
    )


def op1_suffixes(spark, sf_dir):
    rows = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, encode(coalesce(text, '')) AS raw, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), w AS (
  SELECT r, k, md5(raw[k + 1:k + 400]) AS g FROM d, unnest(range(0, n - 399)) AS u(k) WHERE n >= 400
), s AS (
  SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS p FROM (SELECT r, k, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1
), i AS (
  SELECT r, k, sum(CASE WHEN p IS NULL OR k - p > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS run FROM s
), e AS (
  SELECT r, run, min(k) AS a, max(k) + 400 AS b FROM i GROUP BY r, run
), g AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM e
), k AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(d.x, 2 * last + 1)) AS kept
  FROM (SELECT g.*, max(b) OVER (PARTITION BY r) AS last FROM g) JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
