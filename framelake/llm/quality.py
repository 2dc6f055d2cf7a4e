"""Quality rules as weak supervision.

Each rule looks at a document's measures and votes good, bad or abstains. A
latent class model is fitted by expectation-maximisation: documents are good or
bad in one of a few ways (a way for each family of rules), each rule has its own
probability of a bad vote in each class, and rules are independent given the
class. The posterior probability of "good" decides, instead of a filter that
every rule has to pass.

At scale: measuring is a map over Arrow batches. The fit needs only how often
each combination of votes occurs: at most 3 to the number of rules, whatever
the corpus, counted over all documents with partial aggregation. The posterior
is then a sum of constants in plain expressions.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: null and empty texts have no
words, and fail the base rule; so do all documents of fewer than 10 words; a
table without votes is scored by the prior start values; ties at the threshold
are kept; repeated documents each count; extra columns stay untouched in
``quality_filter`` and are ignored in ``quality_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mixed, raw, scratch, stored, texts_of, windows_hash

BATCH_BYTES = 1 << 20
SPACES = b"\t\n\x0b\x0c\r "
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
KEEP_FROM = 0.5
PRIOR_VOTES = 10
LEAST_ERROR = 0.01
LEAST_FOUND = 0.3


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


UPPER, LETTER, MARKS = _table(bytes(range(65, 91))), _table(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)])), _table(b"!?")
BLANK, SIGN, CLOSING = _table(SPACES), _table(SYMBOLS), _table(b".!?\"'):;")
FIRST = _table(bytes([*range(0x80), *range(0xC0, 0x100)]))
"""Bytes that begin a code point."""


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, width: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows of ``width`` words that occur at least twice in the text; 64-bit hashes of the batch's word numbers tell windows apart."""
    owner, n = words.owner(), len(words.codes)
    if n < width:
        return np.zeros(len(words.offsets) - 1, np.int64)
    starts = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    keys = mixed(windows_hash(mixed(words.codes), width)[starts] ^ mixed(owner[starts].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[starts[again] + k] = True
    return _sums(covered, words.offsets)


def lines_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its lines with a word: how many, how many equal an earlier one, and how many end a sentence."""
    split = pc.split_pattern(texts, "\n")
    flat, ends = split.values, split.offsets.to_numpy().astype(np.int64)
    data, offsets = raw(texts_of(pc.ascii_trim(flat, characters=" \t\x0b\x0c\r")))
    worded = offsets[1:] > offsets[:-1]
    closed = worded.copy()
    closed[worded] = CLOSING[data[offsets[1:][worded] - 1]]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    coded = flat.dictionary_encode()
    keys = np.sort((owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False))[worded])
    again = keys[1:][keys[1:] == keys[:-1]] // max(1, len(coded.dictionary))
    return _sums(worded, ends), np.bincount(again, minlength=len(texts)), _sums(closed, ends)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a batch."""
    texts = texts_of(column)
    words = Words(texts)
    data, offsets = raw(texts)
    first = FIRST[data] & ~BLANK[data]
    n_lines, n_dup_lines, n_ended = lines_of(texts)
    known = max(1, len(words.dictionary))
    pairs = np.sort(words.owner() * known + words.codes)
    distinct = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]] // known
    letters = LETTER[data]
    spelled, ends = raw(words.dictionary)
    lettered = (_sums(LETTER[spelled], ends) > 0)[words.codes]
    return {
        "n_words": words.counts(), "word_chars": _sums(first, offsets), "n_symbols": _sums(SIGN[data], offsets), "n_dup_lines": n_dup_lines,
        "n_repeat_words": repeated_words(words), "n_lines": n_lines, "n_ended": n_ended, "n_upper": _sums(UPPER[data], offsets),
        "n_letters": _sums(letters, offsets), "n_marks": _sums(MARKS[data], offsets), "n_distinct": np.bincount(distinct, minlength=len(texts)), "n_lettered": _sums(lettered, words.offsets),
    }


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """1 good, -1 bad, 0 abstains, for each rule and text."""
    n = np.maximum(m["n_words"], 1)
    size, letters, lines = m["word_chars"] / n, np.maximum(m["n_letters"], 1), np.maximum(m["n_lines"], 1)
    spoken = m["n_words"] >= 30
    return {
        "symbols": _vote((m["n_symbols"] > 0.1 * n) & (m["n_symbols"] >= 3), m["n_symbols"] <= 0.02 * n),
        "letters": _vote(m["n_letters"] < 0.75 * m["word_chars"], m["n_letters"] > 0.85 * m["word_chars"]),
        "bare_words": _vote(m["n_lettered"] < 0.8 * n, m["n_lettered"] > 0.95 * n),
        "upper": _vote(m["n_upper"] > 0.4 * letters, m["n_upper"] < 0.15 * letters),
        "marks": _vote(m["n_marks"] > 0.2 * n, m["n_marks"] < 0.05 * n),
        "word_size": _vote((size < 2.5) | (size > 12), (size > 3) & (size < 10)),
        "repeats": _vote(m["n_repeat_words"] > 0.2 * n, m["n_repeat_words"] <= 0.02 * n),
        "distinct": _vote(spoken & (m["n_distinct"] < 0.15 * n), spoken & (m["n_distinct"] > 0.35 * n)),
        "lines": _vote(m["n_dup_lines"] > 0.3 * lines, (m["n_lines"] >= 3) & (m["n_dup_lines"] == 0)),
        "sentences": _vote((m["n_lines"] >= 3) & (m["n_ended"] < 0.2 * lines), m["n_ended"] >= 0.6 * lines),
    }


RULES = tuple(votes({k: np.zeros(0) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters", "n_marks", "n_distinct", "n_lettered")}))


FAMILIES = (("symbols", "letters", "bare_words"), ("upper", "marks"), ("repeats", "distinct", "lines"), ("word_size", "sentences"))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, tolerance: float = 1e-10) -> dict:
    """Expectation-maximisation over (votes, how often they occur).

    Returns the probability of each class, "good" first, and in each class the
    probability of each rule's bad vote. A rule that abstains says nothing. The
    start is that a rule errs with one good document in twenty, and votes bad on
    half of the documents that are bad in the way its family looks for;
    ``PRIOR_VOTES`` votes of that kind are added to the counts, so that no
    probability becomes 0 and the classes cannot trade places. No rule is taken
    to err with fewer than ``LEAST_ERROR`` of the good documents, so that one bad
    vote alone does not condemn a document that all other rules find good; and in
    its own way of being bad each rule of the family votes bad on at least
    ``LEAST_FOUND``, which ties every class to its family.
    """
    start = np.full((1 + len(FAMILIES), len(RULES)), 0.05)
    for k, family in enumerate(FAMILIES):
        start[k + 1, [RULES.index(r) for r in family]] = 0.5
    table, share = start.copy(), np.array([0.8] + [0.2 / len(FAMILIES)] * len(FAMILIES))
    if patterns:
        seen = np.array([p for p, _ in patterns], np.int64)
        weight = np.array([n for _, n in patterns], float)
        bad, good = (seen < 0).astype(float), (seen > 0).astype(float)
        before = -np.inf
        for _ in range(rounds):
            each = np.log(share) + bad @ np.log(table).T + good @ np.log(1 - table).T
            both = np.logaddexp.reduce(each, axis=1)
            given = np.exp(each - both[:, None]) * weight[:, None]
            likely = float((weight * both).sum() / weight.sum())
            share = (given.sum(0) + 1) / (weight.sum() + len(share))
            table = (given.T @ bad + PRIOR_VOTES * start) / (given.T @ (bad + good) + PRIOR_VOTES)
            table = np.maximum(table, LEAST_ERROR)
            table[start == 0.5] = np.maximum(table[start == 0.5], LEAST_FOUND)
            if abs(likely - before) < tolerance:
                break
            before = likely
    return {"classes": share.tolist(), "bad_votes": table.tolist()}


def posterior(model: dict, cast: np.ndarray) -> np.ndarray:
    """The probability of "good" for rows of votes."""
    table = np.array(model["bad_votes"])
    each = np.log(model["classes"]) + (cast < 0) @ np.log(table).T + (cast > 0) @ np.log(1 - table).T
    return np.exp(each[:, 0] - np.logaddexp.reduce(each, axis=1))


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in MEASURES) + ", base_failed boolean, votes string"


def measured(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One narrow row per document: measures, base_failed, and the votes as one letter per rule (b, a, g)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, "text", BATCH_BYTES):
            m = measure(batch.column("text"))
            letters = np.stack(list(votes(m).values()), 1) + 1
            said = np.array([b"bag"], "S3").view("S1")[letters].view(f"S{letters.shape[1]}").ravel().astype(str)
            columns = [batch.column("doc_id"), *(pa.array(m[c], pa.int64()) for c in MEASURES), pa.array(base_failed(m)), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *MEASURES, "base_failed", "votes"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, MEASURED_SCHEMA)


def fitted(rows: DataFrame) -> dict:
    """The model of stored measured rows."""
    counts = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(RULES) rows
    return fit(sorted((tuple("bag".index(c) - 1 for c in r["votes"]), r["n"]) for r in counts))


def quality_scores(docs: DataFrame, doc_id="doc_id", text="text", keep_from=KEEP_FROM) -> DataFrame:
    """doc_id, the measures, base_failed, p_good and kept (false if base_failed, else p_good >= keep_from)."""
    rows = stored(measured(docs, doc_id, text), "measured")
    model = fitted(rows)
    likely = []
    for share, table in zip(model["classes"], model["bad_votes"], strict=True):
        terms = F.lit(float(np.log(share)))
        for k, p in enumerate(table):
            letter = F.substring("votes", k + 1, 1)
            terms = terms + F.when(letter == "b", float(np.log(p))).when(letter == "g", float(np.log(1 - p))).otherwise(0.0)
        likely.append(terms)
    good = 1 / (1 + sum((F.exp(x - likely[0]) for x in likely[1:]), F.lit(0.0)))
    return rows.withColumn("p_good", good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))


def quality_filter(docs: DataFrame, doc_id="doc_id", text="text", keep_from=KEEP_FROM) -> DataFrame:
    """The rows of docs that are kept, unchanged; the model is fitted to all rows first."""
    with scratch(docs.sparkSession):
        model = fitted(stored(measured(docs, doc_id, text), "measured"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, text, BATCH_BYTES):
            m = measure(batch.column(text))
            good = posterior(model, np.stack(list(votes(m).values()), 1)) >= keep_from
            yield batch.filter(pa.array(good & ~base_failed(m)))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality(spark, sf_dir):
    rows = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", *MEASURES, "base_failed", "kept", "p_good")
