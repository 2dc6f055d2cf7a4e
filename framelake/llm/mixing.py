"""Mixing sources to target weights [DataFrame functions only].

Tokens are summed per source, sources get targets by weight, a source's
repetition rate is target / size, and each document is emitted floor(rate)
times plus once more with probability rate - floor(rate), drawn from a hash of
its id and a seed.

Sources are ranked by the order of their UTF-8 bytes (nulls last) and weigh
``weights`` in turn. Together they share all tokens; a target stops at
``max_repeat`` times its source's size and the excess goes to the others by
weight, until none is above. This water filling needs one pass over the sources
in the order of size / weight: with the first k at their limits the others
share what is left, and the level is that of the first source below its limit.

At scale: documents are summed with partial aggregation, so a source with a
third of all rows is no heavier than any other. Only the source table (one row
per source, three numbers each) passes through a single task, as a streaming
window. The way back is an equi-join on the source that Spark broadcasts if the
table is under its broadcast limit, and else splits where a source is skewed.

Edge cases: a null text has size 0; a null source is a source of its own, last
in rank; a source of size 0 has target 0 and emits nothing; documents with equal
ids draw equal numbers, so repeated rows behave alike; a null id is drawn as
the empty string; an empty table gives an empty result; further columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``: each word and the white space around it becomes one letter."""
    letters = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 60 bits of MD5(seed:id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").cast("double") / F.lit(float(1 << 60))


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """From rows with a source and a size: (__mix_source, __mix_n, __mix_target), one row per source."""
    ranked = Window.orderBy(F.col("__mix_source").asc_nulls_last())
    by = (
        sizes.groupBy(F.col(source).alias("__mix_source"))
        .agg(F.sum(size).alias("__mix_n"))
        .withColumn("__mix_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")))
        .withColumn("__mix_cap", F.col("__mix_n") * F.lit(max_repeat))
    )
    total = by.agg(F.sum("__mix_n").alias("__mix_total"), F.sum("__mix_w").alias("__mix_weight"))
    filled = Window.orderBy((F.col("__mix_cap") / F.col("__mix_w")).asc(), F.col("__mix_source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("__mix_total") - F.coalesce(F.sum("__mix_cap").over(before), F.lit(0))).cast("double")
    free = F.col("__mix_weight") - F.coalesce(F.sum("__mix_w").over(before), F.lit(0.0))
    rows = by.crossJoin(F.broadcast(total)).select("*", left.alias("__mix_left"), free.alias("__mix_free"))
    rows = rows.withColumn("__mix_below", F.col("__mix_left") * F.col("__mix_w") <= F.col("__mix_cap").cast("double") * F.col("__mix_free"))
    since = filled.rowsBetween(Window.unboundedPreceding, 0)
    first = F.struct("__mix_left", "__mix_free")
    level = F.first(F.when(F.col("__mix_below"), first), ignorenulls=True).over(since)
    rows = rows.withColumn("__mix_level", level)
    share = F.col("__mix_level.__mix_left") * F.col("__mix_w") / F.col("__mix_level.__mix_free")
    target = F.when(F.col("__mix_level").isNull(), F.col("__mix_cap").cast("double")).otherwise(share)
    return rows.select("__mix_source", "__mix_n", target.alias("__mix_target"))


def with_copies(docs: DataFrame, doc_id: str, source: str, size: str, weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED) -> DataFrame:
    """docs with __mix_n and __mix_target of its source, and __mix_copies, the times the mix takes the document."""
    targets = source_targets(docs, source, size, weights, max_repeat)
    joined = docs.join(targets, docs[source].eqNullSafe(targets["__mix_source"]), "left").drop("__mix_source")
    rate = F.col("__mix_target") / F.when(F.col("__mix_n") > 0, F.col("__mix_n"))
    whole = F.floor(rate)
    copies = whole + (draw(F.col(doc_id), seed) < rate - whole).cast("long")
    return joined.withColumn("__mix_copies", F.least(F.coalesce(copies, F.lit(0)), F.lit(max_repeat)).cast("long"))


def mix_plan(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken (copies x size)."""
    from .common import stored

    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("__mix_size")), "sizes")
    rows = with_copies(sized, "doc_id", "source", "__mix_size", weights, max_repeat, seed)
    return rows.select(
        "doc_id", "source", F.col("__mix_size").alias("size"), F.col("__mix_n").alias("source_size"), F.col("__mix_target").alias("target"),
        F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
    )


def mix_documents(docs: DataFrame, doc_id="doc_id", source="source", text="text", weights=WEIGHTS, max_repeat=MAX_REPEAT, seed=SEED) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its own columns and no others."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # helper names cannot meet the caller's
    sized = docs.select(whole.alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("__mix_size"))
    rows = with_copies(sized, "id", "source", "__mix_size", weights, max_repeat, seed).where("__mix_copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select("row.*")


def op10_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP10_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), r AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s GROUP BY source
), w AS (
  SELECT source, n, 3 * n AS cap, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM r
), f AS (
  SELECT *, ((SELECT sum(n) FROM w) - coalesce(sum(cap) OVER b, 0))::DOUBLE AS lft,
    (SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0.0) AS free,
    row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS k
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT lft AS l_left, free AS l_free, k AS l_k FROM f WHERE lft * w <= cap::DOUBLE * free ORDER BY k LIMIT 1
), t AS (
  SELECT source, n, CASE WHEN l_k IS NULL OR k < l_k THEN cap::DOUBLE ELSE l_left * w / l_free END AS target FROM f LEFT JOIN l ON true
), c AS (
  SELECT s.*, t.n, t.target, t.target / nullif(t.n, 0) AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), d AS (
  SELECT *, least(coalesce(floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT, 0), 3)::BIGINT AS copies FROM c
)
SELECT doc_id, size, n AS source_size, target, copies * size AS taken, source, copies FROM d
"""
