"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; ``run`` writes each stage's result as Parquet in the shared folder and
reads it again, which cuts the lineage and gives the next stage known sizes; what
a stage stored besides, and its input, are deleted then.
All stages but the last return the columns of ``documents``; the last one emits
each document as many times as the mix takes it.

Edge cases, of all stages: an empty table stays empty; null ids, repeated ids and
null sources are kept apart by the text, never dropped; further columns pass
unchanged, whatever their names; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import decontaminate, minhash, mixing, quality, secret_scan
from framelake.llm.common import dropped, scratch, stored

SHINGLE, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules find good; failures of the base rule go too.

    A null, empty or blank text has no words and goes. Repeated rows get the same
    verdict; a posterior at the threshold keeps the document.
    """
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 80 % of their five-word shingles, one with the least id.

    A group without ids, or with several rows of the least id, keeps the row with
    the least text hash, then the least row as JSON. Texts without words are in no
    group and all stay.
    """
    return minhash.deduplicate(docs, width=SHINGLE, percent=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item (or a whole shorter item).

    Decided by the text alone, so rows with a null or shared id stand for
    themselves; a null text has no words and stays, as do all with an empty benchmark.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets masked.

    A null text stays null; ``n_chars`` follows the text where it changes. Without
    any labelled string the automaton is fitted to the strings made by rule.
    """
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring each source near its target.

    A null source is a source of its own; documents without words weigh nothing and
    are emitted at their source's rate; equal ids draw equal numbers.
    """
    return mixing.mix_documents(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mix", mix)]

#: The fitted label model, the hashes and the automaton are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as own:
            before, docs = docs, own.keep(stored(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        dropped(before)  # but for the source, which has no stored table
    return STAGES[-1][1](spark, docs, sf_dir)
