"""The pipeline's stages against plain versions, on the provided documents."""

import os
import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import mixing, quality, registry, secret_scan
from framelake.llm.common import stored

from . import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, given all of what the stage before returned."""
    out = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], DIR), name.replace(" ", "-")))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "secrets", "mix"]
    assert all(s.columns == stages[0].columns for s in stages)


def test_quality_drops_failures_and_keeps_clean_documents(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    rows = [(r["doc_id"], r["text"]) for r in stages[0].collect()]
    failed = {i for i, t in rows if (m := brute.measures(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
    assert not kept & failed
    assert kept == {r["doc_id"] for r in quality.quality_scores(stages[0]).where("kept").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = [i for i, _ in rows if labels.get(i) == 1 and i not in failed]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_near_duplicates_keep_one_of_each(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    expected = {i for i, (_, c) in brute.near_duplicates(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in stages[2].collect()} == expected


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    expected = {r["doc_id"] for r in stages[2].collect() if not brute.contamination(r["text"], items)[1]}
    assert {r["doc_id"] for r in stages[3].collect()} == expected


def test_decontamination_moves_no_texts(spark, stages):
    """However many documents are hit: no table beside the benchmark, no join and no shuffle."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        rows = corpus_pipeline.decontamination(spark, stages[2], DIR)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "Join" not in plan and "Exchange" not in plan and rows.count() == stages[3].count()


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (after[i] != text) == bool(brute.secrets(text)[1])
        assert sum(brute.secrets(after[i])[0]) == 0


def test_secrets_are_fitted_to_all_strings(spark, documents, monkeypatch):
    """1,300 labelled values and 2,600 runs beside theirs, in one partition: more than a former fit took."""
    made, init = [], secret_scan.Model.__init__

    def seen(self, labels, runs, *rest):
        made.append((sum(labels.values()) if isinstance(labels, dict) else len(labels), int(runs[:, -1].sum()) if hasattr(runs, "shape") else len(runs)))
        init(self, labels, runs, *rest)

    monkeypatch.setattr(secret_scan.Model, "__init__", seen)
    texts = [f"secret={k:06d}aB{k % 7}x and" for k in range(1300)] + [f"plain-word-{k}" for k in range(2600)]
    docs = documents([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]).coalesce(1)
    rows = corpus_pipeline.secrets(spark, docs, DIR).collect()
    assert made == [(1300, 1300 + 2600)]
    assert sum("[SECRET]" in r["text"] for r in rows) == 1300 and sum(r["text"].startswith("plain-word-") for r in rows) == 2600


def test_mix_and_run(spark, stages):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(stages[4]).collect()}
    copies = {r["doc_id"]: r["n"] for r in stages[5].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {i: n for i, n in plan.items() if n}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(r["doc_id"] for r in stages[5].collect())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    ours, theirs = registry.QUERIES[name](spark, DIR).toPandas(), con.sql(registry.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    text = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v).astype(str).values.tolist()))
    assert text(ours) == text(theirs) and isinstance(ours, pd.DataFrame)


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))


def test_null_and_repeated_ids(spark, documents, tmp_path):
    bad = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, bad)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = lambda i, t, source="s": (i, t, "en", source, len(t or ""))
    docs = documents([row(None, bad), row(None, "clean text"), row(1, bad), row(1, "also clean"), row(1, None)])
    assert sorted(str(r["text"]) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == ["None", "also clean", "clean text"]
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words, "end"]), " ".join(words[::-1])
    docs = documents([row(None, other), row(None, other), row(5, text, "b"), row(5, text, "a"), row(5, near), row(None, near), row(9, text), row(5, "a b c d e f"), row(None, ""), row(None, "")])
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert len(kept) == 5 and sum(r["text"] in (text, near) for r in kept) == 1
    assert sorted(r["text"] for r in kept if r["text"] not in (text, near)) == ["", "", "a b c d e f", other]
    exact = corpus_pipeline.near_dedup(spark, documents([row(5, text, "b"), row(5, text, "a"), row(9, text)]), str(tmp_path)).collect()
    assert [(r["doc_id"], r["source"]) for r in exact] == [(5, "a")]


def test_stages_on_odd_tables(spark, documents, tmp_path):
    """Empty tables; null, empty, blank, very long and repeated texts; null and repeated ids; columns with the names of helpers."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = "The long road went down to the quiet harbour, where old boats waited for the tide."
    pick = random.Random(12)
    sentence = lambda: " ".join("".join(pick.choice("etaoinshrdlu") for _ in range(pick.randint(2, 9))) for _ in range(12)).capitalize() + "."
    long = " ".join(sentence() for _ in range(40_000))
    texts = [None, "", " \n\t ", prose, prose, f"{prose} token=abcdefgh1234", long, "one two three four five six seven eight nine ten eleven", "x" * 300_000]
    rows = [(None if k % 4 == 3 else k // 2, t, "en", None if k % 3 else "s", len(t or "")) for k, t in enumerate(texts)]
    clash = ", class string, bucket int, key int, votes string, spans string, text_hash int, __place int, __word int, __marked int, size string"
    docs = documents([(*r, "c", 1, 2, "v", "p", 3, 4, 5, 6, "z") for r in rows], clash)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0, name
    clean = spark.range(100).select(F.lit(None).cast("bigint").alias("doc_id"), F.element_at(F.array(*[F.lit(f"{sentence()} {sentence()}") for _ in range(100)]), F.col("id").cast("int") + 1).alias("text"))
    kept = [r["text"] for r in corpus_pipeline.quality_rules(spark, docs.unionByName(clean, allowMissingColumns=True), str(tmp_path)).collect()]
    assert len(kept) >= 100
    assert kept.count(prose) == 2 and long in kept and not {None, "", " \n\t "} & set(kept)
    alone = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["text"]) for r in alone) == sorted(str(t) for t in {*texts} - {texts[5]}) and all(r["__place"] == 4 and r["__marked"] == 6 for r in alone)
    clean = [r["text"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, clean)) == sorted(str(t) for t in texts if t != texts[7])
    masked = {r["text"] for r in corpus_pipeline.secrets(spark, docs, str(tmp_path)).collect()}
    assert f"{prose} token=[SECRET]" in masked and {None, "", long} <= masked
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {r["text"] for r in mixed.collect()} <= set(texts)


def test_run_leaves_one_table(spark, shared_folder):
    folder = shared_folder.removeprefix("file://")
    tables = lambda: {p for p in Path(folder).rglob("*-*") if p.is_dir()}
    before = tables()
    rows = corpus_pipeline.run(spark, DIR)
    left = {p.name.split("-", 1)[1] for p in tables() - before if not p.name.startswith(("app-", "local-"))}
    assert left == {"secrets"} and rows.count() > 0
