import sys

import __spark_entry__ as entry


def test_frame_queries_stand_without_the_text_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "framelake.llm", None)
    for name in [m for m in sys.modules if m.startswith("framelake.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    names = entry.queries()
    assert "compensate" in names and not [n for n in names if n.startswith("op")]
    assert set(entry.oracle_sql()) <= set(names)


def test_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 500 and rows[0]["mean_disp"] >= 0
