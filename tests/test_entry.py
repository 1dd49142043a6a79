import importlib
import sys


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["user_id", "clicks", "after_view", "span_us", "total", "seen"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_it_stands_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.split(".")[0] in ("corpus_pipeline", "__spark_entry__") or m.startswith("rivulet.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "rivulet.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "align_framesync" in entry.queries() and "pipeline" not in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
