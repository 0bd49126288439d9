import importlib
import sys

import pytest


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_part(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("skein.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("skein.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert "story_ranking" in entry.queries()
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("part", ["operators", "sources", "functions", "plans", "streaming"])
def test_nothing_else_imports_the_corpus_part(part):
    from pathlib import Path

    for p in (Path(__file__).parents[1] / "skein" / part).glob("*.py"):
        assert "skein.llm" not in p.read_text()
