"""The entry points, with and without the training-data package."""

import importlib
import sys

import __spark_entry__ as entry


def test_all_queries_are_listed():
    names = entry.queries()
    assert {"r01_space_savings", "w10_guard_alignment"} <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_without_the_training_data_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("ratelens.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def gone(name, *args):
        if name.startswith(("ratelens.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", gone)
    names = entry.queries()
    assert "r01_space_savings" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op")] and set(entry.oracle_sql()) <= set(names)
