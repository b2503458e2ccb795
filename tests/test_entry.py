"""The entry keeps working without the optional subpackage."""

import builtins
import importlib
import sys

import __spark_entry__


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def missing(name, *args, **kw):
        if name.startswith(("corpus_pipeline", "quarry.llm")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", missing)
    for name in [n for n in sys.modules if n.startswith(("corpus_pipeline", "quarry.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    entry = importlib.reload(__spark_entry__)
    assert entry.llm is None and "scan_summary" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
