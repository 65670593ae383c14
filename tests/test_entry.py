import pytest

import __spark_entry__ as entry


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 150
    assert entry.entry(spark).limit(1).count() == 1


def _without(monkeypatch, absent):
    real = entry.importlib.import_module

    def missing(name, *a):
        if name == absent:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", missing)


@pytest.mark.parametrize("absent", ["tessera.llm.queries", "corpus_pipeline"])
def test_library_does_not_need_the_corpus_subpackage(monkeypatch, absent):
    _without(monkeypatch, absent)
    assert not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in entry.queries())
    assert "pipeline" not in entry.queries()


def test_other_missing_modules_are_not_hidden(monkeypatch):
    def broken(name, *a):
        raise ModuleNotFoundError("No module named 'tokenizers'", name="tokenizers")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
