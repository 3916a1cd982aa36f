import importlib.util
import os
import sys

import pytest

from given import ROOT, SF_SMALL

def _load(path, name):
    spec = importlib.util.spec_from_file_location(name, path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


@pytest.fixture(scope="module")
def entry_mod():
    return _load(os.path.join(ROOT, "__spark_entry__.py"), "spark_entry")


def test_entry_runs(spark, entry_mod):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["qid", "agent", "model", "n_messages", "used", "max_tokens", "overflow", "best_score"]


def test_every_query_has_an_oracle(entry_mod):
    from tessera.plans.catalog import QUERIES

    assert set(QUERIES) <= set(entry_mod.queries()) & set(entry_mod.oracle_sql())


def test_queries_match_oracle_at_small_scale(spark):
    check = _load(os.path.join(ROOT, "scripts", "check_oracle.py"), "check_oracle")
    bad = [(n, s, d) for n, s, d in check.compare(spark, SF_SMALL) if s not in ("ok", "rows")]
    assert bad == []


def test_the_rest_works_without_the_training_data_operators(entry_mod, monkeypatch):
    """The guard: neither their package nor the pipeline can be imported."""
    from tessera.plans.catalog import QUERIES
    from tessera.plans.oracle import SQL

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tessera.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry_mod.queries()) == set(QUERIES) and set(entry_mod.oracle_sql()) == set(SQL)


def test_scratch_is_deleted_and_needs_a_shared_folder(spark, monkeypatch):
    from tessera import session

    with session.scratch(spark):
        df = session.materialize(spark.range(3), "gone")
        path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session._checkpoint_base(Session())
