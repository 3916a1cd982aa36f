import re

from given import SF_SMALL

from tessera.plans.catalog import QUERIES


def _plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_row_local_operators_stay_in_the_jvm(spark):
    for name in ("chunk_words", "html_to_text", "token_count", "section_assemble"):
        plan = _plan(spark, name)
        assert "Python" not in plan and "MapIn" not in plan and "ArrowEval" not in plan, name
        assert "Exchange hashpartitioning" not in plan, name


def test_dispatch_broadcasts_the_profile_dimension(spark):
    plan = _plan(spark, "route_questions")
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(spark, "token_count")
    scan = re.sub(r"#\d+L?", "", [line for line in plan.splitlines() if "FileScan parquet" in line][0])
    assert "FileScan parquet [doc_id,text]" in scan
