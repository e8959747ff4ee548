import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = (
    "txt_4_extra_blank_lines", "txt_7_clean", "txt_14_html_blocks", "str_2_major_blocks", "str_15_directory_units",
    "ver_3_next_versions", "ver_10_retries", "ret_5_filtered_topk", "ret_23_retrieval_queries", "ret_24_routes",
    "ret_30_answer_batch", "ana_1_session_search", "ana_8_question_for_answer", "ana_16_violations", "eva_6_summary",
    "stm_2_job_feed", "txt_13_tables", "ret_29_model_prompts", "ver_2_latest_versions",
)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_twin(spark, name):
    out = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert out.startswith("ok"), out


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "Python" not in plan(spark, "str_20_parsed_documents")
    assert "Python" not in plan(spark, "txt_7_clean") and "Python" not in plan(spark, "ret_24_routes")
    found = plan(spark, "ret_4_vector_topk")
    assert "WindowGroupLimit" in found and "CartesianProduct" not in found and "NestedLoop" not in found
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan(spark, "ret_25_rule_routes")
