import os

import pytest
from compare import same_rows

from lexspark.plans import reference, training, workflows

FOLDER = "/root/testdata/sf0.001"
QUERIES = {**training.QUERIES, **reference.QUERIES, **workflows.QUERIES}
SQL = {**training.SQL, **reference.SQL, **workflows.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_query_and_sql_agree(spark, name):
    same_rows(spark, FOLDER, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["spearman_p", "kruskal_p", "ridge_cv", "stratified_sample", "rater_view", "training_sample"])
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_names_and_llm_is_optional(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_the_package_is_shipped_once(spark):
    from lexspark.session import ship

    ship(spark)
    ship(spark)
    assert len([x for x in spark.sparkContext._python_includes if x.startswith("lexspark-")]) == 1
