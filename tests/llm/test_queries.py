import pytest

import __spark_entry__ as entry
from checks.compare import connect, rows_of
from odd_rows import SF
from findrift.llm import queries as Q


def test_one_query_per_operator():
    names = list(Q.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_equals_sql(spark, name):
    df = Q.queries()[name](spark, SF)
    cur = connect(SF).execute(Q.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in Q.oracle_sql()])
def test_runs_on_whole_tables(spark, name):
    df = Q.queries()[name](spark, SF)
    table = {"op6_wrappers": "pages", "op13_repair": "conversations"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert df.count() >= (rows.select("conv_id").distinct() if name == "op13_repair" else rows).count()
