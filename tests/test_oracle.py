"""Every catalogue query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from prefline.plans.catalog import catalog
from prefline.plans.compare import compare
from prefline.plans.oracle import ROUNDED, sql_catalog

from given_tables import SF_ORACLE, SF_SMALL

SQL = sql_catalog()
NAMES = sorted(catalog())


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(NAMES) - set(SQL)
    assert rows_only == {"q32_ml_scorer", "q44_subword_prompts", "q45_subword_prefix"}
    assert set(SQL) <= set(NAMES)


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    r = compare(df, duck, SQL[name], ROUNDED.get(name))
    assert r["match"], r


def test_rows_only_query_runs(spark):
    df = E.queries()["q32_ml_scorer"](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) == 200
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_entry_schema_stable(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "reward", "ref_reward", "margin"]
    rows = df.collect()
    turns = [tuple(r) for r in spark.read.parquet(f"{E.FLAGSHIP_DIR}/conversations.parquet").select("conv_id", "role").collect()]
    both = {c for c, r in turns if r == "user"} & {c for c, r in turns if r == "assistant"}
    assert sorted(r["conv_id"] for r in rows) == sorted(both)  # no id is lost for a gap in the ids
    assert E.entry(spark).schema == df.schema


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_column_types_match_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    oracle = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: DUCK_TYPES.get(t, t) for c, t in df.dtypes} == oracle
