"""The driver contract over the smallest tables, against DuckDB."""

import math
import re

import duckdb
import pytest

import __spark_entry__
from quarry.plans.catalog import Q
from quarry.plans.registry import TABLES, oracle_sql, queries

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("key", sorted(queries()))
def test_query(spark, duck, sf_dir, key):
    df = queries()[key](spark, sf_dir)
    found = duck.execute(ORACLE[key])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(v) for v in r)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want


#: Operators that were run over ranges of ids or sizes, with the table whose rows all come out, if they do.
WHOLE = {"alias_expr": "orders", "filter_cmp": None, "arith": "lineitem", "int_div": "orders", "mod_op": "orders", "window_rank": "orders", "window_sum": "orders", "fn_substr": "documents", "fn_printf": "orders", "intersect": None, "except": None, "bind_params": None}


@pytest.mark.parametrize("key", sorted(WHOLE))
def test_whole_tables(spark, duck, sf_dir, key):
    assert not any(re.search(r"(key|n_chars) *<=? *[?0-9]", text) for text in Q[key] if text)
    if WHOLE[key]:
        assert queries()[key](spark, sf_dir).count() == duck.execute(f"SELECT count(*) FROM {WHOLE[key]}").fetchone()[0] > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
