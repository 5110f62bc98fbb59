"""Registered queries on made-up tables like those that larger inputs bring, against DuckDB."""

import duckdb
import numpy as np
import pandas as pd

from millrace.plans import catalogue
from tests.test_oracles import rows_of


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{folder}/{t}.parquet", index=False)
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    got = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    mine = rows_of(cols, [r.asDict() for r in df.collect()])
    assert mine == rows_of(cols, [dict(zip(cols, r, strict=True)) for r in got.fetchall()])
    return mine


def test_second_by_gain_where_scores_are_close(spark, tmp_path):
    """Twenty candidates whose scores lie within 0.01: the second is still the one with the largest gain."""
    r = np.random.default_rng(5)
    away = np.linalg.qr(r.standard_normal((64, 40)))[0].T[1:31]
    first = np.linalg.qr(r.standard_normal((64, 64)))[0].T[0]
    v = [first]
    for i, x in enumerate(away):
        side = x - (x @ first) * first
        v.append((0.9 - i * 1e-4) * first + np.sqrt(1 - (0.9 - i * 1e-4) ** 2) * side / np.linalg.norm(side))
    v[2] = v[1].copy()  # nearest to the first hit: the second by score alone
    rows = pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": [x.astype(np.float32) for x in v], "label": 0})
    assert (0, 2, 2) not in same_as_sql(spark, tmp_path, "mmr_first_two", embeddings=rows)


def test_sections_with_part_keys_beyond_a_million(spark, tmp_path):
    orders = pd.DataFrame({"o_orderkey": np.array([1, 2, 3, 4])})
    lines = pd.DataFrame({"l_orderkey": [1, 1, 2, 2, 3, 3], "l_partkey": pd.array([1_150_000, 20_000, 5, 4, None, 7], "Int64"), "l_linenumber": np.array([1, 2, 1, 2, 1, 2], np.int32)})
    assert (1, "p20000") in same_as_sql(spark, tmp_path, "table_section", orders=orders, lineitem=lines)
