"""Every query with SQL gives the SQL's rows."""

import datetime

import duckdb
import pandas as pd
import pytest

from quaywise import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(rows):
    return sorted((tuple(map(_value, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = _rows(df.select(*columns).collect())
    cur = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == _rows(tuple(r[i] for i in at) for r in cur.fetchall())


def _errors_are_consistent(rows):
    """What holds of any errors over one table: mae <= rmse, |bias| <= mae, r2 at most 1."""
    for r in rows:
        assert r.n > 0 and 0 <= r.mae <= r.rmse + 1e-9 and abs(r.bias) <= r.mae + 1e-9 and 0 <= r.median_ae
        assert r.r2 is None or r.r2 <= 1 + 1e-9


#: Queries without SQL, and what is known of their rows; the operators have tests of their own beside these.
KNOWN = {
    "arr13_pca_share": lambda rows: {r.component for r in rows} == set(range(5)) and all(r.sd >= 0 for r in rows),
    "arr14_shared_basis_pca": lambda rows: {r.patch for r in rows} == {0, 1} and len({(r.vec_id, r.patch) for r in rows}) == len(rows),
    "arr15_gram_pca": lambda rows: abs(sum(r.pc0 for r in rows)) < 1e-6 and abs(sum(r.pc0 * r.pc1 for r in rows)) < 1e-6,
    "arr16_component_sweep": lambda rows: sorted(r.components for r in rows) == [2, 4, 8] and len({r.n for r in rows}) == 1,
    "mod4_early_stopping": lambda rows: all(1 <= r.best_iteration <= r.grown <= r.best_iteration + 30 for r in rows),
    "arr18_ridge_probe": lambda rows: len(rows) == 1,
    "mod5_staged_errors": lambda rows: sorted(r.trees for r in rows) == [1, 5, 20, 100] and all(r.mse > 0 for r in rows),
    "mod10_shap": lambda rows: len(rows) == 4 and all(r.off < 1e-6 and r.mean_size >= abs(r["mean"]) for r in rows),
    "mod10_importance": lambda rows: abs(sum(r.importance for r in rows) - 1) < 1e-6 and all(r.importance >= 0 for r in rows),
    "mod3_quantile": lambda rows: 0.75 < sum(r.covered * r.n for r in rows) / sum(r.n for r in rows) <= 1,
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_what_is_known(spark, sf, name):
    rows = plans.QUERIES[name](spark, sf).collect()
    assert rows
    if "rmse" in rows[0].asDict():
        _errors_are_consistent(rows)
    if name in KNOWN:
        assert KNOWN[name](rows)
    else:
        assert "rmse" in rows[0].asDict(), "say what is known of its rows"


def test_workbooks_hold_any_name(spark, tmp_path):
    rows = [(k, n, k % 5) for k, n in enumerate(["A & B", "<C>", None, *(f"N{i}" for i in range(11))])]
    spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(map(tuple, plans.QUERIES["src12_workbook"](spark, str(tmp_path)).collect())) == [r for r in rows if r[1]]
