"""Queries that SQL can't express, computed again from the tables with numpy."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaywise import plans
from quaywise.plans.common import P

BASE, LAGS = ["hour", "dow"], ["lag24", "lag48"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def panel(duck):
    rows = duck.execute(f"WITH {P} SELECT p.zone, p.ts, p.y, p.split, a.y AS lag24, b.y AS lag48, CAST(hour(p.ts) AS DOUBLE) AS hour, CAST(isodow(p.ts) - 1 AS DOUBLE) AS dow, day(p.ts) % 5 AS fold FROM p JOIN p a ON a.zone = p.zone AND a.ts = p.ts - INTERVAL 24 HOUR JOIN p b ON b.zone = p.zone AND b.ts = p.ts - INTERVAL 48 HOUR").df()
    return rows.sort_values(["zone", "ts"]).reset_index(drop=True)


def _ridge(train, features, y, penalty):
    """A function of a frame: least squares with a penalty on standardised features and a free intercept."""
    x = train[features].to_numpy(float)
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-12, 1.0, sd)
    z = (x - mean) / sd
    w = np.linalg.lstsq(z.T @ z + penalty * np.eye(len(features)), z.T @ (y - y.mean()), rcond=None)[0]
    return lambda f: (f[features].to_numpy(float) - mean) / sd @ w + y.mean()


def _errors(frame, by):
    out = {}
    for key, g in frame.groupby(by):
        e = g.yhat - g.y
        out[key if isinstance(key, tuple) else (key,)] = (len(g), e.abs().mean(), e.abs().median(), np.sqrt((e**2).mean()), e.mean())
    return out


def _agree(rows, by, want):
    got = {tuple(r[k] for k in by): (r.n, r.mae, r.median_ae, r.rmse, r.bias) for r in rows}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-6, atol=1e-6), k


def test_feature_lattice(spark, sf, panel):
    train, test = panel[panel.split == "train"], panel[panel.split == "test"]
    parts = [test.assign(yhat=_ridge(train, f, train.y, 0.0)(test), feature_set=n) for n, f in (("calendar", BASE), ("lags", LAGS), ("calendar + lags", BASE + LAGS))]
    _agree(plans.QUERIES["mod12_feature_lattice"](spark, sf).collect(), ["feature_set"], _errors(pd.concat(parts), ["feature_set"]))


def test_penalty_by_validation(spark, sf, panel):
    train, val, test = (panel[panel.split == s] for s in ("train", "val", "test"))
    features = LAGS + BASE
    best = min([0.0, 1.0, 10.0, 100.0], key=lambda p: ((_ridge(train, features, train.y, p)(val) - val.y) ** 2).mean())
    _agree(plans.QUERIES["mod6_ridge_validated"](spark, sf).collect(), ["zone"], _errors(test.assign(yhat=_ridge(train, features, train.y, best)(test)), ["zone"]))


def test_penalty_by_folds(spark, sf, panel):
    train, test = panel[panel.split == "train"], panel[panel.split == "test"]
    features = LAGS + BASE

    def error(a):
        total = 0.0
        for k in range(5):
            rest, own = train[train.fold != k], train[train.fold == k]
            total += ((_ridge(rest, features, rest.y, a * len(rest))(own) - own.y) ** 2).sum()
        return total

    best = min([0.0, 0.001, 0.01, 0.1, 1.0], key=error)
    _agree(plans.QUERIES["mod6_ridge_cv"](spark, sf).collect(), ["zone"], _errors(test.assign(yhat=_ridge(train, features, train.y, best * len(train))(test)), ["zone"]))


def _out_of_fold(train, features):
    out = np.zeros(len(train))
    for k in range(5):
        rest = train[train.fold != k]
        own = (train.fold == k).to_numpy()
        out[own] = _ridge(rest, features, rest.y, 1.0)(train[own])
    return out


def test_residual_head_and_stacking(spark, sf, panel):
    train, test = panel[panel.split == "train"].copy(), panel[panel.split == "test"].copy()
    train["oof"] = _out_of_fold(train, BASE)
    first = _ridge(train, BASE, train.y, 1.0)
    head = _ridge(train, LAGS, train.y - train.oof, 1.0)
    _agree(plans.QUERIES["mod8_residual_head"](spark, sf).collect(), ["zone"], _errors(test.assign(yhat=first(test) + head(test)), ["zone"]))
    train["_base"], test["_base"] = train.oof, first(test)
    second = _ridge(train, ["_base", *LAGS], train.y, 1.0)
    _agree(plans.QUERIES["mod9_stacking"](spark, sf).collect(), ["zone"], _errors(test.assign(yhat=second(test)), ["zone"]))


def test_probes_of_vectors(spark, sf, duck):
    e = duck.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").df()
    x, y, held = np.stack(e.embedding).astype(float), e.label.to_numpy(float), (e.vec_id % 5 == 0).to_numpy()
    frame = pd.DataFrame(x[:, :16], columns=[f"x{k}" for k in range(16)]).assign(y=y)
    probe = _ridge(frame[~held], list(frame.columns[:16]), frame.y[~held], 1.0)
    (r,) = plans.QUERIES["arr18_ridge_probe"](spark, sf).collect()
    err = probe(frame[held]) - y[held]
    assert np.allclose([r.n, r.mae, r.rmse, r.bias], [held.sum(), np.abs(err).mean(), np.sqrt((err**2).mean()), err.mean()])
    # components of the training rows, standardised on them, and probes on the first of them
    mean, sd = x[~held].mean(0), x[~held].std(0)
    z = (x - mean) / sd
    _, _, vt = np.linalg.svd(z[~held], full_matrices=False)
    scores = pd.DataFrame(z @ vt[:8].T, columns=[f"c{k}" for k in range(8)])
    for r in plans.QUERIES["arr16_component_sweep"](spark, sf).collect():
        names = list(scores.columns[: r.components])
        err = _ridge(scores[~held], names, pd.Series(y[~held]), 1.0)(scores[held]) - y[held]
        assert np.allclose([r.n, r.mae, r.rmse], [held.sum(), np.abs(err).mean(), np.sqrt((err**2).mean())], rtol=1e-5)
    for r in plans.QUERIES["arr13_pca_share"](spark, sf).collect():
        own = scores.iloc[(e.label == r.label).to_numpy(), r.component]
        assert np.isclose(abs(r["mean"]), abs(own.mean()), atol=1e-6) and np.isclose(r.sd, own.std(ddof=0), atol=1e-6)
