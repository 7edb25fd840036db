import duckdb
import numpy as np
import pandas as pd
import pytest

from vitrina.functions import quantiles as qs


def frame(kind, n, rng):
    if kind == "spread":  # values of all sizes
        return rng.standard_normal(n) * 10.0 ** rng.integers(-8, 9, n)
    if kind == "frequent":  # one value has most rows
        return np.where(rng.random(n) < 0.7, 3.5, rng.random(n))
    if kind == "one":
        return np.full(n, 2.0)
    return rng.integers(0, 40, n).astype(float)


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("kind", ["spread", "frequent", "one", "whole"])
def test_equals_duckdb_by_group(spark, monkeypatch, kind, counted):
    monkeypatch.setattr(qs, "FEW", 20)
    monkeypatch.setattr(qs, "CUTS", 8)
    rng = np.random.default_rng(5)
    own = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000, p=[0.9, 0.08, 0.02]), "x": frame(kind, 3000, rng)})
    own.loc[::50, "x"] = None
    shares = {"low": 0.0, "p25": 0.25, "mid": 0.5, "p99": 0.99, "high": 1.0}
    df = spark.createDataFrame(own.astype(object).where(own.notna(), None), "g string, x double").repartition(5)
    got = {r.g: [r[n] for n in shares] for r in qs.quantiles(df, "x", shares, by=("g",), counted=counted).collect()}
    sql = ", ".join(f"quantile_cont(x, {q}) AS {n}" for n, q in shares.items())
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT g, {sql} FROM own WHERE NOT isnan(x) GROUP BY g").fetchall()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=1e-12, atol=0) for g in got)
    all_ = qs.quantiles(df, "x", shares, counted=counted).first()
    assert np.allclose(list(all_), duckdb.sql(f"SELECT {sql} FROM own WHERE NOT isnan(x)").fetchall()[0], rtol=1e-12, atol=0)


def test_the_driver_gets_few_rows(spark, monkeypatch):
    """However many values there are, what is collected is bounded by the cells."""
    sizes = []
    collect = type(spark.range(1)).collect

    def counted(self):
        out = collect(self)
        sizes.append(len(out))
        return out

    df = spark.range(300_000).selectExpr("sin(id * 1.7) * id AS x")
    monkeypatch.setattr(type(df), "collect", counted)
    got = qs.quantiles(df, "x", {"m": 0.5}).first().m
    assert max(sizes) <= qs.FEW + 1 and len(sizes) <= 8
    x = np.sin(np.arange(300_000) * 1.7) * np.arange(300_000)
    assert got == pytest.approx(np.median(x), abs=1e-9)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert qs.quantiles(df, "x", {"m": 0.5}).collect()[0].m is None
    assert qs.quantiles(df.limit(0), "x", {"m": 0.5}, by=("x",)).count() == 0
