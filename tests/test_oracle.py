"""Every query that has SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tideline.plans import queries as plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        if isinstance(v, datetime.datetime):
            v = v.date()
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = plans.queries()[name](spark, SF)
    found = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = plain(df.collect(), df.columns), plain(found.fetchall(), columns)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6, nan_ok=True) if all(isinstance(x, (int, float)) for x in w) else [x if not isinstance(x, float) else round(x, 4) for x in g] == [x if not isinstance(x, float) else round(x, 4) for x in w]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.oracle_sql()) - {"live_report", "research_report"}))
def test_has_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_monte_carlo_queries_are_of_full_size(spark, monkeypatch):
    from tideline.operators import montecarlo

    sizes, simulate = [], montecarlo.simulate
    monkeypatch.setattr(montecarlo, "simulate", lambda stats, years=10, sims=10_000, *a, **k: sizes.append((years, sims)) or simulate(stats, years, sims, *a, **k))
    for name in ("mc_paths", "research_report"):
        plans.queries()[name](spark, SF)
    assert sizes == [(plans.P.mc_years, plans.P.mc_sims)] * 2 == [(10, 10_000)] * 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9
    assert set(e.oracle_sql()) <= set(e.queries())
