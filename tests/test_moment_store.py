"""Moments that are kept up to date against moments of everything."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tideline.config import PARTS as BOOK
from tideline.operators import moments
from tideline.operators.moment_store import MomentStore
from tideline.operators.returns import daily_returns, densify
from tideline.sources.panel import part_prices

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cov(df):
    return {(r.asset_i, r.asset_j): r.cov for r in df.collect()}


def test_one_more_day(spark, tmp_path):
    every = daily_returns(densify(part_prices(spark, SF), BOOK.universe)).where(F.col("asset").isin(BOOK.assets))
    last = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.weekday("l_shipdate") < 5).agg(F.to_date(F.max("l_shipdate"))).first()[0]
    store = MomentStore(spark, str(tmp_path / "m"), tuple(BOOK.assets), BOOK.benchmark)
    for upto in (last - dt.timedelta(days=1500), last - dt.timedelta(days=400), last - dt.timedelta(days=1)):
        assert store.add(SF, upto) > 0
    before = cov(store.sample_cov())
    day = store.commits()[-1][1]
    new = store.new_sums(SF)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(l_shipdate,{day + dt.timedelta(days=1)}" in plan
    assert [r.day for r in new.select("day").distinct().collect()] == [last]
    # a run that died: states and sums of the next batch without a commit
    spark.read.parquet(f"{store.root}/states/batch=0").write.parquet(f"{store.root}/states/batch=3")
    assert cov(store.sample_cov()) == before
    assert store.add(SF) > 0 and store.add(SF) == 0
    assert [b for b, _ in store.commits()] == [0, 1, 2, 3] and store.commits()[-1][1] == last
    for got, want in ((store.sample_cov(), moments.sample_cov(every)), (store.shrunk_cov(), moments.shrunk_cov(every))):
        got, want = cov(got), cov(want)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want)
    assert cov(store.sample_cov()) != before


def test_nothing_yet(spark, tmp_path):
    store = MomentStore(spark, str(tmp_path / "m"), tuple(BOOK.assets), BOOK.benchmark)
    assert store.commits() == [] and store.add(SF, dt.date(1900, 1, 1)) == 0 and store.commits() == []
