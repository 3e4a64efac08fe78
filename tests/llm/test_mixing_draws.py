"""Large and small documents are taken as often as their rate says, through buckets and levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callbrook.llm import mixing


@pytest.mark.parametrize("same", [False, True])
def test_inclusion_does_not_depend_on_size(spark, same):
    seeds, n = 240, 1000
    k, source = F.col("id") % n, F.floor(F.col("id") / n)
    large = k % 50 == 0
    key = F.when(large | F.lit(not same), k).otherwise(F.floor(k / 100))  # in the second case small documents repeat
    units = spark.range(seeds * n).select(
        F.col("id").alias("__row"), F.xxhash64(key, large, source).alias("__h"), source.alias("__place"),
        F.when(large, 5000.0 + k).otherwise(100.0 + key % 7).alias("__size"), F.when(source % 2 == 0, 0.2).otherwise(0.7).alias("__rate"), F.lit(n).cast("long").alias("__n"))
    drawn = mixing.copies(mixing.written(units, "units"), bucket=128, fan=4, change=8)
    by = units.join(drawn, "__row").groupBy("__rate", (F.col("__size") > 1000).alias("large")).agg(F.avg("__copies").alias("taken")).collect()
    assert len(by) == 4
    for r in by:
        assert abs(r.taken - r["__rate"]) < 0.025, by


def _source(n, large=0.0):
    rng = np.random.default_rng(n)
    size = rng.integers(1, 400, n).astype(float)
    if large:
        size[n // 3] = large
    return pd.DataFrame({"__row": np.arange(n), "__h": rng.integers(0, 2**62, n), "__place": 0, "__bucket": 0, "__size": size,
                         "__p": rng.uniform(0.05, 0.95, n), "__order": rng.permutation(n), "__spare": False})


@pytest.mark.parametrize("n,large", [(500, 0.0), (500, 2000.0), (3, 0.0), (1, 0.0), (0, 0.0)])
def test_small_sources_are_settled_in_pairs(monkeypatch, n, large):
    met, pair = [], mixing._pair
    monkeypatch.setattr(mixing, "_pair", lambda size, p, u: (met.append(len(p)), pair(size, p, u))[1])
    units = _source(n, large)
    out = mixing._settle(True, mixing.CHANGE, 5, 0)(units)
    taken, meant = ((x["__p"] * x["__size"]).sum() for x in (out, units))
    assert set(out["__p"]) <= {0.0, 1.0}
    assert abs(taken - meant) <= (units["__size"].median() if n == 500 else units["__size"].max() if n else 0)
    if n == 500:  # the largest document needs its change, all others meet in pairs
        assert met[0] == (n - mixing.CHANGE if not large else n - mixing._kept_aside(
            *(units.sort_values("__order")[c].to_numpy() for c in ("__size", "__p")), mixing.CHANGE))
        assert met[0] >= 100


def test_pairs_keep_each_expectation():
    units, seeds = _source(300, 2000.0), 1200
    total = sum(mixing._settle(True, 16, seed, 0)(units).sort_values("__row")["__p"].to_numpy() for seed in range(seeds))
    assert np.abs(total / seeds - units["__p"]).max() < 0.06
