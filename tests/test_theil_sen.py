"""Pairwise slopes counted over blocks of x and ranges of residuals."""

import numpy as np
import pytest

from statloom.operators import groups


@pytest.mark.parametrize("kinds", [4, 60])
def test_theil_sen_over_blocks_and_ranges(spark, monkeypatch, kinds):
    """Few places of x with more points than a block, and many with fewer; ties in both; residuals in many ranges."""
    monkeypatch.setattr(groups, "SLOPE_RANGE", 20)
    rng = np.random.default_rng(5)
    x = rng.integers(0, kinds, 300).astype(float)
    y = np.round(2 * x + rng.normal(size=300) * 5, 1)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    i, j = np.triu_indices(300, 1)
    apart = x[i] != x[j]
    slopes = (y[j] - y[i])[apart] / (x[j] - x[i])[apart]
    got = groups.theil_sen(d, "x", "y", (0.25, 0.5), block=16)
    assert np.allclose(got, np.quantile(slopes, [0.25, 0.5]), atol=1e-8)
