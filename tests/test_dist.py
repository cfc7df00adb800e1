"""Distribution functions against tabulated values."""

import numpy as np
import pytest

from statloom.functions import dist, special


@pytest.mark.parametrize("got, want", [
    (dist.norm_ppf(0.975), 1.959963985), (dist.t_ppf(0.975, 10), 2.228138852), (dist.chi2_ppf(0.95, 3), 7.814727903), (dist.f_ppf(0.95, 3, 20), 3.098391212),
    (dist.t_two_sided(2.228138852, 10), 0.05), (dist.chi2_sf(3.841458821, 1), 0.05), (dist.beta_i(2, 3, 0.4), 0.5248), (dist.gamma_p(2, 2), 0.5939941503),
    (dist.binom_two_sided_half(3, 10), 0.34375)])
def test_values(got, want):
    assert got == pytest.approx(want, rel=1e-7)


def test_studentized_range():
    assert dist.studentized_range_sf(3.578, 3, 20) == pytest.approx(0.05, abs=3e-4)


def test_vector_functions():
    import math
    x = np.linspace(-8, 8, 81)
    want = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in x])
    assert np.allclose(special.norm_logcdf(x), want, rtol=1e-9, atol=1e-12)
    z = np.array([0.1, 0.5, 1.0, 2.5, 30.0])
    assert np.allclose(special.lgamma(z), [math.lgamma(v) for v in z], rtol=1e-10)


def test_bh():
    assert dist.bh_adjust([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.04, 0.04])
