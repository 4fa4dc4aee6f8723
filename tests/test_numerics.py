import math

import numpy as np

from causeway.functions.columns import poisson1_cdf
from causeway.functions.dist import betainc, t_ppf, t_sf2, welch
from causeway.functions.linalg import ols_core, project_simplex, simplex_ls


def test_t_distribution_tabulated_values():
    assert abs(t_sf2(2.0, 10) - 0.073388) < 1e-5
    assert abs(t_sf2(2.228138852, 10) - 0.05) < 1e-8
    assert abs(t_ppf(0.975, 10) - 2.228138852) < 1e-7
    assert abs(t_ppf(0.975, 1e9) - 1.959963985) < 1e-6
    assert abs(t_sf2(1.0, 1) - 0.5) < 1e-12  # Cauchy
    assert math.isnan(t_sf2(float("nan"), 5))


def test_betainc_symmetry():
    for a, b, x in [(2.0, 3.0, 0.3), (0.5, 0.5, 0.9), (10, 2, 0.7)]:
        assert abs(betainc(a, b, x) + betainc(b, a, 1 - x) - 1) < 1e-12


def test_welch_matches_closed_form():
    diff, se, t, dof, p = welch(10.0, 4.0, 20, 8.0, 9.0, 30)
    assert abs(se - math.sqrt(4 / 20 + 9 / 30)) < 1e-12
    assert abs(t - 2 / se) < 1e-12
    assert 0 < p < 1 and dof > 40


def test_ols_core_recovers_exact_fit():
    rng = np.random.default_rng(0)
    X = np.column_stack([np.ones(50), rng.normal(size=(50, 2))])
    y = X @ np.array([1.0, 2.0, -3.0])
    r = ols_core(X.T @ X, X.T @ y, float(y @ y), 50.0)
    assert np.allclose(r["beta"], [1, 2, -3])
    assert r["rss"] < 1e-18 + 1e-9


def test_simplex_projection_of_large_values():
    for top in (1.0, 1e9, 1e20, -1e20):
        assert np.array_equal(project_simplex(np.array([top, top - abs(top)])), [1.0, 0.0])
        assert np.allclose(project_simplex(np.array([top, top])), [0.5, 0.5])


def test_simplex_projection_and_exact_convex_combination():
    w = project_simplex(np.array([0.2, -1.0, 3.0]))
    assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()
    rng = np.random.default_rng(1)
    Y = rng.normal(size=(40, 5))
    w_true = np.array([0.5, 0.3, 0.2, 0.0, 0.0])
    y = Y @ w_true
    w = simplex_ls(Y.T @ Y, Y.T @ y)
    assert np.allclose(w, w_true, atol=1e-5)
    assert simplex_ls(np.array([[2.0]]), np.array([1.0]))[0] == 1.0


def test_poisson_cdf_rule():
    cdf = poisson1_cdf()
    assert abs(cdf[0] - math.exp(-1)) < 1e-15
    assert all(a < b for a, b in zip(cdf, cdf[1:])) and cdf[-1] < 1
