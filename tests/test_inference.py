"""Dependent means, bootstrap, certified tests, simulation: plain versions, invariances, exact values."""

import math
from fractions import Fraction

import numpy as np
import pytest

from augurline.functions import special
from augurline.operators import bootstrap, certified, hac, reference, simulate


def panel(spark, x, panel_id="p"):
    rows = [(panel_id, t, k, f"strategy_{k + 1}", float(x[t, k])) for t in range(len(x)) for k in range(x.shape[1])]
    return spark.createDataFrame(rows, "panel_id string, t long, col int, name string, value double")


@pytest.fixture(scope="module")
def x():
    return simulate.simulate(96, 3, phi=0.4, cross_corr=0.3, mean=[0.0, 0.3, 0.1], seed=711)


def slow_hac(v, lags):
    e = v - v.mean()
    g = [(e[h:] * e[: len(e) - h]).sum() / len(e) for h in range(lags + 1)]
    return g[0] + 2 * sum((1 - h / (lags + 1)) * g[h] for h in range(1, lags + 1))


def test_special_functions():
    assert special.t_sf(2.0, 5) == pytest.approx(0.0509697394149292, abs=1e-13)
    t = special.t_ppf(0.975, 10)
    assert float(certified.student_tail(Fraction(t / math.sqrt(10 + t * t)), 10)) == pytest.approx(0.025, abs=1e-15)
    assert special.beta_cdf(0.3, 2, 5) == pytest.approx(1 - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)), abs=1e-14)
    assert special.clopper_pearson_upper(0, 20, 0.05) == pytest.approx(1 - 0.05 ** (1 / 20))
    assert special.wilson(0, 10)[0] == 0 and special.wilson(10, 10)[1] == 1
    assert special.wilson(5, 10) == pytest.approx((0.2365930, 0.7634070), abs=1e-6)
    assert special.binomial_two_sided(1, 10) == pytest.approx(22 / 1024)
    for rho in (0.0, 0.3, 0.99):
        q = special.equicorrelated_max_quantile(0.95, 8, rho)
        assert special.equicorrelated_max_cdf(q, 8, rho) == pytest.approx(0.95, abs=1e-9)
    rng = np.random.default_rng(0)
    z = (math.sqrt(0.4) * rng.standard_normal((200_000, 1)) + math.sqrt(0.6) * rng.standard_normal((200_000, 5))).max(axis=1)
    assert special.equicorrelated_max_cdf(1.5, 5, 0.4) == pytest.approx((z <= 1.5).mean(), abs=0.004)


def test_hac(spark, x):
    for lags in (0, 3, None):
        got = hac.long_run_variance(panel(spark, x).repartition(3), lags).orderBy("col").collect()
        own = hac.default_lags(96) if lags is None else lags
        assert [r["lags"] for r in got] == [own] * 3
        assert [r["lrv"] for r in got] == pytest.approx([slow_hac(x[:, k], own) for k in range(3)])
    iid = hac.infer_mean(panel(spark, x), "iid").orderBy("col").collect()
    se = x.std(axis=0, ddof=1) / math.sqrt(96)
    assert [r["pvalue"] for r in iid] == pytest.approx([special.t_sf(v, 95) for v in x.mean(axis=0) / se])
    assert iid[0]["ci_high"] - iid[0]["ci_low"] == pytest.approx(2 * special.t_ppf(0.975, 95) * se[0])
    with pytest.raises(Exception, match="rectangular"):
        hac.checked_panel(panel(spark, x).where("not (t = 5 and col = 1)")).collect()
    with pytest.raises(Exception, match="rectangular"):
        hac.checked_panel(panel(spark, np.ones((9, 1)))).collect()
    alternating = np.array([[1.0, -1.0] * 6]).T + np.arange(12)[:, None] * 1e-3
    assert hac.long_run_variance(panel(spark, alternating), 1).first()["lrv"] < alternating.var()


def test_tail_and_gls(spark, x):
    assert hac.bartlett_mass(0.0, 9) == 1 and hac.bartlett_mass(0.5, 2) == pytest.approx(1.5)
    t = np.arange(30)
    cov = 0.7 ** np.abs(t[:, None] - t[None, :])
    assert hac.bartlett_mass(0.7, 30) == pytest.approx(cov.sum() / 30)
    got = hac.known_phi_t(panel(spark, x), 0.4).orderBy("col").collect()
    cov = 0.4 ** np.abs(np.arange(96)[:, None] - np.arange(96)[None, :])
    inv, one = np.linalg.inv(cov), np.ones(96)
    for k in range(3):
        m = one @ inv @ x[:, k] / (one @ inv @ one)
        e = x[:, k] - m
        assert got[k]["statistic"] == pytest.approx(m / math.sqrt(e @ inv @ e / 95 / (one @ inv @ one)))
    fit = hac.fit_equicorrelated(panel(spark, x)).first()
    corr = np.corrcoef(x.T)
    assert fit["rho"] == pytest.approx(max(0, corr[np.triu_indices(3, 1)].mean()))


def test_draws_are_a_fixed_stretch_of_one_stream():
    whole = bootstrap.draw_indices(50, 7.5, 11, 0, 40)
    assert (np.vstack([bootstrap.draw_indices(50, 7.5, 11, a, a + 8) for a in range(0, 40, 8)]) == whole).all()
    u = np.random.default_rng(11).random((40, 50, 2))
    for b in range(40):
        at = None
        for t in range(50):
            at = int(u[b, t, 1] * 50) if t == 0 or u[b, t, 0] < 1 / 7.5 else (at + 1) % 50
            assert whole[b, t] == at


@pytest.mark.parametrize("studentization", ["fixed", "resampled"])
def test_audit_against_plain_version(spark, x, studentization):
    b, alpha = 99, 0.1
    got = bootstrap.audit(panel(spark, x).repartition(5), n_resamples=b, alpha=alpha, lags=3, block_length=6, seed=5, studentization=studentization).orderBy("col").collect()
    m, se = x.mean(axis=0), np.sqrt([slow_hac(x[:, k], 3) / 96 for k in range(3)])
    index = bootstrap.draw_indices(96, 6, 5, 0, b)
    draws = np.array([[(v := (x[i, k] - m[k])).mean() / (se[k] if studentization == "fixed" else math.sqrt(slow_hac(v, 3) / 96)) for k in range(3)] for i in index])
    t, top = m / se, draws.max(axis=1)
    assert [r["adjusted_pvalue"] for r in got] == pytest.approx([(1 + (top >= v).sum()) / (b + 1) for v in t])
    assert [r["marginal_pvalue"] for r in got] == pytest.approx([(1 + (draws[:, k] >= t[k]).sum()) / (b + 1) for k in range(3)])
    assert got[0]["max_cutoff"] == pytest.approx(np.quantile(top, 1 - alpha, method="higher"))
    assert got[0]["max_abs_cutoff"] == pytest.approx(np.quantile(np.abs(draws).max(axis=1), 1 - alpha, method="higher"))
    assert [r["selected"] for r in got] == (np.arange(3) == t.argmax()).tolist()
    again = bootstrap.audit(panel(spark, x), n_resamples=b, alpha=alpha, lags=3, block_length=6, seed=5, studentization=studentization, draws_per_task=7).orderBy("col").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]
    assert bootstrap.draws(panel(spark, x), n_resamples=9, lags=3, block_length=6, seed=5, studentization=studentization, draws_per_task=4).count() == 27


def test_family_invariances(spark, x):
    base = [r["adjusted_pvalue"] for r in bootstrap.test_returns(panel(spark, x), n_resamples=99).orderBy("col").collect()]
    scaled = [r["adjusted_pvalue"] for r in bootstrap.test_returns(panel(spark, x * np.array([2.0, 0.25, 1024.0])), n_resamples=99).orderBy("col").collect()]
    twice = [r["adjusted_pvalue"] for r in bootstrap.test_returns(panel(spark, np.hstack([x, x])), n_resamples=99).orderBy("col").collect()]
    assert scaled == base and twice == base * 2
    for bad in ({"method": "other"}, {"beta": 0.1}, {"method": "gaussian_ar", "seed": 1}):
        with pytest.raises((ValueError, TypeError)):
            bootstrap.test_returns(panel(spark, x), **bad)


def test_bootstrap_mean_variance(spark, x):
    got = bootstrap.mean_variance(panel(spark, x), 8).orderBy("col").collect()
    index = bootstrap.draw_indices(96, 8, 3, 0, 20_000)
    assert [r["variance"] for r in got] == pytest.approx(bootstrap.means(x, index).var(axis=0), rel=0.05)


def test_exact_parts():
    assert certified.whole_numbers([0.5, -1.5, 2.0]) == [1, -3, 4]
    assert float(certified.student_tail(Fraction(2, 7), 6)) == pytest.approx(special.t_sf(math.sqrt(6) * (2 / 7) / math.sqrt(1 - 4 / 49), 6))
    c = certified.critical_square(101, 5, Fraction(1, 20), 40)
    assert float(c) ** 0.5 == pytest.approx(special.t_ppf(0.99, 100), rel=1e-9)
    low, high = certified.f_cutoffs(4, 94, Fraction(1, 100), 40)
    cdf = lambda f: special.beta_cdf(4 * f / (4 * f + 94), 2, 47)
    assert cdf(float(low)) == pytest.approx(0.005) and cdf(float(high)) == pytest.approx(0.995)
    assert certified.root_floor(Fraction(1, 8), 3, 10) == 512
    rng = np.random.default_rng(2)
    m = [[tuple(rng.integers(-5, 5, 3).tolist()) for _ in range(3)] for _ in range(3)]
    p = certified.determinant_polynomial(m)
    at = 0.7
    assert float(sum(c * Fraction(at) ** i for i, c in enumerate(p))) == pytest.approx(np.linalg.det([[c[0] + c[1] * at + c[2] * at**2 for c in row] for row in m]))
    w = lambda df: np.cov(rng.standard_normal((df + 1, 2)).T) * df
    ratios = [np.linalg.det(a := w(20)) / np.linalg.det(a + w(4)) for _ in range(20_000)]
    assert float(certified.moment(2, 4, 20, 1)) == pytest.approx(np.mean(ratios), rel=0.01)
    assert float(certified.moment(2, 4, 20, -2)) == pytest.approx(np.mean(np.power(ratios, -2.0)), rel=0.05)
    intervals, _ = certified.enclosure([(-1, 4), (3, -4)], 12)  # x >= 1/4 and x <= 3/4
    assert len(intervals) == 1 and intervals[0][0] <= Fraction(1, 4) and intervals[0][1] >= Fraction(3, 4) and intervals[0][1] - intervals[0][0] <= Fraction(1, 2) + Fraction(2, 4096)
    assert certified.positive_on([(1, -2)], [(Fraction(0), Fraction(1, 4))], 5, 10)[0]
    assert certified.positive_on([(1, -2)], [(Fraction(0), Fraction(1))], 5, 10)[:2] == (False, False)


def test_certified_enclosures_hold_the_float_sets():
    rng = np.random.default_rng(8)
    x = rng.integers(-20, 21, (128, 2)).astype(float)
    columns = [certified.whole_numbers(x[:, k].tolist()) for k in range(2)]
    x = np.array(columns, float).T
    low, high = certified.ratio_cutoffs(2, 30, 93, Fraction(1, 600), 40)
    polys, singular = certified.multiscale_constraints(columns, [4], Fraction(1, 600), 40)
    assert not singular
    sets, _ = certified.enclosure(polys, 10)
    for phi in np.linspace(0, 1, 41):
        e = (x[1:] - phi * x[:-1])[:124]
        blocks = e.reshape(31, 4, 2)
        within = sum(np.cov(b.T, bias=True) * 4 for b in blocks)
        ratio = np.linalg.det(within) / np.linalg.det(np.cov(e.T, bias=True) * 124)
        inside = any(a <= phi <= b for a, b in sets)
        assert inside or not float(low) <= ratio <= float(high)
        a, r = certified.gls_polynomials(columns[0], Fraction(4))
        if phi < 1:
            cov = phi ** np.abs(np.subtract.outer(np.arange(128), np.arange(128))) if phi else np.eye(128)
            inv, one = np.linalg.inv(cov), np.ones(128)
            m = one @ inv @ x[:, 0] / (one @ inv @ one)
            t = m / math.sqrt((x[:, 0] - m) @ inv @ (x[:, 0] - m) / 127 / (one @ inv @ one))
            value = lambda p, phi=phi: sum(c * Fraction(phi) ** i for i, c in enumerate(p))
            assert (value(a) > 0 and value(r) > 0) == (t > 2)


def test_certified_decisions(spark):
    x = simulate.simulate(160, 3, phi=0.3, mean=[0.0, 1.5, -1.0], seed=4)
    for test in (certified.reference_test, certified.multiscale_test):
        got = test(panel(spark, x)).orderBy("col").collect()
        assert [r["reject"] for r in got] == [False, True, False] and got[0]["global_reject"]
        assert any(b["low"] <= 0.3 <= b["high"] for b in got[0]["interval_bounds"])
    with pytest.raises(ValueError):
        certified.multiscale_test(panel(spark, x), beta=0.2)


def test_exact_moments_and_tail_statistics(spark, x):
    assert reference.ar1_mean_variance(50, 0.6) == pytest.approx((0.6 ** np.abs(np.subtract.outer(np.arange(50), np.arange(50)))).mean())
    mean, variance = reference.ar1_hac_moments(60, 0.5, 4)
    rng = np.random.default_rng(6)
    draws = [slow_hac(simulate.simulate(60, 1, phi=0.5, seed=int(s))[:, 0], 4) for s in rng.integers(0, 1 << 40, 4000)]
    assert mean == pytest.approx(np.mean(draws), rel=0.03) and variance == pytest.approx(np.var(draws), rel=0.12)
    assert reference.ar1_hac_moments(200, 0.7, 4)[0] == pytest.approx(2.92, abs=0.01) and reference.ar1_hac_moments(200, 0.9, 4)[0] == pytest.approx(3.77, abs=0.01)
    got = hac.tail_statistics(panel(spark, x), 3, phi=0.4).orderBy("col").collect()
    factor = (1.4 / 0.6) / hac.bartlett_mass(0.4, 4)
    assert [r["statistic"] for r in got] == pytest.approx([x[:, k].mean() / math.sqrt(slow_hac(x[:, k], 3) * factor / 96) for k in range(3)])


def test_public_names_load():
    import augurline

    assert all(getattr(augurline, name) is not None for name in augurline.__all__)


def test_simulation(spark):
    x = simulate.simulate(4000, 2, phi=0.6, cross_corr=0.5, seed=1)
    assert np.corrcoef(x[1:, 0], x[:-1, 0])[0, 1] == pytest.approx(0.6, abs=0.05) and x.var() == pytest.approx(1, abs=0.15)
    assert np.corrcoef(x.T)[0, 1] == pytest.approx(0.5, abs=0.08)
    for process in ("student_ar", "garch"):
        assert simulate.simulate(5000, 1, process, seed=2).var() == pytest.approx(1, abs=0.3)
    for kind in ("constant", "stochastic_scale", "step_scale", "coefficient_break", "student"):
        assert np.isfinite(simulate.scenario(300, kind)).all()
    cells = [{"n": 40, "k": 2, "phi": 0.2}, {"n": 40, "k": 1, "delta": 1.0}]
    one = simulate.study(spark, cells, 6, n_resamples=39)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, simulate.study(spark, cells, 6, n_resamples=39).repartition(2).collect()))
    rates = {(r["cell"], r["method"]): r for r in simulate.rejection_rates(one).collect()}
    assert len(rates) == 8 and rates[1, "hac"]["rate"] > 0.8 and rates[1, "hac"]["upper"] == 1
    assert simulate.paired(one, "iid", "resampled").count() == 2
    q = spark.createDataFrame([(0, float(v)) for v in range(1, 20)], "cell int, statistic double")
    assert simulate.calibrated_level(q, 0.1).first()["cutoff"] == 18
    m = simulate.mean_interval(q, ["cell"], "statistic").first()
    assert (m["mean"], m["n"]) == (10, 19) and m["high"] - m["mean"] == pytest.approx(special.t_ppf(0.975, 18) * m["mcse"])
    assert 0 < simulate.replayed(spark, x[:50], lambda v: float(v.mean(axis=0).max()), 20, phi=0.6, rho=0.5) <= 1


def test_calibration_cells_and_pairing(spark):
    from augurline.operators import calibrate

    grid = calibrate.cells("full")
    assert len([c for c in grid if c["stage"] == "dependence"]) == 5 and len(grid) == 17
    assessed = sum(len(c["counts"]) for c in grid if c["stage"] != "sensitivity")
    assert assessed == 19
    with pytest.raises(ValueError):
        calibrate.cells("other")
    small = [c | {"n": 64, "replicates": 6, "k": min(c["k"], 5), "counts": tuple(x for x in c["counts"] if x <= 5) or (5,)} for c in calibrate.cells("quick")]
    found = calibrate.decisions(spark, small, resamples=39).cache()
    rows = calibrate.rates(found, small)
    by = {(r["stage"], r["process"], r["phi"], r["n_columns"], r["delta"], r["block_length"], r["method"]): r["rejections"] for r in rows}
    for (stage, process, phi, k, delta, block, method), n in by.items():
        assert n <= by.get((stage, process, phi, k, delta + 1, block, method), 6)  # a larger shift rejects no less
    assert {r["method"] for r in rows if r["process"] == "gaussian_ar"} == {"iid", "hac", "fixed", "resampled", "oracle"}
    assert all((r["upper"] is not None) == (r["method"] == "resampled" and r["delta"] == 0 and r["stage"] != "sensitivity") for r in rows)
    assert calibrate.assessment(rows, "quick") == "smoke only" and calibrate.assessment([{"upper": 0.2}], "full") == "failed"
    assert calibrate.variance_ratios(found).where("median > 0").count() == sum(len(c["multiples"]) for c in small if c["process"] == "gaussian_ar")
