"""SQL text for checks: the PCG64 stream, the family test made from it, and tails of distributions, in plain DuckDB expressions.

The random numbers follow the published generator (128-bit linear congruential steps, XSL-RR output, upper 53 bits as a double); only
the state that a seed gives is taken from NumPy.  Draws are addressed by jumping ahead, as affine maps compose.
"""

from __future__ import annotations

import numpy as np

#: Fixed value: the multiplier of the generator.
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645
WORD = "18446744073709551616::UHUGEINT"


def _word(value: int) -> str:
    return f"{value}::UHUGEINT"


def _times(xh: str, xl: str, yh: str, yl: str, ch: str = "0", cl: str = "0") -> tuple[str, str]:
    """Upper and lower half of x * y + c modulo 2**128, with halves below 2**64."""
    low = f"(({xl}) * ({yl}) % {WORD} + {cl})"
    high = f"((({xl}) * ({yl}) // {WORD} + ({xh}) * ({yl}) % {WORD} + ({xl}) * ({yh}) % {WORD} + {ch} + {low} // {WORD}) % {WORD})"
    return high, f"({low} % {WORD})"


def stream_sql(seed: int, n_draws: int, n: str, block: str) -> str:
    """CTEs that end with draws(b, pos, idx): the rows of each draw of a sample of n, blocks of mean length `block`.

    n and block are scalar subqueries or numbers.  The statement must begin with WITH RECURSIVE.
    """
    state = np.random.PCG64(seed).state["state"]
    (ah, al), (sh, sl), (ch, cl) = ((_word(v >> 64), _word(v & (1 << 64) - 1)) for v in (MULTIPLIER, state["state"], state["inc"]))
    mh, ml = _times("mh", "ml", ah, al)
    kh, kl = _times("kh", "kl", ah, al, ch, cl)
    bh, bl = _times("starts.hi", "starts.lo", "jump.mh", "jump.ml", "jump.kh", "jump.kl")
    wh, wl = _times("hi", "lo", ah, al, ch, cl)
    mixed = "xor(hi, lo)"
    turn = "CAST(hi // 288230376151711744::UHUGEINT AS INTEGER)"
    rotated = f"(({mixed} // CAST(pow(2, {turn}) AS UHUGEINT)) + ({mixed} * CAST(pow(2, 64 - {turn}) AS UHUGEINT)) % {WORD})"
    return f"""sz AS MATERIALIZED (SELECT CAST({n} AS BIGINT) AS n, CAST({block} AS DOUBLE) AS block),
 jumps AS (SELECT CAST(0 AS BIGINT) AS i, {_word(0)} AS mh, {_word(1)} AS ml, {_word(0)} AS kh, {_word(0)} AS kl UNION ALL SELECT i + 1, {mh}, {ml}, {kh}, {kl} FROM jumps WHERE i < (SELECT 2 * n FROM sz)),
 jump AS MATERIALIZED (SELECT * FROM jumps WHERE i = (SELECT 2 * n FROM sz)),
 starts AS (SELECT CAST(0 AS BIGINT) AS b, {sh} AS hi, {sl} AS lo UNION ALL SELECT b + 1, {bh}, {bl} FROM starts CROSS JOIN jump WHERE b + 1 < {n_draws}),
 walk AS (SELECT b, CAST(0 AS BIGINT) AS i, hi, lo FROM starts UNION ALL SELECT b, i + 1, {wh}, {wl} FROM walk WHERE i < (SELECT 2 * n FROM sz)),
 uniform AS (SELECT b, (i - 1) // 2 AS pos, (i - 1) % 2 AS odd, CAST(({rotated}) // 2048::UHUGEINT AS DOUBLE) / 9007199254740992e0 AS u FROM walk WHERE i > 0),
 twos AS (SELECT b, pos, max(CASE WHEN odd = 0 THEN u END) AS u, max(CASE WHEN odd = 1 THEN u END) AS v FROM uniform GROUP BY 1, 2),
 held AS (SELECT b, pos, n, max(CASE WHEN pos = 0 OR u < 1 / block THEN pos * 4294967296 + CAST(floor(v * n) AS BIGINT) END) OVER (PARTITION BY b ORDER BY pos) AS held_at FROM twos CROSS JOIN sz),
 draws AS MATERIALIZED (SELECT b, pos, (held_at % 4294967296 + pos - held_at // 4294967296) % n AS idx FROM held)"""


def normal_tail(z: str) -> str:
    """P(Z > z), by the series of odd double factorials."""
    series = f"(SELECT sum(exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - (i + 1) * ln(2e0) - lgamma(i + 1.5e0) + 0.5e0 * ln(pi()))) FROM (SELECT CAST(unnest(range(400)) AS DOUBLE) AS i))"
    return f"(0.5e0 - sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series})"


def student_tail(t: str, df: str) -> str:
    """P(T > t), from the series of the incomplete beta function."""
    y = f"(({t}) * ({t}) / ({df} + ({t}) * ({t})))"
    series = f"(SELECT sum(exp(i * ln(greatest({y}, 1e-300)) + lgamma(({df} + 1) / 2e0 + i) - lgamma(({df} + 1) / 2e0) - lgamma(1.5e0 + i) + lgamma(1.5e0))) FROM (SELECT CAST(unnest(range(3000)) AS DOUBLE) AS i))"
    inner = f"(sqrt({y}) * pow(1 - {y}, {df} / 2e0) * 2 * exp(lgamma(({df} + 1) / 2e0) - lgamma(0.5e0) - lgamma({df} / 2e0)) * {series})"
    return f"(0.5e0 - sign({t}) * 0.5e0 * {inner})"


def family_sql(n_draws: int, *, seed: int = 0, alpha: str = "0.05e0", resampled: bool = False, lags: str | None = None, block: str | None = None, complete: bool = False) -> str:
    """CTEs that turn a panel p(panel_id, t, col, name, value) into family(...), the test's row for each column.

    lags and block: scalar expressions of n; the defaults follow the sample size.  Must stand in WITH RECURSIVE.
    """
    lag_count = lags or "least(floor(4 * pow(n / 100e0, 2 / 9e0)), n - 2)"
    block_size = block or "least(ceil(2 * pow(n, 1 / 3e0)), n)"
    size = "(SELECT count(*) FROM p WHERE col = 0)"
    lagged = f"""dr AS MATERIALIZED (SELECT d.b, ob.col, d.pos, ob.e - avg(ob.e) OVER (PARTITION BY d.b, ob.col) AS e, avg(ob.e) OVER (PARTITION BY d.b, ob.col) AS dm FROM draws d JOIN ob ON ob.t = d.idx),
 dl AS (SELECT x.b, x.col, max(x.dm) AS dm, sum(x.e * x.e) AS g0, max(y.g) AS g FROM dr x LEFT JOIN (SELECT b, col, sum((1 - h / (lags + 1e0)) * w) AS g FROM (SELECT x.b, x.col, h.h, h.lags, sum(x.e * y.e) AS w FROM dr x CROSS JOIN (SELECT lags, unnest(range(1, lags + 1)) AS h FROM lg) h JOIN dr y ON y.b = x.b AND y.col = x.col AND y.pos = x.pos - h.h GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) y ON y.b = x.b AND y.col = x.col GROUP BY 1, 2),
 st AS MATERIALIZED (SELECT b, col, dm / sqrt((g0 + 2 * coalesce(g, 0)) / n / n) AS s FROM dl CROSS JOIN lg)"""
    fixed = "st AS MATERIALIZED (SELECT d.b, ob.col, avg(ob.e) / max(o.se) AS s FROM draws d JOIN ob ON ob.t = d.idx JOIN o ON o.col = ob.col GROUP BY 1, 2)"
    z = "1.959963984540054e0"
    share = f"(k_best / {n_draws}e0)"
    spread = f"({z} * sqrt({share} * (1 - {share}) / {n_draws} + {z} * {z} / (4e0 * {n_draws} * {n_draws})))"
    centre = f"({share} + {z} * {z} / (2e0 * {n_draws}))"
    bottom = f"(1 + {z} * {z} / {n_draws}e0)"
    low, high = f"CASE WHEN k_best = 0 THEN 0e0 ELSE ({centre} - {spread}) / {bottom} END", f"CASE WHEN k_best = {n_draws} THEN 1e0 ELSE ({centre} + {spread}) / {bottom} END"
    warn = [
        ("few draws in the tail", f"{n_draws} * {alpha} < 20"), ("the Monte Carlo interval of the family p-value holds alpha", f"tail_low <= {alpha} AND {alpha} <= tail_high"), ("fewer than 100 observations", "n < 100"), ("the search is not stated to be complete", "false" if complete else "true")
    ]
    listed = "concat_ws('; ', " + ", ".join(f"CASE WHEN {on} THEN '{text}' END" for text, on in warn) + ")"
    rank = f"(CAST(ceil(({n_draws} - 1) * (1 - {alpha})) AS BIGINT) + 1)"
    return f"""{stream_sql(seed, n_draws, size, f"(SELECT {block_size} FROM (SELECT {size} AS n))")},
 lg AS MATERIALIZED (SELECT n, CAST({lag_count} AS BIGINT) AS lags FROM sz),
 ob AS MATERIALIZED (SELECT col, name, t, value - avg(value) OVER (PARTITION BY col) AS e FROM p),
 hv AS (SELECT x.col, sum(CASE WHEN h.h = 0 THEN 1 ELSE 2 * (1 - h.h / (h.lags + 1e0)) END * x.e * y.e) / max(h.n) AS lrv FROM ob x CROSS JOIN (SELECT n, lags, unnest(range(lags + 1)) AS h FROM lg) h JOIN ob y ON y.col = x.col AND y.t = x.t - h.h GROUP BY 1),
 o AS MATERIALIZED (SELECT q.*, sqrt(lrv / n) AS se, mean / sqrt(lrv / n) AS stat FROM (SELECT panel_id, col, name, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM p GROUP BY 1, 2, 3) q JOIN hv USING (col)),
 {lagged if resampled else fixed},
 tp AS MATERIALIZED (SELECT b, max(s) AS top, max(abs(s)) AS wide FROM st GROUP BY 1),
 cu AS (SELECT max(CASE WHEN r = {rank} THEN top END) AS max_cutoff, max(CASE WHEN w = {rank} THEN wide END) AS max_abs_cutoff FROM (SELECT top, wide, row_number() OVER (ORDER BY top) AS r, row_number() OVER (ORDER BY wide) AS w FROM tp)),
 ex AS (SELECT o.col, sum(CAST(st.s >= o.stat AS INTEGER)) AS k_own, sum(CAST(tp.top >= o.stat AS INTEGER)) AS k_top FROM st JOIN o USING (col) JOIN tp USING (b) GROUP BY 1),
 fa AS (SELECT o.*, ex.*, row_number() OVER (ORDER BY stat DESC, o.col) = 1 AS selected, first_value(k_top) OVER (ORDER BY stat DESC, o.col) AS k_best FROM o JOIN ex USING (col)),
 fb AS (SELECT *, {low} AS tail_low, {high} AS tail_high FROM fa CROSS JOIN cu),
 family AS MATERIALIZED (SELECT panel_id, CAST(col AS INTEGER) AS col, name, CAST(n AS INTEGER) AS n, mean, se AS standard_error, stat AS statistic, {student_tail("(mean / (sd / sqrt(n)))", "(n - 1)")} AS iid_pvalue, {normal_tail("stat")} AS hac_pvalue, (1 + k_own) / {n_draws + 1}e0 AS marginal_pvalue, (1 + k_top) / {n_draws + 1}e0 AS adjusted_pvalue, (1 + k_top) / {n_draws + 1}e0 <= {alpha} AS reject, selected, (1 + k_best) / {n_draws + 1}e0 AS global_pvalue,
 mean - max_abs_cutoff * se AS simultaneous_low, mean + max_abs_cutoff * se AS simultaneous_high, mean - max_cutoff * se AS one_sided_lower, max_cutoff, max_abs_cutoff, tail_low, tail_high, CAST((SELECT lags FROM lg) AS INTEGER) AS lags, (SELECT block FROM sz) AS block_length, CAST({n_draws} AS INTEGER) AS n_resamples, {listed} AS warnings FROM fb)"""


def student_width(tail: str, df: str) -> str:
    """CTEs that end with width(df, x), where P(T > x) = tail for the df of a scalar expression, by Newton steps."""
    density = "(exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2e0))"
    steps = ["width0 AS (SELECT CAST(" + df + " AS DOUBLE) AS df, 2e0 AS x)"]
    steps += [f"width{k + 1} AS MATERIALIZED (SELECT df, x + ({student_tail('x', 'df')} - {tail}) / {density} AS x FROM width{k})" for k in range(7)]
    return ", ".join(steps) + ", width AS (SELECT * FROM width7)"


#: The columns of family_sql that are doubles.
FAMILY_DOUBLES = ("mean", "standard_error", "statistic", "iid_pvalue", "hac_pvalue", "marginal_pvalue", "adjusted_pvalue", "global_pvalue", "simultaneous_low", "simultaneous_high", "one_sided_lower", "max_cutoff", "max_abs_cutoff", "tail_low", "tail_high", "block_length")
FAMILY_OTHERS = ("panel_id", "col", "name", "n", "reject", "selected", "lags", "n_resamples", "warnings")


def simulated_sql(replicates: int, n: int, k: int, *, seed: int, phi: float, cross: float) -> str:
    """CTEs that end with p(panel_id, t, col, name, value): Gaussian AR(1) panels from NumPy's normal numbers, given as values."""
    rows = []
    for r in range(replicates):
        rng = np.random.default_rng(int(np.random.SeedSequence(seed, spawn_key=(r,)).generate_state(1, np.uint64)[0]))
        common, own = rng.standard_normal(n).tolist(), rng.standard_normal(n * k).tolist()
        rows.append(f"({r}, {common}::DOUBLE[], {own}::DOUBLE[])")
    return f"""zs AS (SELECT * FROM (VALUES {', '.join(rows)}) AS q(r, common, own)),
 cells AS (SELECT r, common, own, t, unnest(range({k})) AS col FROM (SELECT *, unnest(range({n})) AS t FROM zs)),
 shock AS MATERIALIZED (SELECT r, t, col, (sqrt({cross}e0) * common[t + 1] + sqrt(1 - {cross}e0) * own[t * {k} + col + 1]) * CASE WHEN t = 0 THEN 1e0 ELSE sqrt(1 - {phi}e0 * {phi}e0) END AS z FROM cells),
 p AS MATERIALIZED (SELECT CAST(a.r AS VARCHAR) AS panel_id, a.t, a.col, 'strategy_' || (a.col + 1) AS name, sum(pow({phi}e0, a.t - b.t) * b.z) AS value FROM shock a JOIN shock b ON a.r = b.r AND a.col = b.col AND b.t <= a.t GROUP BY 1, 2, 3, 4)"""


def multistep_sql(leads: tuple[int, ...], scales: tuple[float, ...], weights: tuple[float, ...], *, alpha: float, step: float, decay: float, keep: float) -> str:
    """CTEs that turn series s(series_id, t, y) into issued(...): interlaced intervals of blended scales around the last value.

    A scale follows its lead's residuals alone and a lane its own feedback alone, so there are two recursions, over times and over a
    lane's forecasts.  Must stand in WITH RECURSIVE.
    """
    listed = ", ".join(f"({k}, {lead}, {scale}e0, {weight}e0)" for k, (lead, scale, weight) in enumerate(zip(leads, scales, weights, strict=True)))
    return f"""ld AS (SELECT CAST(k AS BIGINT) AS k, CAST(lead AS BIGINT) AS lead, s0, w FROM (VALUES {listed}) AS q(k, lead, s0, w)),
 rs AS MATERIALIZED (SELECT a.series_id, k, a.t, abs(a.y - b.y) AS r FROM s a CROSS JOIN ld JOIN s b ON a.series_id = b.series_id AND b.t = a.t - lead),
 ow AS (SELECT series_id, k, s0, lead - 1 AS t, s0 AS own FROM (SELECT DISTINCT series_id FROM s) CROSS JOIN ld UNION ALL SELECT ow.series_id, ow.k, s0, rs.t, greatest(s0 * 1e-6, sqrt({keep}e0 * own * own + (1 - {keep}e0) * r * r)) FROM ow JOIN rs ON rs.series_id = ow.series_id AND rs.k = ow.k AND rs.t = ow.t + 1),
 oa AS (SELECT s.series_id, s.t, s.y, ld.*, coalesce(ow.own, ld.s0) AS own, coalesce(os.own, {scales[0]}e0) AS source FROM s CROSS JOIN ld LEFT JOIN ow ON ow.series_id = s.series_id AND ow.k = ld.k AND ow.t = s.t AND s.t >= ld.lead LEFT JOIN ow os ON os.series_id = s.series_id AND os.k = 0 AND os.t = s.t AND s.t >= {leads[0]}),
 ob AS (SELECT *, greatest(s0 * 1e-6, source * s0 / {scales[0]}e0) AS shared FROM oa),
 sc AS (SELECT series_id, t, y, k, lead, CASE WHEN t < {leads[0]} THEN s0 WHEN w = 0 THEN own WHEN w = 1 THEN shared ELSE greatest(least(own, shared), greatest(own, shared) * ((1 - w) * (own / greatest(own, shared)) + w * (shared / greatest(own, shared)))) END AS scale FROM ob),
 fc AS MATERIALIZED (SELECT sc.series_id, k, lead, sc.t AS origin, sc.t % lead AS lane, sc.t // lead AS i, sc.y AS predicted, scale, a.y AS actual FROM sc LEFT JOIN s a ON a.series_id = sc.series_id AND a.t = sc.t + lead),
 ch AS (SELECT series_id, k, lane, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS origin, lead, 0e0 AS predicted, 0e0 AS scale, CAST(NULL AS DOUBLE) AS actual, 0.5e0 AS q0, CAST(NULL AS BOOLEAN) AS miss, 0e0 AS rate, 0.5e0 AS q1, CAST(0 AS BIGINT) AS n FROM fc WHERE i = 0
 UNION ALL SELECT series_id, k, lane, i, origin, lead, predicted, scale, actual, q0, miss, rate, q0 + rate * (CAST(miss AS INTEGER) - {alpha}e0), n FROM (SELECT fc.series_id, fc.k, fc.lane, fc.i, fc.origin, fc.lead, fc.predicted, fc.scale, fc.actual, ch.q1 AS q0, {step}e0 * pow(CAST(ch.n + 1 AS DOUBLE), -{decay}e0) AS rate, ch.n + 1 AS n,
 CASE WHEN fc.actual IS NULL THEN NULL WHEN ch.q1 < 0 THEN true WHEN ch.q1 >= 1 THEN false ELSE fc.actual < fc.predicted - fc.scale * ch.q1 / (1 - ch.q1) OR fc.actual > fc.predicted + fc.scale * ch.q1 / (1 - ch.q1) END AS miss FROM ch JOIN fc ON fc.series_id = ch.series_id AND fc.k = ch.k AND fc.lane = ch.lane AND fc.i = ch.i + 1)),
 issued AS MATERIALIZED (SELECT series_id, origin, origin + lead AS target_index, lead AS lead_time, lane, predicted, CASE WHEN q0 < 0 THEN 'empty' WHEN q0 >= 1 THEN 'unbounded' ELSE 'finite' END AS kind, CASE WHEN q0 >= 0 AND q0 < 1 THEN predicted - scale * q0 / (1 - q0) END AS lower, CASE WHEN q0 >= 0 AND q0 < 1 THEN predicted + scale * q0 / (1 - q0) END AS upper,
 q0 AS quantile, scale, actual, miss, CASE WHEN actual IS NOT NULL THEN rate END AS rate, CASE WHEN actual IS NOT NULL THEN q1 END AS new_quantile, CASE WHEN actual IS NOT NULL THEN n END AS n_updates FROM ch WHERE i >= 0)"""
