"""SQL text of the gamma fit, mirroring the published formulas step by step."""

from __future__ import annotations

from spotrace.operators.stats import LOC_HIGH, LOC_LOW, LOC_POINTS, LOC_ROUNDS, NEWTON_STEPS


def _digamma(a: str) -> str:
    z = f"({a} + 8)"
    below = " + ".join(f"1.0 / ({a} + {k})" for k in range(8))
    return (
        f"(ln({z}) - 0.5 / {z} - 1.0 / (12 * {z} ** 2) + 1.0 / (120 * {z} ** 4)"
        f" - 1.0 / (252 * {z} ** 6) + 1.0 / (240 * {z} ** 8) - ({below}))"
    )


def _trigamma(a: str) -> str:
    z = f"({a} + 8)"
    below = " + ".join(f"1.0 / (({a} + {k}) * ({a} + {k}))" for k in range(8))
    return (
        f"(1.0 / {z} + 1.0 / (2 * {z} ** 2) + 1.0 / (6 * {z} ** 3) - 1.0 / (30 * {z} ** 5)"
        f" + 1.0 / (42 * {z} ** 7) + {below})"
    )


def gamma_fit(src: str = "dwell") -> str:
    """CTE ``fit`` over (datum, dwell_s)."""
    ctes = [
        f"span AS (SELECT datum, min(dwell_s) AS lo, max(dwell_s) AS hi, count(*) AS n, "
        f"{(LOC_LOW + LOC_HIGH) / 2}::DOUBLE AS e FROM {src} GROUP BY datum HAVING max(dwell_s) > min(dwell_s))"
    ]
    reach, prev = (LOC_HIGH - LOC_LOW) / 2, "span"
    for r in range(LOC_ROUNDS):
        step = 2 * reach / (LOC_POINTS - 1)
        offsets = ", ".join(f"({round(-reach + k * step, 12)!r}::DOUBLE)" for k in range(LOC_POINTS))
        ctes.append(
            f"try{r} AS (SELECT DISTINCT b.datum, b.lo, b.hi, b.n, "
            f"greatest(least(b.e + o.o, {LOC_HIGH}::DOUBLE), {LOC_LOW}::DOUBLE) AS e "
            f"FROM {prev} b CROSS JOIN (VALUES {offsets}) AS o(o))"
        )
        ctes.append(
            f"loc{r} AS (SELECT *, lo - pow(10.0, e) * (hi - lo) AS loc FROM try{r})"
        )
        ctes.append(
            f"sum{r} AS (SELECT l.datum, lo, hi, n, e, loc, sum(dwell_s - loc) / count(*) AS mean, "
            f"sum(ln(dwell_s - loc)) / count(*) AS mean_log FROM loc{r} l JOIN {src} d ON d.datum = l.datum GROUP BY ALL)"
        )
        ctes.append(
            f"a{r}_0 AS (SELECT *, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS a "
            f"FROM (SELECT *, ln(mean) - mean_log AS s FROM sum{r}) WHERE s > 0)"
        )
        for k in range(NEWTON_STEPS):
            ctes.append(
                f"a{r}_{k + 1} AS (SELECT * EXCLUDE (a), 1.0 / (1.0 / a + (ln(a) - {_digamma('a')} - s) "
                f"/ (a * a * (1.0 / a - {_trigamma('a')}))) AS a FROM a{r}_{k})"
            )
        ctes.append(
            f"lik{r} AS (SELECT *, mean / a AS scale, n * ((a - 1) * mean_log - a - a * ln(mean / a) - lgamma(a)) AS log_lik "
            f"FROM a{r}_{NEWTON_STEPS})"
        )
        ctes.append(
            f"best{r} AS (SELECT * FROM lik{r} QUALIFY row_number() OVER (PARTITION BY datum ORDER BY log_lik DESC) = 1)"
        )
        prev, reach = f"best{r}", step
    ctes.append(f"fit AS (SELECT datum, n, a AS shape, loc, scale, log_lik FROM {prev})")
    return ",\n".join(ctes)


def cdf(x: str, terms: int = 3000) -> str:
    """Distribution function at ``x`` from columns shape, loc and scale, by its power series."""
    z = f"(({x} - loc) / scale)"
    return (
        f"CASE WHEN {z} <= 0 THEN 0 ELSE list_sum(list_transform(range(0, {terms}), "
        f"lambda k: exp((shape + k) * ln({z}) - {z} - lgamma(shape + k + 1)))) END"
    )
