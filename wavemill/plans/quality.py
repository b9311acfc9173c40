"""Queries on how clean units are, with their SQL twins."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, functions as F

from wavemill import catalog as C
from wavemill.operators import contamination as Q, dependence as D, triage as T

WIDTH = 2 * C.HOUR


def _sweep_sql() -> str:
    at, lags = (lambda i: f"c{abs(i)}"), range(1, 51)
    mean = lambda ls: f"({' + '.join(map(at, ls))}) / {len(ls)}.0"
    rate = ", ".join(mean(ls) for ls in ([*range(-49, -25), *range(25, 50)], range(-50, -10), range(11, 50)))
    sums = [" + ".join(f"2 * c{j}" for j in range(1, i + 1)) for i in range(1, 11)]
    means = ", ".join(f"({s}) / {2 * i}.0" for i, s in enumerate(sums, 1))
    z = ", ".join(f"(({s}) / 2.0 - rate * {i}) / sqrt(rate * {i})" for i, s in enumerate(sums, 1))
    return f"""WITH {C.EV},
p AS (SELECT a.unit, least(a.v, b.v) AS level, CAST(round_even(abs(b.t - a.t) / {WIDTH}.0, 0) AS BIGINT) AS lag
  FROM e a JOIN e b ON a.unit = b.unit AND a.event_id < b.event_id AND abs(b.t - a.t) < {50 * WIDTH}),
l AS (SELECT unit, level, {", ".join(f"count(*) FILTER (lag = {i}) AS n{i}" for i in lags)} FROM p WHERE lag > 0 GROUP BY ALL),
c AS (SELECT unit, level, {", ".join(f"sum(n{i}) OVER w AS c{i}" for i in lags)} FROM l WINDOW w AS (PARTITION BY unit ORDER BY level DESC)),
r AS (SELECT *, greatest({rate}) AS rate FROM c),
m AS (SELECT unit, level, rate, CASE WHEN rate > 0 THEN least({means}) / rate WHEN least({means}) = 0 THEN 0 ELSE 1 END AS ratio,
  CASE WHEN rate > 0 THEN least({z}) END AS z FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY level DESC) AS k FROM m WHERE z < -1.6448536269514729 AND ratio >= 0.2),
f AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY level) AS k FROM m),
u AS (SELECT unit, min(v) AS low, count(*) AS n FROM e GROUP BY unit),
x AS (SELECT u.unit, coalesce(b.level, low) AS cut, n, coalesce(b.rate, f.rate, 0) AS rate, coalesce(b.ratio, f.ratio, 0) AS ratio, coalesce(b.z, f.z) AS z
  FROM u LEFT JOIN b ON b.unit = u.unit AND b.k = 1 LEFT JOIN f ON f.unit = u.unit AND f.k = 1)
SELECT x.unit, cut, n, count(*) AS kept, round(rate, 6) AS rate, round(ratio, 6) AS ratio, round(z, 6) AS z FROM x JOIN e ON e.unit = x.unit AND e.v >= cut GROUP BY ALL"""


@C.register(_sweep_sql())
def contamination_cuts(spark, sf) -> DataFrame:
    """The amplitude from which on each unit's events are clean."""
    got = Q.cuts(C.stream(spark, sf), "unit", "t", "v", "event_id", WIDTH)
    return got.select("unit", "cut", "n", "kept", C.r6("rate"), C.r6("ratio"), C.r6("z"))


def _region_sql() -> str:
    raw = {i: exp(-0.5 * (i / 5) ** 2) for i in range(-20, 21)}
    weights = ", ".join(f"({i}, {w / sum(raw.values())!r}::DOUBLE)" for i, w in raw.items())
    return f"""WITH n AS (SELECT p_partkey AS c, CAST(p_partkey % 100 AS DOUBLE) AS x, p_retailprice / 10 AS z, CAST(p_size AS DOUBLE) AS a FROM part WHERE p_size > 3),
f AS (SELECT *, 50 * ln(5 + a) AS y FROM n),
k AS (SELECT a.c, sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.c ORDER BY d, b.c) AS r FROM f a JOIN f b ON a.c <> b.c),
m AS (SELECT c, z, a, d FROM n JOIN (SELECT c, avg(d) AS d FROM k WHERE r <= 5 GROUP BY c) USING (c)),
t AS (SELECT min(z) AS low, max(d) AS most, CAST(ceil((max(z) - min(z)) / 5) AS BIGINT) AS steps FROM m),
b AS (SELECT CAST(floor((z - low) / 5) AS BIGINT) + 1 AS k, avg(d) AS mean FROM m, t GROUP BY 1),
g AS (SELECT e.k, coalesce(mean, most) AS mean FROM (SELECT unnest(range(0, steps)) AS k, most FROM t) e LEFT JOIN b ON b.k = e.k),
w(i, w) AS (VALUES {weights}),
u AS (SELECT g.k + i AS k, sum(mean * w) AS usual FROM g, w, t WHERE g.k + i BETWEEN 0 AND steps - 1 GROUP BY 1),
l AS (SELECT k, usual, coalesce(lead(usual) OVER o - usual, usual - lag(usual) OVER o, 0) / 5 AS slope FROM u WINDOW o AS (ORDER BY k)),
v AS (SELECT c, d, a, usual + slope * (z - low - k * 5) AS usual FROM m, t, l WHERE k = least(floor((z - low) / 5), steps - 1)),
s AS (SELECT c, d, CASE WHEN usual > 0 THEN ln(d) - ln(usual) - ln(50 * ln(a)) END AS score FROM v), q AS (SELECT quantile_cont(score, 0.8) AS q FROM s)
SELECT c, round(d, 6) AS distance, round(score, 6) AS score, coalesce(score <= q, false) AS kept FROM s, q"""


@C.register(_region_sql())
def triage_by_region(spark, sf) -> DataFrame:
    """Points close to their neighbours, by what is usual at their depth."""
    z = (F.col("p_retailprice") / 10).alias("z")
    n = C.table(spark, sf, "part").select(F.col("p_partkey").alias("c"), (F.col("p_partkey") % 100).alias("x"), z, F.col("p_size").alias("a"))
    return T.region_adaptive(n, "c", "x", "z", "a").select("c", C.r6("distance"), C.r6("score"), "kept")


@C.register(
    """WITH n AS (SELECT p_partkey AS c, p_retailprice AS y, CAST(p_partkey % 1000 AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b FROM part),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY y, c) AS DOUBLE) AS r, CAST(count(*) OVER () AS DOUBLE) AS n FROM n),
k AS (SELECT x.r, x.n, z.r AS s, row_number() OVER (PARTITION BY x.c ORDER BY sqrt(pow(x.a - z.a, 2) + pow(x.b - z.b, 2)), z.c) AS k FROM r x JOIN r z ON x.c <> z.c)
SELECT CAST(max(n) AS BIGINT) AS n, round(sum(n * least(r, s) - (n - r + 1) * (n - r + 1)) / sum((n - r + 1) * (n - (n - r + 1))), 6) AS dependence FROM k WHERE k = 1"""
)
def conditional_dependence(spark, sf) -> DataFrame:
    """Of prices on a part's place in its thousand and its size."""
    n = C.table(spark, sf, "part").select(F.col("p_partkey").alias("c"), "p_retailprice", (F.col("p_partkey") % 1000).alias("a"), F.col("p_size").alias("b"))
    return D.conditional_dependence(n, "c", "p_retailprice", ["a", "b"]).select("n", C.r6("dependence"))
