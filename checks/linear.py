"""Ridge regressions in SQL: normal equations as sums of products, solved by elimination in a recursive query."""

from __future__ import annotations

from collections.abc import Sequence


def solved(source: str, name: str) -> str:
    """`source` has (key, i, j, a): rows 1..n of symmetric positive definite systems and their right sides in columns n+1 on.
    `name` gets (key, i, b), b the list of row i's solutions."""
    return f"""
{name}_rows AS (SELECT key, i, list(a ORDER BY j) AS r FROM {source} GROUP BY key, i),
{name}_steps AS (
  SELECT key, 1 AS k, count(*) AS n, list(r ORDER BY i) AS m FROM {name}_rows GROUP BY key
  UNION ALL
  SELECT key, k + 1, n, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(p, lambda v: v / p[k]) ELSE list_transform(r, lambda v, j: v - r[k] / p[k] * p[j]) END)
  FROM (SELECT key, k, n, m, m[k] AS p FROM {name}_steps WHERE k <= n)),
{name} AS (SELECT key, i, m[i][n + 1:] AS b FROM (SELECT key, n, m, unnest(range(1, n + 1)) AS i FROM {name}_steps WHERE k = n + 1))"""


def pairs(names: Sequence[str], weight: str = "1e0") -> str:
    """A list of {i, j, a}: the sum of the products of every two of the columns."""
    cells = [f"{{'i': {i}, 'j': {j}, 'a': sum({a} * {b} * {weight})}}" for i, a in enumerate(names, 1) for j, b in enumerate(names, 1) if i <= j]
    return f"[{', '.join(cells)}]"


def mirrored(source: str, keys: str) -> str:
    return f"SELECT {keys}, p.i AS i, p.j AS j, p.a AS a FROM {source} UNION ALL SELECT {keys}, p.j, p.i, p.a FROM {source} WHERE p.i < p.j"


def panel_ridge(rows: str, names: Sequence[str], alphas: Sequence[float], cases: dict[str, Sequence[str]]) -> str:
    """CTEs for ridge with median filling, scaling and stock effects.

    `rows` has (fit, fits, preps, stock_id, target, features...): whether a row of a fit counts for its model and for its
    preprocessing. Results: `prep`(fit, m, c, s) with a list each, `coefs`(fit, alpha, name, b) with a coefficient per
    feature and the intercept, and `effects`(fit, alpha, name, stock_id, effect).
    """
    d = len(names)
    z = [f"z{i}" for i in range(1, d + 1)]
    held = {case: [*[i for i, f in enumerate(names, 1) if f in set(kept)], d + 1] for case, kept in cases.items()}
    places = ", ".join(f"('{case}', {i}, {k})" for case, at in held.items() for k, i in enumerate([*at, d + 2], 1))
    return f"""
med AS MATERIALIZED (SELECT fit, [{', '.join(f"coalesce(quantile_cont({f}, 0.5), 0)" for f in names)}] AS m FROM {rows} WHERE preps GROUP BY fit),
prep AS MATERIALIZED (
  SELECT fit, m, [{', '.join(f"avg(coalesce({f}, m[{i}]))" for i, f in enumerate(names, 1))}] AS c,
    list_transform([{', '.join(f"stddev_pop(coalesce({f}, m[{i}]))" for i, f in enumerate(names, 1))}], lambda s: CASE WHEN s > 1e-12 THEN s ELSE 1 END) AS s
  FROM {rows} JOIN med USING (fit) WHERE preps GROUP BY fit, m),
std AS MATERIALIZED (
  SELECT fit, stock_id, {', '.join(f"(coalesce({f}, m[{i}]) - c[{i}]) / s[{i}] AS z{i}" for i, f in enumerate(names, 1))}, 1e0 AS one, target
  FROM {rows} JOIN prep USING (fit) WHERE fits),
whole AS MATERIALIZED (SELECT fit, unnest({pairs([*z, "one", "target"])}) AS p FROM std GROUP BY fit),
stock AS MATERIALIZED (SELECT fit, stock_id, count(*) AS n, {', '.join(f"sum({c}) AS {c}" for c in [*z, "one", "target"])} FROM std GROUP BY fit, stock_id),
alphas AS (SELECT unnest([{', '.join(str(float(a)) for a in alphas)}])::DOUBLE AS alpha),
taken AS MATERIALIZED (SELECT fit, alpha, unnest({pairs([*z, "one", "target"], "(1 / (n + alpha))")}) AS p FROM stock, alphas GROUP BY fit, alpha),
grams AS ({mirrored("whole", "fit, NULL::DOUBLE AS alpha")} UNION ALL {mirrored("taken", "fit, alpha")}),
normal AS (
  SELECT w.fit, t.alpha, w.i, w.j, w.a - t.a + CASE WHEN w.i = w.j AND w.i <= {d} THEN t.alpha ELSE 0 END AS a
  FROM (SELECT * FROM grams WHERE alpha IS NULL) w JOIN (SELECT * FROM grams WHERE alpha IS NOT NULL) t USING (fit, i, j)),
places(name, i, place) AS (VALUES {places}),
systems AS MATERIALIZED (
  SELECT struct_pack(fit := fit, alpha := alpha, name := r.name) AS key, r.place AS i, c.place AS j, a
  FROM normal JOIN places r USING (i) JOIN places c ON c.name = r.name AND c.i = normal.j WHERE normal.i <= {d + 1}),
{solved("systems", "solution")},
coefs AS MATERIALIZED (
  SELECT k.fit, k.alpha, k.name, list(coalesce(b[1], 0) ORDER BY q.i) AS b
  FROM (SELECT DISTINCT key AS k FROM systems) CROSS JOIN (SELECT unnest(range(1, {d + 2})) AS i) q
  LEFT JOIN places ON places.name = k.name AND places.i = q.i LEFT JOIN solution ON solution.key = k AND solution.i = places.place
  GROUP BY ALL),
effects AS MATERIALIZED (
  SELECT fit, alpha, name, stock_id, (target - list_dot_product([{', '.join([*z, "one"])}], b)) / (n + alpha) AS effect FROM stock JOIN coefs USING (fit))"""


def panel_prediction(names: Sequence[str]) -> str:
    """The prediction of a row joined to prep, coefs and, to the left, effects."""
    z = ", ".join(f"(coalesce({f}, m[{i}]) - c[{i}]) / s[{i}]" for i, f in enumerate(names, 1))
    return f"list_dot_product([{z}, 1e0], b) + coalesce(effect, 0)"


def scaled_ridge(rows: str, names: Sequence[str], target: str, alphas: Sequence[float]) -> str:
    """CTEs for ridge on scaled features with a free intercept; `rows` has (fit, features..., target). `coefs` gets
    (fit, alpha, c, s, b)."""
    d = len(names)
    z = [f"z{i}" for i in range(1, d + 1)]
    return f"""
prep AS MATERIALIZED (
  SELECT fit, [{', '.join(f"avg({f})" for f in names)}] AS c, list_transform([{', '.join(f"stddev_pop({f})" for f in names)}], lambda s: CASE WHEN s > 1e-12 THEN s ELSE 1 END) AS s
  FROM {rows} GROUP BY fit),
std AS MATERIALIZED (SELECT fit, {', '.join(f"({f} - c[{i}]) / s[{i}] AS z{i}" for i, f in enumerate(names, 1))}, 1e0 AS one, {target} AS target FROM {rows} JOIN prep USING (fit)),
whole AS MATERIALIZED (SELECT fit, unnest({pairs([*z, "one", "target"])}) AS p FROM std GROUP BY fit),
cells AS MATERIALIZED ({mirrored("whole", "fit")}),
systems AS MATERIALIZED (
  SELECT struct_pack(fit := fit, alpha := alpha) AS key, i, j, a + CASE WHEN i = j AND i <= {d} THEN alpha ELSE 0 END AS a
  FROM cells, (SELECT unnest([{', '.join(str(float(a)) for a in alphas)}])::DOUBLE AS alpha) WHERE i <= {d + 1}),
{solved("systems", "solution")},
coefs AS MATERIALIZED (SELECT key.fit AS fit, key.alpha AS alpha, c, s, list(b[1] ORDER BY i) AS b FROM solution JOIN prep ON prep.fit = key.fit GROUP BY ALL)"""


def scaled_prediction(names: Sequence[str]) -> str:
    z = ", ".join(f"({f} - c[{i}]) / s[{i}]" for i, f in enumerate(names, 1))
    return f"list_dot_product([{z}, 1e0], b)"
