"""Oracle SQL of small linear models: Newton steps on two features and an intercept, written out step by step."""

from __future__ import annotations

_X = ("x1", "x2", "1")


def _solve3() -> list[str]:
    """The three components of the solution of a symmetric 3 x 3 system (h00 ... h22, g0 ... g2), by cofactors."""
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]

    def minor(i: int, j: int) -> str:
        (a, b), (c, d) = ([h[r][s] for s in range(3) if s != j] for r in range(3) if r != i)
        return f"({a} * {d} - {b} * {c})"

    det = f"({h[0][0]} * {minor(0, 0)} - {h[0][1]} * {minor(0, 1)} + {h[0][2]} * {minor(0, 2)})"
    return [f"(({' + '.join(f'{(-1) ** (i + j)} * {minor(j, i)} * g{j}' for j in range(3))}) / {det})" for i in range(3)]


def newton_ctes(name: str, rows: str, loss: str, *, by: str = "grp", c: float = 1.0, penalise_intercept: bool = True, steps: int = 20) -> str:
    """CTEs that end in ``name`` ({by}, w1, w2, w0), fitted on ``rows`` ({by}, x1, x2, y in 0/1).

    The same objective as the library's: half the squared weights plus c times the sum of the losses.
    """
    pen = (1.0, 1.0, float(penalise_intercept))
    if loss == "squared_hinge":
        slope = "CASE WHEN (2 * y - 1) * z < 1 THEN 2 * (z - (2 * y - 1)) ELSE 0 END"
        bend = "CASE WHEN (2 * y - 1) * z < 1 THEN 2.0::DOUBLE ELSE 0 END"
    else:
        slope, bend = "1 / (1 + exp(-z)) - y", "1 / (1 + exp(-z)) * (1 - 1 / (1 + exp(-z)))"
    gradient = [f"{pen[i]}::DOUBLE * any_value({w}) + {c}::DOUBLE * sum(s * {_X[i]}) AS g{i}" for i, w in enumerate(("w1", "w2", "w0"))]
    curvature = [f"{pen[i] if i == j else 0.0}::DOUBLE + {c}::DOUBLE * sum(h * {_X[i]} * {_X[j]}) AS h{i}{j}" for i in range(3) for j in range(i, 3)]
    ctes = [f"{name}_0 AS (SELECT DISTINCT {by}, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w0 FROM {rows})"]
    step = _solve3()
    for k in range(steps):
        last = f"{name}_{k + 1}" if k + 1 < steps else name
        ctes.append(f"""{last} AS MATERIALIZED (SELECT {by}, w1 - {step[0]} AS w1, w2 - {step[1]} AS w2, w0 - {step[2]} AS w0 FROM (
  SELECT {by}, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w0) AS w0, {", ".join(gradient + curvature)} FROM (
    SELECT *, {slope} AS s, {bend} AS h FROM (SELECT *, w1 * x1 + w2 * x2 + w0 AS z FROM {rows} JOIN {name}_{k} USING ({by}))) GROUP BY {by}))""")
    return ",\n".join(ctes)


def sigmoid_ctes(name: str, rows: str, *, by: str = "grp", steps: int = 20) -> str:
    """CTEs that end in ``name`` ({by}, a, b): Platt scaling of ``rows`` ({by}, m, y) with smoothed targets, full Newton steps."""
    ctes = [f"""{name}_t AS (SELECT {by}, (count(*) FILTER (WHERE y = 1) + 1.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) + 2) AS high,
  1.0::DOUBLE / (count(*) FILTER (WHERE y = 0) + 2) AS low,
  ln((count(*) FILTER (WHERE y = 1) + 1.0::DOUBLE) / (count(*) FILTER (WHERE y = 0) + 1)) AS prior FROM {rows} GROUP BY {by})""",
            f"{name}_0 AS (SELECT {by}, 0.0::DOUBLE AS a, prior AS b FROM {name}_t)"]
    for k in range(steps):
        last = f"{name}_{k + 1}" if k + 1 < steps else name
        ctes.append(f"""{last} AS MATERIALIZED (SELECT {by}, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
  SELECT {by}, any_value(a) AS a, any_value(b) AS b, sum((p - t) * m) AS ga, sum(p - t) AS gb, sum(p * (1 - p) * m * m) AS haa, sum(p * (1 - p) * m) AS hab,
    sum(p * (1 - p)) AS hbb FROM (
    SELECT *, 1 / (1 + exp(-(a * m + b))) AS p, CASE WHEN y = 1 THEN high ELSE low END AS t FROM {rows} JOIN {name}_t USING ({by}) JOIN {name}_{k} USING ({by}))
  GROUP BY {by}))""")
    return ",\n".join(ctes)
