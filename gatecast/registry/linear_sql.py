"""SQL that fits the five families from rows of numbers: sweeps over (i, j, v) rows, and coordinate descent.

``v(h, part, r)`` holds one row per horizon and data row: the part of the split (0: test, else the fold) and the list
[1, terms, target]. A term that a horizon lacks is a column of zeros there and stays out.
"""

from __future__ import annotations


def sums(terms: int) -> str:
    """Sums of products per part, training and held-out sums per fold, deviations from the means, and standard deviations."""
    w = terms + 2
    products = ", ".join(f"{{i: {i}, j: {j}, v: sum(r[{i}] * r[{j}])}}" for i in range(1, w + 1) for j in range(i, w + 1))
    return f"""
  upper_sums AS MATERIALIZED (SELECT h, part, unnest([{products}]) AS e FROM v GROUP BY h, part),
  s AS MATERIALIZED (SELECT h, part, e.i AS i, e.j AS j, e.v AS v FROM upper_sums UNION ALL
    SELECT h, part, e.j, e.i, e.v FROM upper_sums WHERE e.i < e.j),
  f AS (SELECT range::INTEGER AS fold FROM range(0, 11)),
  t AS MATERIALIZED (SELECT h, fold, i, j, sum(v) AS v FROM f JOIN s ON part > 0 AND part <> fold GROUP BY h, fold, i, j),
  held AS MATERIALIZED (SELECT h, part AS fold, i, j, v FROM s),
  n AS MATERIALIZED (SELECT h, fold, v AS n FROM t WHERE i = 1 AND j = 1),
  mean AS MATERIALIZED (SELECT t.h, t.fold, j AS i, v / n AS m FROM t JOIN n USING (h, fold) WHERE i = 1),
  c AS MATERIALIZED (SELECT t.h, t.fold, t.i, t.j, v - n * a.m * b.m AS v FROM t JOIN n USING (h, fold)
    JOIN mean a ON a.h = t.h AND a.fold = t.fold AND a.i = t.i JOIN mean b ON b.h = t.h AND b.fold = t.fold AND b.i = t.j
    WHERE t.i > 1 AND t.j > 1),
  sd AS MATERIALIZED (SELECT c.h, c.fold, i, sqrt(v / n) AS sd FROM c JOIN n USING (h, fold) WHERE i = j AND v > 1e-7)"""


def swept(old: str, new: str, pick: str, sign: str) -> str:
    """One column of each fold taken out of (``sign`` +) or put back into (``sign`` -) the others."""
    return f"""{new} AS MATERIALIZED (SELECT m.h, m.fold, m.i, m.j, CASE WHEN m.i = k AND m.j = k THEN -1 / c.v
        WHEN m.i = k OR m.j = k THEN {sign} m.v / c.v ELSE m.v - a.v * b.v / c.v END AS v
      FROM {old} m JOIN {pick} p USING (h, fold) JOIN {old} a ON a.h = m.h AND a.fold = m.fold AND a.i = m.i AND a.j = p.k
        JOIN {old} b ON b.h = m.h AND b.fold = m.fold AND b.i = p.k AND b.j = m.j
        JOIN {old} c ON c.h = m.h AND c.fold = m.fold AND c.i = p.k AND c.j = p.k)"""


def steps(terms: int) -> str:
    """``sub(model, h, fold, step, i, beta)``: coefficients of the greedy sets of both directions."""
    y, out, found = terms + 2, [], []
    for s in range(1, terms + 1):
        old = f"fm{s - 1}" if s > 1 else "c"
        taken = " AND ".join(f"NOT EXISTS (FROM fp{t} q WHERE q.h = d.h AND q.fold = d.fold AND q.k = d.i)" for t in range(1, s)) or "true"
        out.append(f"""fp{s} AS MATERIALIZED (SELECT d.h, d.fold, arg_max(d.i, e.v * e.v / d.v) AS k FROM {old} d JOIN {old} e
          ON e.h = d.h AND e.fold = d.fold AND e.i = d.i AND e.j = {y}
          JOIN sd ON sd.h = d.h AND sd.fold = d.fold AND sd.i = d.i
          WHERE d.i = d.j AND d.i < {y} AND {taken} GROUP BY d.h, d.fold)""")
        out.append(swept(old, f"fm{s}", f"fp{s}", "+"))
        chosen = " UNION ALL ".join(f"SELECT * FROM fp{t}" for t in range(1, s + 1))
        found.append(f"""SELECT 'Forward Selection' AS model, m.h, m.fold, {s}::INTEGER AS step, m.i, m.v AS beta FROM fm{s} m
          JOIN ({chosen}) q ON q.h = m.h AND q.fold = m.fold AND q.k = m.i WHERE m.j = {y}""")
    # Backward: all columns are taken out in order, then put back from the least useful on.
    for s in range(1, terms + 1):
        out.append(f"bp{s} AS (SELECT h, fold, {s + 1} AS k FROM sd WHERE i = {s + 1})")
        old = f"bm{s - 1}" if s > 1 else "c"
        out.append(swept(old, f"bo{s}", f"bp{s}", "+"))
        out.append(f"bm{s} AS MATERIALIZED (FROM bo{s} UNION ALL FROM {old} m WHERE NOT EXISTS (FROM bp{s} p WHERE p.h = m.h AND p.fold = m.fold))")
    out.append("live0 AS MATERIALIZED (SELECT h, fold, i FROM sd WHERE i < %d)" % y)
    for r in range(terms):
        old, live = (f"rm{r}", f"live{r}") if r else (f"bm{terms}", "live0")
        found.append(f"""SELECT 'Backward Selection', m.h, m.fold, z.n::INTEGER, m.i, m.v FROM {old} m JOIN {live} l ON l.h = m.h AND l.fold = m.fold
          AND l.i = m.i JOIN (SELECT h, fold, count(*) AS n FROM {live} GROUP BY h, fold) z ON z.h = m.h AND z.fold = m.fold WHERE m.j = {y}""")
        if r < terms - 1:
            out.append(f"""rp{r + 1} AS MATERIALIZED (SELECT l.h, l.fold, arg_min(l.i, e.v * e.v / -d.v) AS k FROM {live} l
              JOIN {old} d ON d.h = l.h AND d.fold = l.fold AND d.i = l.i AND d.j = l.i JOIN {old} e ON e.h = l.h AND e.fold = l.fold AND e.i = l.i AND e.j = {y}
              GROUP BY l.h, l.fold HAVING count(*) > 1)""")
            out.append(f"live{r + 1} AS MATERIALIZED (SELECT l.* FROM {live} l JOIN rp{r + 1} p ON p.h = l.h AND p.fold = l.fold AND p.k <> l.i)")
            out.append(swept(old, f"rm{r + 1}", f"rp{r + 1}", "-"))
    return ", ".join([*out, "sub AS MATERIALIZED (" + " UNION ALL ".join(found) + ")"])


def _penalty_path(terms: int, models: str) -> list[str]:
    """Correlations, and ``lam(model, h, step, lam)``."""
    y = terms + 2
    return [
        f"""cor AS MATERIALIZED (SELECT c.h, c.fold, c.i, c.j, c.v / n / a.sd / b.sd AS v FROM c JOIN n USING (h, fold)
          JOIN sd a ON a.h = c.h AND a.fold = c.fold AND a.i = c.i JOIN sd b ON b.h = c.h AND b.fold = c.fold AND b.i = c.j WHERE c.i < {y})""",
        f"""top AS (SELECT c.h, max(abs(c.v) / n / sd) AS top FROM c JOIN n USING (h, fold) JOIN sd ON sd.h = c.h AND sd.fold = c.fold AND sd.i = c.i
          WHERE c.fold = 0 AND c.j = {y} AND c.i < {y} GROUP BY c.h)""",
        f"""lam AS MATERIALIZED (SELECT model, h, k::INTEGER AS step, top / alpha * pow(1e-4::DOUBLE, (k - 1) / 99.0::DOUBLE) AS lam
          FROM top, (VALUES {models}) m(model, alpha), range(1, 101) q(k))""",
        f"sys AS MATERIALIZED (SELECT model, lam.h, fold, step, lam / sd AS p FROM lam JOIN sd ON sd.h = lam.h AND sd.i = {y})",
    ]


def _elimination(terms: int) -> list[str]:
    """The ridge equations of all penalties, one column eliminated at a time; the solution is the last column of the last step."""
    out = ["""q0 AS MATERIALIZED (SELECT cor.h, cor.fold, step, i, j, v + CASE WHEN i = j THEN p ELSE 0 END AS v FROM cor
          JOIN sys ON sys.h = cor.h AND sys.fold = cor.fold AND model = 'Ridge')"""]
    for k in range(2, terms + 2):
        old = f"q{k - 2}"
        same = lambda x: f"{x}.h = m.h AND {x}.fold = m.fold AND {x}.step = m.step"
        out.append(f"""q{k - 1} AS MATERIALIZED (SELECT m.h, m.fold, m.step, m.i, m.j, CASE WHEN c.v IS NULL THEN m.v WHEN m.i = {k} THEN m.v / c.v
            ELSE m.v - a.v * b.v / c.v END AS v FROM {old} m LEFT JOIN {old} c ON {same('c')} AND c.i = {k} AND c.j = {k}
          LEFT JOIN {old} a ON {same('a')} AND a.i = m.i AND a.j = {k} LEFT JOIN {old} b ON {same('b')} AND b.i = {k} AND b.j = m.j WHERE m.j >= {k})""")
    return out


def _descent(terms: int, sweeps: int) -> list[str]:
    """Lasso: a recursive query whose rows are the coefficients of every (fold, penalty); a step goes through all coordinates."""
    y, xs = terms + 2, range(2, terms + 2)

    def pull(i: int) -> str:
        return f"g{i} " + " ".join(f"- r{min(i, j)}_{max(i, j)} * {'n' if j < i else 'b'}{j}" for j in xs if j != i)

    soft = ", ".join(f"CASE WHEN live{i} THEN sign({pull(i)}) * greatest(abs({pull(i)}) - p, 0) ELSE 0 END AS n{i}" for i in xs)
    wide = [f"coalesce(max(v) FILTER (i = {i} AND j = {j}), 0) AS r{i}_{j}" for i in xs for j in xs if i < j]
    wide += [f"coalesce(max(v) FILTER (i = {i} AND j = {y}), 0) AS g{i}" for i in xs] + [f"coalesce(bool_or(i = {i}), false) AS live{i}" for i in xs]
    return [
        f"flat AS MATERIALIZED (SELECT h, fold, {', '.join(wide)} FROM cor GROUP BY h, fold)",
        f"""cd AS (SELECT h, fold, step, p, 0 AS turn, {', '.join(f'0.0::DOUBLE AS b{i}' for i in xs)} FROM sys WHERE model = 'Lasso' UNION ALL
          SELECT h, fold, step, p, turn + 1, {', '.join(f'n{i}' for i in xs)} FROM (SELECT cd.h, cd.fold, step, p, turn, {soft}
            FROM cd JOIN flat ON flat.h = cd.h AND flat.fold = cd.fold WHERE turn < {sweeps}))""",
        f"lasso AS MATERIALIZED (SELECT * FROM cd WHERE turn = {sweeps})",
    ]


def _unscaled(terms: int, found: list[str]) -> list[str]:
    """``pen(model, h, fold, step, i, beta)``."""
    return [
        "std AS (" + " UNION ALL ".join(found) + ")",
        f"""pen AS MATERIALIZED (SELECT model, std.h, std.fold, step, std.i, b * y.sd / x.sd AS beta FROM std
          JOIN sd x ON x.h = std.h AND x.fold = std.fold AND x.i = std.i JOIN sd y ON y.h = std.h AND y.fold = std.fold AND y.i = {terms + 2})""",
    ]


def ridge(terms: int) -> str:
    """``pen`` and ``lam`` of ridge alone."""
    solved = f"SELECT 'Ridge' AS model, h, fold, step, i, v AS b FROM q{terms} WHERE j = {terms + 2}"
    return ", ".join([*_penalty_path(terms, "('Ridge', 0.001::DOUBLE)"), *_elimination(terms), *_unscaled(terms, [solved])])


def penalties(terms: int, sweeps: int = 400) -> str:
    """``pen`` and ``lam`` of ridge and lasso."""
    solved = [f"SELECT 'Ridge' AS model, h, fold, step, i, v AS b FROM q{terms} WHERE j = {terms + 2}"]
    solved += [f"SELECT 'Lasso', h, fold, step, {i}, b{i} FROM lasso" for i in range(2, terms + 2)]
    path = _penalty_path(terms, "('Ridge', 0.001::DOUBLE), ('Lasso', 1.0::DOUBLE)")
    return ", ".join([*path, *_elimination(terms), *_descent(terms, sweeps), *_unscaled(terms, solved)])


def errors(terms: int, source: str, name: str) -> str:
    """``name(model, h, fold, step, n, mse)`` of the fits in ``source`` on the held-out part; ``name_u`` holds [intercept, betas, -1]."""
    y = terms + 2
    keys = "model, h, fold, step"
    return f"""{name}_all AS (SELECT DISTINCT {keys} FROM {source}),
  {name}_u AS MATERIALIZED (SELECT {keys}, i, beta AS u FROM {source} UNION ALL SELECT {keys}, {y}, -1 FROM {name}_all UNION ALL
    SELECT a.model, a.h, a.fold, a.step, 1, max(y.m) - coalesce(sum(beta * x.m), 0) FROM {name}_all a LEFT JOIN {source} b ON b.model = a.model AND b.h = a.h
      AND b.fold = a.fold AND b.step = a.step LEFT JOIN mean x ON x.h = b.h AND x.fold = b.fold AND x.i = b.i
      JOIN mean y ON y.h = a.h AND y.fold = a.fold AND y.i = {y} GROUP BY a.model, a.h, a.fold, a.step),
  {name} AS MATERIALIZED (SELECT a.model, a.h, a.fold, a.step, max(k.v) AS n, greatest(sum(a.u * b.u * held.v), 0) / max(k.v) AS mse FROM {name}_u a
    JOIN {name}_u b ON b.model = a.model AND b.h = a.h AND b.fold = a.fold AND b.step = a.step
    JOIN held ON held.h = a.h AND held.fold = a.fold AND held.i = a.i AND held.j = b.i
    JOIN held k ON k.h = a.h AND k.fold = a.fold AND k.i = 1 AND k.j = 1 GROUP BY a.model, a.h, a.fold, a.step)"""


# Cross-validated errors of subset sizes (those that every fold has) and of penalties.
SIZES = """sizes AS MATERIALIZED (SELECT model, h, step, avg(mse) AS cv_mse FROM sub_err WHERE fold > 0 GROUP BY ALL HAVING count(*) = 10)"""
CV = """cvm AS (SELECT model, h, step, sum(n * mse) / sum(n) AS cvm FROM pen_err WHERE fold > 0 GROUP BY ALL),
  cv AS MATERIALIZED (SELECT e.model, e.h, e.step, any_value(lam) AS lam, any_value(cvm.cvm) AS cvm,
      sqrt(sum(n * pow(mse - cvm.cvm, 2)) / sum(n) / (count(*) - 1)) AS cvsd
    FROM pen_err e JOIN cvm USING (model, h, step) JOIN lam USING (model, h, step) WHERE fold > 0 GROUP BY e.model, e.h, e.step)"""
# Rounded as the library rounds before it compares, so that ties fall alike; the smaller step of equals.
CHOSEN = """chosen AS MATERIALIZED (SELECT model, h, arg_min(step, (cv_mse, step)) AS step FROM sizes GROUP BY model, h UNION ALL
    SELECT model, h, arg_min(step, (cvm, step)) FROM cv GROUP BY model, h)"""
