"""Categories, splits, model fits, scores and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecast.functions import dates
from gatecast.models import blocked, scoring
from gatecast.models.wide_lasso import lasso_paths
from gatecast.models.design import complete_rows, design_matrix, fit_design
from gatecast.models.fits import (
    BACKWARD, FORWARD, FULL, LASSO, PATHS, RIDGE, coefficients, final_fits, fit_models, penalties, penalty_errors, subset_errors,
)
from gatecast.models.gram import gram
from gatecast.operators import categorical as cat
from gatecast.operators import sampling
from gatecast.operators.impute import impute_group_mean
from gatecast.operators.joins import left_join
from gatecast.operators.windows import Lag, RollingSum, RunningSum, add_history
from gatecast.plans.forecast import forecast
from gatecast.registry import linear_sql
from gatecast.registry.base import GAMES_SQL, ORDER, games, query, r6, table
from gatecast.session import materialize
from gatecast.sources.tables import inline_rows


@query(
    "k1_factor_levels",
    """WITH l AS (SELECT DISTINCT 'c_mktsegment' AS variable, c_mktsegment AS level FROM customer UNION ALL
         SELECT DISTINCT 'c_nationkey', c_nationkey::VARCHAR FROM customer)
       SELECT variable, level, (row_number() OVER (PARTITION BY variable ORDER BY level))::INTEGER AS position FROM l""",
)
def k1(spark, sf):
    return cat.factor_levels(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query(
    "k2_lump_rare",
    """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) < 80 THEN 'andre_hold' ELSE p_brand END AS p_brand
       FROM part""",
)
def k2(spark, sf):
    return cat.lump_rare(table(spark, sf, "part"), "p_brand", 80, "andre_hold").select("p_partkey", "p_brand")


@query(
    "k3_align_levels",
    """SELECT c_custkey, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 0 AND c_acctbal > 9000)
       THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def k3(spark, sf):
    c = table(spark, sf, "customer")
    known = cat.factor_levels(c.where((F.col("c_nationkey") == 0) & (F.col("c_acctbal") > 9000)), ["c_mktsegment"])
    return cat.align_to_levels(c, "c_mktsegment", known).select("c_custkey", "c_mktsegment")


@query(
    "k4_design_matrix",
    """SELECT c_custkey, c_acctbal, (c_mktsegment = 'BUILDING')::INTEGER::DOUBLE AS "c_mktsegment=BUILDING",
       (c_mktsegment = 'FURNITURE')::INTEGER::DOUBLE AS "c_mktsegment=FURNITURE",
       (c_mktsegment = 'HOUSEHOLD')::INTEGER::DOUBLE AS "c_mktsegment=HOUSEHOLD",
       (c_mktsegment = 'MACHINERY')::INTEGER::DOUBLE AS "c_mktsegment=MACHINERY" FROM customer""",
)
def k4(spark, sf):
    c = table(spark, sf, "customer")
    return design_matrix(c, fit_design(c, "c_acctbal", ["c_acctbal", "c_mktsegment"]), keep=["c_custkey"])


BASKETS_SQL = """baskets AS (SELECT l_orderkey, sum(l_extendedprice) / 1000 AS y, sum(l_quantity) AS x1, sum(l_discount) AS x2,
    count(*)::DOUBLE AS x3 FROM lineitem GROUP BY l_orderkey)"""

PARTS_SQL = f"""{BASKETS_SQL},
  split AS (SELECT *, row_number() OVER (ORDER BY md5(l_orderkey::VARCHAR || '|2')) <=
      floor(0.7::DOUBLE * (SELECT count(*) FROM baskets)) AS train FROM baskets),
  parts AS (SELECT *, CASE WHEN train THEN ntile(10) OVER (PARTITION BY train
      ORDER BY md5(l_orderkey::VARCHAR || '|3')) ELSE 0 END::INTEGER AS part FROM split)"""


def baskets(spark, sf):
    """Order baskets: value in thousands, quantity, discount and number of lines."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (F.sum("l_extendedprice") / 1000).alias("y"), F.sum("l_quantity").alias("x1"), F.sum("l_discount").alias("x2"),
        F.count(F.lit(1)).cast("double").alias("x3"),
    )


def _parts(spark, sf):
    return sampling.split_and_folds(materialize(baskets(spark, sf), "baskets"), ["l_orderkey"], name="_part")


def _paths(spark, sf, horizons, models):
    parts = _parts(spark, sf)
    predictors = list(dict.fromkeys(c for p in horizons.values() for c in p))
    design = fit_design(parts, "y", predictors)
    return parts, design, fit_models(parts, design, "_part", horizons, models)


@query(
    "k5_feature_sets",
    f"""WITH {BASKETS_SQL} SELECT 'måned1' AS horizon, 'x1' AS predictor, round(avg(x1), 4) AS mean FROM baskets UNION ALL
        SELECT 'dag10', 'x1', round(avg(x1), 4) FROM baskets UNION ALL
        SELECT 'dag10', 'x2', round(avg(x2), 4) FROM baskets UNION ALL
        SELECT 'dag7', 'x1', round(avg(x1), 4) FROM baskets UNION ALL SELECT 'dag7', 'x3', round(avg(x3), 4) FROM baskets""",
)
def k5(spark, sf):
    """Mean of each predictor of each horizon, in one pass."""
    sets = cat.feature_sets(["x1"], {"måned1": [], "dag10": ["x2"], "dag7": ["x3"]})
    means = baskets(spark, sf).agg(*[F.avg(c).alias(c) for c in ("x1", "x2", "x3")])
    pairs = [F.struct(F.lit(h).alias("horizon"), F.lit(c).alias("predictor"), r6(c, 4).alias("mean")) for h, p in sets.items() for c in p]
    return means.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


@query(
    "l1_split_exact",
    """SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|2')) <=
       floor(0.7::DOUBLE * (SELECT count(*) FROM orders)) AS is_train FROM orders""",
)
def l1(spark, sf):
    return sampling.split_exact(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "is_train")


@query(
    "l2_balanced_folds",
    "SELECT o_orderkey, (ntile(10) OVER (ORDER BY md5(o_orderkey::VARCHAR || '|2')))::INTEGER AS fold FROM orders",
)
def l2(spark, sf):
    return sampling.balanced_folds(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "fold")


SUMS_SQL = f"""{PARTS_SQL},
  t AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*)::DOUBLE AS n, var_pop(y) * count(*) AS syy,
      var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12,
      covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y FROM parts WHERE part > 0),
  b AS (SELECT *, s1y / s11 AS a1, my - s1y / s11 * m1 AS a0, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
      (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM t),
  c AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM b)"""

OLS = {"one": ["x1"], "two": ["x1", "x2"]}


def _ols(spark, sf):
    parts, design, paths = _paths(spark, sf, OLS, [FULL])
    return parts, design, paths.where(F.col("fold") == 0)


COEF_SQL = f"""WITH {SUMS_SQL} SELECT 'one' AS horizon, '(Intercept)' AS term, round(a0, 6) AS beta FROM c UNION ALL
  SELECT 'one', 'x1', round(a1, 6) FROM c UNION ALL SELECT 'two', '(Intercept)', round(b0, 6) FROM c UNION ALL
  SELECT 'two', 'x1', round(b1, 6) FROM c UNION ALL SELECT 'two', 'x2', round(b2, 6) FROM c"""


@query(
    "l3_ols_full",
    f"""WITH {SUMS_SQL} SELECT 'one' AS horizon, round(a0, 6) AS intercept, round(syy - s1y * s1y / s11, 2) AS rss FROM c
        UNION ALL SELECT 'two', round(b0, 6), round(syy - b1 * s1y - b2 * s2y, 2) FROM c""",
)
def l3(spark, sf):
    _, _, fits = _ols(spark, sf)
    return fits.select("horizon", r6("intercept").alias("intercept"), r6("rss", 2).alias("rss"))


# Two nearly equal columns and an exact multiple. x4 = x1 + x2 / 1000 spans the same as x2, so the fit on x1 and x2 gives the answer.
NEAR = {"near": ["x1", "x4", "x5"]}


def _near(spark, sf):
    parts = _parts(spark, sf).withColumns({"x4": F.col("x1") + F.col("x2") / 1000, "x5": F.col("x1") * 2})
    design = fit_design(parts, "y", NEAR["near"])
    return parts, design, fit_models(parts, design, "_part", NEAR, [FULL], qr=True)


@query(
    "l3_ols_qr",
    f"""WITH {SUMS_SQL} SELECT '(Intercept)' AS term, round(b0, 4) AS beta FROM c UNION ALL
        SELECT 'x1', round(b1 - 1000 * b2, 2) FROM c UNION ALL SELECT 'x4', round(1000 * b2, 2) FROM c""",
)
def l3_qr(spark, sf):
    """The full fit by QR: a column that differs from another by 1 in 10**6 counts, a multiple of another does not."""
    _, design, fits = _near(spark, sf)
    return coefficients(fits, design).select("term", F.when(F.col("term") == "(Intercept)", r6("beta", 4)).otherwise(r6("beta", 2)).alias("beta"))


@query(
    "l13_predict_qr",
    f"WITH {SUMS_SQL} SELECT l_orderkey, round(b0 + b1 * x1 + b2 * x2, 5) AS predicted FROM parts, c WHERE part = 0",
)
def l13_qr(spark, sf):
    parts, design, fits = _near(spark, sf)
    test = parts.where(F.col("_part") == 0)
    return scoring.predict_long(test, design, fits.collect(), NEAR, ["l_orderkey"]).select("l_orderkey", r6("predicted", 5).alias("predicted"))


@query("l7_coefficients", COEF_SQL)
def l7(spark, sf):
    _, design, fits = _ols(spark, sf)
    return coefficients(fits, design).select("horizon", "term", r6("beta").alias("beta"))


PRED_SQL = f"""{SUMS_SQL}, pred AS (SELECT l_orderkey, y, 'one' AS horizon, a0 + a1 * x1 AS predicted FROM parts, c WHERE part = 0
  UNION ALL SELECT l_orderkey, y, 'two', b0 + b1 * x1 + b2 * x2 FROM parts, c WHERE part = 0)"""


def _predicted(spark, sf):
    parts, design, fits = _ols(spark, sf)
    test = parts.where(F.col("_part") == 0)
    return scoring.predict_long(test, design, fits.collect(), OLS, ["l_orderkey", "y"])


CHOSEN_SQL = f"""{PARTS_SQL}, f AS (SELECT range::INTEGER AS fold FROM range(0, 11)),
  s AS (SELECT fold, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
      covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM f JOIN parts ON part > 0 AND part <> fold
    GROUP BY fold),
  b AS (SELECT *, CASE WHEN s1y * s1y / s11 >= s2y * s2y / s22 THEN s1y / s11 ELSE 0 END AS a1,
      CASE WHEN s1y * s1y / s11 >= s2y * s2y / s22 THEN 0 ELSE s2y / s22 END AS a2,
      (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
  e AS (SELECT fold, avg(pow(y - my - a1 * (x1 - m1) - a2 * (x2 - m2), 2)) AS e1,
      avg(pow(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2)) AS e2 FROM b JOIN parts ON part = fold WHERE fold > 0 GROUP BY fold),
  pick AS (SELECT avg(e1) <= avg(e2) AS single FROM e)"""


@query(
    "l8_predict_subset",
    f"""WITH {CHOSEN_SQL} SELECT l_orderkey, round(CASE WHEN single THEN my + a1 * (x1 - m1) + a2 * (x2 - m2)
        ELSE my + b1 * (x1 - m1) + b2 * (x2 - m2) END, 6) AS predicted FROM parts, pick, b WHERE part = 0 AND fold = 0""",
)
def l8(spark, sf):
    """Test rows scored by the subset that cross validation picks on the forward path."""
    parts, design, paths = _paths(spark, sf, {"two": ["x1", "x2"]}, [FORWARD])
    out = scoring.predict(parts.where(F.col("_part") == 0), design, final_fits(paths).collect(), {"two": ["x1", "x2"]})
    return out.select("l_orderkey", r6(F.col(f"two|{FORWARD}")).alias("predicted"))


@query("l13_predict", f"WITH {PRED_SQL} SELECT l_orderkey, horizon, round(predicted, 6) AS predicted FROM pred")
def l13(spark, sf):
    return _predicted(spark, sf).select("l_orderkey", "horizon", r6("predicted").alias("predicted"))


ERROR_SQL = f"WITH {PRED_SQL} SELECT horizon, round(avg(pow(y - predicted, 2)), 4) AS mse FROM pred GROUP BY horizon"


@query("l14_test_error", ERROR_SQL)
def l14(spark, sf):
    """Test error from the test part's sums: no second pass over the rows."""
    return _ols(spark, sf)[2].select("horizon", r6("mse", 4).alias("mse"))


@query("l14_test_error_by_rows", ERROR_SQL)
def l14_rows(spark, sf):
    """The same error from predicted rows."""
    return scoring.test_errors(_predicted(spark, sf), "y").select("horizon", r6("mse", 4).alias("mse"))


@query(
    "gram_sums",
    f"""WITH {PARTS_SQL}, o AS (SELECT avg(x1) AS o1, avg(x2) AS o2, avg(y) AS oy FROM parts),
        v AS (SELECT part, [1.0::DOUBLE, x1 - o1, x2 - o2, y - oy] AS r FROM parts, o),
        ij AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM range(4) a(i), range(4) b(j) WHERE i <= j)
        SELECT part, i, j, round(sum(r[i + 1] * r[j + 1]), 3) + 0.0 AS value FROM v, ij GROUP BY part, i, j""",
)
def gram_sums(spark, sf):
    parts = _parts(spark, sf)
    design = fit_design(parts, "y", ["x1", "x2"])
    return gram(parts, design, "_part").select("part", "i", "j", (r6("value", 3) + 0.0).alias("value"))


def _long(source: str, by: str = "") -> str:
    """Centered sums of squares and products of x1, x2, x3, y as (i, j, v) rows."""
    names = ("x1", "x2", "x3", "y")
    group = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {group}'{a}' AS i, '{b}' AS j, covar_pop({a}, {b}) * count(*) AS v FROM {source}" + (f" GROUP BY {by}" if by else "")
        for a in names
        for b in names
    )


def _take_out(step: int) -> str:
    """SQL of one greedy step: pick the best column, then take it out of the others."""
    old, new, best = f"g{step - 1}", f"g{step}", f"p{step}"
    taken = " AND ".join(f"d.i <> (SELECT name FROM p{s})" for s in range(1, step)) or "true"
    return f"""{best} AS (SELECT arg_max(d.i, e.v * e.v / d.v) AS name FROM {old} d JOIN {old} e ON e.i = d.i AND e.j = 'y'
      WHERE d.i = d.j AND d.i <> 'y' AND {taken}),
    {new} AS (SELECT g.i, g.j, g.v - a.v * b.v / c.v AS v FROM {old} g, {best} p, {old} a, {old} b, {old} c
      WHERE a.i = g.i AND a.j = p.name AND b.i = p.name AND b.j = g.j AND c.i = p.name AND c.j = p.name)"""


GREEDY_SQL = f"""{PARTS_SQL}, tr AS (SELECT * FROM parts WHERE part > 0), g0 AS ({_long('tr')}),
  {_take_out(1)}, {_take_out(2)}, {_take_out(3)}"""
THREE = {"all": ["x1", "x2", "x3"]}


@query(
    "l4_stepwise_forward",
    f"WITH {GREEDY_SQL} "
    + " UNION ALL ".join(
        f"SELECT {s}::INTEGER AS step, (SELECT name FROM p{s}) AS added, round(v, 2) AS rss FROM g{s} WHERE i = 'y' AND j = 'y'"
        for s in (1, 2, 3)
    ),
)
def l4(spark, sf):
    _, design, paths = _paths(spark, sf, THREE, [FORWARD])
    return added_terms(paths, design)


def added_terms(paths, design):
    """Per step of the fit on all training rows: the term that the step before did not have."""
    names = F.array(*[F.lit(t.name) for t in design.terms])
    used = F.filter(F.arrays_zip(names.alias("t"), F.col("betas").alias("b")), lambda x: x["b"] != 0)
    sets = paths.where(F.col("fold") == 0).select("step", "rss", F.transform(used, lambda x: x["t"]).alias("used"))
    before = sets.select((F.col("step") + 1).alias("step"), F.col("used").alias("had"))
    both = sets.join(before, "step", "left")
    added = F.get(F.array_except("used", F.coalesce("had", F.array().cast("array<string>"))), F.lit(0))
    return both.select("step", added.alias("added"), r6("rss", 2).alias("rss"))


# Four categories crossed: some 1900 levels, so the sums are kept in blocks.
CROSSED = "o_orderpriority o_orderstatus c_mktsegment c_nationkey".split()
WIDE_GREEDY_SQL = f"""{PARTS_SQL},
  named AS (SELECT p.*, concat_ws('/', {", ".join(CROSSED)}) AS kind FROM parts p JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey),
  tr AS (SELECT * FROM named WHERE part > 0),
  feats AS (SELECT l_orderkey AS row, 'x1' AS name, x1 AS v FROM tr UNION ALL SELECT l_orderkey, 'x2', x2 FROM tr UNION ALL
    SELECT l_orderkey, 'x3', x3 FROM tr UNION ALL SELECT l_orderkey, 'y', y FROM tr UNION ALL
    SELECT l_orderkey, 'kind=' || kind, 1.0::DOUBLE FROM tr WHERE kind <> (SELECT min(kind) FROM named)),
  sums AS MATERIALIZED (SELECT name, sum(v) AS s FROM feats GROUP BY name),
  d0 AS MATERIALIZED (SELECT name, q - s * s / n AS d, c - s * (SELECT s FROM sums WHERE name = 'y') / n AS g FROM sums
    JOIN (SELECT name, sum(v * v) AS q FROM feats GROUP BY name) USING (name)
    JOIN (SELECT f.name, sum(f.v * o.v) AS c FROM feats f JOIN feats o USING (row) WHERE o.name = 'y' GROUP BY f.name) USING (name),
    (SELECT count(*) AS n FROM tr)), """ + ", ".join(
    f"""p{k} AS MATERIALIZED (SELECT arg_max(name, g * g / d) AS name, arg_max(d, g * g / d) AS d, arg_max(g, g * g / d) AS g FROM d{k - 1}
      WHERE name <> 'y' AND d > 1e-6 {" ".join(f"AND name <> (SELECT name FROM p{t})" for t in range(1, k))}),
    s{k} AS (SELECT f.name, sum(f.v * o.v) AS q FROM feats f JOIN feats o USING (row) WHERE o.name = (SELECT name FROM p{k}) GROUP BY f.name),
    r{k} AS MATERIALIZED (SELECT sums.name, coalesce(q, 0) - s * (SELECT s FROM sums WHERE name = (SELECT name FROM p{k})) / (SELECT count(*) FROM tr)
      {" ".join(f"- r{t}.v * (SELECT v FROM r{t} WHERE name = (SELECT name FROM p{k})) / (SELECT d FROM p{t})" for t in range(1, k))} AS v
      FROM sums LEFT JOIN s{k} USING (name) {" ".join(f"JOIN r{t} ON r{t}.name = sums.name" for t in range(1, k))}),
    d{k} AS MATERIALIZED (SELECT x.name, x.d - v * v / p{k}.d AS d, x.g - v * p{k}.g / p{k}.d AS g FROM d{k - 1} x JOIN r{k} ON r{k}.name = x.name, p{k})"""
    for k in (1, 2, 3)
)


@query(
    "l4_stepwise_blocked",
    f"WITH {WIDE_GREEDY_SQL} "
    + " UNION ALL ".join(
        f"SELECT {k}::INTEGER AS step, (SELECT name FROM p{k}) AS added, round(d, 2) AS rss FROM d{k} WHERE name = 'y'"
        for k in (1, 2, 3)
    ),
)
def l4_blocked(spark, sf):
    """The first steps among three numbers and some 1900 levels, from sums of products in blocks."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kinds = orders.select("o_orderkey", F.concat_ws("/", *[F.col(c).cast("string") for c in CROSSED]).alias("kind"))
    named = _parts(spark, sf).join(kinds, F.col("l_orderkey") == F.col("o_orderkey"))
    named = materialize(named, "crossed")
    design = fit_design(named, "y", ["x1", "x2", "x3", "kind"], max_terms=5000)
    paths = blocked.stepwise_paths(named, design, "_part", "all", PATHS, {FORWARD: True}, max_size=3)
    return added_terms(materialize(paths, "paths"), design)


PAIR = """SELECT '{a}' AS a, '{b}' AS b, {v}(yy) - ({v}(s{a}) * {v}(s{a}) * {v}({b}{b}) - 2 * {v}(s{a}) * {v}(s{b}) * {v}({a}{b})
  + {v}(s{b}) * {v}(s{b}) * {v}({a}{a})) / ({v}({a}{a}) * {v}({b}{b}) - {v}({a}{b}) * {v}({a}{b})) AS rss FROM w"""


def _pair(a: str, b: str) -> str:
    return PAIR.replace("{v}", "").format(a=a, b=b)


WIDE_SQL = """w AS (SELECT """ + ", ".join(
    f"max(v) FILTER (i = '{i}' AND j = '{j}') AS {name}"
    for i, j, name in [
        ("y", "y", "yy"), ("x1", "y", "sx1"), ("x2", "y", "sx2"), ("x3", "y", "sx3"), ("x1", "x1", "x1x1"), ("x2", "x2", "x2x2"),
        ("x3", "x3", "x3x3"), ("x1", "x2", "x1x2"), ("x1", "x3", "x1x3"), ("x2", "x3", "x2x3"),
    ]
) + " FROM g0)"


@query(
    "l5_stepwise_backward",
    f"""WITH {GREEDY_SQL}, {WIDE_SQL}, pairs AS ({_pair('x1', 'x2')} UNION ALL {_pair('x1', 'x3')} UNION ALL {_pair('x2', 'x3')}),
        best AS (SELECT arg_min(a, rss) AS a, arg_min(b, rss) AS b, min(rss) AS rss FROM pairs),
        singles AS (SELECT d.i, (SELECT yy FROM w) - e.v * e.v / d.v AS rss FROM g0 d JOIN g0 e ON e.i = d.i AND e.j = 'y'
          WHERE d.i = d.j AND d.i <> 'y')
        SELECT 3::INTEGER AS step, 3::INTEGER AS size, round(v, 2) AS rss FROM g3 WHERE i = 'y' AND j = 'y' UNION ALL
        SELECT 2, 2, round(rss, 2) FROM best UNION ALL
        SELECT 1, 1, round(min(s.rss), 2) FROM singles s, best WHERE s.i IN (best.a, best.b)""",
)
def l5(spark, sf):
    paths = _paths(spark, sf, THREE, [BACKWARD])[2]
    return paths.where(F.col("fold") == 0).select("step", "size", r6("rss", 2).alias("rss"))


@query(
    "l6_cv_subset_size",
    f"""WITH {PARTS_SQL}, f AS (SELECT range::INTEGER AS fold FROM range(1, 11)),
        s AS (SELECT fold, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
            covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM f JOIN parts ON part > 0 AND part <> fold
          GROUP BY fold),
        b AS (SELECT *, CASE WHEN s1y * s1y / s11 >= s2y * s2y / s22 THEN s1y / s11 ELSE 0 END AS a1,
            CASE WHEN s1y * s1y / s11 >= s2y * s2y / s22 THEN 0 ELSE s2y / s22 END AS a2,
            (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
        e AS (SELECT fold, avg(pow(y - my - a1 * (x1 - m1) - a2 * (x2 - m2), 2)) AS e1,
            avg(pow(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2)) AS e2 FROM b JOIN parts ON part = fold GROUP BY fold)
        SELECT model, step, round(mse, 4) AS cv_mse FROM (SELECT 'Forward Selection' AS model, 1::INTEGER AS step, avg(e1) AS mse FROM e
          UNION ALL SELECT 'Forward Selection', 2, avg(e2) FROM e UNION ALL SELECT 'Backward Selection', 1, avg(e1) FROM e
          UNION ALL SELECT 'Backward Selection', 2, avg(e2) FROM e)""",
)
def l6(spark, sf):
    """Two candidates: both directions meet in the same sets here."""
    paths = _paths(spark, sf, {"two": ["x1", "x2"]}, [FORWARD, BACKWARD])[2]
    return subset_errors(paths).select("model", "step", r6("cv_mse", 4).alias("cv_mse"))


# One feature: both penalized fits have a closed form.
PENALTY_SQL = f"""{PARTS_SQL}, f AS (SELECT range::INTEGER AS fold FROM range(0, 11)),
  s AS (SELECT fold, avg(y) AS my, avg(x1) AS mx, stddev_pop(x1) AS dx, stddev_pop(y) AS dy, covar_pop(x1, y) AS c
    FROM f JOIN parts ON part > 0 AND part <> fold GROUP BY fold),
  m AS (SELECT 'Ridge' AS model, 0.001::DOUBLE AS alpha UNION ALL SELECT 'Lasso', 1.0),
  l AS (SELECT model, k::INTEGER AS step, abs(c) / dx / alpha * pow(1e-4::DOUBLE, (k - 1) / 99.0::DOUBLE) AS lam
    FROM s, m, range(1, 101) r(k) WHERE fold = 0),
  b AS (SELECT l.*, fold, my, mx, CASE WHEN model = 'Ridge' THEN c / dx / dy / (1 + lam / dy)
      ELSE sign(c) * greatest(abs(c) / dx / dy - lam / dy, 0) END * dy / dx AS beta FROM l, s),
  e AS (SELECT model, step, lam, fold, count(*)::DOUBLE AS n, avg(pow(y - my - beta * (x1 - mx), 2)) AS mse
    FROM b JOIN parts ON part = fold WHERE fold > 0 GROUP BY ALL),
  a AS (SELECT model, step, sum(n * mse) / sum(n) AS cvm FROM e GROUP BY ALL),
  cv AS (SELECT e.model, e.step, any_value(lam) AS lam, any_value(a.cvm) AS cvm,
      sqrt(sum(n * pow(mse - a.cvm, 2)) / sum(n) / (count(*) - 1)) AS cvsd
    FROM e JOIN a ON a.model = e.model AND a.step = e.step GROUP BY e.model, e.step),
  best AS (SELECT model, arg_min(step, cvm) AS step, arg_min(lam, cvm) AS lam, min(cvm) AS cvm, arg_min(cvsd, cvm) AS cvsd
    FROM cv GROUP BY model)"""


def _penalized(spark, sf, *models):
    return _paths(spark, sf, {"one": ["x1"]}, models)


def _cv_sql(model: str) -> str:
    return f"""WITH {PENALTY_SQL} SELECT step, round(lam, 6) AS lambda, round(cvm, 4) AS cvm, round(cvsd, 4) AS cvsd FROM cv
      WHERE model = '{model}'"""


def _cv_rows(paths):
    cv = penalty_errors(paths)
    return cv.select("step", r6("lambda").alias("lambda"), r6("cvm", 4).alias("cvm"), r6("cvsd", 4).alias("cvsd"))


@query("l9_ridge_cv", _cv_sql(RIDGE))
def l9(spark, sf):
    return _cv_rows(_penalized(spark, sf, RIDGE)[2])


@query("l10_lasso_cv", _cv_sql(LASSO))
def l10(spark, sf):
    return _cv_rows(_penalized(spark, sf, LASSO)[2])


@query(
    "l11_lambda_1se",
    f"""WITH {PENALTY_SQL} SELECT cv.model, round(any_value(best.lam), 6) AS lambda_min, round(max(cv.lam), 6) AS lambda_1se
        FROM cv JOIN best ON cv.model = best.model WHERE cv.cvm <= best.cvm + best.cvsd GROUP BY cv.model""",
)
def l11(spark, sf):
    found = penalties(_penalized(spark, sf, RIDGE, LASSO)[2])
    return found.select("model", r6("lambda_min").alias("lambda_min"), r6("lambda_1se").alias("lambda_1se"))


@query(
    "l12_penalized_fit",
    f"""WITH {PENALTY_SQL} SELECT b.model, round(my - beta * mx, 6) AS intercept, round(beta, 6) AS x1
        FROM b JOIN best ON b.model = best.model AND b.step = best.step WHERE fold = 0""",
)
def l12(spark, sf):
    fits = final_fits(_penalized(spark, sf, RIDGE, LASSO)[2])
    return fits.select("model", r6("intercept").alias("intercept"), r6(F.col("betas")[0]).alias("x1"))


# Six terms, two of them dummies, so that the paths have real work to do.
SIX = {"all": ["x1", "x2", "x3", "x4", "o_orderstatus"]}
SIX_NAMES = "['x1', 'x2', 'x3', 'x4', 'o_orderstatus=O', 'o_orderstatus=P']"
SIX_SQL = f"""{PARTS_SQL}, extra AS (SELECT l_orderkey, sum(l_tax) AS x4 FROM lineitem GROUP BY l_orderkey),
  v AS MATERIALIZED (SELECT 'all' AS h, part, [1.0::DOUBLE, x1 - avg(x1) OVER (), x2 - avg(x2) OVER (), x3 - avg(x3) OVER (), x4 - avg(x4) OVER (),
      (o_orderstatus = 'O')::INTEGER::DOUBLE, (o_orderstatus = 'P')::INTEGER::DOUBLE, y - avg(y) OVER ()] AS r
    FROM parts JOIN extra USING (l_orderkey) JOIN orders ON l_orderkey = o_orderkey), {linear_sql.sums(6)}"""
SIX_STEPS = f"WITH {SIX_SQL}, {linear_sql.steps(6)}, {linear_sql.errors(6, 'sub', 'sub_err')}, {linear_sql.SIZES}"
SIX_PENALTIES = f"WITH RECURSIVE {SIX_SQL}, {linear_sql.penalties(6)}, {linear_sql.errors(6, 'pen', 'pen_err')}, {linear_sql.CV}"


def _six(spark, sf, *models):
    extra = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("x4"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    parts = materialize(_parts(spark, sf).join(extra, "l_orderkey").join(orders, "l_orderkey"), "six")
    design = fit_design(parts, "y", SIX["all"])
    return design, fit_models(parts, design, "_part", SIX, models)


@query("l6_cv_subset_size_six", f"{SIX_STEPS} SELECT model, step, round(cv_mse, 4) AS cv_mse FROM sizes")
def l6_six(spark, sf):
    """Both directions over six terms, ten folds."""
    paths = _six(spark, sf, FORWARD, BACKWARD)[1]
    return subset_errors(paths).select("model", "step", r6("cv_mse", 4).alias("cv_mse"))


def _six_cv(model: str) -> str:
    return f"{SIX_PENALTIES} SELECT step, round(lam, 6) AS lambda, round(cvm, 4) AS cvm, round(cvsd, 4) AS cvsd FROM cv WHERE model = '{model}'"


@query("l9_ridge_cv_six", _six_cv(RIDGE))
def l9_six(spark, sf):
    return _cv_rows(_six(spark, sf, RIDGE)[1])


@query("l10_lasso_cv_six", _six_cv(LASSO))
def l10_six(spark, sf):
    return _cv_rows(_six(spark, sf, LASSO)[1])


@query(
    "l10_lasso_certified",
    f"""{SIX_PENALTIES} SELECT step, round(lam, 6) AS lambda, string_agg(CASE WHEN abs(beta) < 1e-9 THEN '0' WHEN beta > 0 THEN '+' ELSE '-' END, '' ORDER BY i) AS signs,
        round(any_value(cvm), 4) AS cvm, true AS certified FROM pen JOIN cv USING (model, h, step) WHERE model = '{LASSO}' AND fold = 0 GROUP BY step, lam""",
)
def l10_certified(spark, sf):
    """The path by screened coordinate descent over blocks: signs, errors, and whether the duality gaps of all folds are below 1e-8."""
    extra = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_tax").alias("x4"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    parts = materialize(_parts(spark, sf).join(extra, "l_orderkey").join(orders, "l_orderkey"), "six")
    design = fit_design(parts, "y", SIX["all"])
    paths = materialize(lasso_paths(parts, design, "_part", "all", PATHS, LASSO, size=4), "paths")
    sign = lambda b: F.when(F.abs(b) < 1e-9, "0").when(b > 0, "+").otherwise("-")
    signs = paths.where("fold = 0").select("step", F.array_join(F.transform("betas", sign), "").alias("signs"))
    sure = paths.groupBy("step").agg(((F.max("gap") < 1e-8) & (F.max("breach") < 1e-8)).alias("certified"))
    return _cv_rows(paths).drop("cvsd").join(signs, "step").join(sure, "step")


@query(
    "l12_penalized_fit_six",
    f"""{SIX_PENALTIES}, pick AS (SELECT model, h, arg_min(step, (cvm, step)) AS step FROM cv GROUP BY model, h)
        SELECT pen.model, {SIX_NAMES}[i - 1] AS term, round(beta, 5) AS beta, round(mse, 4) AS mse FROM pen JOIN pick USING (model, h, step)
        JOIN pen_err USING (model, h, fold, step) WHERE fold = 0 AND beta <> 0""",
)
def l12_six(spark, sf):
    """Coefficients and test error of the chosen penalties."""
    design, paths = _six(spark, sf, RIDGE, LASSO)
    fits = final_fits(paths)
    terms = coefficients(fits, design).where("term <> '(Intercept)'").join(fits.select("model", "mse"), "model")
    return terms.select("model", "term", r6("beta", 5).alias("beta"), r6("mse", 4).alias("mse"))


@query(
    "forecast_rows_per_horizon",
    f"""WITH {PARTS_SQL}, late AS (SELECT *, CASE WHEN x3 >= 4 THEN x2 END AS z FROM parts),
        h AS (SELECT 'early' AS horizon, x1 AS x, y, part FROM late UNION ALL SELECT 'late', z, y, part FROM late WHERE z IS NOT NULL),
        c AS (SELECT horizon, avg(y) - covar_pop(x, y) / covar_pop(x, x) * avg(x) AS b0, covar_pop(x, y) / covar_pop(x, x) AS b1
          FROM h WHERE part > 0 GROUP BY horizon)
        SELECT horizon, count(*)::DOUBLE AS test_rows, round(any_value(b0), 6) AS intercept, round(any_value(b1), 6) AS beta,
          round(avg(pow(y - b0 - b1 * x, 2)), 4) AS mse FROM h JOIN c USING (horizon) WHERE part = 0 GROUP BY horizon""",
)
def rows_per_horizon(spark, sf):
    """A predictor that many rows lack, used by one horizon only: the other horizon keeps all rows, the split is one."""
    rows = baskets(spark, sf).withColumn("z", F.when(F.col("x3") >= 4, F.col("x2")))
    done = forecast(rows, "y", {"early": ["x1"], "late": ["z"]}, ["l_orderkey"], [FULL])
    beta = F.aggregate("betas", F.lit(0.0), lambda a, b: a + b)
    return done.fits().select(
        "horizon", F.col("n").alias("test_rows"), r6("intercept").alias("intercept"), r6(beta).alias("beta"), r6("mse", 4).alias("mse")
    )


SHARED = [
    "o_orderpriority", "c_mktsegment", "last_result", "summer", "c_acctbal", "month", "week", "last_value", "last3",
    "season_so_far", "last_meeting",
]
HORIZONS = cat.feature_sets(SHARED, {"måned1": [], "dag10": ["d10"], "dag7": ["d7"], "dag3": ["d3"]})


def frame(spark, sf):
    """A model frame from the given tables: basket value per order with histories and advance sales."""
    line = table(spark, sf, "lineitem")
    upto = lambda n: F.sum(F.when(F.col("l_linenumber") <= n, F.col("l_extendedprice")).otherwise(0.0))
    sales = line.groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("basket"), upto(2).alias("d10"), upto(4).alias("d7"), upto(6).alias("d3")
    )
    df = games(spark, sf)
    df = add_history(
        df,
        {
            "last_result": Lag("o_orderstatus"),
            "last_value": Lag("o_totalprice"),
            "last3": RollingSum("o_totalprice", shift=1),
            "season_value": RunningSum("o_totalprice", ("season",)),
            "last_meeting": Lag("o_totalprice", within=("o_orderpriority",)),
        },
        {"season_so_far": Lag("season_value")},
        team="o_custkey",
        order=ORDER,
    )
    df = left_join(df, table(spark, sf, "customer"), {"o_custkey": "c_custkey"}, ["c_mktsegment", "c_acctbal"])
    df = left_join(df, sales, {"o_orderkey": "l_orderkey"}, ["basket", "d10", "d7", "d3"])
    df = impute_group_mean(materialize(df, "enriched"), "last_meeting", "o_totalprice", 250000)
    return df.withColumns(
        {
            "month": dates.month(F.col("o_orderdate")),
            "week": dates.week_of_year_simple(F.col("o_orderdate")),
            "summer": dates.holiday_season_flag(F.col("o_orderdate")).cast("string"),
        }
    )


def fitted(spark, sf):
    return forecast(frame(spark, sf), "basket", HORIZONS, ["o_orderkey"])


WHOLE_SQL = f"""{GAMES_SQL},
  h AS (SELECT *, lag(o_orderstatus) OVER t AS last_result, lag(o_totalprice) OVER t AS last_value,
      CASE WHEN count(*) OVER b = 3 THEN sum(o_totalprice) OVER b END AS last3,
      sum(o_totalprice) OVER (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey) AS season_value,
      lag(o_totalprice) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS met
    FROM games WINDOW t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
      b AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
  h2 AS (SELECT *, lag(season_value) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS season_so_far,
      CASE WHEN met IS NULL AND o_totalprice < 250000 THEN 1 WHEN met IS NULL AND o_totalprice > 250000 THEN 2 END AS band FROM h),
  g AS (SELECT band, avg(o_totalprice) AS mean FROM h2 WHERE band IS NOT NULL GROUP BY band),
  sales AS (SELECT l_orderkey, sum(l_extendedprice) AS basket, sum(CASE WHEN l_linenumber <= 2 THEN l_extendedprice ELSE 0 END) AS d10,
      sum(CASE WHEN l_linenumber <= 4 THEN l_extendedprice ELSE 0 END) AS d7,
      sum(CASE WHEN l_linenumber <= 6 THEN l_extendedprice ELSE 0 END) AS d3 FROM lineitem GROUP BY l_orderkey),
  whole AS (SELECT o_orderkey, o_orderpriority, c_mktsegment, last_result, c_acctbal, month(o_orderdate)::INTEGER AS month,
      ((dayofyear(o_orderdate) - 1) // 7 + 1)::INTEGER AS week, last_value, round(last3, 2) AS last3,
      CASE WHEN month(o_orderdate) = 7 OR (month(o_orderdate) = 6 AND day(o_orderdate) >= 26)
        OR (month(o_orderdate) = 8 AND day(o_orderdate) <= 12) THEN '1' ELSE '0' END AS summer,
      round(season_so_far, 2) AS season_so_far, round(coalesce(met, mean), 2) AS last_meeting, round(d10, 2) AS d10,
      round(d7, 2) AS d7, round(d3, 2) AS d3, round(basket, 2) AS basket
    FROM h2 LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN sales ON o_orderkey = l_orderkey
      LEFT JOIN g ON h2.band = g.band)"""
FRAME_SQL = f"WITH {WHOLE_SQL} SELECT * FROM whole WHERE COLUMNS(*) IS NOT NULL"


@query("complete_model_frame", FRAME_SQL)
def complete_frame(spark, sf):
    """Rows that enter the models."""
    columns = list(dict.fromkeys(["o_orderkey", *SHARED, "d10", "d7", "d3", "basket"]))
    whole = complete_rows(frame(spark, sf).select(*columns), columns)
    cents = ["last3", "season_so_far", "last_meeting", "d10", "d7", "d3", "basket"]
    return whole.withColumns({c: r6(c, 2) for c in cents})


# One feature per horizon: every family has a closed form, so the whole way can be checked.
SIMPLE = {"måned1": ["x1"], "dag10": ["x2"], "dag7": ["x3"]}
BOARD_SQL = f"""{PARTS_SQL},
  u AS (SELECT 'måned1' AS h, x1 AS x, y, part FROM parts UNION ALL SELECT 'dag10', x2, y, part FROM parts
    UNION ALL SELECT 'dag7', x3, y, part FROM parts),
  f AS (SELECT range::INTEGER AS fold FROM range(0, 11)),
  s AS (SELECT h, fold, avg(y) AS my, avg(x) AS mx, stddev_pop(x) AS dx, stddev_pop(y) AS dy, covar_pop(x, y) AS c
    FROM f JOIN u ON part > 0 AND part <> fold GROUP BY h, fold),
  m AS (SELECT 'Ridge' AS model, 0.001::DOUBLE AS alpha UNION ALL SELECT 'Lasso', 1.0),
  l AS (SELECT h, model, k::INTEGER AS step, abs(c) / dx / alpha * pow(1e-4::DOUBLE, (k - 1) / 99.0::DOUBLE) AS lam
    FROM s, m, range(1, 101) r(k) WHERE fold = 0),
  b AS (SELECT l.*, fold, my, mx, CASE WHEN model = 'Ridge' THEN c / dx / dy / (1 + lam / dy)
      ELSE sign(c) * greatest(abs(c) / dx / dy - lam / dy, 0) END * dy / dx AS beta FROM l JOIN s ON l.h = s.h),
  e AS (SELECT b.h, model, step, fold, count(*)::DOUBLE AS n, avg(pow(y - my - beta * (x - mx), 2)) AS mse
    FROM b JOIN u ON part = fold AND u.h = b.h WHERE fold > 0 GROUP BY ALL),
  cv AS (SELECT h, model, step, sum(n * mse) / sum(n) AS cvm FROM e GROUP BY ALL),
  pick AS (SELECT h, model, arg_min(step, cvm) AS step FROM cv GROUP BY ALL),
  fit AS (SELECT b.h, b.model, my - beta * mx AS b0, beta AS b1 FROM b JOIN pick p ON b.h = p.h AND b.model = p.model
      AND b.step = p.step WHERE fold = 0 UNION ALL
    SELECT h, model, my - c / dx / dx * mx, c / dx / dx FROM s, (VALUES ('Full Linear'), ('Forward Selection'),
      ('Backward Selection')) v(model) WHERE fold = 0),
  err AS (SELECT fit.h, model, any_value(b0) AS b0, any_value(b1) AS b1, avg(pow(y - b0 - b1 * x, 2)) AS mse
    FROM fit JOIN u ON u.h = fit.h AND part = 0 GROUP BY fit.h, model),
  place AS (SELECT *, list_position(['Full Linear', 'Forward Selection', 'Backward Selection', 'Ridge', 'Lasso'], model) AS r FROM err),
  best AS (SELECT h, arg_min(model, (round(mse, 7), r)) AS model FROM place GROUP BY h),
  what(scenario, x1, x2, x3) AS (VALUES ('Best Case', 300.0::DOUBLE, 0.1::DOUBLE, 9.0::DOUBLE), ('Worst Case', 40.0, 0.3, 2.0)),
  scored AS (SELECT scenario, err.h AS horizon, err.model,
      b0 + b1 * CASE err.h WHEN 'måned1' THEN x1 WHEN 'dag10' THEN x2 ELSE x3 END AS predicted
    FROM err JOIN best ON err.h = best.h AND err.model = best.model, what)"""


def simple(spark, sf):
    return forecast(baskets(spark, sf), "y", SIMPLE, ["l_orderkey"])


@query(
    "l15_leaderboard",
    f"""WITH {BOARD_SQL} SELECT model, round(sqrt(max(CASE WHEN h = 'måned1' THEN mse END)), 4) AS "måned1",
        round(sqrt(max(CASE WHEN h = 'dag10' THEN mse END)), 4) AS dag10,
        round(sqrt(max(CASE WHEN h = 'dag7' THEN mse END)), 4) AS dag7 FROM err GROUP BY model""",
)
def l15(spark, sf):
    board = simple(spark, sf).leaderboard(root=True)
    return board.select("model", *[r6(h, 4).alias(h) for h in SIMPLE])


@query(
    "l15_best_models",
    f"""WITH {BOARD_SQL} SELECT best.h AS horizon, best.model AS best_model, round(mse, 4) AS mse, round(sqrt(mse), 4) AS rmse
        FROM best JOIN err ON best.h = err.h AND best.model = err.model""",
)
def l15_best(spark, sf):
    best = simple(spark, sf).best()
    return best.select("horizon", "best_model", r6("mse", 4).alias("mse"), r6("rmse", 4).alias("rmse"))


def _what(spark):
    rows = {"scenario": ["Best Case", "Worst Case"], "x1": [300.0, 40.0], "x2": [0.1, 0.3], "x3": [9.0, 2.0]}
    return inline_rows(spark, rows, "scenario string, x1 double, x2 double, x3 double")


@query("l16_scenario_score", f"WITH {BOARD_SQL} SELECT scenario, horizon, model, round(predicted, 4) AS predicted FROM scored")
def l16(spark, sf):
    scored = simple(spark, sf).scenarios(_what(spark))
    return scored.select("scenario", "horizon", "model", r6("predicted", 4).alias("predicted"))


@query(
    "l17_scenario_table",
    f"""WITH {BOARD_SQL}, d AS (SELECT *, CASE horizon WHEN 'måned1' THEN 30 WHEN 'dag10' THEN 10 WHEN 'dag7' THEN 7 END::INTEGER
          AS days_before FROM scored)
        SELECT scenario, CASE horizon WHEN 'måned1' THEN '1 Måned før' WHEN 'dag10' THEN '10 Måned før' ELSE '7 Måned før' END
          AS timeframe, days_before, round_even(predicted, 0)::BIGINT::VARCHAR || ' tilskuere' || chr(10) || '(' ||
          days_before::VARCHAR || ' dage før)' AS label_text FROM d""",
)
def l17(spark, sf):
    done = scoring.scenario_table(simple(spark, sf).scenarios(_what(spark)))
    return done.select("scenario", "timeframe", "days_before", "label_text")


@query(
    "l18_chart_rows",
    f"""WITH {BOARD_SQL} SELECT best.model, CASE best.h WHEN 'måned1' THEN '1 Måned' WHEN 'dag10' THEN '10 Dage' ELSE '7 Dage' END
        AS horizon, round(sqrt(mse), 4) AS rmse, round_even(sqrt(mse), 0)::BIGINT::VARCHAR AS label
        FROM best JOIN err ON best.h = err.h AND best.model = err.model""",
)
def l18(spark, sf):
    """Chart rows of the best model per horizon under its display label."""
    errors = materialize(simple(spark, sf).errors(), "errors")
    pairs = [(r["best_model"], r["horizon"]) for r in scoring.best_models(errors).collect()]
    return scoring.best_rows(errors, pairs).select("model", "horizon", r6("rmse", 4).alias("rmse"), "label")


@query("forecast_leaderboard")
def whole_board(spark, sf):
    """All families on all predictors for four horizons."""
    return fitted(spark, sf).leaderboard(root=True)


def _scenarios(spark, sf):
    """Two what-if rows: like the best and the worst baskets, by priority seen in the data."""
    best = {
        "scenario": ["Best Case", "Worst Case"], "o_orderpriority": ["1-URGENT", "5-LOW"], "c_mktsegment": ["BUILDING"] * 2,
        "last_result": ["F", "O"], "summer": ["0", "0"], "c_acctbal": [5000.0, -500.0], "month": [2, 2], "week": [7, 7],
        "last_value": [400000.0, 20000.0], "last3": [900000.0, 90000.0], "season_so_far": [900000.0, 20000.0],
        "last_meeting": [300000.0, 30000.0], "d10": [90000.0, 0.0], "d7": [150000.0, 20000.0], "d3": [220000.0, 60000.0],
    }
    kinds = {"month": "int", "week": "int"} | dict.fromkeys(
        ["scenario", "o_orderpriority", "c_mktsegment", "last_result", "summer"], "string"
    )
    return inline_rows(spark, best, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in best))


@query("forecast_scenarios")
def whole_scenarios(spark, sf):
    """What-if rows scored by the best of all families, with days and label text."""
    return scoring.scenario_table(fitted(spark, sf).scenarios(_scenarios(spark, sf)))


# The whole way with all predictors for the four families that SQL can follow: dummies, rows per horizon, ten folds.
FOUR = (FULL, FORWARD, BACKWARD, RIDGE)
BOARD_TERMS = 19
DUMMIES = {
    "o_orderpriority": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "c_mktsegment": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "last_result": ["O", "P"], "summer": ["1"],
}
MEASURED = ["c_acctbal", "month", "week", "last_value", "last3", "season_so_far", "last_meeting"]
SALES_OF = {"måned1": None, "dag10": "d10", "dag7": "d7", "dag3": "d3"}


def _row_sql(sales: str | None, source: str, target: str) -> str:
    """[1, terms, target] of a row, numbers measured from the means of the whole frame."""
    marks = [f"({c} = '{level}')::INTEGER::DOUBLE" for c, levels in DUMMIES.items() for level in levels]
    numbers = [f"{c} - (SELECT avg({c}) FROM aimed)" for c in MEASURED]
    numbers.append(f"{sales} - (SELECT avg({sales}) FROM aimed)" if sales else "0.0::DOUBLE")
    return f"[1.0::DOUBLE, {', '.join(marks + numbers)}, {target}]"


UNROUNDED_SQL = WHOLE_SQL
for _c, _x in {"last3": "last3", "season_so_far": "season_so_far", "coalesce(met, mean)": "last_meeting", "d10": "d10", "d7": "d7", "d3": "d3", "basket": "basket"}.items():
    UNROUNDED_SQL = UNROUNDED_SQL.replace(f"round({_c}, 2) AS {_x}", f"{_c} AS {_x}")

FOUR_SQL = f"""{UNROUNDED_SQL},
  aimed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|2')) <=
      floor(0.7::DOUBLE * (SELECT count(*) FROM whole WHERE basket IS NOT NULL)) AS train FROM whole WHERE basket IS NOT NULL),
  dealt AS MATERIALIZED (SELECT *, CASE WHEN train THEN ntile(10) OVER (PARTITION BY train ORDER BY md5(o_orderkey::VARCHAR || '|3')) ELSE 0 END::INTEGER
      AS part FROM aimed),
  every AS (""" + " UNION ALL ".join(
    f"SELECT '{h}' AS h, part, {_row_sql(x, 'dealt', 'basket - (SELECT avg(basket) FROM aimed)')} AS r FROM dealt" for h, x in SALES_OF.items()
) + f"""),
  v AS MATERIALIZED (SELECT * FROM every WHERE len(list_filter(r, lambda x: x IS NULL)) = 0), {linear_sql.sums(BOARD_TERMS)},
  {linear_sql.steps(BOARD_TERMS)}, {linear_sql.errors(BOARD_TERMS, 'sub', 'sub_err')}, {linear_sql.SIZES},
  {linear_sql.ridge(BOARD_TERMS)}, {linear_sql.errors(BOARD_TERMS, 'pen', 'pen_err')}, {linear_sql.CV}, {linear_sql.CHOSEN},
  final AS MATERIALIZED (SELECT model, h, step, mse FROM sub_err JOIN chosen USING (model, h, step) WHERE fold = 0 UNION ALL
    SELECT model, h, step, mse FROM pen_err JOIN chosen USING (model, h, step) WHERE fold = 0 UNION ALL
    SELECT 'Full Linear', h, max(step), arg_max(mse, step) FROM sub_err WHERE model = '{BACKWARD}' AND fold = 0 GROUP BY h)"""


def four(spark, sf):
    return forecast(frame(spark, sf), "basket", HORIZONS, ["o_orderkey"], FOUR)


@query(
    "forecast_leaderboard_four",
    f"WITH {FOUR_SQL} SELECT model, " + ", ".join(f"round(sqrt(max(mse) FILTER (h = '{h}')), 2) AS \"{h}\"" for h in SALES_OF) + " FROM final GROUP BY model",
)
def four_board(spark, sf):
    board = four(spark, sf).leaderboard(root=True)
    return board.select("model", *[r6(h, 2).alias(h) for h in HORIZONS])


WHAT_SQL = """what(scenario, o_orderpriority, c_mktsegment, last_result, summer, c_acctbal, month, week, last_value, last3, season_so_far, last_meeting,
    d10, d7, d3) AS (VALUES ('Best Case', '1-URGENT', 'BUILDING', 'F', '0', 5000.0::DOUBLE, 2, 7, 400000.0::DOUBLE, 900000.0::DOUBLE, 900000.0::DOUBLE,
      300000.0::DOUBLE, 90000.0::DOUBLE, 150000.0::DOUBLE, 220000.0::DOUBLE),
    ('Worst Case', '5-LOW', 'BUILDING', 'O', '0', -500.0, 2, 7, 20000.0, 90000.0, 20000.0, 30000.0, 0.0, 20000.0, 60000.0))"""


@query(
    "forecast_scenarios_four",
    f"""WITH {FOUR_SQL}, {WHAT_SQL}, best AS (SELECT h, arg_min(model, (round(mse, 1), list_position(['{"', '".join(FOUR)}'], model))) AS model,
          arg_min(step, (round(mse, 1), list_position(['{"', '".join(FOUR)}'], model))) AS step FROM final GROUP BY h),
        u AS (SELECT * FROM sub_err_u WHERE fold = 0 UNION ALL SELECT * FROM pen_err_u WHERE fold = 0 UNION ALL
          SELECT 'Full Linear', h, fold, step, i, u FROM sub_err_u WHERE model = '{BACKWARD}' AND fold = 0),
        asked AS (""" + " UNION ALL ".join(f"SELECT '{h}' AS h, scenario, {_row_sql(x, 'what', '-(SELECT avg(basket) FROM aimed)')} AS r FROM what" for h, x in SALES_OF.items()) + f""")
        SELECT scenario, best.h AS horizon, best.model, round(sum(u * r[i]), 1) AS predicted
        FROM best JOIN u ON u.h = best.h AND u.model = best.model AND u.step = best.step JOIN asked ON asked.h = best.h GROUP BY ALL""",
)
def four_scenarios(spark, sf):
    """What-if rows scored by the best of four families per horizon."""
    scored = four(spark, sf).scenarios(_scenarios(spark, sf))
    return scored.select("scenario", "horizon", "model", r6("predicted", 1).alias("predicted"))
