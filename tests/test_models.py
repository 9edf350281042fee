import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from gatecast.models import blocked, fits, scoring, solvers, wide_lasso
from gatecast.models.design import complete_rows, completeness, design_matrix, fit_design, horizon_mask, prediction
from gatecast.models.gram import fold_grams, gram, square
from gatecast.plans.forecast import forecast

CATS = {"g": "string"}
PRED = ["x1", "x2", "x3", "g", "d"]
HORIZONS = {"early": ["x1", "x2", "x3", "g"], "late": ["x1", "x2", "x3", "g", "d"]}
FOLDS = 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 400
    df = pd.DataFrame({"id": range(n), "x1": rng.normal(5, 2, n), "x2": rng.normal(size=n), "x3": rng.normal(size=n)})
    df["g"] = rng.choice(["A", "N", "R"], n)
    df["d"] = rng.normal(1000, 30, n)
    df["y"] = 3 * df.x1 + df.x2 + 4 * (df.g == "R") + 0.1 * df.d + rng.normal(size=n) * 2
    df["_part"] = np.arange(n) % 7  # 0 and 6 go to the test part
    df.loc[df._part == 6, "_part"] = 0
    return df


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).cache()


@pytest.fixture(scope="module")
def design(frame):
    return fit_design(frame, "y", PRED)


@pytest.fixture(scope="module")
def paths(frame, design):
    return fits.fit_models(frame, design, "_part", HORIZONS, folds=FOLDS).cache()


def matrix(df, late=True):
    x = np.column_stack([df.x1, df.x2, df.x3, df.g == "N", df.g == "R", *([df.d] if late else [])]).astype(float)
    return x, df.y.to_numpy()


def ols(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def test_first_level_is_the_baseline(design):
    assert [t.name for t in design.terms] == ["x1", "x2", "x3", "g=N", "g=R", "d"]


def test_same_columns_as_the_formula_encoder(frame, design):
    encoded = RFormula(formula="y ~ x1 + x2 + x3 + g + d", stringIndexerOrderType="alphabetDesc").fit(frame).transform(frame)
    theirs = np.array([r.features.toArray() for r in encoded.orderBy("id").collect()])
    ours = design_matrix(frame, design, ["id"]).orderBy("id").toPandas().drop(columns="id").to_numpy()
    assert sorted(map(tuple, theirs.T)) == sorted(map(tuple, ours.T))


def test_gram_is_the_sum_of_products(frame, design, data):
    g = gram(frame, design, "_part").toPandas()
    x, y = matrix(data)
    origin = np.array([design.origin.get(t.column, 0.0) if t.level is None else 0.0 for t in design.terms])
    full = np.column_stack([np.ones(len(x)), x - origin, y - design.origin["y"]])
    for p in range(FOLDS + 1):
        part = g[g.part == p]
        got = square(part.i.to_numpy(), part.j.to_numpy(), part.value.to_numpy(), full.shape[1])
        own = full[data._part == p]
        np.testing.assert_allclose(got, own.T @ own, atol=1e-6)


def test_training_sums_are_total_minus_fold(frame, design):
    g = gram(frame, design, "_part").toPandas()
    folds = fold_grams(gram(frame, design, "_part"), FOLDS).toPandas()
    total = g[g.part > 0].groupby(["i", "j"]).value.sum()
    for f in range(FOLDS + 1):
        own = folds[folds.fold == f].set_index(["i", "j"]).sort_index()
        np.testing.assert_allclose(own.full, total.sort_index(), atol=1e-6)
        np.testing.assert_allclose(own.train + (own.held if f else 0), total.sort_index(), atol=1e-6)


def test_nulls_are_refused(spark, design):
    bad = spark.createDataFrame([(1.0, None, 0.0, "A", 1.0, 2.0, 1)], "x1 double, x2 double, x3 double, g string, d double, y double, _part int")
    with pytest.raises(Exception, match="null in x2"):
        gram(bad, design, "_part").collect()
    assert complete_rows(bad, PRED).count() == 0
    report = completeness(bad, PRED).first()
    assert (report.rows, report.complete, report.x2, report.x1) == (1, 0, 1, 0)


def test_full_model_is_least_squares(paths, data):
    fit = paths.where("horizon = 'late' and model = 'Full Linear'").first()
    train, test = data[data._part > 0], data[data._part == 0]
    b = ols(*matrix(train))
    np.testing.assert_allclose([fit.intercept, *fit.betas], b, rtol=1e-6)
    x, y = matrix(test)
    np.testing.assert_allclose(fit.mse, np.mean((y - b[0] - x @ b[1:]) ** 2), rtol=1e-6)


def test_horizons_do_not_use_later_columns(paths):
    assert all(r.betas[-1] == 0.0 for r in paths.where("horizon = 'early'").collect())


def brute_path(x, y, direction):
    """Greedy sets by refitting on the rows."""
    rss = lambda s: np.sum((y - np.column_stack([np.ones(len(x)), x[:, s]]) @ ols(x[:, s], y)) ** 2)
    p, sets = x.shape[1], []
    chosen = [] if direction == "forward" else list(range(p))
    if direction == "forward":
        while len(chosen) < p:
            chosen = chosen + [min((j for j in range(p) if j not in chosen), key=lambda j: rss(chosen + [j]))]
            sets.append(sorted(chosen))
        return sets
    sets.append(chosen)
    while len(chosen) > 1:
        chosen = min(([c for c in chosen if c != j] for j in chosen), key=rss)
        sets.append(sorted(chosen))
    return sets[::-1]


@pytest.mark.parametrize("model,direction", [("Forward Selection", "forward"), ("Backward Selection", "backward")])
def test_stepwise_against_refits(paths, data, model, direction):
    cv = np.zeros((FOLDS, 6))
    for f in range(FOLDS + 1):
        train = data[(data._part > 0) & (data._part != f)]
        held = data[data._part == f]
        (x, y), (hx, hy) = matrix(train), matrix(held)
        got = paths.where(f"horizon = 'late' and model = '{model}' and fold = {f}").orderBy("step").collect()
        for step, chosen in enumerate(brute_path(x, y, direction), 1):
            row = got[step - 1]
            assert row.step == step and [j for j, b in enumerate(row.betas) if b] == chosen
            b = ols(x[:, chosen], y)
            np.testing.assert_allclose([row.intercept, *np.array(row.betas)[chosen]], b, rtol=1e-5)
            error = np.mean((hy - b[0] - hx[:, chosen] @ b[1:]) ** 2)
            np.testing.assert_allclose(row.mse, error, rtol=1e-6)
            if f:
                cv[f - 1, step - 1] = error
    picked = {(r.horizon, r.model): r.step for r in fits.chosen_steps(paths, FOLDS).collect()}
    assert picked["late", model] == int(np.argmin(cv.mean(0))) + 1


def test_error_falls_along_the_path(paths):
    for model in fits.STEPWISE:
        got = [r.rss for r in paths.where(f"horizon = 'late' and model = '{model}' and fold = 0").orderBy("step").collect()]
        assert all(a >= b - 1e-6 for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("model,alpha", [("Ridge", 0.0), ("Lasso", 1.0)])
def test_penalized_agree_with_the_ml_estimator(paths, frame, design, model, alpha):
    ready = VectorAssembler(inputCols=[t.name for t in design.terms], outputCol="v").transform(
        design_matrix(frame.where("_part > 0"), design, ["y"])
    )
    got = paths.where(f"horizon = 'late' and model = '{model}' and fold = 0").orderBy("step").collect()
    for row in (got[30], got[60]):
        theirs = LinearRegression(
            featuresCol="v", labelCol="y", regParam=row["lambda"], elasticNetParam=alpha, tol=1e-12, maxIter=10_000
        ).fit(ready)
        np.testing.assert_allclose(row.betas, theirs.coefficients.toArray(), atol=2e-3)
        np.testing.assert_allclose(row.intercept, theirs.intercept, rtol=2e-3, atol=2e-3)


def test_path_ends(paths, data):
    lasso = paths.where("horizon = 'late' and model = 'Lasso' and fold = 0").orderBy("step").collect()
    assert all(b == 0 for b in lasso[0].betas) and len(lasso) == 100
    assert lasso[-1]["lambda"] == pytest.approx(lasso[0]["lambda"] * 1e-4)
    np.testing.assert_allclose(lasso[-1].betas, ols(*matrix(data[data._part > 0]))[1:], atol=5e-3)


def test_every_penalty_is_scored_on_all_folds(paths):
    cv = fits.penalty_errors(paths)
    assert cv.count() == 2 * 2 * 100 and cv.where(f"folds != {FOLDS}").count() == 0
    # A fold whose penalties differ in the last bits still counts.
    shaken = paths.withColumn("lambda", F.when(F.col("fold") == 2, F.col("lambda") * (1 + 1e-15)).otherwise(F.col("lambda")))
    again = fits.penalty_errors(shaken)
    assert again.count() == 2 * 2 * 100 and again.where(f"folds != {FOLDS}").count() == 0


def test_penalties_of_brute_force_cross_validation(paths, data):
    """The chosen ridge penalty, with every fold refitted from its rows."""
    full = paths.where("horizon = 'late' and model = 'Ridge' and fold = 0").orderBy("step").collect()
    errors, sizes = np.zeros((FOLDS, len(full))), np.zeros(FOLDS)
    for f in range(1, FOLDS + 1):
        (x, y), (hx, hy) = matrix(data[(data._part > 0) & (data._part != f)]), matrix(data[data._part == f])
        mx, sx, my, sy = x.mean(0), x.std(0), y.mean(), y.std()
        z = (x - mx) / sx
        sizes[f - 1] = len(hy)
        for k, row in enumerate(full):
            b = np.linalg.solve(z.T @ z / len(z) + row["lambda"] / sy * np.eye(z.shape[1]), z.T @ (y - my) / len(z))
            errors[f - 1, k] = np.mean((hy - my - (hx - mx) / sx @ b) ** 2)
    cvm = sizes @ errors / sizes.sum()
    cvsd = np.sqrt(sizes @ (errors - cvm) ** 2 / sizes.sum() / (FOLDS - 1))
    best = int(np.argmin(cvm))
    got = {(r.horizon, r.model): r for r in fits.penalties(paths).collect()}["late", "Ridge"]
    assert got.lambda_min == pytest.approx(full[best]["lambda"])
    inside = [row["lambda"] for row, m in zip(full, cvm) if m <= cvm[best] + cvsd[best]]
    assert got.lambda_1se == pytest.approx(max(inside))


def test_perfect_fit_has_no_negative_error():
    x = np.arange(20.0)
    s = np.column_stack([np.ones(20), x - 9.5, 3 * (x - 9.5)])
    c = solvers.center(s.T @ s)
    beta = solvers.solve_on(c, [0])
    assert solvers.rss(c, beta) >= 0 and solvers.held_out_mse(s.T @ s, c.intercept(beta), beta) >= 0


def test_ridge_without_penalty_is_least_squares(data):
    x, y = matrix(data)
    s = np.column_stack([np.ones(len(x)), x, y])
    c = solvers.center(s.T @ s)
    np.testing.assert_allclose(solvers.penalized(c, np.array([0.0]), 0.0)[0], ols(x, y)[1:], rtol=1e-5)
    np.testing.assert_allclose(solvers.penalized(c, np.array([1e-12]), 1.0)[0], ols(x, y)[1:], rtol=1e-4)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12))
    x[:, 1] = x[:, 0] + 0.01 * rng.normal(size=300)
    x[:, 2] = 2 * x[:, 3]
    y = x[:, 0] - x[:, 4] + rng.normal(size=300)
    s = np.column_stack([np.ones(300), x, y])
    c = solvers.center(s.T @ s)
    lambdas = solvers.lambda_path(c, 1.0)
    sd = np.sqrt(np.diag(c.xx) / c.n)
    for lam, b in zip(lambdas, solvers.penalized(c, lambdas, 1.0)):
        pull = (c.xy - c.xx @ b) / c.n / sd
        assert np.all(np.abs(pull) <= lam + 1e-6)
        on = b != 0
        np.testing.assert_allclose(pull[on], lam * np.sign(b[on]), atol=1e-6)


def test_aliased_columns_are_left_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    x = np.column_stack([x[:, 0], 2 * x[:, 0], x[:, 1], np.ones(50)])
    y = x[:, 0] + rng.normal(size=50)
    s = np.column_stack([np.ones(50), x, y])
    c = solvers.center(s.T @ s)
    assert solvers.independent(c) == [0, 2]
    assert sorted(solvers.forward_order(c))[-1] == 2 and len(solvers.forward_order(c)) == 2
    assert [len(b) for b in solvers.backward_sets(c)] == [1, 2]


def test_predictions_match_the_sums(frame, design, paths):
    final = fits.final_fits(paths, FOLDS)
    long = scoring.predict_long(frame.where("_part = 0"), design, final.collect(), HORIZONS, ["id", "y"])
    by_rows = {(r.horizon, r.model): r.mse for r in scoring.test_errors(long, "y").collect()}
    by_sums = {(r.horizon, r.model): r.mse for r in final.collect()}
    assert len(by_sums) == 10
    for key, value in by_sums.items():
        assert by_rows[key] == pytest.approx(value, rel=1e-6)
    best = {r.horizon: r for r in scoring.best_models(final).collect()}
    for h in HORIZONS:
        assert best[h].mse == min(v for (hh, _), v in by_sums.items() if hh == h)
        assert best[h].rmse == pytest.approx(best[h].mse**0.5)
    assert best["late"].mse < best["early"].mse


def test_unknown_level_has_no_prediction(spark, design, paths):
    fit = paths.where("horizon = 'late' and model = 'Ridge' and fold = 0 and step = 50").first()
    new = spark.createDataFrame([(1.0, 0.0, 0.0, "R", 1.0), (1.0, 0.0, 0.0, "?", 1.0), (1.0, None, 0.0, "A", 1.0)], "x1 double, x2 double, x3 double, g string, d double")
    got = [r.p for r in new.select(prediction(design, fit.intercept, fit.betas).alias("p")).collect()]
    assert got[0] is not None and got[1] is None and got[2] is None


def test_wide_designs_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="lump"):
        fit_design(df, "y", ["g"], max_terms=20)


def test_scenario_table(spark):
    scored = spark.createDataFrame(
        [("Best Case", "dag3", "Lasso", 7000.5), ("Best Case", "måned1", "Ridge", 6500.49)],
        "scenario string, horizon string, model string, predicted double",
    )
    got = [(r.horizon, r.days_before, r.label_text) for r in scoring.scenario_table(scored).collect()]
    assert got == [("måned1", 30, "6500 tilskuere\n(30 dage før)"), ("dag3", 3, "7000 tilskuere\n(3 dage før)")]


def test_best_rows(spark):
    errors = spark.createDataFrame([("Ridge", "måned1", 4.0), ("Lasso", "dag3", 9.0), ("Lasso", "måned1", 1.0)], "model string, horizon string, mse double")
    got = [tuple(r) for r in scoring.best_rows(errors, [("Ridge", "måned1"), ("Lasso", "dag3")]).collect()]
    assert got == [("Ridge", "1 Måned", 2.0, "2"), ("Lasso", "3 Dage", 3.0, "3")]


def test_a_null_keeps_a_row_in_the_other_horizons(spark):
    """Each horizon is fitted on the rows that have its own predictors, under one split."""
    rng = np.random.default_rng(12)
    rows = [(k, float(a), None if k % 3 == 0 else float(b), float(1 + 2 * a - b + rng.normal())) for k, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    rows += [(1000, None, 1.0, 2.0), (1001, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    done = forecast(df, "y", {"early": ["a"], "late": ["a", "b"]}, ["id"], [fits.FULL], folds=5)
    parts = {r["id"]: r["_part"] for r in done.parts.collect()}
    assert len(parts) == 301  # all rows with a target
    for r in done.fits().collect():
        use = [c for c in (1, 2) if r["horizon"] == "late" or c == 1]
        mine = [row for row in rows if row[3] is not None and all(row[c] is not None for c in use)]
        train, test = [[x for x in mine if (parts[x[0]] > 0) == t] for t in (True, False)]
        x = np.array([[1.0, *[row[c] for c in use]] for row in train])
        beta = np.linalg.lstsq(x, np.array([row[3] for row in train]), rcond=None)[0]
        assert r["n"] == len(test)
        np.testing.assert_allclose([r["intercept"], *[v for v in r["betas"] if v]], beta, atol=1e-8)
        errors = [row[3] - beta @ np.array([1.0, *[row[c] for c in use]]) for row in test]
        np.testing.assert_allclose(r["mse"], np.mean(np.square(errors)), atol=1e-8)


def test_backward_sets_equal_a_fresh_inverse_each_step():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    y = x @ rng.normal(size=12) + rng.normal(size=400) * 5
    s = np.column_stack([np.ones(400), x, y])
    c = solvers.center(s.T @ s)
    current, want = list(range(12)), [list(range(12))]
    while len(current) > 1:
        inverse = np.linalg.inv(c.xx[np.ix_(current, current)])
        b = inverse @ c.xy[current]
        current.pop(int(np.argmin(b**2 / np.diag(inverse))))
        want.append(list(current))
    assert solvers.backward_sets(c) == want[::-1]


def test_qr_equals_the_sums_of_products_on_a_good_design(frame, design, paths):
    ours = fits.fit_models(frame, design, "_part", HORIZONS, [fits.FULL, fits.RIDGE], FOLDS, qr=True)
    assert ours.schema == paths.schema and ours.where(f"model = '{fits.RIDGE}'").count() == paths.where(f"model = '{fits.RIDGE}'").count()
    theirs = {r.horizon: r for r in paths.where(f"model = '{fits.FULL}'").collect()}
    for row in ours.where(f"model = '{fits.FULL}'").collect():
        other = theirs[row.horizon]
        np.testing.assert_allclose([row.intercept, *row.betas], [other.intercept, *other.betas], rtol=1e-8, atol=1e-10)
        np.testing.assert_allclose([row.mse, row.rss, row.n], [other.mse, other.rss, other.n], rtol=1e-9)
        assert (row["size"], row.step, row.fold) == (other["size"], 1, 0)


def test_qr_keeps_digits_that_sums_of_products_lose(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=500), rng.normal(size=500)
    df = pd.DataFrame({"a": x, "b": x + 1e-5 * z, "c": 3 * x, "y": 2 * x + z, "_part": np.arange(500) % 5})
    table = spark.createDataFrame(df).repartition(7)
    d = fit_design(table, "y", ["a", "b", "c"])
    used = {"all": ["a", "b", "c"]}
    row = fits.fit_models(table, d, "_part", used, [fits.FULL], 4, qr=True).first()
    want = np.array([2 - 1e5, 1e5, 0.0])
    np.testing.assert_allclose(row.betas, want, rtol=1e-8, atol=0)  # the exact answer; c is a multiple of a
    assert row.rss < 1e-6 and row["size"] == 2
    lost = fits.fit_models(table, d, "_part", used, [fits.FULL], 4).first()
    assert lost["size"] == 1 and lost.rss > 100


def test_qr_with_masks_and_few_rows(spark):
    rows = [(1.0, 2.0, "u", 3.0, 1), (2.0, None, "v", 5.0, 1), (4.0, 1.0, "u", 9.0, 2), (3.0, 5.0, "v", 8.0, 2), (5.0, 0.0, "u", 11.5, 1), (2.5, 2.0, "u", 6.0, 0)]
    table = spark.createDataFrame(rows, "a double, b double, g string, y double, _part int")
    horizons = {"early": ["a", "g"], "late": ["a", "b"]}
    masked = table.withColumn("m", horizon_mask(horizons))
    d = fit_design(table, "y", ["a", "b", "g"])
    both = [{r.horizon: r for r in fits.fit_models(masked, d, "_part", horizons, [fits.FULL], 2, "m", qr).collect()} for qr in (False, True)]
    for h in horizons:
        np.testing.assert_allclose([both[1][h].intercept, *both[1][h].betas, both[1][h].mse], [both[0][h].intercept, *both[0][h].betas, both[0][h].mse], rtol=1e-7, atol=1e-9)
        assert both[1][h].n == both[0][h].n == 1


@pytest.fixture(scope="module")
def crossed(spark):
    rng = np.random.default_rng(3)
    n = 1200
    df = pd.DataFrame({"x1": rng.normal(5, 2, n), "x2": rng.normal(size=n), "_part": np.arange(n) % 4})
    df["g"] = rng.choice([f"g{k:02}" for k in range(20)], n)
    df["h"] = rng.choice([f"h{k}" for k in range(9)], n)
    df["x3"] = df.x1 * 2  # aliased
    df["y"] = 3 * df.x1 + df.x2 + 4 * (df.g == "g03") - 2 * (df.h == "h4") + rng.normal(size=n)
    table = spark.createDataFrame(df).repartition(3).cache()
    return table, fit_design(table, "y", ["x1", "g", "x2", "h", "x3"])


@pytest.mark.parametrize("size,held", [(8, 256), (8, 2), (64, 256)])
def test_blocks_hold_the_packed_sums(crossed, monkeypatch, size, held):
    monkeypatch.setattr(blocked, "HELD", held)
    table, d = crossed
    width = len(d.terms) + 2
    found, packed = blocked.blocked_gram(table, d, "_part", size).collect(), gram(table, d, "_part").toPandas()
    for p in range(4):
        own = packed[packed.part == p]
        whole = np.zeros((-(-width // size) * size,) * 2)
        for r in (r for r in found if r.part == p):
            block = blocked.opened(bytes(r["values"]), size)
            whole[r.bi * size : (r.bi + 1) * size, r.bj * size : (r.bj + 1) * size] = block
            whole[r.bj * size : (r.bj + 1) * size, r.bi * size : (r.bi + 1) * size] = block.T
        np.testing.assert_allclose(whole[:width, :width], square(own.i.to_numpy(), own.j.to_numpy(), own.value.to_numpy(), width), atol=1e-8)
        assert not whole[width:].any()


def test_sweeps_over_blocks_equal_the_packed_paths(crossed, monkeypatch):
    monkeypatch.setattr(blocked, "REMOVED", 6)
    monkeypatch.setattr(blocked, "FETCHED", 5)
    table, d = crossed
    theirs = fits.fit_models(table, d, "_part", {"all": list(d.predictors)}, list(fits.STEPWISE), 3).toPandas()
    ours = blocked.stepwise_paths(table, d, "_part", "all", fits.PATHS, {fits.FORWARD: True, fits.BACKWARD: False}, 3, 50, 8)
    both = theirs.merge(ours.toPandas(), on=["horizon", "model", "fold", "step"], suffixes=("", "_b"))
    assert len(both) == len(theirs) == ours.count() == 2 * 4 * 29  # 30 terms, one aliased
    for c in ("size", "n", "mse", "rss", "intercept"):
        np.testing.assert_allclose(both[c], both[f"{c}_b"], rtol=1e-8)
    np.testing.assert_allclose(np.stack(both.betas), np.stack(both.betas_b), atol=1e-9)
    short = blocked.stepwise_paths(table, d, "_part", "all", fits.PATHS, {fits.BACKWARD: False}, 3, 4, 8)
    assert sorted({r.step for r in short.collect()}) == [1, 2, 3, 4]


def test_three_thousand_levels(spark):
    rng = np.random.default_rng(4)
    n = 20_000
    df = pd.DataFrame({"x": rng.normal(size=n), "g": (np.arange(n) * 7 % 3000).astype(str), "_part": np.arange(n) % 3})
    df["y"] = df.x + 5 * (df.g == "77") + 90 * (df.g == "1234") + 0.1 * rng.normal(size=n)
    table = spark.createDataFrame(df)
    d = fit_design(table, "y", ["x", "g"], max_terms=3000)
    paths = blocked.stepwise_paths(table, d, "_part", "all", fits.PATHS, {fits.FORWARD: True}, 2, 3)
    last = paths.where("fold = 0 AND step = 3").first()
    used = {d.terms[k].name: round(b, 1) for k, b in enumerate(last.betas) if b}
    assert len(d.terms) == 3000 and used == {"x": 1.0, "g=1234": 90.0, "g=77": 5.0}
    assert max(len(r["values"]) for r in blocked.blocked_gram(table, d, "_part").collect()) == 8 * blocked.SIZE**2
    train = df[df._part > 0]
    x = np.column_stack([train.x, train.g == "1234", train.g == "77"]).astype(float)
    b = ols(x, train.y.to_numpy())
    np.testing.assert_allclose(last.rss, np.sum((train.y - b[0] - x @ b[1:]) ** 2), rtol=1e-8)


def test_screened_descent_equals_the_packed_lasso(crossed):
    table, d = crossed
    theirs = fits.fit_models(table, d, "_part", {"all": list(d.predictors)}, [fits.LASSO], 3).toPandas()
    ours = wide_lasso.lasso_paths(table, d, "_part", "all", fits.PATHS, fits.LASSO, 3, size=8).toPandas()
    both = theirs.merge(ours, on=["horizon", "model", "fold", "step"], suffixes=("", "_b"))
    assert len(both) == len(theirs) == len(ours) == 400
    assert ours.gap.max() < 1e-8 and ours.breach.max() < 1e-8
    for c in ("lambda", "n", "mse", "rss"):
        np.testing.assert_allclose(both[c], both[f"{c}_b"], rtol=1e-6)
    # x3 is a multiple of x1, so only what they do together is determined.
    k, twice = [[t.name for t in d.terms].index(c) for c in ("x1", "x3")]
    flat = lambda rows: np.array([np.append(np.delete(b, [k, twice]), b[k] + 2 * b[twice]) for b in map(np.array, rows)])
    np.testing.assert_allclose(flat(both.betas), flat(both.betas_b), atol=1e-6)


def test_a_path_ends_where_it_would_need_too_many_columns(crossed):
    table, d = crossed
    short = wide_lasso.lasso_paths(table, d, "_part", "all", fits.PATHS, fits.LASSO, 3, max_size=6, size=64).toPandas()
    assert 0 < short.step.max() < 100 and short["size"].max() <= 6
    assert len(short) == 4 * short.step.max()
