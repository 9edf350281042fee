"""The whole way from schedule pages to scenario forecasts, on a small invented league."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gatecast.operators.categorical import feature_sets
from gatecast.plans import model_frame as mf
from gatecast.plans.forecast import forecast
from gatecast.plans.matches import COLUMNS, ORDER, matches_from_pages
from gatecast.session import materialize

TEAMS = ["HFC", "ANK", "BYN", "OB", "RFC"]
SEASONS = range(2002, 2012)


def schedule():
    """(season, round, rows): every pair meets twice a season; the last rounds are not played yet."""
    rng = random.Random(3)
    out = []
    for season in SEASONS:
        pairs = [(h, a) for h in TEAMS for a in TEAMS if h != a]
        rng.shuffle(pairs)
        teams = pairs + ([("NEW", "HFC"), ("HFC", "NEW")] if season == 2006 else [])
        for round_no, start in enumerate(range(0, len(teams), 2), 1):
            rows = []
            day = dt.date(season - 1, 7, 20) + dt.timedelta(days=28 * round_no)
            for h, a in teams[start : start + 2]:
                open_ = season == SEASONS[-1] and round_no >= 9
                score = "Optakt" if open_ else f"{rng.choice([0, 1, 2, 3, 10])}-{rng.randrange(4)}"
                gate = "" if open_ else f"{rng.randrange(2, 9)}.{rng.randrange(1000):03d}"
                clock = rng.choice(["14:00", "16:30", "18:35", "09:00"])
                rows.append([rng.choice(["Søn", "Lør", "Man"]), f"{day:%d/%m} {clock}", f"{h}-{a}", score, gate, "N.N.", "TV"])
            out.append((season, round_no, rows))
    return out


def html(tables):
    cell = lambda tag, v: f"<{tag}>{v}</{tag}>"
    text = ""
    for _, n, rows in tables:
        head = "".join(cell("th", f"Runde {n}" if not i else "") for i in range(len(COLUMNS)))
        body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows)
        text += f"<table><tr>{head}</tr>{body}</table>"
    return f"<html><body><div id='content'>{text}</div></body></html>"


@pytest.fixture(scope="module")
def matches(spark):
    all_ = schedule()
    pages = [(str(s), html([t for t in all_ if t[0] == s])) for s in SEASONS]
    df = spark.createDataFrame(pages, "season string, html string")
    return materialize(matches_from_pages(df), "matches")


def test_matches(matches):
    want = [
        (str(s), n, *(v or None for v in r[:4]), float(r[4]) * 1000 if r[4] else None) for s, n, rows in schedule() for r in rows
    ]
    got = [
        (r.sæson_år, int(r.runde_nr), r.ugedag, r.dato_tid, r.kamp, r.resultat, r.tilskuere)
        for r in matches.orderBy("sæson_år", "table_no", "row_no").collect()
    ]
    assert got == want


def brute(team):
    """Look-backs of one team, row by row in ingest order."""
    out, last, season_points, met_fixture, met_team, goals, points = [], None, {}, {}, {}, [], []
    for season, round_no, rows in schedule():
        for _, _, kamp, score, gate, *_ in rows:
            h, a = kamp.split("-")
            if team not in (h, a):
                continue
            rival = a if h == team else h
            total = lambda xs: sum(xs) if len(xs) == 3 and None not in xs else None
            row = {
                "sæson_år": str(season), "kamp": kamp, "mål_sidste_kamp": goals[-1] if goals else None,
                "mål_sidste3_lagged": total(goals[-3:]), "point_sidste3_lagged": total(points[-3:]),
                "resultat_lagged": last[0] if last else None, "point_sæson_lagged": last[1] if last else None,
                "sidste_møde_tilskuere": met_fixture.get(kamp), "sidste_møde_resultat": met_team.get(rival),
            }
            out.append(row)
            if score == "Optakt":
                result = point = goal = None
            else:
                x, y = map(int, score.split("-"))
                goal, other = (x, y) if h == team else (y, x)
                result = "vundet" if goal > other else "tabt" if goal < other else "uafgjort"
                point = {"vundet": 3, "uafgjort": 1, "tabt": 0}[result]
            goals.append(goal)
            points.append(point)
            before = season_points.get(season, 0)
            season_points[season] = None if before is None or point is None else before + point
            last = (result, season_points[season])
            met_fixture[kamp] = float(gate) * 1000 if gate else None
            met_team[rival] = result
    return out


@pytest.mark.parametrize("team", ["HFC", "BYN", "NEW"])
@pytest.mark.parametrize("hot_rows", [None, 40])
def test_history_row_by_row(matches, team, hot_rows):
    history = mf.team_history(matches, ORDER, hot_rows=hot_rows).where(F.col("hold") == team)
    got = history.orderBy(*ORDER).collect()
    want = brute(team)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert {k: g[k] for k in w} == w


def test_text_compare_changes_results(matches):
    number = mf.team_history(matches, ORDER, hot_rows=None)
    text = mf.team_history(matches, ORDER, compat="text", hot_rows=None)
    won = lambda df: df.where("resultat like '10-%' and er_hjemme and holdets_resultat = 'vundet'").count()
    assert won(number) > won(text)


@pytest.fixture(scope="module")
def sides(spark):
    """Hourly weather, holidays and advance sales for every match."""
    rng = random.Random(11)
    weather, sales, seen = [], [], set()
    for season, round_no, rows in schedule():
        for r in rows:
            day, clock = r[1].split()
            d, m = map(int, day.split("/"))
            year = season - 1 if m >= 7 else season
            local = dt.datetime(year, m, d, int(clock[:2]), int(clock[3:]), tzinfo=ZoneInfo("Europe/Copenhagen"))
            utc = local.astimezone(dt.timezone.utc).replace(minute=0)
            key = utc.strftime("%Y-%m-%dT%H:%M:%SZ")
            if key not in seen:
                seen.add(key)
                weather += [(p, rng.uniform(0, 9), key) for p in ("temp_dry", "wind_speed", "precip_past1h", "cloud")]
            gate = float(r[4]) * 1000 if r[4] else 5000.0
            if not r[2].startswith("HFC-"):
                continue
            sales.append((year, round_no, *(gate * w + rng.uniform(-e, e) for w, e in ((0.3, 900), (0.5, 500), (0.8, 100)))))
    obs = spark.createDataFrame(weather, "parameterId string, value double, observed string")
    days = spark.createDataFrame([("2003-12-25", "Juledag"), ("2005-08-17", "x")], "dato string, helligdag string")
    sold = spark.createDataFrame(sales, "`år` int, runde int, d10_tilskuere double, d7_tilskuere double, d3_tilskuere double")
    return obs, days, sold


@pytest.fixture(scope="module")
def frame(matches, sides):
    sold = sides[2].dropDuplicates(["år", "runde"])
    return materialize(mf.model_frame(matches, sides[0], sides[1], sold, "HFC", ORDER), "frame")


def test_model_frame(frame):
    got = frame.collect()
    seasons = {r.sæson_år for r in got}
    assert "2002" not in seasons and "2003" in seasons
    assert all(r.kamp.startswith("HFC-") for r in got)
    assert {r.modstander for r in got} == {"ANK", "BYN", "OB", "RFC", "andre_hold"}
    assert all(r.precip_past1h is not None and r.tilskuere is not None for r in got)
    first = [r for r in got if r.kamp == "HFC-NEW"]
    assert len(first) == 1 and first[0].sidste_møde_resultat in ("første møde", "vundet", "tabt", "uafgjort")
    for r in got:
        assert r.måned == r.datotid.month and r.uge_nr == (r.datotid.timetuple().tm_yday - 1) // 7 + 1
        hour = r.datotid.hour
        assert r.tidspunkt == {14: "middag", 16: "eftermiddag", 18: "aften", 9: None}[hour]


def test_forecast_to_scenarios(spark, frame):
    shared = ["ugedag", "modstander", "mål_sidste_kamp", "sidste_møde_tilskuere", "temp_dry"]
    horizons = feature_sets(shared, {"måned1": [], "dag10": ["d10_tilskuere"], "dag7": ["d7_tilskuere"], "dag3": ["d3_tilskuere"]})
    done = forecast(frame, "tilskuere", horizons, ["kamp", "datotid"], folds=4)
    board = done.leaderboard(root=True)
    assert board.count() == 5 and board.columns == ["model", "måned1", "dag10", "dag7", "dag3"]
    best = {r.horizon: r for r in done.best().collect()}
    assert best["dag3"].rmse < best["måned1"].rmse
    again = forecast(frame.repartition(3), "tilskuere", horizons, ["kamp", "datotid"], folds=4)
    for h, r in {r.horizon: r for r in again.best().collect()}.items():
        assert r.best_model == best[h].best_model and r.mse == pytest.approx(best[h].mse, rel=1e-6)
    base = frame.where("tidspunkt is not null").limit(1)
    rows = base.select(F.lit("Best Case").alias("scenario"), *shared, *mf.SALES).union(
        base.withColumn("modstander", F.lit("???")).select(F.lit("Worst Case"), *shared, *mf.SALES)
    )
    scored = done.scenarios(rows).collect()
    assert len(scored) == 8
    assert all((r.predicted is None) == (r.scenario == "Worst Case") for r in scored)
    given = {"måned1": "Ridge", "dag10": "Lasso", "dag7": "Lasso", "dag3": "Lasso"}
    assert {(r.horizon, r.model) for r in done.scenarios(rows, models=given).collect()} == set(given.items())
    predicted = done.predictions(["kamp", "datotid", "tilskuere"])
    assert predicted.groupBy("horizon", "model").count().count() == 20
    assert {r.model for r in done.penalties().collect()} == {"Ridge", "Lasso"}
    assert all(r.lambda_1se >= r.lambda_min for r in done.penalties().collect())
    assert done.coefficients().where("term = '(Intercept)'").count() == 20


def test_schedule_pages_stay_small_however_many_orders_a_month_has(spark, tmp_path, monkeypatch):
    import datetime

    from gatecast.registry import stored

    rows = [(k, k % 7, datetime.date(1995, 3, 1 + k % 3), "O", 1000.0 + k) for k in range(90)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    sizes = []
    read = stored.matches_from_pages

    def seen(pages, **more):
        sizes.extend(r.html.count("<td>Man") for r in pages.collect())
        return read(pages, **more)

    monkeypatch.setattr(stored, "matches_from_pages", seen)
    monkeypatch.setattr(stored, "PAGE_KEYS", 20, raising=False)
    got = sorted((r.page, r.table_no, r.row_no, r.fixture) for r in stored.plan_matches(spark, str(tmp_path)).collect())
    print("largest page", max(sizes), "pages", len(sizes))
    assert got == [(3, 1 + d, 2 + n, f"C{(3 * n + d) % 7}-K{3 * n + d}") for d in range(3) for n in range(30)]
    assert max(sizes) <= 20 and sum(sizes) == 90
