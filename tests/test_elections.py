"""The election inputs end to end on small literal CSV files."""

import numpy as np
import pytest
from panelcast.operators.ensemble import combine_sides, pooled_rows, unpooled_rows
from panelcast.operators.logit import logit_by_key
from panelcast.operators.outcomes import weighted_totals
from panelcast.plans import elections as E
from panelcast.sources.inline import inline_table
from panelcast.sources.readers import read_padded_csv, read_source
from panelcast.sources.states import EXTERNAL_VOTES, STATES, state_dimension
from pyspark.sql import functions as F

YEARS = [1992, 1996, 2000, 2004, 2008, 2012, 2016]
NAMES = {"Ohio": "OH", "Texas": "TX", "Alaska": "AK"}
IN_OFFICE = {1992: "R", 1996: "D", 2000: "D", 2004: "R", 2008: "R", 2012: "D", 2016: "D"}


def lines(path, head, rows):
    path.write_text(head + "\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    rng = np.random.default_rng(11)
    returns, polls, people, eligible = [], [], [], []
    for i, (state, code) in enumerate(NAMES.items()):
        for y in YEARS:
            d, r = int(rng.integers(3000, 6000)), int(rng.integers(3000, 6000))
            total = d + r + int(rng.integers(50, 500))
            returns.append((state, y, total, d, r, 100 * r / (d + r), 100 * d / (d + r)))
            eligible.append((state, y, 2 * total))
            for party, own in (("democrat", d), ("republican", r)):
                for w in (3, 5, 9):
                    polls.append((y, state, party, "X", w, round(100 * own / total + rng.normal(), 1)))
        for y in range(1990, 2019, 2):
            people.append((code, y, *[round(float(v), 3) for v in rng.uniform(5, 60, 9)]))
    national = [
        (y, p, "TRUE", '"Doe, J."', 50.0, 50.0, "TRUE", str(IN_OFFICE[y] == s).upper(), "FALSE")
        for y in YEARS
        for p, s in (("democrat", "D"), ("republican", "R"))
    ]
    files = {
        "state_returns": lines(folder / "r.csv", "state,year,total,D,R,R_pv2p,D_pv2p", returns),
        "state_polls": lines(folder / "p.csv", "year,state,party,candidate_name,weeks_left,avg_poll", polls),
        "national_returns": lines(
            folder / "n.csv", "year,party,winner,candidate,pv,pv2p,incumbent,incumbent_party,prev_admin", national
        ),
        "demographics": lines(
            folder / "d.csv", "state,year,Asian,Black,Hispanic,White,Female,age20,age3045,age4565,age65", people
        ),
        "eligible_population": lines(folder / "v.csv", "state,year,VEP", [*eligible, ("United States", 2016, 9)]),
        "poll_feed": lines(
            folder / "f.csv",
            "state,candidate_name,fte_grade,pct,start_date,end_date",
            [
                ("Ohio", "Blue", "A", 47, "10/20/20", "10/30/20"),
                ("Ohio", "Blue", "B", 49, "10/20/20", "10/28/20"),
                ("Ohio", "Red", "B", 46, "10/20/20", "10/28/20"),
                ("Texas", "Blue", "B", 45, "10/20/20", "10/28/20"),
                ("Texas", "Red", "B", 50, "10/20/20", "10/28/20"),
                ("Alaska", "Red", "B", 55, "10/20/20", "10/28/20"),
                ("Ohio", "Blue", "A", 10, "8/20/20", "8/30/20"),
                ("NA", "Blue", "A", 10, "10/20/20", "10/30/20"),
            ],
        ),
    }
    path = folder / "i.csv"
    path.write_text(
        "Income\nUnits\nby state\nquarterly\nGeoFips,GeoName,1992:Q2,1996:Q2\n"
        "1,Ohio,10,12\n2,Alaska *,(NA),22\n3,Texas,31,33\nLegend\nnote\n"
    )
    tables = {kind: read_source(spark, kind, p) for kind, p in files.items()}
    tables["income"] = read_padded_csv(spark, str(path), ["unit_id", "unit", "q1992", "q1996"], ["q1992", "q1996"])
    return tables


@pytest.fixture(scope="module")
def features(spark, inputs):
    names = inline_table(spark, [("2", "Alaska")], "unit_id STRING, unit STRING")
    income = E.income_rows(inputs["income"], {"q1992": 1992, "q1996": 1996}, names)
    return E.state_features(
        inputs["state_returns"],
        inputs["state_polls"],
        inputs["national_returns"],
        inputs["demographics"],
        income,
        state_dimension(spark),
    ).checkpoint()


def score(spark, inputs, features):
    live = E.live_averages(inputs["poll_feed"], "2020-11-03", {"Blue": "D", "Red": "R"})
    changes = E.demographic_changes(inputs["demographics"], state_dimension(spark))
    return E.scoring_rows(features, live, changes, 2016, 2018, "R")


def test_features(inputs, features):
    assert features.count() == 3 * 7 * 2
    row = features.filter("unit = 'Ohio' AND year = 1996 AND party = 'D'").first()
    returns = {(r["state"], r["year"]): r for r in inputs["state_returns"].collect()}
    now, before = returns["Ohio", 1996], returns["Ohio", 1992]
    assert row["pv"] == pytest.approx(100 * now["D"] / now["total"])
    assert row["lag_pv2p"] == pytest.approx(before["D_pv2p"])
    assert row["incumbent_party"] is True and row["inc_pv"] == pytest.approx(now["D_pv2p"])
    assert row["rdi_q2"] == 12.0
    late = inputs["state_polls"].filter("state = 'Ohio' AND year = 1996 AND party = 'democrat' AND weeks_left <= 5")
    assert row["avg_poll"] == pytest.approx(late.agg(F.avg("avg_poll")).first()[0])
    people = {r["year"]: r["White"] for r in inputs["demographics"].filter("state = 'OH'").collect()}
    assert row["white_chng"] == pytest.approx(people[1996] - people[1994])
    alaska = features.filter("unit = 'Alaska' AND party = 'R'")
    assert {r["year"]: r["rdi_q2"] for r in alaska.filter("year <= 2000").collect()} == {1992: None, 1996: 22.0, 2000: None}


def test_forecast(spark, inputs, features):
    scoring = score(spark, inputs, features)
    rows = {(r["unit"], r["party"]): r for r in unpooled_rows(features, scoring, formulas=E.FORMULAS).collect()}
    train = features.filter("unit = 'Ohio' AND party = 'D' AND lag_pv2p IS NOT NULL").toPandas()
    x = np.column_stack(
        [np.ones(len(train)), train["lag_pv2p"], train["white_chng"], train["incumbent_party"].astype(float)]
    )
    beta = np.linalg.lstsq(x, train["pv"].to_numpy(), rcond=None)[0]
    new = scoring.filter("unit = 'Ohio' AND party = 'D'").first()
    assert new["avg_poll"] == 48.0 and new["incumbent_party"] is False
    expected = beta @ [1.0, new["lag_pv2p"], new["white_chng"], 0.0]
    assert rows["Ohio", "D"]["plus_fit"] == pytest.approx(expected, rel=1e-7)
    assert rows["Alaska", "D"]["polls_fit"] is None and rows["Alaska", "R"]["polls_fit"] is not None
    forecast = combine_sides(unpooled_rows(features, scoring, formulas=E.FORMULAS), ["unit"])
    labelled = {r["unit"]: r["winner"] for r in forecast.collect()}
    assert labelled["Alaska"] is None and labelled["Ohio"] in ("D", "R")
    external = inline_table(spark, [EXTERNAL_VOTES], "winner STRING, ev BIGINT")
    totals = weighted_totals(forecast, "winner", state_dimension(spark), "unit", "ev", external)
    assert sum(r["total_weight"] for r in totals.collect()) == 18 + 38 + 3
    pooled = combine_sides(pooled_rows(features, scoring, formulas=E.FORMULAS), ["unit"])
    assert pooled.count() == 3 and pooled.filter("dem_p IS NULL").count() == 0


def test_binomial_input(inputs):
    table = E.binomial_input(inputs["state_returns"], inputs["state_polls"], inputs["eligible_population"])
    assert table.count() == 3 * 7 * 2
    fits = logit_by_key(table, ["unit", "party"], "successes", "trials", ["avg_poll"])
    assert fits.filter("converged").count() == 6


def test_counties(spark):
    history = spark.createDataFrame(
        [(2000, "X", "a", "1", 10.0), (2000, "X", "b", "2", -5.0), (2000, "X", "c", "3", 1.0)],
        "year INT, state STRING, county STRING, fips STRING, D_win_margin DOUBLE",
    )
    latest = spark.createDataFrame(
        [("FIPS", "Name", "Votes", "Votes"), ("1", "a", "600", "400"), ("2", "b", "1,000", "3"), ("3", "c", "40", "60")],
        ["FIPS", "Geographic Name", "Side D", "Side R"],
    )
    margins = E.county_margins(history, latest, 2020, ["FIPS", "Geographic Name", "Side D", "Side R"])
    rows = {(r["county"], r["year"]): r for r in margins.collect()}
    assert rows["a", 2020]["margin"] == pytest.approx(20.0) and rows["c", 2020]["lean"] == "R"
    assert rows["b", 2020]["margin"] is None
    shift = E.loyal_county_shift(margins, 2000, 2020).collect()
    assert [(r["lean"], r["mean_shift"], r["counties"]) for r in shift] == [("D", pytest.approx(10.0), 1)]


def test_state_table(spark):
    assert len(STATES) == 50 and sum(row[2] for row in STATES) + EXTERNAL_VOTES[1] == 538
    counts = {r[0]: r[1] for r in state_dimension(spark).groupBy("class").count().collect()}
    assert counts == {"Red": 20, "Blue": 19, "Swing": 6, "Sun Swing": 5}
    assert state_dimension(spark).filter("is_battleground").count() == 13
