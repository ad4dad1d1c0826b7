"""Explicit schemas of the inputs, as DDL.

Declaring the Parquet tables saves a pass over file footers before planning.
CSV columns that arrive as dirty text (vote counts with a sub-header, populations,
quarterly income) stay strings here and go through the tolerant casts of
``functions.cleaning``.
"""

NATIONAL_RETURNS = (
    "year INT, party STRING, winner BOOLEAN, candidate STRING, pv DOUBLE, pv2p DOUBLE, "
    "incumbent BOOLEAN, incumbent_party BOOLEAN, prev_admin BOOLEAN"
)
STATE_RETURNS = (
    "state STRING, year INT, total BIGINT, D BIGINT, R BIGINT, R_pv2p DOUBLE, D_pv2p DOUBLE"
)
COUNTY_RETURNS = "year INT, state STRING, county STRING, fips STRING, D_win_margin DOUBLE"
CANDIDATE_RETURNS = (
    "year INT, state STRING, party STRING, candidate STRING, candidatevotes BIGINT, totalvotes BIGINT"
)
ECONOMY = "year INT, quarter INT, GDP_growth_qt DOUBLE, RDI_growth DOUBLE, unemployment DOUBLE"
LOCAL_UNEMPLOYMENT = (
    "`FIPS Code` STRING, `State and area` STRING, Year INT, Month STRING, Unemployed_prce DOUBLE"
)
NATIONAL_POLLS = "year INT, party STRING, weeks_left INT, avg_support DOUBLE"
STATE_POLLS = (
    "year INT, state STRING, party STRING, candidate_name STRING, weeks_left INT, avg_poll DOUBLE"
)
POLL_FEED = (
    "state STRING, candidate_name STRING, fte_grade STRING, pct DOUBLE, start_date STRING, end_date STRING"
)
POLLSTER_RATINGS = "pollster_rating_id INT, `538 Grade` STRING, latest_poll STRING"
APPROVAL = "year INT, president STRING, approve DOUBLE, disapprove DOUBLE, poll_enddate DATE"
ELIGIBLE_POPULATION = "state STRING, year INT, VEP STRING"
DEMOGRAPHICS = (
    "state STRING, year INT, Asian DOUBLE, Black DOUBLE, Hispanic DOUBLE, White DOUBLE, "
    "Female DOUBLE, age20 DOUBLE, age3045 DOUBLE, age4565 DOUBLE, age65 DOUBLE"
)

CSV_SCHEMAS = {
    "national_returns": NATIONAL_RETURNS,
    "state_returns": STATE_RETURNS,
    "county_returns": COUNTY_RETURNS,
    "candidate_returns": CANDIDATE_RETURNS,
    "economy": ECONOMY,
    "local_unemployment": LOCAL_UNEMPLOYMENT,
    "national_polls": NATIONAL_POLLS,
    "state_polls": STATE_POLLS,
    "poll_feed": POLL_FEED,
    "pollster_ratings": POLLSTER_RATINGS,
    "approval": APPROVAL,
    "eligible_population": ELIGIBLE_POPULATION,
    "demographics": DEMOGRAPHICS,
}

TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
}
