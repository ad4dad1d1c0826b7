"""The registered queries once more, as DuckDB SQL over the same tables.

Written independently of the operators: sums of centred products and cofactor
inverses instead of moment sweeps, an explicit refit for every hold-out, unrolled
Newton steps for the binomial fits. Named building blocks are chained as CTEs.
"""

from __future__ import annotations

from collections.abc import Sequence

from panelcast.functions.student import quantile_table
from panelcast.plans import domain
from panelcast.sources.inline import GRADE_TIERS, TIER_WEIGHTS, TURNOUT_SCENARIOS

FIRST = "(SELECT min(CAST(year(o_orderdate) AS INTEGER)) FROM orders)"
LAST = "(SELECT max(CAST(year(o_orderdate) AS INTEGER)) FROM orders)"


def r(expr: str, name: str, digits: int = 6) -> str:
    """A rounded output column; adding zero turns -0.0 into 0.0."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _values(rows: Sequence[Sequence], columns: str) -> str:
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else repr(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows) + f") AS v({columns})"


_SEGMENT_SUMS = ", ".join(
    f"sum(CASE WHEN c_mktsegment = '{s}' THEN o_totalprice ELSE 0.0 END) AS {s.lower()}"
    for s in domain.SEGMENTS
)
_SEGMENT_NAMES = [s.lower() for s in domain.SEGMENTS]

BLOCKS: dict[str, str] = {
    "returns": """
        SELECT n_name AS unit, CAST(year(o_orderdate) AS INTEGER) AS year,
               sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS d,
               sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS r,
               sum(o_totalprice) AS total,
               count(*) AS trials,
               count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS d_count,
               count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS r_count
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "shares": """
        SELECT *, 100.0 * d / nullif(total, 0) AS d_pv, 100.0 * r / nullif(total, 0) AS r_pv,
               100.0 * d / nullif(d + r, 0) AS d_pv2p, 100.0 * r / nullif(d + r, 0) AS r_pv2p,
               100.0 * (d - r) / nullif(d + r, 0) AS margin
        FROM returns""",
    "subunits": """
        SELECT o_custkey AS subunit, CAST(year(o_orderdate) AS INTEGER) AS year,
               sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) AS d,
               sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END) AS r
        FROM orders GROUP BY 1, 2""",
    "margins": """
        SELECT subunit, year, (d - r) * 100.0 / nullif(d + r, 0) AS margin FROM subunits""",
    "segments": f"""
        SELECT n_name AS unit, CAST(year(o_orderdate) AS INTEGER) AS year,
               sum(o_totalprice) AS total, {_SEGMENT_SUMS}
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "segment_shares": "SELECT unit, year, "
    + ", ".join(f"100.0 * {s} / nullif(total, 0) AS {s}" for s in _SEGMENT_NAMES)
    + " FROM segments",
    "months": """
        SELECT n_name AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS month,
               100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*) AS d_pct,
               100.0 * count(CASE WHEN o_orderstatus = 'O' THEN 1 END) / count(*) AS r_pct,
               sum(o_totalprice) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "late_polls": f"""
        SELECT unit, year, avg(d_pct) AS d_poll, avg(r_pct) AS r_poll FROM months
        WHERE round(date_diff('day', last_day(make_date(year, month, 1)), make_date(year, 12, 31)) / 7.0)
              <= {domain.POLL_WEEKS}
        GROUP BY 1, 2""",
    "national": """
        SELECT year, sum(d) AS d, sum(r) AS r, 100.0 * sum(d) / (sum(d) + sum(r)) AS d_pv2p,
               100.0 * sum(r) / (sum(d) + sum(r)) AS r_pv2p
        FROM returns GROUP BY 1""",
    "office": """
        SELECT year + 1 AS year, CASE WHEN d > r THEN 'D' WHEN r > d THEN 'R' END AS in_office
        FROM national""",
    "wide": """
        SELECT s.*, lag(s.d_pv2p) OVER w AS lag_d, lag(s.r_pv2p) OVER w AS lag_r,
               g.building - lag(g.building) OVER w AS segment_chng, in_office, d_poll, r_poll
        FROM shares s JOIN segment_shares g USING (unit, year)
        LEFT JOIN late_polls USING (unit, year) LEFT JOIN office USING (year)
        WINDOW w AS (PARTITION BY unit ORDER BY year)""",
    "features": """
        SELECT unit, year, 'D' AS party, d_pv AS pv, d_pv2p AS pv2p, lag_d AS lag_pv2p, segment_chng,
               CAST(in_office = 'D' AS INTEGER) * 1.0 AS incumbent_party, d_poll AS avg_poll,
               d_count AS successes, trials, in_office FROM wide
        UNION ALL
        SELECT unit, year, 'R', r_pv, r_pv2p, lag_r, segment_chng,
               CAST(in_office = 'R' AS INTEGER) * 1.0, r_poll, r_count, trials, in_office FROM wide""",
    "train": f"SELECT * FROM features WHERE year < {LAST}",
    "score": f"SELECT * FROM features WHERE year = {LAST}",
    "quantiles": "SELECT * FROM "
    + _values([(i + 1, v) for i, v in enumerate(quantile_table())], "qdf, t"),
    "tiers": "SELECT * FROM " + _values(GRADE_TIERS, "grade, tier"),
    "grades": "SELECT * FROM " + _values(domain.SEGMENT_GRADES, "segment, grade"),
    "feed": """
        SELECT user_id, CAST(value AS DECIMAL(20, 6)) AS pct, CAST(ts AS DATE) AS end_date,
               CASE event_type WHEN 'click' THEN 'D' WHEN 'purchase' THEN 'R' END AS party
        FROM events""",
    "graded": """
        SELECT f.party, coalesce(t.tier, 'low') AS tier, f.pct
        FROM feed f JOIN customer c ON f.user_id = c.c_custkey
        LEFT JOIN grades g ON g.segment = c.c_mktsegment
        LEFT JOIN tiers t ON t.grade = g.grade WHERE f.party IS NOT NULL""",
    "tier_means": "SELECT party, "
    + ", ".join(f"avg(CASE WHEN tier = '{t}' THEN pct END) AS tier_{t.lower()}" for t in TIER_WEIGHTS)
    + " FROM graded GROUP BY 1",
    "weighted_polls": "SELECT *, "
    + " + ".join(f"{w} * tier_{t.lower()}" for t, w in TIER_WEIGHTS.items())
    + " AS weighted_pct FROM tier_means",
    "quarters": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, quarter(o_orderdate) AS quarter,
               sum(o_totalprice) AS value FROM orders GROUP BY 1, 2""",
    "growth": """
        SELECT q.year, 100.0 * (q.value - p.value) / p.value AS growth_q2
        FROM quarters q JOIN quarters p ON p.year = q.year AND p.quarter = 1 WHERE q.quarter = 2""",
    "national_months": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS month,
               100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*) AS d_pct,
               100.0 * count(CASE WHEN o_orderstatus = 'O' THEN 1 END) / count(*) AS r_pct
        FROM orders WHERE month(o_orderdate) >= 11 GROUP BY 1, 2""",
    "national_polls": """
        SELECT year, 'D' AS party, avg(d_pct) AS support FROM national_months GROUP BY 1
        UNION ALL SELECT year, 'R', avg(r_pct) FROM national_months GROUP BY 1""",
    "national_sides": """
        SELECT year, 'D' AS party, d_pv2p AS pv2p FROM national
        UNION ALL SELECT year, 'R', r_pv2p FROM national""",
    "national_panel": """
        SELECT DISTINCT year, party, pv2p, support, growth_q2, in_office = party AS is_incumbent
        FROM national_sides FULL JOIN national_polls USING (year, party)
        JOIN growth USING (year) JOIN office USING (year)""",
    "items": """
        SELECT l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
               CAST(l_returnflag = 'R' AS INTEGER) * 1.0 AS returned,
               CAST(year(l_shipdate) AS INTEGER) AS year, 'price' AS model FROM lineitem""",
    "weights": """
        SELECT n_name AS unit, CAST(3 + count(*) // 10 AS BIGINT) AS ev
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "battlegrounds": "SELECT * FROM " + _values([(u,) for u in domain.BATTLEGROUNDS], "unit"),
}

BLOCKS["national_support"] = f"""
        SELECT year, avg(d_pct) AS d_support, avg(r_pct) AS r_support
        FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, month(o_orderdate) AS month,
                     100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*) AS d_pct,
                     100.0 * count(CASE WHEN o_orderstatus = 'O' THEN 1 END) / count(*) AS r_pct
              FROM orders GROUP BY 1, 2)
        WHERE round(date_diff('day', last_day(make_date(year, month, 1)), make_date(year, 12, 31)) / 7.0)
              <= {domain.POLL_WEEKS}
        GROUP BY 1"""
BLOCKS["conditions"] = """
        SELECT o.year, o.in_office, CAST(o.in_office = b.in_office AS INTEGER) * 1.0 AS two_terms,
               CASE o.in_office WHEN 'D' THEN d_support - r_support WHEN 'R' THEN r_support - d_support END AS net_approve,
               growth_q2, 100.0 * (q.value - e.value) / e.value AS income_growth
        FROM office o LEFT JOIN office b ON b.year = o.year - 1
        LEFT JOIN national_support s ON s.year = o.year LEFT JOIN growth g ON g.year = o.year
        LEFT JOIN quarters q ON q.year = o.year AND q.quarter = 2
        LEFT JOIN quarters e ON e.year = o.year - 1 AND e.quarter = 2"""

_NEEDS = {
    "conditions": ["office", "national_support", "growth", "quarters"],
    "shares": ["returns"],
    "margins": ["subunits"],
    "segment_shares": ["segments"],
    "late_polls": ["months"],
    "national": ["returns"],
    "office": ["national"],
    "wide": ["shares", "segment_shares", "late_polls", "office"],
    "features": ["wide"],
    "train": ["features"],
    "score": ["features"],
    "graded": ["feed", "grades", "tiers"],
    "tier_means": ["graded"],
    "weighted_polls": ["tier_means"],
    "growth": ["quarters"],
    "national_polls": ["national_months"],
    "national_sides": ["national"],
    "national_panel": ["national_sides", "national_polls", "growth", "office"],
}


def _closure(names: Sequence[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def query(needs: Sequence[str], body: str, extra: Sequence[tuple[str, str]] = ()) -> str:
    """A statement over named blocks plus statement-specific CTEs."""
    ctes = [(n, BLOCKS[n]) for n in _closure(needs)] + list(extra)
    head = ",\n".join(f"{n} AS MATERIALIZED ({sql.strip()})" for n, sql in ctes)
    return f"WITH {head}\n{body.strip()}" if ctes else body.strip()


# -- regressions ---------------------------------------------------------------------------


def _entry(s: str, i: int, j: int) -> str:
    return f"{s}{min(i, j)}{max(i, j)}"


def _cofactor_inverse(k: int, s: str = "s") -> tuple[str, dict[tuple[int, int], str]]:
    """Determinant and adjugate entries of a symmetric 1x1 or 3x3 matrix."""
    if k == 1:
        return _entry(s, 0, 0), {(0, 0): "1.0"}
    if k == 2:
        det = f"({s}00 * {s}11 - {s}01 * {s}01)"
        return det, {(0, 0): f"{s}11", (0, 1): f"(-{s}01)", (1, 1): f"{s}00"}
    a = {(i, j): _entry(s, i, j) for i in range(3) for j in range(3)}

    def minor(i: int, j: int) -> str:
        rows = [x for x in range(3) if x != i]
        cols = [x for x in range(3) if x != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return (
            f"({sign}({a[rows[0], cols[0]]} * {a[rows[1], cols[1]]}"
            f" - {a[rows[0], cols[1]]} * {a[rows[1], cols[0]]}))"
        )

    adj = {(i, j): minor(i, j) for i in range(3) for j in range(i, 3)}
    det = "(" + " + ".join(f"{a[0, j]} * {adj[0, j]}" for j in range(3)) + ")"
    return det, adj


def ols(
    name: str, source: str, keys: Sequence[str], y: str, xs: Sequence[str], prefix: str
) -> list[tuple[str, str]]:
    """CTEs ending in ``name``: one fit per key from centred sums."""
    k = len(xs)
    by = ", ".join(keys)
    complete = " AND ".join(f"{v} IS NOT NULL" for v in [y, *xs])
    dev = ", ".join(f"{x} - avg({x}) OVER w AS d{i}" for i, x in enumerate([*xs, y]))
    sums = ", ".join(
        f"sum(d{i} * d{j}) AS s{i}{j}" for i in range(k + 1) for j in range(i, k + 1)
    )
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate([*xs, y]))
    det, adj = _cofactor_inverse(k)
    inv = {ij: f"({e} / nullif({det}, 0))" for ij, e in adj.items()}
    slopes = [
        " + ".join(f"{inv[min(i, j), max(i, j)]} * s{j}{k}" for j in range(k)) for i in range(k)
    ]
    centred = f"SELECT {by}, {', '.join([*xs, y])}, {dev} FROM {source} WHERE {complete} WINDOW w AS (PARTITION BY {by})"
    gram = f"SELECT {by}, count(*) AS n, {means}, {sums} FROM {name}_centred GROUP BY {by}"
    solved = (
        f"SELECT *, {', '.join(f'{e} AS b{i}' for i, e in enumerate(slopes))}, "
        + ", ".join(f"{e} AS i{i}{j}" for (i, j), e in inv.items())
        + f" FROM {name}_gram"
    )
    explained = " + ".join(f"b{i} * s{i}{k}" for i in range(k))
    intercept = f"m{k} - " + " - ".join(f"b{i} * m{i}" for i in range(k))
    p = prefix
    out = (
        f"SELECT {by}, n AS {p}_n, {intercept} AS {p}_b, "
        + ", ".join(f"b{i} AS {p}_b{i}" for i in range(k))
        + ", "
        + ", ".join(f"m{i} AS {p}_m{i}" for i in range(k + 1))
        + ", "
        + ", ".join(f"i{i}{j} AS {p}_i{i}{j}" for i, j in inv)
        + f", s{k}{k} AS {p}_sst, greatest(s{k}{k} - ({explained}), 0.0) AS {p}_sse, n - {k + 1} AS {p}_df"
        + f" FROM {name}_solved"
    )
    return [(f"{name}_centred", centred), (f"{name}_gram", gram), (f"{name}_solved", solved), (name, out)]


def pooled(
    name: str, source: str, unit: Sequence[str], group: Sequence[str], y: str, xs: Sequence[str], prefix: str
) -> list[tuple[str, str]]:
    """CTEs ending in ``name``: common slopes by demeaning rows within units."""
    k = len(xs)
    keys = [*group, *unit]
    by, gby = ", ".join(keys), ", ".join(group)
    complete = " AND ".join(f"{v} IS NOT NULL" for v in [y, *xs])
    dev = ", ".join(f"{x} - avg({x}) OVER w AS d{i}" for i, x in enumerate([*xs, y]))
    sums = ", ".join(f"sum(d{i} * d{j}) AS s{i}{j}" for i in range(k + 1) for j in range(i, k + 1))
    det, adj = _cofactor_inverse(k)
    inv = {ij: f"({e} / nullif({det}, 0))" for ij, e in adj.items()}
    slopes = [
        " + ".join(f"{inv[min(i, j), max(i, j)]} * s{j}{k}" for j in range(k)) for i in range(k)
    ]
    p = prefix
    centred = (
        f"SELECT {by}, {', '.join([*xs, y])}, {dev}, {y} - avg({y}) OVER g AS dy_all FROM {source} "
        f"WHERE {complete} WINDOW w AS (PARTITION BY {by}), g AS (PARTITION BY {gby})"
    )
    count_keys = f"count(DISTINCT concat_ws('|', {', '.join(unit)}))"
    gram = (
        f"SELECT {gby}, count(*) AS n, {count_keys} AS n_keys, sum(dy_all * dy_all) AS sst, {sums} "
        f"FROM {name}_centred GROUP BY {gby}"
    )
    solved = (
        f"SELECT *, {', '.join(f'{e} AS b{i}' for i, e in enumerate(slopes))}, "
        + ", ".join(f"{e} AS i{i}{j}" for (i, j), e in inv.items())
        + f" FROM {name}_gram"
    )
    means = (
        f"SELECT {by}, count(*) AS key_n, "
        + ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate([*xs, y]))
        + f" FROM {name}_centred GROUP BY {by}"
    )
    explained = " + ".join(f"b{i} * s{i}{k}" for i in range(k))
    intercept = f"m{k} - " + " - ".join(f"b{i} * m{i}" for i in range(k))
    out = (
        f"SELECT {', '.join('u.' + c for c in keys)}, n AS {p}_n, key_n AS {p}_key_n, {intercept} AS {p}_b, "
        + ", ".join(f"b{i} AS {p}_b{i}" for i in range(k))
        + ", "
        + ", ".join(f"m{i} AS {p}_m{i}" for i in range(k + 1))
        + ", "
        + ", ".join(f"i{i}{j} AS {p}_i{i}{j}" for i, j in inv)
        + f", sst AS {p}_sst, greatest(s{k}{k} - ({explained}), 0.0) AS {p}_sse, n - n_keys - {k} AS {p}_df"
        + f" FROM {name}_means u JOIN {name}_solved USING ({gby})"
    )
    return [
        (f"{name}_centred", centred),
        (f"{name}_gram", gram),
        (f"{name}_solved", solved),
        (f"{name}_means", means),
        (name, out),
    ]


PLUS_XS = ["lag_pv2p", "segment_chng", "incumbent_party"]
POLLS_XS = ["avg_poll"]


def _fit(prefix: str, xs: Sequence[str], alias: str) -> str:
    return f"{prefix}_b + " + " + ".join(f"{prefix}_b{i} * {alias}.{x}" for i, x in enumerate(xs))


def _half(prefix: str, xs: Sequence[str], alias: str, count: str) -> str:
    """Half-width before the quantile: sqrt of residual variance times leverage."""
    k = len(xs)
    terms = [f"1.0 / {count}"]
    for i in range(k):
        for j in range(k):
            di = f"({alias}.{xs[i]} - {prefix}_m{i})"
            dj = f"({alias}.{xs[j]} - {prefix}_m{j})"
            terms.append(f"{di} * {dj} * {prefix}_i{min(i, j)}{max(i, j)}")
    return f"sqrt({prefix}_sse / nullif({prefix}_df, 0) * ({' + '.join(terms)}))"


def _unpooled(source: str, keys: Sequence[str]) -> list[tuple[str, str]]:
    return [
        *ols("plus", source, keys, "pv", PLUS_XS, "plus"),
        *ols("polls", source, keys, "pv", POLLS_XS, "polls"),
    ]


def _quality(p: str) -> str:
    return f"1 - {p}_sse / nullif({p}_sst, 0) AS {p}_r2, {p}_sse / {p}_n AS {p}_mse"


UNPOOLED_ROWS = [
    *_unpooled("train", ["unit", "party"]),
    (
        "predicted",
        f"""SELECT s.unit, s.party, {_fit('plus', PLUS_XS, 's')} AS plus_fit, {_fit('polls', POLLS_XS, 's')} AS polls_fit,
            {_quality('plus')}, {_quality('polls')},
            qp.t * {_half('plus', PLUS_XS, 's', 'plus_n')} AS plus_half,
            qo.t * {_half('polls', POLLS_XS, 's', 'polls_n')} AS polls_half
            FROM score s LEFT JOIN plus USING (unit, party) LEFT JOIN polls USING (unit, party)
            LEFT JOIN quantiles qp ON qp.qdf = plus_df LEFT JOIN quantiles qo ON qo.qdf = polls_df""",
    ),
]

NATIONAL_INPUTS = (
    "inputs",
    "SELECT party, " + ", ".join(f"avg({x}) AS {x}" for x in [*PLUS_XS, *POLLS_XS]) + " FROM score GROUP BY 1",
)

POOLED_ROWS = [
    *pooled("plus", "train", ["unit"], ["party"], "pv", PLUS_XS, "plus"),
    *pooled("polls", "train", ["unit"], ["party"], "pv", POLLS_XS, "polls"),
    NATIONAL_INPUTS,
    (
        "predicted",
        f"""SELECT plus.unit, plus.party, {_fit('plus', PLUS_XS, 's')} AS plus_fit, {_fit('polls', POLLS_XS, 's')} AS polls_fit,
            {_quality('plus')}, {_quality('polls')},
            qp.t * {_half('plus', PLUS_XS, 's', 'plus_key_n')} AS plus_half,
            qo.t * {_half('polls', POLLS_XS, 's', 'polls_key_n')} AS polls_half
            FROM plus JOIN polls USING (unit, party) JOIN inputs s USING (party)
            LEFT JOIN quantiles qp ON qp.qdf = plus_df LEFT JOIN quantiles qo ON qo.qdf = polls_df""",
    ),
]


def _pick(party: str, expr: str) -> str:
    return f"max(CASE WHEN party = '{party}' THEN {expr} END)"


def _combine(keys: Sequence[str], source: str = "predicted", quality: bool = True) -> list[tuple[str, str]]:
    by = ", ".join(keys)
    picks = []
    for s, party in (("d", "D"), ("r", "R")):
        picks.append(f"{_pick(party, 'polls_fit')} AS {s}_polls")
        picks.append(f"{_pick(party, 'plus_fit')} AS {s}_plus")
        if quality:
            picks.append(f"{_pick(party, '0.5 * plus_r2 + 0.5 * polls_r2')} AS {s}_rsquared")
            picks.append(f"{_pick(party, '0.5 * plus_mse + 0.5 * polls_mse')} AS {s}_mse")
    return [
        ("both_sides", f"SELECT {by}, {', '.join(picks)} FROM {source} GROUP BY {by}"),
        (
            "forecast",
            """SELECT *, 0.5 * d_polls + 0.5 * (100.0 * d_plus / (d_plus + r_plus)) AS dem_p,
               0.5 * r_polls + 0.5 * (100.0 * r_plus / (d_plus + r_plus)) AS rep_p FROM both_sides""",
        ),
    ]


_FORECAST_BODY = f"""
    SELECT unit, {r('dem_p', 'dem_p')}, {r('rep_p', 'rep_p')}, {r('dem_p - rep_p', 'd_margin')},
           CASE WHEN dem_p > rep_p THEN 'D' WHEN rep_p > dem_p THEN 'R' END AS winner,
           {r('d_rsquared', 'd_rsquared')}, {r('r_rsquared', 'r_rsquared')},
           {r('d_mse', 'd_mse')}, {r('r_mse', 'r_mse')}
    FROM forecast"""


def _interval_body() -> str:
    columns = []
    for s, party in (("d", "D"), ("r", "R")):
        for m in ("plus", "polls"):
            columns.append(r(_pick(party, f"{m}_fit"), f"{s}_{m}"))
            columns.append(r(_pick(party, f"{m}_fit - {m}_half"), f"{s}_{m}_low"))
            columns.append(r(_pick(party, f"{m}_fit + {m}_half"), f"{s}_{m}_high"))
    return f"SELECT unit, {', '.join(columns)} FROM predicted GROUP BY unit"


def _fit_table(keys: Sequence[str]) -> str:
    columns = []
    for p, xs in (("plus", PLUS_XS), ("polls", POLLS_XS)):
        columns.append(r(f"{p}_b", f"{p}_intercept"))
        columns += [r(f"{p}_b{i}", f"{p}_{x}") for i, x in enumerate(xs)]
        columns.append(r(f"1 - {p}_sse / nullif({p}_sst, 0)", f"{p}_r2"))
        columns.append(r(f"{p}_sse / {p}_n", f"{p}_mse"))
        columns.append(f"{p}_df")
    by = ", ".join(keys)
    return f"SELECT {by}, {', '.join(columns)} FROM plus JOIN polls USING ({by})"


# -- hold-outs: every period is refitted on the rows of the others --------------------------

_OTHERS = (
    "others",
    """SELECT t.year AS held, f.* FROM features f
       JOIN (SELECT DISTINCT year FROM features) t ON f.year <> t.year""",
)

HOLDOUT_UNPOOLED = [
    _OTHERS,
    *_unpooled("others", ["unit", "party", "held"]),
    (
        "predicted",
        f"""SELECT s.unit, s.party, s.year, {_fit('plus', PLUS_XS, 's')} AS plus_fit, {_fit('polls', POLLS_XS, 's')} AS polls_fit
            FROM features s
            LEFT JOIN plus ON plus.unit = s.unit AND plus.party = s.party AND plus.held = s.year
            LEFT JOIN polls ON polls.unit = s.unit AND polls.party = s.party AND polls.held = s.year""",
    ),
]

HOLDOUT_POOLED = [
    _OTHERS,
    *pooled("plus", "others", ["unit"], ["party", "held"], "pv", PLUS_XS, "plus"),
    *pooled("polls", "others", ["unit"], ["party", "held"], "pv", POLLS_XS, "polls"),
    (
        "inputs",
        "SELECT party, year, "
        + ", ".join(f"avg({x}) AS {x}" for x in [*PLUS_XS, *POLLS_XS])
        + " FROM features GROUP BY 1, 2",
    ),
    (
        "predicted",
        f"""SELECT f.unit, f.party, f.year, {_fit('plus', PLUS_XS, 's')} AS plus_fit, {_fit('polls', POLLS_XS, 's')} AS polls_fit
            FROM features f JOIN inputs s ON s.party = f.party AND s.year = f.year
            LEFT JOIN plus ON plus.unit = f.unit AND plus.party = f.party AND plus.held = f.year
            LEFT JOIN polls ON polls.unit = f.unit AND polls.party = f.party AND polls.held = f.year""",
    ),
]

_ACTUAL = (
    "actual",
    f"""SELECT unit, year, {_pick('D', 'pv')} AS d_actual, {_pick('R', 'pv')} AS r_actual
        FROM features GROUP BY 1, 2""",
)

_COMPARED_COLUMNS = """
    dem_p - rep_p AS predicted_margin, d_actual - r_actual AS actual_margin,
    abs(dem_p - d_actual) AS d_error, abs(rep_p - r_actual) AS r_error,
    abs((d_actual - r_actual) - (dem_p - rep_p)) AS margin_error,
    CASE WHEN dem_p > rep_p THEN 'D' WHEN dem_p < rep_p THEN 'R' END AS predicted_winner,
    CASE WHEN d_actual > r_actual THEN 'D' WHEN d_actual < r_actual THEN 'R' END AS actual_winner"""

_HOLDOUT_TAIL = [
    *_combine(["unit", "year"], quality=False),
    _ACTUAL,
    ("compared", f"SELECT unit, year, dem_p, rep_p, {_COMPARED_COLUMNS} FROM forecast JOIN actual USING (unit, year)"),
]

_HOLDOUT_BODY = f"""
    SELECT unit, year, {r('dem_p', 'dem_p')}, {r('rep_p', 'rep_p')},
           {r('predicted_margin', 'predicted_margin')}, {r('actual_margin', 'actual_margin')},
           {r('margin_error', 'margin_error')}, predicted_winner, actual_winner FROM compared"""

COMPARED_NOW = [
    *UNPOOLED_ROWS,
    *_combine(["unit"]),
    _ACTUAL,
    (
        "compared",
        f"SELECT unit, {_COMPARED_COLUMNS} FROM forecast JOIN actual USING (unit) WHERE year = {LAST}",
    ),
]
FORECAST_NEEDS = ["train", "score", "quantiles"]


def _model_comparison() -> str:
    """Each model is a nested statement, so the same CTE names can serve both."""
    parts = []
    for model, rows, held in (
        ("pooled", POOLED_ROWS, HOLDOUT_POOLED),
        ("unpooled", UNPOOLED_ROWS, HOLDOUT_UNPOOLED),
    ):
        def nest(ctes, body):
            head = ", ".join(f"{n} AS MATERIALIZED ({sql.strip()})" for n, sql in ctes)
            return f"(WITH {head} {body})"

        fit = nest(
            [*rows, *_combine(["unit"])],
            "SELECT avg(d_rsquared) AS a, avg(r_rsquared) AS b, avg(d_mse) AS c, avg(r_mse) AS d FROM forecast",
        )
        errors = nest(
            [*held, *_HOLDOUT_TAIL],
            """SELECT avg(margin_error) AS e, avg(CAST(actual_winner = predicted_winner AS INTEGER)) AS h,
               count(margin_error) AS n FROM compared""",
        )
        parts.append(
            f"""SELECT '{model}' AS model, {r('a', 'd_rsquared')}, {r('b', 'r_rsquared')}, {r('c', 'd_mse')},
                {r('d', 'r_mse')}, {r('e', 'holdout_error')}, {r('h', 'hit_rate')}, n AS holdout_rows
                FROM {fit} AS fit, {errors} AS errors"""
        )
    return query(FORECAST_NEEDS, "\nUNION ALL\n".join(parts))


def _model_summaries() -> str:
    models = {
        "growth": ["growth_q2"],
        "growth_terms": ["growth_q2", "net_approve", "two_terms"],
        "income_terms": ["income_growth", "net_approve", "two_terms"],
        "terms": ["net_approve", "two_terms"],
    }
    extra = [
        (
            "sides",
            f"""SELECT f.pv2p, f.party = c.in_office AS held, c.growth_q2, c.income_growth, c.net_approve, c.two_terms
                FROM features f JOIN conditions c ON c.year = f.year
                WHERE f.year < {LAST} AND c.in_office IS NOT NULL""",
        )
    ]
    parts = []
    for name, xs in models.items():
        extra += ols(f"m_{name}", "sides", ["held"], "pv2p", xs, "p")
        parts.append(
            f"""SELECT CASE WHEN held THEN 'incumbent' ELSE 'challenger' END AS side, '{name}' AS model, p_n AS n,
                {r('1 - p_sse / p_sst', 'r2')}, {r('p_sse / p_n', 'mse')}, {r(_fit('p', xs, 's'), 'prediction')}
                FROM m_{name} JOIN conditions s ON s.year = {LAST}"""
        )
    return query(["features", "conditions"], " UNION ALL ".join(parts), extra)


# -- binomial fits: unrolled Newton steps from the pooled log odds --------------------------


def newton(source: str, xs: Sequence[str], steps: int) -> list[tuple[str, str]]:
    """CTEs ending in ``logit``: per-unit coefficients after a fixed number of steps."""
    k = len(xs)
    p = k + 1
    complete = " AND ".join(f"{x} IS NOT NULL" for x in xs)
    design = (
        f"SELECT unit, party, successes * 1.0 AS s, trials * 1.0 AS n, "
        + ", ".join(f"{x} - avg({x}) OVER w AS z{i + 1}" for i, x in enumerate(xs))
        + ", "
        + ", ".join(f"avg({x}) OVER w AS c{i + 1}" for i, x in enumerate(xs))
        + f", 1.0 AS z0 FROM {source} WHERE {complete} WINDOW w AS (PARTITION BY unit, party)"
    )
    start = (
        "SELECT unit, party, ln((sum(s) + 0.5) / (sum(n) - sum(s) + 0.5)) AS b0, "
        + ", ".join(f"0.0 AS b{i + 1}" for i in range(k))
        + ", "
        + ", ".join(f"min(c{i + 1}) AS c{i + 1}" for i in range(k))
        + " FROM design GROUP BY 1, 2"
    )
    out = [("design", design), ("step0", start)]
    eta = " + ".join(f"b{i} * z{i}" for i in range(p))
    det, adj = _cofactor_inverse(p, "h")
    for t in range(1, steps + 1):
        mu = f"(1.0 / (1.0 + exp(-({eta}))))"
        grads = ", ".join(f"sum((s - n * mu) * z{i}) AS g{i}" for i in range(p))
        hess = ", ".join(f"sum(n * mu * (1 - mu) * z{i} * z{j}) AS h{i}{j}" for i in range(p) for j in range(i, p))
        keep = ", ".join([f"min(b{i}) AS b{i}" for i in range(p)] + [f"min(c{i}) AS c{i}" for i in range(1, p)])
        rows = f"SELECT d.*, {', '.join(f'b{i}' for i in range(p))}, {mu} AS mu FROM (SELECT * FROM design) d JOIN (SELECT unit, party, {', '.join(f'b{i}' for i in range(p))} FROM step{t - 1}) USING (unit, party)"
        sums = f"SELECT unit, party, {keep}, {grads}, {hess} FROM ({rows}) GROUP BY 1, 2"
        move = ", ".join(
            f"b{i} + ("
            + " + ".join(f"{adj[min(i, j), max(i, j)]} * g{j}" for j in range(p))
            + f") / {det} AS b{i}"
            for i in range(p)
        )
        out.append((f"step{t}", f"SELECT unit, party, {move}, {', '.join(f'c{i}' for i in range(1, p))} FROM ({sums})"))
    intercept = "b0 - " + " - ".join(f"b{i} * c{i}" for i in range(1, p))
    out.append(
        (
            "logit",
            f"SELECT unit, party, {intercept} AS i0, {', '.join(f'b{i}' for i in range(1, p))} FROM step{steps}",
        )
    )
    return out


def _binomial_with_demographics() -> str:
    """Two predictors, and the deviance at the solution."""
    xs = ["avg_poll", "segment_chng"]
    log_term = "CASE WHEN {a} > 0 THEN {a} * ln({a} / {b}) ELSE 0.0 END"
    won = log_term.format(a="s", b="(n * mu)")
    lost = log_term.format(a="(n - s)", b="(n * (1 - mu))")
    extra = [
        *newton("features", xs, 8),
        (
            "fitted",
            """SELECT unit, party, f.successes * 1.0 AS s, f.trials * 1.0 AS n,
               1.0 / (1.0 + exp(-(i0 + b1 * f.avg_poll + b2 * f.segment_chng))) AS mu
               FROM logit JOIN features f USING (unit, party)
               WHERE f.avg_poll IS NOT NULL AND f.segment_chng IS NOT NULL""",
        ),
        ("deviances", f"SELECT unit, party, 2 * sum({won} + {lost}) AS deviance FROM fitted GROUP BY 1, 2"),
    ]
    body = f"""SELECT unit, party, {r('i0', 'b0')}, {r('b1', 'b_0')}, {r('b2', 'b_1')},
               {r('deviance', 'deviance')}, true AS converged FROM logit JOIN deviances USING (unit, party)"""
    return query(["features"], body, extra)


PROBABILITIES = [
    *newton("train", ["avg_poll"], 8),
    (
        "responses",
        """SELECT unit, party, i0, b1, trials, 1.0 / (1.0 + exp(-(i0 + b1 * avg_poll))) AS probability,
               i0 IS NOT NULL AS converged
           FROM score LEFT JOIN logit USING (unit, party)""",
    ),
]


def _uniform(*parts: str) -> str:
    text = f"concat_ws('|', '42', {', '.join(parts)}, CAST(draw AS VARCHAR))"
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


_SIDES = [
    *PROBABILITIES,
    (
        "sides",
        f"""SELECT unit, max(trials) AS trials, bool_and(converged) AS converged, {_pick('D', 'probability')} AS p_d, {_pick('R', 'probability')} AS p_r
            FROM responses GROUP BY 1""",
    ),
]


#: Binomial draws by the inverse of the distribution, summed from the weights around its most likely count.
_BINOMIAL_DRAWS = [
    *_SIDES,
    (
        "chances",
        """SELECT unit, 'd' AS side, trials AS n, p_d AS p FROM sides WHERE p_d IS NOT NULL
           UNION ALL SELECT unit, 'r', trials, p_r FROM sides WHERE p_r IS NOT NULL""",
    ),
    (
        "support",
        """SELECT *, unnest(generate_series(CAST(greatest(0, floor(n * p - 9 * sqrt(n * p * (1 - p)) - 40)) AS BIGINT),
                  CAST(least(n, ceil(n * p + 9 * sqrt(n * p * (1 - p)) + 40)) AS BIGINT))) AS k FROM chances""",
    ),
    (
        "walked",
        """SELECT *, sum(CASE WHEN k = low THEN 0.0 ELSE ln(((n - k + 1) * p) / (k * (1 - p))) END)
                  OVER (PARTITION BY unit, side ORDER BY k ROWS UNBOUNDED PRECEDING) AS walk
           FROM (SELECT *, min(k) OVER (PARTITION BY unit, side) AS low FROM support)""",
    ),
    ("weighed", "SELECT *, exp(walk - max(walk) OVER (PARTITION BY unit, side)) AS weight FROM walked"),
    (
        "summed",
        "SELECT *, sum(weight) OVER (PARTITION BY unit, side ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM weighed",
    ),
    (
        "stretches",
        """SELECT unit, side, k, coalesce(lag(share) OVER (PARTITION BY unit, side ORDER BY k), 0.0) AS low, share AS high
           FROM (SELECT unit, side, k, upto / max(upto) OVER (PARTITION BY unit, side) AS share FROM summed)""",
    ),
    (
        "drawn_counts",
        f"""SELECT a.unit, a.side, draw, max(k) AS k
            FROM (SELECT unit, side, draw, {_uniform('unit', 'side')} AS u
                  FROM chances, (SELECT unnest(range(1, 10001)) AS draw)) a
            JOIN stretches s ON a.unit = s.unit AND a.side = s.side AND u >= low AND u < high GROUP BY 1, 2, 3""",
    ),
    (
        "drawn",
        """SELECT unit, converged, draw, (d - r) * 100.0 / nullif(d + r, 0) AS margin
           FROM (SELECT unit, draw, max(CASE WHEN side = 'd' THEN k END) AS d, max(CASE WHEN side = 'r' THEN k END) AS r
                 FROM drawn_counts GROUP BY 1, 2) RIGHT JOIN sides USING (unit)""",
    ),
]

_MARGIN_QUANTILES = ", ".join(r(f"quantile_cont(margin, {q})", f"q{round(q * 100):02d}") for q in (0.05, 0.5, 0.95))


def _draw_distribution() -> str:
    body = f"""SELECT unit, count(margin) AS draws, {r('avg(CAST(margin > 0 AS INTEGER))', 'win_rate')},
               {r('avg(margin)', 'mean_margin')}, {_MARGIN_QUANTILES}, bool_and(converged) AS converged FROM drawn GROUP BY 1"""
    return query(["features", "train", "score"], body, _BINOMIAL_DRAWS)


def _binomial_histogram() -> str:
    more, body = _histogram(["unit"], "drawn", "margin", 100, 3)
    return query(["features", "train", "score"], body, [*_BINOMIAL_DRAWS, *more])


def _turnout_draws() -> list[tuple[str, str]]:
    scenarios = _values(TURNOUT_SCENARIOS, "scenario, d_lo, d_hi, r_lo, r_hi")

    def u(side: str) -> str:
        return _uniform("unit", "scenario", f"'{side}'")

    return [
        *_SIDES,
        (
            "votes",
            f"""SELECT unit, scenario, converged, trials * p_d * (d_lo + {u('d')} * (d_hi - d_lo)) AS d,
                       trials * p_r * (r_lo + {u('r')} * (r_hi - r_lo)) AS r
                FROM sides, {scenarios}, (SELECT unnest(range(1, 1001)) AS draw)""",
        ),
        ("drawn", "SELECT *, (d - r) * 100.0 / (d + r) AS margin FROM votes"),
    ]


def _turnout() -> str:
    body = f"""SELECT unit, scenario, count(margin) AS draws, {r('avg(CAST(margin > 0 AS INTEGER))', 'win_rate')},
               {r('avg(margin)', 'mean_margin')}, {_MARGIN_QUANTILES}, bool_and(converged) AS converged FROM drawn GROUP BY 1, 2"""
    return query(["features", "train", "score"], body, _turnout_draws())


# -- histograms -----------------------------------------------------------------------------


def _histogram(facets: Sequence[str], source: str, value: str, bins: int, digits: int = 6) -> tuple[list[tuple[str, str]], str]:
    by = ", ".join(facets)
    extra = [
        (
            "ranged",
            f"""SELECT {by}, {value} AS v, min({value}) OVER w AS lo, (max({value}) OVER w - min({value}) OVER w) / {bins}.0 AS width
                FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {by})""",
        ),
        (
            "binned",
            f"""SELECT *, CAST(CASE WHEN width = 0 THEN 1 ELSE least({bins}, floor((v - lo) / width) + 1) END AS INTEGER) AS bin
                FROM ranged""",
        ),
    ]
    body = f"""SELECT {by}, bin, {r('min(lo) + (bin - 1) * min(width)', 'bin_from', digits)},
               {r('min(lo) + bin * min(width)', 'bin_to', digits)}, count(*) AS rows FROM binned GROUP BY {by}, bin"""
    return extra, body


def _fit_histograms() -> str:
    extra = [
        *_unpooled("train", ["unit", "party"]),
        (
            "statistics",
            " UNION ALL ".join(
                f"SELECT party, '{p}' AS model, '{s}' AS statistic, {e} AS value FROM {p}"
                for p in ("plus", "polls")
                for s, e in (("r2", f"1 - {p}_sse / nullif({p}_sst, 0)"), ("mse", f"{p}_sse / {p}_n"))
            ),
        ),
    ]
    more, body = _histogram(["party", "model", "statistic"], "statistics", "value", 10)
    return query(["train"], body, [*extra, *more])


def _draw_histogram() -> str:
    more, body = _histogram(["unit", "scenario"], "drawn", "margin", 100, 3)
    return query(["features", "train", "score"], body, [*_turnout_draws(), *more])


def _margin_histogram() -> str:
    extra = [
        (
            "leaning",
            """SELECT year, margin, CASE WHEN margin > 0 THEN 'D' WHEN margin < 0 THEN 'R' END AS lean FROM margins
               WHERE margin <> 0""",
        )
    ]
    more, body = _histogram(["year", "lean"], "leaning", "margin", 100)
    return query(["margins"], body, [*extra, *more])


# -- the rest -------------------------------------------------------------------------------


def _ten_predictors() -> str:
    """Each predictor less its projections on the earlier ones; the last coefficient is that of the last remainder."""
    xs = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_quantity * l_discount", "l_quantity * l_tax",
          "l_discount * l_tax", "year(l_shipdate)", "month(l_shipdate)", "day(l_shipdate)"]
    whole = "WINDOW w AS (PARTITION BY flag)"
    listed = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))
    centred = ", ".join(f"x{i} - avg(x{i}) OVER w AS x{i}" for i in range(len(xs)))
    extra = [
        ("lines", f"SELECT l_returnflag AS flag, l_extendedprice AS y, {listed} FROM lineitem"),
        ("g0", f"SELECT flag, y - avg(y) OVER w AS y, {centred}, x0 - avg(x0) OVER w AS z0 FROM lines {whole}"),
    ]
    for j in range(1, len(xs)):
        less = " - ".join(f"z{i} * (sum(x{j} * z{i}) OVER w / sum(z{i} * z{i}) OVER w)" for i in range(j))
        extra.append((f"g{j}", f"SELECT *, x{j} - {less} AS z{j} FROM g{j - 1} {whole}"))
    last = len(xs) - 1
    explained = " + ".join(f"pow(sum(y * z{j}), 2) / sum(z{j} * z{j})" for j in range(len(xs)))
    extra.append(
        ("sums", f"SELECT flag, count(*) AS n, sum(y * y) AS sst, {explained} AS ssr, sum(y * z{last}) / sum(z{last} * z{last}) AS b FROM g{last} GROUP BY 1")
    )
    body = f"""SELECT flag, n, {len(xs) + 1} AS terms, {r('ssr / sst', 'r2', 4)},
               {r(f'1 - (1 - ssr / sst) * (n - 1) / (n - {len(xs) + 1})', 'adj_r2', 4)}, {r('sqrt((sst - ssr) / n)', 'spread', 4)},
               {r('b', 'ship_day', 4)} FROM sums"""
    return query([], body, extra)


def _shifts(n: int) -> str:
    return f"margin - lag(margin, {n}) OVER w"


def _slope_tests() -> str:
    """Two-sided p from the finite cosine series of the t distribution (integer degrees)."""
    fits = ols("simple", "features", ["party"], "pv", POLLS_XS, "simple")
    extra = [
        *fits,
        (
            "tested",
            """SELECT party, simple_df AS df, sqrt(simple_sse / simple_df * simple_i00) AS se,
               simple_b0 / sqrt(simple_sse / simple_df * simple_i00) AS t FROM simple""",
        ),
        ("angled", "SELECT *, atan(abs(t) / sqrt(df)) AS theta FROM tested"),
        (
            "series",
            """SELECT party, sum(CASE WHEN df % 2 = 0
                   THEN exp(lgamma(j + 0.5) - lgamma(j + 1.0) - lgamma(0.5)) * cos(theta) ** (2 * j)
                   ELSE exp(lgamma(j + 1.0) + lgamma(0.5) - lgamma(j + 1.5)) / 2 * cos(theta) ** (2 * j + 1) END) AS total
               FROM (SELECT *, unnest(range(0, CAST(CASE WHEN df % 2 = 0 THEN df / 2 ELSE (df - 1) / 2 END AS BIGINT))) AS j
                     FROM angled) GROUP BY 1""",
        ),
    ]
    p = """1 - CASE WHEN df % 2 = 0 THEN sin(theta) * total
           ELSE 2 / pi() * (theta + sin(theta) * total) END"""
    body = f"SELECT party, {r('se', 'se')}, {r('t', 't')}, {r(p, 'p')} FROM angled JOIN series USING (party)"
    return query(["features"], body, extra)


def _supplier(prefix_source: str, keys: Sequence[str], extra: Sequence[tuple[str, str]], stats: str, held: str | None = None) -> str:
    xs = ["l_quantity", "l_discount", "l_tax"]
    fits = ols("price", prefix_source, keys, "l_extendedprice", xs, "price")
    names = ", ".join(f"{k} AS year" if k == held else k for k in keys)
    coefficients = ", ".join(
        [r("price_b", "price_intercept", 4)] + [r(f"price_b{i}", f"price_{x}", 4) for i, x in enumerate(xs)]
    )
    body = f"""SELECT {names}, {coefficients}, {r('1 - price_sse / price_sst', 'price_r2', 4)}, {stats} FROM price"""
    return query(["items"], body, [*extra, *fits])


def statements() -> dict[str, str]:
    """SQL by query name."""
    segments = ", ".join(r(s, s) for s in _SEGMENT_NAMES)
    changes = ", ".join(
        r(f"{s} - lag({s}) OVER w", f"{s}_chng") for s in _SEGMENT_NAMES
    )
    first, last = f"{LAST} - 2", f"{LAST} - 1"
    out = {
        "returns_scan": query(
            ["returns"],
            f"SELECT unit, year, {r('d', 'd', 2)}, {r('r', 'r', 2)}, {r('total', 'total', 2)}, trials, d_count, r_count FROM returns",
        ),
        "shares": query(
            ["shares"],
            f"""SELECT unit, year, {r('d_pv', 'd_pv')}, {r('r_pv', 'r_pv')}, {r('d_pv2p', 'd_pv2p')},
                {r('r_pv2p', 'r_pv2p')}, {r('margin', 'd_margin')} FROM shares WHERE total > 0""",
        ),
        "winner_labels": query(
            ["returns"],
            """SELECT unit, year, CASE WHEN d > r THEN 'D' ELSE 'R' END AS winner_default,
               CASE WHEN d > r THEN 'D' WHEN r > d THEN 'R' END AS winner FROM returns""",
        ),
        "two_period_swing": query(
            ["shares"],
            f"""SELECT unit, {r('a.d_pv2p', 'd_first')}, {r('b.d_pv2p', 'd_last')},
                {r('b.d_pv2p - a.d_pv2p', 'swing')}, {r('b.r_pv2p - b.d_pv2p', 'lead')}
                FROM (SELECT * FROM shares WHERE year = {first}) a
                FULL JOIN (SELECT * FROM shares WHERE year = {last}) b USING (unit)
                WHERE b.r_pv2p - b.d_pv2p BETWEEN -10 AND 10""",
        ),
        "close_units": query(
            ["shares"],
            f"SELECT unit, year, {r('abs(margin)', 'margin')} FROM shares WHERE abs(margin) <= 5",
        ),
        "battlegrounds_per_year": query(
            ["shares"],
            f"""SELECT CASE WHEN year <= 1998 THEN 'early' ELSE 'late' END AS era, {r('avg(n)', 'mean_close')}, count(*) AS years
                FROM (SELECT year, count(*) AS n FROM shares WHERE abs(margin) <= 5 GROUP BY 1) GROUP BY 1""",
        ),
        "panel_lags": query(
            ["margins"],
            f"""SELECT subunit, year, {r('margin', 'margin')}, {r('lag_margin', 'lag_margin')},
                {r('lag5_margin', 'lag5_margin')}, {r('lead2_margin', 'lead2_margin')},
                {r('margin - lag_margin', 'shift')}
                FROM (SELECT *, lag(margin) OVER w AS lag_margin, lag(margin, 5) OVER w AS lag5_margin,
                             lead(margin, 2) OVER w AS lead2_margin FROM margins
                      WINDOW w AS (PARTITION BY subunit ORDER BY year)) WHERE year > {FIRST}""",
        ),
        "loyal_units_shift": query(
            ["margins"],
            f"""SELECT CASE WHEN a.margin > 0 THEN 'D' ELSE 'R' END AS lean, {r('avg(b.margin - a.margin)', 'mean_shift')},
                count(*) AS subunits
                FROM margins a JOIN margins b USING (subunit)
                WHERE a.year = {FIRST} AND b.year = {LAST} AND a.margin * b.margin > 0 GROUP BY 1""",
        ),
        "polarization_table": query(
            ["margins"],
            f"""SELECT year, {r('avg(shift) FILTER (WHERE margin < 0)', 'shift_r')},
                {r('avg(shift) FILTER (WHERE margin > 0)', 'shift_d')},
                {r('avg(margin) FILTER (WHERE margin < 0)', 'margin_r')},
                {r('avg(margin) FILTER (WHERE margin > 0)', 'margin_d')},
                {r('avg(margin) FILTER (WHERE margin > 0) - avg(margin) FILTER (WHERE margin < 0)', 'gap')}
                FROM (SELECT *, {_shifts(1)} AS shift FROM margins WINDOW w AS (PARTITION BY subunit ORDER BY year))
                GROUP BY 1""",
        ),
        "demographic_deltas": query(
            ["segment_shares"],
            f"SELECT unit, year, {segments}, {changes} FROM segment_shares WINDOW w AS (PARTITION BY unit ORDER BY year)",
        ),
        "unit_classes": query(
            [],
            f"""SELECT n_name AS unit, n_nationkey AS code, r_name AS region, class, count(*) AS subunits
                FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
                LEFT JOIN {_values(domain.REGION_CLASSES, 'region_name, class')} ON region_name = r_name
                GROUP BY 1, 2, 3, 4""",
        ),
        "membership_filters": query(
            ["shares", "battlegrounds"],
            f"""SELECT unit, year, {r('margin', 'margin')},
                CASE WHEN unit IN (SELECT unit FROM battlegrounds) THEN 'member' ELSE 'other' END AS membership FROM shares""",
        ),
        "feature_table": query(
            ["features", "months"],
            f"""SELECT f.unit, f.year, party, {r('coalesce(avg_poll, pv)', 'avg_poll')}, {r('CASE WHEN avg_poll IS NOT NULL THEN q.value_q2 END', 'value_q2', 2)},
                {r('pv', 'pv')}, {r('pv2p', 'pv2p')}, {r('lag_pv2p', 'lag_pv2p')},
                {r('f.segment_chng', 'segment_chng')}, f.in_office AS inc_party,
                CASE f.in_office WHEN 'D' THEN 'R' WHEN 'R' THEN 'D' END AS chl_party,
                {r("CASE f.in_office WHEN 'D' THEN w.d_pv2p WHEN 'R' THEN w.r_pv2p END", 'inc_pv')},
                {r("CASE f.in_office WHEN 'D' THEN w.r_pv2p WHEN 'R' THEN w.d_pv2p END", 'chl_pv')}
                FROM features f JOIN wide w ON w.unit = f.unit AND w.year = f.year
                LEFT JOIN (SELECT unit, year, sum(total) AS value_q2 FROM months WHERE month BETWEEN 4 AND 6 GROUP BY 1, 2) q
                ON q.unit = f.unit AND q.year = f.year""",
        ),
        "wide_to_long_series": query(
            ["months"],
            f"""SELECT unit, year, {r('value_q2', 'value_q2', 2)}
                FROM (SELECT DISTINCT unit FROM months)
                CROSS JOIN (SELECT CAST(unnest(range({FIRST}, {LAST} + 1, 2)) AS INTEGER) AS year)
                LEFT JOIN (SELECT unit, year, sum(total) AS value_q2 FROM months WHERE month BETWEEN 4 AND 6 GROUP BY 1, 2)
                USING (unit, year)""",
        ),
        "inline_dimension": query(
            ["national"],
            f"""SELECT year, CASE WHEN year BETWEEN 1995 AND 1998 THEN 'early' WHEN year BETWEEN 1999 AND 2001 THEN 'late' END AS era,
                CASE WHEN year BETWEEN 1995 AND 1998 THEN 0.5::DOUBLE WHEN year BETWEEN 1999 AND 2001 THEN 1.0::DOUBLE END AS weight,
                {r('d_pv2p', 'd_pv2p')},
                {r('d_pv2p * CASE WHEN year BETWEEN 1995 AND 1998 THEN 0.5 WHEN year BETWEEN 1999 AND 2001 THEN 1.0 END', 'weighted')}
                FROM national""",
        ),
        "incumbent_side": query(
            ["features"],
            f"SELECT unit, year, party, {r('pv', 'pv')}, {r('pv2p', 'pv2p')} FROM features WHERE party = in_office",
        ),
        "first_approval_join": query(
            [],
            f"""SELECT user_id AS rater, strftime(day, '%Y-%m-%d') AS day, {r('value - 50', 'net_approve')},
                c_mktsegment AS segment, n_name AS unit
                FROM (SELECT *, CAST(ts AS DATE) AS day,
                             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)
                JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE k = 1""",
        ),
        "turnout_range": query(
            ["returns"],
            f"""SELECT unit, {r('min(t)', 'min_turnout')}, {r('max(t)', 'max_turnout')}, {r('avg(t)', 'mean_turnout')}
                FROM (SELECT unit, (d_count + r_count) / trials::DOUBLE AS t FROM returns) GROUP BY 1""",
        ),
        "strongest_units": query(
            ["subunits"],
            """(SELECT *, 'top' AS "end" FROM totals ORDER BY margin DESC, subunit LIMIT 10)
               UNION ALL (SELECT *, 'bottom' FROM totals ORDER BY margin, subunit LIMIT 10)""",
            [
                (
                    "totals",
                    f"""SELECT subunit, {r('(sum(d) - sum(r)) * 100.0 / nullif(sum(d) + sum(r), 0)', 'margin')}
                        FROM subunits GROUP BY 1 HAVING sum(d) + sum(r) > 0""",
                )
            ],
        ),
        "order_gaps": f"""
SELECT o_orderkey, CAST(date_diff('day', lag(o_orderdate) OVER a, o_orderdate) AS INTEGER) AS days_since_last,
  {r('o_totalprice - lag(o_totalprice) OVER a', 'price_change', 2)},
  CAST(date_diff('day', lag(o_orderdate) OVER b, o_orderdate) AS INTEGER) AS days_since_own,
  {r('o_totalprice - lag(o_totalprice, 3) OVER b', 'price_change_3', 2)}
FROM orders
WINDOW a AS (ORDER BY o_orderdate, o_orderkey), b AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""".strip(),
        "graded_orders": f"""
SELECT grade, o_orderstatus AS status, count(*) AS orders, {r('max(o_totalprice)', 'largest', 2)}, {r('avg(o_totalprice)', 'mean_price', 2)}
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN {_values(domain.SEGMENT_GRADES, 'segment, grade')} ON segment = c_mktsegment GROUP BY 1, 2""".strip(),
        "ols_ten_predictors": _ten_predictors(),
        "ols_far_from_zero": f"""
SELECT o_orderstatus AS status, count(*) AS n, {r('regr_slope(o_totalprice, o_orderkey)', 'slope')}, {r('regr_r2(o_totalprice, o_orderkey)', 'r2')}
FROM orders GROUP BY 1""".strip(),
        "exact_totals": """
SELECT year, status, value_sum, value_n, value_sum / value_n AS value_mean
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, count(*) AS value_n,
        CAST(sum(CAST(o_totalprice * 1152921504606846976 AS HUGEINT)) AS DOUBLE) / 1152921504606846976 AS value_sum
      FROM orders GROUP BY 1, 2)""".strip(),
        "price_histogram": """
WITH ranged AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
wide AS (
  SELECT o_orderstatus, min(pow(2.0, k)) AS w FROM ranged, (SELECT unnest(range(-30, 60)) AS k)
  WHERE floor(hi / pow(2.0, k)) - floor(lo / pow(2.0, k)) + 1 <= 64 GROUP BY 1)
SELECT o_orderstatus, floor(o_totalprice / w) * w AS bin_from, (floor(o_totalprice / w) + 1) * w AS bin_to, count(*) AS rows
FROM orders JOIN wide USING (o_orderstatus) GROUP BY ALL""".strip(),
        "ranked_units": query(
            ["subunits"],
            "SELECT *, row_number() OVER (ORDER BY margin, subunit) AS order_index FROM totals",
            [
                (
                    "totals",
                    f"""SELECT subunit, {r('(sum(d) - sum(r)) * 100.0 / nullif(sum(d) + sum(r), 0)', 'margin')}
                        FROM subunits GROUP BY 1 HAVING sum(d) + sum(r) > 0""",
                )
            ],
        ),
        "recent_poll_average": query(
            ["feed"],
            f"""SELECT n_name AS unit, party, {r('avg(pct)', 'avg_pct')}, count(*) AS polls,
                CAST(min(date_diff('day', end_date, DATE '{domain.EVENT_DATE}')) AS INTEGER) AS min_days_left
                FROM feed JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
                WHERE party IS NOT NULL
                  AND round(date_diff('day', end_date, DATE '{domain.EVENT_DATE}') / 7.0) <= 2
                GROUP BY 1, 2""",
        ),
        "grade_weighted_polls": query(
            ["weighted_polls"],
            f"""SELECT party, {r('tier_a', 'tier_a')}, {r('tier_b', 'tier_b')}, {r('tier_low', 'tier_low')},
                {r('weighted_pct', 'weighted_pct')} FROM weighted_polls""",
        ),
        "tier_averages": query(
            ["graded"],
            f"SELECT party, tier, {r('avg(pct)', 'avg_pct')}, count(*) AS polls FROM graded GROUP BY 1, 2",
        ),
        "grade_counts": query(
            ["grades"],
            """SELECT grade, count(*) AS raters
               FROM (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-15') u
               JOIN customer ON user_id = c_custkey JOIN grades ON segment = c_mktsegment GROUP BY 1""",
        ),
        "polls_full_economy": query(
            ["national_panel"],
            f"""SELECT CASE WHEN is_incumbent THEN 'incumbent' ELSE 'challenger' END AS side,
                {r('avg(pv2p)', 'mean_pv2p')}, {r('avg(support)', 'mean_support')},
                {r('CASE WHEN count(*) = count(support) THEN avg(support) END', 'strict_support')},
                {r('avg(growth_q2)', 'mean_growth')}, count(*) AS periods
                FROM national_panel WHERE is_incumbent IS NOT NULL GROUP BY 1""",
        ),
        "poll_growth_ensemble": query(
            ["national_panel", "weighted_polls"],
            f"""SELECT n.party, CASE WHEN n.is_incumbent THEN 'incumbent' ELSE 'challenger' END AS side,
                {r('weighted_pct', 'weighted_pct')}, {r('a + b * growth_q2', 'economy_pct')}, {r('r2', 'growth_r2')},
                {r('0.7 * weighted_pct + 0.3 * (a + b * growth_q2)', 'blended')}
                FROM national_panel n
                JOIN (SELECT is_incumbent, regr_intercept(pv2p, growth_q2) AS a, regr_slope(pv2p, growth_q2) AS b,
                             regr_r2(pv2p, growth_q2) AS r2 FROM national_panel WHERE year < {LAST} GROUP BY 1) f
                USING (is_incumbent) JOIN weighted_polls USING (party) WHERE n.year = {LAST}""",
        ),
        "party_in_office_share": query(
            ["national", "office"],
            f"""SELECT year, in_office, {r("CASE in_office WHEN 'D' THEN d_pv2p WHEN 'R' THEN r_pv2p END", 'incumbent_pv2p')}
                FROM national JOIN office USING (year)""",
        ),
        "ols_simple": query(
            ["features"],
            f"""SELECT party, {r('corr(pv, avg_poll)', 'correlation')}, {r('regr_slope(pv, avg_poll)', 'slope')},
                {r('regr_intercept(pv, avg_poll)', 'intercept')}, {r('regr_r2(pv, avg_poll)', 'r2')},
                {r('1 - (1 - regr_r2(pv, avg_poll)) * (count(*) - 1) / (count(*) - 2)', 'adj_r2')}, count(*) AS n
                FROM features WHERE pv IS NOT NULL AND avg_poll IS NOT NULL GROUP BY 1""",
        ),
        "ols_slope_tests": _slope_tests(),
        "ols_multi_predict": query(
            ["items"],
            f"""SELECT {r('price_b', 'price_intercept', 4)}, {r('price_b0', 'price_l_quantity', 4)},
                {r('price_b1', 'price_l_discount', 4)}, {r('price_b2', 'price_returned', 4)},
                {r('1 - price_sse / price_sst', 'price_r2', 4)},
                {r('price_b + 25 * price_b0 + 0.05 * price_b1 + price_b2', 'price_fit', 4)}, price_n AS n FROM price""",
            ols("price", "items", ["model"], "l_extendedprice", ["l_quantity", "l_discount", "returned"], "price"),
        ),
        "ols_by_supplier": _supplier(
            "items", ["l_suppkey"], [], f"price_df, {r('sqrt(price_sse / price_n)', 'rmse', 4)}"
        ),
        "holdout_by_supplier": _supplier(
            "others",
            ["l_suppkey", "held"],
            [
                (
                    "others",
                    """SELECT t.year AS held, i.* FROM items i
                       JOIN (SELECT DISTINCT l_suppkey, year FROM items) t
                       ON t.l_suppkey = i.l_suppkey AND t.year <> i.year""",
                )
            ],
            "price_n AS n",
            "held",
        ),
        "ols_per_unit": query(["train"], _fit_table(["unit", "party"]), _unpooled("train", ["unit", "party"])),
        "ols_by_class": query(
            ["train"],
            _fit_table(["class", "party"]),
            [
                (
                    "classed",
                    f"""SELECT t.*, class FROM train t JOIN nation ON unit = n_name
                        JOIN region ON n_regionkey = r_regionkey
                        LEFT JOIN {_values(domain.REGION_CLASSES, 'region_name, class')} ON region_name = r_name""",
                ),
                *_unpooled("classed", ["class", "party"]),
            ],
        ),
        "ols_fixed_effects": query(["train"], _fit_table(["unit", "party"]), POOLED_ROWS[:10]),
        "fit_residuals": query(
            ["train"],
            f"""SELECT s.unit, s.year, s.party, {r(f"s.pv - ({_fit('plus', PLUS_XS, 's')})", 'plus_residual')},
                {r(f"s.pv - ({_fit('polls', POLLS_XS, 's')})", 'polls_residual')}
                FROM train s JOIN plus USING (unit, party) JOIN polls USING (unit, party)""",
            _unpooled("train", ["unit", "party"]),
        ),
        "unpooled_forecast": query(FORECAST_NEEDS, _FORECAST_BODY, [*UNPOOLED_ROWS, *_combine(["unit"])]),
        "unpooled_intervals": query(FORECAST_NEEDS, _interval_body(), UNPOOLED_ROWS),
        "pooled_forecast": query(FORECAST_NEEDS, _FORECAST_BODY, [*POOLED_ROWS, *_combine(["unit"])]),
        "pooled_intervals": query(FORECAST_NEEDS, _interval_body(), POOLED_ROWS),
        "interval_feed": query(
            FORECAST_NEEDS,
            " UNION ALL ".join(
                f"""SELECT unit, order_index, order_d_plus, order_r_polls, order_r_plus, '{party}' AS party, '{m}' AS model, {r(f'{m}_fit', 'point')},
                    {r(f'{m}_fit - {m}_half', 'low')}, {r(f'{m}_fit + {m}_half', 'high')}
                    FROM predicted JOIN places USING (unit) WHERE party = '{party}'"""
                for party in ("D", "R")
                for m in ("plus", "polls")
            ),
            [
                *UNPOOLED_ROWS,
                (
                    "places",
                    "SELECT unit, "
                    + ", ".join(
                        f"row_number() OVER (ORDER BY {_pick(party, f'{m}_fit')} NULLS FIRST, unit) AS {name}"
                        for name, party, m in (
                            ("order_index", "D", "polls"),
                            ("order_d_plus", "D", "plus"),
                            ("order_r_polls", "R", "polls"),
                            ("order_r_plus", "R", "plus"),
                        )
                    )
                    + " FROM predicted GROUP BY unit",
                ),
            ],
        ),
        "holdout_unpooled": query(["features"], _HOLDOUT_BODY, [*HOLDOUT_UNPOOLED, *_HOLDOUT_TAIL]),
        "holdout_pooled": query(["features"], _HOLDOUT_BODY, [*HOLDOUT_POOLED, *_HOLDOUT_TAIL]),
        "model_comparison": _model_comparison(),
        "model_summaries": _model_summaries(),
        "weighted_outcome": query(
            [*FORECAST_NEEDS, "weights"],
            " UNION ALL ".join(
                f"""SELECT winner, CAST(sum(ev) AS BIGINT) AS total_weight, count(*) AS units, '{kind}' AS outcome
                    FROM (SELECT {kind}_winner AS winner, ev FROM compared JOIN weights USING (unit)
                          UNION ALL SELECT 'D', 3) WHERE winner IS NOT NULL GROUP BY 1"""
                for kind in ("predicted", "actual")
            ),
            COMPARED_NOW,
        ),
        "error_summary": query(
            [*FORECAST_NEEDS, "battlegrounds"],
            f"""SELECT category AS "Category", {r('avg(d_error)', '"Democratic Error"', 2)},
                {r('avg(r_error)', '"Republican Error"', 2)}, {r('avg(margin_error)', '"Margin Error"', 2)},
                {r('avg(CAST(actual_winner = predicted_winner AS INTEGER))', '"Hit Rate"', 2)}, count(*) AS "Units"
                FROM (SELECT *, 'All Units' AS category FROM compared UNION ALL
                      SELECT *, CASE WHEN unit IN (SELECT unit FROM battlegrounds) THEN 'Battleground Units'
                                ELSE 'Non-Battleground Units' END FROM compared) GROUP BY 1""",
            COMPARED_NOW,
        ),
        "winner_confusion": query(
            FORECAST_NEEDS,
            "SELECT actual_winner, predicted_winner, count(*) AS units FROM compared GROUP BY 1, 2",
            COMPARED_NOW,
        ),
        "battleground_errors": query(
            [*FORECAST_NEEDS, "battlegrounds"],
            f"""SELECT unit, {r('actual_margin', 'actual_margin', 2)}, {r('predicted_margin', 'predicted_margin', 2)},
                {r('margin_error', 'margin_error', 2)} FROM compared JOIN battlegrounds USING (unit)""",
            COMPARED_NOW,
        ),
        "fit_histograms": _fit_histograms(),
        "margin_histogram": _margin_histogram(),
        "binomial_per_unit": query(
            ["features", "train", "score"],
            f"""SELECT unit, party, {r('i0', 'b0')}, {r('b1', 'b_0')}, {r('probability', 'probability')}, converged
                FROM responses""",
            PROBABILITIES,
        ),
        "binomial_with_demographics": _binomial_with_demographics(),
        "draw_distribution": _draw_distribution(),
        "draw_histogram": _draw_histogram(),
        "binomial_histogram": _binomial_histogram(),
        "turnout_scenarios": _turnout(),
    }
    return out
