"""DuckDB SQL of the common parts of the plans: panel, metrics, states."""

from __future__ import annotations

from ..config import CHANGE_WINDOWS, CONDITIONS, EVENTS, HORIZONS, RANK_WINDOWS, REGIMES
from ..functions.calendar import LAPSE, MOVED, SCHEDULE_YEAR
from ..operators.panel import INVERSE
from ..operators.states import ROLES, WIDE

AS_OF = "2001-06-30"

PANEL = """
li AS (SELECT r_name AS market, CASE l_returnflag WHEN 'A' THEN 'spec' WHEN 'N' THEN 'slow' ELSE 'other' END AS "role",
    CAST(l_shipdate AS DATE) AS d, CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS report_date, l_linestatus AS ls, l_quantity AS q, l_extendedprice / l_quantity AS px
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cells AS (SELECT market, "role", report_date, coalesce(sum(q) FILTER (ls = 'O'), 0) AS "long", coalesce(sum(q) FILTER (ls <> 'O'), 0) AS "short" FROM li GROUP BY 1, 2, 3),
pos AS (SELECT *, greatest(sum("long") OVER (PARTITION BY market, report_date), sum("short") OVER (PARTITION BY market, report_date)) AS open_interest FROM cells),
pr AS (SELECT market, d AS date, avg(px) AS close FROM li GROUP BY 1, 2)"""


def pct(x: str, n: int, w: str, part: str) -> str:
    h = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    below = f"len(list_filter({h}, lambda y: y < {x})) + len(list_filter({h}, lambda y: y <= {x}))"
    return f"CASE WHEN {x} IS NOT NULL AND len({h}) = {n} THEN 100.0::DOUBLE * ({below}) / {2 * n} END AS {w}"


def rank(x: str, n: int, w: str, part: str) -> str:
    h = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN {x} IS NOT NULL AND len({h}) = {n} THEN CAST(len(list_filter({h}, lambda y: y < {x})) AS DOUBLE) END AS {w}"


def zscore(x: str, n: int, w: str, part: str) -> str:
    f = f"OVER ({part} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {f} = {n} THEN ({x} - avg({x}) {f}) / nullif(stddev_samp({x}) {f}, 0) END AS {w}"


def metrics() -> str:
    part = 'PARTITION BY market, "role" ORDER BY report_date'
    changes = [f"net - lag(net, {k}) OVER w AS chg_{k}w" for k in CHANGE_WINDOWS]
    changes += [f'"{s}" - lag("{s}", {k}) OVER w AS {s}_chg_{k}w' for s in ("long", "short") for k in (1, 4, 13)]
    changes += [f"open_interest - lag(open_interest, {k}) OVER w AS oi_chg_{k}w" for k in (1, 4)]
    ranks = [pct("net_oi", k, f"pct_{k}w", part) for k in RANK_WINDOWS] + [zscore("net_oi", k, f"z_{k}w", part) for k in RANK_WINDOWS]
    ranks += [rank("net", 156, "net_rank_156w", part), pct("open_interest", 52, "oi_pct_52w", part), zscore("chg_4w", 52, "chg_4w_z", part)]
    return f"""{PANEL},
bas AS (SELECT *, "long" - "short" AS net, ("long" - "short") / nullif(open_interest, 0) AS net_oi, "long" / nullif(open_interest, 0) AS long_oi,
  "short" / nullif(open_interest, 0) AS short_oi FROM pos),
chg AS (SELECT *, {", ".join(changes)}, CASE WHEN net > lag(net) OVER w THEN 1 ELSE 0 END AS u, CASE WHEN net < lag(net) OVER w THEN 1 ELSE 0 END AS dn
  FROM bas WINDOW w AS ({part})),
isl AS (SELECT *, sum(1 - u) OVER w AS ug, sum(1 - dn) OVER w AS dg FROM chg WINDOW w AS ({part})),
stk AS (SELECT *, CAST(sum(u) OVER (PARTITION BY market, "role", ug ORDER BY report_date) AS DOUBLE) AS streak_up_weeks,
  CAST(sum(dn) OVER (PARTITION BY market, "role", dg ORDER BY report_date) AS DOUBLE) AS streak_down_weeks FROM isl),
met AS (SELECT *, {", ".join(ranks)} FROM stk)"""


def holiday(d: str) -> str:
    return (
        f"(strftime({d}, '%m-%d') IN ('01-01', '06-19', '07-04', '11-11', '12-25')"
        f" OR (isodow({d}) = 1 AND month({d}) IN (1, 2) AND day({d}) BETWEEN 15 AND 21)"
        f" OR (isodow({d}) = 1 AND month({d}) = 5 AND day({d}) >= 25) OR (isodow({d}) = 1 AND month({d}) = 9 AND day({d}) <= 7)"
        f" OR (isodow({d}) = 4 AND month({d}) = 11 AND day({d}) BETWEEN 22 AND 28))"
    )


def availability(d: str) -> tuple[str, str]:
    """SQL of the release date, and of whether it is in the published schedule."""
    friday = f"({d} + 3 + CAST((12 - isodow({d} + 3)) % 7 AS INTEGER))"
    moved = " ".join(f"WHEN DATE '{k}' THEN DATE '{v}'" for k, v in MOVED.items())
    scheduled = f"(isodow({d}) = 2 AND year({d} + 3) = {SCHEDULE_YEAR})"
    derived = f"CASE WHEN {holiday(friday)} THEN {friday} + 1 ELSE {friday} END"
    return f"CASE WHEN {scheduled} THEN CASE {d} + 3 {moved} ELSE {d} + 3 END ELSE {derived} END", scheduled


def regime() -> str:
    rules = []
    for name, conditions in REGIMES:
        test = " AND ".join(f"coalesce({c} {'=' if op == '==' else op} {limit}, false)" for c, op, limit in conditions) or "true"
        rules.append(f"WHEN {test} THEN '{name}'")
    return f"CASE {' '.join(rules)} ELSE 'Unclassified' END"


def states() -> str:
    cells = [f'max(CASE WHEN "role" = \'{r}\' THEN "{c}" END) AS {r}_{c}' for r in ROLES for c in WIDE]
    part = "PARTITION BY market ORDER BY report_date"
    apart = lambda a, b: f"coalesce(({a} - lag({a}, 4) OVER w) * ({b} - lag({b}, 4) OVER w) < 0, false)"
    points = f"(SELECT market, report_date, availability_date + 7 * h AS due, h FROM avl CROSS JOIN (SELECT unnest([0, {', '.join(map(str, HORIZONS))}]) AS h))"
    sign = f"CASE WHEN market IN ({', '.join(repr(m) for m in INVERSE)}) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    returns = [f"{sign} * (max(close) FILTER (h = {h}) / nullif(max(close) FILTER (h = 0), 0) - 1) AS fwd_return_{h}w" for h in HORIZONS]
    return f"""{metrics()},
wid AS (SELECT market, report_date, {", ".join(cells)} FROM met GROUP BY 1, 2),
avl AS (SELECT *, {availability("report_date")[0]} AS availability_date FROM wid),
prc AS (SELECT a.*, p.close AS price_close FROM avl a ASOF LEFT JOIN pr p ON a.market = p.market AND a.report_date <= p.date),
pch AS (SELECT *, {", ".join(f"price_close / nullif(lag(price_close, {k}) OVER w, 0) - 1 AS price_chg_{k}w" for k in (4, 8, 12))}, {apart("slow_net", "spec_net")} AS div_slow, {apart("spec_net", "price_close")} AS div_price
  FROM prc WINDOW w AS ({part})),
psz AS (SELECT *, {zscore("price_chg_8w", 52, "price_chg_8w_z", part)}, {regime()} AS regime FROM pch),
pts AS (SELECT s.market, s.report_date, s.h, s.due, p.close FROM {points} s ASOF LEFT JOIN pr p ON s.market = p.market AND s.due <= p.date),
fwd AS (SELECT market, report_date, {", ".join(returns)} FROM pts WHERE h = 0 OR due <= DATE '{AS_OF}' GROUP BY 1, 2),
st AS (SELECT psz.*, fwd.* EXCLUDE (market, report_date) FROM psz LEFT JOIN fwd ON psz.market = fwd.market AND psz.report_date = fwd.report_date)"""


def moves() -> str:
    def move(key, q, weeks, direction):
        f = f"OVER (PARTITION BY market ORDER BY report_date ROWS BETWEEN 1 FOLLOWING AND {weeks} FOLLOWING)"
        x = f"max(price_close) {f} / nullif(price_close, 0) - 1" if direction == "up" else f"1 - min(price_close) {f} / nullif(price_close, 0)"
        return f"{x} AS move_{key}"

    cuts = [f"CASE WHEN count(move_{k}) >= 50 THEN quantile_cont(move_{k}, {q}) END AS thr_{k}" for k, q, *_ in EVENTS]
    return f"""{states()},
mov AS (SELECT *, {", ".join(move(*e) for e in EVENTS)} FROM st),
thr AS (SELECT market, {", ".join(cuts)} FROM mov GROUP BY 1),
evt AS (SELECT mov.*, {", ".join(f"move_{k} >= thr_{k} AS ev_{k}" for k, *_ in EVENTS)} FROM mov JOIN thr USING (market))"""


def conditions() -> str:
    top = lambda x: f"CASE WHEN count({x}) OVER (PARTITION BY market) >= 50 THEN {x} >= quantile_cont({x}, 0.85) OVER (PARTITION BY market) END"
    known = lambda *c: " AND ".join(f"{x} IS NOT NULL" for x in c)
    last = "lag(spec_net) OVER w"
    found = {
        "flow_spike_up": top("spec_chg_1w"),
        "flow_spike_down": top("(-spec_chg_1w)"),
        "net_flip_up": f"CASE WHEN {known('spec_net', last)} THEN spec_net > 0 AND {last} <= 0 END",
        "net_flip_down": f"CASE WHEN {known('spec_net', last)} THEN spec_net < 0 AND {last} >= 0 END",
        "turn_from_low": "CASE WHEN spec_pct_52w IS NOT NULL THEN spec_pct_52w <= 20 AND coalesce(spec_streak_up_weeks >= 2, false) END",
        "turn_from_high": "CASE WHEN spec_pct_52w IS NOT NULL THEN spec_pct_52w >= 80 AND coalesce(spec_streak_down_weeks >= 2, false) END",
        "short_squeeze": f"CASE WHEN {known('spec_chg_1w', 'spec_long_chg_1w')} THEN spec_chg_1w > 0 AND abs(spec_long_chg_1w) < abs(spec_chg_1w) / 3 END",
        "divergence_closing": f"CASE WHEN {known('spec_chg_4w', 'slow_chg_4w', 'spec_chg_1w', 'slow_chg_1w')} THEN spec_chg_4w * slow_chg_4w < 0 AND spec_chg_1w * slow_chg_1w > 0 END",
        "oi_surge": top("spec_oi_chg_1w"),
    }
    assert tuple(found) == CONDITIONS
    return f"""{moves()},
cnd AS (SELECT *, {", ".join(f"{v} AS c_{k}" for k, v in found.items())} FROM evt WINDOW w AS (PARTITION BY market ORDER BY report_date))"""


LAPSE_TEST = f"BETWEEN DATE '{LAPSE[0]}' AND DATE '{LAPSE[1]}'"
