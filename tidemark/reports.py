"""Texts and reports.  They repeat numbers that were computed; they never make any."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Mapping

from .config import MIN_SAMPLE


def percent(x, digits: int = 1) -> str:
    return "n/a" if x is None else f"{x * 100:.{digits}f}%"


def signed(x, digits: int = 1, unit: str = "") -> str:
    return "n/a" if x is None else f"{x:+.{digits}f}{unit}"


def number(x, digits: int = 0) -> str:
    return "n/a" if x is None else f"{x:,.{digits}f}".replace(",", " ")


def ordinal(x) -> str:
    if x is None:
        return "n/a"
    n = round(x)
    tail = "th" if 10 <= n % 100 <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{tail}"


def edge_words(edge_pp) -> str:
    if edge_pp is None:
        return "no comparison"
    size = abs(edge_pp)
    return "noise" if size < 5 else "a moderate difference" if size < 12 else "a substantial difference"


def horizon_lines(outcomes: Mapping[int, Mapping]) -> list[str]:
    """A line per horizon; too small a sample shows no statistics."""
    lines = []
    for weeks, o in sorted(outcomes.items()):
        if (o.get("n") or 0) < MIN_SAMPLE:
            lines.append(f"{weeks} weeks: {o.get('n') or 0} cases, too few for statistics.")
            continue
        lines.append(
            f"{weeks} weeks: {o['n']} cases, rose in {percent(o.get('win_rate'))}, median {percent(o.get('median_return'), 2)}; "
            f"base rate {percent(o.get('base_win_rate'))}, difference {signed(o.get('win_diff_pp'), 1, ' pp')}: {edge_words(o.get('win_diff_pp'))}."
        )
    return lines


CODES = {
    "both_long": "Both fast and slow money are long.",
    "both_short": "Both fast and slow money are short.",
    "fast_long_slow_short": "Fast money is long against slow money.",
    "fast_short_slow_long": "Fast money is short against slow money.",
    "mixed": "One of the groups is flat.",
    "missing": "A group is missing.",
    "funds_long_hedgers_short": "Funds are long against hedgers.",
    "funds_short_hedgers_long": "Funds are short against hedgers.",
    "funds_flat": "Funds are flat.",
    "no_move": "Neither side moved in the week.",
    "two_sided": "Both sides moved against each other.",
    "longs_added": "Longs were added.",
    "longs_cut": "Longs were cut.",
    "shorts_added": "Shorts were added.",
    "shorts_covered": "Shorts were covered.",
    "new_longs": "Interest rose with net longs: new money.",
    "short_covering": "Net rose while interest fell: covering.",
    "new_shorts": "Interest rose while net fell: new shorts.",
    "both_fell": "Net and interest fell together.",
    "not_proven": "An advantage is not proven: too few independent cases.",
    "noise": "No advantage: the difference is noise.",
    "unconfirmed": "The block interval covers the base rate: not confirmed.",
    "robust": "The block interval leaves the base rate out: it holds on history.",
    "no_data": "Nothing to compare with.",
}


def crowded(pct) -> bool:
    return pct is not None and (pct <= 20 or pct >= 80)


def facts(row: Mapping) -> list[str]:
    """Blocks on the week, interest, month and quarter, streaks, history and price, as far as they are known."""
    known = lambda *names: all(row.get(n) is not None for n in names)
    out = []
    if known("spec_chg_1w"):
        out.append(f"Week: net {signed(row['spec_chg_1w'], 0)}. {CODES.get(row.get('flow'), '')}".strip())
    if row.get("interest"):
        out.append(f"Open interest: {CODES[row['interest']]}")
    if known("spec_oi_pct_52w"):
        level = "unusually busy" if row["spec_oi_pct_52w"] >= 80 else "unusually quiet" if row["spec_oi_pct_52w"] <= 20 else "as busy as usual"
        out.append(f"Activity: {ordinal(row['spec_oi_pct_52w'])} percentile of a year's open interest, {level}.")
    if known("spec_chg_4w"):
        quarter = f" Quarter: {signed(row['spec_chg_13w'], 0)}." if known("spec_chg_13w") else ""
        out.append(f"Month: net {signed(row['spec_chg_4w'], 0)}.{quarter}")
    for way in ("up", "down"):
        if (row.get(f"spec_streak_{way}_weeks") or 0) >= 2:
            out.append(f"Streak: {int(row[f'spec_streak_{way}_weeks'])} weeks {way}.")
    if known("spec_pct_52w"):
        more = [f"{ordinal(row['spec_pct_156w'])} of three"] if known("spec_pct_156w") else []
        more += [f"net was lower in {number(row['spec_net_rank_156w'])} of the last 156 weeks"] if known("spec_net_rank_156w") else []
        more += [f"{signed(row['spec_z_52w'], 2)} deviations from its mean"] if known("spec_z_52w") else []
        out.append(f"History: {'; '.join([ordinal(row['spec_pct_52w']) + ' percentile of a year', *more])}.")
    if known("price_chg_4w"):
        out.append(f"Price: {percent(row['price_chg_4w'], 2)} in four weeks.")
        if known("spec_chg_4w"):
            same = (row["spec_chg_4w"] > 0) == (row["price_chg_4w"] > 0)
            out.append("Fast money went with the price." if same else "Fast money went against the price.")
    return out


def interpretation(row: Mapping, outcome: Mapping | None = None, horizon: int = 8) -> dict[str, list[str]]:
    """Five sections: what is seen, what it says, what it doesn't say, what followed before, and what speaks against it."""
    pct, long = row.get("spec_pct_52w"), (row.get("spec_net_oi") or 0) > 0
    turning = row.get("momentum") in ("streak_up", "streak_down") and bool(row.get("spec_chg_4w"))
    if crowded(pct):
        says = ["Most who wanted to buy have bought: a rise needs new buyers." if long else "Most who wanted to sell have sold: a fall needs new sellers."]
        says += ["It has begun to turn, which has meant more than the level alone."] if turning else []
    else:
        says = ["The level is no extreme and says little on its own."]
    history = ["No analogs were looked for."]
    if outcome is not None:
        history = horizon_lines({horizon: outcome})
    against = [*(row.get("contradictions") or ()), "Weeks overlap within a horizon, so there are fewer independent cases than counted."]
    return {
        "Seen": facts(row),
        "Says": says,
        "Doesn't say": [*(["When it ends: extremes last for months."] if crowded(pct) else []), "When to trade: positions are a state, measured days before they are public."],
        "History": history,
        "Against": against + (["Extremes alone have been poor at timing."] if crowded(pct) else []),
    }


def market_summary(market: str, regime: str, parts: Mapping[str, Mapping[str, list[str]]]) -> str:
    """A heading over the interpretations of several groups."""
    lines = [f"{market}: {regime}."]
    for group, sections in parts.items():
        lines += ["", group, *(f"{name}: {' '.join(items)}" for name, items in sections.items() if items)]
    return "\n".join(lines)


def report(code: str, entry: Mapping, mode: str = "positions", made_up: bool = False, tests: int = 0) -> str:
    """A market's whole analysis, as ``dossier`` gives it, as Markdown."""
    row, outcomes = entry["state"], entry.get("evidence", {}).get(mode, {})
    roles = [{"group": r, "net": number(row.get(f"{r}_net")), "share": percent(row.get(f"{r}_net_oi")), "percentile": number(row.get(f"{r}_pct_52w"), 1), "deviations": number(row.get(f"{r}_z_52w"), 2), "month": signed(row.get(f"{r}_chg_4w"), 0)} for r in ("spec", "slow", "other")]
    interval = lambda o: f"{percent(o['median_lo'], 2)} to {percent(o['median_hi'], 2)}"
    validity = [f"{h} weeks: 95% interval of the median {interval(o)}; {o['effective_n']} independent cases; {CODES.get(o.get('verdict'), '')}" for h, o in sorted(outcomes.items()) if (o.get("n") or 0) >= MIN_SAMPLE and o.get("median_lo") is not None]
    sections = [
        ("Dates", [f"positions of {row.get('report_date')}", f"public on {row.get('availability_date')} ({row.get('availability_source')})"]),
        ("State", [str(row.get("regime")), *(row.get("regime_reasons") or ())]),
        ("Price", [f"close {number(row.get('price_close'), 4)}", *(f"{k} weeks: {percent(row.get(f'price_chg_{k}w'), 2)}" for k in (4, 8, 12))]),
        ("Divergences", row.get("contradictions") or ["none"]),
        ("Analogs", [f"{a['report_date']}: similarity {number(a['similarity'], 1)}, then {percent(a['fwd_return_8w'], 2)} in 8 weeks" for a in entry.get("analogs", {}).get(mode, [])] or ["none with a known outcome"]),
        ("Outcomes against the base rate", horizon_lines(outcomes)),
        ("Validity", [*validity, "weeks overlap, so p-values are too small", *([f"{tests} conditions were tried: some look good by chance"] if tests > 20 else [])]),
    ]
    sections += list(interpretation(row, outcomes.get(8)).items())
    warning = [("Made-up data", ["Every number comes from generated data."])] if made_up else []
    return markdown(code, [*warning, *sections, ("Note", ["A pattern of the past: no forecast, no signal, no cause."])], roles)


def confirmation(pct) -> tuple[list[str], list[str]]:
    """What would confirm and what would invalidate the reading."""
    if pct is None:
        return [], []
    if pct <= 20:
        return ["net turning up for two weeks"], ["a new low of net"]
    if pct >= 80:
        return ["net turning down for two weeks"], ["a new high of net"]
    return ["net leaving the middle of its range"], ["net staying in the middle of its range"]


def analysis(market: str, row: Mapping, outcomes: Mapping[int, Mapping], verdict: str | None = None) -> str:
    yes, no = confirmation(row.get("spec_pct_52w"))
    lines = [f"{market}: {row.get('regime', 'Unclassified')}.", *(f"Because {r}." for r in row.get("regime_reasons") or ()), *facts(row)]
    lines += [CODES[row["config"]]] if row.get("config") in CODES else []
    lines += horizon_lines(outcomes)
    lines += [CODES[verdict]] if verdict in CODES else []
    lines += [f"Confirms: {x}." for x in yes] + [f"Invalidates: {x}." for x in no]
    return "\n".join([*lines, "Positions are measured on Tuesday and public on Friday; history is no guarantee."])


_NUMBER = re.compile(r"\d+(?:[.,  ]\d+)*")


def numbers_of(values) -> set[str]:
    """Numbers as texts may show them: raw and as percentages, to several places."""
    found: set[str] = set()
    stack = [values]
    while stack:
        v = stack.pop()
        if isinstance(v, Mapping):
            stack += [*v.keys(), *v.values()]
        elif isinstance(v, (list, tuple, set)):
            stack += list(v)
        elif isinstance(v, str):
            found |= set(_NUMBER.findall(v))
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            for x in (abs(v), abs(v) * 100):
                found |= {f"{x:.{d}f}" for d in range(5)} | {f"{x:,.0f}".replace(",", " "), str(x)}
    return found


def assert_no_new_numbers(text: str, values) -> None:
    """ValueError if the text holds a number that isn't among the values; single digits are let through."""
    known = numbers_of(values) | {str(d) for d in range(1, 10)}
    new = [n for n in _NUMBER.findall(text) if n not in known and n.rstrip(".,") not in known]
    if new:
        raise ValueError(f"numbers that were not computed: {new}")


def polish(text: str) -> str:
    raise NotImplementedError("no language model is attached")


def markdown(title: str, sections: Iterable[tuple[str, Iterable[str]]], table: Iterable[Mapping] = ()) -> str:
    lines = [f"# {title}", ""]
    for heading, items in sections:
        lines += [f"## {heading}", "", *(f"- {i}" for i in items), ""]
    rows = list(table)
    if rows:
        heads = list(rows[0])
        lines += [f"| {' | '.join(heads)} |", f"|{'---|' * len(heads)}", *(f"| {' | '.join('' if r[h] is None else str(r[h]) for h in heads)} |" for r in rows), ""]
    return "\n".join(lines)


def html_page(title: str, text: str) -> str:
    """Headings, lists and paragraphs of a markdown text as one page; everything else is escaped."""
    body, items = [], False
    for line in text.splitlines():
        if items and not line.startswith("- "):
            body.append("</ul>")
            items = False
        if m := re.match(r"(#{1,3}) (.*)", line):
            body.append(f"<h{len(m[1])}>{html.escape(m[2])}</h{len(m[1])}>")
        elif line.startswith("- "):
            body += ([] if items else ["<ul>"]) + [f"<li>{html.escape(line[2:])}</li>"]
            items = True
        elif line.strip():
            body.append(f"<p>{html.escape(line)}</p>")
    body += ["</ul>"] if items else []
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{''.join(body)}</body></html>"


def site(title: str, payload) -> str:
    """One file with the data inside; ``</`` is escaped so that no text can end the script."""
    data = json.dumps(payload, ensure_ascii=False, default=str, allow_nan=False).replace("</", "<\\/")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><div id='app'></div><script>const DATA = {data};</script></body></html>"
