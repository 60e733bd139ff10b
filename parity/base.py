"""Composition of oracle statements: named parts become CTEs on demand."""

from __future__ import annotations

import re

from carryover.sources.fixtures import HOT_VIEWS, fixture_params, view_sql

P = fixture_params()
PARTS: dict[str, str] = dict(view_sql())


def part(name: str, text: str) -> None:
    PARTS[name] = text.strip()


def statement(text: str) -> str:
    """``text`` preceded by every part it names, directly or through a part."""
    used: list[str] = []

    def visit(sql: str) -> None:
        words = set(re.findall(r"[a-z_0-9]+", sql))
        for name, body in PARTS.items():
            if name in words and name not in used:
                used.append(name)
                visit(body)

    visit(text)
    order = [n for n in PARTS if n in used]
    if not order:
        return text.strip()
    ctes = ",\n".join(f"{n} AS (\n{PARTS[n]}\n)" for n in order)
    return f"WITH {ctes}\n{text.strip()}"


def on_hot_lines(sql: str) -> str:
    """A composed statement with both big tables replaced by those with a hot line each."""
    names = {n: f"{n}_plain" for n in HOT_VIEWS}
    plain = ",\n".join(f"{names[n]} AS (\n{PARTS[n]}\n)" for n in names)
    for n, text in HOT_VIEWS.items():
        own = f"{n} AS (\n{PARTS[n]}\n)"
        if own not in sql:
            raise ValueError(f"the statement does not read {n}")
        sql = sql.replace(own, f"{n} AS (\n{text.strip().format(**names)}\n)")
    return f"WITH {plain},\n{sql.removeprefix('WITH ')}"


def trim(value: str) -> str:
    return f"trim({value}, ' ' || chr(9) || chr(13) || chr(10))"


def norm(code: str) -> str:
    return f"upper({trim(f"replace({code}, '.', '')")})"


def share(n: str, d: str, digits: int = 4) -> str:
    s = 10**digits
    n, d = f"CAST({n} AS BIGINT)", f"CAST({d} AS BIGINT)"
    return f"CASE WHEN {d} > 0 THEN CAST((2 * {n} * {s} + {d}) // (2 * {d}) AS DOUBLE) / {float(s)} END"


def signed(n: str, d: str, digits: int = 4, per: int = 1) -> str:
    size = share(f"abs({n}) * {per}", d, digits)
    return f"CASE WHEN ({n}) < 0 THEN -({size}) ELSE {size} END"


def years(day: str, first: int, last: int | None = None) -> str:
    last = first if last is None else last
    return f"{day} >= DATE '{first}-01-01' AND {day} < DATE '{last + 1}-01-01'"


def n(text: str) -> str:
    return f"CAST({text} AS BIGINT)"
