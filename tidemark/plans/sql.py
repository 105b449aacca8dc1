"""Pieces of the DuckDB SQL that the catalogue's queries are checked against."""

from __future__ import annotations

DIGITS = 6


def ticks(key: str = "event_type") -> str:
    return f"SELECT CAST({key} AS VARCHAR) AS ticker, ts, event_id, value AS price FROM events"


def bars(label: str, key: str = "event_type") -> str:
    """Bars of events; `label` gives the bar of a ts."""
    return f"""SELECT ticker, {label} AS ts, first(price ORDER BY t, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY t, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM (SELECT ticker, ts AS t, event_id, price FROM ({ticks(key)})) GROUP BY ALL"""


HOUR = "date_trunc('hour', t)"
FOUR = "date_trunc('day', t) + INTERVAL 4 HOUR * (hour(t) // 4)"
DAY = "date_trunc('day', t)"
WEEK = "date_trunc('week', t) + INTERVAL 6 DAY"
BARS_1H, BARS_4H, BARS_1D, BARS_1W = (bars(x) for x in (HOUR, FOUR, DAY, WEEK))


def w(n: int, ahead: int = 0, by: str = "ticker") -> str:
    edge = lambda k: "CURRENT ROW" if k == 0 else f"{k} FOLLOWING" if k > 0 else f"{-k} PRECEDING"
    return f"(PARTITION BY {by} ORDER BY ts ROWS BETWEEN {edge(ahead - n + 1)} AND {edge(ahead)})"


CUM = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WO = "(PARTITION BY ticker ORDER BY ts)"


def full(agg: str, x: str, n: int, least: int | None = None, ahead: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {w(n, ahead)} >= {n if least is None else least} THEN {agg}({x}) OVER {w(n, ahead)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {WO}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER {WO}"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def weighted(x: str, n: int, newest: bool = True) -> str:
    """A linearly weighted mean by lags."""
    total = n * (n + 1) / 2
    parts = [f"{(n - k) if newest else k + 1} * lag({x}, {k}) OVER {WO}" for k in range(n)]
    return f"({' + '.join(parts)}) / {total}"


def stages(base: str, *levels: dict[str, str], out: dict[str, str], where: str = "", keys: str = "ticker, ts", digits: int | None = DIGITS) -> str:
    """Columns added level by level over `base`, and the rounded outputs."""
    text, at = [f"s0 AS ({base})"], 0
    for level in levels:
        text.append(f"s{at + 1} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in level.items())} FROM s{at})")
        at += 1
    shown = ", ".join(f"round({v}, {digits}) AS {k}" if digits is not None else f"{v} AS {k}" for k, v in out.items())
    return f"WITH {', '.join(text)} SELECT {keys}, {shown} FROM s{at} {where}"


TR = {"pc": lag("close")}
TR2 = {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))"}


def recursion(base: str, first: dict[str, str], step: dict[str, str], out: dict[str, str], before: list[dict[str, str]] | None = None, where: str = "", digits: int | None = DIGITS, keys: str = "ticker, ts", extra: str = "") -> str:
    """A state per row from that of the row before (r) and the row itself (b); rows are counted from 1 per ticker."""
    text, at = [f"s0 AS ({base})"], 0
    for level in before or []:
        text.append(f"s{at + 1} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in level.items())} FROM s{at})")
        at += 1
    text.append(f"b AS (SELECT *, row_number() OVER {WO} AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM s{at})")
    a = ", ".join(f"{v} AS {k}" for k, v in first.items())
    z = ", ".join(f"{v} AS {k}" for k, v in step.items())
    text.append(f"r AS (SELECT b.*, {a} FROM b WHERE rn = 1 UNION ALL SELECT b.*, {z} FROM r JOIN b ON b.ticker = r.ticker AND b.rn = r.rn + 1)")
    shown = ", ".join(f"round({v}, {digits}) AS {k}" if digits is not None else f"{v} AS {k}" for k, v in out.items())
    return f"WITH RECURSIVE {', '.join(text)}{extra} SELECT {keys}, {shown} FROM r {where}"


def ema_step(x: str, y: str, rate: str) -> str:
    """The next value of an exponential mean y of b.x; y starts with x."""
    return f"CASE WHEN {x} IS NULL THEN r.{y} WHEN r.{y} IS NULL THEN {x} ELSE {rate} * {x} + (1 - {rate}) * r.{y} END"
