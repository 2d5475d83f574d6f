"""Long rolling windows put together from short ones, so a row's work grows with the logarithm of the window.

A window of 2w dates is the window of the last w dates and the one w dates before: a ``lag`` in the same (ticker, date) order, so no further
exchange or sort. Any n is a sum of such lengths and a plain frame for the rest. What is joined are summaries (count, sum, sum of
squares about the mean, co-moments, extremes): nothing is ever subtracted, so no value outside a window, an infinity or a large sum, reaches
its result. Frames of at most ``PLAIN`` dates stay plain.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES = "PARTITION BY ticker ORDER BY date"
#: Dates of a window that stays a plain frame, and of the plain frames that longer ones are made of.
PLAIN, STEP = 32, 16

Window = tuple[str, tuple[str, ...], int]
#: Summaries (name: plain aggregate of {x}, {y}) and the aggregates that need them.
PARTS = {
    "cnt": "count({x})", "sum": "coalesce(sum({x}), 0.0D)", "m2": "coalesce(var_pop({x}) * count({x}), 0.0D)",
    "sumy": "coalesce(sum({y}), 0.0D)", "cxy": "coalesce(covar_pop({y}, {x}) * count({x}), 0.0D)", "max": "max({x})", "min": "min({x})",
}
NEEDS = {
    "count": ("cnt",), "sum": ("cnt", "sum"), "avg": ("cnt", "sum"), "var_samp": ("cnt", "sum", "m2"), "stddev_samp": ("cnt", "sum", "m2"), "max": ("max",), "min": ("min",),
    "covar_samp": ("cnt", "sum", "sumy", "cxy"), "regr_slope": ("cnt", "sum", "m2", "sumy", "cxy"),
}


def key(xs: tuple[str, ...]) -> str:
    return f"__d{md5('|'.join(xs).encode()).hexdigest()[:12]}"


def name(window: Window) -> str:
    agg, xs, n = window
    return f"{key(xs)}_{agg}_{n}"


def fresh(a: str, b: str, part: str) -> str:
    """Summary ``part`` of two windows side by side, of columns a_<part> and b_<part>; b may lie before the series (null)."""
    na, nb = f"{a}_cnt", f"coalesce({b}_cnt, 0)"
    if part in ("max", "min"):
        return f"{'greatest' if part == 'max' else 'least'}({a}_{part}, {b}_{part})"
    if part in ("cnt", "sum", "sumy"):
        return f"{a}_{part} + coalesce({b}_{part}, 0)"
    gap = f"({b}_sum / {nb} - {a}_sum / {na})"
    other = gap if part == "m2" else f"({b}_sumy / {nb} - {a}_sumy / {na})"
    return f"{a}_{part} + coalesce({b}_{part}, 0.0D) + CASE WHEN {na} > 0 AND {nb} > 0 THEN {gap} * {other} * ({na} * {nb} / ({na} + {nb})) ELSE 0.0D END"


def value(agg: str, at: str) -> str:
    many = f"{at}_cnt - 1"
    return {
        "count": f"{at}_cnt", "sum": f"CASE WHEN {at}_cnt > 0 THEN {at}_sum END", "avg": f"CASE WHEN {at}_cnt > 0 THEN {at}_sum / {at}_cnt END", "max": f"{at}_max", "min": f"{at}_min",
        "var_samp": f"CASE WHEN {at}_cnt > 1 THEN {at}_m2 / ({many}) END", "stddev_samp": f"CASE WHEN {at}_cnt > 1 THEN sqrt({at}_m2 / ({many})) END",
        "covar_samp": f"CASE WHEN {at}_cnt > 1 THEN {at}_cxy / ({many}) END", "regr_slope": f"CASE WHEN {at}_cnt > 1 AND {at}_m2 > 0 THEN {at}_cxy / {at}_m2 END",
    }[agg]


def pieces(n: int) -> list[tuple[int, int]]:
    """(length, dates before the last one) of windows that make up n dates: STEP times powers of two, then the rest."""
    length, before, made = STEP, 0, []
    while 2 * length <= n:
        length *= 2
    while length >= STEP:
        if before + length <= n:
            made.append((length, before))
            before += length
        length //= 2
    return made + ([(n - before, before)] if before < n else [])


def add(df: DataFrame, windows: list[Window]) -> DataFrame:
    """df with a column ``name(window)`` for each (aggregate, (x,) or (x, y), n); rows without x or without y don't count for pairs."""
    by_x: dict[tuple[str, ...], list[Window]] = {}
    for window in dict.fromkeys(windows):
        by_x.setdefault(window[1], []).append(window)
    needed = {xs: list(dict.fromkeys(p for agg, _, _ in own for p in NEEDS[agg])) for xs, own in by_x.items()}
    kept = df.columns

    held = {}
    for xs in by_x:
        x, y = xs if len(xs) == 2 else (xs[0], None)
        held[f"{key(xs)}_x"] = f"CAST({x} AS double)" if y is None else f"CASE WHEN ({y}) IS NOT NULL THEN CAST({x} AS double) END"
        if y:
            held[f"{key(xs)}_y"] = f"CASE WHEN ({x}) IS NOT NULL THEN CAST({y} AS double) END"
    df = with_columns(df, held)

    base = {}
    for xs, own in by_x.items():
        k = key(xs)
        rests = {length for agg, _, n in own if agg not in ("max", "min") for length, _ in pieces(n) if length < STEP}
        for length in {STEP} | rests:
            over = f"OVER ({SERIES} ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
            for part in needed[xs]:
                if length == STEP or part not in ("max", "min"):
                    base[f"{k}_{length}_{part}"] = PARTS[part].replace("{x})", f"{k}_x) {over}").replace("{y})", f"{k}_y) {over}").replace("{y},", f"{k}_y,")
    df = with_columns(df, base)

    longest = {xs: max(n for _, _, n in own) for xs, own in by_x.items()}
    length = STEP
    while any(2 * length <= n for n in longest.values()):
        now = [xs for xs, n in longest.items() if 2 * length <= n]
        lags = {f"{key(xs)}_b_{p}": f"lag({key(xs)}_{length}_{p}, {length}) OVER ({SERIES})" for xs in now for p in needed[xs]}
        df = with_columns(with_columns(df, lags), {f"{key(xs)}_{2 * length}_{p}": fresh(f"{key(xs)}_{length}", f"{key(xs)}_b", p) for xs in now for p in needed[xs]}).drop(*lags)
        length *= 2

    lags, made = {}, {}
    for xs, own in by_x.items():
        for agg, _, n in own:
            if agg in ("max", "min"):  # two windows that may overlap
                wide = pieces(n)[0][0]
                lags[f"{key(xs)}_{wide}at{n - wide}_{agg}"] = f"lag({key(xs)}_{wide}_{agg}, {n - wide}) OVER ({SERIES})"
                made[name((agg, xs, n))] = fresh(f"{key(xs)}_{wide}", f"{key(xs)}_{wide}at{n - wide}", agg)
            else:
                lags |= {f"{key(xs)}_{w}at{b}_{p}": f"lag({key(xs)}_{w}_{p}, {b}) OVER ({SERIES})" for w, b in pieces(n)[1:] for p in NEEDS[agg]}
    df = with_columns(df, lags)
    sums = {(xs, n): list(dict.fromkeys(p for agg, _, m in own if m == n and agg not in ("max", "min") for p in NEEDS[agg])) for xs, own in by_x.items() for _, _, n in own}
    at = {(xs, n): f"{key(xs)}_{pieces(n)[0][0]}" for xs, n in sums}
    for turn in range(1, max(len(pieces(n)) for _, n in sums)):
        joined = {}
        for (xs, n), parts in sums.items():
            if parts and turn < len(pieces(n)):
                w, b = pieces(n)[turn]
                joined |= {f"{key(xs)}_n{n}t{turn}_{p}": fresh(at[xs, n], f"{key(xs)}_{w}at{b}", p) for p in parts}
                at[xs, n] = f"{key(xs)}_n{n}t{turn}"
        df = with_columns(df, joined)
    made |= {name((agg, xs, n)): value(agg, at[xs, n]) for xs, own in by_x.items() for agg, _, n in own if agg not in ("max", "min")}
    return df.select(*kept, *[F.expr(sql).alias(c) for c, sql in made.items()])


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.expr(sql).alias(c) for c, sql in columns.items()]) if columns else df
