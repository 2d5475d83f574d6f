"""Window kernels as SQL expressions over a dense (date, ticker) panel.

Feature families are layers of such expressions: each layer may use the columns of the ones before, so a window result is
computed once and named. All time-series kernels share one window specification, hence one shuffle and one sort by
(ticker, date) for a whole family, and are computed by ``functions.series``; cross-section kernels partition by date.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions import series
from factorlake.functions.series import SERIES, Op

CROSS = "PARTITION BY date"
EPS = "1e-8"
YEAR = "sqrt(252.0D)"

_names = {"dialect": "spark"}


@contextmanager
def dialect(name: str) -> Iterator[None]:
    """Write expressions for another engine meanwhile: the checks run the same definitions in DuckDB."""
    before, _names["dialect"] = _names["dialect"], name
    try:
        yield
    finally:
        _names["dialect"] = before


def spark() -> bool:
    return _names["dialect"] == "spark"


#: Series windows by the name of the column that ``apply_layers`` computes for them, and by their text where they are plain SQL too.
_series: dict[str, Op] = {}
#: Plain aggregates of a cross-section by their text.
_cross: dict[str, tuple[str, str, str]] = {}


def over(kind: str, *xs: str, numbers: tuple = ()) -> str:
    """The name of a series window, computed once however often a layer uses it."""
    op = (kind, xs, numbers)
    name = f"__s{md5(repr(op).encode()).hexdigest()[:16]}"
    _series[name] = op
    return name


def known(sql: str, kind: str, *xs: str, numbers: tuple = ()) -> str:
    """A series window as SQL, for which a family's layers take the computed column."""
    if spark():
        _series[sql] = (kind, xs, numbers)
    return sql


def lag(x: str, n: int = 1) -> str:
    return known(f"lag({x}, {n}) OVER ({SERIES})", "lag", x, numbers=(n,))


def lead(x: str, n: int = 1) -> str:
    return known(f"lead({x}, {n}) OVER ({SERIES})", "lag", x, numbers=(-n,))


def diff(x: str, n: int = 1) -> str:
    return f"({x} - {lag(x, n)})"


def change(x: str, n: int = 1) -> str:
    """x / lag(x) - 1, null where the lag is null or zero."""
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def frame(n: int) -> str:
    return f"OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def window(agg: str, x: str, n: int, y: str | None = None) -> str:
    """An aggregate of x, or of (y, x), over n dates."""
    if spark() and agg != "count":
        return over(agg, *([x] if y is None else [y, x]), numbers=(n, 0))
    of = x if y is None else f"CASE WHEN {y} IS NOT NULL THEN {x} END" if agg == "count" else f"{y}, {x}"
    return f"{agg}({of}) {frame(n)}"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """Rolling aggregate over n dates, null with fewer than ``least`` values (n // 2 if not given).

    Nothing outside the window, an infinity or a large sum, reaches its result.
    """
    least = n // 2 if least is None else least
    if spark():
        return over(agg, x, numbers=(n, least))
    return f"CASE WHEN {window('count', x, n)} >= {least} THEN {window(agg, x, n)} END"


def roll_quantile(x: str, p: float, n: int, least: int) -> str:
    """Rolling quantile with linear interpolation: a place in the window's sorted list, which quantiles of one window share. Between equal values it is that value, not a rounded sum."""
    if spark():
        return over("quantile", x, numbers=(p, n, least))
    return f"CASE WHEN count({x}) {frame(n)} >= {least} THEN percentile({x}, {p}D) {frame(n)} END"


def roll_pair(agg: str, y: str, x: str, n: int, least: int) -> str:
    """Rolling aggregate of two columns (covar_samp, regr_slope) over the rows that have both."""
    if spark():
        return over(agg, y, x, numbers=(n, least))
    return f"CASE WHEN {window('count', x, n, y)} >= {least} THEN {window(agg, x, n, y)} END"


def roll_corr(y: str, x: str, n: int, least: int) -> str:
    """Rolling correlation; null if either side doesn't vary."""
    if spark():
        return over("corr", y, x, numbers=(n, least))
    a, b = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)", f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    spread = f"{window('stddev_samp', a, n)} * {window('stddev_samp', b, n)}"
    return f"CASE WHEN {window('count', b, n)} >= {least} THEN {window('covar_samp', x, n, y)} / nullif({spread}, 0) END"


def skew(x: str, n: int, least: int) -> str:
    """Bias-corrected sample skewness; needs three values."""
    if spark():
        return over("skew", x, numbers=(n, least))
    return f"CASE WHEN (count({x}) {frame(n)}) >= {max(least, 3)} THEN skewness({x}) {frame(n)} END"


def kurt(x: str, n: int, least: int) -> str:
    """Bias-corrected sample excess kurtosis; needs four values."""
    if spark():
        return over("kurt", x, numbers=(n, least))
    return f"CASE WHEN (count({x}) {frame(n)}) >= {max(least, 4)} THEN kurtosis({x}) {frame(n)} END"


def position() -> str:
    return known(f"row_number() OVER ({SERIES})", "position")


def running(agg: str, x: str) -> str:
    return known(f"{agg}({x}) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"running_{agg}", x)


def fill_forward(x: str, limit: int | None = None) -> str:
    start = "UNBOUNDED" if limit is None else str(limit)
    if not spark():
        return f"last_value({x} IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"
    return known(f"last_value({x}) IGNORE NULLS OVER ({SERIES} ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)", "fill_forward", x, numbers=(limit,))


def mean_deviation(x: str, mean: str, n: int, least: int) -> tuple[str, str]:
    """(layer expression of the window, expression of a later layer: mean absolute deviation from ``mean``); in SQL joined by the name ``<x>_list<n>``."""
    if spark():
        return roll("sum", x, n, least), over("mean_deviation", x, mean, numbers=(n, least))
    return f"CASE WHEN count({x}) {frame(n)} >= {least} THEN list({x}) {frame(n)} END", f"list_avg([abs(v - {mean}) FOR v IN {x}_list{n} IF v IS NOT NULL])"


def first_high(x: str, idx: str, n: int) -> str:
    """idx of the first largest x of a full window."""
    if spark():
        return over("first_high", x, idx, numbers=(n,))
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN arg_max({idx}, {x}) {frame(n)} END"


def weekday_is(number: int) -> str:
    """0: Monday."""
    return flag(f"weekday(date) = {number}") if spark() else flag(f"isodow(date) = {number + 1}")


def cross(agg: str, x: str, by: str = "date") -> str:
    text = f"{agg}({x}) OVER (PARTITION BY {by})"
    _cross[text] = (agg, x, by)
    return text


def cross_quantile(x: str, p: float) -> str:
    return f"percentile({x}, {p}D) OVER ({CROSS})"


def cross_z(x: str) -> str:
    return f"({x} - {cross('avg', x)}) / nullif({cross('stddev_samp', x)}, 0)"


def percent_rank(x: str, part: str = CROSS) -> str:
    """Average-tie rank over the number of values; null for null."""
    peers = f"count({x}) OVER ({part} ORDER BY {x} NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x} NULLS LAST) + ({peers} - 1) / 2.0D) / count({x}) OVER ({part}) END"


def own_rank(x: str) -> str:
    """Percent rank in the ticker's whole history."""
    return known(percent_rank(x, "PARTITION BY ticker"), "own_rank", x)


def flag(condition: str) -> str:
    """1 if the condition holds, else 0; an unknown condition doesn't hold."""
    return f"CASE WHEN {condition} THEN 1.0D ELSE 0.0D END"


def low_clip(x: str, low: str = "0.0D") -> str:
    """max(x, low) that stays null for null."""
    return f"CASE WHEN {x} < {low} THEN {low} ELSE {x} END"


def high_clip(x: str, high: str = "0.0D") -> str:
    return f"CASE WHEN {x} > {high} THEN {high} ELSE {x} END"


def apply_layers(df: DataFrame, layers: list[dict[str, str]], wanted: list[str] | None = None) -> DataFrame:
    """df with the columns of all layers, or ``wanted`` alone.

    The series windows of a layer are one pass of ``functions.series`` (a single layer of plain SQL windows stays SQL). Aggregates of a cross-section that
    series follow are joined to the rows by broadcast, a row a date, so the rows stay in their order by ticker; other cross-section windows come last.
    """
    texts = sorted((text for text in _series if " " in text), key=len, reverse=True)
    wants = [words(layer) for layer in layers]
    series_at = [i for i, want in enumerate(wants) if any(w.startswith("__s") for w in want)]
    if not series_at and series.POSITION not in (wanted or ()):
        return plain(df, layers, wanted)
    ops, columns = [], df.columns
    layers = [dict(layer) for layer in layers]
    for layer in layers:
        for name, sql in layer.items():
            for text in texts:
                if text in sql:
                    kind, xs, numbers = _series[text]
                    sql = sql.replace(text, over(kind, *xs, numbers=numbers))
            layer[name] = sql
        ops.append({w: _series[w] for w in words(layer) if w.startswith("__s")})
    last = max(i for i, own in enumerate(ops) if own)
    ordered = series.POSITION in columns  # df comes from a pass
    columns = [c for c in columns if c != series.POSITION]
    for i, (layer, own) in enumerate(zip(layers, ops)):
        later = set().union(*(words(l) for l in layers[i + 1 :]), *(words(dict(enumerate(xs))) for o in ops[i + 1 :] for _, xs, _ in o.values()), set(wanted if wanted is not None else columns))
        if i < last:
            df, layer = with_cross(df, layer)
        own = {name: op for name, op in own.items() if name not in df.columns}  # an earlier layer may have it
        if own:
            here = later | words(layer)
            df = series.add(df, own, tuple(c for c in df.columns if wanted is not None and c not in here and c not in ("date", "ticker", series.POSITION)), ordered)
            ordered = True
        df = df.select("*", *[F.expr(sql).alias(name) for name, sql in layer.items()])
        kept = [c for c in df.columns if c in ("date", "ticker") or c in later or (wanted is None and not c.startswith("__")) or (c == series.POSITION and i < last)]
        df = df.select(*kept)
        if i < last and any("PARTITION BY date" in sql for sql in layer.values()):
            df, ordered = df.drop(series.POSITION), False  # a cross-section amid series: rows are dealt by ticker again
    return df.select(*(wanted if wanted is not None else [*columns, *[c for layer in layers for c in layer]]))


def split_layers(layers: list[dict[str, str]]) -> tuple[list[dict[str, str]], list[dict[str, str]]]:
    """(layers up to the last one with series windows, the others); the first are empty where that one has windows by date too."""
    series_at = [i for i, layer in enumerate(layers) if any(w.startswith("__s") for w in words(layer)) or any(f"({SERIES}" in sql or "PARTITION BY ticker" in sql for sql in layer.values())]
    if not series_at or any("PARTITION BY date" in sql for layer in layers[1 : series_at[-1] + 1] for sql in layer.values()):
        return [], layers
    return layers[: series_at[-1] + 1], layers[series_at[-1] + 1 :]


def pruned(layers: list[dict[str, str]], wanted: list[str]) -> list[dict[str, str]]:
    """The layers with only the columns that ``wanted`` need."""
    need, kept = set(wanted), []
    for layer in reversed(layers):
        own = {name: sql for name, sql in layer.items() if name in need}
        need |= (found := words(own) | {w for text, (_, xs, _) in _series.items() if " " in text and any(text in sql for sql in own.values()) for w in words(dict(enumerate(xs)))})
        while found := {w for token in found if token in _series for w in words(dict(enumerate(_series[token][1])))} - need:
            need |= found
        kept.insert(0, own)
    return [layer for layer in kept if layer]


def merged(stacks: list[list[dict[str, str]]]) -> list[dict[str, str]]:
    """The layers of several families by depth; a name that two of them define alike is made once, at the lesser depth."""
    defined: dict[str, tuple[str, int]] = {}
    for layers in stacks:
        for depth, layer in enumerate(layers):
            for name, sql in layer.items():
                before = defined.get(name, (sql, depth))
                if before[0] != sql:
                    raise ValueError(f"{name} is defined in two ways")
                defined[name] = sql, min(before[1], depth)
    made = [{name: sql for name, (sql, at) in defined.items() if at == depth} for depth in range(max(map(len, stacks), default=0))]
    return [layer for layer in made if layer]


def plain(df: DataFrame, layers: list[dict[str, str]], wanted: list[str] | None = None) -> DataFrame:
    for layer in layers:
        df = df.select("*", *[F.expr(sql).alias(name) for name, sql in layer.items()])
    return df if wanted is None else df.select(*wanted)


def words(layer: dict) -> set[str]:
    return set(re.findall(r"\w+", " ".join(layer.values())))


def with_cross(df: DataFrame, layer: dict[str, str], source: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """df with the aggregates by cross-section that the layer names, and the layer that takes them; unchanged if it has other cross-section windows. source: the same rows with what they aggregate, if that is cheaper than df."""
    found = [text for text in _cross if any(text in sql for sql in layer.values())]
    bare = {}
    for name, sql in layer.items():
        for text in found:
            sql = sql.replace(text, f"__c{md5(text.encode()).hexdigest()[:16]}")
        bare[name] = sql
    if not found or any("PARTITION BY date" in sql for sql in bare.values()):
        return df, layer
    for by in dict.fromkeys(_cross[text][2] for text in found):
        keys = by.split(", ")
        sums = [F.expr(f"{_cross[t][0]}({_cross[t][1]})").alias(f"__c{md5(t.encode()).hexdigest()[:16]}") for t in found if _cross[t][2] == by]
        made = (df if source is None else source).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(*sums)
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        df = df.join(F.broadcast(made), same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    return df, bare


def to_duckdb(sql: str) -> str:
    """Literals and function names that differ; what differs in more is written for the dialect from the start."""
    return re.sub(r"\bpercentile\(", "quantile_cont(", re.sub(r"(\d)D\b", r"\1", sql))


def layers_sql(source: str, layers: list[dict[str, str]]) -> str:
    """The layers as nested DuckDB queries over ``source``; build them under ``dialect("duckdb")``."""
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{to_duckdb(sql)} AS {name}' for name, sql in layer.items())} FROM {source})"
    return source
