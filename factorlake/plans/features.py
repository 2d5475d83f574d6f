"""The feature families as layers of window expressions on a dense panel (see functions.kernels).

A panel has one row for each date of the universe and ticker; prices are null where a ticker did not trade. Series windows
count universe dates. Exponential means come as columns from ``operators.panel.with_emas``. Each family is (layers, names of its features).
"""

from __future__ import annotations

from factorlake.functions.kernels import (
    EPS, YEAR, change, cross, cross_quantile, cross_z, diff, fill_forward, first_high, flag, high_clip, kurt, lag, low_clip, mean_deviation, own_rank, percent_rank, position, roll, roll_corr, roll_pair, roll_quantile, running, skew, weekday_is, window,
)

Layers = list[dict[str, str]]
#: (name, span, source) of the exponential means that momentum needs; sources may be means' differences.
EMA_SPANS = (5, 8, 10, 12, 13, 19, 20, 21, 26, 39, 50, 55, 100, 200)
MACD = {"macd": (12, 26, 9), "macd_fast": (5, 13, 4), "macd_slow": (19, 39, 9)}
C, R, V = "adj_close", "returns", "volume"


def momentum() -> tuple[Layers, list[str]]:
    rets = {f"ret{n}": change(C, n) for n in (5, 10, 20, 21, 40, 60, 63, 120, 126, 252)}
    base = rets | {f"peak{n}": roll("max", C, n) for n in (20, 60, 252)} | {f"sma{n}": roll("avg", C, n, n) for n in (10, 20, 50, 200)}
    base |= {"high63": roll("max", C, 252, 63), "low63": roll("min", C, 252, 63), "up": flag(f"{R} > 0")}
    base |= {f"{m}_above": flag(f"{m}_line > {m}_signal") for m in ("macd", "macd_fast")}
    second = {f"mom_consist_{n}": roll("avg", "up", n) for n in (20, 60, 252)}
    second |= {"macd_cross": f"macd_above - coalesce({lag('macd_above')}, 0)", "macd_fast_cross": f"macd_fast_above - coalesce({lag('macd_fast_above')}, 0)"}
    second |= {"mom_20d_ts_rank": own_rank("ret20"), "mom_60d_ts_rank": own_rank("ret60")}
    out = {f"mom_{n}d": f"ret{n}" for n in (5, 10, 20, 60, 120, 252)}
    out |= {"mom_12_1": "ret252 - ret21", "mom_6_1": "ret126 - ret21", "mom_3_1": "ret63 - ret21"}
    out |= {"macd_hist": "macd_line - macd_signal", "macd_ratio": f"macd_line / (abs({C}) + {EPS})", "macd_fast_hist": "macd_fast_line - macd_fast_signal", "macd_slow_hist": "macd_slow_line - macd_slow_signal"}
    out |= {f"mom_accel_{a}_{b}": f"ret{a} - ret{b}" for a, b in ((20, 40), (60, 120), (5, 20), (20, 60))}
    out |= {"residual_mom": "ret252 - ret21", "residual_mom_6_1": "ret126 - ret21"}
    out |= {f"roc_{n}d": change(C, n) for n in (3, 7, 14, 21, 42)}
    out |= {"dist_52w_high": f"{C} / (high63 + {EPS}) - 1", "dist_52w_low": f"{C} / (low63 + {EPS}) - 1"}
    out |= {f"drawdown_{n}d": f"({C} - peak{n}) / (peak{n} + {EPS})" for n in (20, 60, 252)}
    out |= {"reversal_1w": "-ret5", "reversal_2w": "-ret10", "reversal_1m": "-ret21"}
    out |= {f"price_ema_ratio_{n}": f"{C} / (ema{n} + {EPS}) - 1" for n in (10, 20, 50, 100, 200)}
    out |= {f"sma_cross_{a}_{b}": f"sma{a} / (sma{b} + {EPS}) - 1" for a, b in ((10, 20), (20, 50), (50, 200), (10, 50))}
    out |= {"tema_cross_8_21": f"ema8 / (ema21 + {EPS}) - 1", "tema_cross_21_55": f"ema21 / (ema55 + {EPS}) - 1", "tema_alignment": f"({flag('ema8 > ema21')} + {flag('ema21 > ema55')}) / 2"}
    across = {f"rel_strength_{n}d": f"ret{n} - {cross('avg', f'ret{n}')}" for n in (20, 60, 252)} | {f"mom_zscore_{n}d": cross_z(f"ret{n}") for n in (20, 60, 252)}
    across |= {"mom_spread_12m": f"ret252 - {cross('avg', 'ret252')}", "mom_spread_1m": f"ret21 - {cross('avg', 'ret21')}"}
    return [base, second, out, across], [*second, *out, *across]


def volatility(ranged: bool = True) -> tuple[Layers, list[str]]:
    """ranged: the panel has high and low."""
    first = {"mkt": cross("avg", R)}
    base = {f"sd{n}": roll("stddev_samp", R, n) for n in (5, 10, 20, 60, 120, 252)} | {"sd21": roll("stddev_samp", R, 21, 10)}
    base |= {"down": high_clip(R), "wealth": f"exp({running('sum', f'ln(1 + coalesce({R}, 0))')})"}
    base |= {f"mvar{n}": roll("var_samp", "mkt", n) for n in (60, 120, 252)} | {f"cov{n}": roll_pair("covar_samp", R, "mkt", n, n // 2) for n in (60, 120, 252)}
    base |= {f"var_5pct_{n}d": roll_quantile(R, 0.05, n, n // 2) for n in (20, 252)}
    base |= {f"skew_{n}d": skew(R, n, n // 2) for n in (20, 60)} | {f"kurt_{n}d": kurt(R, n, n // 2) for n in (20, 60)}
    high, low = f"abs(high - {lag(C)})", f"abs(low - {lag(C)})"
    base |= {"tr": f"CASE WHEN high IS NOT NULL AND low IS NOT NULL AND {lag(C)} IS NOT NULL THEN greatest(high - low, {high}, {low}) END"} if ranged else {"tr": f"abs({change(C)})"}
    if ranged:
        base["hl2"] = f"power(ln(high / (low + {EPS})), 2)"
    second = {f"vol_{n}d": f"sd{n} * {YEAR}" for n in (5, 10, 20, 60, 120, 252)}
    second |= {f"vol_of_vol_{n}d": f"{roll('stddev_samp', 'sd21', n)} * {YEAR}" for n in (20, 60, 120)}
    second |= {f"atr_{n}d": f"{roll('avg', 'tr', n)}" + (f" / ({C} + {EPS})" if ranged else "") for n in (7, 14, 21)}
    second |= {f"dsd{n}": roll("stddev_samp", "down", n) for n in (20, 60, 252)}
    second |= {f"beta_{n}d": f"cov{n} / (mvar{n} + 1e-10)" for n in (60, 120, 252)}
    second |= {f"dd{n}": f"(wealth - {window('max', 'wealth', n)}) / ({window('max', 'wealth', n)} + {EPS})" for n in (20, 60, 252)}
    if ranged:
        second |= {f"parkinson_vol_{n}d": f"sqrt({roll('avg', 'hl2', n)} / (4 * ln(2.0D))) * {YEAR}" for n in (20, 60)}
    third = {f"downside_dev_{n}d": f"dsd{n} * {YEAR}" for n in (20, 60, 252)} | {f"downside_ratio_{n}d": f"dsd{n} / (sd{n} + {EPS})" for n in (20, 60, 252)}
    inner = {n: f"vol_{n}d * vol_{n}d - power(beta_{n}d * sqrt(mvar{n}) * {YEAR}, 2)" for n in (60, 252)}
    third |= {f"idio_vol_{n}d": f"sqrt({low_clip(inner[n])})" for n in (60, 252)}
    third |= {"med252": roll_quantile("vol_20d", 0.5, 252, 126)}
    third |= {f"vol_ratio_{a}_{b}": f"vol_{a}d / (vol_{b}d + {EPS})" for a, b in ((5, 20), (20, 60), (60, 252))} | {f"max_dd_{n}d": window("min", f"dd{n}", n) for n in (20, 60, 252)}
    fourth = {"high_vol_flag": flag("vol_20d > med252"), "low_vol_flag": flag("vol_20d < med252"), "vol_rank_20d": percent_rank("vol_20d"), "vol_rank_60d": percent_rank("vol_60d")}
    layers = [first, base, second, third, fourth]
    hidden = {"mkt", "down", "wealth", "tr", "hl2", "med252", "sd21"}
    return layers, [c for layer in layers for c in layer if c not in hidden and not c.startswith(("sd", "mvar", "cov", "dsd", "dd"))]


def volume(ranged: bool = True) -> tuple[Layers, list[str]]:
    base = {"pv": f"{C} * {V}", "signed": f"(CASE WHEN {R} > 0 THEN 1 WHEN {R} < 0 THEN -1 ELSE 0 END) * {V}", "rv": f"{R} * {V}", "absret": f"abs({R})", "dvol": change(V)}
    base |= {"spread_proxy_1d": f"(high - low) / ({C} + {EPS})" if ranged else f"abs({R})", "vmax": f"nullif({roll('max', V, 252, 63)}, 0)"}
    second = {"obv": f"CASE WHEN signed IS NOT NULL THEN {running('sum', 'signed')} END", "vpt": f"CASE WHEN rv IS NOT NULL THEN {running('sum', 'rv')} END", "illiq": "absret / nullif(pv, 0)", "turnover_norm": f"{V} / vmax"}
    second |= {f"vwap_dev_{n}d": f"{C} / (({roll('sum', 'pv', n)}) / (({roll('sum', V, n)}) + {EPS}) + {EPS}) - 1" for n in (5, 20, 60)}
    second |= {f"abnorm_vol_{n}d": f"{V} / (({roll('avg', V, n)}) + {EPS})" for n in (5, 20, 60)} | {f"dollar_vol_{n}d": f"ln(1 + ({roll('avg', 'pv', n)}))" for n in (20, 60, 252)}
    second |= {f"vol_ratio_{n}d": f"({roll('avg', V, n, n)}) / (({roll('avg', V, 3 * n, n)}) + {EPS})" for n in (5, 10, 20)}
    second |= {f"spread_proxy_{n}d": roll("avg", "spread_proxy_1d", n) for n in (20, 60)}
    second |= {f"kyle_lambda_{n}d": f"({roll('avg', 'absret', n)}) / (({roll('avg', V, n)}) + {EPS}) * 1e6" for n in (20, 60, 252)}
    second |= {"v20": roll("avg", V, 20), "v252": roll("avg", V, 252), "v60": roll("avg", V, 60), "vol_accel_5_20": f"({roll('avg', V, 5, 3)}) / (({roll('avg', V, 20)}) + {EPS}) - 1", "price_vol_corr_60d": roll_corr(R, "dvol", 60, 30)}
    third = {f"obv_mom_{n}d": f"obv / nullif({lag('obv', n)} + {EPS}, 0) - 1" for n in (10, 20, 60)} | {f"vpt_mom_{n}d": f"vpt / nullif({lag('vpt', n)} + {EPS}, 0) - 1" for n in (20, 60)}
    third |= {f"amihud_{n}d": f"({roll('avg', 'illiq', n)}) * 1e6" for n in (20, 60, 252)} | {"turnover_ma_20d": roll("avg", "turnover_norm", 20), "tq": roll_quantile("turnover_norm", 0.8, 252, 63), "vol_trend_60d": change("v60", 20)}
    fourth = {"high_turnover": flag("turnover_norm > tq"), "vol_rank_20d": percent_rank("v20"), "vol_rank_252d": percent_rank("v252")}
    layers = [base, second, third, fourth]
    hidden = {"pv", "signed", "rv", "absret", "dvol", "vmax", "obv", "vpt", "illiq", "v20", "v252", "v60", "tq"}
    return layers, [c for layer in layers for c in layer if c not in hidden]


def technical() -> tuple[Layers, list[str]]:
    """The panel has high and low (``operators.panel.ranged`` puts the close where they are absent)."""
    base = {"delta": diff(C), "tp": f"(high + low + {C}) / 3", "hm": diff("high"), "lm": f"-{diff('low')}"}
    prev = lag(C)
    base |= {"trange": f"CASE WHEN high IS NOT NULL AND low IS NOT NULL AND {prev} IS NOT NULL THEN greatest(high - low, abs(high - {prev}), abs(low - {prev})) END"}
    base |= {f"m{n}": roll("avg", C, n) for n in (10, 20, 50)} | {f"s{n}": roll("stddev_samp", C, n) for n in (10, 20, 50)}
    base |= {f"hh{n}": roll("max", "high", n, m) for n, m in ((9, 5), (14, 7), (21, 10), (26, 13), (28, 14), (52, 26))} | {f"ll{n}": roll("min", "low", n, m) for n, m in ((9, 5), (14, 7), (21, 10), (26, 13), (28, 14), (52, 26))}
    base |= {"clv": f"(({C} - low) - (high - {C})) / ((high - low) + {EPS})", "idx": position(), "ret14": change(C, 14)}
    base |= {f"roc_osc_{n}": f"100 * ({C} - {lag(C, n)}) / ({lag(C, n)} + {EPS})" for n in (9, 14, 25, 50)}
    second = {"gain": low_clip("delta"), "loss": f"-({high_clip('delta')})", "pdm": f"CASE WHEN hm > lm AND hm > 0 THEN hm ELSE 0.0D END", "mdm": "CASE WHEN lm > hm AND lm > 0 THEN lm ELSE 0.0D END"}
    second |= {f"bb_pos_{n}": f"({C} - (m{n} - 2 * s{n})) / (4 * s{n} + {EPS})" for n in (10, 20, 50)} | {f"bb_width_{n}": f"4 * s{n} / (m{n} + {EPS})" for n in (10, 20, 50)}
    second |= {f"stoch_k_{n}": f"100 * ({C} - ll{n}) / (hh{n} - ll{n} + {EPS})" for n in (14, 21)} | {f"williams_r_{n}": f"-100 * (hh{n} - {C}) / (hh{n} - ll{n} + {EPS})" for n in (14, 28)}
    second |= {f"tp_list{n}": mean_deviation("tp", f"tpm{n}", n, n // 2)[0] for n in (14, 20)} | {f"tpm{n}": roll("avg", "tp", n) for n in (14, 20)}
    second |= {f"atr{n}": roll("avg", "trange", n) for n in (14, 21)} | {"tenkan": "(hh9 + ll9) / 2", "kijun": "(hh26 + ll26) / 2", "senkou_b": "(hh52 + ll52) / 2"}
    second |= {f"trend_slope_{n}": f"({roll_pair('regr_slope', C, 'idx', n, n)}) / ({C} + {EPS})" for n in (20, 60, 120)} | {f"money_flow_{n}": roll("avg", "clv", n) for n in (20, 60)}
    second |= {f"aroon_up_{n}": f"100.0D * ({n} - (idx - ({first_high('high', 'idx', n)}))) / {n}" for n in (14, 25)}
    third = {f"rs{n}": f"({roll('avg', 'gain', n)}) / (({roll('avg', 'loss', n)}) + {EPS})" for n in (7, 14, 21, 28)}
    third |= {f"stoch_d_{n}": roll("avg", f"stoch_k_{n}", 3, 2) for n in (14, 21)}
    third |= {f"cci_{n}": f"(tp - tpm{n}) / (0.015 * ({mean_deviation('tp', f'tpm{n}', n, n // 2)[1]}) + {EPS})" for n in (14, 20)}
    third |= {f"pdi{n}": f"100 * ({roll('avg', 'pdm', n)}) / (atr{n} + {EPS})" for n in (14, 21)} | {f"mdi{n}": f"100 * ({roll('avg', 'mdm', n)}) / (atr{n} + {EPS})" for n in (14, 21)}
    third |= {"ichimoku_conv_base_diff": f"(tenkan - kijun) / ({C} + {EPS})", "ichimoku_price_vs_base": f"({C} - kijun) / ({C} + {EPS})", "senkou_a": "(tenkan + kijun) / 2", "bq": roll_quantile("bb_width_20", 0.2, 60, 30)}
    third |= {"bb_breakout_20": flag("bb_pos_20 > 1.0 OR bb_pos_20 < 0.0")}
    fourth = {f"rsi_{n}": f"100 - 100 / (1 + rs{n})" for n in (7, 14, 21, 28)} | {f"dx{n}": f"100 * abs(pdi{n} - mdi{n}) / (pdi{n} + mdi{n} + {EPS})" for n in (14, 21)}
    fourth |= {"di_diff_14": "pdi14 - mdi14", "ichimoku_cloud_thickness": f"abs(senkou_a - senkou_b) / ({C} + {EPS})", "ichimoku_price_above_cloud": flag(f"{C} > senkou_a AND {C} > senkou_b"), "bb_squeeze_20": flag("bb_width_20 < bq")}
    fifth = {f"adx_{n}": roll("avg", f"dx{n}", n) for n in (14, 21)} | {"rsi_overbought": flag("rsi_14 > 70"), "rsi_oversold": flag("rsi_14 < 30"), "rsi_zscore": "(rsi_14 - 50) / 25.0"}
    sixth = {"rsi_price_divergence": f"({percent_rank('ret14')}) - ({percent_rank('rsi_14')})"}
    layers = [base, second, third, fourth, fifth, sixth]
    wanted = ("rsi_", "bb_", "stoch_", "williams_", "cci_", "adx_", "di_diff", "ichimoku_", "roc_osc_", "trend_slope_", "money_flow_", "aroon_")
    return layers, [c for layer in layers for c in layer if c.startswith(wanted)]


def value() -> tuple[Layers, list[str]]:
    """On a panel with fundamentals joined as of each date."""
    cheap, yields = ("pe_ratio", "pb_ratio", "ev_ebitda"), ("earnings_yield", "dividend_yield")
    de = low_clip("debt_equity")
    one = {f"raw_{c}": c for c in (*cheap, *yields, "debt_equity")} | {f"inv_{c}": f"1.0D / nullif({c}, 0)" for c in cheap}
    one |= {f"delta_{c}_{n}d": change(c, n) for c in cheap for n in (63, 252)} | {f"div_yield_change_{n}d": diff("dividend_yield", n) for n in (63, 252)}
    one |= {"ey_change_63d": diff("earnings_yield", 63), "ey_accel": f"{diff('earnings_yield', 63)} - {diff('earnings_yield', 126)}"} | {f"ts_rank_{c}": f"1 - ({own_rank(c)})" for c in cheap}
    one |= {"yield_composite": "(earnings_yield + dividend_yield) / 2", "debt_adj_ey": f"earnings_yield / (1 + ({de}))", "net_ey": f"earnings_yield - 0.05 * (CASE WHEN debt_equity > 3 THEN 3.0D WHEN debt_equity < 0 THEN 0.0D ELSE debt_equity END)"}
    one |= {"pb_roe_spread": "roe - 0.1 * pb_ratio", "roe_pb_ratio": "roe / nullif(pb_ratio, 0)", "high_current_ratio": flag("current_ratio > 1.5"), "leverage_adj_ev_ebitda": f"ev_ebitda * (1 + ({de}))"}
    two = {f"rank_{c}": percent_rank(c) for c in yields} | {f"rank_{c}": f"1 - ({percent_rank(c)})" for c in cheap} | {f"zscore_{c}": cross_z(c) for c in (*cheap, *yields, "debt_equity")}
    two |= {"roe_pr": percent_rank("roe"), "ev_ebitda_rank": f"1 - ({percent_rank('ev_ebitda')})", "ev_q": cross_quantile("ev_ebitda", 0.3), "current_ratio_rank": percent_rank("current_ratio"), "leverage_adj_ev_rank": f"1 - ({percent_rank('leverage_adj_ev_ebitda')})"}
    ranks = [f"rank_{c}" for c in (*cheap, *yields)]
    some = " + ".join(f"coalesce({r}, 0)" for r in ranks)
    three = {"value_composite": f"CASE WHEN coalesce({', '.join(ranks)}) IS NOT NULL THEN ({some}) / {len(ranks)} END", "value_quality_combo": "(rank_earnings_yield + roe_pr) / 2"}
    three |= {"ev_ebitda_zscore": "zscore_ev_ebitda", "low_ev_flag": flag("ev_ebitda < ev_q"), "div_yield_zscore": "zscore_dividend_yield"}
    return [one, two, three], [c for layer in (one, two, three) for c in layer if c not in ("roe_pr", "ev_q")]


def quality() -> tuple[Layers, list[str]]:
    """On the report-date grid of fundamentals."""
    four = lambda c: diff(c, 4)
    one = {"qual_roe": "roe", "qual_roa": "roa", "qual_gross_margin": "gross_margin", "qual_earnings_yield": "earnings_yield", "qual_dividend_payout": "dividend_yield"}
    one |= {"accruals_change": change("accruals", 4), "asset_growth_change": four("asset_growth"), "f_roa_positive": flag("roa > 0"), "f_roa_improving": flag(f"{four('roa')} > 0"), "f_cfo_positive": flag("roa - accruals > 0")}
    one |= {"f_accruals_low": flag("accruals < 0"), "f_leverage_low": flag(f"{four('debt_equity')} < 0"), "f_cr_improving": flag(f"{four('current_ratio')} > 0"), "f_high_cr": flag("current_ratio > 1.0"), "f_gm_improving": flag(f"{four('gross_margin')} > 0")}
    one |= {"roe_trend_4q": four("roe"), "roe_trend_8q": diff("roe", 8), "gm_trend_4q": four("gross_margin"), "gm_trend_8q": diff("gross_margin", 8), "roa_trend_4q": four("roa"), "quality_leverage_adj": f"roe / (1 + ({low_clip('debt_equity')}))"}
    one |= {"ey_std_4q": roll("stddev_samp", "earnings_yield", 4, 2), "ey_improving": flag(f"{four('earnings_yield')} > 0"), "roa_std_4q": roll("stddev_samp", "roa", 4, 2), "roe_std_4q": roll("stddev_samp", "roe", 4, 2)}
    one |= {"ey_m4": roll("avg", "earnings_yield", 4, 4), "roe_m4": roll("avg", "roe", 4, 4), "deleveraging_flag": flag(f"{diff('debt_equity', 8)} < 0"), "gm_ts_rank": own_rank("gross_margin"), "gm_m8": roll("avg", "gross_margin", 8, 4)}
    two = {f"rank_{c}": percent_rank(c) for c in ("roe", "roa", "gross_margin")} | {f"zscore_{c}": cross_z(c) for c in ("roe", "roa", "gross_margin", "accruals", "asset_growth")}
    two |= {"accruals_rank": f"1 - ({percent_rank('accruals')})", "acc_q": cross_quantile("accruals", 0.3), "asset_growth_rank": f"1 - ({percent_rank('asset_growth')})", "ag_q": cross_quantile("asset_growth", 0.3), "de_q": cross_quantile("debt_equity", 0.4)}
    two |= {"cr_pr": percent_rank("current_ratio"), "de_pr": percent_rank("debt_equity"), "ey_cv": f"ey_std_4q / (abs(ey_m4) + {EPS})", "roe_cv": f"roe_std_4q / (abs(roe_m4) + {EPS})", "gm_above_avg": flag("gross_margin > gm_m8")}
    three = {"low_accruals": flag("accruals < acc_q"), "low_asset_growth": flag("asset_growth < ag_q"), "f_low_leverage": flag("debt_equity < de_q"), "quality_composite": "(rank_roe + rank_roa + rank_gross_margin) / 3", "quality_accrual_adj": "(rank_roe + accruals_rank) / 2"}
    three |= {"leverage_liquidity_score": "cr_pr - de_pr", "financial_health_score": "rank_roe - de_pr"}
    flags = ["f_roa_positive", "f_roa_improving", "f_cfo_positive", "f_accruals_low", "f_leverage_low", "f_low_leverage", "f_cr_improving", "f_high_cr", "f_gm_improving"]
    last = {"piotroski_f": " + ".join(flags), "quality_composite_change": four("quality_composite")}
    hidden = {"ey_m4", "roe_m4", "gm_m8", "acc_q", "ag_q", "de_q", "cr_pr", "de_pr"}
    return [one, two, three, last], [c for layer in (one, two, three, last) for c in layer if c not in hidden]


def alternative() -> tuple[Layers, list[str]]:
    """On a panel with fundamentals joined as of each date; ``home`` is the ticker's most frequent sector."""
    one = {"a_vol20": roll("stddev_samp", R, 20), "a_mom20": change(C, 20), "a_v20": roll("avg", V, 20), "a_rv10": f"({roll('stddev_samp', R, 10)}) * {YEAR}", "a_rv60": f"({roll('stddev_samp', R, 60)}) * {YEAR}"}
    one |= {"iv_skew_proxy": skew(R, 60, 30), "iv_kurtosis_proxy": kurt(R, 60, 30), "put_call_skew_proxy": f"-({skew(R, 20, 10)})", "a_dv": f"{C} * {V}"}
    one |= {"analyst_revision_proxy_1q": diff("earnings_yield", 63), "analyst_revision_proxy_2q": diff("earnings_yield", 126), "revision_acceleration": f"{diff('earnings_yield', 21)} - {diff('earnings_yield', 42)}"}
    one |= {"a_accel": f"{change(C, 10)} - {change(C, 20)}", "a_confirm": f"({roll('avg', V, 10)}) / (({roll('avg', V, 60)}) + {EPS})", "a_r3": roll("sum", R, 3, 2), "a_r5": roll("avg", R, 5, 3)}
    peers = lambda agg: cross(agg, R, "date, home")
    one |= {"is_january": flag("month(date) = 1"), "is_month_end": flag("day(date) >= 25"), "is_monday": weekday_is(0), "is_friday": weekday_is(4)}
    one |= {"a_peer": f"CASE WHEN home IS NOT NULL THEN ({peers('sum')} - coalesce({R}, 0)) / nullif({peers('count')} - (CASE WHEN {R} IS NULL THEN 0 ELSE 1 END), 0) END"}
    two = {"a_dv60": roll("avg", "a_dv", 60), "a_dv5": roll("avg", "a_dv", 5, 3), "sector_spillover_mom": roll("avg", "a_peer", 20), "days_to_cover_proxy": f"a_vol20 / (ln(1 + a_v20) + {EPS})", "iv_proxy_short": "a_rv10", "iv_term_structure": f"a_rv10 / (a_rv60 + {EPS})"}
    two |= {"revision_momentum": "analyst_revision_proxy_1q - analyst_revision_proxy_2q", "sentiment_proxy": "a_accel * a_confirm", "news_momentum_proxy": "a_r3 * a_confirm", "vol_risk_premium_proxy": "a_rv10 - a_rv60"}
    three = {"short_interest_proxy": f"({percent_rank('a_vol20')}) * (1 - ({percent_rank('a_mom20')}))", "a_q80": cross_quantile("a_mom20", 0.8), "a_q70": cross_quantile("a_vol20", 0.7), "revision_rank": percent_rank("analyst_revision_proxy_1q")}
    three |= {"macro_regime_proxy": cross("stddev_samp", R), "inst_flow_proxy": f"a_dv5 / (a_dv60 + {EPS}) - 1", "smart_money_proxy": f"a_r5 * (a_dv5 / (a_dv60 + {EPS}))", "a_iv_pr": percent_rank("iv_term_structure")}
    four = {"short_squeeze_risk": f"{flag('a_mom20 > a_q80')} * {flag('a_vol20 > a_q70')}", "a_si_pr": percent_rank("short_interest_proxy"), "a_if_pr": percent_rank("inst_flow_proxy"), "flight_to_quality_proxy": "-sentiment_proxy * macro_regime_proxy"}
    five = {"liquidity_stress_proxy": "(a_iv_pr + a_si_pr) / 2", "crowding_score": "(a_si_pr + a_if_pr) / 2"}
    six = {"contrarian_signal": "-crowding_score * sign(a_mom20)"}
    layers = [one, two, three, four, five, six]
    return layers, [c for layer in layers for c in layer if not c.startswith("a_")]


def composite(ranked: list[str]) -> tuple[Layers, list[str]]:
    """On a matrix of all other features; ranked: its ``rank_*`` and ``zscore_*`` columns."""
    one = {f"k_{c}": percent_rank(c) for c in ("mom_12_1", "quality_composite", "value_composite", "amihud_60d", "short_interest_proxy")} | {"k_low_vol": percent_rank("neg_vol_60d")}
    one |= {f"z_{c}": f"({c} - {cross('avg', c)}) / ({cross('stddev_samp', c)} + {EPS})" for c in ranked}
    mean = f"({' + '.join(f'coalesce(z_{c}, 0)' for c in ranked)}) / nullif({' + '.join(f'(CASE WHEN z_{c} IS NULL THEN 0 ELSE 1 END)' for c in ranked)}, 0)"
    two = {"mom_quality_combo": "(k_mom_12_1 + k_quality_composite) / 2", "mom_value_combo": "(k_mom_12_1 + k_value_composite) / 2", "low_vol_quality_combo": "(k_low_vol + k_quality_composite) / 2"}
    two |= {"risk_adj_momentum": f"mom_12_1 / (vol_60d + {EPS})", "risk_adj_value": f"value_composite / (vol_60d + {EPS})", "three_factor_composite": "(k_mom_12_1 + k_value_composite + k_quality_composite) / 3"}
    two |= {"liquidity_adj_momentum": "k_mom_12_1 - 0.3 * k_amihud_60d", "crowding_adj_momentum": "k_mom_12_1 - 0.2 * k_short_interest_proxy", "pca_composite_proxy": mean}
    two |= {"tech_mom_confirm": f"{flag('mom_12_1 > 0')} * {flag('rsi_14 > 50')} - {flag('mom_12_1 < 0')} * {flag('rsi_14 < 50')}", "multi_factor_vote": "coalesce(sign(mom_12_1), 0) + coalesce(sign(value_composite), 0) + coalesce(sign(quality_composite), 0)"}
    return [{"neg_vol_60d": "-vol_60d"}, one, two], list(two)


def base_factory() -> tuple[Layers, list[str]]:
    """Returns, volatility and averages of close, and volume ratios; filled forward, then 0."""
    one = {"b_ret": change("close")} | {f"b_return_{n}d": change("close", n) for n in (3, 5, 10, 20, 60, 120, 252)} | {f"b_sma_ratio_{n}d": f"close / ({roll('avg', 'close', n, n)})" for n in (3, 5, 10, 20, 60, 120, 252)}
    one |= {f"b_ratio_{n}d": f"volume / nullif(({roll('avg', 'volume', n, n)}), 0)" for n in (5, 10, 20, 60)} | {f"b_std_{n}d": roll("stddev_samp", "volume", n, n) for n in (5, 10, 20, 60)}
    two = {f"b_volatility_{n}d": roll("stddev_samp", "b_ret", n, n) for n in (3, 5, 10, 20, 60, 120, 252)} | {f"b_force_{n}d": f"b_ret * b_ratio_{n}d" for n in (5, 10, 20, 60)}
    three = {}
    for n in (3, 5, 10, 20, 60, 120, 252):
        three |= {f"momentum_{k}_{n}d": f"coalesce({fill_forward(f'b_{k}_{n}d')}, 0)" for k in ("return", "volatility", "sma_ratio")}
    for n in (5, 10, 20, 60):
        three |= {f"volume_{k}_{n}d": f"coalesce({fill_forward(f'b_{k}_{n}d')}, 0)" for k in ("ratio", "force", "std")}
    return [one, two, three], list(three)


#: Names of base-factory columns that come from tables beside the bars.
QUALITY = ("roe", "roa", "gross_margin", "debt_to_equity", "asset_turnover", "operating_leverage")
VALUE = ("pe_ratio", "pb_ratio", "ps_ratio", "ev_ebitda", "dividend_yield", "book_to_market")
MACRO = ("rates_beta", "inflation_beta", "vix_beta", "credit_spread_beta", "gdp_beta")
ALTERNATIVE = ("sentiment_score", "supply_chain_disruption_index", "news_intensity", "web_traffic_index")


def base_named() -> list[str]:
    """Base-factory columns that are taken over by name where a table has them, and 0 where none has."""
    names = [f"quality_{m}{end}" for m in QUALITY for end in ("", "_change_1y")] + [f"value_{m}{end}" for m in VALUE for end in ("", "_rank_cross_sectional")]
    names += [f"macro_sensitivity_{m}_{n}d" for m in MACRO for n in (60, 120, 252)]
    return names + [f"alt_{m}_{kind}_{n}d" for m in ALTERNATIVE for n in (5, 20, 60) for kind in ("mean", "momentum")]


__all__ = ["EMA_SPANS", "MACD", "alternative", "base_factory", "base_named", "composite", "momentum", "quality", "technical", "value", "volatility", "volume"]
