"""The same queries as DuckDB SQL, written on their own: common table expressions stacked into one statement."""

from __future__ import annotations

from types import SimpleNamespace

# Stated here on their own, not taken from the operators: window lengths, metrics, thresholds and t quantiles.
D = SimpleNamespace(returns=(1, 2, 3, 5, 10, 20), momentum=(5, 10, 20), up_days=(5, 10), averages=(5, 10, 20, 50), volatility=(5, 10, 20), volume=20, relative=(1, 5), rolling=20)
METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "precision_up", "recall_up", "mcc", "brier", "log_loss", "roc_auc", "pr_auc")
CANDIDATES = tuple(round(0.30 + 0.01 * i, 2) for i in range(41))
T_975 = {1: 12.7062047361747, 2: 4.30265272974946, 3: 3.18244630528371, 4: 2.77644510519779, 5: 2.57058183563631, 6: 2.44691185114497, 7: 2.36462425159278}
W = "PARTITION BY ticker ORDER BY session"


def _bars(name: str, ticker: str, session: str, price: str, size: str, order: str, source: str) -> str:
    return f"""{name} AS (
        SELECT {ticker} AS ticker, {session} AS session, arg_min({price}, {order}) AS open, max({price}) AS high, min({price}) AS low,
               arg_max({price}, {order}) AS close, CAST(sum({size}) AS DOUBLE) AS volume
        FROM {source} GROUP BY 1, 2)"""


_LINE = ("CAST(l_shipdate AS DATE)", "100.0::DOUBLE + l_extendedprice / 10000.0::DOUBLE", "l_quantity", "ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)", "lineitem")
DAILY = _bars("bars", "l_linestatus", *_LINE)
WIDE = _bars("bars", "CAST(l_suppkey AS VARCHAR)", *_LINE)
HOURLY = _bars("bars", "event_type", "date_trunc('hour', CAST(ts AS TIMESTAMP))", "100.0::DOUBLE + value / 50.0::DOUBLE", "1.0::DOUBLE", "event_id", "events")
FLOW = _bars("bars", "o_orderpriority", "CAST(o_orderdate AS DATE)", "100.0::DOUBLE + o_totalprice / 50000.0::DOUBLE", "1.0::DOUBLE", "o_orderkey", "orders")
DAY = "strftime(session, '%Y-%m-%d') AS session"
OHLCV = ", ".join(f"round({c}, 8) AS {c}" for c in ("open", "high", "low", "close", "volume"))


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def r8(x: str, name: str) -> str:
    return f"round({x}, 8) + 0.0::DOUBLE AS {name}"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def lag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({W})"


def roll(f: str, n: int) -> str:
    return f"{f} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(counted: str, n: int, value: str) -> str:
    return f"CASE WHEN {roll(f'count({counted})', n)} = {n} THEN {value} END"


RET = f"returned AS (SELECT *, {div('close', lag('close', 1))} - 1 AS ret FROM bars)"
UP = "CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT)::DOUBLE END"


def _sma(n: int) -> str:
    return full("close", n, roll("avg(close)", n))


def _vol(n: int) -> str:
    return full("ret", n, roll("stddev_samp(ret)", n))


_VM, _VS = full("volume", D.volume, roll("avg(volume)", D.volume)), full("volume", D.volume, roll("stddev_samp(volume)", D.volume))
FEATURES: dict[str, dict[str, str]] = {
    "lagged_returns": {f"return_{n}d": f"{div('close', lag('close', n))} - 1" for n in D.returns},
    "skip_momentum": {f"momentum_{n}d": f"{div(lag('close', 1), lag('close', n))} - 1" for n in D.momentum},
    "up_day_share": {f"positive_days_last_{n}": full("ret", n, f"{roll(f'sum({UP})', n)} / {n}") for n in D.up_days},
    "sma_ratios": {f"close_to_sma_{n}": f"{div('close', _sma(n))} - 1" for n in D.averages} | {f"sma_{a}_to_sma_{b}": f"{div(_sma(a), _sma(b))} - 1" for a, b in zip(D.averages, D.averages[1:])},
    "rolling_volatility": {f"volatility_{n}d": _vol(n) for n in D.volatility} | {f"vol_ratio_{D.volatility[0]}d_{D.volatility[-1]}d": f"{div(_vol(D.volatility[0]), _vol(D.volatility[-1]))} - 1"},
    "bar_shape": {
        "intraday_range": div("high - low", "close"),
        "overnight_gap": f"{div('open', lag('close', 1))} - 1",
        "open_to_close_return": f"{div('close', 'open')} - 1",
        "close_position_in_range": "CASE WHEN high - low > 1e-12 THEN (close - low) / (high - low) ELSE 0.5::DOUBLE END",
    },
    "volume_relative": {
        "volume_change_1d": f"{div('volume', lag('volume', 1))} - 1",
        f"volume_to_sma_{D.volume}": f"{div('volume', _VM)} - 1",
        f"volume_zscore_{D.volume}": div(f"volume - {_VM}", _VS),
    },
}
ALL = {n: e for family in FEATURES.values() for n, e in family.items()}

_BOTH = "CASE WHEN ret IS NOT NULL AND bench_ret IS NOT NULL THEN 1 END"
_N = D.rolling
BENCH = {
    "benchmark_return_1d": "bench_ret",
    **{f"relative_return_{k}d": f"{div('close', lag('close', k))} - {div('bench_close', lag('bench_close', k))}" for k in D.relative},
    f"rolling_beta_{_N}": full(_BOTH, _N, div(roll("covar_samp(ret, bench_ret)", _N), roll("var_samp(bench_ret)", _N))),
    f"rolling_correlation_{_N}": full(_BOTH, _N, div(roll("covar_samp(ret, bench_ret)", _N), f"{roll('stddev_samp(ret)', _N)} * {roll('stddev_samp(bench_ret)', _N)}")),
}
ALIGNED = "bars_all AS (SELECT * FROM bars), aligned AS (SELECT a.*, b.close AS bench_close FROM bars a JOIN bars b ON a.session = b.session AND b.ticker = 'O' WHERE a.ticker = 'F')"
BENCH_RET = f"returned AS (SELECT *, {div('close', lag('close', 1))} - 1 AS ret, {div('bench_close', lag('bench_close', 1))} - 1 AS bench_ret FROM aligned)"


def _select(columns: dict[str, str], source: str) -> str:
    return f"SELECT ticker, {DAY}, " + ", ".join(r8(e, n) for n, e in columns.items()) + f" FROM {source}"


_FR = f"{div(f'lead(close, 1) OVER ({W})', f'lead(open, 1) OVER ({W})')} - 1"
DATASET = [
    DAILY,
    RET,
    f"wide AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in ALL.items())}, {_FR} AS future_return FROM returned)",
    f"complete AS (SELECT *, CAST(future_return > 0 AS INT) AS target FROM wide WHERE future_return IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in ALL)})",
    f"rows_ AS (SELECT *, row_number() OVER ({W}) - 1 AS row_idx, count(*) OVER (PARTITION BY ticker) AS n_rows FROM complete)",
    "sizes AS (SELECT ticker, count(*) AS n_rows FROM rows_ GROUP BY 1)",
    "bounds AS (SELECT ticker, n_rows, CAST(floor(n_rows * 0.8::DOUBLE) AS BIGINT) AS dev_end FROM sizes)",
    "fold_size AS (SELECT ticker, dev_end AS n, (dev_end - 1) // 6 AS size FROM bounds)",
    "folds AS (SELECT ticker, CAST(k AS BIGINT) AS fold, size * k AS train_end, size * k + 1 AS eval_start, CASE WHEN k = 5 THEN n ELSE size * k + 1 + size END AS eval_end FROM fold_size, range(1, 6) t(k) WHERE size > 0)",
]
EVAL = "eval AS (SELECT r.*, f.fold FROM rows_ r JOIN folds f ON r.ticker = f.ticker AND r.row_idx >= f.eval_start AND r.row_idx < f.eval_end)"
_C = "least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, {}))"
SCORED = [
    *DATASET,
    EVAL,
    "train AS (SELECT r.*, f.fold FROM rows_ r JOIN folds f ON r.ticker = f.ticker AND r.row_idx < f.train_end)",
    """fit AS (SELECT ticker, fold, avg(target) AS prior,
        coalesce(avg(CASE WHEN open_to_close_return > 0 THEN target END), avg(target)) AS after_up,
        coalesce(avg(CASE WHEN NOT open_to_close_return > 0 THEN target END), avg(target)) AS after_down FROM train GROUP BY 1, 2)""",
    """joined AS (SELECT e.*, prior, after_up, after_down,
        CAST(CAST('0x' || substr(md5('42:' || e.ticker || ':' || CAST(row_idx AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS draw
        FROM eval e JOIN fit USING (ticker, fold))""",
    f"""scored AS (
        SELECT 'majority_class' AS candidate, ticker, fold, session, row_idx, {_C.format('prior')} AS proba_up, CAST(prior >= 0.5 AS INT) AS prediction, target, future_return FROM joined
        UNION ALL SELECT 'always_up', ticker, fold, session, row_idx, {_C.format('prior')}, 1, target, future_return FROM joined
        UNION ALL SELECT 'random', ticker, fold, session, row_idx, {_C.format('prior')}, CAST(draw < prior AS INT), target, future_return FROM joined
        UNION ALL SELECT 'last_direction', ticker, fold, session, row_idx, {_C.format('CASE WHEN open_to_close_return > 0 THEN after_up ELSE after_down END')}, CAST(open_to_close_return > 0 AS INT), target, future_return FROM joined
        UNION ALL SELECT 'reversion', ticker, fold, session, row_idx, round(1.0::DOUBLE / (1.0::DOUBLE + exp(open_to_close_return * 20.0::DOUBLE)), 8), CAST(round(1.0::DOUBLE / (1.0::DOUBLE + exp(open_to_close_return * 20.0::DOUBLE)), 8) >= 0.5 AS INT), target, future_return FROM joined)""",
]


def _hard(source: str, keys: str, tp: str, fp: str, tn: str, fn: str) -> dict[str, str]:
    """Metrics of a confusion table by name."""
    up, down = div(tp, f"{tp} + {fn}"), div(tn, f"{tn} + {fp}")
    f_up, f_down = div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), div(f"2 * {tn}", f"2 * {tn} + {fp} + {fn}")
    mean = lambda a, b: f"coalesce(({a} + {b}) / 2, {a}, {b})"
    return {
        "accuracy": div(f"{tp} + {tn}", f"{tp} + {fp} + {tn} + {fn}"),
        "balanced_accuracy": mean(up, down),
        "f1_macro": mean(f_up, f_down),
        "precision_up": f"coalesce({div(tp, f'{tp} + {fp}')}, 0)",
        "recall_up": f"coalesce({up}, 0)",
        "mcc": f"CASE WHEN {tp} + {fn} > 0 AND {tn} + {fp} > 0 THEN coalesce({div(f'{tp} * {tn} - {fp} * {fn}', f'sqrt(({tp} + {fp}) * ({tp} + {fn}) * ({tn} + {fp}) * ({tn} + {fn}))')}, 0) END",
    }


_COUNT = "CAST(count(*) FILTER ({}) AS DOUBLE)"
_H = _hard("", "", "tp", "fp", "tn", "fn")


def _counts(keys: str) -> str:
    p = "least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, proba_up))"
    return f"""counted AS (SELECT {keys}, count(*) AS n, {_COUNT.format('target = 1 AND prediction = 1')} AS tp, {_COUNT.format('target = 0 AND prediction = 1')} AS fp,
        {_COUNT.format('target = 0 AND prediction = 0')} AS tn, {_COUNT.format('target = 1 AND prediction = 0')} AS fn,
        avg((proba_up - target) * (proba_up - target)) AS brier, avg(-CASE WHEN target = 1 THEN ln({p}) ELSE ln(1 - {p}) END) AS log_loss FROM scored GROUP BY ALL)"""


def _ranks(keys: str) -> list[str]:
    return [
        f"distinct_scores AS (SELECT {keys}, proba_up, {_COUNT.format('target = 1')} AS pos, {_COUNT.format('target = 0')} AS neg FROM scored GROUP BY ALL)",
        f"""score_runs AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY proba_up DESC ROWS UNBOUNDED PRECEDING) AS tps, sum(neg) OVER (PARTITION BY {keys} ORDER BY proba_up DESC ROWS UNBOUNDED PRECEDING) AS fps,
            sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS q FROM distinct_scores)""",
        f"""rank_scores AS (SELECT {keys}, CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(pos * (q - fps) + pos * neg / 2) / (max(p) * max(q)) END AS roc_auc,
            CASE WHEN max(p) > 0 AND max(q) > 0 THEN sum(pos * tps / (tps + fps)) / max(p) END AS pr_auc FROM score_runs GROUP BY ALL)""",
    ]


KEYS, PAIR = "candidate, ticker, fold", "candidate, ticker"
SUITE = [*SCORED, _counts(KEYS), *_ranks(KEYS), f"suite AS (SELECT {KEYS}, n, tp, fp, tn, fn, {', '.join(f'{e} AS {n}' for n, e in _H.items())}, brier, log_loss, roc_auc, pr_auc FROM counted JOIN rank_scores USING ({KEYS}))"]
SUMMARY = """summary AS (SELECT ticker, candidate, avg(balanced_accuracy) AS mean_ba, coalesce(stddev_samp(balanced_accuracy), 0) AS std_ba, avg(log_loss) AS mean_log_loss, avg(roc_auc) AS mean_auc, avg(mcc) AS mean_mcc,
    CAST(CASE WHEN candidate = 'reversion' THEN 1 ELSE 0 END AS BIGINT) AS complexity FROM suite GROUP BY ticker, candidate)"""

BINS = f"""bins AS (SELECT {PAIR}, CAST(least(floor(proba_up * 10), 9) AS BIGINT) AS bin_id, count(*) AS n, avg(proba_up) AS mean_predicted, avg(target) AS observed FROM scored GROUP BY ALL),
    gaps_ AS (SELECT *, abs(mean_predicted - observed) AS gap FROM bins)"""
SCAN = [
    *SCORED,
    f"counts_ AS (SELECT {PAIR}, proba_up, {_COUNT.format('target = 1')} AS pos, {_COUNT.format('target = 0')} AS neg FROM scored GROUP BY ALL)",
    "cuts AS (SELECT unnest([" + ", ".join(f"{c}::DOUBLE" for c in CANDIDATES) + "]) AS threshold)",
    f"""table_ AS (SELECT {PAIR}, threshold, sum(CASE WHEN proba_up >= threshold THEN pos ELSE 0 END) AS tp, sum(CASE WHEN proba_up >= threshold THEN neg ELSE 0 END) AS fp,
        sum(CASE WHEN proba_up < threshold THEN neg ELSE 0 END) AS tn, sum(CASE WHEN proba_up < threshold THEN pos ELSE 0 END) AS fn FROM counts_, cuts GROUP BY ALL)""",
    f"scan AS (SELECT {PAIR}, threshold, {', '.join(f'{_H[m]} AS {m}' for m in ('accuracy', 'balanced_accuracy', 'f1_macro'))} FROM table_)",
]


def _days(mode: str) -> list[str]:
    long = "CASE WHEN proba_up >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    position = f"CASE WHEN proba_up <= 0.45 THEN -1.0::DOUBLE ELSE {long} END" if mode == "next_open" else long
    w = "PARTITION BY strategy, ticker ORDER BY session"
    cost = "abs(position) * 0.001::DOUBLE" if mode == "next_open" else f"abs(position - lag(position, 1, 0.0::DOUBLE) OVER ({w})) * 0.0005::DOUBLE"
    return [
        *SCORED,
        "rule AS (SELECT * FROM scored WHERE candidate IN ('reversion', 'last_direction'))",
        "each_day AS (SELECT DISTINCT ticker, session, future_return FROM rule)",
        f"""held AS (SELECT candidate AS strategy, ticker, session, {position} AS position, future_return FROM rule
            UNION ALL SELECT 'always_active', ticker, session, 1.0::DOUBLE, future_return FROM each_day
            UNION ALL SELECT 'cash', ticker, session, 0.0::DOUBLE, future_return FROM each_day)""",
        *_daily("held", cost, w),
    ]


def _daily(source: str, cost: str, w: str) -> list[str]:
    run = f"OVER ({w} ROWS UNBOUNDED PRECEDING)"
    return [
        f"costed AS (SELECT *, position * future_return AS gross_return, {cost} AS cost FROM {source})",
        "netted AS (SELECT *, gross_return - cost AS net_return FROM costed)",
        f"grown AS (SELECT *, product(1 + net_return) {run} AS equity, product(1 + gross_return) {run} AS gross_equity FROM netted)",
        f"days AS (SELECT *, equity / max(equity) {run} - 1 AS drawdown FROM grown)",
    ]


_SW = "PARTITION BY strategy, ticker ORDER BY session"
TRADES_OPEN = "trades AS (SELECT strategy, ticker, session AS entry, net_return AS trade_return FROM days WHERE position <> 0)"
TRADES_BLOCK = f"""turns AS (SELECT *, CASE WHEN position = lag(position) OVER ({_SW}) THEN 0 ELSE 1 END AS turned FROM days),
    blocks AS (SELECT *, sum(turned) OVER ({_SW} ROWS UNBOUNDED PRECEDING) AS block FROM turns),
    trades AS (SELECT strategy, ticker, min(session) AS entry, product(1 + net_return) - 1 AS trade_return FROM blocks WHERE position <> 0 GROUP BY strategy, ticker, block)"""
ECONOMICS = f"""changes AS (SELECT *, CAST(position <> lag(position, 1, 0.0::DOUBLE) OVER ({_SW}) AS BIGINT) AS changed FROM days),
    base AS (SELECT strategy, ticker, count(*) AS n_sessions, arg_max(equity, session) - 1 AS cumulative_return, arg_max(gross_equity, session) - 1 AS gross_cumulative_return,
        CASE WHEN arg_max(equity, session) > 0 THEN pow(arg_max(equity, session), 252.0::DOUBLE / count(*)) - 1 END AS annualized_return,
        stddev_samp(net_return) * sqrt(252) AS annualized_volatility, {div('avg(net_return)', 'stddev_samp(net_return)')} * sqrt(252) AS sharpe,
        {div('avg(net_return)', 'stddev_samp(CASE WHEN net_return < 0 THEN net_return END)')} * sqrt(252) AS sortino, min(drawdown) AS max_drawdown,
        count(*) FILTER (position <> 0) AS n_active, CAST(sum(changed) AS BIGINT) AS n_position_changes,
        {div('CAST(count(*) FILTER (position <> 0 AND net_return > 0) AS DOUBLE)', 'count(*) FILTER (position <> 0)')} AS hit_rate,
        CAST(count(*) FILTER (position <> 0) AS DOUBLE) / count(*) AS exposure, avg(position) AS average_position, sum(cost) AS total_cost, coalesce({div('sum(cost)', 'count(*) FILTER (position <> 0)')}, 0) AS cost_per_active
        FROM changes GROUP BY 1, 2),
    done AS (SELECT strategy, ticker, count(*) AS n_trades, avg(trade_return) AS average_trade, median(trade_return) AS median_trade, CAST(count(*) FILTER (trade_return > 0) AS DOUBLE) / count(*) AS trade_win_rate,
        max(trade_return) AS best_trade, min(trade_return) AS worst_trade, {div('coalesce(sum(trade_return) FILTER (trade_return > 0), 0)', 'sum(-trade_return) FILTER (trade_return < 0)')} AS profit_factor,
        (sum(-trade_return) FILTER (trade_return < 0) IS NULL AND sum(trade_return) FILTER (trade_return > 0) IS NOT NULL) AS only_wins FROM trades GROUP BY 1, 2),
    economics AS (SELECT base.*, coalesce(n_trades, 0) AS n_trades, average_trade, median_trade, trade_win_rate, best_trade, worst_trade, profit_factor, only_wins FROM base LEFT JOIN done USING (strategy, ticker))"""
_FLOATS = "cumulative_return gross_cumulative_return annualized_return annualized_volatility sharpe sortino max_drawdown hit_rate exposure average_position total_cost cost_per_active average_trade median_trade trade_win_rate best_trade worst_trade profit_factor".split()


def _boot(series: str, statistics: tuple[str, ...]) -> list[str]:
    """Blocks drawn by hash, resamples, statistics of each, and their spread; from ``series(key, idx, value)``."""
    stats = """avg(value) AS mean_daily, CASE WHEN count(*) FILTER (value <= -1) = 0 THEN exp(sum(CASE WHEN value > -1 THEN ln(1 + value) END) * 252 / count(*)) - 1 END AS annualized,
        avg(value) / nullif(stddev_samp(value), 0) * sqrt(252) AS sharpe"""
    return [
        f"series AS ({series})",
        "lengths AS (SELECT key, count(*) AS n, greatest(1, least(20, count(*))) AS length FROM series GROUP BY 1)",
        "numbered AS (SELECT key, n, length, sample, block_no FROM lengths, range(0, 2000) s(sample), range(0, CAST(ceil(n / length) AS BIGINT)) b(block_no))",
        """starts AS (SELECT *, CAST(floor(CAST(CAST('0x' || substr(md5('42:' || CAST(sample AS VARCHAR) || ':' || CAST(block_no AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0::DOUBLE * (n - length + 1)) AS BIGINT) AS start FROM numbered)""",
        "picked AS (SELECT key, sample, block_no * length + o AS place, start + o AS idx, n FROM starts, range(0, 20) t(o) WHERE o < length)",
        "resample AS (SELECT p.key, sample, value FROM picked p JOIN series s ON s.key = p.key AND s.idx = p.idx WHERE place < n)",
        f"draws AS (SELECT key, sample, {stats} FROM resample GROUP BY 1, 2)",
        f"point_ AS (SELECT key, {stats} FROM series GROUP BY 1)",
        "final_ AS ("
        + " UNION ALL ".join(
            f"SELECT key, '{s}' AS statistic, any_value(p.{s}) AS point, count(d.{s}) AS n_draws, quantile_cont(d.{s}, 0.025) AS low, quantile_cont(d.{s}, 0.975) AS high, avg(CAST(d.{s} > 0 AS INT)) AS above_zero FROM draws d JOIN point_ p USING (key) GROUP BY key"
            for s in statistics
        )
        + ")",
    ]


_BOOT_OUT = f"SELECT key, statistic, {r8('point', 'point')}, n_draws, {r8('low', 'low')}, {r8('high', 'high')}, {r8('above_zero', 'above_zero')} FROM final_"
_DEFECTS = """defects AS (SELECT ticker, session, open, CASE WHEN day(session) = 7 THEN low - 1 ELSE high END AS high, CASE WHEN day(session) = 8 THEN high + 1 ELSE low END AS low, close,
    CASE WHEN day(session) = 9 THEN 0 ELSE volume END AS volume FROM bars)"""
_KINDS = {"high_below_low": "high < low - slack", "high_below_open": "high < open - slack", "high_below_close": "high < close - slack", "low_above_open": "low > open + slack", "low_above_close": "low > close + slack"}
_SLACK = "slacked AS (SELECT *, greatest(abs(close), 1e-12::DOUBLE) * 1e-8::DOUBLE AS slack FROM defects)"
_MOVES = f"moved AS (SELECT *, {div('close', lag('close', 1))} - 1 AS move, CAST(session AS DATE) - CAST({lag('session', 1)} AS DATE) AS gap_days FROM {{}})"
_LOST = "bench AS (SELECT session FROM bars WHERE ticker = 'O' AND day(session) <> 20), asset AS (SELECT * FROM bars WHERE ticker = 'F')"
_T = "CASE n_values - 1 " + " ".join(f"WHEN {d} THEN {t!r}::DOUBLE" for d, t in T_975.items()) + " END"
_SHORT = {"ba": "balanced_accuracy", "log_loss": "log_loss", "auc": "roc_auc", "mcc": "mcc", "brier": "brier", "accuracy": "accuracy"}
_LONG = "long_ AS (" + " UNION ALL ".join(f"SELECT {KEYS}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM suite" for m in METRICS) + ")"
_HOLD = f"""moves_in AS (SELECT ticker, session, {div('close', lag('close', 1))} - 1 AS r FROM bars),
    held AS (SELECT 'buy_and_hold' AS strategy, ticker, session, 1.0::DOUBLE AS position, coalesce(r, 0) AS future_return FROM rows_ LEFT JOIN moves_in USING (ticker, session))"""
_C2C_COST = f"abs(position - lag(position, 1, 0.0::DOUBLE) OVER ({_SW})) * 0.0005::DOUBLE"
_NUMBERED = "SELECT ticker AS key, row_number() OVER (PARTITION BY ticker ORDER BY session) - 1 AS idx, net_return AS value FROM days WHERE strategy = 'reversion'"
_PAIRED = """SELECT ticker AS key, row_number() OVER (PARTITION BY ticker ORDER BY session) - 1 AS idx, a.net_return - b.net_return AS value
    FROM (SELECT * FROM days WHERE strategy = 'reversion') a JOIN (SELECT ticker, session, net_return FROM days WHERE strategy = 'always_active') b USING (ticker, session)"""
_CORR = lambda x, y: div(f"covar_samp({x}, {y})", f"stddev_samp({x}) * stddev_samp({y})")
_SMALL = {
    "return_1d": f"{div('close', lag('close', 1))} - 1", "return_5d": f"{div('close', lag('close', 5))} - 1", "momentum_5d": f"{div(lag('close', 1), lag('close', 5))} - 1",
    "up5": full("ret", 5, roll("count(*)", 5)), "sma10": _sma(10), "vol5": _vol(5), "volume10": full("volume", 10, div(roll("avg(volume)", 10), roll("stddev_samp(volume)", 10))), "volume1": lag("volume", 1),
}

_TRAIN = "train AS (SELECT r.*, f.fold FROM rows_ r JOIN folds f ON r.ticker = f.ticker AND r.row_idx < f.train_end)"
_NAMES = "[" + ", ".join(f"'{n}'" for n in ALL) + "]"
_VALUES = "[" + ", ".join(ALL) + "]"

ORACLE: dict[str, str] = {
    "rank_metrics_in_ranges": f"""{_with("scored AS (SELECT l_returnflag AS candidate, l_extendedprice / l_quantity + l_discount AS proba_up, CAST(l_linestatus = 'F' AS INT) AS target FROM lineitem)", *_ranks('candidate'))}
        SELECT candidate, {r8('roc_auc', 'roc_auc')}, {r8('pr_auc', 'pr_auc')} FROM rank_scores""",
    "fold_causality": f"""{_with(*DATASET)}, moved AS (SELECT 'development' AS folds, ticker, fold, train_end, eval_start, eval_end FROM folds UNION ALL SELECT 'early', ticker, fold, train_end, eval_start - 2, eval_end FROM folds)
        SELECT folds, ticker, fold, eval_start >= train_end + 1 AS after_train, coalesce(eval_start >= lag(eval_end) OVER (PARTITION BY folds, ticker ORDER BY fold), true) AS in_order, eval_end > eval_start AS filled FROM moved""",
    "holdout_causality": f"""{_with(*DATASET)}, ends AS (SELECT ticker, n_rows, CAST(floor(n_rows * 0.6::DOUBLE) AS BIGINT) AS a, dev_end AS b FROM bounds),
        parts AS (SELECT ticker, 'train' AS part, 0 AS s, a AS e FROM ends UNION ALL SELECT ticker, 'validation', a + 1, b FROM ends UNION ALL SELECT ticker, 'test', b + 1, n_rows FROM ends)
        SELECT CAST(gap AS BIGINT) AS gap, ticker, part, coalesce(s >= lag(e) OVER (PARTITION BY gap, ticker ORDER BY s) + gap, true) AS follows, e > s AS filled FROM parts, (SELECT unnest([1, 2]) AS gap)""",
    "curve_in_ranges": f"{_with(*_days('next_open'))} SELECT strategy, ticker, {DAY}, {r8('ln(equity)', 'log_equity')}, {r8('drawdown', 'drawdown')} FROM days",
    "train_medians": f"""{_with(*DATASET, _TRAIN)}, l AS (SELECT ticker, fold, unnest({_NAMES}) AS feature, unnest({_VALUES}) AS value FROM train)
        SELECT ticker, fold, feature, {r8('median(value)', 'median')} FROM l GROUP BY 1, 2, 3""",
    "feature_bins": f"""{_with(*DATASET, _TRAIN)}, l AS (SELECT ticker, fold, row_idx, unnest({_NAMES}) AS feature, round(unnest({_VALUES}), 8) AS value FROM train),
        k AS (SELECT *, row_number() OVER (PARTITION BY ticker, fold, feature ORDER BY value, row_idx) - 1 AS place, count(*) OVER (PARTITION BY ticker, fold, feature) AS n FROM l),
        c AS (SELECT DISTINCT ticker, fold, feature, value FROM k WHERE (place * 255) // n <> ((place + 1) * 255) // n),
        e AS (SELECT *, max(value) OVER (PARTITION BY ticker, fold, feature) AS top FROM c),
        g AS (SELECT ticker, fold, feature, min(value) FILTER (value < top) AS least, max(value) FILTER (value < top) AS most, coalesce(sum(value) FILTER (value < top), 0) AS total, count(*) FILTER (value < top) AS n_edges FROM e GROUP BY 1, 2, 3)
        SELECT ticker, fold, feature, n_edges, {r8('least', 'least')}, {r8('most', 'most')}, {r8('total', 'total')} FROM g""",
    "permuted_features": f"""{_with(*DATASET)}, dev AS (SELECT r.* FROM rows_ r JOIN bounds b ON r.ticker = b.ticker AND r.row_idx < b.dev_end),
        d AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY row_idx) AS place FROM dev),
        l AS (SELECT ticker, row_idx, unnest(range(0, {len(ALL)})) AS j, unnest({_NAMES}) AS feature, unnest({_VALUES}) AS value FROM d),
        x AS (SELECT l.*, CAST(k AS BIGINT) AS repeat, row_number() OVER (PARTITION BY ticker, j, k ORDER BY md5('42:' || j || ':' || k || ':' || row_idx), row_idx) AS place FROM l, range(0, 5) t(k))
        SELECT x.ticker, feature, repeat, count(*) AS n, {r8('sum(value * target)', 'with_target')}, {r8('sum(value * d.row_idx) / count(*)', 'with_place')} FROM x JOIN d ON d.ticker = x.ticker AND d.place = x.place GROUP BY 1, 2, 3""",
    "logistic_stationarity": f"{_with(*DATASET, _TRAIN)} SELECT ticker, fold, count(*) AS n, true AS flat FROM train GROUP BY 1, 2",
    "bars_daily": f"{_with(DAILY)} SELECT ticker, {DAY}, {OHLCV} FROM bars",
    "bars_wide": f"{_with(WIDE)} SELECT ticker, {DAY}, {OHLCV} FROM bars",
    "bars_hourly": f"{_with(HOURLY)} SELECT ticker, strftime(session, '%Y-%m-%d %H:%M:%S') AS session, {OHLCV} FROM bars",
    "stream_bars": f"{_with(HOURLY)} SELECT ticker, strftime(session, '%Y-%m-%d %H:%M:%S') AS session, {OHLCV} FROM bars",
    "order_flow": f"{_with(FLOW)} SELECT ticker, {DAY}, {OHLCV} FROM bars",
    "normalized_bars": f"{_with(DAILY)} SELECT ticker, {DAY}, {OHLCV} FROM bars WHERE day(session) <> 3",
    "bar_dedup": f"{_with(DAILY)} SELECT ticker, count(*) AS n_rows, count(*) FILTER (day(session) = 15) AS n_removed FROM bars GROUP BY 1",
    "bar_conflicts": f"{_with(DAILY)} SELECT ticker, {DAY}, CAST(2 AS BIGINT) AS n_versions FROM bars WHERE day(session) = 10",
    "quality_report": f"""{_with(DAILY, _DEFECTS, _SLACK, _MOVES.format('slacked'))} SELECT ticker, count(*) AS n_rows, strftime(min(session), '%Y-%m-%d') AS first_session, strftime(max(session), '%Y-%m-%d') AS last_session,
        count(*) FILTER (least(open, high, low, close) <= 0) AS n_not_positive, count(*) FILTER (volume < 0) AS n_negative_volume, count(*) FILTER (volume = 0) AS n_zero_volume,
        count(*) FILTER (abs(move) > 0.04) AS n_large_moves, max(gap_days) AS max_gap_days, {', '.join(f'0.0::DOUBLE AS missing_{c}' for c in ('open', 'high', 'low', 'close', 'volume'))},
        {', '.join(f'count(*) FILTER ({t}) AS {k}' for k, t in _KINDS.items())} FROM moved GROUP BY 1""",
    "large_moves": f"{_with(DAILY, _MOVES.format('bars'))} SELECT ticker, {DAY}, {r8('move', 'move')} FROM moved WHERE abs(move) > 0.04",
    "calendar_gaps": f"{_with(DAILY, 'partly AS (SELECT * FROM bars WHERE day(session) NOT BETWEEN 3 AND 15)', _MOVES.format('partly'))} SELECT ticker, {DAY}, gap_days FROM moved WHERE gap_days > 10",
    "ohlc_violations": f"{_with(DAILY, _DEFECTS, _SLACK)} " + " UNION ALL ".join(f"SELECT ticker, {DAY}, '{k}' AS violation FROM slacked WHERE {t}" for k, t in _KINDS.items()),
    "open_session_drop": f"{_with(DAILY)} SELECT ticker, strftime(max(session), '%Y-%m-%d') AS last_session, count(*) AS n_rows FROM bars WHERE session < DATE '1996-07-01' GROUP BY 1",
    **{name: f"{_with(DAILY, RET)} {_select(family, 'returned')}" for name, family in FEATURES.items()},
    "feature_matrix": f"{_with(DAILY, RET, 'wide AS (SELECT ticker, session, ' + ', '.join(f'{e} AS {n}' for n, e in ALL.items()) + ' FROM returned)')} {_select({n: n for n in ALL}, 'wide')} WHERE {' AND '.join(f'{n} IS NOT NULL' for n in ALL)}",
    "feature_matrix_in_cells": f"{_with(DAILY, RET, 'wide AS (SELECT ticker, session, ' + ', '.join(f'{e} AS {n}' for n, e in ALL.items()) + ' FROM returned)')} {_select({n: n for n in ALL}, 'wide')} WHERE {' AND '.join(f'{n} IS NOT NULL' for n in ALL)}",
    "benchmark_feature_matrix": f"{_with(DAILY, ALIGNED, BENCH_RET, 'wide AS (SELECT ticker, session, ' + ', '.join(f'{e} AS {n}' for n, e in (ALL | BENCH).items()) + ' FROM returned)')} {_select({n: n for n in ALL | BENCH}, 'wide')} WHERE {' AND '.join(f'{n} IS NOT NULL' for n in ALL | BENCH)}",
    "relative_returns": f"{_with(DAILY, ALIGNED, BENCH_RET)} {_select({n: e for n, e in BENCH.items() if 'return' in n}, 'returned')}",
    "rolling_beta": f"{_with(DAILY, ALIGNED, BENCH_RET)} {_select({n: e for n, e in BENCH.items() if 'beta' in n}, 'returned')}",
    "rolling_correlation": f"{_with(DAILY, ALIGNED, BENCH_RET)} {_select({n: e for n, e in BENCH.items() if 'correlation' in n}, 'returned')}",
    "benchmark_align": f"""{_with(DAILY, _LOST)}, gone AS (SELECT * FROM asset WHERE session NOT IN (SELECT session FROM bench))
        SELECT (SELECT count(*) FROM asset) AS n_before, (SELECT count(*) FROM asset) - count(*) AS n_after, count(*) AS n_lost, {r8('count(*)::DOUBLE / (SELECT count(*) FROM asset)', 'lost_share')},
        coalesce(array_to_string(list_sort(list(strftime(session, '%Y-%m-%d')))[1:50], ','), '') AS lost_sessions FROM gone""",
    "benchmark_lost_sessions": f"{_with(DAILY, _LOST)} SELECT ticker, {DAY} FROM asset WHERE session NOT IN (SELECT session FROM bench)",
    "asof_signal": f"""{_with(DAILY)}, moments AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS moment FROM orders), thirds AS (SELECT session FROM bars WHERE ticker = 'F' AND day(session) % 3 = 0)
        SELECT 'F' AS ticker, strftime(moment, '%Y-%m-%d') AS moment, strftime(session, '%Y-%m-%d') AS signal FROM moments ASOF LEFT JOIN thirds ON moment >= session""",
    "next_session": f"{_with(DAILY)} SELECT ticker, {DAY}, strftime(lead(bars.session) OVER (PARTITION BY ticker ORDER BY bars.session), '%Y-%m-%d') AS next_session FROM bars",
    "label_c2c": f"{_with(DAILY)}, f AS (SELECT *, lead(close, 3) OVER ({W}) / close - 1 AS fr FROM bars) SELECT ticker, {DAY}, {r8('fr', 'future_return')}, CAST(fr > 0 AS BIGINT) AS target FROM f",
    "label_o2c": f"{_with(DAILY)}, f AS (SELECT *, {_FR} AS fr FROM bars) SELECT ticker, {DAY}, {r8('fr', 'future_return')}, CAST(fr > 0 AS BIGINT) AS target FROM f",
    "unlabeled_tail": f"{_with(DAILY)}, f AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM bars) SELECT ticker, strftime(max(session), '%Y-%m-%d') AS last_session, count(*) AS n_rows FROM f WHERE k > 3 GROUP BY 1",
    "label_summary": f"""{_with(DAILY)}, f AS (SELECT *, {_FR} AS fr FROM bars) SELECT ticker, count(fr) AS n_labeled, count(*) FILTER (fr > 0) AS n_up, count(*) FILTER (fr <= 0) AS n_down,
        {r8('avg(CAST(fr > 0 AS INT))', 'up_rate')}, {r8('avg(fr)', 'mean_return')} FROM f GROUP BY 1""",
    "dataset": f"{_with(*DATASET)} SELECT ticker, {DAY}, row_idx, n_rows, CAST(target AS BIGINT) AS target, {', '.join(r8(c, c) for c in ('future_return', 'return_1d', 'close_to_sma_50', 'volatility_20d', 'volume_zscore_20'))} FROM rows_",
    "dataset_summary": f"{_with(*DATASET)} SELECT ticker, count(*) AS n_rows, strftime(min(session), '%Y-%m-%d') AS first_session, strftime(max(session), '%Y-%m-%d') AS last_session, {r8('avg(target)', 'up_rate')} FROM rows_ GROUP BY 1",
    "dev_test_bounds": f"{_with(*DATASET)} SELECT ticker, n_rows, dev_end, dev_end + 1 AS test_start, greatest(0, n_rows - dev_end - 1) AS n_test FROM bounds",
    "holdout_ranges": f"""{_with(*DATASET)}, h AS (SELECT ticker, n_rows, dev_end, CAST(floor(n_rows * 0.6::DOUBLE) AS BIGINT) AS first_end FROM bounds)
        SELECT ticker, 'train' AS part, CAST(0 AS BIGINT) AS start, first_end AS "end" FROM h UNION ALL SELECT ticker, 'validation', first_end + 1, dev_end FROM h UNION ALL SELECT ticker, 'test', dev_end + 1, n_rows FROM h""",
    "fold_ranges": f"{_with(*DATASET)} SELECT ticker, fold, train_end, eval_start, eval_end FROM folds",
    "fold_membership": f"{_with(*DATASET, EVAL)} SELECT ticker, fold, row_idx, {DAY} FROM eval",
    "fold_spans": f"""{_with(*DATASET)}, t AS (SELECT r.*, f.fold, r.row_idx < f.train_end AS in_train, r.row_idx >= f.eval_start AND r.row_idx < f.eval_end AS in_eval FROM rows_ r JOIN folds f USING (ticker))
        SELECT ticker, fold, {', '.join(f"strftime({g}(session) FILTER (in_{p}), '%Y-%m-%d') AS {p}_{n}" for p in ('train', 'eval') for g, n in (('min', 'first'), ('max', 'last')))}, count(*) FILTER (in_train) AS n_train, count(*) FILTER (in_eval) AS n_eval FROM t GROUP BY 1, 2""",
    **{f"baseline_{n}": f"{_with(*SCORED)} SELECT ticker, fold, row_idx, {r8('proba_up', 'proba_up')}, CAST(prediction AS BIGINT) AS prediction FROM scored WHERE candidate = '{n}'" for n in ("majority_class", "always_up", "random", "last_direction")},
    "oof_union": f"{_with(*SCORED)} SELECT {KEYS}, count(*) AS n, {r8('avg(proba_up)', 'mean_proba')}, CAST(sum(prediction) AS BIGINT) AS n_up FROM scored GROUP BY ALL",
    "metric_suite": f"{_with(*SUITE)} SELECT {KEYS}, n, {', '.join(r8(c, c) for c in ('tp', 'fp', 'tn', 'fn', *METRICS))} FROM suite",
    "roc_auc": f"{_with(*SUITE)} SELECT {KEYS}, {r8('roc_auc', 'roc_auc')} FROM suite",
    "avg_precision": f"{_with(*SUITE)} SELECT {KEYS}, {r8('pr_auc', 'pr_auc')} FROM suite",
    "roc_points": f"{_with(*SCORED, *_ranks(PAIR))} SELECT {PAIR}, {r8('proba_up', 'threshold')}, {r8('fps / q', 'fpr')}, {r8('tps / p', 'tpr')} FROM score_runs",
    "pr_points": f"{_with(*SCORED, *_ranks(PAIR))} SELECT {PAIR}, {r8('proba_up', 'threshold')}, {r8('tps / p', 'recall')}, {r8('tps / (tps + fps)', 'precision')}, {r8('p / (p + q)', 'base_rate')} FROM score_runs",
    "confusion": f"{_with(*SCORED)} SELECT {PAIR}, CAST(target AS BIGINT) AS actual, count(*) FILTER (prediction = 0) AS predicted_down, count(*) FILTER (prediction = 1) AS predicted_up FROM scored GROUP BY ALL",
    "fold_aggregate": f"""{_with(*SUITE, _LONG)}, a AS (SELECT candidate, ticker, metric, count(value) AS n_values, avg(value) AS mean, stddev_samp(value) AS s, min(value) AS least, max(value) AS greatest FROM long_ GROUP BY 1, 2, 3)
        SELECT candidate, ticker, metric, n_values, {r8('mean', 'mean')}, {r8('CASE WHEN n_values = 1 THEN 0 ELSE s END', 'std')}, {r8('least', 'least')}, {r8('greatest', 'greatest')},
        {r8(f'mean - {_T} * s / sqrt(n_values)', 'ci_low')}, {r8(f'mean + {_T} * s / sqrt(n_values)', 'ci_high')} FROM a""",
    "class_balance": f"""{_with(*DATASET)} SELECT ticker, year(session) AS year, count(*) AS n, {r8('avg(target)', 'up_rate')} FROM rows_ GROUP BY 1, 2
        UNION ALL SELECT ticker, CAST(0 AS BIGINT), count(*), {r8('avg(target)', 'up_rate')} FROM rows_ GROUP BY 1""",
    "holdout_spans": f"""{_with(*DATASET)}, h AS (SELECT ticker, CAST(floor(b.n_rows * 0.6::DOUBLE) AS BIGINT) AS first_end, b.dev_end FROM bounds b),
        p AS (SELECT r.ticker, session, CASE WHEN row_idx < first_end THEN 'train' WHEN row_idx > first_end AND row_idx < dev_end THEN 'validation' WHEN row_idx > dev_end THEN 'test' END AS part FROM rows_ r JOIN h USING (ticker))
        SELECT ticker, part, strftime(min(session), '%Y-%m-%d') AS first_session, strftime(max(session), '%Y-%m-%d') AS last_session, count(*) AS n FROM p WHERE part IS NOT NULL GROUP BY 1, 2""",
    "quality_sessions": f"""{_with(DAILY, _DEFECTS, _MOVES.format('defects'))}, k AS (SELECT ticker, strftime(session, '%Y-%m-%d') AS day, abs(move) > 0.04 AS large, volume = 0 AS silent FROM moved)
        SELECT ticker, coalesce(array_to_string(list_sort(list(day) FILTER (large))[1:20], ','), '') AS large_moves, coalesce(array_to_string(list_sort(list(day) FILTER (silent))[1:5], ','), '') AS zero_volume FROM k GROUP BY 1""",
    "bar_describe": f"{_with(DAILY)}, l AS (" + " UNION ALL ".join(f"SELECT ticker, '{c}' AS name, {c} AS x FROM bars" for c in ("open", "high", "low", "close", "volume")) + f""") SELECT ticker, name, count(x) AS n, {r8('avg(x)', 'mean')}, {r8('stddev_samp(x)', 'std')},
        {r8('min(x)', 'least')}, {r8('max(x)', 'greatest')}, {r8('quantile_cont(x, 0.25)', 'q1')}, {r8('quantile_cont(x, 0.5)', 'median')}, {r8('quantile_cont(x, 0.75)', 'q3')} FROM l GROUP BY 1, 2""",
    "feature_correlation": f"{_with(*DATASET)}, l AS (" + " UNION ALL ".join(f"SELECT ticker, row_idx, {i} AS i, '{n}' AS feature, {n} AS x FROM rows_" for i, n in enumerate(ALL)) + f""")
        SELECT a.ticker, a.feature, b.feature AS other, {r8(_CORR('a.x', 'b.x'), 'correlation')} FROM l a JOIN l b ON a.ticker = b.ticker AND a.row_idx = b.row_idx AND a.i < b.i GROUP BY 1, 2, 3""",
    "calibration_bins": f"{_with(*SCORED, BINS)} SELECT {PAIR}, bin_id, {r8('bin_id / 10.0::DOUBLE', 'lower')}, {r8('(bin_id + 1) / 10.0::DOUBLE', 'upper')}, n, {r8('mean_predicted', 'mean_predicted')}, {r8('observed', 'observed')}, {r8('gap', 'gap')}, {r8('gap * gap', 'squared_gap')} FROM gaps_",
    "ece_mce": f"{_with(*SCORED, BINS)} SELECT {PAIR}, CAST(sum(n) AS BIGINT) AS n, {r8('sum(n * gap) / sum(n)', 'ece')}, {r8('max(gap)', 'mce')} FROM gaps_ GROUP BY ALL",
    "calibration_report": f"""{_with(*SCORED, BINS)}, e AS (SELECT {PAIR}, CAST(sum(n) AS BIGINT) AS n, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM gaps_ GROUP BY ALL),
        s AS (SELECT {PAIR}, avg((proba_up - target) * (proba_up - target)) AS brier, avg(target) * (1 - avg(target)) AS base_rate_brier, min(proba_up) AS least, max(proba_up) AS greatest, avg(proba_up) AS mean, stddev_samp(proba_up) AS std FROM scored GROUP BY ALL)
        SELECT {PAIR}, n, {', '.join(r8(c, c) for c in ('brier', 'base_rate_brier', 'least', 'greatest', 'mean', 'std', 'ece', 'mce'))} FROM s JOIN e USING ({PAIR})""",
    "probability_histogram": f"""{_with(*SCORED)}, s AS (SELECT *, min(proba_up) OVER (PARTITION BY {PAIR}) AS low, max(proba_up) OVER (PARTITION BY {PAIR}) AS high FROM scored)
        SELECT {PAIR}, CAST(least(coalesce(floor((proba_up - low) / nullif(high - low, 0) * 40), 0), 39) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY ALL""",
    "threshold_scan": f"{_with(*SCAN)} SELECT {PAIR}, {r8('threshold', 'threshold')}, {r8('accuracy', 'accuracy')}, {r8('balanced_accuracy', 'balanced_accuracy')}, {r8('f1_macro', 'f1_macro')} FROM scan",
    "best_threshold": f"{_with(*SCAN)}, o AS (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY round(balanced_accuracy, 8) DESC NULLS LAST, threshold) AS k FROM scan) SELECT {PAIR}, {r8('threshold', 'threshold')}, {r8('balanced_accuracy', 'score')} FROM o WHERE k = 1",
    "net_sharpe_scan": f"""{_with(*SCAN)}, e AS (SELECT candidate, ticker, threshold, CASE WHEN proba_up >= threshold THEN future_return - 0.001::DOUBLE ELSE 0 END AS net FROM scored, cuts WHERE candidate = 'reversion')
        SELECT {PAIR}, {r8('threshold', 'threshold')}, {r8('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)', 'net_sharpe')} FROM e GROUP BY candidate, ticker, e.threshold""",
    "positions": f"{_with(*_days('next_open'))} SELECT strategy, ticker, {DAY}, position FROM days",
    "cost_intraday": f"{_with(*_days('next_open'))} SELECT strategy, ticker, {DAY}, {r8('cost', 'cost')} FROM days",
    "cost_c2c": f"{_with(*_days('close_to_close'))} SELECT strategy, ticker, {DAY}, {r8('cost', 'cost')} FROM days",
    "equity_curve": f"{_with(*_days('next_open'))} SELECT strategy, ticker, {DAY}, {r8('net_return', 'net_return')}, {r8('ln(equity)', 'log_equity')} FROM days",
    "drawdown": f"{_with(*_days('next_open'))} SELECT strategy, ticker, {DAY}, {r8('drawdown', 'drawdown')} FROM days",
    "trades_blocks": f"{_with(*_days('close_to_close'), TRADES_BLOCK)} SELECT strategy, ticker, strftime(entry, '%Y-%m-%d') AS entry, {r8('trade_return', 'trade_return')} FROM trades",
    "trades_intraday": f"{_with(*_days('next_open'), TRADES_OPEN)} SELECT strategy, ticker, strftime(entry, '%Y-%m-%d') AS entry, {r8('trade_return', 'trade_return')} FROM trades",
    "backtest_metrics": f"{_with(*_days('next_open'), TRADES_OPEN, ECONOMICS)} SELECT strategy, ticker, n_sessions, n_active, n_position_changes, n_trades, only_wins, {', '.join(r8(c, c) for c in _FLOATS)} FROM economics",
    "backtest_compare": f"{_with(*_days('close_to_close'), TRADES_BLOCK, ECONOMICS)} SELECT strategy, ticker, n_trades, {', '.join(r8(c, c) for c in ('cumulative_return', 'sharpe', 'max_drawdown', 'total_cost', 'profit_factor'))} FROM economics",
    "buy_and_hold": f"{_with(*DATASET, _HOLD, *_daily('held', _C2C_COST, _SW))} SELECT ticker, {DAY}, {r8('net_return', 'net_return')}, {r8('cost', 'cost')}, {r8('ln(equity)', 'log_equity')} FROM days",
    "block_bootstrap": f"{_with(*_days('next_open'), *_boot(_NUMBERED, ('mean_daily', 'annualized', 'sharpe')))} {_BOOT_OUT}",
    "block_bootstrap_in_ranges": f"{_with(*_days('next_open'), *_boot(_NUMBERED, ('mean_daily', 'annualized', 'sharpe')))} {_BOOT_OUT}",
    "bootstrap_difference": f"{_with(*_days('next_open'), *_boot(_PAIRED, ('mean_daily',)))} {_BOOT_OUT}",
    "candidate_rank": f"""{_with(*SUITE)}, m AS (SELECT ticker, candidate, count(balanced_accuracy) AS n_folds, {', '.join(f'avg({c}) AS mean_{n}, coalesce(stddev_samp({c}), 0) AS std_{n}' for n, c in _SHORT.items())},
            CASE WHEN candidate = 'reversion' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS complexity,
            CASE candidate WHEN 'reversion' THEN [20.0::DOUBLE] WHEN 'always_up' THEN [1.0::DOUBLE] WHEN 'majority_class' THEN [0.0::DOUBLE] ELSE CAST([] AS DOUBLE[]) END AS simplicity FROM suite GROUP BY 1, 2)
        SELECT ticker, candidate, n_folds, complexity, {', '.join(r8(f'{k}_{n}', f'{k}_{n}') for n in _SHORT for k in ('mean', 'std'))},
        {r8(f"mean_ba - {_T.replace('n_values', 'n_folds')} * std_ba / sqrt(n_folds)", 'low_ba')}, {r8(f"mean_ba + {_T.replace('n_values', 'n_folds')} * std_ba / sqrt(n_folds)", 'high_ba')},
        row_number() OVER (PARTITION BY ticker ORDER BY round(mean_ba, 8) DESC NULLS LAST, round(std_ba, 8) NULLS LAST, round(mean_log_loss, 8) NULLS LAST, complexity, simplicity, candidate) AS rank FROM m""",
    "edge_gate": f"""{_with(*SUITE, SUMMARY)}, b AS (SELECT ticker, candidate AS baseline, mean_ba AS baseline_ba, row_number() OVER (PARTITION BY ticker ORDER BY round(mean_ba, 8) DESC NULLS LAST, CASE candidate WHEN 'majority_class' THEN 0 WHEN 'always_up' THEN 1 WHEN 'random' THEN 2 ELSE 3 END) AS k FROM summary WHERE candidate <> 'reversion'),
        g AS (SELECT m.ticker, m.candidate AS model, m.mean_ba AS model_ba, m.mean_auc, m.mean_mcc, baseline, baseline_ba, m.mean_ba - baseline_ba AS margin,
            (SELECT count(*) FROM suite x JOIN suite y ON x.ticker = y.ticker AND x.fold = y.fold WHERE x.ticker = m.ticker AND x.candidate = 'reversion' AND y.candidate = b.baseline AND round(x.balanced_accuracy, 8) > round(y.balanced_accuracy, 8)) AS fold_wins
            FROM summary m JOIN b ON m.ticker = b.ticker AND b.k = 1 WHERE m.candidate = 'reversion')
        SELECT ticker, model, {r8('model_ba', 'model_ba')}, {r8('mean_auc', 'mean_auc')}, {r8('mean_mcc', 'mean_mcc')}, baseline, {r8('baseline_ba', 'baseline_ba')}, fold_wins, {r8('margin', 'margin')},
            round(margin, 8) >= 0.01 AS margin_ok, fold_wins >= 4 AS wins_ok, coalesce(mean_auc > 0.5, false) AS auc_ok, coalesce(mean_mcc > 0, false) AS mcc_ok,
            round(margin, 8) >= 0.01 AND fold_wins >= 4 AND coalesce(mean_auc > 0.5, false) AND coalesce(mean_mcc > 0, false) AS edge FROM g""",
    "lookback_sequences": f"{_with(*DATASET)} SELECT ticker, strftime(session, '%Y-%m-%d') AS session, CAST(5 AS BIGINT) AS length, {r8('total', 'total')} FROM (SELECT ticker, session, {roll('count(*)', 5)} AS n, {roll('sum(return_1d + intraday_range)', 5)} AS total FROM rows_) WHERE n = 5",
    "overnight_variance": f"{_with(DAILY)}, s AS (SELECT ticker, {div('open', lag('close', 1))} - 1 AS night, close / open - 1 AS day FROM bars) SELECT ticker, {r8('var_samp(night) / (var_samp(night) + var_samp(day))', 'overnight_share')} FROM s WHERE night IS NOT NULL GROUP BY 1",
    "lag_autocorrelation": f"{_with(DAILY, RET)}, b AS (" + " UNION ALL ".join(f"SELECT ticker, CAST({k} AS BIGINT) AS lag, ret, {lag('ret', k)} AS before FROM returned" for k in (1, 2, 3, 5, 10)) + f") SELECT ticker, lag, {r8(_CORR('ret', 'before'), 'autocorrelation')} FROM b WHERE ret IS NOT NULL AND before IS NOT NULL GROUP BY 1, 2",
    "feature_target_correlation": f"{_with(*DATASET)}, b AS (" + " UNION ALL ".join(f"SELECT ticker, '{n}' AS feature, {n} AS x, CAST(target AS DOUBLE) AS y FROM rows_" for n in ALL) + f") SELECT ticker, feature, {r8(_CORR('x', 'y'), 'correlation')} FROM b GROUP BY 1, 2",
    "rolling_feature_correlation": f"{_with(*DATASET)}, t AS (SELECT *, CAST(target AS DOUBLE) AS y FROM rows_) SELECT ticker, {DAY}, {r8('CASE WHEN n = 252 THEN c / nullif(s, 0) END', 'correlation')} FROM (SELECT ticker, session, {roll('count(*)', 252)} AS n, {roll('covar_samp(return_1d, y)', 252)} AS c, {roll('stddev_samp(return_1d)', 252)} * {roll('stddev_samp(y)', 252)} AS s FROM t)",
    "hourly_strategy": f"""{_with(HOURLY, RET)}, wide AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SMALL.items())}, {lag('close', 1)} AS before, {_FR} AS future_return FROM returned),
        held AS (SELECT 'last_direction' AS strategy, ticker, session, CAST(close / open - 1 > 0 AS INT)::DOUBLE AS position, future_return FROM wide WHERE future_return IS NOT NULL AND before IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in _SMALL)}),
        {', '.join(_daily('held', 'abs(position) * 0.001::DOUBLE', _SW))}
        SELECT ticker, count(*) AS n, {r8('arg_max(equity, session) - 1', 'cumulative_return')}, {r8('avg(position)', 'exposure')}, {r8('min(drawdown)', 'max_drawdown')} FROM days GROUP BY 1""",
}
