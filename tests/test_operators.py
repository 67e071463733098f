"""Operators on tiny hand-computed frames, and causality."""

from __future__ import annotations

import math
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, ratio
from tidemark.operators import backtest as bt
from tidemark.operators import baselines as bl
from tidemark.operators import benchmark as bm
from tidemark.operators import bootstrap as bs
from tidemark.operators import calibration as cal
from tidemark.operators import features as ft
from tidemark.operators import folds as fo
from tidemark.operators import labels as lb
from tidemark.operators import metrics as mt
from tidemark.operators import quality as ql
from tidemark.operators import ranking as rk
from tidemark.sources import panels

BAR = "ticker string, session date, open double, high double, low double, close double, volume double"


def bars(spark, closes, opens=None, ticker="x"):
    opens = opens or closes
    rows = [(ticker, date.fromordinal(735000 + i), float(o), float(max(o, c)), float(min(o, c)), float(c), 100.0 + i) for i, (o, c) in enumerate(zip(opens, closes))]
    return spark.createDataFrame(rows, BAR)


def column(df, name, by="session"):
    return [r[name] for r in df.orderBy(by).collect()]


def scored(spark, rows):
    return spark.createDataFrame([("m", "x", f, date.fromordinal(735000 + i), float(p), int(p >= 0.5), y, float(r)) for i, (f, p, y, r) in enumerate(rows)], "candidate string, ticker string, fold long, session date, proba_up double, prediction int, target int, future_return double")


def near(a, b, tol=1e-9):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= tol)


def test_ratio_and_finite(spark):
    row = spark.createDataFrame([(1.0, 0.0, float("nan"), float("inf"))], "a double, z double, n double, i double").select(ratio("a", "z"), finite("n"), finite("i"), finite("a")).first()
    assert tuple(row) == (None, None, None, 1.0)


def test_bars_of_ticks(spark):
    ticks = spark.createDataFrame([("a", 1, 3.0, 2.0), ("a", 2, 1.0, 1.0), ("a", 3, 2.0, 4.0)], "t string, k int, p double, q double")
    b = panels.bars(ticks, F.col("t"), F.lit("2020-01-02").cast("date"), F.col("p"), F.col("q"), F.col("k")).first()
    assert (b["open"], b["high"], b["low"], b["close"], b["volume"]) == (3.0, 3.0, 1.0, 2.0, 7.0)


def test_normalize_and_flatten(spark):
    raw = spark.createDataFrame([("2020-01-02T23:00:00-05:00", "1", "2", "x", "1.5", "10"), ("2020-01-03", "1", "2", "1", None, "10")], "Date string, Open string, High string, Low string, Close string, Volume string")
    rows = panels.normalize(raw, "t").collect()
    assert len(rows) == 1 and str(rows[0]["session"]) == "2020-01-02" and rows[0]["low"] is None
    assert panels.flatten_columns([("Close", "T"), ("T", "Open"), "Volume"], "T") == ["Close", "Open", "Volume"]
    with pytest.raises(ValueError):
        panels.flatten_columns([("Close", "T"), ("T", "Close")], "T")
    with pytest.raises(ValueError):
        panels.normalize(raw.drop("Close"))


def test_duplicates(spark):
    p = bars(spark, [1, 2, 3])
    same, n = ql.resolve_duplicates(p.unionByName(p.limit(2)))
    assert n == 2 and same.count() == 3
    with pytest.raises(ValueError):
        ql.resolve_duplicates(p.unionByName(p.limit(1)), collapse=False)
    with pytest.raises(ValueError):
        ql.resolve_duplicates(p.unionByName(p.withColumn("close", F.col("close") + 1)))


def test_validate(spark):
    p = bars(spark, [10, 11, 12, 20])
    assert ql.validate(p, 3)[0]["n_large_moves"] == 1
    for broken in (p.withColumn("high", F.lit(1.0)), p.withColumn("close", F.lit(-1.0)), p.unionByName(p), p.drop("low"), p.withColumn("open", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            ql.validate(broken, 3)
    with pytest.raises(ValueError):
        ql.validate(p, 5)


def test_guards(spark):
    with pytest.raises(ValueError):
        ql.assert_no_leakage(["a", "future_return"])
    with pytest.raises(ValueError):
        ql.assert_finite(spark.createDataFrame([(1.0, None)], "a double, b double"), ["a", "b"])
    closes = {date(2026, 3, 5): datetime(2026, 3, 5, 21, tzinfo=UTC)}
    decide = lambda hour, **k: ql.decide_partial_bar(date(2026, 3, 5), closes, datetime(2026, 3, 5, hour, tzinfo=UTC), **k).drop
    assert decide(20) and not decide(21) and not decide(20, enabled=False) and not decide(20, explicit_end=date(2026, 3, 6))
    assert not ql.decide_partial_bar(date(2026, 3, 7), closes, datetime(2026, 3, 7, 10, tzinfo=UTC)).drop


def test_features_by_hand(spark):
    p = bars(spark, [100, 110, 99, 99, 120, 90])
    f = ft.build_features(p, ft.FeatureConfig(returns=(1, 2), momentum=(2,), up_days=(2,), averages=(2, 3), volatility=(2, 3), volume=2)).orderBy("session").collect()
    assert f[0]["return_1d"] is None and near(f[2]["return_2d"], -0.01) and near(f[2]["momentum_2d"], 0.1)
    assert f[1]["positive_days_last_2"] is None and f[2]["positive_days_last_2"] == 0.5 and f[3]["positive_days_last_2"] == 0.0
    assert near(f[1]["close_to_sma_2"], 110 / 105 - 1) and near(f[2]["sma_2_to_sma_3"], 104.5 / 103 - 1)
    assert f[1]["volatility_2d"] is None and near(f[2]["volatility_2d"], abs(0.1 - -0.1) / math.sqrt(2))
    assert f[0]["close_position_in_range"] == 0.5
    assert near(f[1]["volume_zscore_2"], 0.5 / math.sqrt(0.5))


def test_default_feature_counts():
    assert len(ft.feature_columns()) == 29 and len(ft.feature_columns(ft.FeatureConfig(benchmark=True))) == 34
    assert ft.FeatureConfig().warm_up() == 50 and ft.manifest()["features"][0] == "return_1d"


def test_features_do_not_see_the_future(spark):
    closes = [100 + (i * 7919 % 13) for i in range(80)]
    a = ft.build_features(bars(spark, closes)).orderBy("session").limit(60).collect()
    b = ft.build_features(bars(spark, closes[:60] + [5.0] * 20)).orderBy("session").limit(60).collect()
    assert a == b


def test_labels_by_hand(spark):
    c2c = lb.with_labels(bars(spark, [100, 101, 99]), lb.LabelConfig("close_to_close"))
    assert column(c2c, "target") == [1, 0, None] and near(column(c2c, "future_return")[1], 99 / 101 - 1)
    o2c = lb.with_labels(bars(spark, [100, 110, 90], [99, 100, 100]))
    assert [None if x is None else round(x, 9) for x in column(o2c, "future_return")] == [0.1, -0.1, None]
    flat = lb.with_labels(bars(spark, [100, 100]), lb.LabelConfig("close_to_close"))
    assert column(flat, "target") == [0, None]
    assert lb.drop_unlabeled_tail(bars(spark, [1, 2, 3]), 3).count() == 0
    with pytest.raises(ValueError):
        lb.LabelConfig("open_to_close", 2)


def test_folds(spark):
    sizes = spark.createDataFrame([("x", 4097)], "ticker string, n_rows long")
    b = fo.bounds(sizes).first()
    assert (b["dev_end"], b["test_start"], b["n_test"]) == (3277, 3278, 819)
    folds = [r.asDict() for r in fo.walk_forward(spark.createDataFrame([("x", 3277)], "ticker string, n_rows long")).orderBy("fold").collect()]
    assert [f["train_end"] for f in folds] == [546 * k for k in range(1, 6)] and folds[-1]["eval_end"] == 3277 and folds[0]["eval_end"] == 547 + 546
    fo.assert_causal(folds, 1)
    with pytest.raises(ValueError):
        fo.assert_causal([{**folds[0], "eval_start": folds[0]["train_end"]}], 1)
    assert fo.walk_forward(sizes.withColumn("n_rows", F.lit(3).cast("long"))).count() == 0
    with pytest.raises(ValueError):
        fo.SplitConfig(train=0.7)


def test_baselines(spark):
    rows = [("x", 1, date.fromordinal(735000 + i), i, 0.1 if i % 2 else -0.1, int(i < 7), 0.01) for i in range(10)]
    df = spark.createDataFrame(rows, "ticker string, fold long, session date, row_idx long, open_to_close_return double, target int, future_return double")
    out = bl.predicted(df.join(bl.fitted(df, ("ticker", "fold"), "open_to_close_return"), ["ticker", "fold"]), "open_to_close_return").collect()
    by = {n: [r for r in out if r["candidate"] == n] for n in bl.BASELINES}
    assert all(near(r["proba_up"], 0.7) and r["prediction"] == 1 for r in by["majority_class"])
    assert all(near(r["proba_up"], 0.6 if r["row_idx"] % 2 else 0.8) for r in by["last_direction"])
    assert {r["prediction"] for r in by["random"]} == {0, 1}


def test_metrics_by_hand(spark):
    df = scored(spark, [(1, 0.9, 1, 0), (1, 0.8, 0, 0), (1, 0.8, 1, 0), (1, 0.3, 0, 0), (1, 0.2, 1, 0)])
    m = mt.metric_suite(df).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (2, 1, 1, 1) and near(m["accuracy"], 0.6) and near(m["balanced_accuracy"], (2 / 3 + 1 / 2) / 2)
    pairs = [(a, b) for a in (0.9, 0.8, 0.2) for b in (0.8, 0.3)]
    assert near(m["roc_auc"], sum((a > b) + (a == b) / 2 for a, b in pairs) / 6)
    assert near(m["pr_auc"], 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    one = mt.metric_suite(scored(spark, [(1, 0.9, 1, 0), (1, 0.1, 1, 0)])).first()
    assert one["roc_auc"] is None and one["mcc"] is None and one["balanced_accuracy"] == 0.5


def test_t_interval(spark):
    df = spark.createDataFrame([("a", v) for v in (0.50, 0.51, 0.52, 0.53, 0.54)] + [("b", 1.0), ("c", None)], "k string, value double")
    r = {x["k"]: x for x in mt.t_interval(df, ("k",)).collect()}
    half = 2.776445105 * math.sqrt(0.00025) / math.sqrt(5)
    assert near(r["a"]["ci_low"], 0.52 - half, 1e-8) and r["b"]["std"] == 0 and r["b"]["ci_low"] is None and r["c"]["n_values"] == 0
    exact = {1: 12.7062047362, 2: 4.3026527297, 3: 3.1824463053, 4: 2.7764451052, 9: 2.2621571628, 30: 2.0422724563, 120: 1.9799304051, 1000: 1.9623390808}
    assert all(near(mt.t_quantile(d), q, 1e-8) for d, q in exact.items())
    degrees = spark.createDataFrame([(d,) for d in (0, 1, 4, 31, 200, 201, 500, 1000)], "d int")
    got = {r["d"]: r["t"] for r in degrees.select("d", mt.t_column(F.col("d")).alias("t")).collect()}
    assert got.pop(0) is None and all(near(t, mt.t_quantile(d), 1e-9) for d, t in got.items())
    assert not mt.excludes(None, None, 0) and mt.excludes(0.1, 0.2, 0)


def test_calibration(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.05, 0.15, 0.5, 0.95, 1.0)], "proba_up double")
    assert [r[0] for r in df.select(cal.bin_id()).collect()] == [0, 0, 1, 5, 9, 9]
    with pytest.raises(Exception):
        spark.createDataFrame([(1.5,)], "proba_up double").select(cal.bin_id()).collect()
    e = cal.calibration_errors(scored(spark, [(1, 0.1, 0, 0), (1, 0.1, 1, 0), (1, 0.9, 1, 0)]), ("candidate",)).first()
    assert near(e["ece"], (2 * 0.4 + 0.1) / 3) and near(e["mce"], 0.4)


def test_threshold_ties_go_low(spark):
    df = scored(spark, [(1, 0.2, 0, 0), (1, 0.8, 1, 0)])
    best = cal.best_threshold(cal.threshold_scan(df, ("candidate",)), ("candidate",)).first()
    assert best["threshold"] == 0.3 and best["score"] == 1.0
    none = cal.best_threshold(cal.threshold_scan(df, ("candidate",)).withColumn("balanced_accuracy", F.lit(None).cast("double")), ("candidate",)).first()
    assert none["threshold"] == 0.5


def positions(spark, held, returns):
    rows = [("s", "x", date.fromordinal(735000 + i), float(p), float(r)) for i, (p, r) in enumerate(zip(held, returns))]
    return spark.createDataFrame(rows, "strategy string, ticker string, session date, position double, future_return double")


def test_costs(spark):
    d = bt.daily(positions(spark, [1, 1, 0, 1], [0.1, 0.1, 0, -0.2]))
    assert [round(c, 9) for c in column(d, "cost")] == [0.001, 0.001, 0.0, 0.001]
    close = bt.BacktestConfig(mode="close_to_close", one_way_bps=7)
    d = bt.daily(positions(spark, [1, 1, 1, 0, 0], [0] * 5), close)
    assert [round(c, 9) for c in column(d, "cost")] == [0.0007, 0, 0, 0.0007, 0]


def test_trades_and_metrics(spark):
    free = bt.BacktestConfig(mode="close_to_close", one_way_bps=0)
    d = bt.daily(positions(spark, [1, 1, 0, 1], [0.1, 0.1, 0.0, -0.2]), free)
    assert [round(x, 9) for x in column(bt.trades(d, free), "trade_return", "entry")] == [0.21, -0.2]
    intraday = bt.BacktestConfig(round_trip_bps=0)
    m = bt.economic_metrics(bt.daily(positions(spark, [1] * 4, [0.10, -0.05, 0.20, -0.01]), intraday), intraday).first()
    assert near(m["best_trade"], 0.2) and near(m["worst_trade"], -0.05) and near(m["median_trade"], 0.045) and m["trade_win_rate"] == 0.5 and near(m["profit_factor"], 5.0)
    flat = bt.economic_metrics(bt.daily(positions(spark, [0, 0], [0.1, 0.1])), bt.BacktestConfig()).first()
    assert flat["n_trades"] == 0 and flat["sharpe"] is None and flat["cumulative_return"] == 0


def test_drawdown_starts_at_first_equity(spark):
    d = bt.daily(positions(spark, [1, 1], [-0.5, 0.0]), bt.BacktestConfig(round_trip_bps=0))
    assert column(d, "drawdown") == [0.0, 0.0]


def test_short_positions(spark):
    df = scored(spark, [(1, 0.6, 1, 0), (1, 0.5, 1, 0), (1, 0.4, 1, 0)])
    assert column(df.withColumn("position", bt.position(bt.BacktestConfig(allow_short=True))), "position") == [1.0, 0.0, -1.0]
    with pytest.raises(ValueError):
        bt.BacktestConfig(allow_short=True, threshold=0.4, short_threshold=0.45)


def test_bootstrap(spark):
    series = spark.createDataFrame([("k", i, 0.001 * ((i * 37) % 11 - 5)) for i in range(100)], "key string, idx long, value double")
    full = bs.resampled(series, 20, 7).groupBy("sample").count().collect()
    assert len(full) == 20 and all(r["count"] == 100 for r in full)
    r = {x["statistic"]: x for x in bs.block_bootstrap(series, 60, 7).collect()}
    assert r["mean_daily"]["low"] <= r["mean_daily"]["point"] <= r["mean_daily"]["high"] and r["sharpe"]["n_draws"] == 60
    text = lambda rows: [[f"{v:.9f}" if isinstance(v, float) else v for v in x] for x in rows]
    assert text(bs.block_bootstrap(series, 60, 7).orderBy("statistic").collect()) == text(bs.block_bootstrap(series.repartition(3), 60, 7).orderBy("statistic").collect())
    # running sums give what the resamples spelled out give, also for series that are ruined or never change
    others = spark.createDataFrame([("ruin", i, -1.0 if i == 3 else 0.01) for i in range(30)] + [("same", i, 0.002) for i in range(25)] + [("one", 0, 0.5)], "key string, idx long, value double")
    every = series.unionByName(others)
    plain = {(x["key"], x["sample"]): x for x in bs.statistics(bs.resampled(every, 40, 7), ("key", "sample")).collect()}
    quick = {(x["key"], x["sample"]): x for x in bs.draw_statistics(every, 40, 7).collect()}
    assert plain.keys() == quick.keys()
    for k, x in plain.items():
        assert near(x["mean_daily"], quick[k]["mean_daily"], 1e-12) and near(x["annualized"], quick[k]["annualized"], 1e-9)
        assert k[0] == "same" or near(x["sharpe"], quick[k]["sharpe"], 1e-8)
        assert k[0] != "same" or quick[k]["sharpe"] is None
    dated = lambda rows: spark.createDataFrame([("k", date.fromordinal(735000 + i), v) for i, v in rows], "key string, session date, value double")
    with pytest.raises(ValueError):
        bs.bootstrap_difference(dated([(1, 0.1)]), dated([(2, 0.1)]))
    one = bs.resampled(series, 3, 1000).groupBy("sample").agg(F.sum("value").alias("s")).collect()
    assert all(near(x["s"], series.agg(F.sum("value")).first()[0], 1e-9) for x in one)


def test_ranking_order(spark):
    simple = [("f", [0.1, 9.0]), ("g", [0.1, 8.0]), ("h", [0.01])]
    rows = [("x", "b", 0.5, 0.1, 0.6, 1, [1.0]), ("x", "a", 0.5, 0.1, 0.6, 1, [1.0]), ("x", "c", None, 0.0, 0.1, 1, []), ("x", "d", 0.5, 0.1, 0.6, 0, [9.0]), ("x", "e", 0.6, 0.9, 0.9, 9, [])]
    rows += [("x", name, 0.5, 0.1, 0.6, 1, s) for name, s in simple]
    df = spark.createDataFrame(rows, "ticker string, candidate string, mean_ba double, std_ba double, mean_log_loss double, complexity long, simplicity array<double>")
    assert [r["candidate"] for r in rk.ranked(df).orderBy("rank").collect()] == ["e", "d", "h", "g", "f", "a", "b", "c"]


def test_edge_gate(spark):
    def suite(scores, **other):
        rows = [("x", c, f, s, 0.6, other.get("auc", 0.6), other.get("mcc", 0.1), 0.2, s) for c, each in scores.items() for f, s in enumerate(each, 1)]
        return spark.createDataFrame(rows, "ticker string, candidate string, fold long, balanced_accuracy double, log_loss double, roc_auc double, mcc double, brier double, accuracy double")

    base = {"one": [0.50, 0.50, 0.50, 0.50, 0.50], "two": [0.50, 0.50, 0.50, 0.50, 0.50], "low": [0.4] * 5}
    gate = lambda model, names=("two", "one", "low"), **o: rk.edge_gate(suite(base | {"m": model}, **o), ["m"], names).first().asDict()
    good = gate([0.52, 0.52, 0.52, 0.52, 0.40 + 0.10])
    assert good["edge"] and good["baseline"] == "two" and good["fold_wins"] == 4  # of equal means the one named first
    assert gate([0.52] * 5, ("one", "two"))["baseline"] == "one"
    assert not gate([0.505] * 5)["margin_ok"] and not gate([0.6, 0.6, 0.6, 0.5, 0.5])["wins_ok"]
    assert not gate([0.6] * 5, auc=0.5)["edge"] and not gate([0.6] * 5, mcc=0.0)["edge"]
    none = gate([0.9] * 5, ())
    assert not none["edge"] and none["baseline"] is None and "no baselines" in rk.gate_reason(none)
    # the named winner is gated, not the best of all models
    both = suite(base | {"m": [0.52] * 5, "better": [0.9] * 5})
    assert rk.edge_gate(both, ["m"], ("one",)).first()["model"] == "m" and rk.edge_gate(both, ["m", "better"], ("one",)).first()["model"] == "better"
    assert "edge: m" in rk.gate_reason(good) and "margin" in rk.gate_reason(gate([0.5] * 5))


def test_benchmark(spark):
    p = bars(spark, [1, 2, 3, 4]).unionByName(bars(spark, [1, 2, 3, 4], ticker="b").limit(3))
    asset, bench = bm.split_benchmark(p, "x", "b")
    a = bm.alignment_audit(asset, bench).first()
    assert (a["n_before"], a["n_after"], a["n_lost"]) == (4, 3, 1) and bm.lost_sessions(asset, bench).count() == 1
    with pytest.raises(ValueError):
        bm.align_checked(asset, bench)
    assert bm.resolve_signal(asset, "9999-01-01") == str(date.fromordinal(735003))
    with pytest.raises(ValueError):
        bm.resolve_signal(asset, "9999-01-01", "9998-01-01")


def test_stream_equals_batch(spark, sf):
    from tidemark.streaming.bars import replay_events

    batch = panels.hourly(spark, sf).orderBy("ticker", "session").collect()
    assert replay_events(spark, sf).select("ticker", "session", *panels.BAR_COLUMNS).orderBy("ticker", "session").collect() == batch


def test_stream_drops_late_ticks_and_repeats(spark, tmp_path):
    """Files are read one at a time: a tick behind the watermark is left out, and a repeated one counts once."""
    from tidemark.streaming.bars import once_only, streaming_bars

    schema = "ticker string, ts timestamp, price double, size double, order long"
    batches = [
        [("a", "2024-01-01 00:10", 1.0, 1.0, 1), ("a", "2024-01-01 00:20", 2.0, 1.0, 2), ("a", "2024-01-01 00:20", 2.0, 1.0, 2)],
        [("a", "2024-01-01 05:00", 9.0, 1.0, 3)],
        [("a", "2024-01-01 05:05", 8.5, 1.0, 7)],  # after a dropDuplicates the watermark rules late ticks out a batch later
        [("a", "2024-01-01 00:30", 50.0, 1.0, 4), ("a", "2024-01-01 05:10", 8.0, 1.0, 5)],
        [("z", "2024-01-03 00:00", 0.0, 0.0, 6)],
    ]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(t, datetime.fromisoformat(x), p, q, o) for t, x, p, q, o in rows], schema)
        made.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").glob("part-*"):
            (tmp_path / "stream").mkdir(exist_ok=True)
            target = f.rename(tmp_path / f"stream/{i}.parquet")
            import os

            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
    bars_ = streaming_bars(once_only(stream), lateness=None)
    query = bars_.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    out = {str(r["session"])[11:16]: (r["open"], r["close"], r["volume"]) for r in spark.read.schema(bars_.schema).parquet(str(tmp_path / "out")).collect()}
    assert out == {"00:00": (1.0, 2.0, 2.0), "05:00": (9.0, 8.5, 3.0)}


def test_holdout_is_causal(spark):
    parts = [r.asDict() for r in fo.holdout(spark.createDataFrame([("x", 100)], "ticker string, n_rows long")).collect()]
    fo.assert_holdout_causal(parts, 1)
    for broken in ({"part": "validation", "start": 60}, {"part": "test", "start": 79}, {"part": "test", "end": 81}):
        with pytest.raises(ValueError):
            fo.assert_holdout_causal([p | broken if p["part"] == broken["part"] else p for p in parts], 1)


def test_first_sessions(spark):
    p = bars(spark, [10, 20, 20, 40, 40]).withColumn("volume", F.when(F.col("close") == 20, 0.0).otherwise(1.0))
    r = ql.first_sessions(p, 0.25, 1, 1).first()
    assert r["large_moves"] == str(date.fromordinal(735001)) and r["zero_volume"] == str(date.fromordinal(735001))
    assert ql.first_sessions(bars(spark, [10, 10])).first()["large_moves"] == ""


def test_sources():
    vendor = panels.Vendor("mine", lambda *how: how)
    panels.register(vendor)
    try:
        assert panels.VENDORS["mine"] is vendor
        with pytest.raises(ValueError):
            panels.load(None, "nothing", "", "x", "2000-01-01")
    finally:
        del panels.VENDORS["mine"]


def test_vendor_gives_a_panel(spark):
    raw = spark.createDataFrame([("2020-01-02", "1", "2", "1", "2", "10"), ("2020-01-03", "1", "2", "1", "2", "10"), ("2020-01-06", "1", "2", "1", "2", "10")], "Date string, Open string, High string, Low string, Close string, Volume string")
    asked = []
    vendor = panels.Vendor("v", lambda *how: asked.append(how) or raw)
    panel = vendor.load("T", "2020-01-03", "2020-01-06", auto_adjust=False)
    assert [str(r["session"]) for r in panel.collect()] == ["2020-01-03"] and asked == [("T", "2020-01-03", "2020-01-06", "1d", False)]
    with pytest.raises(ValueError):
        panels.Vendor("v", lambda *how: raw.limit(0)).load("T", "2020-01-03")


def test_model_queries_take_every_ticker(spark, sf):
    from tidemark.plans.queries import QUERIES, _dataset

    tickers = {r["ticker"] for r in _dataset(spark, sf).select("ticker").distinct().collect()}
    assert len(tickers) > 1
    for name in ("logistic_oof", "feature_importance", "permutation_importance"):
        assert {r["ticker"] for r in QUERIES[name](spark, sf).select("ticker").distinct().collect()} == tickers, name


# ---- ranges and cells of long groups ----


def test_scans_over_ranges(spark):
    """Sums, products and maxima of a group that nearly all rows belong to, as one window gives them."""
    from pyspark.sql import Window

    from tidemark.functions import ranks
    from tidemark.functions.shared import Scratch

    rows = spark.range(3000).selectExpr("if(id % 60 = 0, 'b', 'a') as k", "id as i", "1 + cast(pmod(xxhash64(id), 200) - 100 as double) / 10000 as v")
    upto = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.k, r.i): (r.s, r.p, r.m) for r in rows.select("k", "i", F.sum("v").over(upto).alias("s"), F.product("v").over(upto).alias("p"), F.max("v").over(upto).alias("m")).collect()}
    with Scratch(spark, "test") as scratch:
        scans = {"s": ("sum", "v"), "p": ("product", "v"), "m": ("max", "v")}
        got = {(r.k, r.i): (r.s, r.p, r.m) for r in ranks.scanned(rows, ["k"], ["i"], scans, scratch).collect()}
        sums = {(r.k, r.i): (r.s, r.s_all) for r in ranks.running(rows, ["k"], ["i"], {"s": "v"}, scratch).collect()}
    assert got.keys() == want.keys() == sums.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k])) and all(abs(sums[k][0] - want[k][0]) < 1e-9 for k in want)
    assert all(abs(sums[k, i][1] - max(v[0] for (g, _), v in want.items() if g == k)) < 1e-6 for k, i in [("a", 1), ("b", 60)])


@pytest.mark.parametrize("cell_rows", [51, 70, 1000])
def test_features_of_cells(spark, sf, cell_rows):
    """Features from cells of any length are those of whole tickers."""
    from tidemark.functions.shared import Scratch

    panel = panels.daily(spark, sf).where("session < '1996-01-01'")
    read = lambda df: {(r["ticker"], r["session"]): [None if v is None else round(v, 9) for v in r[2:]] for r in df.collect()}
    with Scratch(spark, "test") as scratch:
        got = read(ft.build_features_in_cells(panel, scratch, cell_rows=cell_rows))
    assert got == read(ft.build_features(panel)) and len(got) > 300
    with pytest.raises(ValueError):
        ft.build_features_in_cells(panel, Scratch(spark, "none"), cell_rows=10)


def test_causality(spark):
    from tidemark.operators import folds as fo

    folds = spark.createDataFrame([("F", 1, 10, 11, 20), ("F", 2, 20, 20, 30), ("F", 3, 30, 29, 29)], "ticker string, fold long, train_end long, eval_start long, eval_end long")
    assert [(r.after_train, r.in_order, r.filled) for r in fo.causality(folds, 1).orderBy("fold").collect()] == [(True, True, True), (False, True, True), (False, False, False)]
    parts = spark.createDataFrame([("F", "train", 0, 5), ("F", "validation", 6, 6), ("F", "test", 6, 9)], "ticker string, part string, start long, end long")
    assert [(r.follows, r.filled) for r in fo.holdout_causality(parts, 1).orderBy("start", "end").collect()] == [(True, True), (True, False), (False, True)]
