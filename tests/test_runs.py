"""Configuration, artifacts, calendar, models, workflow and command line."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from datetime import UTC, date, datetime

import numpy as np
import pytest

from tidemark.functions import ranks, shared
from tidemark.operators import blocks, trees
from tidemark.operators import models as md
from tidemark.runs import artifacts, calendar, cli, config, workflow
from tidemark.sources import panels


def small(tmp_path, **over):
    base = {
        "data.ticker": "F",
        "data.min_rows": 200,
        "paths.runs": str(tmp_path / "runs"),
        "paths.cache": str(tmp_path / "cache"),
        "paths.processed": str(tmp_path / "processed"),
        "features.returns": [1, 2],
        "features.momentum": [5],
        "features.up_days": [5],
        "features.averages": [5, 10],
        "features.volatility": [5],
        "features.volume": 10,
        "split.n_splits": 3,
        "selection.gate.fold_wins": 2,
        "statistics.samples": 20,
    }
    return config.load(None, base | over)


def test_config(tmp_path):
    c = small(tmp_path)
    assert c.sha256() == small(tmp_path).sha256() != small(tmp_path, **{"split.gap": 2}).sha256()
    for bad in ({"labels.definition": "close_to_close"}, {"split.gap": 0}, {"data.min_rows": 3}, {"selection.gate.fold_wins": 9}, {"nothing.x": 1}, {"data.end": "1980-01-01"}):
        with pytest.raises(ValueError):
            small(tmp_path, **bad)
    (tmp_path / "base.yaml").write_text("split: {n_splits: 4, gap: 2}\nselection: {families: [logistic, gradient_boosting]}\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nsplit: {gap: 3}\nselection: {families: [logistic]}\n")
    loaded = config.load(tmp_path / "own.yaml", {"data.ticker": None})
    assert loaded.split.gap == 3 and loaded.split.n_splits == 4 and loaded.selection.families == ("logistic",)
    assert config.load(tmp_path / "own.yaml", {"split.gap": 5}).split.gap == 5
    assert config.from_dict(config.asdict(loaded)) == loaded
    for text in ("nothing: {x: 1}\n", "split: 3\n", "split: {gaps: 1}\n"):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(ValueError):
            config.load(tmp_path / "bad.yaml")
    (tmp_path / "deep.yaml").write_text("extends: own.yaml\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "deep.yaml")


def test_artifacts(tmp_path):
    c = small(tmp_path)
    run = artifacts.create_run(c, "one")
    with pytest.raises(artifacts.RunExists):
        artifacts.create_run(c, "one")
    assert artifacts.create_run(c).run_id != artifacts.create_run(c).run_id
    run.write_json("x.json", {"a": float("nan"), "b": math.inf, "c": np.float64(1.5), "d": {3, 1}, "e": date(2020, 1, 2)})
    assert run.read_json("x.json") == {"a": "NaN", "b": "Infinity", "c": 1.5, "d": [1, 3], "e": "2020-01-02"}
    digest = artifacts.sha256_path(run.path / "x.json")
    artifacts.verify(run.path / "x.json", digest)
    (run.path / "x.json").write_text("{}")
    with pytest.raises(artifacts.DigestMismatch):
        artifacts.verify(run.path / "x.json", digest)
    with pytest.raises(FileNotFoundError):
        artifacts.open_run(c, "none")


def test_lock(tmp_path):
    run = artifacts.create_run(small(tmp_path), "one")
    assert run.allow_final_test() is None
    run.write_lock(artifacts.Lock("h", "m", "a", "b", 3))
    for flags in ({}, {"rerun": True}, {"rerun": True, "reason": "  "}):
        with pytest.raises(artifacts.FinalTestDone):
            run.allow_final_test(**flags)
    again = run.write_lock(artifacts.Lock("h", "m", "a", "b", 3), run.allow_final_test(True, "bug"), "bug")
    assert again.reruns[0]["reason"] == "bug" and run.lock().reruns == again.reruns


def test_calendar():
    assert not calendar.is_session(date(2026, 3, 7)) and calendar.is_session(date(2026, 3, 5))
    for closed in (date(2024, 3, 29), date(2024, 5, 27), date(2024, 6, 19), date(2024, 7, 4), date(2024, 11, 28), date(2024, 12, 25), date(2023, 1, 2), date(2021, 7, 5)):
        assert not calendar.is_session(closed), closed
    assert calendar.is_session(date(2021, 12, 31))
    assert calendar.close_time(date(2026, 3, 5)) == datetime(2026, 3, 5, 21, tzinfo=UTC)
    assert calendar.close_time(date(2024, 11, 29)).hour == 18
    assert calendar.last_completed(datetime(2026, 3, 5, 20, tzinfo=UTC)) == date(2026, 3, 4)
    assert calendar.next_session(date(2026, 3, 6)) == date(2026, 3, 9)
    assert not calendar.is_session(date(2001, 9, 12)) and calendar.last_completed(datetime(2012, 10, 30, 23, tzinfo=UTC)) == date(2012, 10, 26)
    with pytest.raises(ValueError):
        calendar.close_time(date(2026, 3, 5), "NOWHERE")


def test_calendar_as_a_table(spark):
    rows = calendar.sessions(spark, date(2024, 11, 27), date(2024, 12, 2)).orderBy("session").collect()
    assert [(str(r["session"]), r["close_utc"].hour) for r in rows] == [("2024-11-27", 21), ("2024-11-29", 18), ("2024-12-02", 21)]


def test_open_bar_is_dropped(spark, tmp_path):
    """The last bar goes while its session is open, by the calendar, unless the configuration says otherwise."""
    rows = [("F", date(2026, 3, d), 1.0, 1.0, 1.0, 1.0, 1.0) for d in (3, 4, 5)]
    panel = spark.createDataFrame(rows, "ticker string, session date, open double, high double, low double, close double, volume double")
    at = lambda hour, **over: workflow.without_open_bar(panel, small(tmp_path, **over), datetime(2026, 3, 5, hour, tzinfo=UTC))
    assert at(20)[0].count() == 2 and at(20)[1].drop and at(21)[0].count() == 3
    assert at(20, **{"data.drop_last_incomplete": False})[0].count() == 3 and at(20, **{"data.end": "2026-03-06"})[0].count() == 3
    held, facts = workflow.cached_panel(spark, small(tmp_path), lambda: panel, now=datetime(2026, 3, 5, 20, tzinfo=UTC))
    assert held.count() == 2 and facts["partial_bar"]["drop"] and facts["cache"] == "miss"
    held, facts = workflow.cached_panel(spark, small(tmp_path), lambda: None, now=datetime(2026, 3, 5, 22, tzinfo=UTC))
    assert held.count() == 3 and facts["cache"] == "hit"  # what is cached is what was fetched
    assert workflow.cache_path(small(tmp_path)) != workflow.cache_path(small(tmp_path, **{"data.auto_adjust": False}))
    panel.limit(1).write.mode("overwrite").parquet(workflow.cache_path(small(tmp_path)))
    with pytest.raises(artifacts.DigestMismatch):
        workflow.cached_panel(spark, small(tmp_path), lambda: None)


def test_frame_digest(spark):
    df = spark.range(100).selectExpr("id", "id * 0.5 as x", "if(id % 7 = 0, null, cast(id as string)) as s")
    assert artifacts.frame_digest(df) == artifacts.frame_digest(df.repartition(7).select("s", "id", "x"))
    assert artifacts.frame_digest(df) != artifacts.frame_digest(df.where("id <> 5")) != artifacts.frame_digest(df.unionByName(df.limit(1)))


def test_candidates():
    assert len(md.candidates(("logistic", "gradient_boosting"))) == 8
    assert md.Candidate("lstm", {"units": (32, 16), "lookback": 5}).name == "lstm[lookback=5,units=32x16]"
    with pytest.raises(ValueError):
        md.Candidate("nothing")
    with pytest.raises(ValueError):
        md.candidates(("lstm",))
    assert all(c.family != "lstm" for c in md.candidates(("logistic", "lstm")))
    assert md.Candidate("logistic", {"C": 0.1}).simplicity < md.Candidate("logistic", {"C": 1.0}).simplicity


def test_logistic_is_the_penalised_minimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.2]
    y = (x @ [1.0, 0.1, 2.0] + rng.normal(size=400) > 0.3).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, target int")
    fitted = md.fit(md.Candidate("logistic", {"C": 0.5, "balanced": True}), df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    z1, beta = np.column_stack((z, np.ones(400))), np.zeros(4)
    ridge = np.array([1, 1, 1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1 @ beta))
        grad = 0.5 * z1.T @ (w * (p - y)) + ridge * beta
        beta -= np.linalg.solve(0.5 * (z1 * (w * p * (1 - p))[:, None]).T @ z1 + np.diag(ridge), grad)
    assert np.allclose([fitted.importance()[n] for n in "abc"], beta[:3], atol=1e-6)
    scores = {r["a"]: r["proba_up"] for r in fitted.score(df).collect()}
    assert all(abs(scores[float(r[0])] - 1 / (1 + np.exp(-z1[i] @ beta))) < 1e-8 for i, r in enumerate(x))


def test_missing_values_take_the_median(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] > 0).astype(int)
    x[::9, 0] = np.nan
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    table = lambda v: spark.createDataFrame([(None if np.isnan(p) else float(p), float(q), int(t)) for (p, q), t in zip(v, y)], "a double, b double, target int")
    a, b = (md.fit(md.Candidate("logistic", {"C": 1.0, "balanced": False}), table(v), ["a", "b"]) for v in (x, filled))
    assert a.local["fill"] == [np.nanmedian(x[:, 0]), 0.0] and np.allclose(a.local["beta"], b.local["beta"], atol=1e-9)
    assert a.score(table(x)).where("proba_up is null").isEmpty()
    none = table(np.column_stack((np.full(300, np.nan), x[:, 1])))  # a feature without a value
    assert md.fit(md.Candidate("logistic", {}), none, ["a", "b"]).local["beta"][0] == 0


def panel_rows(spark, n=700, seed=7):
    """Two tickers with missing values, targets that two features decide, and a constant feature."""
    rng = np.random.default_rng(seed)
    rows = []
    for ticker in "FO":
        x = rng.normal(size=(n, 4))
        y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
        x[rng.random(n) < 0.1, 2] = np.nan
        x[(y == 1) & (rng.random(n) < 0.3), 3] = np.nan
        rows += [(ticker, i, date(2020, 1, 1), *[None if np.isnan(v) else float(v) for v in r], 1.0, int(t), 0.0) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ticker string, row_idx long, session date, a double, b double, c double, d double, e double, target int, future_return double")


NAMES = ["a", "b", "c", "d", "e"]
TREES = [md.Candidate("gradient_boosting", {"rate": 0.3, "leaves": 7, "rounds": 12, "least": 5}), md.Candidate("random_forest", {"trees": 12, "depth": 6, "least": 5})]


def test_all_models_of_all_folds(spark, monkeypatch):
    """One call for all candidates, tickers and folds; the same models and scores from blocks of any size and rows in any order."""
    rows = panel_rows(spark)
    folds = spark.createDataFrame([(t, k, 200 * k, 200 * k + 1, 200 * k + 200) for t in "FO" for k in (1, 2, 3)], "ticker string, fold long, train_end long, eval_start long, eval_end long")
    chosen = [*TREES, md.Candidate("logistic", {"C": 1.0, "balanced": True}), md.Candidate("logistic", {"C": 0.01, "balanced": False})]
    key = ("candidate", "ticker", "fold", "row_idx")
    read = lambda df: {tuple(r[k] for k in key): (r["proba_up"], r["prediction"], r["target"]) for r in df.collect()}
    once = read(md.model_oof(rows, folds, chosen, NAMES))
    assert len(once) == 4 * 2 * 199 * 2 + 4 * 2 * 99  # the last fold ends with the rows
    for c in TREES:
        right = [h == t for k, (_, h, t) in once.items() if k[0] == c.name and k[2] == 3]
        assert np.mean(right) > 0.8, c.name
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    monkeypatch.setattr(trees, "REFRESHED", 5)
    monkeypatch.setattr(trees, "GROUP_BYTES", 1)
    again = read(md.model_oof(rows.repartition(5), folds, chosen, NAMES))
    assert once.keys() == again.keys() and all(once[k][0] == again[k][0] if "logistic" not in k[0] else abs(once[k][0] - again[k][0]) < 1e-9 for k in once)


def brute_split(x, g, h, least, ridge):
    """The best gain of all features, all cuts between distinct values, and both sides for missing values."""
    best = 0.0
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
    for v in x.T:
        for cut in np.unique(v[~np.isnan(v)]):
            for gone in (False, True):
                left = np.where(np.isnan(v), gone, v <= cut)
                if least <= left.sum() <= len(v) - least:
                    best = max(best, score(left) + score(~left) - score(np.ones(len(v), bool)))
    return best


def test_trees_split_where_it_gains_most(spark):
    """Every split of a boosted tree against a search over all cuts of the rows in its node; leaf values; a forest's first splits."""
    rows = panel_rows(spark, 120).where("ticker = 'F'")
    table = rows.orderBy("row_idx").toPandas()
    x, y = table[NAMES].to_numpy(float), table["target"].to_numpy(float)
    fitted = md.fit(md.Candidate("gradient_boosting", {"rate": 0.5, "leaves": 4, "rounds": 2, "least": 5}), rows, NAMES)
    raw = np.full(len(y), fitted.local["start"])
    assert abs(raw[0] - np.log(y.mean() / (1 - y.mean()))) < 1e-12
    for t in fitted.local["trees"]:
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), int)
        for k, f in enumerate(t["feature"]):
            of = node == k
            if f < 0:
                assert abs(t["value"][k] + 0.5 * g[of].sum() / (h[of].sum() + 1)) < 1e-5
                raw[of] += t["value"][k]
                continue
            assert abs(t["gain"][k] - brute_split(x[of], g[of], h[of], 5, 1.0)) < 1e-4
            left = np.where(np.isnan(x[:, f]), t["missing"][k], x[:, f] <= float(t["at"][k]))
            node[of & left], node[of & ~left] = t["left"][k], t["right"][k]
        assert sum(f < 0 for f in t["feature"]) == 4
    scores = {r["row_idx"]: r["proba_up"] for r in fitted.score(rows).collect()}
    assert all(abs(scores[i] - 1 / (1 + np.exp(-raw[i]))) < 1e-9 for i in range(len(y)))
    shares = fitted.importance()
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["e"] == 0
    forest = md.fit(md.Candidate("random_forest", {"trees": 5, "depth": 2, "least": 5, "balanced": False}), rows, NAMES)
    assert all(sum(f >= 0 for f in t["feature"]) <= 3 for t in forest.local["trees"]) and len({str(t) for t in forest.local["trees"]}) == 5
    flat = md.fit(md.Candidate("gradient_boosting", {"rounds": 3}), spark.createDataFrame([(0.0, 0.0, 1)] * 50, "a double, b double, target int"), ["a", "b"])
    assert flat.score(spark.createDataFrame([(0.0, None)], "a double, b double")).first()["proba_up"] > 0.99


def test_boosting_takes_few_short_passes(spark, monkeypatch):
    """Models go their own pace, nodes too small to split take no pass, and a pass is one job that carries only unwritten trees."""
    passes, sent = [], []
    inner = trees._pass

    def counted(blocks, models, growing, *rest):
        passes.append(growing)
        found = inner(blocks, models, growing, *rest)
        sent.append(max(len(m["trees"]) - m["written"] for m in models))
        return found

    monkeypatch.setattr(trees, "_pass", counted)
    monkeypatch.setattr(trees, "REFRESHED", 3)
    rows = panel_rows(spark)
    folds = spark.createDataFrame([(t, k, 200 * k, 200 * k + 1, 200 * k + 200) for t in "FO" for k in (1, 2)], "ticker string, fold long, train_end long, eval_start long, eval_end long")
    md.model_oof(rows, folds, [md.Candidate("gradient_boosting", {"rate": 0.3, "leaves": 7, "rounds": 8, "least": 60})], NAMES).collect()
    by_model = [sum(any(m == k for k, _ in growing) for growing in passes) for m in range(4)]
    assert len(passes) == max(by_model)  # no model waits for another
    assert max(by_model[::2]) <= 16  # 200 rows, 60 at least on either side of a split: no node of a third level can split
    assert max(sent) <= 3 + 1


def test_bootstrap_draws():
    drawn = np.array([trees.times_drawn(np.arange(2000), 42, t) for t in range(20)])
    assert abs(drawn.mean() - 1) < 0.03 and abs(drawn.var() - 1) < 0.05 and abs(np.corrcoef(drawn).sum() - 20) < 2
    model = {"kind": "forest", "seed": 1}
    chosen = trees.features_at(model, 0, list(range(200)), 29)
    assert chosen.shape == (200, 5) and all(len(set(r)) == 5 for r in chosen) and len(np.unique(chosen)) == 29
    assert (trees.features_at(model, 0, [7], 29)[0] == chosen[7]).all()


def test_ranks_of_one_large_group(spark):
    """Nearly all rows in one group, with ties: ranks as a window in one task gives them."""
    rows = spark.range(5000).selectExpr("if(id % 50 = 0, 'b', 'a') as k", "cast(pmod(xxhash64(id), 40) as double) as v", "id")
    with shared.Scratch(spark, "test") as scratch:
        found = ranks.ranked(rows, ["k"], ["v", "id"], scratch).collect()
        middle = {r["k"]: r["median"] for r in ranks.medians(rows, ["k"], "v", "id", scratch).collect()}
    for k in "ab":
        of = sorted((r["v"], r["id"], r["rank"], r["rank_n"]) for r in found if r["k"] == k)
        assert [r[2] for r in of] == list(range(len(of))) and {r[3] for r in of} == {len(of)}
        assert middle[k] == np.median([r[0] for r in of])


def test_permutation(spark):
    """What a feature is worth, and that dealing anew is a permutation that no partitioning changes."""
    rows = panel_rows(spark, 300).drop("e")
    names = NAMES[:4]
    with shared.Scratch(spark, "test") as scratch:
        read = lambda df: {tuple(r)[:4]: list(r["x"]) for r in df.select("ticker", "row_idx", "j", "repeat", "x").collect()}
        dealt = read(md.permuted_rows(rows, ["ticker"], names, 2, 42, scratch))
        assert dealt == read(md.permuted_rows(rows.repartition(7), ["ticker"], names, 2, 42, scratch))
    true = {(r["ticker"], r["row_idx"]): [r[n] for n in names] for r in rows.collect()}
    for t, j, k in itertools.product("FO", range(4), range(2)):
        for other in range(4):
            plain, new = [true[t, i][other] for i in range(300)], [dealt[t, i, j, k][other] for i in range(300)]
            assert new == plain if other != j else (new != plain and Counter(new) == Counter(plain))
    worth = {(r["ticker"], r["name"]): r["value"] for r in md.importance(TREES[0], rows, names, repeats=3).collect()}
    assert all(worth[t, n] > 0.1 > abs(worth[t, "c"]) for t in "FO" for n in "ab")
    fitted = md.fit(TREES[0], rows, names)
    assert md.permuted(fitted, rows)["a"] > 0.1


def test_workflow(spark, sf, tmp_path, monkeypatch):
    c = small(tmp_path, **{"threshold.tune_classification": True, "threshold.tune_trading": True, "paths.tables": str(tmp_path / "tables")})
    panel, facts = workflow.cached_panel(spark, c, lambda: panels.load(spark, c.data.source, sf, c.data.ticker, c.data.start))
    assert facts["cache"] == "miss" and workflow.cached_panel(spark, c, lambda: None)[1]["cache"] == "hit"
    chosen = [md.Candidate("logistic", {"C": 1.0, "balanced": True}), md.Candidate("logistic", {"C": 0.01, "balanced": False})]
    run = workflow.selection_stage(spark, panel, c, "r1", chosen, facts)
    decision = run.read_json("selection_decision.json")
    assert decision["gate"]["model"] == decision["ranking"][0]["candidate"] == decision["winner"]["name"] and decision["gate"]["reason"]
    assert {b["candidate"] for b in decision["baselines"]} >= {"majority_class", "always_up"} and {h["part"] for h in decision["holdout"]} == {"train", "validation", "test"}
    assert set(decision["thresholds"]) == {"classification", "trading"} and all(0.3 <= t <= 0.7 for t in decision["thresholds"].values())
    assert run.read_table(spark, "oof_predictions.parquet").count() > 0 and "metric" in run.read_table(spark, "fold_metrics.csv").columns
    assert not run.exists("oof_predictions.parquet") and run.read_json("data_manifest.json")["source"]["sha256"] == facts["sha256"]
    sink = workflow.processed_sink(workflow.build_rows(panel, c), c)
    assert "features" in (tmp_path / "processed").joinpath(sink.rsplit("/", 1)[1].replace(".parquet", ".json")).read_text()
    assert not run.exists("final_test.json") and run.read_json("selection_decision.json")["development_only"]
    with monkeypatch.context() as m:  # a test that breaks off has looked: its lock stands before any figure
        m.setattr(workflow.md, "fit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            workflow.final_test(spark, panel, run)
    assert run.lock().data_sha256 and not run.exists("final_test.json")
    with pytest.raises(artifacts.FinalTestDone):
        workflow.final_test(spark, panel, run)
    report = workflow.final_test(spark, panel, run, True, "the first one broke off")
    assert {m["candidate"] for m in report["metrics"]} >= {"majority_class", "last_direction"}
    assert {b["strategy"] for b in report["backtests"]} == {decision["winner"]["name"], "last_direction", "always_up", "always_active", "cash", "buy_and_hold"}
    assert report["bootstrap_against_always_active"][0]["statistic"] == "mean_daily" and len(run.read_json("permutation_importance.json")) == len(decision["features"])
    card = (run.path / "model_card.md").read_text()
    assert all(h in card for h in ("## Baselines", "against the best baseline", "## Calibration", "## Provenance", run.lock().data_sha256))
    assert run.lock().data_sha256 == run.read_json("data_manifest.json")["data_sha256"]
    assert report["verdict"] in cli.final_text(report) and "buy_and_hold" in cli.final_text(report)
    model = run.read_json("model.json")
    run.write_json("model.json", {**model, "local": {**model["local"], "beta": [0.0]}})
    with pytest.raises(artifacts.DigestMismatch):
        workflow.load_model(run)
    run.write_json("model.json", model)
    with pytest.raises(artifacts.DigestMismatch):  # other rows than those of the selection
        workflow.final_test(spark, panel.where("session < '1996-01-01'"), run, True, "other rows")
    with pytest.raises(artifacts.FinalTestDone):
        workflow.final_test(spark, panel, run)
    out = workflow.predict(spark, panel, run, str(panel.agg({"session": "max"}).first()[0]))
    assert 0 <= out["proba_up"] <= 1 and out["direction"] in ("up", "down")
    manifest = run.read_json("feature_manifest.json")
    run.write_json("feature_manifest.json", {**manifest, "features": manifest["features"][::-1]})
    with pytest.raises(workflow.InferenceRefused):
        workflow.predict(spark, panel, run, "2000-01-01")
    decision = run.read_json("selection_decision.json")
    run.write_json("selection_decision.json", {**decision, "dev_end": 1})
    with pytest.raises(ValueError):
        workflow.final_test(spark, panel, run, True, "again")


def test_cli(tmp_path, capsys):
    assert cli.main(["list-runs", "--config", str(tmp_path / "none.yaml")]) == 2
    (tmp_path / "c.yaml").write_text(f"paths: {{runs: {tmp_path}/runs}}\n")
    assert cli.main(["list-runs", "--config", str(tmp_path / "c.yaml")]) == 0 and "[]" in capsys.readouterr().out
    assert cli.main(["show-run", "--config", str(tmp_path / "c.yaml")]) == 1
    assert cli.main(["evaluate", "--config", str(tmp_path / "c.yaml"), "--run-id", "x"]) == 1
