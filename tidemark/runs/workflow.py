"""Selection on the development part, one look at the holdout, and prediction.

The holdout is sealed in the plan: selection filters on ``row_idx < dev_end``
before anything else, and the final test is a call of its own behind a lock.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import baselines as bl
from ..operators import benchmark as bm
from ..operators import bootstrap as bs
from ..operators import calibration as cal
from ..operators import features as ft
from ..operators import folds as fo
from ..operators import labels as lb
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import quality as ql
from ..functions.shared import hadoop_path, path_exists
from ..operators import ranking as rk
from . import calendar
from .artifacts import DigestMismatch, Lock, Run, create_run, environment, frame_digest, now_iso, sha256_json, to_json
from .config import Config


class InferenceRefused(ValueError):
    """A prediction that would not be what the model was trained for."""


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever store the path names."""
    hadoop, fs = hadoop_path(spark, path)
    out = fs.create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def cache_path(config: Config) -> str:
    """Where a source's panel is kept: by ticker, interval and a digest of all that decides what is fetched."""
    d = config.data
    key = sha256_json([d.source, d.ticker, d.start, d.end, d.interval, d.auto_adjust])[:12]
    return f"{config.paths.cache.rstrip('/')}/{d.ticker}_{d.interval}_{key}"


def cached_panel(spark: SparkSession, config: Config, fetch: Any, refresh: bool = False, now: datetime | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The panel of a source by content key: a verified copy in the cache, or a new one.

    Either way repeats are collapsed and the last bar goes if its session is
    still open; the facts say what was done.  The copy and its facts lie in
    the same store, and the digest is of the rows, not of files.
    """
    d = config.data
    path = cache_path(config)
    if path_exists(spark, path) and path_exists(spark, f"{path}.json") and not refresh:
        facts = json.loads(_read_text(spark, f"{path}.json"))
        panel = spark.read.parquet(path)
        if facts["sha256"] != frame_digest(panel):
            raise DigestMismatch(f"{path} has changed since it was cached")
        facts["cache"] = "hit"
    else:
        panel = fetch()
        panel = panel.where(F.col("session") >= F.lit(d.start).cast("date"))
        panel = panel if d.end is None else panel.where(F.col("session") < F.lit(d.end).cast("date"))
        panel.write.mode("overwrite").parquet(path)
        panel = spark.read.parquet(path)
        facts = {"source": d.source, "ticker": d.ticker, "start": d.start, "end": d.end, "interval": d.interval, "auto_adjust": d.auto_adjust, "fetched": now_iso(), "n_rows": panel.count(), "sha256": frame_digest(panel)}
        _write_text(spark, f"{path}.json", to_json(facts))
        facts["cache"] = "miss"
    panel, facts["duplicates_removed"] = ql.resolve_duplicates(panel, d.collapse_duplicates)
    panel, decision = without_open_bar(panel, config, now)
    return panel, facts | {"partial_bar": asdict(decision)}


def without_open_bar(panel: DataFrame, config: Config, now: datetime | None = None) -> tuple[DataFrame, ql.PartialBar]:
    """The panel without its last session if that has not closed by ``now``, and why it was or was not dropped."""
    d = config.data
    last = panel.agg(F.max("session").alias("s")).first()["s"]
    if last is None:
        return panel, ql.PartialBar(False, "no rows")
    day = last.date() if isinstance(last, datetime) else last
    closes = {day: calendar.close_time(day, d.exchange)} if calendar.is_session(day) else {}
    end = date.fromisoformat(str(d.end)) if d.end is not None else None
    decision = ql.decide_partial_bar(day, closes, now or datetime.now(UTC), end, d.drop_last_incomplete)
    return (panel.where(F.col("session") < F.lit(last)) if decision.drop else panel), decision


def build_rows(panel: DataFrame, config: Config) -> DataFrame:
    """The labelled rows of the configured ticker, validated and, if asked for, aligned with its benchmark."""
    asset, bench = bm.split_benchmark(panel, config.data.ticker, config.data.benchmark)
    ql.validate(asset, config.data.min_rows)
    ql.assert_chronological(asset)
    if config.features.benchmark:
        asset = bm.align_checked(asset, bench, config.data.max_join_loss)
    return lb.build_dataset(asset, config.features, config.labels, config.data.min_rows)


def processed_sink(rows: DataFrame, config: Config) -> str:
    """The labelled table by ticker, and beside it a manifest of its features, configuration, rows and digest."""
    target = f"{config.paths.processed.rstrip('/')}/{config.data.ticker}_{config.labels.definition}_features.parquet"
    rows.write.mode("overwrite").partitionBy("ticker").parquet(target)
    summary = [r.asDict() for r in lb.dataset_summary(rows).collect()]
    manifest = {"features": ft.manifest(config.features), "config_sha256": config.sha256(), "rows": summary, "sha256": frame_digest(rows), "written": now_iso()}
    _write_text(rows.sparkSession, f"{target.removesuffix('.parquet')}.json", to_json(manifest))
    return target


@dataclass
class Selection:
    """What selection decided; ``decision`` is what the run's folder records."""

    suite: DataFrame
    oof: DataFrame
    decision: dict[str, Any]
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what was kept in memory while selecting."""
        for df in self.held:
            df.unpersist()


def select(spark: SparkSession, rows: DataFrame, config: Config, chosen: list[md.Candidate] | None = None) -> Selection:
    """Score all candidates and baselines on the same folds of the development part, rank them, apply the gate."""
    names = list(ft.feature_columns(config.features))
    sizes = rows.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    bound = fo.bounds(sizes, config.split).first()
    if bound["n_test"] < 1:
        raise ValueError("no rows are left for the final test")
    fo.assert_holdout_causal([r.asDict() for r in fo.holdout(sizes, config.split).collect()], config.split.gap)
    dev = rows.where(F.col("row_idx") < bound["dev_end"]).withColumn("n_rows", F.lit(bound["dev_end"])).persist()
    folds = fo.walk_forward(dev.groupBy("ticker").agg(F.count("*").alias("n_rows")), config.split).persist()
    fo.assert_causal([r.asDict() for r in folds.collect()], config.split.gap)
    chosen = chosen or md.candidates(config.selection.families)
    models = md.model_oof(dev, folds, chosen, names, config.statistics.seed)
    base = bl.baseline_oof(dev, folds, config.labels.definition, config.statistics.seed)
    if not config.selection.random_baseline:
        base = base.where("candidate <> 'random'")
    oof = models.unionByName(base).persist()
    suite = mt.metric_suite(oof).persist()
    model_names = [c.name for c in chosen]
    base_names = [n for n in bl.BASELINES if n != "random" or config.selection.random_baseline]
    summary = rk.summary(suite, {c.name: c.standing for c in chosen})
    ranks = rk.ranked(summary.where(F.col("candidate").isin(model_names))).drop("folds").orderBy("rank").collect()
    winner = next(c for c in chosen if c.name == ranks[0]["candidate"])
    gate = rk.edge_gate(suite, [winner.name], base_names, config.selection.gate).first().asDict()
    gate["reason"] = rk.gate_reason(gate)
    decision = {
        "winner": {"name": winner.name, "family": winner.family, "params": winner.params},
        "ranking": [r.asDict() for r in ranks],
        "gate": gate,
        "baselines": [r.asDict() for r in summary.where(F.col("candidate").isin(base_names)).drop("folds", "simplicity").orderBy(F.desc_nulls_last("mean_ba"), "candidate").collect()],
        "holdout": [r.asDict() for r in fo.holdout_spans(rows, config.split).orderBy("part").collect()],
        "dev_end": bound["dev_end"],
        "test_start": bound["test_start"],
        "features": names,
        "config_sha256": config.sha256(),
        "development_only": True,
        "thresholds": tune(oof.where(F.col("candidate") == winner.name), config),
    }
    decision["decision_sha256"] = sha256_json(decision)
    return Selection(suite, oof, decision, (dev, folds, oof, suite))


def tune(winner_oof: DataFrame, config: Config) -> dict[str, float]:
    """Thresholds of the winner, tuned on its out-of-fold scores where the configuration says so."""
    t = config.threshold
    out = {"classification": t.classification, "trading": t.trading}
    scan = cal.threshold_scan(winner_oof, ("ticker",), t.candidates)
    if t.tune_classification:
        out["classification"] = cal.best_threshold(scan, ("ticker",), t.objective).first()["threshold"]
    if t.tune_trading:
        if t.objective == "net_sharpe":
            scan = cal.net_sharpe_scan(winner_oof, ("ticker",), config.backtest.cost_rate, config.backtest.mode == "next_open", t.candidates)
        out["trading"] = cal.best_threshold(scan, ("ticker",), t.objective).first()["threshold"]
    return out


def data_manifest(rows: DataFrame, config: Config, facts: dict[str, Any] | None = None) -> dict[str, Any]:
    """Where the rows come from, what they are, and their digest."""
    return {
        "source": facts or {"source": config.data.source, "ticker": config.data.ticker},
        "data": asdict(config.data),
        "rows": [r.asDict() for r in lb.dataset_summary(rows).collect()],
        "label": asdict(config.labels),
        "feature_version": ft.FEATURE_VERSION,
        "features_sha256": sha256_json(ft.manifest(config.features)),
        "data_sha256": frame_digest(rows),
    }


def selection_stage(spark: SparkSession, panel: DataFrame, config: Config, run_id: str | None = None, chosen: list[md.Candidate] | None = None, facts: dict[str, Any] | None = None) -> Run:
    """Selection written into a new run's folder."""
    rows = build_rows(panel, config).persist()
    run = create_run(config, run_id)
    picked = select(spark, rows, config, chosen)
    run.write_json("config.json", asdict(config))
    run.write_json("environment.json", environment(spark))
    run.write_json("feature_manifest.json", ft.manifest(config.features))
    run.write_json("data_manifest.json", data_manifest(rows, config, facts))
    run.write_json("selection_decision.json", picked.decision)
    run.write_table("oof_predictions.parquet", picked.oof)
    run.write_table("fold_metrics.csv", mt.long_metrics(picked.suite), "csv")
    picked.release()
    rows.unpersist()
    return run


def verified_decision(run: Run, config: Config) -> dict[str, Any]:
    decision = run.read_json("selection_decision.json")
    body = {k: v for k, v in decision.items() if k != "decision_sha256"}
    if not decision.get("development_only") or decision["decision_sha256"] != sha256_json(body):
        raise ValueError("the decision is not certified")
    if decision["config_sha256"] != config.sha256():
        raise ValueError("the decision was made under another configuration")
    return decision


def final_test(spark: SparkSession, panel: DataFrame, run: Run, rerun: bool = False, reason: str | None = None) -> dict[str, Any]:
    """Refit the winner on the development part and evaluate it once on the holdout."""
    config = run.config()
    decision = verified_decision(run, config)
    previous = run.allow_final_test(rerun, reason)
    rows = build_rows(panel, config).persist()
    digest = frame_digest(rows)
    if digest != run.read_json("data_manifest.json")["data_sha256"]:
        raise DigestMismatch("the rows are not those that the model was selected on")
    names, w = decision["features"], decision["winner"]
    dev, test = rows.where(F.col("row_idx") < decision["dev_end"]), rows.where(F.col("row_idx") >= decision["test_start"])
    # the look at the holdout is on record before any figure of it exists: an interrupted test counts as one
    span = test.agg(F.min("session").alias("a"), F.max("session").alias("b"), F.count("*").alias("n")).first()
    lock = run.write_lock(Lock(config.sha256(), w["name"], str(span["a"]), str(span["b"]), span["n"], digest), previous, reason)
    fitted = md.fit(md.Candidate(w["family"], w["params"]), dev, names, config.statistics.seed)
    thresholds = decision["thresholds"]
    keys = ("candidate", "ticker")
    columns = (*keys, "session", "row_idx", "proba_up", "prediction", "target", "future_return")
    scored = fitted.score(test).withColumn("candidate", F.lit(w["name"])).withColumn("prediction", (F.col("proba_up") >= thresholds["classification"]).cast("int")).select(*columns)
    feature = bl.direction_feature(config.labels.definition)
    base = bl.predicted(test.join(bl.fitted(dev, ("ticker",), feature), "ticker"), feature, config.statistics.seed).select(*columns)
    everything = scored.unionByName(base).persist()
    suite = [r.asDict() for r in mt.metric_suite(everything, keys).collect()]
    trading = bt.BacktestConfig(**{**asdict(config.backtest), "threshold": thresholds["trading"]})
    held = bt.strategies(scored, trading).unionByName(bt.rules(base))
    days = bt.daily(held, trading).persist()
    holding = bt.BacktestConfig(**{**asdict(trading), "mode": "close_to_close"})
    owned = bt.daily(bt.buy_and_hold(panel, test), holding)
    economics = [r.asDict() for c, d in ((trading, days), (holding, owned)) for r in bt.economic_metrics(d, c).collect()]
    of = lambda name: days.where(F.col("strategy") == name).select(F.col("ticker").alias("key"), "session", F.col("net_return").alias("value"))
    idx = F.row_number().over(bt.Window.partitionBy("key").orderBy("session")) - 1
    st = config.statistics
    draw = {"n_samples": st.samples, "block": st.block, "seed": st.seed, "level": st.level}
    boot = bs.block_bootstrap(of(w["name"]).select("key", idx.cast("long").alias("idx"), "value"), **draw)
    report = {
        "metrics": suite,
        "backtests": economics,
        "bootstrap": [r.asDict() for r in boot.collect()],
        "bootstrap_against_always_active": [r.asDict() for r in bs.bootstrap_difference(of(w["name"]), of("always_active"), **draw).collect()],
        "calibration": [r.asDict() for r in cal.calibration_report(scored, keys).collect()],
        "calibration_bins": [r.asDict() for r in cal.calibration_bins(scored, keys).orderBy("bin_id").collect()],
        "thresholds": thresholds,
    }
    model = {m["candidate"]: m["balanced_accuracy"] for m in suite if m["candidate"] == w["name"]}
    report["verdict"] = mt.compare_sentence(model, {m["candidate"]: m["balanced_accuracy"] for m in suite if m["candidate"] != w["name"]})
    save_model(run, fitted, test.limit(20), {"thresholds": thresholds, "config_sha256": config.sha256(), "git": environment()["git"], "edge": decision["gate"]["edge"], "feature_version": ft.FEATURE_VERSION})
    run.write_json("feature_importance.json", fitted.importance())
    run.write_json("permutation_importance.json", md.permuted(fitted, dev, config.statistics.seed))
    run.write_json("final_test.json", report)
    run.write_text("model_card.md", model_card(run, decision, report, lock))
    run.write_json("environment.json", {**run.read_json("environment.json"), "finished": now_iso()})
    for df in (everything, days, rows):
        df.unpersist()
    return report


def save_model(run: Run, fitted: md.Fitted, sample: DataFrame, extra: dict[str, Any]) -> None:
    """Model and digest; read back at once and compared by the scores of some rows, a failure fails the run."""
    meta = {"family": fitted.candidate.family, "params": fitted.candidate.params, "features": fitted.names, **extra}
    run.write_json("model.json", meta | {"local": fitted.local, "sha256": sha256_json(fitted.local)})
    again, _ = load_model(run)
    scores = lambda f: [r["proba_up"] for r in f.score(sample).orderBy("ticker", "session").collect()]
    if scores(again) != scores(fitted):
        raise DigestMismatch("the model that was read back scores otherwise")


def load_model(run: Run) -> tuple[md.Fitted, dict[str, Any]]:
    meta = run.read_json("model.json")
    if sha256_json(meta["local"]) != meta["sha256"]:
        raise DigestMismatch("the model has changed")
    return md.Fitted(md.Candidate(meta["family"], meta["params"]), meta["features"], meta["local"]), meta


def predict(spark: SparkSession, panel: DataFrame, run: Run, last_completed: str, as_of: str | None = None) -> dict[str, Any]:
    """Probability of a rise from one session's features, with refusals and warnings."""
    fitted, meta = load_model(run)
    config, manifest = run.config(), run.read_json("feature_manifest.json")
    if meta["feature_version"] != manifest["version"] or manifest["version"] != ft.FEATURE_VERSION:
        raise InferenceRefused("the model was trained on another version of the features")
    if meta["features"] != manifest["features"]:
        raise InferenceRefused("the model's features are not those of the manifest")
    asset, bench = bm.split_benchmark(panel, config.data.ticker, config.data.benchmark)
    if config.features.benchmark:
        asset = bm.align_checked(asset, bench, config.data.max_join_loss)
    rows = ft.in_manifest_order(ft.build_features(asset, config.features), manifest["features"]).dropna()
    session = bm.resolve_signal(rows, last_completed, as_of)
    one = rows.where(F.col("session") == F.lit(session).cast("date"))
    ql.assert_finite(one, manifest["features"], "signal row")
    p = fitted.score(one).first()["proba_up"]
    warnings = [] if meta.get("edge") else ["the model showed no edge over the baselines"]
    if session != last_completed:
        warnings.append(f"the last completed session is {last_completed}")
    return {
        "run_id": run.run_id,
        "signal_session": session,
        "proba_up": round(p, 6),
        "direction": "up" if p >= meta["thresholds"]["classification"] else "down",
        "position": "long" if p >= meta["thresholds"]["trading"] else "cash",
        "warnings": warnings,
        "at": datetime.now(UTC).isoformat(timespec="seconds"),
    }


def _table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])


#: Metrics of which less is better.
LOWER = {"brier", "log_loss"}


def against_best(metrics: list[dict[str, Any]], model: str) -> list[dict[str, Any]]:
    """Each metric of the model beside the best baseline's, most or least as the metric goes."""
    out = []
    own = next(m for m in metrics if m["candidate"] == model)
    for name in mt.METRICS:
        others = [(m[name], m["candidate"]) for m in metrics if m["candidate"] != model and m[name] is not None]
        best = (min if name in LOWER else max)(others, default=(None, None))
        gain = None if best[0] is None or own[name] is None else (best[0] - own[name] if name in LOWER else own[name] - best[0])
        out.append({"metric": name, "model": own[name], "best baseline": best[0], "which": best[1], "better by": gain})
    return out


def model_card(run: Run, decision: dict[str, Any], report: dict[str, Any], lock: Lock) -> str:
    """What was chosen, why, how it did and where it comes from, as Markdown."""
    g, name = decision["gate"], decision["winner"]["name"]
    environment_ = run.read_json("environment.json")
    provenance = {"run": run.run_id, "configuration": lock.config_sha256, "rows": lock.data_sha256, "commit": environment_["git"]["commit"], "test": f"{lock.test_start} to {lock.test_end}, {lock.n_test_rows} rows", "first look": lock.created, "later looks": "; ".join(f"{r['at']}: {r['reason']}" for r in lock.reruns) or "none"}
    scores = ["candidate", "mean_ba", "std_ba", "low_ba", "high_ba", "mean_log_loss", "mean_auc", "mean_mcc"]
    money = ["strategy", "cumulative_return", "annualized_return", "sharpe", "max_drawdown", "exposure", "n_trades", "total_cost"]
    spread = ["statistic", "point", "low", "high", "above_zero"]
    return "\n\n".join(
        [
            f"# {name} ({run.run_id})",
            report["verdict"] + ".",
            "## Candidates on the development part",
            _table(decision["ranking"], ["rank", *scores]),
            "## Baselines on the development part",
            _table(decision["baselines"], scores),
            f"## Gate: {'passed' if g['edge'] else 'not passed'}",
            g["reason"] + ".",
            _table([g], ["margin", "margin_ok", "fold_wins", "wins_ok", "mean_auc", "auc_ok", "mean_mcc", "mcc_ok"]),
            "## Holdout",
            _table(report["metrics"], ["candidate", *mt.METRICS]),
            "## Holdout against the best baseline",
            _table(against_best(report["metrics"], name), ["metric", "model", "best baseline", "which", "better by"]),
            "## Calibration",
            _table(report["calibration"], ["n", "ece", "mce", "brier", "base_rate_brier"]),
            _table(report["calibration_bins"], ["bin_id", "n", "mean_predicted", "observed", "gap"]),
            "## Backtests",
            _table(report["backtests"], money),
            "## Bootstrap",
            _table(report["bootstrap"], spread),
            "Against the always-active rule:",
            _table(report["bootstrap_against_always_active"], spread),
            "## Provenance",
            _table([{"what": k, "value": v} for k, v in provenance.items()], ["what", "value"]),
        ]
    )
