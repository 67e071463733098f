"""Command line: ``python -m tidemark.runs.cli COMMAND``.  Exit codes: 0 done, 1 refused or failed, 2 bad configuration, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from .artifacts import list_runs, open_run, to_json
from .config import Config, load

COMMANDS = ("download", "build-features", "evaluate-candidates", "select-model", "final-test", "run-all", "evaluate", "backtest", "predict", "show-run", "list-runs")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--config")
    p.add_argument("--data", default="data/tables", help="folder of the source tables")
    p.add_argument("--ticker")
    p.add_argument("--end-date")
    p.add_argument("--run-id")
    p.add_argument("--as-of")
    p.add_argument("--last-completed")
    p.add_argument("--refresh", action="store_true")
    p.add_argument("--allow-rerun", action="store_true")
    p.add_argument("--rerun-reason")
    return p


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _execute(args: argparse.Namespace, config: Config) -> object:
    if args.command == "list-runs":
        return list_runs(config)
    run = open_run(config, args.run_id) if args.run_id and args.command not in ("select-model", "run-all") else None
    if args.command in ("show-run", "evaluate", "backtest", "final-test", "predict") and run is None:
        raise ValueError("--run-id is needed")
    if args.command == "show-run":
        lock = run.lock()
        return {"decision": run.read_json("selection_decision.json"), "lock": None if lock is None else vars(lock)}
    if args.command in ("evaluate", "backtest"):
        report = run.read_json("final_test.json")
        return report["metrics"] if args.command == "evaluate" else report["backtests"]
    from ..sources import panels
    from . import calendar, workflow

    spark = _spark()
    d = config.data
    fetch = lambda: panels.load(spark, d.source, args.data, d.ticker, d.start, d.end, d.interval, d.auto_adjust)
    panel, facts = workflow.cached_panel(spark, config, fetch, args.refresh)
    if args.command == "download":
        return {**facts, "rows": panel.count()}
    if args.command == "build-features":
        return {"table": workflow.processed_sink(workflow.build_rows(panel, config), config)}
    if args.command == "evaluate-candidates":
        return workflow.select(spark, workflow.build_rows(panel, config).persist(), config).decision["ranking"]
    if args.command == "predict":
        last = args.last_completed or str(calendar.last_completed(datetime.now(UTC), d.exchange))
        return workflow.predict(spark, panel, run, last, args.as_of)
    if args.command in ("select-model", "run-all"):
        run = workflow.selection_stage(spark, panel, config, args.run_id, facts=facts)
        if args.command == "select-model":
            return {"run_id": run.run_id, "gate": run.read_json("selection_decision.json")["gate"]}
    return final_text(workflow.final_test(spark, panel, run, args.allow_rerun, args.rerun_reason))


def final_text(report: dict) -> str:
    """The final report as lines of a terminal."""
    columns = {"metrics": ["candidate", "accuracy", "balanced_accuracy", "roc_auc", "mcc", "log_loss", "brier"], "backtests": ["strategy", "cumulative_return", "annualized_return", "sharpe", "max_drawdown", "n_trades", "total_cost"]}
    show = lambda v: f"{v:>12.4f}" if isinstance(v, float) else f"{'-' if v is None else v:>12}"
    lines = []
    for part, (first, *rest) in columns.items():
        lines.append(f"{first:<48}" + "".join(f" {c[:12]:>12}" for c in rest))
        lines += [f"{r[first]:<48}" + "".join(f" {show(r[c])}" for c in rest) for r in report[part]]
        lines.append("")
    return "\n".join([*lines, report["verdict"]])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.config and not Path(args.config).is_file():
            raise ValueError(f"no file {args.config}")
        config = load(args.config, {"data.ticker": args.ticker, "data.end": args.end_date})
    except (ValueError, TypeError) as error:
        print(f"configuration: {error}", file=sys.stderr)
        return 2
    try:
        result = _execute(args, config)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OSError, KeyError, PySparkException, Py4JError) as error:
        print(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 1
    print(result if isinstance(result, str) else json.dumps(json.loads(to_json(result)), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
