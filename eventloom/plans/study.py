"""A whole study from one configuration: panel, market model, event study and horse race, each stage on or off.

The configuration is a dict, as a TOML file gives it:

    [run]          paper, run_id ("auto" or a name)
    [stages]       build_panel, market_model, event_study, horserace = true or false
    [build_panel]  gpt_csv, lmmd_csv, out_csv, skip_if_exists
    [market_model] market, stocks, out_csv, skip_if_exists
    [event_study]  measures, windows, skip_if_exists
    [horserace]    windows (else those of the event study), skip_if_exists

Paths are relative to the root.  Results of a run lie in outputs/<paper>/<run_id>, its metadata in runs/<paper>/<run_id>.
"""

from __future__ import annotations

import json
import logging
import subprocess
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenient_date
from ..operators import car, horserace, market_model, panel, regression, returns
from ..sources.readers import read_csv
from ..sources.writers import row_dict, write_csv, write_qc

STAGES = ("build_panel", "market_model", "event_study", "horserace")
WINDOWS = ((0, 0), (0, 1), (-1, 1))


def parse_windows(raw) -> list[tuple[int, int]]:
    """Pairs of whole numbers; None gives no window, anything but pairs a ValueError."""
    out = []
    for w in raw or ():
        if not isinstance(w, (list, tuple)) or len(w) != 2:
            raise ValueError(f"a window is a pair [start, end], not {w!r}")
        out.append((int(w[0]), int(w[1])))
    return out


def revision(root: Path) -> str:
    """The short name of the checked-out commit, or 'unknown'."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=root, capture_output=True, text=True, check=True, timeout=10).stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


@dataclass
class Study:
    spark: SparkSession
    root: Path
    config: dict
    paper: str
    run_id: str
    log: logging.Logger

    @classmethod
    def start(cls, spark: SparkSession, root: str | Path, config: dict) -> Study:
        run = config.get("run", {})
        run_id = run.get("run_id", "auto")
        run_id = run_id if isinstance(run_id, str) and run_id != "auto" else datetime.now().strftime("%Y-%m-%d_%H%M%S")
        study = cls(spark, Path(root), config, run.get("paper", "paper1"), run_id, logging.getLogger("eventloom.study"))
        study.log_to(study.outputs / "logs" / "run.log")
        study.write_metadata()
        return study

    @property
    def outputs(self) -> Path:
        return self.root / "outputs" / self.paper / self.run_id

    def log_to(self, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        self.log.setLevel(logging.INFO)
        for old in list(self.log.handlers):
            old.close()
            self.log.removeHandler(old)
        for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler(sys.stdout)):
            handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
            self.log.addHandler(handler)

    def write_metadata(self) -> None:
        """command.txt, git.txt and config_resolved.json."""
        folder = self.root / "runs" / self.paper / self.run_id
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "command.txt").write_text(" ".join(sys.argv) + "\n", encoding="utf-8")
        (folder / "git.txt").write_text(revision(self.root) + "\n", encoding="utf-8")
        resolved = {"paper": self.paper, "run_id": self.run_id, "config": self.config}
        (folder / "config_resolved.json").write_text(json.dumps(resolved, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")

    def of(self, stage: str, key: str, default=None):
        value = self.config.get(stage, {}).get(key, default)
        if value is None:
            raise ValueError(f"[{stage}] needs {key}")
        return value

    def done(self, stage: str, path: Path) -> bool:
        """Whether a stage's result is there and may stay."""
        if skip := path.exists() and bool(self.of(stage, "skip_if_exists", True)):
            self.log.info("%s: %s is there already", stage, path)
        return skip

    @contextmanager
    def timed(self, stage: str) -> Iterator[dict]:
        """Logs how a stage ended and how long it took, also when it fails."""
        state, began = {"status": "ok"}, time.perf_counter()
        try:
            yield state
        except Exception:
            state["status"] = "failed"
            raise
        finally:
            self.log.info("Stage %s finished: status=%s elapsed=%.3fs", stage, state["status"], time.perf_counter() - began)

    def load(self, path: str) -> DataFrame:
        full = str(self.root / path)
        df = self.spark.read.parquet(full) if full.endswith(".parquet") else read_csv(self.spark, full)
        for c in ("date", "trading_date"):
            if c in df.columns and dict(df.dtypes)[c] == "string":
                df = df.withColumn(c, lenient_date(F.substring(c, 1, 10)))
        return df

    def returns(self) -> tuple[DataFrame, DataFrame]:
        market, stocks = (self.load(self.of("market_model", k)) for k in ("market", "stocks"))
        return returns.stock_returns(stocks, returns.trading_day(stocks)), returns.market_returns(market, returns.trading_day(market))

    def panel(self) -> DataFrame:
        df = panel.with_date(read_csv(self.spark, str(self.root / self.of("build_panel", "out_csv"))))
        df = df.withColumnsRenamed({"symbol": "Ticker", "filing_date": "EventDate"})
        return df if "industry" in df.columns else df.withColumn("industry", F.lit(None).cast("string"))

    def windows(self, stage: str = "event_study") -> list[tuple[int, int]]:
        own = self.config.get(stage, {}).get("windows")
        return parse_windows(own) if own is not None else self.windows() if stage != "event_study" else list(WINDOWS)

    def cumulated(self, events: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
        stock, market = returns.overlap(*self.returns())
        parameters = read_csv(self.spark, str(self.root / self.of("market_model", "out_csv")))
        parameters = parameters.select("Ticker", F.col("alpha").try_cast("double").alias("alpha"), F.col("beta").try_cast("double").alias("beta"))
        return car.cumulate(events, stock, market, parameters, windows)

    def build_panel(self, state: dict) -> None:
        out = self.root / self.of("build_panel", "out_csv")
        if self.done("build_panel", out):
            state["status"] = "skipped"
            return
        left, right = (panel.with_date(read_csv(self.spark, str(self.root / self.of("build_panel", k)))) for k in ("gpt_csv", "lmmd_csv"))
        merged = panel.build_panel(left, right)
        write_csv(merged, out)
        write_qc(out, row_dict(panel.panel_qc(left, right, merged, ["symbol", "filing_date"], list(panel.REQUIRED))))

    def market_model(self, state: dict) -> None:
        out = self.root / self.of("market_model", "out_csv")
        if self.done("market_model", out):
            state["status"] = "skipped"
            return
        stock, market = returns.overlap(*self.returns())
        write_csv(market_model.market_model(stock, market).orderBy("Ticker"), out)
        write_qc(out, row_dict(market_model.observations(stock, market)), beside=True)

    def event_study(self, state: dict) -> None:
        df, written = self.panel(), 0
        for measure in self.of("event_study", "measures", ["document_score"]):
            out = self.outputs / "event_study" / f"regression_summary_{measure}.csv"
            if not self.done("event_study", out):
                events = df.select("Ticker", "EventDate", F.col(measure).alias("Sentiment"))
                write_csv(regression.regression_summary(self.cumulated(events, self.windows()), "CAR", "Sentiment", "Ticker", measure), out)
                written += 1
        state["status"] = "ok" if written else "skipped"

    def horserace(self, state: dict) -> None:
        out = self.outputs / "event_study" / "horserace_summary.csv"
        if self.done("horserace", out):
            state["status"] = "skipped"
            return
        df = self.panel()
        events = df.select("Ticker", "EventDate").distinct()
        write_csv(horserace.horserace(self.cumulated(events, self.windows("horserace")), df, self.paper, self.run_id), out)


def run_study(spark: SparkSession, root: str | Path, config: dict) -> Study:
    """Runs the stages that are on, in their fixed order."""
    study = Study.start(spark, root, config)
    study.log.info("Study %s, run %s", study.paper, study.run_id)
    for name in STAGES:
        if config.get("stages", {}).get(name):
            with study.timed(name) as state:
                getattr(study, name)(state)
        else:
            study.log.info("Stage %s disabled", name)
    return study
