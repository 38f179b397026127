"""The grid of specifications: measures against each other, with and without fixed effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lenient_double
from .regression import CellGram, zscore

MEASURES = {"document_score": "gpt_z", "lmmd_net": "lmmd_z", "neg_rate": "neg_z", "pos_rate": "pos_z"}
BASE = {"GPT": ["gpt_z"], "LMMD": ["lmmd_z"], "GPT+LMMD": ["gpt_z", "lmmd_z"], "LMMD_Neg": ["neg_z"], "LMMD_Pos": ["pos_z"], "LMMD_PosNeg": ["neg_z", "pos_z"], "GPT+Neg+Pos": ["gpt_z", "neg_z", "pos_z"]}


def specifications() -> dict[str, tuple[list[str], bool, bool]]:
    """28 names with their regressors and fixed effects."""
    return {f"{k}{'+YearFE' * y}{'+IndFE' * i}": (xs, y, i) for k, xs in BASE.items() for y in (False, True) for i in (False, True)}


def joined(car: DataFrame, panel: DataFrame) -> DataFrame:
    """CAR rows with the panel's measures, by Ticker and EventDate; repeated keys fan out."""
    measures = panel.select("Ticker", "EventDate", "industry", *MEASURES)
    return car.select("Ticker", "EventDate", "window_start", "window_end", "CAR").join(measures, ["Ticker", "EventDate"])


def prepared(car: DataFrame, panel: DataFrame) -> DataFrame:
    """Complete rows with the standardised measures and the year."""
    df = joined(car, panel)
    df = df.withColumns({c: lenient_double(F.col(c)) for c in ("CAR", *MEASURES)}).na.drop(subset=["Ticker", "CAR", *MEASURES])
    return zscore(df, MEASURES, ["window_start", "window_end"]).withColumn("year", F.year("EventDate"))


def horserace(car: DataFrame, panel: DataFrame, paper: str = "paper1", run_id: str = "run", specs: dict | None = None) -> DataFrame:
    """A row per window and specification; columns of regressors that a specification lacks are null."""
    rows = CellGram(prepared(car, panel), "CAR", list(MEASURES.values()), "Ticker", "year", "industry", ["window_start", "window_end"]).fit(specs or specifications())
    return as_table(car.sparkSession, rows, paper, run_id)


def as_table(spark: SparkSession, rows: list[dict], paper: str, run_id: str) -> DataFrame:
    """The fits as a table of fixed columns."""
    names = [f"{k}_{x}" for x in MEASURES.values() for k in ("beta", "se", "p")]
    schema = "paper string, run_id string, window_start int, window_end int, spec string, year_fe boolean, industry_fe boolean, nobs long, r2 double, " + ", ".join(f"{n} double" for n in names)
    data = [(paper, run_id, int(r["window_start"]), int(r["window_end"]), r["spec"], r["year_fe"], r["industry_fe"], r["nobs"], r["r2"], *(r.get(n) for n in names)) for r in rows]
    return spark.createDataFrame(data, schema)
