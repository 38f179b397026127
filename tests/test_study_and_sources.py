"""Readers, writers, files and a whole study over small fixtures."""

from __future__ import annotations

import datetime
import io
import json
import math
import zipfile

import pytest

from eventloom.operators import panel, regression
from eventloom.plans.study import Study, parse_windows, run_study
from eventloom.sources import files, readers, writers


def test_code_list(spark, tmp_path):
    text = 'about,2024-01-01\nＥＤＩＮＥＴコード,名,番号\nE1,"二\n行",12\nE2,x,\n'
    path = tmp_path / "list.csv"
    path.write_bytes(text.encode("cp932") + b"E3,\x81!,7\n")
    about, df = readers.read_codelist(spark, str(path))
    rows = {r["ＥＤＩＮＥＴコード"]: r for r in df.collect()}
    assert about == ["about", "2024-01-01"] and rows["E1"]["名"] == "二\n行" and rows["E1"]["番号"] == 12
    assert rows["E2"]["番号"] is None and rows["E3"]["番号"] == 7 and "�" in rows["E3"]["名"]


def test_csv_sections_and_analyses(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿a,b,c\n1,x,2.5\nq,y,\n", encoding="utf-8")
    typed = readers.read_typed_csv(spark, str(tmp_path / "a.csv"), "a int, c double")
    assert [(r.a, r.b, r.c) for r in typed.collect()] == [(1, "x", 2.5), (None, "y", None)]
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), columns=["b"]).columns == ["b"]
    (tmp_path / "s.txt").write_text("Foods\nCode\tCompany Name\n1332\tNissui\n\nMines\n1605\tInpex\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_sections(spark, str(tmp_path / "s.txt")).collect()] == [("Foods", "1332", "Nissui"), ("Mines", "1605", "Inpex")]
    (tmp_path / "S1_1.json").write_text(json.dumps({"mdna_found": True, "document_score": 0.5, "chunks": [{"score": 1, "label": "p", "evidence": ["e"]}]}))
    got = readers.read_analyses(spark, str(tmp_path / "S1_1.json")).first()
    assert got.doc == "S1_1" and got.document_score == 0.5 and len(got.chunks) == 1
    with pytest.raises(FileNotFoundError):
        readers.read_analyses(spark, str(tmp_path / "none.json"))


def test_files(tmp_path):
    waits, tries = [], []

    def opener(request, timeout):
        tries.append(request.full_url)
        if len(tries) < 3:
            raise OSError("no network")
        return io.BytesIO(b"data")

    got = files.download("http://host/x", tmp_path / "x.zip", retries=2, backoff=1.5, opener=opener, sleep=waits.append)
    assert got.bytes == 4 and waits == [1.5, 3.0] and not list(tmp_path.glob("*.part"))

    def dead(request, timeout):
        raise OSError("no network")

    with pytest.raises(RuntimeError):
        files.download("http://host/x", tmp_path / "y.zip", retries=0, opener=dead, sleep=waits.append)
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("foo.csv", "a,b\n1,2\n")
        z.writestr("bar/baz.txt", "hello")
    assert files.safe_unzip(tmp_path / "good.zip", tmp_path / "out") == ["foo.csv", "bar/baz.txt"]
    with pytest.raises(FileExistsError):
        files.safe_unzip(tmp_path / "good.zip", tmp_path / "out")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        files.safe_unzip(tmp_path / "bad.zip", tmp_path / "out")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, w string")
    writers.write_csv(df, tmp_path / "o" / "a.csv")
    assert (tmp_path / "o" / "a.csv").read_bytes().startswith(b"\xef\xbb\xbfa,w")
    writers.write_table(df, str(tmp_path / "t"), "w")
    assert (tmp_path / "t" / "w=x").exists()
    assert json.loads(writers.write_qc(tmp_path / "a.csv", {"n": 2}).read_text())["n"] == 2


def test_panel_keeps_and_drops(spark):
    left = spark.createDataFrame([("1301.T", "2024-01-04", 0.5, "f", "ok", "z")], "symbol string, filing_date string, document_score double, filename string, status string, filing_date_parsed string")
    right = spark.createDataFrame([("1301.T", "2024-01-04", 0.1, 0.2, 0.1, "g", "ok")], "symbol string, filing_date string, pos_rate double, neg_rate double, lmmd_net double, filename string, status string")
    assert set(panel.build_panel(left, right).columns) == {"symbol", "filing_date", "document_score", "status_x", "pos_rate", "neg_rate", "lmmd_net", "status_y"}


def test_windows():
    assert parse_windows([[0, 0], ["-1", 1]]) == [(0, 0), (-1, 1)] and parse_windows(None) == []
    with pytest.raises(ValueError):
        parse_windows([[1]])


def test_standardised_slope(spark):
    rows = [(f"t{i % 5}", float(i % 7), math.sin(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "Ticker string, x double, y double")
    a = regression.cluster_ols(df, "y", "x", "Ticker", standardise=True).first()
    b = regression.cluster_ols(regression.zscore(df, {"x": "z"}), "y", "z", "Ticker").first()
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in ("nobs", "clusters", "beta", "se_cluster", "r2"))


def test_study(spark, tmp_path):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(120) if (datetime.date(2024, 1, 1) + datetime.timedelta(k)).weekday() < 5]
    market = "date,adj_close\n" + "".join(f"{d},{100 + 5 * math.sin(k)}\n" for k, d in enumerate(days))
    tickers = ["1301.T", "1332.T", "1605.T", "7203.T"]
    stocks = "date,symbol,adj_close\n" + "".join(f"{d},{t},{50 + 3 * math.sin(k * (j + 1) / 2) + math.cos(k + j)}\n" for j, t in enumerate(tickers) for k, d in enumerate(days))
    events = [(t, days[10 + 9 * k + j]) for j, t in enumerate(tickers) for k in range(8)]
    gpt = "symbol,filing_date,document_score\n" + "".join(f"{t},{d},{math.sin(i)}\n" for i, (t, d) in enumerate(events))
    tone = "symbol,filing_date,pos_rate,neg_rate,lmmd_net\n" + "".join(f"{t},{d},{math.cos(i)},{math.cos(2 * i)},{math.cos(i) - math.cos(2 * i)}\n" for i, (t, d) in enumerate(events))
    for name, text in {"market": market, "stocks": stocks, "gpt": gpt, "tone": tone}.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    config = {
        "run": {"paper": "p", "run_id": "r1"}, "stages": dict.fromkeys(("build_panel", "market_model", "event_study", "horserace"), True),
        "build_panel": {"gpt_csv": "gpt.csv", "lmmd_csv": "tone.csv", "out_csv": "work/panel.csv"}, "market_model": {"market": "market.csv", "stocks": "stocks.csv", "out_csv": "work/ab.csv"},
        "event_study": {"measures": ["document_score", "lmmd_net"], "windows": [[0, 0], [-1, 1]]}, "horserace": {"windows": [[0, 1]]},
    }
    study = run_study(spark, tmp_path, config)
    out = study.outputs / "event_study"
    rows = (out / "regression_summary_document_score.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(rows) == 3 and (out / "regression_summary_lmmd_net.csv").exists()
    for r in rows[1:]:
        *_, beta, se, p, r2 = r.split(",")
        assert float(p) == pytest.approx(math.erfc(abs(float(beta) / float(se)) / math.sqrt(2)))
    race = (out / "horserace_summary.csv").read_text(encoding="utf-8-sig").splitlines()
    assert len(race) == 1 + 28 and all(",0,1," in x for x in race[1:])
    assert len((tmp_path / "work" / "ab.csv").read_text().splitlines()) == 5
    assert json.loads((tmp_path / "runs" / "p" / "r1" / "config_resolved.json").read_text())["run_id"] == "r1"
    run_study(spark, tmp_path, config)
    log = (study.outputs / "logs" / "run.log").read_text()
    assert log.count("status=ok") == 4 and log.count("status=skipped") == 4
    with pytest.raises(ValueError):
        run_study(spark, tmp_path, config | {"build_panel": {}})
    assert "status=failed" in (study.outputs / "logs" / "run.log").read_text() and Study
