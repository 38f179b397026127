"""Standardising and least squares with errors clustered by a key."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_double, normal_p


def zscore(df: DataFrame, columns: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """df with a population z-score of each column under a new name; where the deviation is 0, the raw value.

    columns maps sources to new names.  Moments are aggregated per group and joined back; groups are few (windows).
    """
    by = list(by)
    moments = df.groupBy(*by).agg(*(f(F.col(c)).alias(f"__{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(moments), by) if by else df.crossJoin(F.broadcast(moments))
    for c, z in columns.items():
        s = F.col(f"__s_{c}")
        out = out.withColumn(z, F.when((s == 0) | s.isNull() | F.isnan(s), F.col(c)).otherwise((F.col(c) - F.col(f"__m_{c}")) / s))
    return out.drop(*(f"__{k}_{c}" for c in columns for k in "ms"))


def cluster_ols(df: DataFrame, y: str, x: str, cluster: str, by: Sequence[str] = (), small_sample: bool = True, standardise: bool = False) -> DataFrame:
    """(by..., nobs, clusters, beta, se_cluster, r2): one regressor and a constant per group, errors clustered.

    standardise gives the figures of x as a population z-score in its group, without a second pass: a linear map of x only
    scales the slope and its error.

    All in SQL aggregates: moments per group, then scores per cluster.  Without variance of x, or with one cluster, beta
    and se are null.
    """
    by = list(by)
    df = df.select(*by, cluster, lenient_double(F.col(x)).alias("__x"), lenient_double(F.col(y)).alias("__y")).na.drop(subset=[cluster, "__x", "__y"])
    # sums per cluster suffice for both steps, so rows are read once
    per = df.groupBy(*by, cluster).agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in {"x": F.col("__x"), "y": F.col("__y"), "xx": F.col("__x") ** 2, "xy": F.col("__x") * F.col("__y"), "yy": F.col("__y") ** 2}.items()))
    total = per.groupBy(*by).agg(*(F.sum(k).alias(f"t_{k}") for k in ("n", "x", "y", "xx", "xy", "yy")), F.count("*").alias("g"))
    mx, my = F.col("t_x") / F.col("t_n"), F.col("t_y") / F.col("t_n")
    sxx = F.col("t_xx") - F.col("t_x") * mx
    total = total.withColumns({"mx": mx, "sxx": F.when(sxx > 1e-12 * F.col("t_xx"), sxx)})
    total = total.withColumn("b", (F.col("t_xy") - F.col("t_x") * my) / F.col("sxx")).withColumn("a", my - F.col("b") * mx)
    joined = per.join(F.broadcast(total), by) if by else per.crossJoin(F.broadcast(total))
    # the score of the slope, with x measured from its mean, is sum((x - mx) * (y - a - b * x))
    u0 = F.col("y") - F.col("a") * F.col("n") - F.col("b") * F.col("x")
    u1 = F.col("xy") - F.col("a") * F.col("x") - F.col("b") * F.col("xx")
    meat = joined.groupBy(*by).agg(F.sum((u1 - F.col("mx") * u0) ** 2).alias("meat"), *(F.first(c).alias(c) for c in ("t_n", "g", "b", "sxx", "t_yy", "t_y", "t_xy", "t_x", "a")))
    n, g = F.col("t_n").cast("double"), F.col("g").cast("double")
    factor = g / (g - 1) * (n - 1) / (n - 2) if small_sample else F.lit(1.0)
    syy = F.col("t_yy") - F.col("t_y") ** 2 / n
    fits = (F.col("g") > 1) & (F.col("t_n") > 2)
    scale = F.sqrt(F.col("sxx") / n) if standardise else F.lit(1.0)
    return meat.select(
        *by, F.col("t_n").alias("nobs"), F.col("g").alias("clusters"), (F.col("b") * scale).alias("beta"),
        F.when(fits, F.sqrt(F.col("meat") * F.when(fits, factor)) / F.col("sxx") * scale).alias("se_cluster"),
        F.when(syy > 0, F.col("b") ** 2 * F.col("sxx") / F.when(syy > 0, syy)).alias("r2"),
    )


def regression_summary(df: DataFrame, y: str, x: str, cluster: str, name: str, by: Sequence[str] = ("window_start", "window_end")) -> DataFrame:
    """Rows (sentiment_col, by..., nobs, beta, se_cluster, p_value, r2), sorted; x is standardised per group first."""
    fit = cluster_ols(df, y, x, cluster, by, standardise=True)
    rows = [(name, *(r[b] for b in by), r["nobs"], r["beta"], r["se_cluster"], normal_p(r["beta"] / r["se_cluster"]) if r["se_cluster"] else None, r["r2"]) for r in fit.orderBy(*by).collect()]
    kinds = {f.name: f.dataType.simpleString() for f in fit.schema}
    return df.sparkSession.createDataFrame(rows, f"sentiment_col string, {', '.join(f'{b} {kinds[b]}' for b in by)}, nobs long, beta double, se_cluster double, p_value double, r2 double")


def year_dummies(df: DataFrame, date: str, prefix: str = "year_") -> DataFrame:
    """df with 0/1 columns for each year but the first; a null date has 0 in all.  The years are collected: they are few."""
    year = F.year(date)
    levels = [r[0] for r in df.select(year.alias("y")).where("y is not null").distinct().orderBy("y").collect()]
    return df.withColumns({f"{prefix}{v}": F.coalesce((year == v).cast("double"), F.lit(0.0)) for v in levels[1:]})


class CellGram:
    """Clustered least squares of many specifications on one pass over the data.

    Rows are summed by (group, cluster, year, industry) cells: counts, and sums and products of the numbers.  Every
    specification's normal equations, with or without fixed effects, follow from cells, as dummies don't vary in a cell.
    The driver gets the cells summed over clusters (groups x years x industries rows), solves for the coefficients, and
    a second pass over the cells adds up the clusters' scores; so the number of clusters isn't bounded by the driver.
    """

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], cluster: str, year: str, industry: str, by: Sequence[str]):
        self.xs, self.by, self.numbers = list(xs), list(by), ["1", *xs, y]
        value = lambda c: F.lit(1.0) if c == "1" else F.col(c)
        self.pairs = list(combinations_with_replacement(range(len(self.numbers)), 2))
        sums = [F.sum(value(self.numbers[i]) * value(self.numbers[j])).alias(f"p{i}_{j}") for i, j in self.pairs]
        self.cells = df.groupBy(*by, F.col(cluster).alias("cluster"), F.col(year).alias("year"), F.col(industry).alias("industry")).agg(*sums).persist()
        self.totals = self.cells.groupBy(*by, "year", "industry").agg(*(F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in self.pairs)).toPandas()
        self.years = sorted(v for v in self.totals["year"].dropna().unique())
        self.industries = sorted(v for v in self.totals["industry"].dropna().unique())

    def design(self, xs: Sequence[str], year_fe: bool, industry_fe: bool) -> tuple[list[int], list, list]:
        return [0, *(self.numbers.index(x) for x in xs)], self.years[1:] if year_fe else [], self.industries[1:] if industry_fe else []

    def gram(self, cells, spec) -> np.ndarray:
        """Products of the columns (constant, regressors, dummies, y), summed over cells."""
        at, years, industries = spec
        at = [*at, len(self.numbers) - 1]
        k = len(at) - 1
        moments = np.zeros((len(cells), len(at), len(at)))
        for a, i in enumerate(at):
            for b, j in enumerate(at):
                moments[:, a, b] = cells[f"p{min(i, j)}_{max(i, j)}"].to_numpy(float)
        dummies = np.array([[y == v for v in years] + [x == v for v in industries] for y, x in zip(cells["year"], cells["industry"], strict=True)], float).reshape(len(cells), len(years) + len(industries))
        cross = np.einsum("cd,ca->da", dummies, moments[:, 0, :])  # a dummy times a number is the number's sum in its cells
        among = np.einsum("cd,ce,c->de", dummies, dummies, moments[:, 0, 0])
        m = moments.sum(axis=0)
        top = np.hstack([m[:k, :k], cross[:, :k].T, m[:k, k:]])
        middle = np.hstack([cross[:, :k], among, cross[:, k:]])
        return np.vstack([top, middle, np.hstack([m[k:, :k], cross[:, k:].T, m[k:, k:]])])

    def fit(self, specs: dict[str, tuple[Sequence[str], bool, bool]], small_sample: bool = True) -> list[dict]:
        """A dict per group and specification: by..., spec, nobs, clusters, r2 and beta, se and p of each regressor."""
        designs = {name: self.design(*s) for name, s in specs.items()}
        solved = {}
        for group, cells in self.totals.groupby(self.by, sort=True):
            for name, spec in designs.items():
                g = self.gram(cells, spec)
                bread = np.linalg.pinv(g[:-1, :-1], hermitian=True)
                solved[group, name] = (bread, bread @ g[:-1, -1], g)
        by, gram, beta = self.by, self.gram, {k: v[1] for k, v in solved.items()}

        def scores(frames):
            import pandas as pd

            meat, count, held = {}, {}, None

            def add(cells):
                for (*group, _), one in cells.groupby([*by, "cluster"]):
                    group = tuple(group)
                    count[group] = count.get(group, 0) + 1
                    for name, spec in designs.items():
                        g = gram(one, spec)
                        s = g[:-1, -1] - g[:-1, :-1] @ beta[group, name]
                        meat[group, name] = meat.get((group, name), 0) + np.outer(s, s)

            for pdf in frames:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                last = (pdf[[*by, "cluster"]] == pdf[[*by, "cluster"]].iloc[-1]).all(axis=1)
                held, pdf = pdf[last], pdf[~last]  # a cluster may go on in the next batch
                add(pdf)
            if held is not None:
                add(held)
            for (group, name), m in meat.items():
                i, j = np.triu_indices(len(m))
                yield pd.DataFrame({**{b: v for b, v in zip(by, group, strict=True)}, "spec": name, "i": i, "j": j, "v": m[i, j], "n": float(count[group])})

        kinds = {f.name: f.dataType.simpleString() for f in self.cells.schema}
        schema = f"{', '.join(f'{b} {kinds[b]}' for b in by)}, spec string, i int, j int, v double, n double"
        clean = type(self).__new__(type(self))
        clean.numbers = self.numbers
        gram = clean.gram  # without the DataFrames, for the executors
        parts = self.cells.where("cluster is not null").repartition(*by, "cluster").sortWithinPartitions(*by, "cluster").mapInPandas(scores, schema)
        sums = parts.groupBy(*by, "spec", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
        meats: dict = {}
        for r in sums:
            m, _ = meats.setdefault((tuple(r[b] for b in by), r["spec"]), (np.zeros_like(solved[tuple(r[b] for b in by), r["spec"]][0]), r["n"]))
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
        out = []
        for (group, name), (bread, coef, g) in solved.items():
            m, clusters = meats[group, name]
            n, k = g[0, 0], int(np.linalg.matrix_rank(g[:-1, :-1], hermitian=True))
            factor = clusters / (clusters - 1) * (n - 1) / (n - k) if small_sample and clusters > 1 and n > k else 1.0
            se = np.sqrt(np.clip(np.diag(bread @ m @ bread) * factor, 0, None)) if clusters > 1 else np.full(len(coef), math.nan)
            ssr = g[-1, -1] - coef @ g[:-1, -1]
            sst = g[-1, -1] - g[0, -1] ** 2 / n
            row = dict(zip(by, group, strict=True)) | {"spec": name, "year_fe": specs[name][1], "industry_fe": specs[name][2], "nobs": int(round(n)), "clusters": int(clusters), "r2": float(1 - ssr / sst) if sst > 0 else None}
            for i, x in enumerate(specs[name][0], 1):
                row |= {f"beta_{x}": float(coef[i]), f"se_{x}": float(se[i]) if se[i] == se[i] else None, f"p_{x}": normal_p(float(coef[i] / se[i])) if se[i] > 0 else None}
            out.append(row)
        self.cells.unpersist()
        return out
