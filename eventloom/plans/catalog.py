"""The registered queries over the reference's operators, with their DuckDB counterparts.

Floating results are rounded on both sides, and 0.0 is added so that no result is a negative zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite, first_four_digits, lenient_date, lenient_double, lookup_code, pad_code, posix_path, securities_code
from ..operators import car, chunks, horserace, market_model, panel, refdata, regression, returns
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rd(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)


PRICES = """prices AS (SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE isodow(CAST(l_shipdate AS DATE)) <= 5 GROUP BY 1, 2)"""
RETURNS = f"""{PRICES},
market AS (SELECT date, avg(price) AS close FROM prices GROUP BY 1),
mret AS (SELECT * FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS mr FROM market) WHERE mr IS NOT NULL),
sret AS (SELECT * FROM (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM prices) WHERE r IS NOT NULL)"""
MODEL = f"""{RETURNS},
both_r AS (SELECT ticker, s.date, r, mr FROM sret s JOIN mret m ON s.date = m.date),
model AS (SELECT * FROM (SELECT ticker, regr_intercept(r, mr) AS alpha, regr_slope(r, mr) AS beta FROM both_r GROUP BY 1) WHERE alpha IS NOT NULL AND beta IS NOT NULL)"""
EVENTS = """ev AS (SELECT o_orderkey AS event_id, n_name AS ticker, CAST(o_orderdate AS DATE) AS d, o_totalprice AS score, c_mktsegment AS industry
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
SNAP = f"""{MODEL}, {EVENTS},
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM sret)),
snapped AS (SELECT ev.*, cal.i FROM ev ASOF JOIN cal ON ev.d >= cal.date)"""
CAR = f"""{SNAP},
ar AS (SELECT x.ticker, cal.i, r - (coalesce(alpha, 0) + coalesce(beta, 1) * mr) AS ar
  FROM both_r x JOIN cal ON x.date = cal.date LEFT JOIN model ON x.ticker = model.ticker),
w AS (SELECT * FROM (VALUES (0, 0), (0, 1), (-1, 1), (-2, 2), (-3, 3)) t(lo, hi)),
spot AS (SELECT DISTINCT ticker, i FROM snapped),
spot_car AS (SELECT spot.ticker, spot.i, lo, hi, sum(ar) AS car FROM spot CROSS JOIN w JOIN ar ON ar.ticker = spot.ticker AND ar.i BETWEEN spot.i + lo AND spot.i + hi GROUP BY ALL),
car AS (SELECT event_id, s.ticker, d, score, industry, lo, hi, car FROM snapped s JOIN spot_car c ON s.ticker = c.ticker AND s.i = c.i)"""


def _returns(spark, d):
    p = b.prices(spark, d)
    stock = returns.stock_returns(p.withColumnRenamed("price", "close"))
    return stock, returns.market_returns(b.market(p))


def _car(spark, d, windows=car.WINDOWS):
    stock, market = _returns(spark, d)
    return car.cumulate(b.events(spark, d), stock, market, market_model.market_model(stock, market), windows)


# --- scans, projections, predicates ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship_date FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30")
def scan_prune(spark, d):
    return b.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 30").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship_date"))


_RAW = "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END"
_RAW_DATE = "CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""SELECT * FROM (SELECT o_orderkey, try_cast({_RAW} AS DOUBLE) AS price, CAST(try_strptime({_RAW_DATE}, '%Y-%m-%d') AS DATE) AS day FROM orders) WHERE price IS NOT NULL AND day IS NOT NULL""")
def coerce_dropna(spark, d):
    o = b.table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.floor("o_totalprice").cast("long").cast("string"))
    date = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", lenient_double(raw).alias("price"), lenient_date(date).alias("day")).na.drop(subset=["price", "day"])


@query("SELECT l_orderkey, l_linenumber, round(l_tax / l_discount, 6) + 0.0 AS ratio FROM lineitem WHERE l_discount <> 0 AND l_tax IS NOT NULL")
def finite_filter(spark, d):
    df = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_tax", "l_discount").alias("x"))
    return df.where(finite(F.col("x"))).select("l_orderkey", "l_linenumber", rd("x").alias("ratio"))


@query("""SELECT count(*) AS n_all, count(*) FILTER (o_orderstatus = 'F') AS n_listed,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS n_domestic,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND length(CAST(o_custkey AS VARCHAR)) <> 3) AS n_coded FROM orders""")
def listed_filter_counts(spark, d):
    steps = [("listed", F.col("o_orderstatus") == "F"), ("domestic", F.col("o_orderpriority") == "1-URGENT"), ("coded", refdata.valid_code(F.col("o_custkey")))]
    return refdata.steps(b.table(spark, d, "orders"), steps)[1]


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND length(CAST(o_custkey AS VARCHAR)) <> 3""")
def listed_filter(spark, d):
    steps = [("listed", F.col("o_orderstatus") == "F"), ("domestic", F.col("o_orderpriority") == "1-URGENT"), ("coded", refdata.valid_code(F.col("o_custkey")))]
    return refdata.steps(b.table(spark, d, "orders"), steps)[0].select("o_orderkey")


@query("""SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS code,
  lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(4, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') || '.T' AS symbol,
  s_name AS company_ja, CAST(NULL AS VARCHAR) AS name_ja, CAST(NULL AS VARCHAR) AS sector_sub, CAST(NULL AS DATE) AS asof_date FROM supplier""")
def default_columns(spark, d):
    raw = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") > 1, F.lit("kept")).alias("symbol"), F.col("s_name").alias("company_ja"))
    return refdata.constituents(raw)


@query("""SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) < 4 THEN lpad(CAST(s_suppkey AS VARCHAR), 4, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS code FROM supplier""")
def code_pad(spark, d):
    return b.table(spark, d, "supplier").select("s_suppkey", pad_code(F.col("s_suppkey").cast("string")).alias("code"))


_SEC = "regexp_replace(regexp_replace(trim(CAST(c_custkey AS VARCHAR) || '0.0'), '\\.0$', ''), '0$', '')"
_LOOK = "regexp_replace(translate(trim(' ' || substr(c_name, 10) || '-'), ' -_.', ''), '0+$', '')"
_PAD = lambda x: f"CASE WHEN length({x}) < 4 THEN lpad({x}, 4, '0') ELSE {x} END"


@query(f"SELECT c_custkey, {_PAD(_SEC)} AS sec, {_PAD(_LOOK)} AS look, nullif(regexp_extract(c_name, '[0-9]{{4}}'), '') AS four FROM customer")
def code_normalise(spark, d):
    c = b.table(spark, d, "customer")
    dirty = F.concat(F.lit(" "), F.substring("c_name", 10, 100), F.lit("-"))
    return c.select("c_custkey", securities_code(F.concat(F.col("c_custkey").cast("string"), F.lit("0.0"))).alias("sec"), lookup_code(dirty).alias("look"), first_four_digits(F.col("c_name")).alias("four"))


@query(r"SELECT p_partkey, replace(replace('C:\data\' || p_brand || '\' || p_type, 'C:\data', '/mnt/data'), '\', '/') AS path FROM part")
def path_rewrite(spark, d):
    raw = F.concat(F.lit("C:\\data\\"), F.col("p_brand"), F.lit("\\"), F.col("p_type"))
    return b.table(spark, d, "part").select("p_partkey", posix_path(raw, "C:\\data", "/mnt/data").alias("path"))


# --- panel -------------------------------------------------------------------------------------------------------


def _sides(spark, d):
    left = b.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("size"))
    right = b.table(spark, d, "labels").select("doc_id", "quality", "toxic", (F.col("quality") + F.col("toxic")).alias("size"))
    return left, right


_LEFT = "(SELECT doc_id, lang, n_chars AS size FROM documents WHERE doc_id IS NOT NULL) a"
_RIGHT = "(SELECT doc_id, quality, toxic, quality + toxic AS size FROM labels WHERE doc_id IS NOT NULL) b"


def _merge_sql(how: str) -> str:
    return f"SELECT doc_id, lang, a.size AS size_x, quality, toxic, b.size AS size_y FROM {_LEFT} {how} JOIN {_RIGHT} USING (doc_id)"


@query(_merge_sql("INNER") + " WHERE quality IS NOT NULL AND lang IS NOT NULL")
def panel_merge_inner(spark, d):
    return panel.merge(*_sides(spark, d), ["doc_id"], "inner", ["quality", "lang"])


@query(_merge_sql("LEFT"))
def panel_merge_left(spark, d):
    return panel.merge(*_sides(spark, d), ["doc_id"], "left")


@query(_merge_sql("RIGHT"))
def panel_merge_right(spark, d):
    return panel.merge(*_sides(spark, d), ["doc_id"], "right")


@query(_merge_sql("FULL"))
def panel_merge_outer(spark, d):
    return panel.merge(*_sides(spark, d), ["doc_id"], "outer")


@query("""WITH l AS (SELECT count(*) n, count(DISTINCT (l_orderkey, l_suppkey)) k FROM lineitem), o AS (SELECT count(*) n, count(DISTINCT o_custkey) k FROM orders),
m AS (SELECT count(*) n, count(DISTINCT doc_id) k, count(*) FILTER (quality IS NULL) q, count(*) FILTER (lang IS NULL) g FROM documents LEFT JOIN labels USING (doc_id))
SELECT l.n AS left_n_rows, l.k AS left_n_keys, l.n - l.k AS left_n_duplicates, o.n AS right_n_rows, o.k AS right_n_keys, o.n - o.k AS right_n_duplicates,
m.n AS merged_n_rows, m.k AS merged_n_keys, m.n - m.k AS merged_n_duplicates, m.q AS null_quality, m.g AS null_lang FROM l, o, m""")
def panel_qc(spark, d):
    merged = panel.merge(*_sides(spark, d), ["doc_id"], "left")
    left = b.table(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_suppkey").alias("doc_id"))
    right = b.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"))
    return panel.panel_qc(left, right, merged, ["doc_id"], ["quality", "lang"])


# --- reference data ----------------------------------------------------------------------------------------------


@query(f"""SELECT s_suppkey AS code, s_name, c_name, c_custkey FROM supplier LEFT JOIN customer ON {_PAD('CAST(s_suppkey AS VARCHAR)')} = {_PAD(_SEC)}""")
def n225_left_join(spark, d):
    members = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_name")
    codes = b.table(spark, d, "customer").select("c_name", "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("0.0")).alias("sec"))
    return refdata.join_codelist(members, codes, "sec").drop("sec")


def _codelists(spark, d, whole: bool = False):
    ja = b.table(spark, d, "supplier").where("true" if whole else "s_suppkey % 3 <> 0").select(F.concat(F.lit(" E"), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("ＥＤＩＮＥＴコード"), F.concat(F.lit("業"), F.col("s_nationkey").cast("string")).alias("提出者業種"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit("0")).alias("証券コード"))
    en = b.table(spark, d, "supplier").where("true" if whole else "s_suppkey % 2 = 0").select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("EDINET Code"), F.concat(F.lit("industry "), F.col("s_nationkey").cast("string")).alias("Submitter's industry"))
    return ja, en


_JA = "ja AS (SELECT 'E' || s_suppkey AS code, '業' || s_nationkey AS jp, lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS sec FROM supplier WHERE s_suppkey % 3 <> 0)"
_EN = "en AS (SELECT 'E' || s_suppkey AS code, 'industry ' || s_nationkey AS en FROM supplier WHERE s_suppkey % 2 = 0)"


@query(f"WITH {_JA}, {_EN} SELECT code AS edinet_code, jp AS industry_jp, en AS industry_en FROM ja FULL JOIN en USING (code)")
def industry_full_outer(spark, d):
    return refdata.industry_map(*_codelists(spark, d))


@query(f"""WITH {_JA}, {_EN}, m AS (SELECT code, jp, en FROM ja FULL JOIN en USING (code))
SELECT l_orderkey, l_linenumber, jp AS industry_jp, en AS industry_en, jp AS industry FROM lineitem LEFT JOIN m ON 'E' || l_suppkey = code WHERE l_returnflag = 'A'""")
def attach_industry(spark, d):
    lines = b.table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("edinet_code"))
    return refdata.attach_by_code(lines, refdata.industry_map(*_codelists(spark, d)), "both").drop("edinet_code")


@query(f"""WITH {_JA.split(" WHERE ")[0]}), {_EN.split(" WHERE ")[0]}), m AS (SELECT code, jp, en FROM ja FULL JOIN en USING (code))
SELECT l_orderkey, l_linenumber, jp AS industry_jp, en AS industry_en, jp AS industry FROM lineitem LEFT JOIN m ON 'E' || l_suppkey = code""")
def attach_industry_all(spark, d):
    """attach_industry over all lines and all codes."""
    lines = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("edinet_code"))
    return refdata.attach_by_code(lines, refdata.industry_map(*_codelists(spark, d, whole=True)), "both").drop("edinet_code")


@query(f"""WITH {_JA}, {_EN}, m AS (SELECT code, jp, en FROM ja FULL JOIN en USING (code))
SELECT s_suppkey, en AS industry_en, en AS industry FROM supplier LEFT JOIN ja ON sec = lpad(CAST(s_suppkey AS VARCHAR), 4, '0') LEFT JOIN m ON m.code = ja.code""")
def attach_industry_by_ticker(spark, d):
    ja, en = _codelists(spark, d)
    tickers = b.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit(".T")).alias("Ticker"))
    return refdata.attach_by_ticker(tickers, ja, refdata.industry_map(ja, en), label="en").drop("Ticker")


@query(f"""WITH e AS (SELECT k, arg_min(c_name, c_custkey) AS v FROM (SELECT {_PAD("regexp_replace(CAST(c_custkey AS VARCHAR), '0+$', '')")} AS k, c_name, c_custkey FROM customer) GROUP BY k)
SELECT s_suppkey, v AS found FROM supplier LEFT JOIN e ON {_PAD("regexp_replace(CAST(s_suppkey AS VARCHAR), '0+$', '')")} = k""")
def lookup_batch(spark, d):
    return refdata.lookup(b.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", b.table(spark, d, "customer"), "c_custkey", "c_name", "c_custkey", lookup_code)


@query("SELECT DISTINCT c_mktsegment AS industry FROM customer WHERE c_mktsegment IS NOT NULL")
def sorted_industries(spark, d):
    return refdata.sorted_industries(b.table(spark, d, "customer"), "c_mktsegment")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""")
def section_ffill(spark, d):
    lines = b.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("h"))
    return refdata.carry_headers(lines, F.col("h"), "turn", ["conv_id"]).select("conv_id", "turn", "header")


# --- returns, calendars, market models ---------------------------------------------------------------------------


@query(f"WITH {RETURNS} SELECT date, round(mr, 6) + 0.0 AS market_return FROM mret")
def market_return(spark, d):
    return returns.market_returns(b.market(b.prices(spark, d))).select(F.col("Date").alias("date"), rd("MarketReturn").alias("market_return"))


@query(f"WITH {RETURNS} SELECT ticker, date, round(r, 6) + 0.0 AS ret FROM sret")
def stock_return(spark, d):
    return _returns(spark, d)[0].select(F.col("Ticker").alias("ticker"), F.col("Date").alias("date"), rd("Return").alias("ret"))


@query(f"""WITH {PRICES}, gaps AS (SELECT ticker, date, CASE WHEN day(date) % 3 <> 0 THEN price END AS p FROM prices),
filled AS (SELECT ticker, date, last_value(p IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM gaps)
SELECT * FROM (SELECT ticker, date, round(p / lag(p) OVER (PARTITION BY ticker ORDER BY date) - 1, 6) + 0.0 AS ret FROM filled) WHERE ret IS NOT NULL""")
def stock_return_ffill(spark, d):
    p = b.prices(spark, d).withColumn("close", F.when(F.dayofmonth("date") % 3 != 0, F.col("price")))
    r = returns.stock_returns(p, fill="ffill")
    return r.select(F.col("Ticker").alias("ticker"), F.col("Date").alias("date"), rd("Return").alias("ret"))


@query(f"WITH {RETURNS} SELECT DISTINCT s.date FROM sret s JOIN mret m ON s.date = m.date WHERE day(m.date) <> 1")
def calendar_intersection(spark, d):
    stock, market = _returns(spark, d)
    return returns.overlap(stock, market.where(F.dayofmonth("Date") != 1))[0].select(F.col("Date").alias("date")).distinct()


@query(f"WITH {MODEL}, n AS (SELECT ticker, count(*) AS n FROM both_r GROUP BY 1) SELECT min(n) AS n_min, median(n) AS n_median, max(n) AS n_max, count(*) AS tickers FROM n")
def obs_per_ticker(spark, d):
    return market_model.observations(*_returns(spark, d))


@query(f"WITH {MODEL} SELECT ticker, round(alpha, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta FROM model")
def market_model_fit(spark, d):
    return market_model.market_model(*_returns(spark, d)).select(F.col("Ticker").alias("ticker"), rd("alpha").alias("alpha"), rd("beta").alias("beta"))


# --- events ------------------------------------------------------------------------------------------------------


@query(f"WITH {SNAP} SELECT event_id, CAST(i AS BIGINT) AS i FROM snapped")
def asof_snap(spark, d):
    stock, _ = _returns(spark, d)
    return car.snap(b.events(spark, d), returns.calendar(stock)).select("event_id", F.col("i").cast("long").alias("i"))


@query(f"WITH {CAR} SELECT event_id, lo AS window_start, hi AS window_end, round(car, 6) + 0.0 AS car FROM car")
def car_windows(spark, d):
    return _car(spark, d).select("event_id", "window_start", "window_end", rd("CAR").alias("car"))


def _one_window(name: str, lo: int, hi: int) -> None:
    def f(spark, d):
        return _car(spark, d, [(lo, hi)]).select("event_id", rd("CAR").alias("car"))

    f.__name__ = name
    query(f"WITH {CAR} SELECT event_id, round(car, 6) + 0.0 AS car FROM car WHERE lo = {lo} AND hi = {hi}")(f)


for _name, _lo, _hi in (("car_0_0", 0, 0), ("car_0_1", 0, 1), ("car_m1_1", -1, 1), ("car_m2_2", -2, 2), ("car_m3_3", -3, 3)):
    _one_window(_name, _lo, _hi)


@query("""WITH m AS (SELECT avg(o_totalprice) a, stddev_pop(o_totalprice) s FROM orders)
SELECT o_orderkey, round((o_totalprice - a) / s, 6) + 0.0 AS z, CAST(1 AS DOUBLE) AS flat FROM orders, m""")
def zscore(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1.0).alias("one"))
    return regression.zscore(o, {"o_totalprice": "zz", "one": "flat"}).select("o_orderkey", rd("zz").alias("z"), "flat")


def _ols_sql(measure: str, tag: str = "") -> str:
    """Clustered least squares of car on a standardised measure of the relation base (lo, hi, ticker, car, measures)."""
    return f"""z{tag} AS (SELECT lo, hi, ticker, car AS y, ({measure} - avg({measure}) OVER w) / stddev_pop({measure}) OVER w AS x FROM base WINDOW w AS (PARTITION BY lo, hi)),
f{tag} AS (SELECT lo, hi, count(*) n, count(DISTINCT ticker) g, regr_slope(y, x) b, regr_intercept(y, x) a, regr_r2(y, x) r2, regr_sxx(y, x) sxx, avg(x) mx FROM z{tag} GROUP BY 1, 2),
s{tag} AS (SELECT z.lo, z.hi, sum((x - mx) * (y - a - b * x)) AS s FROM z{tag} z JOIN f{tag} f ON z.lo = f.lo AND z.hi = f.hi GROUP BY z.lo, z.hi, ticker),
m{tag} AS (SELECT lo, hi, sum(s * s) AS meat FROM s{tag} GROUP BY 1, 2),
fit{tag} AS (SELECT f.lo, f.hi, n, g, b, r2, sqrt(meat * g / (g - 1) * (n - 1) / (n - 2)) / sxx AS se FROM f{tag} f JOIN m{tag} m ON f.lo = m.lo AND f.hi = m.hi)"""


@query(f"WITH {CAR}, base AS (SELECT *, score AS measure FROM car), {_ols_sql('measure')} SELECT lo AS window_start, hi AS window_end, n AS nobs, g AS clusters, round(b, 6) + 0.0 AS beta, round(se, 6) + 0.0 AS se_cluster, round(b / se, 5) + 0.0 AS z, round(r2, 8) + 0.0 AS r2 FROM fit")
def cluster_ols(spark, d):
    by = ["window_start", "window_end"]
    fit = regression.cluster_ols(_car(spark, d), "CAR", "Sentiment", "Ticker", by, standardise=True)
    return fit.select(*by, "nobs", "clusters", rd("beta").alias("beta"), rd("se_cluster").alias("se_cluster"), rd(F.col("beta") / F.col("se_cluster"), 5).alias("z"), rd("r2", 8).alias("r2"))


@query(f"WITH {CAR}, base AS (SELECT *, score AS measure FROM car), {_ols_sql('measure')} SELECT 'document_score' AS sentiment_col, lo AS window_start, hi AS window_end, n AS nobs, round(b, 6) + 0.0 AS beta, round(se, 6) + 0.0 AS se_cluster, round(r2, 8) + 0.0 AS r2 FROM fit")
def regression_summary(spark, d):
    """Without the p-value, which SQL has no function for; tests hold it against erfc."""
    out = regression.regression_summary(_car(spark, d), "CAR", "Sentiment", "Ticker", "document_score")
    return out.select("sentiment_col", "window_start", "window_end", "nobs", rd("beta").alias("beta"), rd("se_cluster").alias("se_cluster"), rd("r2", 8).alias("r2"))


def _horse_inputs(spark, d):
    events = b.events(spark, d).join(b.rates(spark, d), "event_id").withColumnRenamed("Sentiment", "document_score")
    got = _car(spark, d).drop("industry", "Sentiment").join(events.drop("Ticker", "EventDate"), "event_id")
    return got


def _prepared(spark, d):
    df = _horse_inputs(spark, d).withColumns({c: lenient_double(F.col(c)) for c in ("CAR", *horserace.MEASURES)}).na.drop(subset=["Ticker", "CAR", *horserace.MEASURES])
    return regression.zscore(df, horserace.MEASURES, ["window_start", "window_end"]).withColumn("year", F.year("EventDate"))


RATES = "rates AS (SELECT l_orderkey AS event_id, avg(l_discount) AS pos_rate, avg(l_tax) AS neg_rate, avg(l_discount) - avg(l_tax) AS lmmd_net FROM lineitem GROUP BY 1)"
_SINGLE = {"GPT": "score", "LMMD": "lmmd_net", "LMMD_Neg": "neg_rate", "LMMD_Pos": "pos_rate"}


def _single_sql() -> str:
    parts = ", ".join(_ols_sql(measure, f"_{spec}") for spec, measure in _SINGLE.items())
    union = " UNION ALL ".join(f"SELECT '{s}' AS spec, lo AS window_start, hi AS window_end, n AS nobs, round(b, 6) + 0.0 AS beta, round(se, 6) + 0.0 AS se, round(r2, 8) + 0.0 AS r2 FROM fit_{s}" for s in _SINGLE)
    return f"WITH {CAR}, {RATES}, base AS (SELECT car.*, pos_rate, neg_rate, lmmd_net FROM car JOIN rates ON car.event_id = rates.event_id), {parts} {union}"


@query(_single_sql())
def horserace_single(spark, d):
    """The specifications of one regressor without fixed effects."""
    specs = {k: v for k, v in horserace.specifications().items() if k in _SINGLE}
    by = ["window_start", "window_end"]
    rows = regression.CellGram(_prepared(spark, d), "CAR", list(horserace.MEASURES.values()), "Ticker", "year", "industry", by).fit(specs)
    x = {k: v[0][0] for k, v in specs.items()}
    data = [(r["spec"], int(r["window_start"]), int(r["window_end"]), r["nobs"], r[f"beta_{x[r['spec']]}"], r[f"se_{x[r['spec']]}"], r["r2"]) for r in rows]
    df = spark.createDataFrame(data, "spec string, window_start int, window_end int, nobs long, beta double, se double, r2 double")
    return df.select("spec", *by, "nobs", rd("beta").alias("beta"), rd("se").alias("se"), rd("r2", 8).alias("r2"))


@query()
def horserace_grid(spark, d):
    # the join by (Ticker, EventDate) would fan out here, as many orders share both; the event's number joins instead
    rows = regression.CellGram(_prepared(spark, d), "CAR", list(horserace.MEASURES.values()), "Ticker", "year", "industry", ["window_start", "window_end"]).fit(horserace.specifications())
    return horserace.as_table(spark, rows, "orders", "run")


@query("""SELECT event_key, industry, CASE WHEN y = 1996 THEN 1.0 ELSE 0.0 END::DOUBLE AS year_1996, CASE WHEN y = 1997 THEN 1.0 ELSE 0.0 END::DOUBLE AS year_1997
FROM (SELECT o_orderkey AS event_key, o_orderpriority AS industry, year(o_orderdate) AS y FROM orders) WHERE y BETWEEN 1995 AND 1997""")
def year_fe_dummies(spark, d):
    o = b.table(spark, d, "orders").where(F.year("o_orderdate").between(1995, 1997)).select(F.col("o_orderkey").alias("event_key"), F.col("o_orderpriority").alias("industry"), F.to_date("o_orderdate").alias("day"))
    return regression.year_dummies(o, "day").drop("day")


_YEARS = range(1996, 2002)


@query(f"""SELECT event_key, industry, {", ".join(f"CASE WHEN y = {y} THEN 1.0 ELSE 0.0 END::DOUBLE AS year_{y}" for y in _YEARS)}
FROM (SELECT o_orderkey AS event_key, o_orderpriority AS industry, year(o_orderdate) AS y FROM orders)""")
def year_fe_dummies_all(spark, d):
    """year_fe_dummies over all years."""
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("event_key"), F.col("o_orderpriority").alias("industry"), F.to_date("o_orderdate").alias("day"))
    return regression.year_dummies(o, "day").drop("day")


@query(f"""WITH {CAR}, {EVENTS.replace('ev AS', 'p AS')}, k AS (SELECT ticker, d, count(*) AS n FROM p GROUP BY 1, 2)
SELECT lo AS window_start, hi AS window_end, CAST(sum(n) AS BIGINT) AS n_pairs FROM car JOIN k ON car.ticker = k.ticker AND car.d = k.d GROUP BY 1, 2""")
def car_panel_fanout(spark, d):
    """Repeated keys fan out in the join of CAR and panel; counted by key, as the pairs grow with the squares."""
    keys = b.events(spark, d).groupBy("Ticker", "EventDate").agg(F.count("*").alias("n"))
    joined = _car(spark, d).join(keys, ["Ticker", "EventDate"])
    return joined.groupBy("window_start", "window_end").agg(F.sum("n").alias("n_pairs"))


# --- nested documents --------------------------------------------------------------------------------------------


@query("""SELECT conv_id, round(avg(length(text)), 6) + 0.0 AS mean_chunk_score, round(median(length(text)), 6) + 0.0 AS median_chunk_score, count(text) AS num_chunks FROM conversations GROUP BY 1""")
def chunk_agg(spark, d):
    c = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.length("text").cast("string").alias("score"))).alias("chunks"))
    out = chunks.chunk_scores(c, "conv_id")
    return out.select("conv_id", rd("mean_chunk_score").alias("mean_chunk_score"), rd("median_chunk_score").alias("median_chunk_score"), "num_chunks")


@query("""SELECT label, round(avg(x), 6) + 0.0 AS mean_chunk_score, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1""")
def chunk_explode(spark, d):
    e = b.table(spark, d, "embeddings").select("label", F.explode_outer("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy("label").agg(rd(F.avg("x")).alias("mean_chunk_score"), F.count("*").alias("n"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def json_access(spark, d):
    return b.table(spark, d, "events").select("event_id", lenient_double(F.get_json_object("props", "$.k")).alias("k"))


_POS, _NEG = ["the", "and", "of"], ["idiot", "trash", "loser"]
_IN = lambda xs: "list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in xs) + "))"


@query(f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len({_IN(_POS)}) AS p, len({_IN(_NEG)}) AS q FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS token_count, CAST(p AS BIGINT) AS pos_count, CAST(q AS BIGINT) AS neg_count, round(CASE WHEN n > 0 THEN p / n ELSE 0 END, 8) + 0.0 AS pos_rate,
round(CASE WHEN n > 0 THEN q / n ELSE 0 END, 8) + 0.0 AS neg_rate, round(CASE WHEN n > 0 THEN p / n - q / n ELSE 0 END, 8) + 0.0 AS lmmd_net FROM c""")
def tone_rates(spark, d):
    t = chunks.tone(b.table(spark, d, "documents"), "doc_id", "text", _POS, _NEG)
    return t.select("doc_id", "token_count", "pos_count", "neg_count", rd("pos_rate", 8).alias("pos_rate"), rd("neg_rate", 8).alias("neg_rate"), rd("lmmd_net", 8).alias("lmmd_net"))


# --- appends -----------------------------------------------------------------------------------------------------


@query("""SELECT 'a' AS source, o_orderkey AS id, o_totalprice AS price, CAST(NULL AS VARCHAR) AS segment FROM orders
UNION ALL SELECT 'b' AS source, c_custkey AS id, CAST(NULL AS DOUBLE) AS price, c_mktsegment AS segment FROM customer""")
def sparse_append(spark, d):
    a = b.table(spark, d, "orders").select(F.lit("a").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    c = b.table(spark, d, "customer").select(F.lit("b").alias("source"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(c, allowMissingColumns=True)


@query("SELECT DISTINCT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS rank FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def dense_index(spark, d):
    from pyspark.sql import Window

    levels = b.table(spark, d, "orders").select("o_orderpriority").distinct()
    return levels.select("o_orderpriority", F.row_number().over(Window.orderBy("o_orderpriority")).cast("long").alias("rank"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def text_digest(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
