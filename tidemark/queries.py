"""Registered queries: every operator applied to whole tables, with SQL that gives the same rows.

Trades are the rows of ``events``: the event type is the symbol, the value its price, the id breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import intervals as iv
from tidemark.functions import normalize as nm
from tidemark.operators import candles as cd
from tidemark.operators import fundamentals as fd
from tidemark.operators import indicators as ind
from tidemark.operators import merge as mg
from tidemark.operators import monitoring as mon
from tidemark.operators import records as rec
from tidemark.plans import coverage, rollups, router
from tidemark.sources import feeds
from tidemark.sources.pages import FolderPages
from tidemark.streaming import candles as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Table = Callable[[str], DataFrame]
#: Fixed moments of the event log, so that results don't depend on the day of the run.
NOW, DAY_BEFORE = "2024-01-20 12:34:56", "2024-01-19 12:34:56"
NOW_MS = 1_705_754_096_000


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Table], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


WIDTHS = {"5": "5 minutes", "15": "15 minutes", "60": "1 hour", "240": "4 hours", "D": "1 day", "W": "7 days"}
BASE = "60"


def hourly(t: Table) -> DataFrame:
    return cd.bars(t("events"), BASE, "event_type", "ts", "value", "event_id")


def candle_sql(source: str, target: str, having: str = "") -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL '{WIDTHS[target]}', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY ts) AS close, sum(volume) AS volume, sum(turnover) AS turnover, count(*) AS n FROM {source} GROUP BY ALL {having}"""


def bars_sql(code: str = BASE) -> str:
    return f"""bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{WIDTHS[code]}', ts) AS ts, first(value ORDER BY ts, event_id) AS open,
        max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, sum(value * value) AS turnover,
        count(*) AS n FROM events GROUP BY ALL)"""


ROUNDED = "symbol, ts, open, high, low, close, round(volume, 4) AS volume, round(turnover, 4) AS turnover, n"


def rounded(candles: DataFrame) -> DataFrame:
    return candles.select("symbol", "ts", "open", "high", "low", "close", F.round("volume", 4).alias("volume"), F.round("turnover", 4).alias("turnover"), "n")


def candle_table(t: Table, name: str):
    """A stored table of hourly and daily candles of the events: session, path, and columns of a candle."""
    h = hourly(t).withColumn("interval", F.lit(BASE))
    rows = h.unionByName(cd.rollup(h.drop("n"), "D").withColumn("interval", F.lit("D")).select(h.columns))
    path = st.work_dir(rows.sparkSession, name)
    feeds.write_candles(rows, path)
    return rows.sparkSession, path, rows.schema


# candles ------------------------------------------------------------------------------------------------------------


@query("src_base_klines", f"WITH {bars_sql()} SELECT {ROUNDED} FROM bars WHERE symbol = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 100")
def src_base_klines(t):
    spark, path, kind = candle_table(t, "src_base_klines")
    symbols = t("events").select(F.col("event_type").alias("symbol")).distinct().where("symbol = 'purchase'")
    rows = feeds.read_candles(spark, path, kind, BASE, "2024-01-05", "2024-01-20").join(symbols, "symbol", "left_semi")
    return rounded(cd.newest(rows, cd.capped(100)))


@query("src_stored_klines", f"WITH {bars_sql()}, day AS ({candle_sql('bars', 'D')}) SELECT {ROUNDED} FROM day ORDER BY ts DESC, symbol LIMIT 50")
def src_stored_klines(t):
    spark, path, kind = candle_table(t, "src_stored_klines")
    table = feeds.stored_candles(spark, path, kind)
    base = table.where(F.col("interval") == BASE)
    return rounded(router.candles("D", BASE, base, lambda view: table.where(F.col("interval") == "D"), 50))


@query("agg_ohlcv_complete", f"WITH {bars_sql()} SELECT {ROUNDED} FROM ({candle_sql('bars', '240', 'HAVING count(*) >= 4')})")
def agg_ohlcv_complete(t):
    return rounded(cd.resample(hourly(t), BASE, "240"))


@query("agg_ohlcv_weekly", f"WITH {bars_sql('D')} SELECT {ROUNDED} FROM ({candle_sql('bars', 'W', 'HAVING count(*) >= 7')})")
def agg_ohlcv_weekly(t):
    return rounded(cd.resample(cd.bars(t("events"), "D", "event_type", "ts", "value", "event_id"), "D", "W"))


for _id, _code in (("agg_rollup_1h", "60"), ("agg_rollup_4h", "240"), ("agg_rollup_1d", "D")):
    query(_id, f"WITH {bars_sql('5')} SELECT {ROUNDED} FROM ({candle_sql('bars', _code)})")(
        lambda t, code=_code: rounded(cd.rollup(cd.bars(t("events"), "5", "event_type", "ts", "value", "event_id"), code))
    )


@query("agg_first_by_time", "SELECT user_id, first(value ORDER BY ts, event_id) AS first_value FROM events GROUP BY user_id")
def agg_first(t):
    return t("events").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first_value"))


@query("agg_last_by_time", "SELECT user_id, last(value ORDER BY ts, event_id) AS last_value FROM events GROUP BY user_id")
def agg_last(t):
    return t("events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("agg_having_min_count", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 3")
def agg_having(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("agg_time_range", "SELECT event_type AS symbol, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM events GROUP BY event_type")
def agg_time_range(t):
    return cd.time_range(t("events").select(F.col("event_type").alias("symbol"), "ts"))


def two_intervals(t: Table) -> DataFrame:
    h = hourly(t)
    return h.select("symbol", "ts", F.lit("60").alias("interval")).unionByName(cd.rollup(h, "D").select("symbol", "ts", F.lit("D").alias("interval")))


TWO = f"WITH {bars_sql()}, both_ AS (SELECT symbol, ts, '60' AS \"interval\" FROM bars UNION ALL SELECT symbol, ts, 'D' FROM ({candle_sql('bars', 'D')}))"


@query("agg_stats_by_interval", TWO + ' SELECT symbol, "interval", count(*) AS n, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM both_ GROUP BY ALL')
def agg_stats(t):
    return cd.stats_by_interval(two_intervals(t))


NAMES = "names AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'nothing')"


@query("agg_nested_json", TWO + f""", {NAMES}, s AS (SELECT symbol, "interval", count(*) AS n, min((epoch_us(ts) // 1000)) AS a, max((epoch_us(ts) // 1000)) AS b FROM both_ GROUP BY ALL)
    SELECT symbol, '[' || string_agg('{{"interval":' || coalesce('"' || "interval" || '"', 'null') || ',"n":' || coalesce(n::VARCHAR, 'null') || ',"first_ms":' || coalesce(a::VARCHAR, 'null')
    || ',"last_ms":' || coalesce(b::VARCHAR, 'null') || '}}', ',' ORDER BY "interval") || ']' AS stats FROM names LEFT JOIN s USING (symbol) GROUP BY symbol""")
def agg_nested(t):
    names = t("events").select(F.col("event_type").alias("symbol")).distinct()
    return cd.nested_stats(names.unionByName(names.sparkSession.createDataFrame([("nothing",)], "symbol string")), two_intervals(t))


@query("join_left_stats", "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_left_stats(t):
    stats = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t("customer").join(stats, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n", "total")


GAPS = f"""WITH {bars_sql()}, l AS (SELECT symbol, (epoch_us(ts) // 1000) AS ms, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY symbol ORDER BY ts) AS gap_end FROM bars),
    g AS (SELECT symbol, ms + 3600000 AS gap_start, gap_end FROM l WHERE gap_end - ms > 7200000)"""


ISLANDS = f"""{bars_sql()}, m AS (SELECT symbol, (epoch_us(ts) // 1000) AS ms FROM bars), g AS (SELECT symbol, ms, ms - 3600000 * row_number() OVER (PARTITION BY symbol ORDER BY ms) AS run FROM m),
    covered AS (SELECT symbol, min(ms) AS start_ms, max(ms) + 3600000 AS end_ms FROM g GROUP BY symbol, run)"""


@query("op_gaps", GAPS + " SELECT * FROM g")
def op_gaps(t):
    return cd.gaps(hourly(t), BASE)


@query("win_lead_gap", "SELECT user_id, event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 - (epoch_us(ts) // 1000) AS wait_ms FROM events")
def win_lead_gap(t):
    ahead = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_id", (iv.to_ms(ahead) - iv.to_ms(F.col("ts"))).alias("wait_ms"))


@query("op_first_gap", GAPS + f" SELECT symbol, gap_start, gap_end FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY gap_start) = 1 AND gap_end < {NOW_MS}")
def op_first_gap(t):
    return cd.first_gap(hourly(t), BASE, NOW_MS)


@query("op_page_gap", f"WITH {bars_sql()} SELECT symbol, greatest(0, (min((epoch_us(ts) // 1000)) - 1704000000000) // 3600000) AS missing FROM bars GROUP BY symbol")
def op_page_gap(t):
    return cd.page_gap(hourly(t), BASE, 1_704_000_000_000)


@query("srt_desc_limit", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def srt_desc_limit(t):
    return t("events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@query("srt_cte_limit", f"WITH {bars_sql()}, c AS ({candle_sql('bars', '240', 'HAVING count(*) >= 4')}) SELECT symbol, ts, open, close FROM (SELECT * FROM c ORDER BY ts DESC, symbol LIMIT 200) ORDER BY ts DESC, symbol")
def srt_cte_limit(t):
    return router.candles("240", BASE, hourly(t), lambda view: cd.resample(hourly(t), BASE, "240"), 200).select("symbol", "ts", "open", "close")


@query("srt_name", "SELECT n_name FROM nation ORDER BY n_name")
def srt_name(t):
    return t("nation").select("n_name").orderBy("n_name")


@query("srt_gap_start", GAPS + " SELECT symbol, gap_start FROM g ORDER BY gap_start, symbol")
def srt_gap_start(t):
    return cd.gaps(hourly(t), BASE).select("symbol", "gap_start").orderBy("gap_start", "symbol")


@query("srt_symbol_cmp", "SELECT p_name, p_brand FROM part ORDER BY p_name, p_brand")
def srt_symbol_cmp(t):
    return t("part").select("p_name", "p_brand").orderBy("p_name", "p_brand")


@query("lim_max_1000", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def lim_max(t):
    return t("lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(cd.capped(5000))


@query("topk_recent", "SELECT user_id, event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def topk_recent(t):
    return t("events").select("user_id", "event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)


@query("snk_json_api", f"WITH {bars_sql()} SELECT symbol, epoch_us(ts) // 1000 AS ms, open, high, low, close, round(volume, 4) AS volume, round(turnover, 4) AS turnover FROM bars")
def snk_json_api(t):
    """Candles as the interface's arrays of seven numbers, read back."""
    rows = cd.as_arrays(hourly(t)).select("symbol", F.from_json("row", "array<double>").alias("r"))
    values = [F.col("r")[k + 1].alias(c) for k, c in enumerate(cd.VALUES[:4])] + [F.round(F.col("r")[5], 4).alias("volume"), F.round(F.col("r")[6], 4).alias("turnover")]
    return rows.select("symbol", F.col("r")[0].cast("long").alias("ms"), *values)


# indicators ---------------------------------------------------------------------------------------------------------

ENOUGH = f"{bars_sql()}, e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS cnt FROM bars QUALIFY cnt >= 30)"
FRAME = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("ind_sma", f"WITH {ENOUGH}, s AS (SELECT symbol, ts, k, avg(close) {FRAME} AS sma FROM e) SELECT symbol, ts, round(sma, 6) AS sma FROM s WHERE k >= 20")
def ind_sma(t):
    return ind.sma(hourly(t)).select("symbol", "ts", *r6("sma"))


@query("ind_bbands", f"""WITH {ENOUGH}, s AS (SELECT symbol, ts, k, avg(close) {FRAME} AS m, stddev_pop(close) {FRAME} AS d FROM e)
    SELECT symbol, ts, round(m + 2 * d, 6) AS upper, round(m, 6) AS middle, round(m - 2 * d, 6) AS lower, round(4 * d / m, 6) AS bandwidth FROM s WHERE k >= 20""")
def ind_bbands(t):
    return ind.bollinger(hourly(t)).select("symbol", "ts", *r6("upper", "middle", "lower", "bandwidth"))


@query("ind_obv", f"""WITH {ENOUGH}, s AS (SELECT symbol, ts, volume, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM e)
    SELECT symbol, ts, round(sum(CASE WHEN p IS NULL OR close > p THEN volume WHEN close < p THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts), 4) AS obv FROM s""")
def ind_obv(t):
    return ind.obv(hourly(t)).select("symbol", "ts", F.round("obv", 4).alias("obv"))


@query("ind_ema", f"""WITH RECURSIVE {ENOUGH}, r AS (SELECT symbol, 20 AS k, avg(close) AS v FROM e WHERE k <= 20 GROUP BY symbol
    UNION ALL SELECT r.symbol, r.k + 1, r.v + (e.close - r.v) * 2 / 21 FROM r JOIN e ON e.symbol = r.symbol AND e.k = r.k + 1)
    SELECT e.symbol, e.ts, round(r.v, 6) AS ema FROM r JOIN e USING (symbol, k)""")
def ind_ema(t):
    return ind.ema(hourly(t)).select("symbol", "ts", *r6("ema"))


@query("ind_macd", f"""WITH RECURSIVE {ENOUGH}, r AS (SELECT symbol, 26 AS k, avg(close) FILTER (k > 14) AS f, avg(close) AS s FROM e WHERE k <= 26 GROUP BY symbol
    UNION ALL SELECT r.symbol, r.k + 1, r.f + (e.close - r.f) * 2 / 13, r.s + (e.close - r.s) * 2 / 27 FROM r JOIN e ON e.symbol = r.symbol AND e.k = r.k + 1),
    l AS (SELECT symbol, k, f - s AS line FROM r),
    g AS (SELECT symbol, 34 AS k, avg(line) AS v FROM l WHERE k <= 34 GROUP BY symbol
    UNION ALL SELECT g.symbol, g.k + 1, g.v + (l.line - g.v) * 2 / 10 FROM g JOIN l ON l.symbol = g.symbol AND l.k = g.k + 1)
    SELECT e.symbol, e.ts, round(l.line, 6) AS macd, round(g.v, 6) AS signal, round(l.line - g.v, 6) AS histogram FROM g JOIN l USING (symbol, k) JOIN e USING (symbol, k)""")
def ind_macd(t):
    return ind.macd(hourly(t)).select("symbol", "ts", *r6("macd", "signal", "histogram"))


@query("ind_rsi", f"""WITH RECURSIVE {ENOUGH}, c AS (SELECT symbol, ts, k, close - lag(close) OVER (PARTITION BY symbol ORDER BY k) AS d FROM e),
    r AS (SELECT symbol, 15 AS k, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM c WHERE k BETWEEN 2 AND 15 GROUP BY symbol
    UNION ALL SELECT r.symbol, r.k + 1, (r.g * 13 + greatest(c.d, 0)) / 14, (r.l * 13 + greatest(-c.d, 0)) / 14 FROM r JOIN c ON c.symbol = r.symbol AND c.k = r.k + 1)
    SELECT symbol, ts, round(CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END, 6) AS rsi FROM r JOIN c USING (symbol, k)""")
def ind_rsi(t):
    return ind.rsi(hourly(t)).select("symbol", "ts", *r6("rsi"))


BY_USER = "u AS (SELECT user_id::VARCHAR || event_type AS symbol, count(*) AS n_rows FROM events GROUP BY 1)"


@query("ind_min_rows", f"WITH {BY_USER} SELECT symbol, n_rows FROM u WHERE n_rows < 30")
def ind_min_rows(t):
    return ind.too_short(t("events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("symbol")))


SIX = " LEFT JOIN ".join(f"({ORACLES[f'ind_{name}']}){' USING (symbol, ts)' if k else ''}" for k, name in enumerate(("obv", "sma", "ema", "rsi", "macd", "bbands")))


@query("ind_dispatch", f"SELECT symbol, ts, obv, sma, ema, rsi, macd, signal, histogram, upper, middle, lower, bandwidth FROM {SIX}")
def ind_dispatch(t):
    """All six from one cut of the series; a parameter of 0 takes its default."""
    names = ("sma", "ema", "rsi", "macd", "signal", "histogram", "upper", "middle", "lower", "bandwidth")
    out = ind.indicators(hourly(t), {"obv": {}, "sma": {"length": 0}, "ema": {}, "rsi": {}, "macd": {}, "bb": {}})
    return out.select("symbol", "ts", F.round("obv", 4).alias("obv"), *r6(*names))


@query("flt_finite", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def flt_finite(t):
    return t("events").where(ind.finite("value")).select("event_id", "value")


# filters and projections --------------------------------------------------------------------------------------------


@query("flt_symbol_exchange", "SELECT s_suppkey, s_name FROM supplier WHERE s_name = 'Supplier#000000001' AND s_nationkey IS NOT NULL")
def flt_symbol_exchange(t):
    return t("supplier").where("s_name = 'Supplier#000000001' AND s_nationkey IS NOT NULL").select("s_suppkey", "s_name")


@query("flt_symbol_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def flt_symbol_exists(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("flt_interval_range", "SELECT event_id FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def flt_interval_range(t):
    return cd.in_range(t("events").where("event_type = 'click'"), "2024-01-05", "2024-01-10").select("event_id")


@query("flt_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_in_list(t):
    return t("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt_status_quote", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'N')")
def flt_status_quote(t):
    return t("lineitem").where((F.col("l_linestatus") == "O") & F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber")


@query("flt_confirmed", "SELECT event_id FROM events WHERE event_type = 'purchase'")
def flt_confirmed(t):
    return t("events").withColumn("confirm", F.col("event_type") == "purchase").where("confirm").select("event_id")


@query("flt_recent_24h", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{DAY_BEFORE}' AND ts <= TIMESTAMP '{NOW}'")
def flt_recent(t):
    return fd.recent(t("events").where(F.col("ts") <= moment(NOW)), "ts", moment(NOW)).select("event_id")


@query("flt_break_cutoff", f"SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{DAY_BEFORE}' GROUP BY user_id")
def flt_break(t):
    return fd.recent(t("events"), "ts", moment(NOW)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("flt_stale", f"WITH u AS (SELECT user_id, max(ts) AS a FROM events GROUP BY 1) SELECT c_custkey FROM customer LEFT JOIN u ON user_id = c_custkey WHERE coalesce(epoch(TIMESTAMP '{NOW}' - a) >= 604800, true)")
def flt_stale(t):
    seen = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("updated_at"))
    return mg.stale(t("customer").select("c_custkey"), seen, "c_custkey", moment(NOW).cast("timestamp"), 604_800)


@query("prj_rename_alias", "SELECT p_partkey AS id, p_name AS symbol_name FROM part")
def prj_rename(t):
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol_name"))


@query("prj_literal", "SELECT event_id, '60' AS \"interval\" FROM events")
def prj_literal(t):
    return t("events").select("event_id", F.lit("60").alias("interval"))


@query("prj_epoch_ms", "SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events")
def prj_epoch(t):
    return t("events").select("event_id", iv.to_ms(F.col("ts")).alias("ms"))


@query("prj_dto", "SELECT n_nationkey, n_name FROM nation")
def prj_dto(t):
    return t("nation").drop("n_regionkey").select("n_nationkey", "n_name")


@query("prj_flatten_json", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events")
def prj_flatten(t):
    return t("events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("prj_cast_float", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem")
def prj_cast(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("x"))


# joins and sets -----------------------------------------------------------------------------------------------------


@query("join_inner_dim", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("join_left_platforms", "SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_platforms(t):
    children = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = fd.with_children(t("customer").select("c_custkey"), children, "c_custkey", ["o_orderkey"], "orders")
    return out.select("c_custkey", F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("join_lookup_existing", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def join_lookup(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("join_semi_in_subquery", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def join_semi(t):
    return t("lineitem").join(t("part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("join_anti_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate >= DATE '1998-01-01')")
def join_anti_missing(t):
    recent = t("orders").where("o_orderstatus = 'P' OR o_orderdate >= DATE '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return mg.missing(t("customer").select("c_custkey"), recent, "c_custkey")


def market_pages(t):
    """Ids of coins, and pages of them as a market source sends them: by chunks of 250 ids, without some coins; the third chunk has an empty page, the fourth repeats coins."""
    ids = t("part").select(F.concat(F.lit("coin-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), "p_partkey", "p_size", "p_retailprice")
    chunks = feeds.id_chunks(ids)
    coin = F.struct("id", F.col("p_retailprice").cast("double").alias("current_price"), (F.col("p_size") * 1000).cast("double").alias("market_cap"))
    there = ids.join(chunks, "id").where("chunk <> 2 AND (p_size % 3 <> 0 OR chunk = 0)")
    pages = there.unionByName(there.where("chunk = 3")).groupBy("chunk").agg(F.to_json(F.collect_list(coin)).alias("value")).select("chunk", F.lit(1).alias("page"), "value")
    empty = chunks.select("chunk").distinct().select("chunk", F.explode(F.array(F.when(F.col("chunk") == 2, 1).otherwise(2))).alias("page"), F.lit("[]").alias("value"))
    return chunks, feeds.read_pages(pages.unionByName(empty))


IDS = """ids AS (SELECT 'coin-' || lpad(p_partkey::VARCHAR, 9, '0') AS id, p_size, p_retailprice, (row_number() OVER (ORDER BY p_partkey) - 1) // 250 AS chunk FROM part),
    sent AS (SELECT * FROM ids WHERE chunk <> 2 AND (p_size % 3 <> 0 OR chunk = 0)), pages AS (SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE chunk = 3)"""


@query("src_coin_markets", f"WITH {IDS} SELECT id, p_retailprice::DOUBLE AS price, (p_size * 1000)::DOUBLE AS cap, chunk FROM pages")
def src_coin_markets(t):
    _, read = market_pages(t)
    rows = read.select("chunk", F.explode("c").alias("c"))
    return rows.select("c.id", F.col("c.current_price").alias("price"), F.col("c.market_cap").alias("cap"), "chunk")


@query("set_missing_ids", f"""WITH {IDS}, got AS (SELECT chunk, count(*) AS n FROM pages GROUP BY chunk), asked AS (SELECT chunk, count(*) AS m FROM ids GROUP BY chunk)
    SELECT id, chunk, CASE WHEN coalesce(n, 0) = 0 THEN 'no page' WHEN n < m THEN 'short page' ELSE 'missing id' END AS why FROM ids JOIN asked USING (chunk) LEFT JOIN got USING (chunk) WHERE id NOT IN (SELECT id FROM pages)""")
def set_missing_ids(t):
    chunks, read = market_pages(t)
    return feeds.market_missing(chunks, read)


PLATFORMS = """SELECT user_id AS u, avg(value) FILTER (event_type = 'click') / 100 AS a, avg(value) FILTER (event_type = 'view') / 100 AS b, avg(value) FILTER (event_type = 'purchase') / 100 AS c FROM events GROUP BY 1"""


def platform_scores(t):
    def one(kind, name):
        return t("events").where(F.col("event_type") == kind).groupBy("user_id").agg((F.avg("value") / 100).alias(name))

    users = t("events").select("user_id").distinct()
    return users.join(one("click", "a"), "user_id", "left").join(one("view", "b"), "user_id", "left").join(one("purchase", "c"), "user_id", "left")


@query("join_sentiment_sources", f"SELECT u AS user_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM ({PLATFORMS})")
def join_sources(t):
    return platform_scores(t).select("user_id", *r6("a", "b", "c"))


@query("agg_platform_mean", f"SELECT u AS user_id, round(coalesce((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 0), 6) AS score FROM ({PLATFORMS})")
def agg_platform(t):
    return platform_scores(t).select("user_id", F.round(fd.present_mean(F.col("a"), F.col("b"), F.col("c")), 6).alias("score"))


@query("join_platform_halves", """SELECT customer.c_custkey, h.c_acctbal AS c_acctbal, h.n AS n FROM customer LEFT JOIN (SELECT c.c_custkey AS k, c.c_acctbal, n FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c.c_custkey WHERE c.c_acctbal > 0) h ON h.k = customer.c_custkey""")
def join_halves(t):
    profile = t("customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    activity = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return fd.both_halves(t("customer").select("c_custkey"), profile, activity, "c_custkey")


def symbol_sets(t):
    day = lambda d: t("events").where(F.col("ts").cast("date") == d).select("user_id").distinct()
    return day("2024-01-16"), day("2024-01-15")


@query("set_new", "SELECT user_id FROM events WHERE ts::DATE = DATE '2024-01-16' EXCEPT SELECT user_id FROM events WHERE ts::DATE = DATE '2024-01-15'")
def set_new(t):
    now, before = symbol_sets(t)
    return mg.missing(now, before, "user_id")


@query("set_delisted", "SELECT user_id FROM events WHERE ts::DATE = DATE '2024-01-15' EXCEPT SELECT user_id FROM events WHERE ts::DATE = DATE '2024-01-16'")
def set_delisted(t):
    now, before = symbol_sets(t)
    return mg.missing(before, now, "user_id")


@query("set_union_tokens", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).union(t("supplier").select("s_nationkey")).distinct()


COINS = """coins AS (SELECT replace(p_name, ' ', '-') || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '-' || p_partkey % 50 END AS id, string_split(p_name, ' ')[2] AS symbol, p_name || ' ' || lower(p_type) AS name, p_partkey AS position FROM part),
    words AS (SELECT *, string_split(lower(id), '-') AS iw, list_filter(string_split(lower(name), ' '), lambda x: x <> '') AS nw FROM coins),
    scores AS (SELECT position, id, lower(symbol) AS token, CASE WHEN list_contains(iw, lower(symbol)) THEN 100 ELSE 50 END - len(iw)::INT AS by_id, CASE WHEN list_contains(nw, lower(symbol)) THEN 100 ELSE 50 END - len(nw)::INT AS by_name,
        100 - length(regexp_replace(id, '[[:alnum:]]', '', 'g'))::INT - length(id)::INT AS plain FROM words),
    best AS (SELECT token, id FROM scores QUALIFY row_number() OVER (PARTITION BY token ORDER BY by_id DESC, by_name DESC, plain DESC, position) = 1)"""


def coins(t):
    k = F.col("p_partkey")
    coin_id = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("-"), (k % 50).cast("string"))))
    return t("part").select(coin_id.alias("id"), F.split("p_name", " ")[1].alias("symbol"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), k.alias("position"))


@query("topk_best_match", f"""WITH {COINS}, asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(w[2]) WHEN 1 THEN '1000' || w[2] WHEN 2 THEN w[1] ELSE '7' || w[1] END AS ticker FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)),
    one AS (SELECT ticker, id FROM asked LEFT JOIN best ON token = lower(ticker))
    SELECT ticker, coalesce(one.id, b.id) AS id, CASE WHEN one.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 END AS step FROM one LEFT JOIN best b ON one.id IS NULL AND regexp_matches(ticker, '^[0-9]') AND b.token = lower(ltrim(ticker, '0123456789'))""")
def topk_best(t):
    """Tickers as exchanges write them: in capitals, with a multiplier before them, and some that no coin has."""
    k, w = F.col("p_partkey") % 4, F.split("p_name", " ")
    ticker = F.when(k == 0, F.upper(w[1])).when(k == 1, F.concat(F.lit("1000"), w[1])).when(k == 2, w[0]).otherwise(F.concat(F.lit("7"), w[0]))
    return fd.resolve(t("part").select(ticker.alias("ticker")), coins(t))


@query("fn_token_score", f"WITH {COINS} SELECT position, by_id, by_name, plain FROM scores")
def fn_token_score(t):
    a, b, c = fd.token_score(F.col("id"), F.col("name"), F.col("symbol"))
    return coins(t).select("position", a.alias("by_id"), b.alias("by_name"), c.alias("plain"))


INSTRUMENTS = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'O') DESC, o_orderkey DESC) = 1"


def one_instrument(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "USDT").otherwise("USDC").alias("quote"))
    return fd.one_instrument(rows, "o_custkey", "quote", "o_orderkey").select("o_custkey", "o_orderkey")


query("dedup_symbol", INSTRUMENTS)(one_instrument)


@query("src_rest_symbols", """WITH i AS (SELECT 'P' || p_partkey AS symbol, p_brand AS base, CASE p_partkey % 3 WHEN 0 THEN 'USDT' WHEN 1 THEN 'USDC' ELSE 'EUR' END AS quote, p_size AS launch_ms, p_partkey FROM part
    WHERE p_size > 10 AND p_partkey % 3 < 2) SELECT symbol, base, quote, launch_ms::BIGINT AS launch_ms FROM i QUALIFY row_number() OVER (PARTITION BY base ORDER BY (quote <> 'USDT') DESC, p_partkey DESC) = 1""")
def src_rest_symbols(t):
    k = F.col("p_partkey") % 3
    item = F.struct(
        F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_brand").alias("baseCoin"), F.when(k == 0, "USDT").when(k == 1, "USDC").otherwise("EUR").alias("quoteCoin"),
        F.when(F.col("p_size") > 10, "Trading").otherwise("Closed").alias("status"), F.col("p_size").cast("string").alias("launchTime"),
    )
    page = t("part").groupBy("p_brand").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("list"))).alias("value"))
    return fd.one_instrument(feeds.instruments(page), "base", "quote", "position").select("symbol", "base", "quote", "launch_ms")


def kept_pages(t: Table, name: str) -> tuple[SparkSession, str, dict]:
    """Hourly candles as an interface of pages keeps them; with the options to read them."""
    bars = hourly(t)
    text = lambda c: F.col(c).cast("string")
    ms = iv.to_ms(F.col("ts"))
    row = F.array(ms.cast("string"), *[text(c) for c in ("open", "high", "low", "close", "volume", "turnover")])
    spark, path = bars.sparkSession, st.work_dir(bars.sparkSession, name)
    days = F.floor(ms / iv.DAY).cast("int")
    bars.select("symbol", days.alias("day"), row.alias("row")).repartition("symbol", "day").write.partitionBy("symbol", "day").json(f"{path}/pages")
    span = bars.agg(F.min(days).alias("a"), F.max(days).alias("b")).first()
    symbols = [r["symbol"] for r in bars.select("symbol").distinct().orderBy("symbol").collect()]
    return spark, path, {"path": f"{path}/pages", "symbols": ",".join(symbols), "interval": BASE, "first_day": str(span["a"]), "last_day": str(span["b"]), "start": str(FIRST_MS)}


FIRST_MS, HALF_MS = 1_704_200_400_000, 1_705_300_000_000


@query("src_rest_klines", f"WITH {bars_sql()} SELECT symbol, '60' AS \"interval\", epoch_us(ts) // 1000 AS ts_ms, open, high, low, close FROM bars WHERE epoch_us(ts) // 1000 BETWEEN {FIRST_MS} AND {NOW_MS}")
def src_rest_klines(t):
    """Pages read as a stream in two runs from one checkpoint, the first up to some moment and the second up to now."""
    spark, path, options = kept_pages(t, "src_rest_klines")
    spark.dataSource.register(FolderPages)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    for end in (HALF_MS, NOW_MS):
        stream = spark.readStream.format("folder_pages").options(**options, end=str(end)).load()
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("symbol", "interval", "ts_ms", "open", "high", "low", "close")


# writes -------------------------------------------------------------------------------------------------------------


def orders_batch(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = o.where("o_orderkey % 2 = 0")
    new = o.where("o_orderkey % 4 = 0 OR o_orderkey % 2 = 1")
    batch = new.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("v", F.lit(1)).unionByName(new.withColumn("v", F.lit(2)).withColumn("o_totalprice", F.col("o_totalprice") + 2))
    return old, batch


UPSERT = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 2 = 1 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders"


def upsert_orders(t):
    old, batch = orders_batch(t)
    return mg.upsert(old, batch, ["o_orderkey"], ["v"])


query("dml_upsert_klines", UPSERT)(upsert_orders)


@query("dml_upsert_metrics", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 5 ELSE p_retailprice END AS p_retailprice FROM part")
def dml_upsert_metrics(t):
    rows = t("part").select("p_partkey", "p_retailprice")
    return mg.upsert(rows, rows.where("p_partkey % 2 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 5), ["p_partkey"])


@query("dml_upsert_sentiment", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 0.5 ELSE -1.0 END::DOUBLE AS score FROM supplier WHERE s_nationkey < 20")
def dml_upsert_sentiment(t):
    s = t("supplier")
    old = s.where("s_nationkey >= 5 AND s_nationkey < 20").select("s_suppkey", F.lit(-1.0).alias("score"))
    return mg.upsert(old, s.where("s_nationkey < 10").select("s_suppkey", F.lit(0.5).alias("score")), ["s_suppkey"])


@query("snk_klines", f"WITH {bars_sql()}, day AS ({candle_sql('bars', 'D')}) SELECT symbol, 'D' AS \"interval\", ts, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN close + 1 ELSE close END AS close FROM day UNION ALL SELECT symbol, '60', ts, close FROM bars")
def snk_klines(t):
    spark, path, kind = candle_table(t, "snk_klines")
    symbols = t("events").select(F.col("event_type").alias("symbol")).distinct()
    later = feeds.read_candles(spark, path, kind, "D", "2024-01-20", "2030-01-01").withColumn("close", F.col("close") + 1)
    batch = later.withColumn("v", F.lit(2)).unionByName(later.withColumn("v", F.lit(1)).withColumn("close", F.lit(0.0)))
    feeds.merge_candles(spark, path, last_of(batch), ["symbol", "interval", "ts"], ["ts"], symbols)
    return feeds.stored_candles(spark, path, kind).select("symbol", "interval", "ts", "close")


def last_of(batch):
    return mg.last_wins(batch, ["symbol", "interval", "ts"], ["v"]).drop("v")


@query("snk_symbol", "SELECT o_orderkey, o_custkey, o_totalprice + CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 0 END AS o_totalprice FROM orders")
def snk_symbol(t):
    old, batch = orders_batch(t)
    return mg.insert_absent(old, batch.where("v = 2"), ["o_orderkey"])


@query("dml_upsert_metadata", """SELECT 'parent' AS kind, o_orderkey AS k, 0 AS line, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders
    UNION ALL SELECT 'child', l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_linenumber = 1""")
def dml_metadata(t):
    """Parents are merged by their key, and the children of those in the batch are replaced, also where the batch has none."""
    parents, children = t("orders").select("o_orderkey", "o_totalprice"), t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    batch = parents.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    lines = children.where("l_orderkey % 3 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    merged, kept = mg.upsert_with_children(parents, children, batch, lines, "o_orderkey", "l_orderkey")
    out = merged.select(F.lit("parent").alias("kind"), F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.col("o_totalprice").alias("v"))
    return out.unionByName(kept.select(F.lit("child").alias("kind"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").alias("v")))


KEPT_ORDERS = "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"


def kept_orders(t):
    gone = t("customer").where("c_nationkey = 3")
    return mg.delete_cascade(t("customer"), t("orders"), gone, "c_custkey", "o_custkey")[1].select("o_orderkey")


query("dml_delete_symbol", KEPT_ORDERS)(kept_orders)


@query("dml_delete_batched", f"WITH {bars_sql()}, day AS ({candle_sql('bars', 'D')}) SELECT \"interval\", symbol, count(*) AS n FROM (SELECT '60' AS \"interval\", symbol FROM bars UNION ALL SELECT 'D', symbol FROM day) WHERE symbol <> 'click' GROUP BY ALL")
def dml_delete_batched(t):
    spark, path, kind = candle_table(t, "dml_delete_batched")
    feeds.delete_symbols(spark, path, kind, spark.createDataFrame([("click",)], "symbol string"))
    return feeds.stored_candles(spark, path, kind).groupBy("interval", "symbol").agg(F.count("*").alias("n"))


@query("st_delist", "WITH now AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = DATE '2024-01-16'), gone AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = DATE '2024-01-15' AND user_id NOT IN (SELECT user_id FROM now)) SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM gone)")
def st_delist(t):
    now, before = symbol_sets(t)
    users = t("events").select("user_id").distinct()
    return mg.delete_cascade(users, t("events"), mg.missing(before, now, "user_id"), "user_id", "user_id")[1].select("event_id")


@query("dml_delete_by_symbols", "SELECT 'customer' AS kind, c_custkey AS k FROM customer WHERE c_nationkey NOT IN (3, 7) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey NOT IN (3, 7)")
def dml_by_symbols(t):
    gone = t("nation").where(F.col("n_nationkey").isin(3, 7)).select(F.col("n_nationkey").alias("nation"))
    tables = {"customer": t("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation")), "supplier": t("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))}
    left = mg.delete_everywhere(tables, gone, ["nation"])
    return left["customer"].unionByName(left["supplier"]).drop("nation")


@query("st_add_remove_tokens", "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0")
def st_add_remove(t):
    return mg.delete(t("customer"), t("customer").where("c_custkey % 5 = 0"), ["c_custkey"]).select("c_custkey")


@query("dml_platforms", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 1, 7 FROM orders WHERE o_orderkey % 8 = 0")
def dml_platforms(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = t("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    batch = t("orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).cast(rows.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit(7).cast(rows.schema["l_partkey"].dataType).alias("l_partkey"))
    return mg.replace_children(rows, batch, "l_orderkey", parents)


@query("mnt_hypertable", f"WITH {bars_sql()}, day AS ({candle_sql('bars', 'D')}) SELECT \"interval\", strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM (SELECT '60' AS \"interval\", ts FROM bars UNION ALL SELECT 'D', ts FROM day) GROUP BY ALL")
def mnt_hypertable(t):
    spark, path, kind = candle_table(t, "mnt_hypertable")
    return feeds.stored_candles(spark, path, kind).groupBy("interval", F.col("week").cast("string").alias("week")).agg(F.count("*").alias("n"))


@query("mnt_retention", f"WITH {bars_sql()}, day AS ({candle_sql('bars', 'D')}) SELECT * FROM (SELECT '60' AS \"interval\", symbol, ts, close FROM bars UNION ALL SELECT 'D', symbol, ts, close FROM day) WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def mnt_retention(t):
    spark, path, kind = candle_table(t, "mnt_retention")
    feeds.retain_candles(spark, path, kind, datetime.fromisoformat(NOW) - timedelta(days=10))
    return feeds.stored_candles(spark, path, kind).select("interval", "symbol", "ts", "close")


def inside_sql(code: str, now: str) -> str:
    return f"ts >= TIMESTAMP '{now}' - INTERVAL {rollups.START_HOURS[code]} HOUR AND ts + INTERVAL '{WIDTHS[code]}' <= TIMESTAMP '{now}' - INTERVAL {rollups.END_HOURS[code]} HOUR"


def refresh_sql() -> str:
    """Every view's stored close is -1 but for whole buckets between the offsets of its policy."""
    views = [f"SELECT '{code}' AS view, symbol, ts, CASE WHEN {inside_sql(code, NOW)} THEN close ELSE -1.0 END AS close FROM ({candle_sql('bars', code)})" for code in rollups.HOURS]
    return f"WITH {bars_sql('5')} " + " UNION ALL ".join(views)


def five_minutes(t: Table) -> DataFrame:
    return cd.bars(t("events"), "5", "event_type", "ts", "value", "event_id").withColumn("interval", F.lit("5"))


def views_of(r: rollups.Rollups) -> DataFrame:
    kept = feeds.stored_candles(r.spark, f"{r.path}/candles", r.columns).where(F.col("interval").isin(*rollups.HOURS))
    return kept.select(F.col("interval").alias("view"), "symbol", "ts", "close", "n")


@query("mnt_refresh_policy", refresh_sql())
def mnt_refresh(t):
    base = five_minutes(t)
    r = rollups.Rollups(base.sparkSession, st.work_dir(base.sparkSession, "mnt_refresh_policy"), "5", base.schema)
    for code in rollups.HOURS:
        old = cd.rollup(base.drop("n"), code).withColumn("close", F.lit(-1.0)).withColumn("interval", F.lit(code))
        feeds.write_candles(old.select(base.columns), f"{r.path}/candles")
    r.ingest(base)
    for code in rollups.HOURS:
        r.refresh(code, datetime.fromisoformat(NOW))
    return views_of(r).drop("n")


BEFORE = "2024-01-20 07:34:56"


def late_sql() -> str:
    """Buckets of the later refresh hold all trades; of the others, those of the earlier one hold what had come by then."""
    early = bars_sql("5").replace("bars AS", "early AS").replace("FROM events", "FROM events WHERE event_id % 5 > 0")
    views = []
    for code in rollups.HOURS:
        now, before = inside_sql(code, NOW), inside_sql(code, BEFORE)
        views.append(f"SELECT '{code}' AS view, symbol, ts, close, n FROM ({counted_sql('bars', code)}) WHERE {now}")
        views.append(f"SELECT '{code}', symbol, ts, close, n FROM ({counted_sql('early', code)}) WHERE {before} AND NOT ({now})")
    return f"WITH {bars_sql('5')}, {early} " + " UNION ALL ".join(views)


def counted_sql(source: str, code: str) -> str:
    return candle_sql(source, code).replace("count(*) AS n", "sum(n)::BIGINT AS n")


@query("mnt_refresh_late", late_sql())
def mnt_refresh_late(t):
    """Every fifth trade comes after a first refresh, and only the buckets that it touches are computed anew by the second."""
    base = five_minutes(t)
    r = rollups.Rollups(base.sparkSession, st.work_dir(base.sparkSession, "mnt_refresh_late"), "5", base.schema)
    late = t("events").where("event_id % 5 = 0").select(F.col("event_type").alias("symbol"), iv.bucket("ts", "5").alias("ts")).distinct()
    early = cd.bars(t("events").where("event_id % 5 > 0"), "5", "event_type", "ts", "value", "event_id").withColumn("interval", F.lit("5"))
    for batch, now in ((early, BEFORE), (base.join(late, ["symbol", "ts"], "left_semi"), NOW)):
        r.ingest(batch)
        for code in rollups.HOURS:
            r.refresh(code, datetime.fromisoformat(now))
    return views_of(r)


@query("mnt_full_refresh", f"WITH {bars_sql()} SELECT {ROUNDED} FROM ({candle_sql('bars', 'D')})")
def mnt_full(t):
    return rounded(cd.rollup(hourly(t), "D"))


# scalar functions ---------------------------------------------------------------------------------------------------

CODES = "(VALUES (0, '1', 60000), (1, '3', 180000), (2, '5', 300000), (3, '15', 900000), (4, '30', 1800000), (5, '60', 3600000), (6, '120', 7200000), (7, '240', 14400000), (8, '360', 21600000), (9, '720', 43200000), (10, 'D', 86400000), (11, 'W', 604800000)) v(k, code, w)"
CODED = f"coded AS (SELECT event_id, a.code AS base, a.w AS bw, b.code AS target, b.w AS tw FROM events JOIN {CODES.replace('v(', 'a(')} ON a.k = event_id % 12 LEFT JOIN {CODES.replace('v(', 'b(')} ON b.k = event_id // 12 % 13)"


def coded(t):
    """Events with two interval codes each, the second of which is now and then none."""
    listed = F.array(*[F.lit(c) for c in iv.INTERVALS])
    pick = lambda k: F.get(listed, k.cast("int"))
    return t("events").select("event_id", pick(F.col("event_id") % 12).alias("base"), pick(F.floor(F.col("event_id") / 12) % 13).alias("target"))


@query("fn_interval_ms", f"WITH {CODED} SELECT event_id, tw::BIGINT AS ms FROM coded")
def fn_interval_ms(t):
    return coded(t).select("event_id", iv.interval_ms(F.col("target")).cast("long").alias("ms"))


@query("fn_interval_valid", f"WITH {CODED} SELECT event_id, coalesce(tw >= bw AND tw % bw = 0, false) AS ok FROM coded")
def fn_interval_valid(t):
    return coded(t).select("event_id", iv.valid_target(F.col("base"), F.col("target")).alias("ok"))


@query("fn_valid_intervals", f"WITH {CODED} SELECT event_id, string_agg(code, ',' ORDER BY k) AS codes FROM coded JOIN {CODES} ON w % bw = 0 GROUP BY event_id")
def fn_valid_intervals(t):
    return coded(t).select("event_id", F.array_join(iv.valid_targets(F.col("base")), ",").alias("codes"))


@query("fn_interval_view", f"WITH {CODED} SELECT event_id, CASE base WHEN '60' THEN 'kline_1h' WHEN '240' THEN 'kline_4h' WHEN 'D' THEN 'kline_1d' END AS view_name FROM coded")
def fn_interval_view(t):
    table = F.create_map(*[F.lit(x) for pair in iv.STORED_VIEWS.items() for x in pair])
    return coded(t).select("event_id", F.try_element_at(table, F.col("base")).alias("view_name"))


@query("fn_interval_bucket", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events")
def fn_interval_bucket(t):
    return t("events").select("event_id", iv.bucket("ts", "15").alias("b"))


@query("fn_time_bucket", "SELECT event_id, time_bucket(INTERVAL '7 days', ts) AS week, time_bucket(INTERVAL '4 hours', ts) AS four FROM events")
def fn_time_bucket(t):
    week = F.timestamp_add("MILLISECOND", iv.floor_ms(iv.to_ms(F.col("ts")), F.lit("W")), F.lit("1970-01-01").cast("timestamp_ntz"))
    return t("events").select("event_id", week.alias("week"), iv.bucket("ts", "240").alias("four"))


@query("fn_align_interval", """SELECT event_id, epoch_ms(time_bucket(INTERVAL '7 days', ts)) AS low_w, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS low_d,
    CASE WHEN (epoch_us(ts) // 1000) % 900000 = 0 THEN (epoch_us(ts) // 1000) ELSE ((epoch_us(ts) // 1000) // 900000 + 1) * 900000 END AS high_15 FROM events""")
def fn_align_interval(t):
    ms = iv.to_ms(F.col("ts"))
    return t("events").select("event_id", iv.floor_ms(ms, F.lit("W")).alias("low_w"), iv.floor_ms(ms, F.lit("D")).alias("low_d"), iv.ceil_ms(ms, F.lit("15")).alias("high_15"))


@query("fn_align_range", f"SELECT event_id, (epoch_us(ts) // 1000) // 300000 * 300000 AS a, least(((epoch_us(ts) // 1000) + 86400000) // 300000 * 300000, {NOW_MS} // 300000 * 300000 - 300000) AS b FROM events")
def fn_align_range(t):
    ms = iv.to_ms(F.col("ts"))
    a, b = iv.align_range(ms, ms + iv.DAY, F.lit("5"), F.lit(NOW_MS))
    return t("events").select("event_id", a.alias("a"), b.alias("b"))


@query("fn_from_ms", "SELECT event_id, date_trunc('milliseconds', ts) AS t FROM events")
def fn_from_ms(t):
    return t("events").select("event_id", iv.from_ms(iv.to_ms(F.col("ts"))).cast("timestamp_ntz").alias("t"))


@query("fn_to_ms", "SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events")
def fn_to_ms(t):
    return t("events").select("event_id", iv.to_ms(F.col("ts")).alias("ms"))


@query("fn_now", f"SELECT event_id, {NOW_MS} - epoch_us(ts) // 1000 AS age_ms FROM events")
def fn_now(t):
    """The present as a parameter; without one it is the clock's."""
    return t("events").select("event_id", (iv.now_ms(F.lit(NOW).cast("timestamp")) - iv.to_ms(F.col("ts"))).alias("age_ms"))


@query("fn_format_ts", "SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M') AS s FROM events")
def fn_format_ts(t):
    return t("events").select("event_id", iv.format_time(F.col("ts")).alias("s"))


@query("fn_format_diff", """SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
    WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS d FROM (SELECT event_id, event_id * 37 % 200000 AS s FROM events)""")
def fn_format_diff(t):
    return t("events").select("event_id", iv.format_span(F.col("event_id") * 37 % 200_000).alias("d"))


@query("fn_launch_clip", f"SELECT event_id, greatest((epoch_us(ts) // 1000), {NOW_MS} - 10 * 86400000) AS a, (epoch_us(ts) // 1000) AS b FROM events")
def fn_launch_clip(t):
    ms = iv.to_ms(F.col("ts"))
    return t("events").select("event_id", iv.clip_launch(ms, F.lit(NOW_MS), 10).alias("a"), iv.clip_launch(ms, F.lit(NOW_MS), 0).alias("b"))


@query("fn_total_candles", f"SELECT event_id, ({NOW_MS} + 2592000000 - (epoch_us(ts) // 1000)) // 300000 + 1 AS n FROM events")
def fn_total_candles(t):
    return t("events").select("event_id", iv.total_candles(iv.to_ms(F.col("ts")), F.lit(NOW_MS + 2_592_000_000), F.lit("5")).alias("n"))


@query("fn_progress_pct", "SELECT l_orderkey, l_linenumber, least(100.0, coalesce(l_quantity / nullif(l_linenumber * 10 - 10, 0) * 100, 0))::DOUBLE AS pct FROM lineitem")
def fn_progress_pct(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.least(F.lit(100.0), nm.share(F.col("l_quantity"), F.col("l_linenumber") * 10 - 10, 100.0)).alias("pct"))


@query("fn_progress_update", """WITH g AS (SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN o_custkey % 20 ELSE 0 END AS gap FROM orders)
    SELECT o_custkey, o_orderkey, CAST(sum(1) OVER w AS BIGINT) AS done, (50 - sum(gap) OVER w)::BIGINT AS total, least(100.0, round(sum(1) OVER w * 100.0 / (50 - sum(gap) OVER w), 6))::DOUBLE AS percent FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def fn_progress_update(t):
    """A customer's first batch comes with a leading gap, which goes off the total."""
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1
    log = t("orders").select("o_custkey", "o_orderkey", F.lit(1).alias("done"), F.lit(50).alias("total"), F.when(first, F.col("o_custkey") % 20).otherwise(0).alias("gap"))
    out = mon.progress(log, "o_custkey", "o_orderkey", "done", "total", "gap")
    return out.select("o_custkey", "o_orderkey", "done", F.col("total").cast("long").alias("total"), F.round(F.col("percent").cast("double"), 6).alias("percent"))


@query("fn_div_guard", "SELECT p_partkey, coalesce(p_retailprice / nullif(p_size - 10, 0), 0) AS rate FROM part")
def fn_div_guard(t):
    return t("part").select("p_partkey", nm.share(F.col("p_retailprice"), F.col("p_size") - 10).alias("rate"))


@query("fn_rate", "SELECT user_id, round(coalesce(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 0), 0), 9) AS per_second FROM events GROUP BY user_id")
def fn_rate(t):
    seen = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return seen.select("user_id", F.round(nm.rate(F.col("n"), F.col("a"), F.col("b")), 9).alias("per_second"))


@query("fn_collector_pct", """WITH d AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), w AS (SELECT p_brand, sum(p_size) AS total FROM part WHERE p_brand LIKE '%1%' GROUP BY p_brand)
    SELECT p_brand, round(coalesce(n / nullif(coalesce(total, 1), 0) * 100, 0), 6) AS pct FROM d LEFT JOIN w USING (p_brand)""")
def fn_collector_pct(t):
    """Brands as collectors; some have no total, which counts as 1."""
    done = t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    totals = t("part").where("p_brand LIKE '%1%'").groupBy("p_brand").agg(F.sum("p_size").alias("total"))
    return done.join(totals, "p_brand", "left").select("p_brand", F.round(nm.done_percent(F.col("n"), F.col("total")), 6).alias("pct"))


@query("fn_status_flag", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS up FROM orders")
def fn_status_flag(t):
    return t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("up"))


#: The values that a priority may have, and their names.
PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none", "5-LOW": "low"}


@query("fn_source_enum", "SELECT o_orderkey, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items()) + " END AS source FROM orders")
def fn_source_enum(t):
    """A value that isn't known is an error."""
    return t("orders").select("o_orderkey", nm.one_of(F.col("o_orderpriority"), PRIORITIES).alias("source"))


@query("fn_symbol_format", "SELECT s_suppkey, s_name || ' (sim)' AS label, s_name || '/USD' AS pair FROM supplier")
def fn_symbol_format(t):
    return t("supplier").select("s_suppkey", nm.symbol_label(F.col("s_name"), F.lit("sim")).alias("label"), nm.pair_label(F.col("s_name"), F.lit("USD")).alias("pair"))


#: Numbers as sources send them, good and bad, by the remainder of a row's key: the text of ``x``, and what there is beside it.
DIRTY = (None, "junk", "inf", "-Infinity", "NaN", "", " 12.5% ", "1,234,567.891234567", "-0.00000000004", "123456789012.75", "1234567890123.5", "1e40", "-1e40", "3%5", "1e12", "2.5e-7", "1d", "-987654.32109")


def dirty(key: str, x) -> F.Column:
    """Every other row has its own value, with commas, the others those of ``DIRTY`` in turn."""
    listed = F.array(*[F.lit(v).cast("string") for v in DIRTY])
    return F.when(F.col(key) % 2 == 0, F.format_number(x, 6)).otherwise(F.get(listed, (F.floor(F.col(key) / 2) % len(DIRTY)).cast("int")))


def dirty_sql(key: str, x: str, table: str, scale: int, digits: int, default: str) -> str:
    """Beside the rule itself, the decimal is read from the text at once: no value has more digits than a double tells."""
    values = ", ".join("NULL" if v is None else f"'{v}'" for v in DIRTY)
    kind = f"DECIMAL(38,{scale})"
    shed = " ".join(f"WHEN abs(d) >= 1e{digits - k - 1} THEN round(d, {k})::{kind}" for k in range(scale))
    most = f"{'9' * digits}::{kind}"
    return f"""(SELECT k, coalesce(CASE WHEN abs(d) >= 1e{28 - scale} THEN NULL {shed} ELSE d END, {default}::{kind}) AS v FROM (
        SELECT k, CASE WHEN abs(x) < 1e-10 THEN 0::{kind} WHEN x >= 1e{digits} THEN {most} WHEN x <= -1e{digits} THEN -({most}) WHEN contains(t, 'e') THEN try_cast(x AS {kind}) WHEN x IS NOT NULL THEN try_cast(t AS {kind}) END AS d FROM (
        SELECT k, t, CASE WHEN regexp_matches(t, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(t AS DOUBLE) END AS x FROM (
        SELECT {key} AS k, trim(regexp_replace(trim(replace(CASE WHEN {key} % 2 = 0 THEN printf('%.6f', ({x})::DOUBLE) ELSE ([{values}])[1 + ({key} // 2) % {len(DIRTY)}] END, ',', '')), '%$', '')) AS t FROM {table}))))"""


def as_double(**columns) -> list:
    return [c.cast("double").alias(k) for k, c in columns.items()]


@query("fn_norm_decimal", f"SELECT k AS c_custkey, m.v::DOUBLE AS money, s.v::DOUBLE AS supply FROM {dirty_sql('c_custkey', 'c_acctbal', 'customer', 2, 30, '0')} m JOIN {dirty_sql('c_custkey', 'c_acctbal', 'customer', 8, 30, '7')} s USING (k)")
def fn_norm_decimal(t):
    x = dirty("c_custkey", "c_acctbal")
    return t("customer").select("c_custkey", *as_double(money=nm.decimal(x, 2, 30), supply=nm.decimal(x, 8, 30, "7")))


@query("fn_norm_pct", f"SELECT k AS o_orderkey, least(greatest(v, -999999.9999), 999999.9999)::DOUBLE AS pct FROM {dirty_sql('o_orderkey', 'o_totalprice', 'orders', 4, 16, '0')}")
def fn_norm_pct(t):
    return t("orders").select("o_orderkey", *as_double(pct=nm.percent(dirty("o_orderkey", "o_totalprice"))))


@query("fn_norm_price", f"SELECT k AS c_custkey, greatest(p.v, 0.0000000001)::DOUBLE AS price, c.v::DOUBLE AS change FROM {dirty_sql('c_custkey', 'c_acctbal', 'customer', 10, 20, '0.0000000001')} p JOIN {dirty_sql('c_custkey', 'c_acctbal', 'customer', 10, 20, '0')} c USING (k)")
def fn_norm_price(t):
    x = dirty("c_custkey", "c_acctbal")
    return t("customer").select("c_custkey", *as_double(price=nm.price(x), change=nm.price_change(x)))


@query("fn_norm_supply", f"SELECT k AS p_partkey, v::DOUBLE AS supply FROM {dirty_sql('p_partkey', 'p_retailprice', 'part', 8, 30, '0')}")
def fn_norm_supply(t):
    return t("part").select("p_partkey", *as_double(supply=nm.supply(dirty("p_partkey", "p_retailprice"))))


@query("fn_norm_money", f"SELECT k AS p_partkey, v::DOUBLE AS money FROM {dirty_sql('p_partkey', 'p_retailprice', 'part', 2, 30, '0')}")
def fn_norm_money(t):
    return t("part").select("p_partkey", *as_double(money=nm.money(dirty("p_partkey", "p_retailprice"))))


@query("fn_pair", "SELECT p_partkey, p_brand || '/' || p_type AS pair FROM part")
def fn_pair(t):
    return t("part").select("p_partkey", nm.pair_label(F.col("p_brand"), F.col("p_type")).alias("pair"))


@query("fn_parse_iso", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {NOW_MS} ELSE epoch_ms(date_trunc('second', ts)) END AS ms FROM events")
def fn_parse_iso(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("no date")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return t("events").select("event_id", F.unix_millis(nm.iso_time(raw, F.timestamp_millis(F.lit(NOW_MS)))).alias("ms"))


@query("fn_parse_genesis", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_ms(date_trunc('day', ts)) END AS ms FROM events")
def fn_parse_genesis(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("no date")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t("events").select("event_id", F.unix_millis(nm.genesis_date(raw)).alias("ms"))


@query("fn_token_name", "SELECT p_partkey, lower(p_brand) AS name FROM part")
def fn_token_name(t):
    return t("part").select("p_partkey", F.lower("p_brand").alias("name"))


@query("fn_lower_symbol", "SELECT c_custkey, lower(c_mktsegment) AS symbol FROM customer")
def fn_lower_symbol(t):
    return t("customer").select("c_custkey", F.lower("c_mktsegment").alias("symbol"))


@query("fn_rank_default", "SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_size END, -1) AS rank FROM part")
def fn_rank_default(t):
    return t("part").select("p_partkey", nm.rank_or_none(F.when(F.col("p_size") > 10, F.col("p_size"))).alias("rank"))


LINKS = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://reddit.com/r/sub' || o_custkey || '/' WHEN 1 THEN 'https://t.me/chan' || o_custkey ELSE '@user' || o_custkey END AS link FROM orders"


def links(t):
    k = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 3
    return t("orders").select("o_orderkey", F.when(m == 0, F.concat(F.lit("https://reddit.com/r/sub"), k, F.lit("/"))).when(m == 1, F.concat(F.lit("https://t.me/chan"), k)).otherwise(F.concat(F.lit("@user"), k)).alias("link"))


@query("fn_subreddit", f"SELECT o_orderkey, regexp_extract(rtrim(link, '/'), '/r/([^/]*)', 1) AS sub FROM ({LINKS})")
def fn_subreddit(t):
    return links(t).select("o_orderkey", nm.subreddit(F.col("link")).alias("sub"))


@query("fn_telegram_user", f"SELECT o_orderkey, CASE WHEN link LIKE '%t.me/%' THEN regexp_extract(link, 't\\.me/([^/]*)', 1) ELSE ltrim(link, '@') END AS name FROM ({LINKS})")
def fn_telegram(t):
    return links(t).select("o_orderkey", nm.telegram_user(F.col("link")).alias("name"))


@query("fn_twitter_user", f"SELECT o_orderkey, ltrim(list_last(string_split(link, '/')), '@') AS name FROM ({LINKS})")
def fn_twitter(t):
    return links(t).select("o_orderkey", nm.twitter_user(F.col("link")).alias("name"))


@query("fn_strip_digits", "SELECT c_custkey, ltrim(c_custkey::VARCHAR || c_mktsegment, '0123456789') AS s FROM customer")
def fn_strip(t):
    return t("customer").select("c_custkey", nm.without_digits(F.concat(F.col("c_custkey").cast("string"), F.col("c_mktsegment"))).alias("s"))


@query("fn_json_array", "SELECT p_partkey, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS categories FROM part")
def fn_json_array(t):
    made = F.from_json(F.to_json(F.array("p_brand", "p_type")), "array<string>")
    return t("part").select("p_partkey", F.to_json(made).alias("categories"))


@query("fn_map_entries", "SELECT p_partkey, 'brand' AS key, p_brand AS value FROM part WHERE p_brand <> '' UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE p_type <> ''")
def fn_map_entries(t):
    rows = t("part").select("p_partkey", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit(""), F.lit("x")).alias("m"))
    return fd.map_rows(rows, "m", ["p_partkey"])


LEX, MODS = (", ".join(f"('{w}', {v})" for w, v in d.items()) for d in (fd.LEXICON, fd.MODIFIERS))
#: A word's value is multiplied with the modifiers between it and the last word before it that is none.
SCORED = f"""lex(w, v) AS (VALUES {LEX}), mods(w, m) AS (VALUES {MODS}), split AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') AS ws FROM documents),
    tok AS (SELECT doc_id, i, w, v, m FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM split) LEFT JOIN lex USING (w) LEFT JOIN mods USING (w)),
    runs AS (SELECT *, coalesce(sum((m IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM tok),
    vals AS (SELECT doc_id, run, max(v) AS v, coalesce(product(m), 1.0) AS f FROM runs GROUP BY doc_id, run HAVING max(v) IS NOT NULL),
    scored AS (SELECT doc_id, avg(greatest(-1.0, least(1.0, v::DOUBLE * f))) AS s FROM vals GROUP BY doc_id)"""


@query("fn_polarity", f"WITH {SCORED} SELECT doc_id, round(coalesce(s, 0), 6) AS polarity FROM documents LEFT JOIN scored USING (doc_id)")
def fn_polarity(t):
    return t("documents").select("doc_id", F.round(fd.polarity(F.col("text")), 6).alias("polarity"))


@query("agg_sentiment_mean", f"WITH {SCORED} SELECT source || '/' || lang AS channel, round(avg(CASE WHEN length(text) > 0 THEN coalesce(s, 0) END), 6) AS score FROM documents LEFT JOIN scored USING (doc_id) GROUP BY 1")
def agg_sentiment(t):
    texts = t("documents").select(F.concat_ws("/", "source", "lang").alias("channel"), "text")
    return fd.mean_polarity(texts, "channel", "text").withColumn("score", F.round("score", 6))


@query("fn_float_norm", "SELECT event_id, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS x FROM events")
def fn_float_norm(t):
    return t("events").select("event_id", nm.number(F.col("value")).alias("x"))


# sentiment sources, monitoring, validation --------------------------------------------------------------------------

TWEETS = "SELECT user_id, round(coalesce(sum(value + event_id % 7 + event_id % 3) / count(*), 0), 4) AS engagement FROM events GROUP BY user_id"


def tweets(t):
    rows = t("events").select("user_id", "value", (F.col("event_id") % 7).alias("shares"), (F.col("event_id") % 3).alias("replies"))
    return fd.engagement(rows, "user_id", "value", "shares", "replies").withColumn("engagement", F.round("engagement", 4))


query("agg_engagement_rate", TWEETS)(tweets)


@query("src_twitter", f"SELECT user_id, count(*) AS tweets, round(sum(value + event_id % 7 + event_id % 3) / count(*), 4) AS engagement FROM events WHERE ts BETWEEN TIMESTAMP '{DAY_BEFORE}' AND TIMESTAMP '{NOW}' GROUP BY user_id")
def src_twitter(t):
    """Tweets as JSON, of the last 24 hours."""
    tweet = F.to_json(F.struct("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), F.col("value").alias("likes"), (F.col("event_id") % 7).alias("retweets"), (F.col("event_id") % 3).alias("replies")))
    rows = t("events").select(F.from_json(tweet, "user_id bigint, created_at timestamp_ntz, likes double, retweets bigint, replies bigint").alias("x")).select("x.*").where(F.col("created_at") <= moment(NOW))
    fresh = fd.recent(rows, "created_at", moment(NOW))
    rate = fd.engagement(fresh, "user_id", "likes", "retweets", "replies").withColumn("engagement", F.round("engagement", 4))
    return fresh.groupBy("user_id").agg(F.count("*").alias("tweets")).join(rate, "user_id").withColumn("user_id", F.col("user_id").cast(t("events").schema["user_id"].dataType))


TEXTS = "coalesce(md5(string_agg(text, '|' ORDER BY text)), '') AS texts"


@query("agg_posts_comments", f"SELECT conv_id, count(*) AS posts, CAST(sum(turn) AS BIGINT) AS comments, {TEXTS} FROM conversations GROUP BY conv_id")
def posts(t):
    return digest(fd.post_activity(t("conversations"), "conv_id", "turn", "text"))


def digest(rows):
    """The list of texts as one hash, which SQL can compare."""
    return rows.withColumn("texts", F.when(F.size("texts") > 0, F.md5(F.array_join("texts", "|").cast("binary"))).otherwise(""))


POSTED = f"TIMESTAMP '{NOW}' - to_hours(CAST(conv_id % 48 AS INTEGER)) - to_minutes(CAST(turn AS INTEGER))"


def posted(t):
    """Turns as posts: each conversation began up to two days before now."""
    back = F.make_dt_interval(F.lit(0), (F.col("conv_id") % 48).cast("int"), F.col("turn").cast("int"))
    return t("conversations").withColumn("at", moment(NOW) - back)


@query("src_reddit", f"SELECT conv_id, count(*) AS posts, CAST(sum(turn) AS BIGINT) AS comments, {TEXTS} FROM conversations WHERE {POSTED} >= TIMESTAMP '{DAY_BEFORE}' GROUP BY conv_id")
def src_reddit(t):
    return digest(fd.post_activity(fd.recent(posted(t), "at", moment(NOW)), "conv_id", "turn", "text"))


@query("agg_messages", """SELECT role, count(*) OVER (PARTITION BY role) AS n, CAST(sum(length(text)) OVER (PARTITION BY role) AS BIGINT) AS n_chars,
    row_number() OVER (PARTITION BY role ORDER BY text) AS place, text FROM conversations WHERE text <> ''""")
def messages(t):
    """The count and the whole list of texts; the list stays rows, numbered in its order, as a role may have any number of texts."""
    return fd.message_list(t("conversations"), "role", "text", ["conv_id", "turn"])


@query("src_telegram", f"""SELECT role, count(*) OVER (PARTITION BY role) AS n, md5(concat_ws('|', conv_id, turn, text)) AS texts FROM conversations
    WHERE text <> '' AND {POSTED} >= TIMESTAMP '{DAY_BEFORE}'""")
def src_telegram(t):
    """All messages of the last day with the count of their channel; the list stays rows, each message's conversation, turn and text as one hash."""
    fresh = fd.message_activity(fd.recent(posted(t), "at", moment(NOW)), "role", "text")
    return fresh.select("role", "n", F.md5(F.concat_ws("|", "conv_id", "turn", "text").cast("binary")).alias("texts"))


@query("agg_error_summary", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_error_summary(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg_error_frequency", """SELECT user_id, n, CASE WHEN b < TIMESTAMP '2024-01-15' OR s <= 0 THEN 0 ELSE round(n / s * 3600, 9) END AS per_hour FROM
    (SELECT user_id, count(*) AS n, max(ts) AS b, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS s FROM events GROUP BY user_id)""")
def agg_error_frequency(t):
    return mon.error_frequency(t("events"), "user_id", "ts", moment("2024-01-15")).withColumn("per_hour", F.round("per_hour", 9))


@query("agg_error_recent", "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-25'")
def agg_error_recent(t):
    return mon.recent_errors(t("events"), "user_id", "ts", moment("2024-01-25"))


@query("agg_distinct_entities", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS entities FROM events GROUP BY user_id")
def agg_distinct(t):
    return mon.affected(t("events"), "user_id", "event_type").withColumn("entities", F.array_join("entities", ","))


@query("src_prom_text", "SELECT 'm' || (event_id % 50) AS name, last(value ORDER BY event_id) AS value FROM events GROUP BY 1")
def src_prom(t):
    text = F.concat(F.lit("m"), (F.col("event_id") % 50).cast("string"), F.lit('{a="b c"} '), F.col("value").cast("string"))
    return feeds.metric_text(t("events").select(text.alias("value"), F.col("event_id").alias("position")))


@query("src_ws_klines", "SELECT event_type AS symbol, '5' AS \"interval\", (epoch_us(ts) // 1000) AS ms, round(value, 6) AS close FROM events WHERE event_id % 2 = 0")
def src_ws(t):
    v = F.col("value").cast("string")
    data = F.array(F.struct(iv.to_ms(F.col("ts")).alias("start"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), v.alias("volume"), v.alias("turnover"), (F.col("event_id") % 2 == 0).alias("confirm")))
    message = F.to_json(F.struct(F.concat(F.lit("kline.5."), "event_type").alias("topic"), data.alias("data")))
    return feeds.stream_rows(t("events").select(message.alias("value"))).select("symbol", "interval", F.unix_millis("ts").alias("ms"), *r6("close"))


@query("val_candle_rules", f"""WITH r AS (SELECT event_id, (epoch_us(ts) // 1000) AS ms, value, event_id % 4 AS m FROM events) SELECT event_id,
    concat_ws(',', CASE WHEN ms > {NOW_MS} + 60000 THEN 'ts_future' END, CASE WHEN m = 1 THEN 'interval' END, CASE WHEN m = 2 THEN 'volume_value' END, CASE WHEN m = 3 AND value > 0 THEN 'ohlc_order' END) AS errors FROM r""")
def val_candles(t):
    m, v = F.col("event_id") % 4, F.col("value")
    rows = t("events").select("event_id", iv.to_ms(F.col("ts")).alias("ts_ms"), F.when(m == 1, "7").otherwise("5").alias("interval"), v.alias("open"),
                              F.when(m == 3, v / 2).otherwise(v).alias("high"), v.alias("low"), v.alias("close"), F.when(m == 2, -1.0).otherwise(1.0).alias("volume"), F.lit(1.0).alias("turnover"))
    return rows.select("event_id", F.array_join(rec.errors(rec.candle_rules(F.lit(NOW_MS))), ",").alias("errors"))


@query("st_resume_point", f"WITH {ISLANDS} SELECT symbol, CASE WHEN 1704067200000 < min(start_ms) THEN 1704067200000 ELSE max(end_ms) - 3600000 END AS start_ms, CASE WHEN 1704067200000 < min(start_ms) THEN min(start_ms) ELSE {NOW_MS} END AS end_ms FROM covered GROUP BY symbol")
def st_resume(t):
    r = coverage.ends(coverage.of_candles(hourly(t), BASE), BASE)
    return r.select("symbol", *st.resume_side(F.col("first_ms"), F.col("last_ms"), F.lit(1_704_067_200_000), F.lit(NOW_MS)))


# streams ------------------------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_query(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, st.work_dir(spark, name))
        ORACLES[name] = sql
        return f

    return keep


BARS_ONLY = "symbol, ts, open, high, low, close, n"

@stream_query("st_tumbling", f"WITH {bars_sql('60')} SELECT {BARS_ONLY} FROM bars")
def st_tumbling(spark, sf_dir, work):
    rolled = st.rollup_stream(event_stream(spark, sf_dir), "60", "event_type", "ts", "value", "event_id")
    return st.finished(rolled, ["symbol", "ts"], work).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@stream_query("st_late_data", f"""WITH late AS (SELECT * FROM events WHERE event_id % 5 > 0 OR time_bucket(INTERVAL '4 hours', ts) + INTERVAL '4 hours' > (SELECT max(ts) FROM events WHERE event_id % 5 > 1) - INTERVAL '12 hours'),
    {bars_sql('240').replace('FROM events', 'FROM late')} SELECT {BARS_ONLY} FROM bars""")
def st_late_data(spark, sf_dir, work):
    """Every fifth trade arrives in a third batch, late by up to the whole span: buckets that ended before the watermark leave it out.

    A batch leaves out what was late by the watermark of the batch before it, which follows from the first one here.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k, part in enumerate(("event_id % 5 > 1", "event_id % 5 = 1", "event_id % 5 = 0")):
        events.where(part).withColumn("part", F.lit(k)).coalesce(1).write.mode("append").partitionBy("part").parquet(f"{work}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{work}/in")
    rolled = st.rollup_stream(stream.drop("part"), "240", "event_type", "ts", "value", "event_id")
    return st.finished(rolled, ["symbol", "ts"], work).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: Messages of candles of five minutes: every event is one of its bucket's, a third of them confirm it, and sign-ups end before the others.
MESSAGES = """m AS (SELECT event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS ts, value AS close, event_id, event_id % 3 = 0 AS confirm FROM events WHERE event_type <> 'signup' OR ts < TIMESTAMP '2024-01-20'),
    mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS moment FROM m), c AS (SELECT symbol, ts, bool_or(confirm) AS ok, arg_min(close, event_id) FILTER (confirm) AS held, arg_max(close, event_id) AS latest FROM m GROUP BY ALL)"""


@stream_query("st_confirmed_upsert", f"""WITH {MESSAGES} SELECT symbol, ts, 'confirmed' AS status, held AS close FROM c WHERE ok UNION ALL SELECT symbol, ts, 'never confirmed', latest FROM c, mark WHERE NOT ok AND ts + INTERVAL 15 MINUTE <= moment
    UNION ALL SELECT symbol, max(ts), 'silent', NULL FROM c, mark GROUP BY symbol, moment HAVING max(ts) + INTERVAL 15 MINUTE <= moment""")
def st_confirmed_upsert(spark, sf_dir, work):
    """All messages come twice and in no order; confirmed candles are merged into a table, the others and silent symbols are reported."""
    events = event_stream(spark, sf_dir).where("event_type <> 'signup' OR ts < TIMESTAMP '2024-01-20'")
    twice = events.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    messages = twice.select(F.col("event_type").alias("symbol"), F.lit("5").alias("interval"), F.window("ts", "5 minutes")["start"].alias("ts"), F.col("value").alias("close"), F.col("event_id").alias("arrived"), (F.col("event_id") % 3 == 0).alias("confirm"))
    st.settle_into(messages, ["close"], f"{work}/table", f"{work}/reports", f"{work}/checkpoint").awaitTermination()
    kind = spark.createDataFrame([], "symbol string, interval string, ts timestamp, close double").schema
    passed = feeds.stored_candles(spark, f"{work}/table", kind).select("symbol", "ts", F.lit("confirmed").alias("status"), "close")
    reports = spark.read.parquet(f"{work}/reports").select("symbol", "ts", "status", "close")
    return passed.unionByName(reports).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def holes(t: Table) -> tuple[DataFrame, DataFrame]:
    full = hourly(t).select("symbol", "ts", "open", "close")
    return full, full.where(~F.col("ts").between(moment("2024-01-10"), moment("2024-01-12")))


def backfilled(t: Table, name: str):
    """A table with holes, filled round by round; its path and columns, and what is covered."""
    full, state = holes(t)
    full = full.withColumn("interval", F.lit(BASE))
    path = st.work_dir(full.sparkSession, name)
    feeds.write_candles(state.withColumn("interval", F.lit(BASE)), path)

    def fetch(found):
        w = iv.INTERVALS[BASE]
        page = F.sequence(F.col("gap_start"), F.col("gap_end") - w, F.lit(w))
        asked = found.select("symbol", F.explode(page).alias("ms")).select("symbol", iv.from_ms(F.col("ms")).cast("timestamp_ntz").alias("ts"))
        return full.join(asked, ["symbol", "ts"], "left_semi").select(full.columns)

    def write(rows):
        feeds.merge_candles(full.sparkSession, path, rows, ["symbol", "interval", "ts"], ["ts"])

    covered, _ = st.backfill(coverage.of_candles(state, BASE), fetch, write, BASE)
    return full.sparkSession, path, full.schema, covered


@query("st_backfill_loop", f"WITH {bars_sql()} SELECT symbol, ts, open, close FROM bars")
def st_backfill_loop(t):
    spark, path, kind, _ = backfilled(t, "st_backfill_loop")
    return feeds.stored_candles(spark, path, kind).select("symbol", "ts", "open", "close")


@query("st_covered", f"WITH {ISLANDS} SELECT symbol, start_ms, end_ms FROM covered")
def st_covered(t):
    """What a backfill says is covered, without a look at the candles."""
    return backfilled(t, "st_covered")[3]


@query("st_repair", f"WITH {bars_sql()} SELECT symbol, ts, open, CASE WHEN ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 5 HOUR AND TIMESTAMP '{NOW}' THEN close ELSE -1.0 END AS close FROM bars")
def st_repair(t):
    full = hourly(t).select("symbol", "ts", "open", "close")
    return st.repaired(full.withColumn("close", F.lit(-1.0)), full, BASE, moment(NOW))


@query("st_window_counter", """SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def st_window_counter(t):
    """Calls of the last 60 seconds, for every call."""
    return mon.with_recent(t("events"), "event_type", "ts").select("event_id", "event_type", "recent")


@query("val_symbol_rules", f"""SELECT p_partkey, concat_ws(',', CASE WHEN NOT regexp_matches(name, '^[A-Z0-9]+$') OR length(name) NOT BETWEEN 5 AND 50 THEN 'name' END, CASE WHEN NOT regexp_matches(quote, '^[A-Z0-9]+$') THEN 'quote_asset' END,
    CASE WHEN scale > 18 THEN 'price_scale' END, CASE WHEN launch NOT BETWEEN 1230940800000 AND {NOW_MS} + 86400000 THEN 'launch_time' END) AS errors
    FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_type END AS name, CASE WHEN p_size % 3 = 0 THEN 'usdt' ELSE 'USDT' END AS quote, p_size - 25 + 15 AS scale, {NOW_MS}::BIGINT + (p_partkey % 9 - 7) * 86400000::BIGINT * 100 AS launch FROM part WHERE p_size >= 10)""")
def val_symbols(t):
    k = F.col("p_size")
    rows = t("part").where("p_size >= 10").select("p_partkey", F.when(k % 5 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("name"), F.lit("sim").alias("exchange"), F.lit("BTC").alias("base_asset"),
                                                  F.when(k % 3 == 0, "usdt").otherwise("USDT").alias("quote_asset"), (k - 10).alias("price_scale"), (F.lit(NOW_MS) + (F.col("p_partkey") % 9 - 7) * F.lit(iv.DAY) * 100).alias("launch_time"))
    return rows.select("p_partkey", F.array_join(rec.errors(rec.symbol_rules(F.lit(NOW_MS))), ",").alias("errors"))
