"""Queries of signals, text scalars, stored tables and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import rounded, zscore
from ..operators import aggregates as a
from ..operators import pair_paths, pairs, text
from ..operators import signals as g
from ..operators.technical import drawdown
from ..sources import market as m
from ..sources import store
from ..streaming import events as st
from ..streaming import stateful as sf
from .registry import query, sql
from .technical import DD, W, r, roll


@query("G6_crossover", sql("bars", f"SELECT symbol, date, CAST(coalesce(sign(({roll('avg', 'close', 5)}) - ({roll('avg', 'close', 20)})), 0) AS INTEGER) AS signal FROM bars"))
def crossover(spark, sf_dir):
    return g.crossover(m.daily_bars(spark, sf_dir))


P20 = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("G6_channel", sql("bars", f"SELECT symbol, date, CASE WHEN count(high) OVER {P20} >= 20 AND close > max(high) OVER {P20} THEN 1 WHEN count(high) OVER {P20} >= 20 AND close < min(low) OVER {P20} THEN -1 ELSE 0 END AS signal FROM bars"))
def channel(spark, sf_dir):
    return g.channel(m.daily_bars(spark, sf_dir))


@query("G7_hysteresis", sql("bars", f""", z AS (SELECT symbol, date, coalesce((close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_samp', 'close', 20)}, 0), 99.0) AS z FROM bars)
SELECT symbol, date, CAST(list_reduce(list_prepend(0.0, list(z) OVER (PARTITION BY symbol ORDER BY date)), lambda s, v: CASE WHEN v = 99.0 THEN s WHEN s = 0 THEN CASE WHEN v > 1.5 THEN -1.0 WHEN v < -1.5 THEN 1.0 ELSE 0.0 END WHEN abs(v) < 0.5 THEN 0.0 ELSE s END) AS INTEGER) AS position FROM z"""))
def hysteresis(spark, sf_dir):
    return g.hysteresis(m.daily_bars(spark, sf_dir).select("symbol", "date", zscore("close", 20).alias("z")), "z", 1.5, 0.5)


@query("G1_ratings", sql("bars", f""", c AS (SELECT symbol, date, tanh(5 * coalesce(close / nullif(lag(close, 21) OVER w, 0) - 1, 0.0)) AS m, coalesce(-((close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_samp', 'close', 20)}, 0)) / 3, 0.0) AS z, tanh(10 * coalesce(({roll('avg', 'close', 5)}) / nullif({roll('avg', 'close', 20)}, 0) - 1, 0.0)) AS t FROM bars {W}), k AS (SELECT *, (m + z + t) / 3 AS mn FROM c)
SELECT symbol, date, {r(signal='coalesce((m * abs(m) + z * abs(z) + t * abs(t)) / nullif(abs(m) + abs(z) + abs(t), 0), 0.0)', agreement='1 - sqrt(((m - mn) * (m - mn) + (z - mn) * (z - mn) + (t - mn) * (t - mn)) / 3) / 2')} FROM k"""))
def ratings(spark, sf_dir):
    return rounded(g.ratings(m.daily_bars(spark, sf_dir)), "symbol", "date")


PAIRS = "x AS (SELECT symbol, date, industry, close FROM bars JOIN sectors USING (symbol)), p AS (SELECT a.symbol AS a, b.symbol AS b, a.date, a.close AS x, b.close AS y FROM x a JOIN x b ON a.industry = b.industry AND a.date = b.date AND a.symbol < b.symbol), ps AS (SELECT a, b, count(*) AS n, regr_slope(y, x) AS hedge, regr_intercept(y, x) AS intercept, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS correlation, stddev_samp(y) AS sy FROM p GROUP BY a, b HAVING count(*) >= 20)"


def closes(spark, sf_dir):
    """Bars with their industry, and the columns by which pairs meet."""
    return m.daily_bars(spark, sf_dir).join(m.sectors(spark, sf_dir), "symbol"), "industry", "close"


def pair_table(spark, sf_dir):
    """Statistics of the closes of all pairs of an industry with 20 common dates."""
    return pairs.statistics(*closes(spark, sf_dir), 20)


@query("G9_pair_statistics", sql("bars sectors", f", {PAIRS} SELECT a, b, n, {r(hedge='hedge', intercept='intercept', correlation='correlation', residual_std='sy * sqrt(greatest(1 - correlation * correlation, 0.0))')} FROM ps"))
def pair_statistics(spark, sf_dir):
    return rounded(pair_table(spark, sf_dir).drop("deviation"), "a", "b", "n")


@query("G10_best_pairs", sql("bars sectors", f", {PAIRS} SELECT a, b, round(abs(correlation), 6) AS pair_score FROM ps WHERE correlation IS NOT NULL ORDER BY abs(correlation) DESC, a, b LIMIT 10"))
def best_pairs(spark, sf_dir):
    return rounded(g.best_pairs(pair_table(spark, sf_dir), 10).select("a", "b", "pair_score"), "a", "b")


@query("G11_spread_z", sql("bars sectors", f""", {PAIRS}, e AS (SELECT p.a, p.b, p.date, y - hedge * x - intercept AS e FROM p JOIN ps ON p.a = ps.a AND p.b = ps.b), q AS (SELECT a, b, date, CASE WHEN count(e) OVER k >= 20 THEN (e - avg(e) OVER k) / nullif(stddev_samp(e) OVER k, 0) END AS z FROM e WINDOW k AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT a, b, date, round(z, 6) AS z, CASE WHEN z > 2 THEN 1 * -1 WHEN z < -2 THEN 1 ELSE 0 END AS signal FROM q"""))
def spread_z(spark, sf_dir):
    return rounded(pair_paths.spread_z(*closes(spark, sf_dir)), "a", "b", "date")


REG = "mk AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date), sv AS (SELECT date, stddev_samp(market) OVER k AS v, sum(market) OVER k AS s FROM mk WINDOW k AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), rg AS (SELECT date, CASE WHEN v > 0.8 THEN 'crisis' WHEN s < -1 THEN 'bear' WHEN s > 1 THEN 'bull' ELSE 'sideways' END AS regime FROM sv)"


@query("G15_regime", sql("rets", f", {REG} SELECT date, regime FROM rg"))
def regime(spark, sf_dir):
    return g.regime(a.market(m.with_returns(m.daily_bars(spark, sf_dir))))


@query("G16_transitions", sql("rets", f", {REG}, t AS (SELECT lag(regime) OVER (ORDER BY date) AS before, regime FROM rg), n AS (SELECT before, regime, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2) SELECT before, regime, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM n"))
def transitions(spark, sf_dir):
    return rounded(g.transitions(g.regime(a.market(m.with_returns(m.daily_bars(spark, sf_dir))))), "before", "regime", "n")


@query("G17_blend", sql("rets", f""", l AS (SELECT symbol, date, sign(ret) AS signal, least(abs(ret), 1.0) AS confidence FROM rets WHERE ret IS NOT NULL UNION ALL SELECT symbol, date, CASE WHEN close > open THEN 1 ELSE -1 END, 0.5 FROM rets)
SELECT symbol, date, round(coalesce(sum(signal * confidence) / nullif(sum(confidence), 0), 0.0), 6) AS signal, min(sign(signal)) = max(sign(signal)) AS agree FROM l GROUP BY symbol, date"""))
def blend(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    one = rows.where("ret is not null").select("symbol", "date", F.signum("ret").alias("signal"), F.least(F.abs("ret"), F.lit(1.0)).alias("confidence"))
    two = rows.select("symbol", "date", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0).alias("signal"), F.lit(0.5).alias("confidence"))
    return rounded(g.blend(one.unionByName(two)), "symbol", "date")


@query("G22_threshold_signals", sql("rets", "SELECT symbol, date, CASE WHEN ret >= 0.2 THEN 1 WHEN ret <= -0.2 THEN -1 ELSE 0 END AS signal FROM rets"))
def threshold_signals(spark, sf_dir):
    return g.threshold_signals(m.with_returns(m.daily_bars(spark, sf_dir)), "ret", 0.2, -0.2).select("symbol", "date", "signal")


@query("G25_loss_limit", sql("rets", f", {DD}, l AS (SELECT symbol, date, growth / nullif(first_value(growth) OVER k, 0) - 1 AS l FROM dd WINDOW k AS (PARTITION BY symbol, date_trunc('month', date) ORDER BY date)) SELECT symbol, date, max(CAST(l <= -0.1 AS INTEGER)) OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS stopped FROM l"))
def loss_limit(spark, sf_dir):
    return g.loss_limit(drawdown(m.with_returns(m.daily_bars(spark, sf_dir))), 0.1)


@query("G31_drawdown_guard", sql("rets", f", {DD} SELECT symbol, date, max(CAST(drawdown <= -0.5 AS INTEGER)) OVER w AS halted FROM dd {W}"))
def drawdown_guard(spark, sf_dir):
    return g.drawdown_guard(drawdown(m.with_returns(m.daily_bars(spark, sf_dir))), 0.5)


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \\n]+|[^ \\n]+@[^ \\n]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


@query("F1_normalise_text", f"SELECT doc_id, length({NORM}) AS n_chars_normal, md5({NORM}) AS text_md5 FROM documents")
def normalise_text(spark, sf_dir):
    n = text.normalise(F.col("text"))
    return m.table(spark, sf_dir, "documents").select("doc_id", F.length(n).cast("long").alias("n_chars_normal"), F.md5(n).alias("text_md5"))


@query("F2_tickers", "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '[A-Z]+')), lambda x: length(x) BETWEEN 2 AND 5 AND x NOT IN ('THE', 'AND', 'FOR'))), ',') AS tickers FROM documents")
def tickers(spark, sf_dir):
    return m.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tickers(F.col("text")), ",").alias("tickers"))


@query("F3_lexicon")
def lexicon(spark, sf_dir):
    return rounded(m.table(spark, sf_dir, "documents").select("doc_id", text.lexicon_score(F.col("text")).alias("score")), "doc_id")


@query("S1_partitioned_slice", sql("bars", "SELECT symbol, date, round(close, 6) AS close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND symbol IN (1, 2, 3)"))
def partitioned_slice(spark, sf_dir):
    """Written by month of the bars, read back as a slice: the date prunes partitions, the symbol reaches the scan."""
    rows = m.daily_bars(spark, sf_dir).select("symbol", "close", F.trunc("date", "month").alias("month"), "date")
    path = store.scratch(spark, "bars")
    rows.repartition("month").write.partitionBy("month").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path).where("month between date'1996-01-01' and date'1996-06-01' and symbol in (1, 2, 3)")
    return rounded(back.select("symbol", "date", "close"), "symbol", "date")


@query("S3_available", sql("bars", "SELECT DISTINCT date, symbol FROM bars"))
def available(spark, sf_dir):
    return store.available(m.daily_bars(spark, sf_dir))


@query("S5_snapshot", sql("depth", ", b AS (SELECT * FROM depth WHERE ts <= TIMESTAMP '2024-01-15'), l AS (SELECT symbol, max(ts) AS ts FROM b GROUP BY symbol) SELECT b.symbol, CAST(level AS INTEGER) AS level, round(bid_size, 6) AS bid_size FROM b JOIN l ON b.symbol = l.symbol AND b.ts = l.ts WHERE level <= 3"))
def snapshot(spark, sf_dir):
    return rounded(store.snapshot(m.depth(spark, sf_dir), F.expr("timestamp_ntz'2024-01-15'"), 3).select("symbol", "level", "bid_size"), "symbol", "level")


@query("S8_insert_new", sql("articles", ", k AS (SELECT *, sha256(concat_ws('|', title, source)) AS key FROM articles) SELECT key, min(id) AS id FROM k WHERE id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE id % 2 = 0) GROUP BY key"))
def insert_new(spark, sf_dir):
    rows = m.articles(spark, sf_dir).select("id", store.article_id("title", "source").alias("key"))
    return store.insert_new(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "key")


@query("S8_insert_new_articles", sql("headlines", r""", k AS (SELECT id, sha256(concat(regexp_replace(regexp_replace(lower(coalesce(title, '')), '^[ \t\n\r\f\x0B]+', ''), '[ \t\n\r\f\x0B]+\z', ''), '|', lower(coalesce(source, '')), '|', coalesce(CAST(date AS VARCHAR), ''))) AS key FROM headlines)
SELECT key, min(id) AS id FROM k WHERE id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE id % 2 = 0) GROUP BY key"""))
def insert_new_articles(spark, sf_dir):
    """As S8_insert_new, by the whole title, the source and the day."""
    rows = m.headlines(spark, sf_dir).select("id", store.article_key("title", "source", "date").alias("key"))
    return store.insert_new(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "key")


@query("S10_update", sql("articles", "SELECT id, CASE WHEN id % 3 = 0 THEN n_chars * 2 ELSE n_chars END AS n_chars FROM articles"))
def update(spark, sf_dir):
    rows = m.articles(spark, sf_dir).select("id", "n_chars")
    return store.update(rows, rows.where("id % 3 = 0").select("id", (F.col("n_chars") * 2).alias("n_chars")), "id", "n_chars")


@query("S13_cached_result", sql("bars", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol"))
def cached_result(spark, sf_dir):
    folder = store.scratch(spark, "cache")
    build = lambda: m.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    store.cached(spark, folder, {"kind": "count", "source": sf_dir}, build)
    return store.cached(spark, folder, {"source": sf_dir, "kind": "count"}, build)


@query("T1_stream_bars", f"SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, {r(open='first(value ORDER BY ts, event_id)', high='max(value)', low='min(value)', close='last(value ORDER BY ts, event_id)')} FROM events GROUP BY 1, 2")
def stream_bars(spark, sf_dir):
    out = st.run_once(st.bars(st.source(spark, sf_dir)), "complete")
    return rounded(out.select("user_id", F.to_date("w.start").alias("day"), "n", "open", "high", "low", "close"), "user_id", "day", "n")


@query("T2_stream_order_flow", sql("trades", "SELECT symbol AS user_id, CAST(ts AS DATE) AS day, round(sum(side * volume), 6) AS flow FROM trades GROUP BY 1, 2"))
def stream_order_flow(spark, sf_dir):
    return rounded(st.run_once(st.order_flow(st.source(spark, sf_dir)), "complete").select("user_id", F.to_date("w.start").alias("day"), "flow"), "user_id", "day")


@query("T5_stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    return st.run_once(st.first_seen(st.source(spark, sf_dir), ["user_id", "event_type"])).select("user_id", "event_type")


@query("T7_stream_latched_drawdown", """WITH p AS (SELECT event_id, user_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events)
SELECT event_id, user_id, round(peak, 6) AS peak, bool_or(value <= peak * 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS latched FROM p""")
def stream_latched_drawdown(spark, sf_dir):
    out = sf.latched_drawdown(st.source(spark, sf_dir), 0.5, store.scratch(spark, "peaks"))
    return rounded(out.select("event_id", "user_id", "peak", "latched"), "event_id", "user_id")


@query("T8_stream_alerts", "SELECT event_id, user_id, CASE WHEN value > 160 THEN 'critical' ELSE 'warning' END AS level FROM events WHERE value > 80")
def stream_alerts(spark, sf_dir):
    return st.run_once(st.alerts(st.source(spark, sf_dir), 80.0)).select("event_id", "user_id", "level")


@query("T10_late_corrections", f"SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, {r(open='first(value ORDER BY ts, event_id)', high='max(value)', low='min(value)', close='last(value ORDER BY ts, event_id)')} FROM events GROUP BY 1, 2")
def late_corrections(spark, sf_dir):
    """Every 97th event arrives three days late: bars of the rows in time are published, and days with late rows corrected."""
    folder, landing = store.scratch(spark, "late"), store.scratch(spark, "landing")
    sf.arrive(m.table(spark, sf_dir, "events"), landing, 8, F.col("event_id") % 97 == 0, 3)
    sf.land(st.source(spark, landing, "*.parquet", 1), folder, "1 DAY")
    rows = sf.landed(st.SCHEMA.replace("timestamp_ntz", "timestamp"), spark, folder)
    sf.publish(rows, f"{folder}/bars")
    sf.correct(rows, f"{folder}/bars")
    return rounded(sf.read_bars(spark, f"{folder}/bars"), "user_id", "day", "n")
