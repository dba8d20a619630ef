"""Variability and daily-rhythm queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.catalog.beats_q import r6
from beatloom.operators import columns, hrv, rollup
from beatloom.params import METRIC_RANGES

K = ["recording_id", "timeframe", "window_start_ms"]
FRAMES = hrv.ALL_FRAMES


def _values(frames) -> str:
    return ", ".join(f"('{n}', {ms}, {least})" for n, (ms, least) in frames.items())


def _win(frames) -> str:
    """Each interval in its window of each timeframe, in windows with enough beats."""
    return f"""rt AS (SELECT recording_id, timestamp_ms AS t, CAST(rr_prev_ms AS DOUBLE) AS rr FROM fx_long_rr WHERE rr_prev_ms IS NOT NULL),
an AS (SELECT recording_id, min(t) AS a FROM rt GROUP BY recording_id),
wa AS (SELECT rt.*, timeframe, len, a + (t - a) // len * len AS window_start_ms, least_n FROM rt JOIN an USING (recording_id),
   (VALUES {_values(frames)}) f(timeframe, len, least_n)),
wi AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY t) - 1 AS i FROM wa WINDOW g AS (PARTITION BY recording_id, timeframe, window_start_ms)),
wn AS (SELECT *, rr - lag(rr) OVER g AS d, lag(rr) OVER g AS m1, lag(rr, 2) OVER g AS m2, lead(rr) OVER g AS p1, lead(rr, 2) OVER g AS p2 FROM wi WHERE n >= least_n
   WINDOW g AS (PARTITION BY recording_id, timeframe, window_start_ms ORDER BY t))"""


WIN, ENTROPY_WIN = _win(FRAMES), _win(hrv.ENTROPY_FRAMES)
KEYS = "recording_id, timeframe, window_start_ms"
SHORTEST = "5M"


def rr(spark, sf):
    return hrv.rr_table(fx.long_beats(spark, sf))


def beat_rr(spark, sf):
    return hrv.rr_table(fx.beats(spark, sf))


@query("l1_tumbling_windows", f""", {WIN} SELECT {KEYS}, window_start_ms + max(len) AS window_end_ms, count(*) AS count FROM wn GROUP BY recording_id, timeframe, window_start_ms""", "fx_long_rr")
def _(spark, sf):
    return hrv.window_counts(rr(spark, sf), FRAMES).select(*K, "window_end_ms", "count")


@query("l2_entropy_windows", f""", {ENTROPY_WIN} SELECT {KEYS}, count(*) AS count, round(avg(rr), 6) AS mean_rr FROM wn GROUP BY ALL""", "fx_long_rr")
def _(spark, sf):
    return hrv.moments(rr(spark, sf), hrv.ENTROPY_FRAMES).select(*K, "count", *r6("mean_rr"))


@query("l3_time_domain", f""", {WIN}, md AS (SELECT {KEYS}, quantile_cont(rr, 0.5) AS med FROM wn GROUP BY ALL),
b AS (SELECT {KEYS}, count(*) AS count, avg(rr) AS m, stddev_samp(rr) AS sdnn, stddev_samp(d) AS sdsd, sqrt(avg(d * d)) AS rmssd, count(*) FILTER (abs(d) > 20) / count(d) * 100 AS pnn20,
  count(*) FILTER (abs(d) > 50) / count(d) * 100 AS pnn50 FROM wn GROUP BY ALL),
q AS (SELECT {KEYS}, min(rr) AS min_rr, max(rr) AS max_rr, max(rr) - min(rr) AS mxdmn, max(med) AS med_rr, quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25) AS iqr,
  round(quantile_cont(rr, 0.2), 6) AS q20, round(quantile_cont(rr, 0.8), 6) AS q80, quantile_cont(abs(rr - med), 0.5) AS mad FROM wn JOIN md USING ({KEYS}) GROUP BY ALL)
SELECT {KEYS}, count, round(sdnn, 6) AS sdnn, round(sdsd, 6) AS sdsd, round(rmssd, 6) AS rmssd, round(pnn20, 6) AS pnn20, round(pnn50, 6) AS pnn50, round(sdnn / m * 100, 6) AS cv,
  round(rmssd / m * 100, 6) AS cvsd, min_rr, max_rr, mxdmn, med_rr, iqr, q20, q80, mad, round(mad / med_rr * 100, 6) AS mcv FROM b JOIN q USING ({KEYS})""", "fx_long_rr")
def _(spark, sf):
    st = rollup.states(rr(spark, sf), FRAMES)
    out = hrv.moments(st).join(hrv.order_statistics(st).drop("count"), K)
    return out.select(*K, "count", *r6("sdnn", "sdsd", "rmssd", "pnn20", "pnn50", "cv", "cvsd"), "min_rr", "max_rr", "mxdmn",
                      "med_rr", "iqr", *r6("q20", "q80"), "mad", *r6("mcv"))


@query("l4_deceleration_capacity", f""", {WIN} SELECT {KEYS}, round(avg((rr + p1 - m1 - m2) / 4) FILTER (d > 0 AND i >= 5 AND i + 5 < n), 6) AS dc,
  round(-avg((rr + p1 - m1 - m2) / 4) FILTER (d < 0 AND i >= 5 AND i + 5 < n), 6) AS ac FROM wn GROUP BY ALL""", "fx_long_rr")
def _(spark, sf):
    return hrv.moments(rr(spark, sf), FRAMES).select(*K, *r6("dc", "ac"))


@query("l5_sub_bin_spread", f""", {WIN}, b AS (SELECT {KEYS}, (window_start_ms::HUGEINT * (n - 1) + i * len) // ((n - 1) * 300000) AS bin, avg(rr) AS m, stddev_samp(rr) AS s FROM wn GROUP BY ALL)
SELECT {KEYS}, round(CASE WHEN count(*) > 1 THEN stddev_samp(m) END, 6) AS sdann5, round(CASE WHEN count(*) > 1 THEN avg(s) END, 6) AS sdnni5 FROM b GROUP BY ALL""", "fx_long_rr")
def _(spark, sf):
    return hrv.sub_bin_spread(rr(spark, sf), FRAMES).select(*K, *r6("sdann5", "sdnni5"))


@query("l6_frequency_domain")
def _(spark, sf):
    return hrv.frequency_domain(rr(spark, sf), FRAMES)


@query("l7_permutation_entropy", f""", {WIN}, p AS (SELECT {KEYS}, (rr <= p1)::INT * 4 + (p1 <= p2)::INT * 2 + (rr <= p2)::INT AS p, count(*) AS c FROM wn WHERE p2 IS NOT NULL GROUP BY ALL),
q AS (SELECT *, c / sum(c) OVER (PARTITION BY {KEYS}) AS f FROM p) SELECT {KEYS}, round(-sum(f * log2(f)) / {math.log2(6)!r}, 6) AS perm_en FROM q GROUP BY ALL""", "fx_long_rr")
def _(spark, sf):
    return hrv.permutation_entropy(rr(spark, sf), FRAMES).select(*K, *r6("perm_en"))


@query("l8_sample_entropy")
def _(spark, sf):
    return hrv.sample_entropies(rr(spark, sf), FRAMES)


@query("l9_fluctuation_exponents")
def _(spark, sf):
    return hrv.fluctuation(rr(spark, sf), FRAMES)


@query("l10_fuzzy_entropy_dimension")
def _(spark, sf):
    return hrv.entropic(rr(spark, sf))


@query("l11_poincare", f""", {WIN}, v AS (SELECT {KEYS}, sqrt(0.5 * var_samp(d)) AS sd1, sqrt(2 * var_samp(rr) - 0.5 * var_samp(d)) AS sd2 FROM wn GROUP BY ALL)
SELECT {KEYS}, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(sd1 / sd2, 6) AS sd1_sd2, round(sd2 / sd1, 6) AS csi, round(log10(sd1 * sd2), 6) AS cvi FROM v""", "fx_long_rr")
def _(spark, sf):
    return hrv.moments(rr(spark, sf), FRAMES).select(*K, *r6("sd1", "sd2", "sd1_sd2", "csi", "cvi"))


@query("l12_geometric", f""", {WIN}, s AS (SELECT {KEYS}, count(*) AS n, min(rr) AS lo, max(rr) - min(rr) AS span, 2.0::DOUBLE * (quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25)) / pow(count(*)::DOUBLE, 1.0::DOUBLE / 3) AS fd FROM wn GROUP BY ALL),
s2 AS (SELECT *, ceil(span / CASE WHEN fd > 0 THEN least(fd, span / (log2(n::DOUBLE) + 1)) ELSE span / (log2(n::DOUBLE) + 1) END) AS bins FROM s),
a AS (SELECT {KEYS}, least(floor((rr - lo) / (span / bins)), bins - 1) AS b, count(*) AS c, max(s2.n) AS n, max(span / bins) AS w FROM wn JOIN s2 USING ({KEYS}) GROUP BY ALL),
t AS (SELECT *, max(c) OVER (PARTITION BY {KEYS}) AS top FROM a),
f AS (SELECT {KEYS}, least(floor((rr - lo) / 50), greatest(1, ceil(span / 50)) - 1) AS b, count(*) AS c, max(s.n) AS n FROM wn JOIN s USING ({KEYS}) GROUP BY ALL),
g AS (SELECT {KEYS}, max(c) / max(n) * 100 AS amo50 FROM f GROUP BY ALL)
SELECT {KEYS}, round(max(n) / max(top), 6) AS hti, round((max(b) FILTER (c >= top / 2) - min(b) FILTER (c >= top / 2) + 1) * max(w), 6) AS tinn, round(max(amo50), 6) AS amo50 FROM t JOIN g USING ({KEYS}) GROUP BY ALL""", "fx_long_rr")
def _(spark, sf):
    return hrv.geometric(rr(spark, sf), FRAMES).select(*K, *r6("hti", "tinn", "amo50"))


@query("l13_all_metrics")
def _(spark, sf):
    out = hrv.hrv_metrics(rr(spark, sf))
    return columns.round_metrics(out, [c for c in out.columns if c not in K])


# Closed-form columns of the wrapper; a timeframe's unsupported columns are null.
CLOSED = ("count", "med_rr", "min_rr", "max_rr", "mxdmn", "iqr", "mad", "sdsd", "sdnn", "rmssd", "pnn20", "pnn50", "dc", "ac", "sd1", "sd2", "sd1_sd2", "csi", "perm_en", "amo50", "hti")
DAY_ONLY = ("amo50", "hti")


@query("l13_closed_form", f""", {WIN}, md AS (SELECT {KEYS}, quantile_cont(rr, 0.5) AS med FROM wn GROUP BY ALL),
x AS (SELECT {KEYS}, count(*) AS count, max(med) AS med_rr, min(rr) AS min_rr, max(rr) AS max_rr, max(rr) - min(rr) AS mxdmn, quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25) AS iqr,
  quantile_cont(abs(rr - med), 0.5) AS mad, stddev_samp(d) AS sdsd, stddev_samp(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd, count(*) FILTER (abs(d) > 20) / count(d) * 100 AS pnn20, count(*) FILTER (abs(d) > 50) / count(d) * 100 AS pnn50,
  avg((rr + p1 - m1 - m2) / 4) FILTER (d > 0 AND i >= 5 AND i + 5 < n) AS dc, -avg((rr + p1 - m1 - m2) / 4) FILTER (d < 0 AND i >= 5 AND i + 5 < n) AS ac,
  sqrt(0.5 * var_samp(d)) AS sd1, sqrt(2 * var_samp(rr) - 0.5 * var_samp(d)) AS sd2 FROM wn JOIN md USING ({KEYS}) GROUP BY ALL),
p AS (SELECT {KEYS}, (rr <= p1)::INT * 4 + (p1 <= p2)::INT * 2 + (rr <= p2)::INT AS p, count(*) AS c FROM wn WHERE p2 IS NOT NULL GROUP BY ALL),
pe AS (SELECT {KEYS}, -sum(f * log2(f)) / {math.log2(6)!r} AS perm_en FROM (SELECT *, c / sum(c) OVER (PARTITION BY {KEYS}) AS f FROM p) GROUP BY ALL),
s AS (SELECT {KEYS}, count(*) AS n, min(rr) AS lo, max(rr) - min(rr) AS span, 2.0::DOUBLE * (quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25)) / pow(count(*)::DOUBLE, 1.0::DOUBLE / 3) AS fd FROM wn GROUP BY ALL),
s2 AS (SELECT *, ceil(span / CASE WHEN fd > 0 THEN least(fd, span / (log2(n::DOUBLE) + 1)) ELSE span / (log2(n::DOUBLE) + 1) END) AS bins FROM s),
t AS (SELECT {KEYS}, max(n) / max(c) AS hti FROM (SELECT {KEYS}, least(floor((rr - lo) / (span / bins)), bins - 1) AS b, count(*) AS c, max(s2.n) AS n FROM wn JOIN s2 USING ({KEYS}) GROUP BY ALL) GROUP BY ALL),
f AS (SELECT {KEYS}, max(c) / max(n) * 100 AS amo50 FROM (SELECT {KEYS}, least(floor((rr - lo) / 50), greatest(1, ceil(span / 50)) - 1) AS b, count(*) AS c, max(s.n) AS n FROM wn JOIN s USING ({KEYS}) GROUP BY ALL) GROUP BY ALL),
j AS (SELECT * REPLACE (CASE WHEN timeframe = '24H' THEN amo50 END AS amo50, CASE WHEN timeframe = '24H' THEN hti END AS hti) FROM (SELECT x.*, sd1 / sd2 AS sd1_sd2, sd2 / sd1 AS csi FROM x) JOIN pe USING ({KEYS}) JOIN t USING ({KEYS}) JOIN f USING ({KEYS}))
SELECT {KEYS}, count, {", ".join(f"round({c}, 6) AS {c}" for c in CLOSED if c != "count")} FROM j""", "fx_long_rr")
def _(spark, sf):
    return hrv.hrv_metrics(rr(spark, sf), names=CLOSED).select(*K, "count", *r6(*[c for c in CLOSED if c != "count"]))


@query("b8_metric_subset", f", {WIN} SELECT {KEYS}, count(*) AS count, round(stddev_samp(rr), 6) AS sdnn, CASE WHEN timeframe = '24H' THEN 1.0::DOUBLE END AS ulf, CASE WHEN len >= 10800000 THEN 2.0::DOUBLE END AS vlf FROM wn GROUP BY ALL", "fx_long_rr")
def _(spark, sf):
    m = hrv.moments(rr(spark, sf)).select(*K, "count", *r6("sdnn"), F.lit(1.0).alias("ulf"), F.lit(2.0).alias("vlf"))
    parts = [columns.metric_subset(m.filter(F.col("timeframe") == t), t, K) for t in FRAMES]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("b9_stats_metrics_split", f", {WIN} SELECT {KEYS}, round(rm, 6) AS rmssd, round(sd, 6) AS sdnn FROM (SELECT {KEYS}, sqrt(avg(d * d)) AS rm, stddev_samp(rr) AS sd FROM wn GROUP BY ALL)", "fx_long_rr")
def _(spark, sf):
    m = hrv.moments(rr(spark, sf), FRAMES).select(*K, "count", "cv", *r6("rmssd", "sdnn"))
    return columns.stats_and_metrics(m, K)[1]


@query("l14_instantaneous_hr", "SELECT recording_id, timestamp_ms, round(6.0E4 / rr_prev_ms, 1) AS hr FROM fx_rr WHERE rr_prev_ms > 0", "fx_rr")
def _(spark, sf):
    return hrv.instantaneous_hr(beat_rr(spark, sf)).select("recording_id", "timestamp_ms", "hr")


def hourly(spark, sf):
    h = fx.hourly(spark, sf)
    return h.withColumn("hour", F.hour(F.timestamp_millis("hour_ms")))


COS = """h AS (SELECT event_type, hour_ms, v, CAST(hour_ms // 3600000 % 24 AS INT) AS hour FROM fx_hourly)"""


# DuckDB has regr_* but no two-variable fit: the SQL solves the normal equations with Cramer's rule.
@query("l15_cosinor", f""", {COS}, a AS (SELECT event_type, v, cos(hour * 2 * pi() / 24) AS c, sin(hour * 2 * pi() / 24) AS s FROM h),
m AS (SELECT event_type, count(*) AS n, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(v, c) AS yc, covar_pop(v, s) AS ys, var_pop(v) AS yy, avg(v) AS my, avg(c) AS mc, avg(s) AS ms FROM a GROUP BY 1),
b AS (SELECT *, (yc * ss - ys * cs) / (cc * ss - cs * cs) AS b1, (ys * cc - yc * cs) / (cc * ss - cs * cs) AS b2 FROM m)
SELECT event_type, n, round(my - b1 * mc - b2 * ms, 6) AS mesor, round(sqrt(b1 * b1 + b2 * b2), 6) AS amplitude, round((atan2(-b2, b1) * 24 / (2 * pi()) + 24) % 24, 6) AS acrophase,
  round((b1 * yc + b2 * ys) / yy, 6) AS r_squared FROM b""", "fx_hourly")
def _(spark, sf):
    return hrv.cosinor(hourly(spark, sf), "hour", "v", ["event_type"]).select("event_type", "n", *r6("mesor", "amplitude", "acrophase", "r_squared"))


@query("l16_hourly_profile", f", {COS} SELECT event_type, hour, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM h GROUP BY ALL", "fx_hourly")
def _(spark, sf):
    return hrv.hourly_profile(hourly(spark, sf), "hour", "v", ["event_type"]).select("event_type", "hour", *r6("mean", "sd"), "n")


@query("l17_daily_slices", """, s AS (SELECT *, hour_ms // 86400000 * 86400000 AS slice_ms FROM fx_hourly), z AS (SELECT event_type, slice_ms, (max(hour_ms) - min(hour_ms)) // 3600000 + 1 AS h FROM s GROUP BY ALL)
SELECT event_type, slice_ms, count(*) AS n, round(avg(v), 6) AS v FROM s JOIN z USING (event_type, slice_ms) WHERE h >= 23 GROUP BY ALL""", "fx_hourly")
def _(spark, sf):
    d = hrv.time_slices(fx.hourly(spark, sf), "hour_ms", "daily", 23, ["event_type"])
    return d.groupBy("event_type", "slice_ms").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("v"))


@query("l17_weekly_slices", """, s AS (SELECT *, CAST((epoch_us(date_trunc('week', make_timestamp_ms(hour_ms))::TIMESTAMP) // 1000) AS BIGINT) AS slice_ms FROM fx_hourly),
z AS (SELECT event_type, slice_ms, (max(hour_ms) - min(hour_ms)) // 3600000 + 1 AS h FROM s GROUP BY ALL)
SELECT event_type, slice_ms, count(*) AS n, round(avg(v), 6) AS v FROM s JOIN z USING (event_type, slice_ms) WHERE h >= 120 GROUP BY ALL""", "fx_hourly")
def _(spark, sf):
    d = hrv.time_slices(fx.hourly(spark, sf), "hour_ms", "weekly", 120, ["event_type"])
    return d.groupBy("event_type", "slice_ms").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("v"))


@query("l19_metric_ranges", f""", {WIN}, b AS (SELECT {KEYS}, stddev_samp(rr) AS sdnn, sqrt(avg(d * d)) AS rmssd FROM wn GROUP BY ALL)
SELECT {KEYS}, CASE WHEN sdnn < 30 THEN 'low' WHEN sdnn > 150 THEN 'high' ELSE 'normal' END AS sdnn_class, CASE WHEN rmssd < 27 THEN 'low' WHEN rmssd > 72 THEN 'high' ELSE 'normal' END AS rmssd_class FROM b""", "fx_long_rr")
def _(spark, sf):
    d = columns.classify_range(hrv.moments(rr(spark, sf), FRAMES), METRIC_RANGES)
    return d.select(*K, "sdnn_class", "rmssd_class")
