"""Interval, heart-rate, session and constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.operators import constraints, windows
from beatloom.params import Series
from beatloom.plans.ordered import over_rows, row_index

W = "WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp_ms, peak_id)"


def r6(*cols: str):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def s6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("e1_rr_intervals", f"""SELECT peak_id, rr_prev_ms, rr_next_ms, abs(rr_prev_ms - rr_next_ms) AS rr_delta_ms
FROM fx_rr""", "fx_rr")
def _(spark, sf):
    return windows.rr_intervals(fx.beats(spark, sf)).select("peak_id", "rr_prev_ms", "rr_next_ms", "rr_delta_ms")


@query("e2_rr_second_neighbours", f"""SELECT peak_id, lag(rr_prev_ms) OVER w AS rr_prev_2, lead(rr_next_ms) OVER w AS rr_next_2
FROM fx_rr {W}""", "fx_rr")
def _(spark, sf):
    return windows.rr_extended(fx.beats(spark, sf)).select("peak_id", "rr_prev_2", "rr_next_2")


@query("e3_rr_local_spread", f""", q AS (SELECT peak_id, recording_id, timestamp_ms, rr_prev_ms AS p1, rr_next_ms AS n1,
  lag(rr_prev_ms) OVER w AS p2, lead(rr_next_ms) OVER w AS n2 FROM fx_rr {W}),
v AS (SELECT peak_id, unnest([coalesce(p2, p1, n1), coalesce(p1, n1), coalesce(n1, p1), coalesce(n2, n1, p1)]) AS x FROM q)
SELECT peak_id, round(avg(x), 6) AS rr_local_mean_5, round(stddev_pop(x), 6) AS rr_local_sd_5 FROM v GROUP BY peak_id""", "fx_rr")
def _(spark, sf):
    return windows.rr_extended(fx.beats(spark, sf)).select("peak_id", *r6("rr_local_mean_5", "rr_local_sd_5"))


@query("e4_rr_deltas_ratio", f"""SELECT peak_id, abs(rr_prev_ms - lag(rr_prev_ms) OVER w) AS rr_abs_delta_prev,
  abs(rr_next_ms - lead(rr_next_ms) OVER w) AS rr_abs_delta_next,
  round(CASE WHEN coalesce(rr_next_ms, 0) = 0 THEN 0.0 ELSE rr_prev_ms / rr_next_ms END, 6) AS rr_delta_ratio_next
FROM fx_rr {W}""", "fx_rr")
def _(spark, sf):
    return windows.rr_extended(fx.beats(spark, sf)).select(
        "peak_id", "rr_abs_delta_prev", "rr_abs_delta_next", *r6("rr_delta_ratio_next"))


@query("e5_rr_legacy", """SELECT peak_id, round(CASE WHEN coalesce(rr_next_ms, 0) = 0 THEN 0.0 ELSE rr_prev_ms / rr_next_ms END, 6) AS rr_ratio,
  rr_prev_ms - rr_next_ms AS rr_diff, (rr_prev_ms + rr_next_ms) / 2 AS rr_mean FROM fx_rr""", "fx_rr")
def _(spark, sf):
    return windows.rr_legacy(windows.rr_intervals(fx.beats(spark, sf))).select(
        "peak_id", *r6("rr_ratio"), "rr_diff", "rr_mean")


@query("e6_fill_segment_median", """, g AS (SELECT recording_id, segment_idx, quantile_cont(rr_prev_ms, 0.5) AS m FROM fx_rr GROUP BY ALL),
a AS (SELECT quantile_cont(rr_prev_ms, 0.5) AS m FROM fx_rr)
SELECT peak_id, coalesce(CAST(rr_prev_ms AS DOUBLE), g.m, a.m, 0.0) AS rr_prev_ms
FROM fx_rr JOIN g USING (recording_id, segment_idx) CROSS JOIN a""", "fx_rr")
def _(spark, sf):
    rr = windows.rr_intervals(fx.beats(spark, sf))
    return windows.fill_with_group_median(rr, ["rr_prev_ms"], ["recording_id", "segment_idx"], []).select(
        "peak_id", "rr_prev_ms")


@query("e7_instantaneous_hr", """SELECT peak_id, round(CASE WHEN rr_prev_ms > 0 THEN 6.0E4 / rr_prev_ms END, 6) AS hr_instantaneous_bpm
FROM fx_rr""", "fx_rr")
def _(spark, sf):
    return windows.heart_rate(fx.beats(spark, sf)).select("peak_id", *r6("hr_instantaneous_bpm"))


HR = f"""hr AS (SELECT *, 6.0E4 / rr_prev_ms AS hr FROM fx_rr),
sm AS (SELECT *, lag(hr) OVER w AS hr_prev, avg(hr) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS hr_smooth FROM hr {W}),
fl AS (SELECT *, min(hr_smooth) OVER (PARTITION BY recording_id ORDER BY timestamp_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS hr_floor FROM sm),
ts AS (SELECT *, coalesce(hr_smooth - hr_floor >= 40, false) AS onset FROM fl),
tr AS (SELECT *, max(onset) OVER p AS tachy FROM ts WINDOW p AS (PARTITION BY recording_id ORDER BY timestamp_ms
   RANGE BETWEEN 20000 PRECEDING AND 20000 FOLLOWING))"""


@query("e8_hr_change_rate", f""", {HR} SELECT peak_id, round(abs(hr - hr_prev) / (rr_prev_ms / 1.0E3), 6) AS hr_change_rate_bpm_per_sec FROM sm""", "fx_rr")
def _(spark, sf):
    return windows.heart_rate(fx.beats(spark, sf)).select("peak_id", *r6("hr_change_rate_bpm_per_sec"))


@query("e9_rolling_mean_beats", f""", {HR} SELECT peak_id, round(hr_smooth, 6) AS hr_smooth FROM sm""", "fx_rr")
def _(spark, sf):
    def build(d, w):
        return windows.smooth_hr_stage(windows.hr_stage(windows.rr_stage(d, w), w), w)

    return over_rows(fx.beats(spark, sf), 12, 1, build).select("peak_id", *r6("hr_smooth"))


@query("e10_rolling_min_time", f""", {HR} SELECT peak_id, round(hr_floor, 6) AS hr_floor FROM fl""", "fx_rr")
def _(spark, sf):
    return constraints.hr_rise(fx.labels(spark, sf)).select("peak_id", *r6("hr_floor"))


SESS = f"""b AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS gap, coalesce(segment_idx < lag(segment_idx) OVER w, false) AS back FROM fx_beats {W}),
e AS (SELECT *, gap IS NULL OR gap > 1000 OR back AS is_boundary FROM b),
se AS (SELECT *, CASE WHEN NOT is_boundary THEN gap END AS rr_ms,
   CAST(sum(CAST(is_boundary AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id FROM e {W})"""
SESS_GAP = 1000  # the given series has gaps of at most 2.7 s
P_SESS = windows.Params(session_gap_ms=SESS_GAP)


def _sessions(spark, sf):
    return windows.sessions(fx.beats(spark, sf), p=P_SESS)


@query("e15_session_split", f", {SESS} SELECT peak_id, rr_ms, is_boundary, session_id FROM se", "fx_beats")
def _(spark, sf):
    return _sessions(spark, sf).select("peak_id", "rr_ms", "is_boundary", "session_id")


@query("e27_usable_sessions", f""", {SESS}, n AS (SELECT recording_id, session_id, count(*) AS c FROM se GROUP BY ALL HAVING count(*) >= 35)
SELECT peak_id, session_id FROM se SEMI JOIN n USING (recording_id, session_id)""", "fx_beats")
def _(spark, sf):
    return windows.usable_sessions(_sessions(spark, sf)).select("peak_id", "session_id")


BASE = f"""{SESS}, bl AS (SELECT *, CASE WHEN count(rr_ms) OVER (w ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) >= 3
   THEN quantile_cont(rr_ms, 0.5) OVER (w ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) END AS baseline_ms FROM se {W}),
ra AS (SELECT *, CASE WHEN baseline_ms > 0 THEN rr_ms / baseline_ms END AS pause_ratio FROM bl),
pm AS (SELECT *, max(pause_ratio) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pre_max_ratio FROM ra {W})"""


def _baseline(spark, sf):
    return over_rows(_sessions(spark, sf), 16, 0, windows.trailing_baseline_stage)


@query("e11_trailing_median", f", {BASE} SELECT peak_id, baseline_ms FROM bl", "fx_beats")
def _(spark, sf):
    return _baseline(spark, sf).select("peak_id", "baseline_ms")


@query("e12_trailing_max_ratio", f", {BASE} SELECT peak_id, round(pause_ratio, 6) AS pause_ratio, round(pre_max_ratio, 6) AS pre_max_ratio FROM pm", "fx_beats")
def _(spark, sf):
    return _baseline(spark, sf).select("peak_id", *r6("pause_ratio", "pre_max_ratio"))


CENT = f"""{SESS}, cb AS (SELECT *, rr_ms - CASE WHEN count(rr_ms) OVER (w ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING) >= 5
   THEN quantile_cont(rr_ms, 0.5) OVER (w ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING) END AS deviation_ms FROM se {W}),
cs AS (SELECT *, coalesce(avg(deviation_ms) OVER (PARTITION BY recording_id, session_id ORDER BY timestamp_ms, peak_id
   ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0.0) AS deviation_smooth FROM cb)"""


def _centred(spark, sf):
    return over_rows(_sessions(spark, sf), 15, 15, windows.centred_baseline_stage)


@query("e13_centred_median", f", {CENT} SELECT peak_id, round(deviation_ms, 6) AS deviation_ms FROM cb", "fx_beats")
def _(spark, sf):
    return _centred(spark, sf).select("peak_id", *r6("deviation_ms"))


@query("e14_centred_mean_session", f", {CENT} SELECT peak_id, round(deviation_smooth, 6) AS deviation_smooth FROM cs", "fx_beats")
def _(spark, sf):
    return _centred(spark, sf).select("peak_id", *r6("deviation_smooth"))


RUNS = f"""f AS (SELECT *, phys_event_window AND NOT coalesce(lag(phys_event_window) OVER w, false) AS opens FROM fx_labels {W}),
i AS (SELECT *, sum(CAST(opens AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f {W}),
runs AS (SELECT recording_id, run, min(timestamp_ms) - 20000 AS start_ms, max(timestamp_ms) + 20000 AS end_ms, count(*) AS n_beats
  FROM i WHERE phys_event_window GROUP BY ALL)"""


@query("e16_flag_runs", f", {RUNS} SELECT recording_id, start_ms, end_ms, n_beats FROM runs", "fx_labels")
def _(spark, sf):
    return windows.flag_runs(fx.labels(spark, sf), "phys_event_window", 20_000).drop("run_id")


@query("e17_successive_differences", f""", d AS (SELECT recording_id, segment_idx, peak_id, rr_prev_ms,
  rr_prev_ms - lag(rr_prev_ms) OVER (PARTITION BY recording_id, segment_idx ORDER BY timestamp_ms, peak_id) AS d FROM fx_rr WHERE rr_prev_ms IS NOT NULL)
SELECT recording_id, segment_idx, round(sqrt(avg(d * d)), 6) AS rmssd, count(*) FILTER (abs(d) > 50) AS n50, count(d) AS n FROM d GROUP BY ALL""", "fx_rr")
def _(spark, sf):
    rr = windows.rr_intervals(fx.beats(spark, sf))
    d = windows.successive_differences(rr, ["recording_id", "segment_idx"], "rr_prev_ms")
    x = F.col("rr_diff_ms")
    return d.groupBy("recording_id", "segment_idx").agg(
        F.round(F.sqrt(F.avg(x * x)), 6).alias("rmssd"), F.count_if(F.abs(x) > 50).alias("n50"), F.count(x).alias("n"))


NOISY = f"""rr AS (SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS p, lead(timestamp_ms) OVER w - timestamp_ms AS n FROM fx_noisy {W}),
nb AS (SELECT *, lag(p) OVER w AS pp, lead(n) OVER w AS nn FROM rr {W}),
ar AS (SELECT peak_id, coalesce(timestamp_ms < lag(timestamp_ms) OVER (PARTITION BY recording_id ORDER BY peak_id), false) AS oos FROM fx_noisy),
hf AS (SELECT nb.*, oos, CASE WHEN p <= 0 THEN 'rr_zero_or_negative' WHEN oos THEN 'timestamp_out_of_sequence'
   WHEN p < 175 AND n > 175 AND pp BETWEEN 300 AND 1800 AND nn BETWEEN 300 AND 1800 THEN 'isolated_impossible_sandwich' END AS hard_filter_reason
   FROM nb JOIN ar USING (peak_id))"""


def _hard(spark, sf):
    ordered = constraints.arrival_disorder(fx.noisy(spark, sf), "peak_id")
    return constraints.hard_filters(row_index(ordered))


@query("e18_neighbour_band", f""", {NOISY} SELECT peak_id, coalesce(pp BETWEEN 300 AND 1800 AND nn BETWEEN 300 AND 1800, false) AS neighbours_normal FROM nb""", "fx_noisy")
def _(spark, sf):
    def build(d, w):
        d = windows.rr_stage(d, w)
        both = F.lag("rr_prev_ms").over(w).between(300, 1800) & F.lead("rr_next_ms").over(w).between(300, 1800)
        return d.withColumn("neighbours_normal", F.coalesce(both, F.lit(False)))

    return over_rows(fx.noisy_indexed(spark, sf), 2, 2, build).select("peak_id", "neighbours_normal")


@query("e19_out_of_sequence", f", {NOISY} SELECT peak_id, oos AS out_of_sequence FROM ar", "fx_noisy")
def _(spark, sf):
    return constraints.arrival_disorder(fx.noisy(spark, sf), "peak_id").select("peak_id", "out_of_sequence")


@query("e20_rr_vectors", """, l AS (SELECT recording_id, peak_id, beat_idx, coalesce(CAST(rr_prev_ms AS DOUBLE), 6.0E2) AS rr FROM fx_rr),
v AS (SELECT peak_id, list(rr) OVER (PARTITION BY recording_id ORDER BY beat_idx ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS v FROM l)
SELECT peak_id, list_transform(v, lambda x: CAST(x AS BIGINT)) AS rr_vector FROM v WHERE len(v) = 10""", "fx_rr")
def _(spark, sf):
    rr = windows.rr_intervals(fx.beats(spark, sf)).withColumn("rr_ms", F.coalesce("rr_prev_ms", F.lit(600)))
    return windows.rr_vectors(rr).select("peak_id", F.col("rr_vector").cast("array<bigint>").alias("rr_vector"))


@query("e21_rr_vectors_padded", f"""SELECT peak_id, [{", ".join(
    f"coalesce({'lag' if o < 0 else 'lead'}(CAST(rr_prev_ms AS BIGINT), {abs(o)}) OVER w, 0)" for o in range(-5, 5))}] AS rr_vector FROM fx_rr {W}""", "fx_rr")
def _(spark, sf):
    rr = windows.rr_intervals(fx.beats(spark, sf)).withColumn("rr_ms", F.col("rr_prev_ms").cast("double"))
    return windows.rr_vectors(rr, fill="zero").select("peak_id", F.col("rr_vector").cast("array<bigint>").alias("rr_vector"))


@query("e23_temporal_split", """, s AS (SELECT recording_id, segment_idx, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) - 1 AS r,
  count(*) OVER (PARTITION BY recording_id) AS n FROM (SELECT DISTINCT recording_id, segment_idx FROM fx_beats))
SELECT peak_id, r < greatest(1, floor(n * 800 / 1000)) AS is_train FROM fx_beats JOIN s USING (recording_id, segment_idx)""", "fx_beats")
def _(spark, sf):
    return windows.temporal_split(fx.beats(spark, sf), ["recording_id", "segment_idx"]).select("peak_id", "is_train")


@query("e24_temporal_row_split", """, s AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) - 1 AS r,
  count(*) OVER (PARTITION BY recording_id) AS n FROM fx_segq)
SELECT recording_id, segment_idx, quality_label, r < greatest(1, floor(n * 800 / 1000)) AS is_train FROM s""", "fx_segq")
def _(spark, sf):
    return windows.temporal_split(fx.segment_quality(spark, sf), ["recording_id", "segment_idx"])


SPINE = """sp AS (SELECT event_type, unnest(range(min(hour_ms), max(hour_ms) + 1, 3600000)) AS hour_ms FROM fx_hourly GROUP BY event_type),
j AS (SELECT sp.event_type, sp.hour_ms, v FROM sp LEFT JOIN fx_hourly USING (event_type, hour_ms)),
c AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN hour_ms END IGNORE NULLS) OVER l AS lt, last_value(v IGNORE NULLS) OVER l AS lv,
   first_value(CASE WHEN v IS NOT NULL THEN hour_ms END IGNORE NULLS) OVER r AS rt, first_value(v IGNORE NULLS) OVER r AS rv FROM j
   WINDOW l AS (PARTITION BY event_type ORDER BY hour_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          r AS (PARTITION BY event_type ORDER BY hour_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ip AS (SELECT event_type, hour_ms, v, lt, rt, CASE WHEN lt = rt THEN lv ELSE lv + (rv - lv) * ((hour_ms - lt) / (rt - lt)) END AS line FROM c)"""
HOURS = Series(key=("event_type",), ts="hour_ms", tie="hour_ms", idx="hour_idx", bucket_ms=3_600_000 * 24)


def hourly_spine(spark, sf):
    from beatloom.operators.aggregates import resample_spine

    return resample_spine(fx.hourly(spark, sf), ["event_type"], "hour_ms", 3_600_000)


@query("e25_interpolate_limited", f""", {SPINE} SELECT event_type, hour_ms, round(CASE WHEN hour_ms - lt <= 7200000 OR rt - hour_ms <= 7200000 THEN line END, 6) AS v_filled FROM ip""", "fx_hourly")
def _(spark, sf):
    return windows.interpolate_gaps(hourly_spine(spark, sf), "v", HOURS, 2).select("event_type", "hour_ms", *r6("v_filled"))


@query("e26_interpolate_all", f""", {SPINE} SELECT event_type, hour_ms, round(line, 6) AS v_filled FROM ip""", "fx_hourly")
def _(spark, sf):
    return windows.interpolate_gaps(hourly_spine(spark, sf), "v", HOURS).select("event_type", "hour_ms", *r6("v_filled"))


@query("e28_rolling_week_mean", """, h AS (SELECT event_type, CAST(floor((epoch_us(ts) // 1000) / 3600000) AS BIGINT) * 3600000 AS hour_ms, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL)
SELECT event_type, hour_ms, round(avg(cents) OVER (PARTITION BY event_type ORDER BY hour_ms
  RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM h""".replace(", h AS", "WITH h AS", 1))
def _(spark, sf):
    hour = (F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000).alias("hour_ms")
    h = fx.events_ms(spark, sf).groupBy("event_type", hour).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return windows.rolling_time_mean(h, "cents", 7 * 86_400_000, HOURS).select(
        "event_type", "hour_ms", *r6("rolling_mean"))


# ---- constraints -----------------------------------------------------------


@query("i4_hard_filters", f", {NOISY} SELECT peak_id, hard_filter_reason, hard_filter_reason IS NOT NULL AS hard_filtered FROM hf", "fx_noisy")
def _(spark, sf):
    return _hard(spark, sf).select("peak_id", "hard_filter_reason", "hard_filtered")


@query("i15_tachy_transitions", f", {HR} SELECT peak_id, tachy AS tachy_transition_candidate FROM tr", "fx_rr")
def _(spark, sf):
    return constraints.hr_rise(fx.labels(spark, sf)).select("peak_id", "tachy_transition_candidate")


SOFT = f"""{HR}, ph AS (SELECT tr.*, l.label, max(l.phys_event_window) OVER p AS pots FROM tr JOIN (SELECT peak_id, label, phys_event_window FROM fx_labels) l USING (peak_id)
  WINDOW p AS (PARTITION BY recording_id ORDER BY timestamp_ms RANGE BETWEEN 20000 PRECEDING AND 20000 FOLLOWING)),
so AS (SELECT *, coalesce(rr_prev_ms < 275, false) AS rr_suspicious_short, coalesce(rr_prev_ms > 2250, false) AS rr_suspicious_long,
  coalesce(hr < 45, false) AS hr_suspicious_low, coalesce(hr > 205, false) AS hr_suspicious_high,
  coalesce(hr BETWEEN 85 AND 115, false) AS in_modal_hr_range, pots AS pots_transition_candidate, tachy AS tachy_transition_candidate,
  coalesce(abs(hr - hr_prev) / (rr_prev_ms / 1.0E3) > 25 AND NOT pots AND NOT tachy AND NOT rr_prev_ms < 275, false) AS physio_implausible FROM ph),
pr AS (SELECT *, CAST(3 * physio_implausible::INT + 2 * rr_suspicious_short::INT + 2 * rr_suspicious_long::INT + 1.5 * hr_suspicious_high::INT
  + hr_suspicious_low::INT + 0.5 * pots::INT + 0.5 * tachy::INT AS DOUBLE) AS review_priority_score FROM so)"""


@query("i16_soft_features", f""", {SOFT} SELECT peak_id, rr_suspicious_short, rr_suspicious_long, hr_suspicious_low, hr_suspicious_high,
  in_modal_hr_range, pots_transition_candidate, tachy_transition_candidate, physio_implausible FROM so""", "fx_labels", "fx_rr")
def _(spark, sf):
    return constraints.soft_features(fx.labels(spark, sf)).select(
        "peak_id", "rr_suspicious_short", "rr_suspicious_long", "hr_suspicious_low", "hr_suspicious_high",
        "in_modal_hr_range", "pots_transition_candidate", "tachy_transition_candidate", "physio_implausible")


@query("i17_review_priority", f", {SOFT} SELECT peak_id, review_priority_score FROM pr", "fx_labels", "fx_rr")
def _(spark, sf):
    return constraints.soft_features(fx.labels(spark, sf)).select("peak_id", "review_priority_score")


@query("flagship_segment_review", f""", {SOFT} SELECT recording_id, segment_idx, count(*) AS n_beats,
  count(*) FILTER (physio_implausible) AS n_implausible, count(*) FILTER (label = 'artifact') AS n_artifact,
  round(avg(hr), 6) AS mean_hr, round(avg(review_priority_score), 6) AS mean_priority FROM pr GROUP BY ALL""", "fx_labels", "fx_rr")
def _(spark, sf):
    d = constraints.soft_features(fx.labels(spark, sf))
    return d.groupBy("recording_id", "segment_idx").agg(
        F.count(F.lit(1)).alias("n_beats"),
        F.count_if("physio_implausible").alias("n_implausible"),
        F.count_if(F.col("label") == "artifact").alias("n_artifact"),
        F.round(F.avg("hr_instantaneous_bpm"), 6).alias("mean_hr"),
        F.round(F.avg("review_priority_score"), 6).alias("mean_priority"))
