"""Waveform and feature-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.catalog.beats_q import r6
from beatloom.catalog.evaluation_q import round_array
from beatloom.functions import arrays as A
from beatloom.operators import aggregates, constraints, waveforms, windows
from beatloom.params import Series

REFS = Series(ts="timestamp_ms", tie="ref_id")


def ref_beats(spark, sf):
    return fx.refs(spark, sf).withColumnRenamed("ref_ms", "timestamp_ms")


NEAR = """ac AS (WITH l AS (SELECT r.recording_id, r.ref_id, r.ref_ms, s.timestamp_ms AS lt, s.sample_idx AS li FROM fx_refs r ASOF LEFT JOIN fx_samples s ON r.recording_id = s.recording_id AND r.ref_ms >= s.timestamp_ms),
  rr AS (SELECT r.ref_id, s.timestamp_ms AS rt, s.sample_idx AS ri FROM fx_refs r ASOF LEFT JOIN fx_samples s ON r.recording_id = s.recording_id AND r.ref_ms < s.timestamp_ms)
  SELECT recording_id, ref_id, CASE WHEN lt IS NULL OR rt - ref_ms <= ref_ms - lt THEN ri ELSE li END AS c FROM l JOIN rr USING (ref_id)),
sn AS (SELECT recording_id, ref_id, arg_max(s.sample_idx, struct_pack(a := abs(s.ecg), b := -s.sample_idx)) AS c FROM ac JOIN fx_samples s USING (recording_id) WHERE s.sample_idx BETWEEN c - 8 AND c + 8 GROUP BY recording_id, ref_id)"""


def _window_sql(src: str) -> str:
    return f""", {NEAR}, g AS (SELECT recording_id, ref_id, c, unnest(range(c - 32, c + 33)) AS i FROM {src})
SELECT ref_id, g.c AS centre_idx, list(coalesce(s.ecg, 0.0) ORDER BY i) AS waveform FROM g LEFT JOIN fx_samples s ON s.recording_id = g.recording_id AND s.sample_idx = g.i GROUP BY ref_id, g.c"""


@query("k0_snapped_windows", _window_sql("sn"), "fx_refs", "fx_samples")
def _(spark, sf):
    out = waveforms.extract_windows(ref_beats(spark, sf), fx.samples(spark, sf), s=REFS)
    return out.select("ref_id", "centre_idx", "waveform")


@query("k0b_unsnapped_windows", _window_sql("ac"), "fx_refs", "fx_samples")
def _(spark, sf):
    out = waveforms.extract_windows(ref_beats(spark, sf), fx.samples(spark, sf), snap=0, s=REFS)
    return out.select("ref_id", "centre_idx", "waveform")


@query("k0c_resampled_windows")
def _(spark, sf):
    out = waveforms.resampled_windows(fx.beats(spark, sf), fx.samples(spark, sf))
    return out.select("recording_id", "peak_id", F.size("waveform").alias("n"), F.round(A.sd(F.col("waveform")), 6).alias("sd"))


SNAP = """ctx AS (SELECT vec_id AS peak_id, CAST(embedding AS DOUBLE[]) AS x, CAST(vec_id % 64 AS INT) AS c FROM embeddings),
am AS (SELECT peak_id, x, greatest(0, c - 8) AS lo, list_transform(x[greatest(0, c - 8) + 1 : least(63, c + 8) + 1], lambda v: abs(v)) AS m FROM ctx),
sp AS (SELECT peak_id, x, lo + list_position(m, list_max(m)) - 1 AS a FROM am)"""


def contexts(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("peak_id"), F.col("embedding").cast("array<double>").alias("context"),
                    (F.col("vec_id") % 64).cast("int").alias("centre_idx"))


@query("k0d_context_window", f"""WITH {SNAP} SELECT peak_id, list_transform(range(a - 16, a + 17), lambda i: CASE WHEN i >= 0 AND i < 64 THEN x[i + 1] ELSE 0.0 END) AS waveform FROM sp""")
def _(spark, sf):
    return waveforms.stored_context_windows(contexts(spark, sf), 33, 8).select("peak_id", "waveform")


@query("j6_snap_to_extremum", f"WITH {SNAP} SELECT peak_id, CAST(a AS INT) AS snapped FROM sp")
def _(spark, sf):
    return contexts(spark, sf).select("peak_id", A.snap(F.col("context"), F.col("centre_idx"), 8).alias("snapped"))


@query("k1_window_stats", "SELECT peak_id, round(avg(x), 6) + 0.0 AS window_mean, round(stddev_pop(x), 6) AS window_std, round(max(x) - min(x), 6) AS window_ptp, round(min(x), 6) AS window_min, round(max(x), 6) AS window_max FROM fx_wave_pos GROUP BY peak_id", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.window_stats(fx.waveforms(spark, sf))
    return out.select("peak_id", (F.round("window_mean", 6) + 0.0).alias("window_mean"), *r6("window_std", "window_ptp", "window_min", "window_max"))


QUAL = """sg AS (SELECT peak_id, pos, x, x >= avg(x) OVER (PARTITION BY peak_id) AS up FROM fx_wave_pos),
dd AS (SELECT *, x - lag(x) OVER o AS d, up <> lag(up) OVER o AS flip FROM sg WINDOW o AS (PARTITION BY peak_id ORDER BY pos)),
ql AS (SELECT peak_id, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS window_iqr, CASE WHEN stddev_pop(x) < 1e-6 THEN 0 ELSE kurtosis_pop(x) END AS window_kurtosis, count(*) FILTER (flip) / 63 AS window_zcr,
  max(abs(x)) FILTER (pos = 32) / (quantile_cont(abs(x), 0.5) + 1e-9) AS r_peak_snr, sqrt(avg(d * d)) AS window_hf_noise_rms, regr_slope(x, pos) AS window_wander_slope,
  sum(x * x) FILTER (pos BETWEEN 24 AND 39) / (sum(x * x) + 1e-9) AS window_energy_ratio FROM dd GROUP BY peak_id)"""
QCOLS = ["window_iqr", "window_kurtosis", "window_zcr", "r_peak_snr", "window_hf_noise_rms", "window_wander_slope", "window_energy_ratio"]


@query("k2_signal_quality", f", {QUAL} SELECT peak_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in QCOLS) + " FROM ql", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.signal_quality(fx.waveforms(spark, sf))
    return out.select("peak_id", *[(F.round(c, 6) + 0.0).alias(c) for c in QCOLS])


PAIR = """pr AS (SELECT a.peak_id, a.segment_idx, a.hard_filtered, corr(a.x, b.x) AS r FROM fx_wave_pos a JOIN fx_wave_pos b ON b.beat_idx = a.beat_idx + {step} AND a.pos = b.pos GROUP BY ALL)"""


@query("k3_pearson_arrays", ", " + PAIR.format(step=1) + " SELECT w.peak_id, round(coalesce(r, 0.0), 6) + 0.0 AS r FROM fx_waves w LEFT JOIN pr USING (peak_id)", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.neighbour_similarity(fx.waveforms(spark, sf))
    return out.select("peak_id", (F.round("qrs_corr_next", 6) + 0.0).alias("r"))


@query("e22_neighbour_similarity", ", " + PAIR.format(step=-1) + ", nx AS (SELECT a.peak_id, corr(a.x, b.x) AS r FROM fx_wave_pos a JOIN fx_wave_pos b ON b.beat_idx = a.beat_idx + 1 AND a.pos = b.pos GROUP BY ALL) SELECT w.peak_id, round(coalesce(pr.r, 0.0), 6) + 0.0 AS qrs_corr_prev, round(coalesce(nx.r, 0.0), 6) + 0.0 AS qrs_corr_next FROM fx_waves w LEFT JOIN pr USING (peak_id) LEFT JOIN nx USING (peak_id)", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.neighbour_similarity(fx.waveforms(spark, sf))
    return out.select("peak_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("qrs_corr_prev", "qrs_corr_next")])


GT = "gt AS (SELECT pos, avg(x) AS m FROM fx_wave_pos WHERE label = 'clean' AND NOT hard_filtered GROUP BY pos)"
CLEAN = "label = 'clean' and not hard_filtered"


def global_corr(spark, sf):
    w = fx.waveforms(spark, sf)
    return waveforms.template_similarity(w, aggregates.template(w.filter(CLEAN), ()), (), name="global_corr_clean")


@query("k4_template_correlation", f", {GT} SELECT peak_id, round(coalesce(corr(x, m), 0.0), 6) + 0.0 AS global_corr_clean FROM fx_wave_pos JOIN gt USING (pos) GROUP BY peak_id", "fx_wave_pos")
def _(spark, sf):
    return global_corr(spark, sf).select("peak_id", (F.round("global_corr_clean", 6) + 0.0).alias("global_corr_clean"))


@query("f7_queue_presort", f""", {GT}, c AS (SELECT peak_id, coalesce(corr(x, m), 0.0) AS r FROM fx_wave_pos JOIN gt USING (pos) GROUP BY peak_id)
SELECT peak_id, round(r, 6) + 0.0 AS template_corr, CASE WHEN r >= 0.2 THEN 'pristine' WHEN r >= 0.0 THEN 'ambiguous' ELSE 'likely_artifact' END AS presort_category FROM c ORDER BY r DESC, peak_id""", "fx_wave_pos")
def _(spark, sf):
    from beatloom.operators.learning import presort_queue

    w = fx.waveforms(spark, sf)
    out = presort_queue(w, aggregates.template(w.filter(CLEAN), ()), 0.2, 0.0)
    return out.select("peak_id", (F.round("template_corr", 6) + 0.0).alias("template_corr"), "presort_category")


@query("k5_zscore_windows", "SELECT peak_id, list(round((x - m) / (s + 1e-8), 6) + 0.0 ORDER BY pos) AS z FROM (SELECT *, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s FROM fx_wave_pos WINDOW p AS (PARTITION BY peak_id)) GROUP BY peak_id", "fx_wave_pos")
def _(spark, sf):
    return fx.waveforms(spark, sf).withColumn("z", A.zscore(F.col("waveform"))).select("peak_id", round_array("z"))


# Centroids: the mean window of each tenth of the vectors (by label of the embedding).
CENT = """cl AS (SELECT vec_id AS peak_id, CAST(label AS INT) AS idx FROM embeddings),
ce AS (SELECT idx, pos, avg(x) AS m FROM fx_wave_pos JOIN cl USING (peak_id) GROUP BY ALL),
di AS (SELECT peak_id, w.label, ce.idx, sqrt(sum((x - m) * (x - m))) AS d FROM fx_wave_pos w JOIN ce USING (pos) GROUP BY ALL),
ne AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY d, idx) AS k FROM di),
nn AS (SELECT peak_id, label, idx, d, d / (SELECT avg(d) FROM ne WHERE k = 1 AND label = 'clean') AS score FROM ne WHERE k = 1)"""


def centroids(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("label").alias("idx"), F.col("embedding").cast("array<double>").alias("waveform"))
    t = aggregates.template(e, ["idx"])
    return t.select("idx", F.concat(F.lit("motif_"), F.col("idx").cast("string")).alias("label"), F.col("template").alias("centroid"))


def near_motif(spark, sf):
    return waveforms.nearest_centroid(fx.waveforms(spark, sf), centroids(spark, sf), "waveform", "qrs")


@query("k6_nearest_centroid", f", {CENT} SELECT peak_id, idx AS nearest_qrs_motif_idx, 'motif_' || idx AS nearest_qrs_motif_label, round(d, 6) AS dist_to_nearest_qrs_motif FROM nn", "fx_wave_pos")
def _(spark, sf):
    return near_motif(spark, sf).select("peak_id", "nearest_qrs_motif_idx", "nearest_qrs_motif_label", *r6("dist_to_nearest_qrs_motif"))


@query("k7_anomaly_score", f", {CENT} SELECT peak_id, round(score, 6) AS qrs_anomaly_score, score > 1.1 AS is_qrs_anomaly FROM nn", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.anomaly(near_motif(spark, sf), "dist_to_nearest_qrs_motif", "qrs", limit=1.1)
    return out.select("peak_id", *r6("qrs_anomaly_score"), "is_qrs_anomaly")


AMP = """am AS (SELECT recording_id, segment_idx, quantile_cont(ecg, 0.5) AS ecg_median, quantile_cont(ecg, 0.75) - quantile_cont(ecg, 0.25) AS ecg_iqr, quantile_cont(abs(ecg), 0.95) AS ecg_p95,
  quantile_cont(ecg, 0.99) - quantile_cont(ecg, 0.01) AS segment_amplitude_range, stddev_pop(ecg) AS sd, min(sample_idx) AS i0 FROM fx_samples GROUP BY ALL)"""


@query("k8_amplitude_stats", f", {AMP} SELECT recording_id, segment_idx, max(ecg_median) AS ecg_median, max(ecg_iqr) AS ecg_iqr, max(ecg_p95) AS ecg_p95, round(avg((abs(ecg) > 0.95 * ecg_p95)::INT), 6) AS ecg_saturation_fraction FROM fx_samples JOIN am USING (recording_id, segment_idx) GROUP BY ALL", "fx_samples")
def _(spark, sf):
    out = waveforms.amplitude_stats(fx.samples(spark, sf))
    return out.select("recording_id", "segment_idx", "ecg_median", "ecg_iqr", "ecg_p95", *r6("ecg_saturation_fraction"))


@query("k9_segment_quality_native", f""", {AMP}, bl AS (SELECT recording_id, segment_idx, (sample_idx - i0) // 130 AS b, stddev_pop(ecg) AS s, count(*) AS n, max(sd) AS sd FROM fx_samples JOIN am USING (recording_id, segment_idx) GROUP BY ALL),
fl AS (SELECT recording_id, segment_idx, avg((s < greatest(4.9, 0.05 * sd))::INT) AS f FROM bl WHERE n = 130 GROUP BY ALL), de AS (SELECT recording_id, segment_idx, count(*) / 85.0::DOUBLE AS q FROM fx_beats GROUP BY ALL)
SELECT recording_id, segment_idx, round(f, 6) AS segment_flatline_fraction, round(q, 6) AS segment_qrs_density, round(segment_amplitude_range, 6) AS segment_amplitude_range FROM am LEFT JOIN fl USING (recording_id, segment_idx) LEFT JOIN de USING (recording_id, segment_idx)""", "fx_samples")
def _(spark, sf):
    on = ["recording_id", "segment_idx"]
    smp = fx.samples(spark, sf)
    out = waveforms.amplitude_stats(smp).join(waveforms.flatline_share(smp, floor=4.9), on, "left").join(
        waveforms.qrs_density(fx.beats(spark, sf)), on, "left")
    return out.select(*on, *r6("segment_flatline_fraction", "segment_qrs_density", "segment_amplitude_range"))


@query("k9_segment_spectral_quality")
def _(spark, sf):
    return waveforms.spectral_quality(fx.samples(spark, sf))


@query("k10_morphology_consistency", """, o AS (SELECT peak_id, segment_idx, beat_idx, row_number() OVER (PARTITION BY segment_idx ORDER BY beat_idx) AS k FROM fx_waves WHERE NOT hard_filtered),
q AS (SELECT o.segment_idx, o.k, pos, x FROM o JOIN fx_wave_pos USING (peak_id)), c AS (SELECT a.segment_idx, a.k, coalesce(corr(a.x, b.x), 0.0) AS r FROM q a JOIN q b ON a.segment_idx = b.segment_idx AND b.k = a.k - 1 AND a.pos = b.pos GROUP BY ALL)
SELECT s.segment_idx, round(avg(r), 6) + 0.0 AS sqi_qrs FROM (SELECT DISTINCT segment_idx FROM o) s LEFT JOIN c USING (segment_idx) GROUP BY s.segment_idx""", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.morphology_consistency(fx.waveforms(spark, sf), group=["segment_idx"])
    return out.select("segment_idx", (F.round("sqi_qrs", 6) + 0.0).alias("sqi_qrs"))


SH = """ok AS (SELECT r.recording_id, r.segment_idx, rr_prev_ms AS x, rr_prev_ms - lag(rr_prev_ms) OVER (PARTITION BY r.recording_id, r.segment_idx ORDER BY timestamp_ms, peak_id) AS d FROM fx_rr r WHERE rr_prev_ms IS NOT NULL AND value >= 1),
sh AS (SELECT recording_id, segment_idx, CAST(count(*) AS INT) AS beat_count, avg(x) AS mean_nn, stddev_samp(x) AS sd_nn, sqrt(avg(d * d)) AS rmssd, count(*) FILTER (abs(d) > 50) / count(d) AS pnn50_fraction,
  quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr_nn, count(*) FILTER (abs(d) > 200) / count(d) AS rr_roughness_200 FROM ok GROUP BY ALL)"""
SHC = ["mean_nn", "sd_nn", "rmssd", "pnn50_fraction", "iqr_nn"]


def seg_beats(spark, sf):
    rr = windows.rr_intervals(fx.beats(spark, sf))
    return rr.withColumn("hard_filtered", F.col("value") < 1)


@query("k11_segment_hrv", f", {SH} SELECT recording_id, segment_idx, beat_count, " + ", ".join(f"CASE WHEN beat_count >= 5 THEN round({c}, 6) END AS {c}" for c in SHC) + ", CASE WHEN beat_count >= 2 THEN round(rr_roughness_200, 6) END AS rr_roughness_200 FROM sh", "fx_rr")
def _(spark, sf):
    out = waveforms.segment_hrv(seg_beats(spark, sf))
    return out.select("recording_id", "segment_idx", "beat_count", *r6(*SHC, "rr_roughness_200"))


@query("k12_beat_matrix", f""", {QUAL}, {PAIR.format(step=-1)}, b AS (SELECT peak_id, segment_idx, label, hard_filtered, beat_idx, timestamp_ms - lag(timestamp_ms) OVER (ORDER BY beat_idx) AS p, lead(timestamp_ms) OVER (ORDER BY beat_idx) - timestamp_ms AS n FROM fx_waves),
sm AS (SELECT segment_idx, coalesce(stddev_samp(p), 0.0) AS sd, quantile_cont(p, 0.5) AS pm, quantile_cont(n, 0.5) AS nm FROM b GROUP BY 1),
own AS (SELECT segment_idx, pos, avg(x) AS m, count(*) AS c FROM fx_wave_pos WHERE label = 'clean' AND NOT hard_filtered GROUP BY ALL), {GT},
tc AS (SELECT w.peak_id, corr(w.x, CASE WHEN coalesce(o.c, 0) >= 17 THEN o.m ELSE g.m END) AS r FROM fx_wave_pos w JOIN gt g USING (pos) LEFT JOIN own o ON o.segment_idx = w.segment_idx AND o.pos = w.pos GROUP BY w.peak_id)
SELECT b.peak_id, coalesce(p, pm)::DOUBLE AS rr_prev_ms, coalesce(n, nm)::DOUBLE AS rr_next_ms, round(coalesce(p, pm) / coalesce(n, nm), 6) AS rr_ratio, round(sd, 6) AS segment_rr_sd, round(window_zcr, 6) AS window_zcr,
  round(window_iqr, 6) AS window_iqr, round(coalesce(pr.r, 0.0), 6) + 0.0 AS qrs_corr_prev, round(coalesce(tc.r, 0.0), 6) + 0.0 AS qrs_corr_to_template, 0 AS rr_suspicious_long
FROM b JOIN sm USING (segment_idx) JOIN ql USING (peak_id) JOIN tc USING (peak_id) LEFT JOIN pr USING (peak_id)""", "fx_wave_pos")
def _(spark, sf):
    out = waveforms.beat_matrix(fx.waveforms(spark, sf), ["rr_suspicious_long"], min_template_beats=17)
    return out.select("peak_id", "rr_prev_ms", "rr_next_ms", *r6("rr_ratio", "segment_rr_sd", "window_zcr", "window_iqr"),
                      *[(F.round(c, 6) + 0.0).alias(c) for c in ("qrs_corr_prev", "qrs_corr_to_template")], "rr_suspicious_long")


@query("k13_segment_matrix", f""", {SH}, {AMP}, de AS (SELECT recording_id, segment_idx, count(*) / 85.0::DOUBLE AS q FROM fx_beats GROUP BY ALL)
SELECT recording_id, segment_idx, coalesce(beat_count, 0) AS beat_count, CASE WHEN beat_count >= 5 THEN round(mean_nn, 6) END AS mean_nn, CASE WHEN beat_count >= 5 THEN round(rmssd, 6) END AS rmssd,
  round(q, 6) AS segment_qrs_density, ecg_median, ecg_iqr FROM am FULL JOIN sh USING (recording_id, segment_idx) FULL JOIN de USING (recording_id, segment_idx)""", "fx_rr", "fx_samples")
def _(spark, sf):
    smp = fx.samples(spark, sf)
    soft = constraints.soft_features(fx.labels(spark, sf)).join(fx.beats(spark, sf).select("peak_id", "value"), "peak_id")
    soft = soft.withColumn("hard_filtered", F.col("value") < 1)
    beats = waveforms.extract_windows(soft, smp)
    out = waveforms.segment_matrix(beats, smp)
    return out.select("recording_id", "segment_idx", "beat_count", *r6("mean_nn", "rmssd", "segment_qrs_density"), "ecg_median", "ecg_iqr")


@query("k17_reconstruction_snr", """, b AS (SELECT peak_id, x, round(x * 4) / 4 AS y FROM fx_wave_pos) SELECT peak_id, round(least(60.0, 10 * log10(var_pop(x) / var_pop(x - y))), 6) AS snr FROM b GROUP BY peak_id""", "fx_wave_pos")
def _(spark, sf):
    w = fx.waveforms(spark, sf)
    rebuilt = F.transform("waveform", lambda x: F.round(x * 4, 0) / 4)
    return w.select("peak_id", F.round(A.reconstruction_snr(F.col("waveform"), rebuilt), 6).alias("snr"))


@query("k19_safe_pearson", """, f AS (SELECT peak_id, x, CASE WHEN peak_id % 5 = 0 THEN 1.0 ELSE x * x END AS y FROM fx_wave_pos) SELECT peak_id, round(CASE WHEN stddev_pop(y) < 1e-9 THEN 0.0 ELSE corr(x, y) END, 6) + 0.0 AS r FROM f GROUP BY peak_id""", "fx_wave_pos")
def _(spark, sf):
    w = fx.waveforms(spark, sf)
    flat = F.transform("waveform", lambda x: F.when(F.col("peak_id") % 5 == 0, F.lit(1.0)).otherwise(x * x))
    return w.select("peak_id", (F.round(A.pearson(F.col("waveform"), flat), 6) + 0.0).alias("r"))


@query("j7_rr_patterns", """, v AS (SELECT peak_id, list(rr_prev_ms) OVER (PARTITION BY recording_id ORDER BY beat_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v, count(rr_prev_ms) OVER (PARTITION BY recording_id ORDER BY beat_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM fx_rr),
d AS (SELECT peak_id, v, (v[2] < v[1])::INT + (v[3] < v[2])::INT + (v[4] < v[3])::INT + (v[5] < v[4])::INT AS dn, (v[2] > v[1])::INT + (v[3] > v[2])::INT + (v[4] > v[3])::INT + (v[5] > v[4])::INT AS up FROM v WHERE n = 5)
SELECT peak_id, CASE WHEN dn / 4 > 0.65 AND v[1] - v[5] > 200 THEN 'pots_ramp_up' WHEN up / 4 > 0.65 AND v[5] - v[1] > 200 THEN 'pots_recovery' ELSE '' END AS pattern FROM d""", "fx_rr")
def _(spark, sf):
    rr = windows.rr_intervals(fx.beats(spark, sf)).withColumn("rr_ms", F.col("rr_prev_ms").cast("double"))
    v = windows.rr_vectors(rr, length=5)
    return v.select("peak_id", A.rr_pattern(F.col("rr_vector")).alias("pattern"))


@query("o3_disagreement_export", """, ca AS (SELECT * FROM (SELECT s.*, abs(p_tab - p_wave) AS dis FROM fx_scores s JOIN fx_segq q USING (recording_id, segment_idx) WHERE NOT reviewed AND quality_label <> 'bad' AND p_wave >= 0.5 AND 0.5 * p_tab + 0.5 * p_wave < 0.7)
   ORDER BY dis DESC, peak_id LIMIT 150),
cx AS (SELECT c.peak_id, c.dis, list(s.ecg ORDER BY s.timestamp_ms) AS x, list(abs(s.timestamp_ms - c.timestamp_ms) ORDER BY s.timestamp_ms) AS dt FROM ca c JOIN fx_samples s ON s.recording_id = c.recording_id AND s.segment_idx = c.segment_idx AND abs(s.timestamp_ms - c.timestamp_ms) <= 2500 GROUP BY ALL),
ci AS (SELECT *, list_position(dt, list_min(dt)) - 1 AS ci FROM cx), lo AS (SELECT *, greatest(0, ci - 5) AS lo, least(len(x) - 1, ci + 5) AS hi FROM ci),
sp AS (SELECT *, lo + list_position(x[lo + 1 : hi + 1], list_max(x[lo + 1 : hi + 1])) - 1 AS si FROM lo)
SELECT peak_id, round(dis, 6) AS disagreement, CAST(si AS INT) AS snapped_idx FROM sp WHERE NOT (si < 8 OR si > len(x) - 9) ORDER BY dis DESC, peak_id LIMIT 50""", "fx_scores", "fx_segq", "fx_samples")
def _(spark, sf):
    from beatloom.operators.learning import export_disagreements

    s = fx.scores(spark, sf).withColumns({"disagreement": F.abs(F.col("p_tab") - F.col("p_wave")), "p_ensemble": 0.5 * F.col("p_tab") + 0.5 * F.col("p_wave")})
    out = export_disagreements(s, fx.segment_quality(spark, sf), fx.samples(spark, sf), n=50, oversample=3, max_ensemble=0.7, min_wave=0.5, margin=8)
    return out.select("peak_id", *r6("disagreement"), "snapped_idx")
