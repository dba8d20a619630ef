"""Source, model, augmentation and incremental queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import hrv_q, query
from beatloom.catalog.beats_q import r6
from beatloom.catalog.hrv_q import beat_rr as rr
from beatloom.operators import aggregates, categorytree, intervals, models, sampleindex, waveforms, windows
from beatloom.plans.ordered import over_rows
from beatloom.sources import queues, tables
from beatloom.session import checkpoint_dir, materialise
from beatloom.streaming import anchored, live

ON = ["recording_id", "segment_idx"]
CODES = {"clean": 0, "noisy_ok": 1, "bad": 2}

# ---- sources ---------------------------------------------------------------


@query("a2_find_column", "SELECT o_orderkey, o_totalprice AS value FROM orders")
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select("o_orderkey", F.col(tables.find_column(o, ["price", "o_totalprice", "o_custkey"])).alias("value"))


@query("a6_key_fallback", "SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE value END, CAST(user_id AS DOUBLE)) AS v FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("value")).alias("b"), F.col("user_id").cast("double").alias("c"))
    return e.select("event_id", tables.first_present(e, ["a", "b", "c"], F.lit(0.0)).alias("v"))


@query("a8_table_summary", "SELECT label, count(*) AS n, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, (SELECT count(*) FROM fx_labels) AS n_all, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fx_labels), 6) AS pct FROM fx_labels GROUP BY label", "fx_labels")
def _(spark, sf):
    return tables.table_summary(fx.labels(spark, sf), "timestamp_ms", "label").select("label", "n", "first_ms", "last_ms", "n_all", *r6("pct"))


def device(spark, sf):
    """A wide device table: every event is a row in ns, ms or s."""
    e = fx.events_ms(spark, sf)
    k = F.col("event_id") % 3
    t = F.when(k == 0, F.col("ts_ms") * 1_000_000).when(k == 1, F.col("ts_ms")).otherwise(F.floor(F.col("ts_ms") / 1000))
    return e.select(
        (F.col("user_id") % 16).alias("recording_id"), F.when(F.col("event_type") == "view", F.lit(0)).otherwise(t).cast("long").alias("time"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("ecg"), F.when(F.col("event_type") == "error", F.col("value")).alias("hr"),
        F.when(F.col("event_type") == "signup", F.col("value")).alias("rr"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("marker"),
        F.col("event_id").alias("arrival"))


DEV = """dv AS (SELECT user_id % 16 AS recording_id, event_id, event_type, value, props, CASE WHEN event_id % 3 = 2 THEN (epoch_us(ts) // 1000) // 1000 * 1000 ELSE (epoch_us(ts) // 1000) END AS timestamp_ms FROM events)"""


@query("a9_device_split", f"""WITH {DEV} SELECT recording_id, timestamp_ms, 'ecg' AS kind, round(value * 1000, 6) AS v FROM (SELECT DISTINCT recording_id, timestamp_ms, value FROM dv WHERE event_type = 'click')
UNION ALL SELECT recording_id, timestamp_ms, 'hr', CAST(trunc(arg_max(value, event_id)) AS DOUBLE) FROM dv WHERE event_type = 'error' GROUP BY 1, 2
UNION ALL SELECT recording_id, timestamp_ms, 'rr', CAST(v AS DOUBLE) FROM (SELECT DISTINCT recording_id, timestamp_ms, trunc(value) AS v FROM dv WHERE event_type = 'signup')
UNION ALL SELECT recording_id, timestamp_ms, 'marker', CAST(json_extract(arg_max(props, event_id), '$.k') AS DOUBLE) FROM dv WHERE event_type = 'purchase' GROUP BY 1, 2""")
def _(spark, sf):
    t = tables.device_tables(device(spark, sf))
    k = ["recording_id", "timestamp_ms"]
    out = t["ecg"].select(*k, F.lit("ecg").alias("kind"), F.round("ecg", 6).alias("v"))
    for n in ("hr", "rr"):
        out = out.unionByName(t[n].select(*k, F.lit(n).alias("kind"), F.col(n).cast("double").alias("v")))
    m = F.get_json_object("marker", "$.k").cast("double")
    return out.unionByName(t["marker"].select(*k, F.lit("marker").alias("kind"), m.alias("v")))


@query("a10_csv_repair", """, l AS (SELECT doc_id, string_split(concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'early,' || lang ELSE lang END, CASE WHEN doc_id % 11 <> 0 THEN source END, text), ',') AS p FROM documents)
SELECT doc_id, p[1] AS a, p[2] AS b, array_to_string(p[3:], ',') AS c FROM l WHERE len(p) >= 3""".replace(", l AS", "WITH l AS", 1))
def _(spark, sf):
    """All rows, damaged ones too: an early comma moves the cells behind it, a missing
    cell is filled by the next, and lines that stay too short are rejected."""
    d = fx.table(spark, sf, "documents")
    lang = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("early,"), "lang")).otherwise(F.col("lang"))
    source = F.when(F.col("doc_id") % 11 != 0, F.col("source"))
    return tables.repair_lines(d.select("doc_id", F.concat_ws(",", lang, source, "text").alias("value")), ["a", "b", "c"])


@query("a11_epoch_units", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN (epoch_us(ts) // 1000) // 1000 * 1000 ELSE (epoch_us(ts) // 1000) END AS ms FROM events")
def _(spark, sf):
    from beatloom.functions.timeparse import epoch_any_unit

    e = fx.events_ms(spark, sf)
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("ts_ms") * 1_000_000).when(k == 1, F.col("ts_ms")).otherwise(F.floor(F.col("ts_ms") / 1000))
    return e.select("event_id", epoch_any_unit(raw.cast("long")).alias("ms"))


@query("a12_plausible_times", f"WITH {DEV} SELECT event_id, timestamp_ms FROM dv WHERE event_type <> 'view'")
def _(spark, sf):
    return tables.plausible_times(device(spark, sf), "time").select(F.col("arrival").alias("event_id"), "timestamp_ms")


@query("a13_scan_segments", "SELECT timestamp_ms, ecg FROM fx_samples WHERE segment_idx BETWEEN 1 AND 4", "fx_samples")
def _(spark, sf):
    return tables.scan_segments(fx.samples(spark, sf), 2, 3, ["timestamp_ms", "ecg"])


@query("a14_scan_time_and_ids", "SELECT peak_id, value FROM fx_beats WHERE timestamp_ms BETWEEN 1704067200000 + 60000 AND 1704067200000 + 240000 AND peak_id IN (SELECT ref_id FROM fx_refs)", "fx_beats", "fx_refs")
def _(spark, sf):
    b = tables.scan_times(fx.beats(spark, sf), fx.T0 + 60_000, fx.T0 + 240_000)
    return tables.scan_ids(b, fx.refs(spark, sf).withColumnRenamed("ref_id", "peak_id")).select("peak_id", "value")


@query("a15_file_ranges", "SELECT recording_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM fx_beats GROUP BY 1", "fx_beats")
def _(spark, sf):
    return tables.file_ranges(fx.beats(spark, sf), "recording_id")


@query("a15_edges_from_footers", "SELECT recording_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms FROM fx_beats GROUP BY 1", "fx_beats")
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    tables.write_table(fx.beats(spark, sf), path)
    return tables.edge_times(spark, path)


@query("a16_files_by_overlap", """, r AS (SELECT user_id, min((epoch_us(ts) // 1000)) AS a, max((epoch_us(ts) // 1000)) AS b FROM events GROUP BY 1)
SELECT user_id, greatest(a, 1704153600000) AS from_ms, least(b, 1704326400000) AS to_ms, least(b, 1704326400000) - greatest(a, 1704153600000) AS duration_ms FROM r WHERE b >= 1704153600000 AND a < 1704326400000""".replace(", r AS", "WITH r AS", 1))
def _(spark, sf):
    r = tables.file_ranges(fx.events_ms(spark, sf), "user_id", "ts_ms")
    return tables.overlapping_files(r, 1_704_153_600_000, 1_704_326_400_000).select("user_id", "from_ms", "to_ms", "duration_ms")


@query("a17_merge_append", """SELECT recording_id, timestamp_ms, CASE WHEN event_type IN ('click', 'view') THEN round(value, 1) ELSE value END AS hr FROM fx_beats""", "fx_beats")
def _(spark, sf):
    b = fx.beats(spark, sf).select("recording_id", "timestamp_ms", "event_type", F.col("value").alias("hr"))
    new = b.filter("event_type in ('click', 'view')").withColumn("hr", F.round("hr", 1))
    old = b.filter("event_type <> 'view'")
    return tables.merge_append(old, new, ["recording_id", "timestamp_ms"]).drop("event_type")


RECORD = """peak_id long, timestamp_ms long, segment_idx int, current_label string, p_artifact_ensemble double, disagreement double, composite_score double,
  rr_prev_ms double, rr_next_ms double, context_ecg array<double>, context_timestamps_ms array<long>, r_peak_index_in_context int"""


@query("a18_queue_records", """, c AS (SELECT b.recording_id, b.peak_id, b.timestamp_ms, b.segment_idx, s.p_tab, s.p_wave, l.label, rr_prev_ms, rr_next_ms
  FROM fx_rr b JOIN fx_scores s USING (peak_id) JOIN fx_labels l USING (peak_id) WHERE b.event_type = 'purchase' AND b.value > 100),
x AS (SELECT c.peak_id, list(s.ecg ORDER BY s.timestamp_ms) AS v, list(s.timestamp_ms ORDER BY s.timestamp_ms) AS t FROM c JOIN fx_samples s
  ON s.recording_id = c.recording_id AND s.segment_idx = c.segment_idx AND abs(s.timestamp_ms - c.timestamp_ms) <= 2500 GROUP BY c.peak_id)
SELECT peak_id, timestamp_ms, segment_idx, label AS current_label, round(0.5 * p_tab + 0.5 * p_wave, 6) AS p_artifact_ensemble, round(abs(p_tab - p_wave), 6) AS disagreement,
  0.0::DOUBLE AS composite_score, CAST(rr_prev_ms AS DOUBLE) AS rr_prev_ms, CAST(rr_next_ms AS DOUBLE) AS rr_next_ms, v AS context_ecg, t AS context_timestamps_ms,
  CAST(list_position(list_transform(t, lambda z: abs(z - timestamp_ms)), list_min(list_transform(t, lambda z: abs(z - timestamp_ms)))) - 1 AS INT) AS r_peak_index_in_context
FROM c JOIN x USING (peak_id)""", "fx_rr", "fx_scores", "fx_labels", "fx_samples")
def _(spark, sf):
    """Assembled, written as JSON with a CSV summary, and read back."""
    cand = fx.scores(spark, sf).select("recording_id", "peak_id", (0.5 * F.col("p_tab") + 0.5 * F.col("p_wave")).alias("p_artifact_ensemble"), F.abs(F.col("p_tab") - F.col("p_wave")).alias("disagreement"))
    few = fx.beats(spark, sf).filter("event_type = 'purchase' and value > 100").select("recording_id", "peak_id")
    beats = fx.beats(spark, sf)
    near = over_rows(beats, 1, 1, windows.rr_stage).select("recording_id", "peak_id", "rr_prev_ms", "rr_next_ms")
    labels = fx.labels(spark, sf).select("recording_id", "peak_id", "label").join(near, ["recording_id", "peak_id"])
    index = sampleindex.sample_index(fx.samples(spark, sf), ["ecg", "segment_idx"])
    records = queues.queue_records(cand.join(few, ["recording_id", "peak_id"], "left_semi"), beats, labels, index)
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    tables.export_queue(materialise(records.drop("recording_id")), path)
    return spark.read.schema(RECORD).json(f"{path}/records")


@query("a19_check_completed", """SELECT count(*) FILTER (event_type = 'view') AS unknown_ids, count(*) FILTER (event_type = 'click') AS unknown_labels, 0::BIGINT AS duplicates FROM events""")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("event_id").alias("peak_id"), "event_type")
    done = e.withColumn("label", F.when(F.col("event_type") == "click", "odd").otherwise("clean"))
    return tables.check_completed(done, e.filter("event_type <> 'view'")).withColumn("duplicates", F.col("duplicates").cast("bigint"))


@query("a20_required_columns", "SELECT peak_id, p_tab FROM fx_scores", "fx_scores")
def _(spark, sf):
    return tables.required(fx.scores(spark, sf), ["peak_id", "p_tab"])


@query("a21_reviewed_queue", "SELECT r.ref_id AS peak_id, b.timestamp_ms FROM fx_refs r JOIN fx_beats b ON b.peak_id = r.ref_id WHERE b.value > 50 ORDER BY b.timestamp_ms", "fx_beats", "fx_refs")
def _(spark, sf):
    done = fx.refs(spark, sf).select(F.col("recording_id").alias("queue"), F.col("ref_id").alias("peak_id"))
    rec = fx.beats(spark, sf).filter("value > 50").select(F.col("recording_id").alias("queue"), "peak_id", "timestamp_ms")
    return tables.reviewed_queue(done, rec).select("peak_id", "timestamp_ms")


# ---- models ----------------------------------------------------------------

FEAT = ["rr_prev_ms", "rr_next_ms", "value"]


def training(spark, sf):
    b = fx.beats(spark, sf).select("peak_id", "value")
    d = windows.rr_intervals(fx.labels(spark, sf)).join(b, "peak_id")
    d = d.withColumn("truth", (F.col("label") == "artifact").cast("double"))
    d = windows.temporal_split(d, ON)
    return models.impute(d, aggregates.column_medians(d.filter("is_train and reviewed"), FEAT), FEAT)


@query("m1_median_imputation", """, t AS (SELECT quantile_cont(rr_prev_ms, 0.5) AS m FROM fx_rr) SELECT peak_id, coalesce(CAST(rr_prev_ms AS DOUBLE), m, 0.0) AS rr_prev_ms FROM fx_rr, t""", "fx_rr")
def _(spark, sf):
    d = windows.rr_intervals(fx.beats(spark, sf))
    return models.impute(d, aggregates.column_medians(d, ["rr_prev_ms"]), ["rr_prev_ms"]).select("peak_id", "rr_prev_ms")


def seg_table(spark, sf):
    rr_ = windows.rr_intervals(fx.beats(spark, sf))
    f = rr_.groupBy(*ON).agg(F.avg("rr_prev_ms").alias("m"), F.coalesce(F.stddev_samp("rr_prev_ms"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    return f.join(fx.segment_quality(spark, sf), ON).fillna(0.0)


@query("m2_m3_segment_quality")
def _(spark, sf):
    d = seg_table(spark, sf)
    m = models.train_segment_quality(d, ["m", "s", "n"], "quality_label", CODES)
    return models.predict_segment_quality(m, d.drop("quality_label"), ON, CODES)


@query("m4_m5_beat_classifier")
def _(spark, sf):
    d = training(spark, sf)
    m = models.train_beats(d.filter("reviewed"), FEAT, "truth", "is_train", 4.0)
    return models.predict_beats(m, d, ["peak_id"], "p_artifact_tabular")


@query("f5_top_features")
def _(spark, sf):
    d = training(spark, sf)
    m = models.train_beats(d.filter("reviewed"), FEAT, "truth", "is_train", 4.0)
    return spark.createDataFrame(models.top_features(m, FEAT, 2), "feature string, gain double")


@query("m9_stacking")
def _(spark, sf):
    s = fx.scores(spark, sf).withColumn("truth", F.col("truth").cast("double"))
    m = models.train_stacking(s.filter("reviewed"), "truth")
    return models.predict_beats(m, models.with_disagreement(s), ["peak_id"], "p_meta")


@query("m10_waveform_classifier")
def _(spark, sf):
    w = fx.waveforms(spark, sf).withColumn("truth", (F.col("label") == "artifact").cast("double"))
    d = models.waveform_vector(w, "waveform")
    m = models.train_waveform_classifier(d, "truth", 64)
    return models.predict_beats(m, d, ["peak_id"], "p_artifact_wave")


@query("m11_qrs_motifs")
def _(spark, sf):
    w = windows.rr_intervals(fx.waveforms(spark, sf))
    return models.qrs_motifs(w).select("idx", "label", "n_beats")


def vectors(spark, sf):
    d = windows.rr_intervals(fx.beats(spark, sf)).withColumn("rr_ms", F.coalesce("rr_prev_ms", F.lit(600)).cast("double"))
    return windows.rr_vectors(d)


@query("m12_rr_motifs")
def _(spark, sf):
    return models.rr_motifs(vectors(spark, sf)).select("idx", "label", "n_beats")


@query("m13_motif_features")
def _(spark, sf):
    w = windows.rr_intervals(fx.waveforms(spark, sf))
    mot = models.qrs_motifs(w.filter("label = 'clean'"))
    from beatloom.functions import arrays as A

    out = waveforms.nearest_centroid(w, mot, A.zscore(F.col("waveform")), "qrs")
    return waveforms.anomaly(out, "dist_to_nearest_qrs_motif", "qrs").select("peak_id", "nearest_qrs_motif_idx", "nearest_qrs_motif_label", "qrs_anomaly_score", "is_qrs_anomaly")


CATEGORY_FEATURES = ["window_iqr", "window_zcr", "r_peak_snr", "window_hf_noise_rms", "window_wander_slope"]


def category_model(spark, sf):
    """All beats, and the tree of the reviewed ones with its categories."""
    w = waveforms.signal_quality(fx.waveforms(spark, sf)).withColumn("truth", ((F.col("label") == "artifact") | F.col("hard_filtered")).cast("int"))
    w = materialise(w)
    tree = categorytree.fit(w.filter("segment_idx % 3 <> 0"), CATEGORY_FEATURES, "truth", min_leaf=20)
    return w, tree, models.categorise_leaves(categorytree.leaf_table(w, tree))


@query("m14_m16_categories")
def _(spark, sf):
    w, tree, leaves = category_model(spark, sf)
    return categorytree.apply(tree, leaves, w, ["peak_id"])


@query("m14_leaf_contract", """, r AS (SELECT CASE WHEN label = 'artifact' OR hard_filtered THEN 1 ELSE 0 END AS y FROM fx_waves WHERE segment_idx % 3 <> 0)
SELECT count(*) AS n_reviewed, count(*) FILTER (y = 0) AS n_clean, count(*) FILTER (y = 1) AS n_artifact, 0::BIGINT AS wrong_counts, 0::BIGINT AS wrong_purity, 0::BIGINT AS small_leaves FROM r""", "fx_waves")
def _(spark, sf):
    """Leaves hold the reviewed beats, each once, and say their counts and purity."""
    w, tree, leaves = category_model(spark, sf)
    got = categorytree.apply(tree, leaves, w.filter("segment_idx % 3 <> 0"), ["truth"])
    n = got.groupBy("leaf_id").agg(F.count_if(F.col("truth") == 0).alias("_c"), F.count_if(F.col("truth") == 1).alias("_a"), F.max("category_confidence").alias("_p"))
    j = leaves.join(n, leaves["leaf"] == n["leaf_id"], "left").fillna(0, ["_c", "_a"])
    purity = F.greatest("_c", "_a") / (F.col("_c") + F.col("_a"))
    return j.agg(
        F.sum(F.col("_c") + F.col("_a")).alias("n_reviewed"), F.sum("_c").alias("n_clean"), F.sum("_a").alias("n_artifact"),
        F.count_if((F.col("_c") != F.col("n_clean")) | (F.col("_a") != F.col("n_artifact"))).alias("wrong_counts"),
        F.count_if(~F.coalesce(F.abs(purity - F.col("_p")) < 1e-12, F.lit(False))).alias("wrong_purity"),
        F.count_if(F.col("_c") + F.col("_a") < 20).alias("small_leaves"),
    )


@query("m19_leaf_paths")
def _(spark, sf):
    return category_model(spark, sf)[2].select("leaf", "tree_path", "n_clean", "n_artifact", "category")


@query("h11_path_conditions", "SELECT count(*) AS beats, 0::BIGINT AS outside_their_path FROM fx_waves", "fx_waves")
def _(spark, sf):
    """The text of a leaf's path, read as a condition, holds for its beats."""
    w, tree, _ = category_model(spark, sf)
    exact = F.lit(True)
    holds = []
    for i, (path, _) in enumerate(categorytree.leaves(tree)):
        tests = [F.expr(f"coalesce({f} > {t!r}D, false)" if op == ">" else f"not coalesce({f} > {t!r}D, false)") for f, op, t in path]
        holds.append((categorytree.leaf_id(tree) != i) | reduce(lambda a, b: a & b, tests, exact))
    ok = reduce(lambda a, b: a & b, holds)
    return w.agg(F.count(F.lit(1)).alias("beats"), F.count_if(~ok).alias("outside_their_path"))


@query("m15_leaf_rules", """, l AS (SELECT segment_idx AS leaf, count(*) FILTER (label <> 'artifact') AS c, count(*) FILTER (label = 'artifact') AS a FROM fx_waves GROUP BY 1)
SELECT leaf, CASE WHEN leaf % 2 = 0 AND c / (a + c) >= 0.95 THEN 'pristine' WHEN leaf % 2 = 0 AND c / (a + c) >= 0.9 THEN 'clean_normal' WHEN leaf % 2 = 1 AND c / (a + c) >= 0.8 THEN 'clean_low_amplitude' WHEN a / (a + c) >= 0.7 THEN 'artifact_general' ELSE 'uncertain' END AS category FROM l""", "fx_waves")
def _(spark, sf):
    w = fx.waveforms(spark, sf).groupBy(F.col("segment_idx").alias("leaf")).agg(
        F.count_if(F.col("label") != "artifact").alias("n_clean"), F.count_if(F.col("label") == "artifact").alias("n_artifact"))
    even = F.array(F.lit("global_corr_clean >"), F.lit("r_peak_snr >"))
    w = w.withColumn("splits", F.when(F.col("leaf") % 2 == 0, even).otherwise(F.array(F.lit("window_iqr <="))))
    return models.categorise_leaves(w).select("leaf", "category")


@query("m20_motif_store")
def _(spark, sf):
    from beatloom.session import checkpoint_dir
    import uuid

    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    models.save_motifs(models.rr_motifs(vectors(spark, sf)), path)
    return spark.read.parquet(path).select("idx", "label", "n_beats", "scale_mean", "scale_sd")


@query("l18_principal_axes")
def _(spark, sf):
    d = seg_table(spark, sf).withColumn("n", F.col("n").cast("double"))
    return models.principal_axes(d, ["m", "s", "n"])[0].select(*ON, "pc1", "pc2")


def contract(d, kinds):
    """One window of the same length per key, of a known kind, without nulls."""
    w = F.col("waveform")
    return d.select("peak_id", F.size(w).alias("n"), F.col("kind").isin(*kinds).alias("known"), F.forall(w, lambda x: x.isNotNull() & ~F.isnan(x)).alias("whole"))


@query("k14_augment_artifacts", "SELECT peak_id, len(waveform)::INT AS n, true AS known, true AS whole FROM fx_waves WHERE label = 'clean'", "fx_waves")
def _(spark, sf):
    return contract(models.augment_artifacts(fx.waveforms(spark, sf).filter("label = 'clean'"), run=1), models.ARTIFACT_KINDS)


@query("k15_augment_jitter", "SELECT peak_id, len(waveform)::INT AS n, true AS known, true AS whole FROM fx_waves", "fx_waves")
def _(spark, sf):
    return contract(models.augment_jitter(fx.waveforms(spark, sf), run=1), models.JITTER_KINDS)


@query("k16_corrupt", "SELECT peak_id, len(waveform)::INT AS n, true AS known, true AS whole FROM fx_waves", "fx_waves")
def _(spark, sf):
    return contract(models.corrupt(fx.waveforms(spark, sf), run=1), models.CORRUPTION_KINDS)


# ---- incremental forms -----------------------------------------------------


@query("p1_window_metrics", """SELECT recording_id, timestamp_ms // 60000 * 60000 AS window_start_ms, count(*) AS count, round(avg(rr_prev_ms), 6) AS mean_rr, round(stddev_samp(rr_prev_ms), 6) AS sdnn, CAST(min(rr_prev_ms) AS DOUBLE) AS min_rr, CAST(max(rr_prev_ms) AS DOUBLE) AS max_rr
FROM fx_rr WHERE rr_prev_ms IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60""", "fx_rr")
def _(spark, sf):
    out = live.window_metrics(rr(spark, sf), "1 minute", 60)
    return out.select("recording_id", "window_start_ms", "count", *r6("mean_rr", "sdnn"), "min_rr", "max_rr")


@query("p1_anchored_increments", f""", {hrv_q.WIN} SELECT {hrv_q.KEYS}, count(*) AS count, round(avg(rr), 6) AS mean_rr, round(stddev_samp(rr), 6) AS sdnn, round(sqrt(avg(d * d)), 6) AS rmssd,
  round(avg((rr + p1 - m1 - m2) / 4) FILTER (d > 0 AND i >= 5 AND i + 5 < n), 6) AS dc FROM wn GROUP BY ALL""", "fx_long_rr")
def _(spark, sf):
    """The recordings arrive in four batches; a late copy of old rows changes nothing."""
    w = anchored.AnchoredWindows(spark, f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}")
    d = hrv_q.rr(spark, sf).select("recording_id", "timestamp_ms", "rr_ms", (F.col("rr_idx") % 7 == 0).alias("late"))
    d = materialise(d)
    at = F.lit(fx.T0) + F.lit(6 * 3_600_000)
    w.write(d.filter(F.col("timestamp_ms") < at), 0)
    w.write(d.filter(F.col("timestamp_ms").between(at, at + 12 * 3_600_000)), 1)
    w.write(d.filter("late").withColumn("rr_ms", F.lit(1.0)).filter(F.col("timestamp_ms") <= at + 12 * 3_600_000), 2)
    w.write(d.filter(F.col("timestamp_ms") > at + 12 * 3_600_000), 3)
    return w.metrics().select(*hrv_q.K, "count", *r6("mean_rr", "sdnn", "rmssd", "dc"))


@query("p2_live_sessions", """, b AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w <= 1000 THEN 0 ELSE 1 END AS e FROM fx_beats WINDOW w AS (PARTITION BY recording_id ORDER BY beat_idx)),
s AS (SELECT *, sum(e) OVER (PARTITION BY recording_id ORDER BY beat_idx) AS g FROM b) SELECT recording_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(*) AS n_beats FROM s GROUP BY recording_id, g""", "fx_beats")
def _(spark, sf):
    return live.live_sessions(fx.beats(spark, sf).select("recording_id", "timestamp_ms"), 1000)


@query("p2_bucketed_sessions", """, b AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w <= 1000 THEN 0 ELSE 1 END AS e FROM fx_beats WINDOW w AS (PARTITION BY recording_id ORDER BY beat_idx)),
s AS (SELECT *, sum(e) OVER (PARTITION BY recording_id ORDER BY beat_idx) AS g FROM b) SELECT recording_id, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms, count(*) AS n_beats FROM s GROUP BY recording_id, g""", "fx_beats")
def _(spark, sf):
    # buckets of a minute: most sessions cross their borders
    parts = live.partial_sessions(fx.beats(spark, sf).select("recording_id", "timestamp_ms"), 1000, 60_000)
    return live.merge_sessions(parts, 1000)


@query("e29_resume_after_last", """, d AS (SELECT recording_id, timestamp_ms // 60000 * 60000 AS w, count(*) AS n FROM fx_beats GROUP BY ALL), m AS (SELECT recording_id, max(timestamp_ms // 60000 * 60000) AS last FROM fx_beats WHERE event_type = 'purchase' AND value > 200 GROUP BY 1)
SELECT d.recording_id, w AS window_start_ms, n FROM d LEFT JOIN m USING (recording_id) WHERE last IS NULL OR w > last""", "fx_beats")
def _(spark, sf):
    w = (F.floor(F.col("timestamp_ms") / 60_000) * 60_000).alias("window_start_ms")
    b = fx.beats(spark, sf)
    done = b.filter("event_type = 'purchase' and value > 200").select("recording_id", w)
    return intervals.resume_after(b.groupBy("recording_id", w).agg(F.count(F.lit(1)).alias("n")), done, "window_start_ms")


# ---- round trips: written to the shared folder, read by the source operator ----


def _fresh(spark) -> str:
    import uuid

    from beatloom.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query("a1_scan_signal_csv", "SELECT timestamp_ms, ecg * 1000 AS ecg FROM fx_samples", "fx_samples")
def _(spark, sf):
    path = _fresh(spark)
    fx.samples(spark, sf).select(F.col("timestamp_ms").alias("DateTime"), F.col("ecg").alias("ECG")).write.csv(path, header=True)
    return tables.read_signal_csv(spark, path).select("timestamp_ms", "ecg")


@query("a5_scan_annotations", """SELECT recording_id, 'artifact' AS kind, timestamp_ms AS start_ms, timestamp_ms AS end_ms FROM fx_beats WHERE peak_id % 50 IN (3, 4)
UNION ALL SELECT recording_id, 'event', timestamp_ms, timestamp_ms + CASE WHEN peak_id % 50 = 2 THEN 500 ELSE 0 END FROM fx_beats WHERE peak_id % 50 < 3
UNION ALL SELECT recording_id, 'revisit', segment_idx, segment_idx FROM (SELECT DISTINCT recording_id, segment_idx FROM fx_beats WHERE peak_id % 50 = 5)""", "fx_beats")
def _(spark, sf):
    """One document per recording and day, with times as numbers, as text and as
    objects: a document is read whole, so it must not grow with the recording."""
    from beatloom.operators import labelling

    path = _fresh(spark)
    b, k, ms = fx.beats(spark, sf), F.col("peak_id") % 50, F.col("timestamp_ms")
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    event = F.when(k == 0, ms.cast("string")).when(k == 1, F.concat(F.lit('"'), iso, F.lit('"')))
    event = event.otherwise(F.concat(F.lit('{"start_time": "'), iso, F.lit('", "end_time": '), ms + 500, F.lit("}")))
    time = F.when(k == 3, ms.cast("string")).otherwise(F.concat(F.lit('"'), iso, F.lit('"')))
    revisit = F.concat(F.lit('{"segment_idx": '), F.col("segment_idx"), F.lit(', "marked_at": "x"}'))
    part = F.floor(F.col("segment_idx") / 1440).cast("int").alias("part")
    lists = b.groupBy("recording_id", part).agg(
        F.array_join(F.collect_list(F.when(k.isin(3, 4), time)), ",").alias("a"), F.array_join(F.collect_list(F.when(k < 3, event)), ",").alias("e"),
        F.array_join(F.collect_set(F.when(k == 5, revisit)), ",").alias("r"),
    )
    text = F.format_string('{"artifacts": [%s], "tagged_physiological_events": [%s], "return_to_pile": [%s]}', "a", "e", "r")
    lists.select("recording_id", "part", text.alias("value")).write.partitionBy("recording_id", "part").text(path)
    docs = tables.read_annotations(spark, path)
    out = tables.times_of(docs, "artifacts").select("recording_id", F.lit("artifact").alias("kind"), F.col("ref_ms").alias("start_ms"), F.col("ref_ms").alias("end_ms"))
    out = out.unionByName(labelling.event_windows(docs).withColumn("kind", F.lit("event")))
    again = docs.select("recording_id", F.explode("return_to_pile").alias("r")).select("recording_id", F.lit("revisit").alias("kind"), F.col("r.segment_idx").cast("long").alias("start_ms"))
    return out.unionByName(again.withColumn("end_ms", F.col("start_ms"))).withColumn("recording_id", F.col("recording_id").cast("long"))


@query("a4_scan_peak_csv", "SELECT timestamp_ms, CASE WHEN event_type = 'click' THEN 'added' ELSE 'detected' END AS source, event_type = 'click' AS is_added_peak FROM fx_beats", "fx_beats")
def _(spark, sf):
    path = _fresh(spark)
    added = F.col("event_type") == "click"
    fx.beats(spark, sf).select(
        F.col("timestamp_ms").alias("peak_id"), F.when(added, "added").otherwise("detected").alias("source"), added.alias("is_added_peak")
    ).write.csv(path, header=True)
    return tables.read_peak_csv(spark, path).select("timestamp_ms", "source", "is_added_peak")


@query("a7_write_table", "SELECT recording_id, segment_idx, count(*) AS n, min(timestamp_ms) AS first_ms FROM fx_beats GROUP BY ALL", "fx_beats")
def _(spark, sf):
    path = _fresh(spark)
    tables.write_table(fx.beats(spark, sf), path)
    back = spark.read.parquet(path)
    out = back.groupBy("recording_id", "segment_idx").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("first_ms"))
    return out.withColumn("recording_id", F.col("recording_id").cast("bigint"))
