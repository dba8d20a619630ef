"""Statistics, evaluation, score and active-learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.catalog.beats_q import SOFT, r6
from beatloom.operators import aggregates as ag
from beatloom.operators import constraints, evaluation, learning, scores, windows

ON = ["recording_id", "segment_idx"]


def seg_rr(spark, sf):
    """Mean interval and counts per segment: a small metrics table."""
    rr = windows.rr_intervals(fx.beats(spark, sf))
    return rr.groupBy(*ON).agg(
        F.sum("rr_prev_ms").alias("rr_sum"), F.count(F.lit(1)).alias("n"), F.max("rr_prev_ms").alias("rr_max"))


SEG_RR = "sr AS (SELECT recording_id, segment_idx, CAST(sum(rr_prev_ms) AS BIGINT) AS rr_sum, count(*) AS n, max(rr_prev_ms) AS rr_max FROM fx_rr GROUP BY ALL)"


@query("d1_segment_beat_stats", "SELECT recording_id, segment_idx, count(*) AS total_beats, count(*) FILTER (label = 'artifact') AS artifact_beats, count(*) FILTER (label = 'clean') AS clean_beats FROM fx_labels GROUP BY ALL", "fx_labels")
def _(spark, sf):
    return ag.segment_beat_stats(fx.labels(spark, sf))


@query("d2_segment_ranges", "SELECT recording_id, segment_idx, min(timestamp_ms) AS start_timestamp_ms, max(timestamp_ms) AS end_timestamp_ms FROM fx_samples GROUP BY ALL", "fx_samples")
def _(spark, sf):
    return ag.segment_ranges(fx.samples(spark, sf))


@query("d3_segment_rr_sd", "SELECT recording_id, segment_idx, round(coalesce(stddev_samp(rr_prev_ms), 0.0), 6) AS segment_rr_sd FROM fx_rr GROUP BY ALL", "fx_rr")
def _(spark, sf):
    return ag.segment_rr_sd(windows.rr_intervals(fx.beats(spark, sf))).withColumn("segment_rr_sd", F.round("segment_rr_sd", 6))


@query("d4_column_medians", "SELECT quantile_cont(rr_prev_ms, 0.5) AS rr_prev_ms, quantile_cont(rr_next_ms, 0.5) AS rr_next_ms, 0.0::DOUBLE AS none FROM fx_rr WHERE segment_idx % 3 <> 0", "fx_rr")
def _(spark, sf):
    rr = windows.rr_intervals(fx.labels(spark, sf)).filter("reviewed").withColumn("none", F.lit(None).cast("double"))
    return ag.column_medians(rr, ["rr_prev_ms", "rr_next_ms", "none"])


TPL = """own AS (SELECT segment_idx, pos, avg(x) AS m, count(*) AS n FROM fx_wave_pos WHERE label = 'clean' AND NOT hard_filtered GROUP BY ALL),
ol AS (SELECT segment_idx, max(n) AS n, list(m ORDER BY pos) AS t FROM own GROUP BY segment_idx),
al AS (SELECT list(m ORDER BY pos) AS t FROM (SELECT pos, avg(x) AS m FROM fx_wave_pos WHERE label = 'clean' AND NOT hard_filtered GROUP BY pos))"""


def round_array(name: str, digits: int = 6):
    return F.transform(name, lambda x: F.round(x, digits) + 0.0).alias(name)


def clean_wave():
    return (F.col("label") == "clean") & ~F.col("hard_filtered")


@query("d5_segment_templates", f""", {TPL} SELECT g.segment_idx, coalesce(n, 0) AS n_beats, list_transform(CASE WHEN coalesce(n, 0) >= 16 THEN ol.t ELSE al.t END, lambda x: round(x, 6) + 0.0) AS template
FROM (SELECT DISTINCT segment_idx FROM fx_waves) g LEFT JOIN ol USING (segment_idx) CROSS JOIN al""", "fx_wave_pos")
def _(spark, sf):
    t = ag.mean_template(fx.waveforms(spark, sf), ["segment_idx"], clean_wave(), min_beats=16)
    return t.select("segment_idx", "n_beats", round_array("template"))


@query("d6_global_template", f", {TPL} SELECT list_transform(t, lambda x: round(x, 6) + 0.0) AS template FROM al", "fx_wave_pos")
def _(spark, sf):
    return ag.template(fx.waveforms(spark, sf).filter(clean_wave()), ()).select(round_array("template"))


@query("d7_label_counts", """, c AS (SELECT segment_idx % 3 AS iter, label, count(*) AS n FROM fx_labels GROUP BY ALL)
SELECT iter, CAST(sum(n) AS BIGINT) AS n_total, CAST(to_json(map(list(label ORDER BY label), list(n ORDER BY label))) AS VARCHAR) AS counts FROM c GROUP BY iter""", "fx_labels")
def _(spark, sf):
    d = ag.label_counts(fx.labels(spark, sf).withColumn("iter", F.col("segment_idx") % 3), ["iter"])
    return d.select("iter", "n_total", F.to_json("counts").alias("counts"))


@query("d8_flag_summary", f""", {SOFT} SELECT count(*) AS n_beats, count(*) FILTER (rr_suspicious_long) AS n_rr_suspicious_long, count(*) FILTER (tachy) AS n_tachy_transition_candidate,
  count(*) FILTER (physio_implausible) AS n_physio_implausible, count(*) FILTER (review_priority_score <> 0) AS n_nonzero, round(avg(review_priority_score), 6) AS score_mean,
  max(review_priority_score) AS score_max, quantile_cont(review_priority_score, 0.5) AS score_p50, quantile_cont(review_priority_score, 0.95) AS score_p95,
  quantile_cont(review_priority_score, 0.99) AS score_p99 FROM pr""", "fx_labels", "fx_rr")
def _(spark, sf):
    d = constraints.soft_features(fx.labels(spark, sf))
    out = ag.flag_summary(d, ["rr_suspicious_long", "tachy_transition_candidate", "physio_implausible"], "review_priority_score")
    return out.withColumn("score_mean", F.round("score_mean", 6))


@query("d9_describe_metrics", f""", {SEG_RR}, u AS (SELECT 'rr_sum' AS metric, CAST(rr_sum AS DOUBLE) AS v FROM sr UNION ALL SELECT 'rr_max', rr_max FROM sr UNION ALL SELECT 'n', n FROM sr),
mo AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, v) AS k FROM u WHERE v IS NOT NULL GROUP BY metric, v)
SELECT metric, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, round(var_samp(v), 4) AS variance,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, max(mo.v) FILTER (k = 1) AS mode
FROM u JOIN mo USING (metric, v) GROUP BY metric""".replace("u JOIN mo USING (metric, v)", "(SELECT u.metric, u.v, k FROM u JOIN mo USING (metric, v)) mo"), "fx_rr")
def _(spark, sf):
    d = seg_rr(spark, sf).select(*[F.col(c).cast("double") for c in ("rr_sum", "rr_max", "n")])
    out = ag.describe_metrics(d, ["rr_sum", "rr_max", "n"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), "variance": F.round("variance", 4)})


def predicted(spark, sf):
    s = fx.scores(spark, sf)
    return s.withColumn("pred", F.when(F.col("p_tab") > 0.8, "artifact").when(F.col("p_wave") > 0.9, "phys_event").otherwise("clean"))


PRED = "pd AS (SELECT *, CASE WHEN p_tab > 0.8 THEN 'artifact' WHEN p_wave > 0.9 THEN 'phys_event' ELSE 'clean' END AS pred FROM fx_scores)"
CLASSES = ["clean", "artifact", "phys_event"]


@query("d10_confusion_matrix", f""", {PRED}, v AS (SELECT unnest(['clean', 'artifact', 'phys_event']) AS c)
SELECT a.c AS truth, b.c AS pred, (SELECT count(*) FROM pd WHERE label = a.c AND pred = b.c) AS n FROM v a, v b""", "fx_scores")
def _(spark, sf):
    return evaluation.confusion(predicted(spark, sf), "label", "pred", CLASSES)


@query("d11_class_report", f""", {PRED}, v AS (SELECT unnest(['clean', 'artifact', 'phys_event']) AS cls), k AS (SELECT * FROM pd WHERE label <> 'interpolated'),
c AS (SELECT cls, count(*) FILTER (label = cls AND pred = cls) AS tp, count(*) FILTER (pred = cls) AS np, count(*) FILTER (label = cls) AS support FROM v, k GROUP BY cls),
m AS (SELECT cls, support, tp / np AS p, tp / support AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM f""", "fx_scores")
def _(spark, sf):
    out = evaluation.class_report(predicted(spark, sf), "label", "pred", CLASSES)
    return out.select("cls", "support", *r6("precision", "recall", "f1", "macro_f1"))


@query("d12_threshold_metrics", """, c AS (SELECT count(*) FILTER (p_tab >= 0.6 AND truth = 1) AS tp, count(*) FILTER (p_tab >= 0.6 AND truth = 0) AS fp, count(*) FILTER (p_tab < 0.6 AND truth = 1) AS fn FROM fx_scores)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""", "fx_scores")
def _(spark, sf):
    out = evaluation.threshold_metrics(fx.scores(spark, sf), "p_tab", "truth", 0.6)
    return out.select("tp", "fp", "fn", *r6("precision", "recall", "f1"))


@query("d13_calibration", """, b AS (SELECT CAST(least(floor(p_tab * 0.8 * 10), 9) AS INT) AS bin, p_tab * 0.8 AS p, truth FROM fx_scores)
SELECT CAST(i AS INT) AS bin, round(coalesce(avg(p), 0), 6) AS predicted, round(coalesce(avg(truth), 0), 6) AS actual, count(p) AS n FROM range(10) r(i) LEFT JOIN b ON b.bin = i GROUP BY i""", "fx_scores")
def _(spark, sf):
    out = evaluation.calibration(fx.scores(spark, sf).withColumn("p", F.col("p_tab") * 0.8), "p", "truth")
    return out.select("bin", *r6("predicted", "actual"), "n")


def rr_labels(spark, sf):
    rr = windows.rr_intervals(fx.labels(spark, sf))
    return rr.filter("rr_prev_ms is not null").withColumn("rr", F.col("rr_prev_ms").cast("double"))


RRL = "rl AS (SELECT r.peak_id, l.label, CAST(r.rr_prev_ms AS DOUBLE) AS rr FROM fx_rr r JOIN fx_labels l USING (peak_id) WHERE rr_prev_ms IS NOT NULL)"


def _hist_sql(lo: float, hi: float, bins: int, clip: bool) -> str:
    v = "least(greatest(rr, a), b)" if clip else "rr"
    where = "" if clip else "WHERE rr BETWEEN a AND b"
    extra = "round(n / (s * w), 9) AS density" if clip else "round(n / m, 6) AS relative"
    return f""", {RRL}, e AS (SELECT quantile_cont(rr, {lo}) AS a, quantile_cont(rr, {hi}) AS b FROM rl),
h AS (SELECT label, CAST(least(floor(({v} - a) / ((b - a) / {bins})), {bins - 1}) AS INT) AS bin, max((b - a) / {bins}) AS w, count(*) AS n FROM rl, e {where} GROUP BY 1, 2),
t AS (SELECT *, max(n) OVER (PARTITION BY label) AS m, sum(n) OVER (PARTITION BY label) AS s FROM h) SELECT label, bin, n, {extra} FROM t"""


@query("d14_shared_histogram", _hist_sql(0.01, 0.99, 25, False), "fx_rr", "fx_labels")
def _(spark, sf):
    out = ag.shared_axis_histogram(rr_labels(spark, sf), "rr", "label", 25, 0.01, 0.99)
    return out.withColumn("relative", F.round("relative", 6))


@query("d15_density_histogram", _hist_sql(0.005, 0.995, 40, True), "fx_rr", "fx_labels")
def _(spark, sf):
    out = ag.shared_axis_histogram(rr_labels(spark, sf), "rr", "label", 40, 0.005, 0.995, clip=True)
    return out.withColumn("density", F.round("density", 9))


@query("d16_summary_statistics", f""", {RRL} SELECT label, count(*) AS n, round(avg(rr), 6) AS mean, round(stddev_pop(rr), 6) AS sd, min(rr) AS min, max(rr) AS max,
  round(quantile_cont(rr, 0.05), 6) AS p5, quantile_cont(rr, 0.25) AS p25, quantile_cont(rr, 0.5) AS p50, quantile_cont(rr, 0.75) AS p75, round(quantile_cont(rr, 0.95), 6) AS p95 FROM rl GROUP BY label""", "fx_rr", "fx_labels")
def _(spark, sf):
    out = ag.summary_statistics(rr_labels(spark, sf), "rr", ["label"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "p5", "p95")})


@query("d17_category_medians", """SELECT l_shipmode AS category, n, pct, m1 AS median_l_quantity, m2 AS median_l_extendedprice FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS pct, quantile_cont(l_quantity, 0.5) AS m1, round(quantile_cont(l_extendedprice, 0.5), 6) AS m2 FROM lineitem GROUP BY l_returnflag)""")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "category")
    out = ag.medians_and_shares(li, "category", ["l_quantity", "l_extendedprice"])
    return out.withColumns({"pct": F.round("pct", 6), "median_l_extendedprice": F.round("median_l_extendedprice", 6)})


@query("d18_crosstab", "SELECT quality_label, " + ", ".join(f"count(*) FILTER (label = '{v}') AS n_{v}" for v in ("clean", "artifact", "phys_event", "interpolated")) + " FROM fx_labels JOIN fx_segq USING (recording_id, segment_idx) GROUP BY quality_label", "fx_labels", "fx_segq")
def _(spark, sf):
    d = fx.labels(spark, sf).join(fx.segment_quality(spark, sf), ON)
    return ag.crosstab(d, "quality_label", "label", ["clean", "artifact", "phys_event", "interpolated"])


@query("d19_hour_by_weekday", "SELECT CAST(hour(ts) AS INT) AS hour, " + ", ".join(f"round(avg(value) FILTER (dayname(ts) = '{d}'), 6) AS {d.lower()}" for d in ag.WEEKDAYS) + " FROM events GROUP BY hour(ts)")
def _(spark, sf):
    return ag.hour_by_weekday(fx.events_ms(spark, sf), "ts_ms", "value").select("hour", *r6(*[d.lower() for d in ag.WEEKDAYS]))


@query("d20_daily_mean", "SELECT event_type, CAST((epoch_us(ts) // 1000) // 86400000 * 86400000 AS BIGINT) AS step_ms, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    return ag.resample(fx.events_ms(spark, sf), "ts_ms", 86_400_000, ["value"], ["event_type"]).withColumn("value", F.round("value", 6))


@query("d21_hourly_spine", """, sp AS (SELECT event_type, unnest(range(min(hour_ms), max(hour_ms) + 1, 3600000)) AS hour_ms FROM fx_hourly GROUP BY event_type)
SELECT sp.event_type, sp.hour_ms, round(v, 6) AS v FROM sp LEFT JOIN fx_hourly USING (event_type, hour_ms)""", "fx_hourly")
def _(spark, sf):
    return ag.resample_spine(fx.hourly(spark, sf), ["event_type"], "hour_ms", 3_600_000).withColumn("v", F.round("v", 6))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d22_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(NUM) for b in NUM[:i]))
def _(spark, sf):
    return ag.correlation_matrix(fx.table(spark, sf, "lineitem"), NUM).withColumn("r", F.round("r", 6))


@query("d23_relative_shares", "SELECT l_orderkey, l_linenumber, round(l_tax * 100.0 / (l_tax + l_discount + l_quantity), 6) AS l_tax_share, round(l_quantity * 100.0 / (l_tax + l_discount + l_quantity), 6) AS l_quantity_share FROM lineitem")
def _(spark, sf):
    out = ag.relative_shares(fx.table(spark, sf, "lineitem"), ["l_tax", "l_discount", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", *r6("l_tax_share", "l_quantity_share"))


@query("d24_event_calendar", """, e AS (SELECT e.*, b.recording_id, b.segment_idx FROM events e JOIN fx_beats b ON e.event_id = b.peak_id WHERE e.event_type = 'error'),
d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM e GROUP BY 1), m AS (SELECT date_trunc('month', d) AS m, sum(n) AS n FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM e) AS n_events, (SELECT count(*) FROM d) AS n_days, (SELECT max(n) FROM d) AS max_per_day,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY recording_id, segment_idx)) AS max_per_segment,
  (SELECT quantile_cont(n, 0.5)::DOUBLE FROM m) AS median_per_month, (SELECT CAST(max(n) AS BIGINT) FROM m) AS max_per_month""", "fx_beats")
def _(spark, sf):
    e = fx.events_ms(spark, sf).filter("event_type = 'error'").select(F.col("event_id").alias("peak_id"), "ts_ms")
    return ag.event_calendar(e.join(fx.beats(spark, sf).select("peak_id", *ON), "peak_id"), "ts_ms")


@query("d25_polarity_vote", """, t AS (SELECT recording_id, ecg, sample_idx // 10 AS r FROM fx_samples WHERE (sample_idx + 1) % 10 = 0),
w AS (SELECT recording_id, r // 13 AS w, count(*) AS n, arg_max(ecg, struct_pack(a := abs(ecg), b := -r)) AS dom FROM t GROUP BY 1, 2 HAVING count(*) = 13)
SELECT recording_id, count(*) AS n_windows, quantile_cont(dom, 0.5) AS dominant_median, count(*) >= 5 AND quantile_cont(dom, 0.5) < -2 AS invert FROM w GROUP BY recording_id""", "fx_samples")
def _(spark, sf):
    from beatloom.params import Series

    return ag.polarity_vote(fx.samples(spark, sf), threshold=-2.0, s=Series(idx="sample_idx"))


@query("d26_class_imbalance", "SELECT count(*) FILTER (truth = 1) AS n_pos, count(*) FILTER (truth = 0) AS n_neg, round(count(*) FILTER (truth = 0) / count(*) FILTER (truth = 1), 6) AS pos_weight FROM fx_scores", "fx_scores")
def _(spark, sf):
    return ag.class_imbalance(fx.scores(spark, sf)).withColumn("pos_weight", F.round("pos_weight", 6))


@query("d27_score_totals", "SELECT count(p_tab) AS n, min(p_tab) AS min, max(p_tab) AS max, round(avg(p_tab), 6) AS mean, round(sum(p_tab * p_tab), 6) AS sum_sq FROM fx_scores", "fx_scores")
def _(spark, sf):
    return ag.score_totals(fx.scores(spark, sf), "p_tab").withColumns({"mean": F.round("mean", 6), "sum_sq": F.round("sum_sq", 6)})


# ---- scores ----------------------------------------------------------------


@query("m6_uncertainty", "SELECT peak_id, round(1 - 2 * abs(p_tab - 0.5), 6) AS uncertainty FROM fx_scores", "fx_scores")
def _(spark, sf):
    return scores.uncertainty(fx.scores(spark, sf), "p_tab").select("peak_id", *r6("uncertainty"))


@query("m7_fuse", """SELECT peak_id, p_tab, p_wave, round(0.55 * p_tab + 0.45 * p_wave, 6) AS p_ensemble, round(abs(p_tab - p_wave), 6) AS disagreement,
  round(1 - 2 * abs(0.55 * p_tab + 0.45 * p_wave - 0.5), 6) AS uncertainty_ensemble, round(0.55 * p_tab + 0.45 * p_wave, 9) >= 0.6 AS predicted_artifact FROM fx_scores""", "fx_scores")
def _(spark, sf):
    s = fx.scores(spark, sf)
    out = scores.fuse(s, s.select("peak_id", "p_wave"), 0.55, 0.6 - 1e-12)
    return out.select("peak_id", "p_tab", "p_wave", *r6("p_ensemble", "disagreement", "uncertainty_ensemble"), "predicted_artifact")


def ap_sql(src: str, score: str, truth: str, group: str) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""pt AS (SELECT {g}{score} AS s, count(*) AS n, count(*) FILTER ({truth} = 1) AS pos FROM {src} GROUP BY {g}{score}),
cu AS (SELECT *, sum(n) OVER ({part}ORDER BY s DESC) AS cn, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(n) OVER ({part.strip()}) AS na, sum(pos) OVER ({part.strip()}) AS np FROM pt)"""


@query("m8_tune_alpha", f""", al AS (SELECT truth, a AS alpha, a * p_tab + (1.0::DOUBLE - a) * p_wave AS sc FROM fx_scores, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS a)),
{ap_sql('al', 'sc', 'truth', 'alpha')}, ap AS (SELECT alpha, round(sum(pos / np * (tp / cn)), 12) AS v FROM cu GROUP BY alpha)
SELECT alpha, round(v, 6) AS average_precision, alpha = (SELECT alpha FROM ap ORDER BY v DESC, alpha LIMIT 1) AS is_best FROM ap""", "fx_scores")
def _(spark, sf):
    return scores.tune_alpha(fx.scores(spark, sf), "truth").withColumn("average_precision", F.round("average_precision", 6))


@query("m17_rule_baseline", "SELECT peak_id, p_tab > 0.5 OR p_wave < 0.3 OR p_tab * p_wave > 0.4 AS rule_bad FROM fx_scores", "fx_scores")
def _(spark, sf):
    d = fx.scores(spark, sf).withColumn("entropy", F.col("p_tab") * F.col("p_wave"))
    return scores.rule_baseline(d, "p_tab", "p_wave", "entropy", 0.4).select("peak_id", "rule_bad")


@query("m18_tune_threshold", f""", gr AS (SELECT truth, t AS threshold, CASE WHEN p_tab > t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sc FROM fx_scores, (SELECT CAST(unnest(range(1, 71)) AS DOUBLE) / 71 AS t)),
{ap_sql('gr', 'sc', 'truth', 'threshold')}, ap AS (SELECT threshold, round(sum(pos / np * (tp / cn)), 12) AS v FROM cu GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(v, 6) AS average_precision, threshold = (SELECT threshold FROM ap ORDER BY v DESC, threshold LIMIT 1) AS is_best FROM ap""", "fx_scores")
def _(spark, sf):
    out = scores.tune_threshold(fx.scores(spark, sf), "p_tab", "truth", [i / 71 for i in range(1, 71)])
    return out.select(*r6("threshold", "average_precision"), "is_best")


# ---- evaluation ------------------------------------------------------------


@query("n1_average_precision", f", {ap_sql('fx_scores', 'p_tab', 'truth', 'recording_id')} SELECT recording_id, round(sum(pos / np * (tp / cn)), 6) AS average_precision FROM cu GROUP BY recording_id", "fx_scores")
def _(spark, sf):
    return evaluation.average_precision(fx.scores(spark, sf), "p_tab", "truth", ["recording_id"]).withColumn("average_precision", F.round("average_precision", 6))


@query("n2_roc_auc", f", {ap_sql('fx_scores', 'p_tab', 'truth', '')} SELECT round(sum((n - pos) * (tp - pos / 2)) / max(np * (na - np)), 6) AS roc_auc FROM cu", "fx_scores")
def _(spark, sf):
    return evaluation.roc_auc(fx.scores(spark, sf), "p_tab", "truth").withColumn("roc_auc", F.round("roc_auc", 6))


PRC = f"{ap_sql('fx_scores', 'p_tab', 'truth', '')}, pr AS (SELECT s, CAST(tp AS DOUBLE) / CAST(cn AS DOUBLE) AS p, CAST(tp AS DOUBLE) / CAST(np AS DOUBLE) AS r FROM cu), pf AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"


@query("n3_pr_curve", f", {PRC} SELECT s AS score, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM pf", "fx_scores")
def _(spark, sf):
    return evaluation.pr_curve(fx.scores(spark, sf), "p_tab", "truth").select("score", *r6("precision", "recall", "f1"))


@query("n3_operating_points", f""", {PRC} SELECT (SELECT s FROM pf ORDER BY f1 DESC, s LIMIT 1) AS best_f1_threshold, round((SELECT max(f1) FROM pf), 6) AS best_f1,
  coalesce((SELECT s FROM pf WHERE p >= 0.21 ORDER BY r DESC, s LIMIT 1), (SELECT max(s) FROM pf)) AS precision_threshold,
  coalesce((SELECT s FROM pf WHERE r >= 0.9 ORDER BY p DESC, s LIMIT 1), (SELECT min(s) FROM pf)) AS recall_threshold""", "fx_scores")
def _(spark, sf):
    out = evaluation.operating_points(fx.scores(spark, sf), "p_tab", "truth", 0.21, 0.9)
    return out.withColumn("best_f1", F.round("best_f1", 6))


@query("n4_model_comparison", """, j AS (SELECT p_tab AS o, p_wave AS n, reviewed FROM fx_scores) SELECT count(*) AS n_beats, round(avg((o >= 0.7)::INT), 6) AS old_share, round(avg((n >= 0.7)::INT), 6) AS new_share,
  round(avg(o), 6) AS old_mean, round(avg(n), 6) AS new_mean, round(avg(((o >= 0.7) = (n >= 0.7))::INT), 6) AS agreement, count(*) FILTER (o < 0.7 AND n >= 0.7) AS clean_to_artifact,
  count(*) FILTER (o >= 0.7 AND n < 0.7) AS artifact_to_clean, count(*) FILTER ((o >= 0.7) <> (n >= 0.7) AND reviewed) AS reviewed_flips,
  abs(avg((n >= 0.7)::INT) - avg((o >= 0.7)::INT)) > 0.05 AS shift_warning FROM j""", "fx_scores")
def _(spark, sf):
    s = fx.scores(spark, sf)
    old = s.select("peak_id", F.col("p_tab").alias("p"))
    new = s.select("peak_id", F.col("p_wave").alias("p"), "reviewed")
    out = evaluation.model_comparison(old, new, "p", 0.7)
    return out.withColumns({c: F.round(c, 6) for c in ("old_share", "new_share", "old_mean", "new_mean", "agreement")})


@query("n5_category_validation", f""", {PRED}, {ap_sql('(SELECT * FROM pd)', 'p_tab', 'truth', 'pred')} SELECT pred AS category, CAST(max(na) AS BIGINT) AS n, CAST(max(np) AS BIGINT) AS n_artifact,
  round(CASE WHEN max(np) > 0 AND max(np) < max(na) THEN sum(pos / np * (tp / cn)) END, 6) AS average_precision,
  round(CASE WHEN max(np) > 0 AND max(np) < max(na) THEN sum((n - pos) * (tp - pos / 2)) / max(np * (na - np)) END, 6) AS roc_auc FROM cu GROUP BY pred""", "fx_scores")
def _(spark, sf):
    d = predicted(spark, sf).withColumnRenamed("pred", "category")
    counts = d.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == 1).alias("n_artifact"))
    out = counts.join(evaluation.aucs(d, "p_tab", "truth", ["category"]), "category")
    return out.select("category", "n", "n_artifact", *r6("average_precision", "roc_auc"))


@query("n6_template_thresholds", """, e AS (SELECT quantile_cont(p_tab, 0.05) FILTER (label = 'clean') AS hi, quantile_cont(p_tab, 0.9) FILTER (label = 'artifact') AS lo FROM fx_scores)
SELECT round(hi, 6) AS clean_p5, round(lo, 6) AS artifact_p90, count(*) FILTER (label = 'clean' AND p_tab >= hi) AS clean_above, count(*) FILTER (label = 'artifact' AND p_tab >= hi) AS artifact_above,
  count(*) FILTER (label = 'clean' AND p_tab <= lo) AS clean_below, count(*) FILTER (label = 'artifact' AND p_tab <= lo) AS artifact_below,
  count(*) FILTER (label = 'clean' AND p_tab > lo AND p_tab < hi) AS clean_ambiguous, count(*) FILTER (label = 'artifact' AND p_tab > lo AND p_tab < hi) AS artifact_ambiguous,
  lo >= hi AS overlap FROM fx_scores, e GROUP BY hi, lo""", "fx_scores")
def _(spark, sf):
    out = evaluation.template_thresholds(fx.scores(spark, sf), "p_tab", "label")
    return out.withColumns({"clean_p5": F.round("clean_p5", 6), "artifact_p90": F.round("artifact_p90", 6)})


@query("n7_stage_comparison", """, b AS (SELECT recording_id, segment_idx, CASE WHEN (recording_id * 3 + segment_idx) % 4 = 0 THEN 'bad' ELSE 'clean' END AS quality_label FROM fx_segq)
SELECT recording_id, segment_idx, a.quality_label AS label_a, b.quality_label AS label_b, a.quality_label = b.quality_label AS agree, a.quality_label = 'bad' AND b.quality_label = 'bad' AS both_bad,
  (a.quality_label = 'bad') <> (b.quality_label = 'bad') AS one_bad FROM fx_segq a JOIN b USING (recording_id, segment_idx)""", "fx_segq")
def _(spark, sf):
    a = fx.segment_quality(spark, sf)
    bad = (F.col("recording_id") * 3 + F.col("segment_idx")) % 4 == 0
    return evaluation.stage_comparison(a, a.withColumn("quality_label", F.when(bad, "bad").otherwise("clean")), "quality_label", ON)


@query("n8_prevalence", "SELECT count(*) AS n, round(avg((p_tab >= 0.7)::INT), 6) AS prevalence FROM fx_scores", "fx_scores")
def _(spark, sf):
    return evaluation.prevalence(fx.scores(spark, sf), "p_tab", 0.7).withColumn("prevalence", F.round("prevalence", 6))


@query("n9_reviewed_with_segment_features", f""", {SEG_RR}, f AS (SELECT recording_id, segment_idx, CASE WHEN n > 20 THEN rr_max END AS rr_max FROM sr JOIN fx_segq USING (recording_id, segment_idx) WHERE quality_label <> 'bad'),
s AS (SELECT recording_id, segment_idx, row_number() OVER (PARTITION BY recording_id ORDER BY segment_idx) - 1 AS r, count(*) OVER (PARTITION BY recording_id) AS n FROM (SELECT DISTINCT recording_id, segment_idx FROM fx_labels WHERE reviewed)),
j AS (SELECT l.peak_id, r < greatest(1, floor(s.n * 800 / 1000)) AS is_train, f.rr_max FROM fx_labels l JOIN s USING (recording_id, segment_idx) LEFT JOIN f USING (recording_id, segment_idx) WHERE reviewed),
m AS (SELECT quantile_cont(rr_max, 0.5) AS m FROM j WHERE is_train) SELECT peak_id, is_train, coalesce(CAST(rr_max AS DOUBLE), m) AS rr_max FROM j, m""", "fx_rr", "fx_labels", "fx_segq")
def _(spark, sf):
    good = fx.segment_quality(spark, sf).filter("quality_label <> 'bad'")
    seg = seg_rr(spark, sf).join(good, ON)
    seg = seg.select(*ON, F.when(F.col("n") > 20, F.col("rr_max")).alias("rr_max"))
    d = windows.temporal_split(fx.labels(spark, sf).filter("reviewed"), ON).join(seg, ON, "left")
    med = ag.column_medians(d.filter("is_train"), ["rr_max"]).withColumnRenamed("rr_max", "_m")
    out = d.crossJoin(F.broadcast(med))
    return out.select("peak_id", "is_train", F.coalesce(F.col("rr_max").cast("double"), "_m").alias("rr_max"))


@query("n10_reviewed_aucs", f""", rv AS (SELECT * FROM fx_scores WHERE reviewed AND label IN ('clean', 'artifact')), {ap_sql('rv', 'p_wave', 'truth', 'recording_id')}
SELECT recording_id, round(CASE WHEN max(np) > 0 AND max(np) < max(na) THEN sum(pos / np * (tp / cn)) END, 6) AS average_precision,
  round(CASE WHEN max(np) > 0 AND max(np) < max(na) THEN sum((n - pos) * (tp - pos / 2)) / max(np * (na - np)) END, 6) AS roc_auc FROM cu GROUP BY recording_id""", "fx_scores")
def _(spark, sf):
    d = fx.scores(spark, sf).filter("reviewed and label in ('clean', 'artifact')")
    return evaluation.aucs(d, "p_wave", "truth", ["recording_id"]).select("recording_id", *r6("average_precision", "roc_auc"))


# ---- active learning -------------------------------------------------------

N_CAND = 400


def candidates_input(spark, sf):
    d = constraints.soft_features(fx.labels(spark, sf))
    s = fx.scores(spark, sf).select("peak_id", "p_tab", "p_wave")
    fused = scores.fuse(s.select("peak_id", "p_tab"), s.select("peak_id", "p_wave"))
    return d.select("peak_id", *ON, "reviewed", "review_priority_score", "pots_transition_candidate").join(fused, "peak_id")


CAND = f"""{SOFT}, ws AS (SELECT p.peak_id, p.recording_id, p.segment_idx, p.review_priority_score, p.pots_transition_candidate, q.quality_label, 0.5 * s.p_tab + 0.5 * s.p_wave AS pe, abs(s.p_tab - s.p_wave) AS dis
  FROM pr p JOIN fx_scores s USING (peak_id) LEFT JOIN fx_segq q ON q.recording_id = p.recording_id AND q.segment_idx = p.segment_idx WHERE NOT s.reviewed AND coalesce(q.quality_label, '') <> 'bad'),
tp AS (SELECT peak_id FROM ws ORDER BY review_priority_score DESC, peak_id LIMIT {N_CAND}),
po AS (SELECT *, CASE WHEN pe BETWEEN 0.3 AND 0.7 THEN 'margin' WHEN dis >= 0.3 THEN 'committee' WHEN peak_id IN (SELECT peak_id FROM tp) THEN 'priority' END AS selection_strategy FROM ws),
cs AS (SELECT *, (0.4::DOUBLE * (1 - 2.0::DOUBLE * abs(pe - 0.5)) + 0.4::DOUBLE * dis + 0.2::DOUBLE * (review_priority_score / (SELECT CASE WHEN max(review_priority_score) = 0 THEN 1 ELSE max(review_priority_score) END FROM po WHERE selection_strategy IS NOT NULL)))
   * CASE WHEN quality_label = 'noisy_ok' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN pots_transition_candidate THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS score FROM po WHERE selection_strategy IS NOT NULL)"""


@query("o1_select_candidates", f", {CAND} SELECT peak_id, selection_strategy, round(score, 6) AS composite_score FROM cs ORDER BY score DESC, peak_id LIMIT {N_CAND}", "fx_labels", "fx_rr", "fx_scores", "fx_segq")
def _(spark, sf):
    out = learning.select_candidates(candidates_input(spark, sf), fx.segment_quality(spark, sf), N_CAND)
    return out.select("peak_id", "selection_strategy", *r6("composite_score"))


@query("o2_composite_scores", f", {CAND} SELECT selection_strategy, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM cs GROUP BY ALL", "fx_labels", "fx_rr", "fx_scores", "fx_segq")
def _(spark, sf):
    pool = learning.candidate_pool(candidates_input(spark, sf), fx.segment_quality(spark, sf), N_CAND)
    top = pool.agg(F.max("review_priority_score").alias("_m"))
    d = pool.crossJoin(F.broadcast(top)).withColumn("c", learning.composite_score(F.col("_m")))
    return d.groupBy("selection_strategy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_score"), F.round(F.max("c"), 6).alias("max_score"))


UPD = """lb AS (SELECT *, CAST(segment_idx % 2 AS INT) AS al_iteration FROM fx_labels), rs AS (SELECT ref_id AS peak_id FROM fx_refs),
up AS (SELECT peak_id, CASE WHEN rs.peak_id IS NOT NULL THEN 'clean' ELSE label END AS label, reviewed OR rs.peak_id IS NOT NULL AS reviewed, CASE WHEN rs.peak_id IS NOT NULL THEN 7 ELSE al_iteration END AS al_iteration FROM lb LEFT JOIN rs USING (peak_id))"""


def updated(spark, sf):
    lab = fx.labels(spark, sf).withColumn("al_iteration", (F.col("segment_idx") % 2).cast("int"))
    res = fx.refs(spark, sf).select(F.col("ref_id").alias("peak_id"), F.lit("clean").alias("label"))
    return learning.record_labels(lab, res, 7)


@query("g11_label_upsert", f", {UPD} SELECT * FROM up", "fx_labels", "fx_refs")
def _(spark, sf):
    return updated(spark, sf).select("peak_id", "label", "reviewed", "al_iteration")


@query("o4_record_labels", f", {UPD} SELECT label, reviewed, count(*) AS n FROM up GROUP BY ALL", "fx_labels", "fx_refs")
def _(spark, sf):
    return updated(spark, sf).groupBy("label", "reviewed").agg(F.count(F.lit(1)).alias("n"))


@query("o5_iteration_summary", f""", {UPD}, c AS (SELECT al_iteration, label, count(*) AS n FROM up GROUP BY ALL), s AS (SELECT al_iteration, avg(p_tab) AS m FROM up JOIN fx_scores USING (peak_id) GROUP BY 1)
SELECT c.al_iteration, CAST(sum(n) AS BIGINT) AS n_total, CAST(to_json(map(list(c.label ORDER BY c.label), list(n ORDER BY c.label))) AS VARCHAR) AS counts, round(max(m), 6) AS mean_p_tab FROM c JOIN s USING (al_iteration) GROUP BY c.al_iteration""", "fx_labels", "fx_refs", "fx_scores")
def _(spark, sf):
    d = updated(spark, sf).join(fx.scores(spark, sf).select("peak_id", "p_tab"), "peak_id")
    out = learning.iteration_summary(d, ["p_tab"])
    return out.select("al_iteration", "n_total", F.to_json("counts").alias("counts"), F.round("mean_p_tab", 6).alias("mean_p_tab"))
