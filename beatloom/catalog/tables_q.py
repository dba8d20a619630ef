"""Column, join, set, top-k and upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.catalog.beats_q import SOFT, r6
from beatloom.operators import columns, constraints, relational, scores

ON = ["recording_id", "segment_idx"]
CODES = {"clean": 0, "noisy_ok": 1, "bad": 2}


def wide(spark, sf):
    """Beats with label, quality and hard filter (large intervals)."""
    lab = fx.labels(spark, sf).withColumn("hard_filtered", F.col("peak_id") % 211 == 0)
    return lab.join(fx.segment_quality(spark, sf), ON, "left")


WIDE = "wd AS (SELECT l.*, q.quality_label, l.peak_id % 211 = 0 AS hard_filtered FROM fx_labels l LEFT JOIN fx_segq q USING (recording_id, segment_idx))"


@query("b1_segment_bucket", """SELECT o_orderkey, CAST(floor(((epoch_us(o_orderdate) // 1000) - 694224000000) / 60000) AS INT) AS segment_idx FROM orders""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("ms", F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    return columns.segment_bucket(o, "ms", 694_224_000_000).select("o_orderkey", "segment_idx")


@query("b2_scale_and_flip", """SELECT recording_id, sample_idx, ecg * 1000 * CASE WHEN recording_id % 3 = 0 THEN -1 ELSE 1 END + 0.0 AS ecg FROM fx_samples""", "fx_samples")
def _(spark, sf):
    smp = fx.samples(spark, sf)
    flags = fx.beats(spark, sf).select("recording_id").distinct().withColumn("invert", F.col("recording_id") % 3 == 0)
    out = columns.scale_signal(smp, flags, ["recording_id"])
    return out.select("recording_id", "sample_idx", (F.col("ecg") + 0.0).alias("ecg"))


@query("b3_training_rows", f""", {WIDE} SELECT peak_id, label FROM wd WHERE NOT (quality_label = 'bad' AND label <> 'artifact')
  AND NOT in_bad_region AND label <> 'interpolated' AND (reviewed OR label = 'artifact')""", "fx_labels", "fx_segq")
def _(spark, sf):
    return columns.training_rows(wide(spark, sf)).select("peak_id", "label")


@query("b4_training_without_hard_filtered", f""", {WIDE} SELECT peak_id, label FROM wd WHERE NOT (quality_label = 'bad' AND label <> 'artifact')
  AND NOT in_bad_region AND label <> 'interpolated' AND (reviewed OR label = 'artifact') AND NOT hard_filtered""", "fx_labels", "fx_segq")
def _(spark, sf):
    return columns.training_rows(wide(spark, sf), drop_hard_filtered=True).select("peak_id", "label")


@query("b18_strict_training_rows", f""", {WIDE} SELECT peak_id, label FROM wd WHERE quality_label <> 'bad'
  AND NOT in_bad_region AND label <> 'interpolated' AND reviewed""", "fx_labels", "fx_segq")
def _(spark, sf):
    return columns.training_rows(wide(spark, sf), drop_whole_bad_segments=True, drop_unreviewed_artifacts=True).select("peak_id", "label")


@query("b5_feature_columns", """SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey, l_partkey, l_suppkey FROM lineitem""")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey"))
    return li.select(*columns.feature_columns(li))


@query("b6_patch_columns", """, nw AS (SELECT peak_id, 1 AS f1, CAST(floor(value) AS INT) AS f2 FROM fx_beats WHERE event_type = 'click')
SELECT b.peak_id, b.segment_idx, coalesce(nw.f1, 0) AS f1, coalesce(nw.f2, 0) AS f2 FROM fx_beats b LEFT JOIN nw USING (peak_id)""", "fx_beats")
def _(spark, sf):
    b = fx.beats(spark, sf)
    old = b.select("peak_id", "segment_idx", F.lit(7).alias("f1"), F.lit(8).alias("f2"))
    new = b.filter("event_type = 'click'").select("peak_id", F.lit(1).alias("f1"), F.floor("value").cast("int").alias("f2"))
    return columns.patch_columns(old, new, ["peak_id"], ["f1", "f2"])


@query("b7_backfill_quality", """SELECT b.peak_id, b.value, q.quality_label FROM fx_beats b LEFT JOIN fx_segq q USING (recording_id, segment_idx)""", "fx_beats", "fx_segq")
def _(spark, sf):
    b = fx.beats(spark, sf)
    out = columns.backfill(b.select("peak_id", "value"), b, fx.segment_quality(spark, sf), "peak_id", ON, "quality_label")
    return out.select("peak_id", "value", "quality_label")


@query("b7_duplicate_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(spark, sf):
    return columns.duplicate_keys(fx.table(spark, sf, "orders"), ["o_custkey"])


@query("b10_round_metrics", """SELECT vec_id, round(x, 1) AS sdnn, round(y, 2) AS rmssd, round(z, 0) AS ulf, round(x * y, 3) AS perm_en FROM
 (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    d = e.select("vec_id", x.alias("sdnn"), y.alias("rmssd"), (z * 100).alias("ulf"), (x * y).alias("perm_en"))
    return columns.round_metrics(d, ["sdnn", "rmssd", "ulf", "perm_en"])


@query("b11_one_hot_category", """, c AS (SELECT peak_id, event_type AS category FROM fx_beats WHERE event_type <> 'view')
SELECT b.peak_id, """ + ", ".join(f"CASE WHEN category = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat_{v}" for v in ("click", "error", "purchase", "signup")) + """
FROM fx_beats b LEFT JOIN c USING (peak_id)""", "fx_beats")
def _(spark, sf):
    b = fx.beats(spark, sf)
    cats = b.filter("event_type <> 'view'").select("peak_id", F.col("event_type").alias("category"))
    joined = b.select("peak_id").join(cats, "peak_id", "left")
    return columns.one_hot(joined, "category", "cat_", ("click", "error", "purchase", "signup")).drop("category")


@query("b12_one_hot_motifs", "SELECT vec_id AS peak_id, " + ", ".join(f"CASE WHEN label = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS motif_qrs_{k}" for k in range(10)) + " FROM embeddings")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("peak_id"), F.col("label").cast("string").alias("motif"))
    return columns.one_hot(e, "motif", "motif_qrs_", [str(k) for k in range(10)]).drop("motif")


@query("b13_vocabulary_codes", """SELECT recording_id, segment_idx, CASE quality_label WHEN 'clean' THEN 0 WHEN 'noisy_ok' THEN 1 ELSE 2 END AS code, quality_label AS decoded
FROM fx_segq WHERE quality_label IN ('clean', 'noisy_ok', 'bad')""", "fx_segq")
def _(spark, sf):
    d = columns.encode(fx.segment_quality(spark, sf), "quality_label", CODES, "code")
    return columns.decode(d, "code", CODES, "decoded").drop("quality_label")


@query("b14_bad_segment_mask", "SELECT peak_id FROM fx_beats ANTI JOIN (SELECT * FROM fx_segq WHERE quality_label IN ('bad', 'noisy_ok')) USING (recording_id, segment_idx)", "fx_beats", "fx_segq")
def _(spark, sf):
    return columns.without_bad_segments(fx.beats(spark, sf), fx.segment_quality(spark, sf), ON, include_noisy=True).select("peak_id")


@query("b15_score_ranges", "SELECT peak_id, p_tab, p_wave FROM fx_scores WHERE p_wave >= 0.8 AND p_tab < 0.4", "fx_scores")
def _(spark, sf):
    return columns.score_range(fx.scores(spark, sf), {"p_wave": 0.8}, {"p_tab": 0.4}).select("peak_id", "p_tab", "p_wave")


@query("b16_flags_to_int", f", {SOFT} SELECT peak_id, CAST(rr_suspicious_long AS INT) AS rr_suspicious_long, CAST(tachy AS INT) AS tachy_transition_candidate, 0 AS not_there, review_priority_score FROM pr", "fx_labels", "fx_rr")
def _(spark, sf):
    d = constraints.soft_features(fx.labels(spark, sf))
    flags = ["rr_suspicious_long", "tachy_transition_candidate", "not_there"]
    return columns.flags_to_int(d, flags, ["review_priority_score"]).select("peak_id", *flags, "review_priority_score")


@query("b17_oversample", """SELECT count(*) AS n, true AS near_share FROM fx_labels""", "fx_labels")
def _(spark, sf):
    """As many draws as rows; artifacts near their share of the summed weights."""
    d = fx.labels(spark, sf)
    drawn = columns.oversample(d, "label", {"artifact": 15.0, "clean": 1.0}, seed=42)
    hit = F.col("label") == "artifact"
    want = d.agg((F.count_if(hit) * 15.0 / (F.count_if(hit) * 15.0 + F.count_if(~hit))).alias("want"))
    got = drawn.agg(F.count(F.lit(1)).alias("n"), (F.count_if(hit) / F.count(F.lit(1))).alias("got"))
    return got.crossJoin(F.broadcast(want)).select("n", (F.abs(F.col("got") - F.col("want")) < 0.1).alias("near_share"))


@query("b17_class_weights", "SELECT peak_id, CASE WHEN label = 'artifact' THEN 15.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM fx_labels", "fx_labels")
def _(spark, sf):
    return columns.class_weights(fx.labels(spark, sf), "label", {"artifact": 15.0}).select("peak_id", "weight")


@query("b19_usable_columns", """, t AS (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE value END AS a, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE value END AS b, 1.0 AS c, value AS d FROM fx_beats),
s AS (SELECT unnest(['a', 'b', 'c', 'd']) AS "column", unnest([avg(CAST(a IS NULL AS INT)), avg(CAST(b IS NULL AS INT)), avg(CAST(c IS NULL AS INT)), avg(CAST(d IS NULL AS INT))]) AS null_share,
  unnest([count(DISTINCT a) > 1, count(DISTINCT b) > 1, count(DISTINCT c) > 1, count(DISTINCT d) > 1]) AS varies FROM t)
SELECT "column", round(null_share, 6) AS null_share, varies, null_share < 0.3 AND varies AS usable FROM s""", "fx_beats")
def _(spark, sf):
    v, e = F.col("value"), F.col("event_type")
    d = fx.beats(spark, sf).select(
        F.when(e != "click", v).alias("a"), F.when(~e.isin("click", "view"), v).alias("b"), F.lit(1.0).alias("c"), v.alias("d"))
    out = columns.usable_columns(d, ["a", "b", "c", "d"])
    return out.withColumn("null_share", F.round("null_share", 6))


# ---- equi joins ------------------------------------------------------------


@query("c1_inner_scores", """SELECT t.peak_id, t.p_tab, w.p_wave FROM fx_scores t JOIN (SELECT peak_id, p_wave FROM fx_scores WHERE label <> 'clean') w USING (peak_id)""", "fx_scores")
def _(spark, sf):
    s = fx.scores(spark, sf)
    out = s.select("peak_id", "p_tab").join(s.filter("label <> 'clean'").select("peak_id", "p_wave"), "peak_id")
    return scores.require_rows(out, "joined score table")


@query("c2_left_default", """, o AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(p, 0.0) AS o_totalprice FROM customer LEFT JOIN o ON c_custkey = o_custkey""".replace(", o AS", "WITH o AS", 1))
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    c = fx.table(spark, sf, "customer").select("c_custkey")
    return relational.left_default(c, o, ["c_custkey"], ["o_totalprice"], 0.0, "o_orderkey")


@query("c3_star_join", """SELECT b.peak_id, b.value, l.label, b.segment_idx, coalesce(q.quality_label, 'clean') AS quality_label FROM fx_beats b JOIN fx_labels l USING (peak_id)
LEFT JOIN (SELECT * FROM fx_segq WHERE quality_label <> 'noisy_ok') q ON q.recording_id = b.recording_id AND q.segment_idx = b.segment_idx""", "fx_labels", "fx_segq")
def _(spark, sf):
    b = fx.beats(spark, sf)
    q = fx.segment_quality(spark, sf).filter("quality_label <> 'noisy_ok'")
    out = relational.star_join(b.select("peak_id", "value"), fx.labels(spark, sf).select("peak_id", "label"), b, q.unionByName(q))
    return out.select("peak_id", "value", "label", "segment_idx", "quality_label")


@query("c4_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return fx.table(spark, sf, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("c5_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("c6_replace_rows", """, nw AS (SELECT peak_id, 'fixed' AS label FROM fx_labels WHERE label = 'artifact')
SELECT peak_id, label FROM fx_labels WHERE peak_id NOT IN (SELECT peak_id FROM nw) UNION ALL SELECT * FROM nw""", "fx_labels")
def _(spark, sf):
    lab = fx.labels(spark, sf).select("peak_id", "label")
    new = lab.filter("label = 'artifact'").withColumn("label", F.lit("fixed"))
    return relational.replace_rows(lab, new, ["peak_id"])


@query("c19_coverage_compare", """, a AS (SELECT DISTINCT peak_id FROM fx_scores WHERE p_tab >= 0.2), b AS (SELECT DISTINCT peak_id FROM fx_scores WHERE p_wave >= 0.3)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (peak_id)) AS "both", (SELECT count(*) FROM a ANTI JOIN b USING (peak_id)) AS only_old, (SELECT count(*) FROM b ANTI JOIN a USING (peak_id)) AS only_new""", "fx_scores")
def _(spark, sf):
    s = fx.scores(spark, sf)
    return relational.coverage(s.filter("p_tab >= 0.2"), s.filter("p_wave >= 0.3"), ["peak_id"])


@query("c20_windows_metrics_merge", """, w AS (SELECT recording_id, 1704067200000 + segment_idx * 60000 AS start_ms, count(*) AS n FROM fx_beats GROUP BY recording_id, segment_idx),
e AS (SELECT recording_id, 1704067200000 + segment_idx * 60000 AS start_ms, max(value) AS extra FROM fx_beats WHERE event_type = 'click' GROUP BY recording_id, segment_idx HAVING max(value) > 150)
SELECT w.*, e.extra FROM w LEFT JOIN e USING (recording_id, start_ms)""", "fx_beats")
def _(spark, sf):
    b = fx.beats(spark, sf).withColumn("start_ms", fx.T0 + F.col("segment_idx").cast("long") * 60_000)
    w = b.groupBy("recording_id", "start_ms").agg(F.count(F.lit(1)).alias("n"))
    e = b.filter("event_type = 'click'").groupBy("recording_id", "start_ms").agg(F.max("value").alias("extra")).filter("extra > 150")
    return w.join(e, ["recording_id", "start_ms"], "left")


@query("c21_apply_order", """, o AS (SELECT peak_id, row_number() OVER (ORDER BY value DESC, peak_id) AS position, value AS corr FROM fx_beats WHERE event_type = 'error'),
j AS (SELECT b.peak_id, b.timestamp_ms, o.position, o.corr FROM fx_beats b LEFT JOIN o USING (peak_id))
SELECT peak_id, corr, row_number() OVER (ORDER BY position NULLS LAST, CASE WHEN position IS NULL THEN timestamp_ms END, peak_id) AS out_pos FROM j""", "fx_beats")
def _(spark, sf):
    b = fx.beats(spark, sf)
    err = b.filter("event_type = 'error'").select("peak_id", F.col("value").alias("corr"))
    from beatloom.params import Series
    from beatloom.plans.ordered import RANGE, in_ranges, running

    # the external list: error beats by falling value, with its position
    err = in_ranges(err.withColumn("neg", -F.col("corr")), "neg", "peak_id")
    err = running(err, {"position": ("sum", F.lit(1).cast("long"))},
                  Series(key=(), ts="neg", tie="peak_id"), position=F.col(RANGE), width=1, order=("neg", "peak_id")).drop("neg", RANGE)
    return relational.apply_order(b.select("peak_id", "timestamp_ms"), err, "peak_id", "position").select("peak_id", "corr", "out_pos")


# ---- sort, top-k -----------------------------------------------------------


@query("f1_sorted_by_time", "SELECT recording_id, timestamp_ms, peak_id FROM fx_beats ORDER BY recording_id, timestamp_ms, peak_id", "fx_beats")
def _(spark, sf):
    return fx.beats(spark, sf).select("recording_id", "timestamp_ms", "peak_id").orderBy("recording_id", "timestamp_ms", "peak_id")


@query("f2_top_n", "SELECT peak_id, p_tab FROM fx_scores ORDER BY p_tab DESC, peak_id LIMIT 200", "fx_scores")
def _(spark, sf):
    return relational.top_n(fx.scores(spark, sf), "p_tab", 200).select("peak_id", "p_tab")


@query("f3_top_n_filtered", """, t AS (SELECT * FROM fx_scores ORDER BY p_tab DESC, peak_id LIMIT 300)
SELECT peak_id, p_tab FROM t WHERE label = 'clean' ORDER BY p_tab DESC, peak_id LIMIT 100""", "fx_scores")
def _(spark, sf):
    return relational.top_n_filtered(fx.scores(spark, sf), "p_tab", 100, 3, F.col("label") == "clean").select("peak_id", "p_tab")


def spot_categories() -> dict:
    ens = F.col("p_ensemble")
    out = {}
    for model, p in (("wave", F.col("p_wave")), ("tab", F.col("p_tab"))):
        out[f"{model}_unsure_artifact"] = (ens >= 0.5, F.round(F.abs(p - 0.5), 9), True)
        out[f"{model}_unsure_clean"] = (ens < 0.5, F.round(F.abs(p - 0.5), 9), True)
        out[f"{model}_high_but_clean"] = (ens < 0.5, p, False)
        out[f"{model}_low_but_artifact"] = (ens >= 0.5, p, True)
    return out


def _spot_sql() -> str:
    parts = []
    for m, p in (("wave", "p_wave"), ("tab", "p_tab")):
        for name, test, key in (
            ("unsure_artifact", ">=", f"round(abs({p} - 0.5), 9)"),
            ("unsure_clean", "<", f"round(abs({p} - 0.5), 9)"),
            ("high_but_clean", "<", f"-{p}"),
            ("low_but_artifact", ">=", p),
        ):
            parts.append(f"SELECT peak_id, '{m}_{name}' AS category, {key} AS k FROM en WHERE p_ensemble {test} 0.5")
    return """, en AS (SELECT *, 0.5 * p_tab + 0.5 * p_wave AS p_ensemble FROM fx_scores), u AS (""" + " UNION ALL ".join(parts) + """),
r AS (SELECT peak_id, category, CAST(row_number() OVER (PARTITION BY category ORDER BY k, peak_id) AS INT) AS rank FROM u) SELECT * FROM r WHERE rank <= 25"""


@query("f4_top_per_category", _spot_sql(), "fx_scores")
def _(spark, sf):
    d = fx.scores(spark, sf).withColumn("p_ensemble", 0.5 * F.col("p_tab") + 0.5 * F.col("p_wave"))
    return relational.top_n_per_category(d, spot_categories(), 25).select("peak_id", "category", "rank")


@query("f6_surprising_disagreements", """SELECT peak_id, round(abs(p_tab - 0.5), 6) AS confidence FROM fx_scores WHERE reviewed AND (p_tab >= 0.5) <> (truth = 1)
ORDER BY abs(p_tab - 0.5) DESC, peak_id LIMIT 100""", "fx_scores")
def _(spark, sf):
    s = fx.scores(spark, sf).filter(F.col("reviewed") & ((F.col("p_tab") >= 0.5) != (F.col("truth") == 1)))
    s = s.withColumn("confidence", F.abs(F.col("p_tab") - 0.5))
    return relational.top_n(s, "confidence", 100).select("peak_id", *r6("confidence"))


@query("f8_first_n", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def _(spark, sf):
    return fx.table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(1000).select("l_orderkey", "l_linenumber")


# ---- sets, dedup, upsert ---------------------------------------------------


@query("g1_union_with_origin", """SELECT recording_id, timestamp_ms, 'csv' AS origin FROM fx_beats UNION ALL SELECT recording_id, ref_ms, 'annotation' FROM fx_refs""", "fx_beats", "fx_refs")
def _(spark, sf):
    return relational.union_tagged({
        "csv": fx.beats(spark, sf).select("recording_id", "timestamp_ms"),
        "annotation": fx.refs(spark, sf).select("recording_id", F.col("ref_ms").alias("timestamp_ms"))})


@query("g5_distinct_times", "SELECT recording_id, timestamp_ms FROM fx_noisy UNION SELECT recording_id, ref_ms FROM fx_refs", "fx_noisy", "fx_refs")
def _(spark, sf):
    a = fx.noisy(spark, sf).select("recording_id", "timestamp_ms")
    return a.union(fx.refs(spark, sf).select("recording_id", "ref_ms")).distinct()


@query("g6_keep_first", "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return relational.latest(o, ["o_custkey", "o_orderstatus"], ["o_orderkey"], newest=False)


@query("g7_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.latest(o, ["o_custkey"], ["o_orderkey"])


@query("g8_last_session_wins", """, s AS (SELECT user_id % 16 AS recording_id, user_id, event_id, CASE WHEN event_type = 'view' THEN '__skip' ELSE event_type END AS label, CAST((epoch_us(ts) // 1000) // 86400000 AS BIGINT) AS session FROM events)
SELECT user_id, arg_max(label, struct_pack(s := session, e := event_id)) AS label, max(session) AS session FROM s WHERE NOT starts_with(label, '__') GROUP BY user_id""".replace(", s AS", "WITH s AS", 1))
def _(spark, sf):
    e = fx.events_ms(spark, sf).select(
        "user_id", "event_id", F.when(F.col("event_type") == "view", "__skip").otherwise(F.col("event_type")).alias("label"),
        F.floor(F.col("ts_ms") / 86_400_000).alias("session"))
    e = e.filter(~F.col("label").startswith("__"))
    return relational.latest(e, ["user_id"], ["session", "event_id"]).drop("event_id")


@query("g9_pool_union", """, u AS (SELECT peak_id, 'margin' AS tag, 1 AS r FROM fx_scores WHERE p_tab BETWEEN 0.3 AND 0.7 UNION ALL SELECT peak_id, 'committee', 2 FROM fx_scores WHERE abs(p_tab - p_wave) >= 0.3
  UNION ALL (SELECT peak_id, 'priority', 3 FROM fx_scores ORDER BY p_wave DESC, peak_id LIMIT 500))
SELECT peak_id, arg_min(tag, r) AS tag FROM u GROUP BY peak_id""", "fx_scores")
def _(spark, sf):
    s = fx.scores(spark, sf)
    pool = relational.union_tagged({
        "margin": s.filter("p_tab between 0.3 and 0.7").select("peak_id"),
        "committee": s.filter("abs(p_tab - p_wave) >= 0.3").select("peak_id"),
        "priority": relational.top_n(s, "p_wave", 500).select("peak_id")}, "tag")
    return relational.first_tag(pool, ["peak_id"], "tag", ["margin", "committee", "priority"])


@query("g10_segment_difference", """SELECT recording_id, segment_idx FROM fx_segq EXCEPT SELECT recording_id, segment_idx FROM fx_segq WHERE quality_label = 'bad'
EXCEPT SELECT recording_id, segment_idx FROM fx_labels WHERE in_bad_region""", "fx_segq", "fx_labels")
def _(spark, sf):
    q = fx.segment_quality(spark, sf)
    return relational.minus(q, q.filter("quality_label = 'bad'"), fx.labels(spark, sf).filter("in_bad_region"), key=ON)


@query("g12_metrics_upsert", """, o AS (SELECT recording_id, segment_idx, count(*) AS n FROM fx_beats GROUP BY ALL), w AS (SELECT recording_id, segment_idx, count(*) AS n FROM fx_beats WHERE event_type <> 'view' AND value > 20 GROUP BY ALL)
SELECT * FROM w UNION ALL SELECT * FROM o ANTI JOIN w USING (recording_id, segment_idx)""", "fx_beats")
def _(spark, sf):
    b = fx.beats(spark, sf)
    old = b.groupBy(*ON).agg(F.count(F.lit(1)).alias("n"))
    new = b.filter("event_type <> 'view' and value > 20").groupBy(*ON).agg(F.count(F.lit(1)).alias("n"))
    return relational.upsert(old, new, ON)


@query("g13_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.filter("l_returnflag = 'R'").select("l_partkey").intersect(li.filter("l_returnflag = 'A'").select("l_partkey"))


@query("g14_integrity_checks", """, l AS (SELECT * FROM fx_labels WHERE in_bad_region = false), s AS (SELECT DISTINCT recording_id, segment_idx FROM fx_beats WHERE event_type <> 'view' OR value > 30)
SELECT 'labels_without_peak' AS check_name, (SELECT count(*) FROM l ANTI JOIN fx_beats USING (peak_id)) AS violations
UNION ALL SELECT 'peaks_without_label', (SELECT count(*) FROM fx_beats ANTI JOIN l USING (peak_id))
UNION ALL SELECT 'segments_without_samples', (SELECT count(*) FROM s ANTI JOIN fx_samples USING (recording_id, segment_idx))
UNION ALL SELECT 'peak_segments_unknown', (SELECT count(*) FROM (SELECT DISTINCT recording_id, segment_idx FROM fx_beats) ANTI JOIN s USING (recording_id, segment_idx))
UNION ALL SELECT 'null_times', 0 UNION ALL SELECT 'null_labels', 0 UNION ALL SELECT 'duplicate_peak_ids', 0""", "fx_beats", "fx_labels", "fx_samples")
def _(spark, sf):
    b, lab = fx.beats(spark, sf), fx.labels(spark, sf).filter("not in_bad_region")
    seg = b.filter("event_type <> 'view' or value > 30").select(*ON).distinct()
    return relational.integrity_checks(b, lab, seg, fx.samples(spark, sf))
