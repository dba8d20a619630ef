"""Time parsing, labelling, annotation and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.catalog.beats_q import r6
from beatloom.catalog.joins_q import REG, greedy_sql, regions
from beatloom.functions import timeparse as tp
from beatloom.operators import aggregates, events, labelling, windows

# Times as text in several shapes; the two engines spell them independently.
TEXT = """tx AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '999Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '+00:00'
  WHEN 2 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) || '.75' ELSE 'not a time' END AS t FROM events)"""


def texts(spark, sf):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    return fx.table(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("999Z")))
        .when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))
        .when(k == 2, F.concat(F.unix_millis(ts).cast("string"), F.lit(".75")))
        .otherwise("not a time").alias("t"))


@query("h1_iso_to_ms", f"WITH {TEXT} SELECT event_id, CASE WHEN event_id % 4 < 2 THEN ms END AS ms FROM tx")
def _(spark, sf):
    return texts(spark, sf).select("event_id", tp.iso_ms(F.col("t")).alias("ms"))


@query("h2_any_to_ms", f"WITH {TEXT} SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ms END AS ms FROM tx")
def _(spark, sf):
    return texts(spark, sf).select("event_id", tp.any_ms(F.col("t")).alias("ms"))


@query("h3_sorted_times", f"WITH {TEXT} SELECT event_id // 8 AS doc, list(ms ORDER BY ms) FILTER (event_id % 4 < 3) AS times FROM tx GROUP BY 1")
def _(spark, sf):
    d = texts(spark, sf).groupBy(F.floor(F.col("event_id") / 8).alias("doc")).agg(F.collect_list("t").alias("ts"))
    return d.select("doc", tp.sorted_times(F.col("ts")).alias("times"))


@query("h5_segment_number", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey AS INT) END AS n FROM orders")
def _(spark, sf):
    k = F.col("o_custkey").cast("string")
    t = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("part_"), k)).otherwise(F.concat(F.lit("seg_"), k))
    return fx.table(spark, sf, "orders").select("o_orderkey", tp.segment_number(t).alias("n"))


@query("h6_display_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS a, strftime(ts, '%d.%m.%y %I:%M %p') AS b FROM events")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return fx.events_ms(spark, sf).select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm").alias("a"), F.date_format(ts, "dd.MM.yy hh:mm a").alias("b"))


@query("h7_calendar_parts", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return fx.events_ms(spark, sf).select(
        "event_id", F.hour(ts).alias("hour"), F.date_format(ts, "EEEE").alias("day"), F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("week"))


# summer time of those years: first Sunday of April to last of October, both at 2 o'clock
@query("h8_local_to_utc", """WITH y AS (SELECT *, make_date(year(o_orderdate), 4, 1) AS m, make_date(year(o_orderdate), 10, 25) AS n FROM orders),
  s AS (SELECT *, o_orderdate >= m + (7 - dayofweek(m))::INT % 7 + INTERVAL 2 HOUR AND o_orderdate < n + (7 - dayofweek(n))::INT % 7 + INTERVAL 2 HOUR AS summer FROM y)
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE ((epoch_us(o_orderdate) // 1000) // 1000 + CASE WHEN summer THEN 4 ELSE 5 END * 3600) * 1000 END AS ms FROM s""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    t = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", tp.local_to_utc_ms(t, "America/New_York").alias("ms"))


@query("h9_math", """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, round(log2(l_quantity), 6) AS b, round(log10(l_extendedprice), 6) AS c, round(atan2(l_tax, l_quantity), 6) AS d,
  least(greatest(l_quantity, 10), 40) AS e, CAST(sign(l_discount - 0.05) AS INT) AS f, l_orderkey % 7 AS g FROM lineitem""")
def _(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt(q), 6).alias("a"), F.round(F.log2(q), 6).alias("b"), F.round(F.log10(p), 6).alias("c"),
        F.round(F.atan2("l_tax", "l_quantity"), 6).alias("d"), F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("e"),
        F.signum(F.col("l_discount") - 0.05).cast("int").alias("f"), (F.col("l_orderkey") % 7).alias("g"))


@query("h10_json_tags", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS tag FROM events UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT), 'seen' FROM events")
def _(spark, sf):
    tags = F.to_json(F.array(F.struct(F.col("event_type").alias("tag")), F.struct(F.lit("seen").alias("tag"))))
    e = fx.table(spark, sf, "events").withColumn("tags", tags)
    parsed = F.explode(F.from_json("tags", "array<struct<tag string>>"))
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), parsed.alias("t")).select("event_id", "k", "t.tag")


# ---- annotation documents: one per (recording, segment) --------------------


def iso(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def docs(spark, sf):
    seg = fx.beats(spark, sf).groupBy("recording_id", "segment_idx").agg(F.min("timestamp_ms").alias("a"), F.max("timestamp_ms").alias("b"))
    d = seg.join(fx.segment_quality(spark, sf), ["recording_id", "segment_idx"])
    ann = F.col("segment_idx") + 100
    name = F.concat(F.lit("seg_"), ann.cast("string"))
    return d.select(
        "recording_id",
        F.array(F.struct(ann.alias("segment_idx"), iso(F.col("a")).alias("first_timestamp"), iso(F.col("b")).alias("last_timestamp"))).alias("segment_timestamps"),
        F.when(F.col("quality_label") != "bad", F.array(name)).otherwise(F.array().cast("array<string>")).alias("validated_segments"),
        F.when(F.col("quality_label") == "bad", F.array(ann)).otherwise(F.array().cast("array<int>")).alias("bad_segments"),
        F.when(F.col("quality_label") == "noisy_ok", F.array(name)).otherwise(F.array().cast("array<string>")).alias("flagged_poor_quality_segments"),
        F.array(F.struct(ann.alias("segment_idx"), iso(F.col("a") + 1000).alias("start_time"), F.when(F.col("segment_idx") % 2 == 0, iso(F.col("a") + 9000)).alias("end_time"))).alias("bad_regions"),
        F.array(
            F.struct(iso(F.col("a")).alias("start"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("start_timestamp"), F.lit(None).cast("string").alias("end"), iso(F.col("b")).alias("end_time"), F.lit(None).cast("string").alias("end_timestamp"), F.lit(None).cast("string").alias("at")),
            F.struct(F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("start_timestamp"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("end_time"), F.lit(None).cast("string").alias("end_timestamp"), F.col("b").cast("string").alias("at")),
        ).alias("tagged_physiological_events"))


def starts(spark, sf):
    return fx.beats(spark, sf).select("recording_id").distinct().withColumn("start_ms", F.lit(fx.T0))


def mapping(spark, sf):
    return labelling.segment_translation(docs(spark, sf), starts(spark, sf))


SR = "sr AS (SELECT recording_id, segment_idx, min(timestamp_ms) AS a, max(timestamp_ms) AS b FROM fx_beats GROUP BY ALL)"


@query("a3_recording_start", "SELECT recording_id, least(min(timestamp_ms), (SELECT min(ref_ms) FROM fx_refs r WHERE r.recording_id = b.recording_id)) AS start_ms FROM fx_beats b GROUP BY recording_id", "fx_beats", "fx_refs")
def _(spark, sf):
    refs = fx.refs(spark, sf).withColumnRenamed("ref_ms", "timestamp_ms")
    return labelling.recording_starts(fx.beats(spark, sf), refs)


@query("c15_segment_translation", "SELECT recording_id, segment_idx + 100 AS ann_idx, segment_idx FROM fx_segq", "fx_segq")
def _(spark, sf):
    return mapping(spark, sf)


@query("i11_validated_segments", "SELECT recording_id, segment_idx FROM fx_segq WHERE quality_label <> 'bad'", "fx_segq")
def _(spark, sf):
    return labelling.validated_segments(docs(spark, sf), mapping(spark, sf))


@query("i12_bad_segments", "SELECT recording_id, segment_idx FROM fx_segq WHERE quality_label <> 'clean'", "fx_segq")
def _(spark, sf):
    return labelling.bad_segments(docs(spark, sf), mapping(spark, sf))


@query("i13_bad_regions", f", {SR} SELECT recording_id, a + 1000 AS start_ms, a + 9000 AS end_ms, segment_idx FROM sr WHERE segment_idx % 2 = 0", "fx_beats")
def _(spark, sf):
    return labelling.bad_regions(docs(spark, sf), mapping(spark, sf))


@query("h4_event_windows", f", {SR} SELECT recording_id, a AS start_ms, b AS end_ms FROM sr UNION ALL SELECT recording_id, b, b FROM sr", "fx_beats")
def _(spark, sf):
    return labelling.event_windows(docs(spark, sf))


@query("i1_build_peaks", f""", al AS (SELECT recording_id, timestamp_ms, source, 1 AS pr FROM fx_noisy UNION ALL SELECT recording_id, ref_ms, 'added', 0 FROM fx_refs UNION ALL SELECT recording_id, end_ms, 'detected', 0 FROM fx_intervals),
{greedy_sql('al', 10)}, cl AS (SELECT n.*, a.t AS anchor FROM al n ASOF JOIN anc a ON a.recording_id = n.recording_id AND n.timestamp_ms >= a.t),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, anchor ORDER BY pr, timestamp_ms, source) AS k FROM cl)
SELECT recording_id, timestamp_ms, source, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms) - 1 AS peak_id, CAST(floor((timestamp_ms - 1704067200000) / 60000) AS INT) AS segment_idx FROM rk WHERE k = 1""", "fx_noisy", "fx_refs", "fx_intervals")
def _(spark, sf):
    det = fx.noisy(spark, sf).withColumn("is_added_peak", F.lit(False))
    added = fx.refs(spark, sf).withColumnRenamed("ref_ms", "timestamp_ms")
    rep = fx.intervals(spark, sf).withColumnRenamed("end_ms", "timestamp_ms")
    out = labelling.build_peaks(det, added, rep, starts(spark, sf))
    return out.select("recording_id", "timestamp_ms", "source", "peak_id", "segment_idx")


def _near(src: str, col: str) -> str:
    return f"EXISTS (SELECT 1 FROM {src} r WHERE r.recording_id = b.recording_id AND r.{col} BETWEEN b.timestamp_ms - 80 AND b.timestamp_ms + 80)"


LAB = f"""{REG}, it AS (SELECT recording_id, timestamp_ms + 30 AS ref_ms FROM fx_beats WHERE event_type = 'view' AND value < 40), ad AS (SELECT recording_id, timestamp_ms - 81 AS ref_ms FROM fx_beats WHERE event_type = 'click'
  UNION ALL SELECT recording_id, timestamp_ms - 80 FROM fx_beats WHERE event_type = 'signup'),
lb AS (SELECT b.recording_id, b.peak_id, b.segment_idx, EXISTS (SELECT 1 FROM fx_intervals i WHERE i.recording_id = b.recording_id AND b.timestamp_ms BETWEEN i.start_ms AND i.end_ms) AS phys_event_window,
  q.quality_label = 'clean' AS reviewed, EXISTS (SELECT 1 FROM rg i WHERE i.recording_id = b.recording_id AND i.segment_idx = b.segment_idx AND b.timestamp_ms BETWEEN i.start_ms AND i.end_ms) AS in_bad_region,
  CASE WHEN {_near('fx_refs', 'ref_ms')} THEN 'artifact' WHEN {_near('it', 'ref_ms')} THEN 'interpolated' WHEN {_near('ad', 'ref_ms')} THEN 'missed_original'
    WHEN EXISTS (SELECT 1 FROM fx_intervals i WHERE i.recording_id = b.recording_id AND b.timestamp_ms BETWEEN i.start_ms AND i.end_ms) THEN 'phys_event' ELSE 'clean' END AS label
  FROM fx_beats b JOIN fx_segq q ON q.recording_id = b.recording_id AND q.segment_idx = b.segment_idx)"""


def built_labels(spark, sf):
    b = fx.beats(spark, sf)
    ts = F.col("timestamp_ms")
    it = b.filter("event_type = 'view' and value < 40").select("recording_id", (ts + 30).alias("ref_ms"))
    ad = b.filter("event_type in ('click', 'signup')").select(
        "recording_id", (ts - F.when(F.col("event_type") == "click", 81).otherwise(80)).alias("ref_ms"))
    ok = fx.segment_quality(spark, sf).filter("quality_label = 'clean'")
    return labelling.build_labels(
        b.select("recording_id", "peak_id", "timestamp_ms", "beat_idx", "segment_idx"), fx.refs(spark, sf), it, ad,
        fx.intervals(spark, sf), ok, regions(spark, sf))


@query("i2_build_labels", f", {LAB} SELECT peak_id, label, phys_event_window, reviewed, in_bad_region FROM lb", "fx_refs", "fx_intervals", "fx_segq")
def _(spark, sf):
    return built_labels(spark, sf).drop("recording_id")


@query("i3_build_segments", """, st AS (SELECT recording_id, segment_idx, count(*) AS n, count(*) FILTER (label = 'artifact') AS a, count(*) FILTER (label = 'clean') AS c FROM fx_labels WHERE label <> 'artifact' OR in_bad_region GROUP BY ALL),
rg AS (SELECT recording_id, segment_idx, min(timestamp_ms) AS start_timestamp_ms, max(timestamp_ms) AS end_timestamp_ms FROM fx_samples GROUP BY ALL)
SELECT recording_id, segment_idx, start_timestamp_ms, end_timestamp_ms, CASE WHEN quality_label = 'bad' OR coalesce(a / n, 0) > 0.5 THEN 'bad' WHEN a > 0 THEN 'noisy_ok'
  WHEN quality_label = 'clean' THEN CASE WHEN coalesce(c, 0) >= 10 THEN 'clean' ELSE 'noisy_ok' END ELSE 'unknown' END AS quality_label
FROM rg LEFT JOIN st USING (recording_id, segment_idx) LEFT JOIN fx_segq USING (recording_id, segment_idx)""", "fx_labels", "fx_samples", "fx_segq")
def _(spark, sf):
    lab = fx.labels(spark, sf).filter("label <> 'artifact' or in_bad_region")
    q = fx.segment_quality(spark, sf)
    return aggregates.build_segments(
        aggregates.segment_ranges(fx.samples(spark, sf)), aggregates.segment_beat_stats(lab),
        q.filter("quality_label = 'bad'"), q.filter("quality_label = 'clean'"))


CONS = f"""{REG}, sp AS (SELECT recording_id, segment_idx + 100 AS ann_idx, min(timestamp_ms) AS a, max(timestamp_ms) AS e FROM fx_beats GROUP BY recording_id, segment_idx),
im AS (SELECT recording_id, ref_id AS item_id, ref_ms AS ts, 'artifacts' AS list_name FROM fx_refs UNION ALL SELECT recording_id, peak_id, timestamp_ms + 7, 'events' FROM fx_beats WHERE event_type = 'signup'),
lk AS (SELECT im.*, CASE WHEN ts <= e THEN ann_idx END AS ann_idx FROM im ASOF LEFT JOIN sp ON sp.recording_id = im.recording_id AND im.ts >= sp.a),
rs AS (SELECT lk.*, CASE WHEN q.quality_label IS NULL OR z.n < 90 THEN 'not_validated' WHEN q.quality_label = 'bad' THEN 'in_bad_seg' WHEN q.quality_label = 'noisy_ok' THEN 'in_revisit'
  WHEN list_name = 'artifacts' AND EXISTS (SELECT 1 FROM rg i WHERE i.recording_id = lk.recording_id AND abs(i.segment_idx - floor((lk.ts - 1704067200000) / 60000)) <= 1 AND lk.ts BETWEEN i.start_ms AND i.end_ms) THEN 'in_bad_region' ELSE 'keep' END AS reason
  FROM lk LEFT JOIN (SELECT recording_id, segment_idx, count(*) AS n FROM fx_beats GROUP BY ALL) z ON z.recording_id = lk.recording_id AND z.segment_idx + 100 = lk.ann_idx LEFT JOIN fx_segq q ON q.recording_id = lk.recording_id AND q.segment_idx + 100 = lk.ann_idx)"""


def consolidated(spark, sf):
    b = fx.beats(spark, sf)
    items = fx.refs(spark, sf).select("recording_id", F.col("ref_id").alias("item_id"), F.col("ref_ms").alias("timestamp_ms"), F.lit("artifacts").alias("list_name"))
    items = items.unionByName(b.filter("event_type = 'signup'").select("recording_id", F.col("peak_id").alias("item_id"), (F.col("timestamp_ms") + 7).alias("timestamp_ms"), F.lit("events").alias("list_name")))
    items = items.withColumn("segment_idx", fx.segment_of(F.col("timestamp_ms")))
    q = fx.segment_quality(spark, sf).withColumn("ann_idx", F.col("segment_idx") + 100)
    spans = b.groupBy("recording_id", (F.col("segment_idx") + 100).alias("ann_idx")).agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))
    return labelling.consolidate(
        items, spans, spans.filter("n >= 90"), q.filter("quality_label = 'bad'"), q.filter("quality_label = 'noisy_ok'"), regions(spark, sf))


@query("i18_consolidation", f", {CONS} SELECT list_name, item_id, reason FROM rs", "fx_refs", "fx_intervals", "fx_segq")
def _(spark, sf):
    return consolidated(spark, sf).select("list_name", "item_id", "reason")


@query("i18_consolidation_counts", f", {CONS} SELECT list_name, reason, count(*) AS n FROM rs GROUP BY ALL", "fx_refs", "fx_intervals", "fx_segq")
def _(spark, sf):
    return labelling.consolidation_counts(consolidated(spark, sf))


# ---- event detectors -------------------------------------------------------

BASE = """se AS (SELECT *, rr_prev_ms AS rr FROM fx_rr),
bl AS (SELECT *, CASE WHEN count(rr) OVER (w ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) >= 3 THEN quantile_cont(rr, 0.5) OVER (w ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) END AS base FROM se WINDOW w AS (PARTITION BY recording_id ORDER BY beat_idx)),
pm AS (SELECT *, rr / base AS ratio, max(rr / base) OVER (PARTITION BY recording_id ORDER BY beat_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pre FROM bl),
ca AS (SELECT * FROM pm WHERE rr >= 1200 AND ratio >= 1.8 AND base <= 1500 AND coalesce(pre, 0) <= 1.5),
fo AS (SELECT ca.peak_id, f.beat_idx - ca.beat_idx AS j, f.rr, f.rr <= ca.base * (1 + 0.2) AS back FROM ca JOIN se f ON f.recording_id = ca.recording_id AND f.beat_idx BETWEEN ca.beat_idx + 1 AND ca.beat_idx + 15),
st AS (SELECT peak_id, coalesce(min(j) FILTER (back), 15) AS stop FROM fo GROUP BY 1)"""


@query("j1_vagal_arrests", f""", {BASE} SELECT ca.peak_id AS onset_peak_id, ca.rr AS rr_ms, ca.base AS local_baseline_ms, round(ca.ratio, 6) AS pause_ratio,
  CAST(count(fo.j) FILTER (fo.j <= stop) AS INT) AS recovery_beats, CAST(coalesce(sum(fo.rr) FILTER (fo.j <= stop), 0) AS BIGINT) AS recovery_duration_ms FROM ca LEFT JOIN st USING (peak_id) LEFT JOIN fo USING (peak_id) GROUP BY ALL""", "fx_rr")
def _(spark, sf):
    out = events.vagal_arrests(windows.sessions(fx.beats(spark, sf)))
    return out.select("onset_peak_id", "rr_ms", "local_baseline_ms", *r6("pause_ratio"), "recovery_beats", "recovery_duration_ms")


RSA = """d0 AS (SELECT *, rr_prev_ms - CASE WHEN count(rr_prev_ms) OVER (w ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING) >= 5 THEN quantile_cont(rr_prev_ms, 0.5) OVER (w ROWS BETWEEN 13 PRECEDING AND 13 FOLLOWING) END AS dev
  FROM fx_rr WINDOW w AS (PARTITION BY recording_id ORDER BY beat_idx)),
d1 AS (SELECT recording_id, beat_idx, peak_id, timestamp_ms, round(coalesce(avg(dev) OVER (PARTITION BY recording_id ORDER BY beat_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0.0), 6) AS v FROM d0),
d2 AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM d1 WINDOW w AS (PARTITION BY recording_id ORDER BY beat_idx)),
d3 AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY beat_idx) AS run FROM d2),
ru AS (SELECT recording_id, run, min(v) AS v, (min(beat_idx) + max(beat_idx)) // 2 AS beat_idx FROM d3 GROUP BY ALL),
ex AS (SELECT *, CASE WHEN v > lag(v) OVER w AND v > lead(v) OVER w AND v >= 32 THEN 'slow' WHEN v < lag(v) OVER w AND v < lead(v) OVER w AND -v >= 32 THEN 'fast' END AS kind FROM ru WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
e2 AS (SELECT ex.recording_id, ex.beat_idx, kind, abs(ex.v) AS amp, peak_id, timestamp_ms FROM ex JOIN d1 USING (recording_id, beat_idx) WHERE kind IS NOT NULL),
e3 AS (SELECT *, (lag(amp) OVER w + amp) / 2 AS pair, coalesce(lag(kind) OVER w <> kind AND beat_idx - lag(beat_idx) OVER w BETWEEN 2 AND 14 AND (lag(amp) OVER w + amp) / 2 >= 32, false) AS cont FROM e2 WINDOW w AS (PARTITION BY recording_id ORDER BY beat_idx)),
e4 AS (SELECT *, sum((NOT cont)::INT) OVER (PARTITION BY recording_id ORDER BY beat_idx) AS isl FROM e3),
ev AS (SELECT recording_id, arg_min(peak_id, beat_idx) AS start_peak_id, arg_max(peak_id, beat_idx) AS end_peak_id, max(beat_idx) - min(beat_idx) + 1 AS beat_count, (count(*) - 1) // 2 AS n_cycles,
  avg(pair) FILTER (cont) AS m, max(pair) FILTER (cont) AS x FROM e4 GROUP BY recording_id, isl)"""


@query("j2_rsa_events", f", {RSA} SELECT start_peak_id, end_peak_id, beat_count, n_cycles, round(m, 4) AS mean_amplitude_ms, round(x, 4) AS max_amplitude_ms FROM ev WHERE n_cycles >= 2 AND m >= 40", "fx_rr")
def _(spark, sf):
    out = events.rsa_events(windows.sessions(fx.beats(spark, sf)))
    return out.select("start_peak_id", "end_peak_id", "beat_count", "n_cycles", F.round("mean_amplitude_ms", 4).alias("mean_amplitude_ms"), F.round("max_amplitude_ms", 4).alias("max_amplitude_ms"))


@query("j3_energy_detector")
def _(spark, sf):
    return events.detect_peaks(fx.samples(spark, sf), "energy")


@query("j4_wavelet_detector")
def _(spark, sf):
    return events.detect_peaks(fx.samples(spark, sf), "wavelet")


@query("j5_ensemble_detector")
def _(spark, sf):
    return events.detect_ensemble(fx.samples(spark, sf))


@query("j8_change_points")
def _(spark, sf):
    return events.change_points(fx.hourly(spark, sf), ["event_type"], "hour_ms", "v")
