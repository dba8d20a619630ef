"""Time-series joins, interval algebra and thinning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.catalog import query
from beatloom.catalog.beats_q import RUNS
from beatloom.operators import intervals, sampleindex, temporal, thinning, windows
from beatloom.params import Series

LABEL_LOOKUP = "fx_labels"


@query("c7_match_within", """SELECT peak_id, EXISTS (SELECT 1 FROM fx_refs r WHERE r.recording_id = b.recording_id
  AND r.ref_ms BETWEEN b.timestamp_ms - 80 AND b.timestamp_ms + 80) AS matched FROM fx_beats b""", "fx_beats", "fx_refs")
def _(spark, sf):
    return temporal.match_within(fx.beats(spark, sf), fx.refs(spark, sf), 80, "ref_ms").select("peak_id", "matched")


@query("c8_nearest_within", """, j AS (SELECT r.ref_id, b.peak_id, b.timestamp_ms, row_number() OVER (PARTITION BY r.ref_id
    ORDER BY abs(b.timestamp_ms - r.ref_ms), b.timestamp_ms DESC) AS k
  FROM fx_refs r JOIN fx_beats b ON b.recording_id = r.recording_id AND b.timestamp_ms BETWEEN r.ref_ms - 80 AND r.ref_ms + 80)
SELECT r.ref_id, j.peak_id, j.timestamp_ms - r.ref_ms AS offset_ms FROM fx_refs r LEFT JOIN j ON j.ref_id = r.ref_id AND k = 1""", "fx_beats", "fx_refs")
def _(spark, sf):
    s = Series(ts="ref_ms", tie="ref_id")
    out = temporal.nearest_within(fx.refs(spark, sf), fx.beats(spark, sf), 80, "timestamp_ms", ["peak_id"], s)
    return out.select("ref_id", F.col("nearest.peak_id").alias("peak_id"), (F.col("nearest.t") - F.col("ref_ms")).alias("offset_ms"))


def _asof_sql(tie: str) -> str:
    return f""", l AS (SELECT r.ref_id, r.ref_ms, s.timestamp_ms AS lt, s.sample_idx AS li FROM fx_refs r ASOF LEFT JOIN fx_samples s
    ON r.recording_id = s.recording_id AND r.ref_ms >= s.timestamp_ms),
rr AS (SELECT r.ref_id, s.timestamp_ms AS rt, s.sample_idx AS ri FROM fx_refs r ASOF LEFT JOIN fx_samples s
    ON r.recording_id = s.recording_id AND r.ref_ms < s.timestamp_ms)
SELECT ref_id, CASE WHEN lt IS NULL OR rt - ref_ms {tie} ref_ms - lt THEN ri ELSE li END AS sample_idx FROM l JOIN rr USING (ref_id)"""


def _asof(spark, sf, tie):
    s = Series(ts="ref_ms", tie="ref_id")
    index = sampleindex.sample_index(fx.samples(spark, sf), [])
    out = sampleindex.nearest_sample(fx.refs(spark, sf), index, s, tie)
    return out.select("ref_id", F.col("nearest.i").alias("sample_idx"))


@query("c9_asof_nearest_sample", _asof_sql("<="), "fx_refs", "fx_samples")
def _(spark, sf):
    return _asof(spark, sf, "later")


@query("c10_asof_nearest_earlier_tie", _asof_sql("<"), "fx_refs", "fx_samples")
def _(spark, sf):
    return _asof(spark, sf, "earlier")


@query("c11_in_intervals", """SELECT peak_id, EXISTS (SELECT 1 FROM fx_intervals i WHERE i.recording_id = b.recording_id
  AND b.timestamp_ms BETWEEN i.start_ms AND i.end_ms) AS inside FROM fx_beats b""", "fx_beats", "fx_intervals")
def _(spark, sf):
    return temporal.in_intervals(fx.beats(spark, sf), fx.intervals(spark, sf)).select("peak_id", "inside")


def regions(spark, sf):
    """Bad regions: the intervals, owned by the segment of their start."""
    return fx.intervals(spark, sf).withColumn("segment_idx", fx.segment_of(F.col("start_ms")))


REG = "rg AS (SELECT *, CAST(floor((start_ms - 1704067200000) / 60000) AS INT) AS segment_idx FROM fx_intervals)"


@query("c12_segment_scoped_ranges", f""", {REG} SELECT peak_id, EXISTS (SELECT 1 FROM rg i WHERE i.recording_id = b.recording_id
  AND i.segment_idx = b.segment_idx AND b.timestamp_ms BETWEEN i.start_ms AND i.end_ms) AS in_range FROM fx_beats b""", "fx_beats", "fx_intervals")
def _(spark, sf):
    return temporal.in_scoped_ranges(fx.beats(spark, sf), regions(spark, sf)).select("peak_id", "in_range")


@query("c13_neighbour_segment_ranges", f""", {REG} SELECT peak_id, EXISTS (SELECT 1 FROM rg i WHERE i.recording_id = b.recording_id
  AND abs(i.segment_idx - b.segment_idx) <= 1 AND b.timestamp_ms BETWEEN i.start_ms AND i.end_ms) AS in_range FROM fx_beats b""", "fx_beats", "fx_intervals")
def _(spark, sf):
    return temporal.in_scoped_ranges(fx.beats(spark, sf), regions(spark, sf), reach=1).select("peak_id", "in_range")


@query("c14_interval_lookup", """, sg AS (SELECT recording_id, segment_idx, min(timestamp_ms) AS a, CASE WHEN segment_idx % 2 = 0 THEN max(timestamp_ms) ELSE min(timestamp_ms) + 60000 END AS e
  FROM fx_beats GROUP BY recording_id, segment_idx),
j AS (SELECT r.ref_id, r.ref_ms, s.segment_idx, s.e FROM fx_refs r ASOF LEFT JOIN sg s ON r.recording_id = s.recording_id AND r.ref_ms >= s.a)
SELECT ref_id, CASE WHEN ref_ms <= e THEN segment_idx END AS segment_idx FROM j""", "fx_beats", "fx_refs")
def _(spark, sf):
    seg = fx.beats(spark, sf).groupBy("recording_id", "segment_idx").agg(
        F.min("timestamp_ms").alias("start_ms"),
        F.when(F.col("segment_idx") % 2 == 0, F.max("timestamp_ms")).alias("end_ms"))
    s = Series(ts="ref_ms", tie="ref_id")
    return temporal.interval_lookup(fx.refs(spark, sf), seg, "segment_idx", s=s).select("ref_id", "segment_idx")


@query("c16_expanding_radius", """, j AS (SELECT r.ref_id, i.interval_id, list_min(list_filter([1000, 10000, 60000], lambda x: x >= greatest(0, i.start_ms - r.ref_ms, r.ref_ms - i.end_ms))) AS radius_ms,
    abs((i.start_ms + i.end_ms) // 2 - r.ref_ms) AS dist_ms
  FROM fx_refs r JOIN fx_intervals i ON r.recording_id = i.recording_id AND i.end_ms >= r.ref_ms - 60000 AND i.start_ms <= r.ref_ms + 60000),
b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY radius_ms, dist_ms, interval_id) AS k FROM j)
SELECT r.ref_id, b.radius_ms, b.dist_ms, b.interval_id FROM fx_refs r LEFT JOIN b ON b.ref_id = r.ref_id AND k = 1""", "fx_refs", "fx_intervals")
def _(spark, sf):
    return temporal.nearest_by_radius(
        fx.refs(spark, sf), fx.intervals(spark, sf), [1000, 10_000, 60_000], "ref_id", "ref_ms", "interval_id"
    ).select("ref_id", "radius_ms", "dist_ms", "interval_id")


CTX = """ca AS (SELECT recording_id, peak_id, timestamp_ms, segment_idx FROM fx_beats WHERE event_type = 'purchase' AND value > 100),
cx AS (SELECT c.peak_id, list(s.ecg ORDER BY s.timestamp_ms) AS context, list(s.timestamp_ms ORDER BY s.timestamp_ms) AS context_ms,
   arg_min(s.timestamp_ms, abs(s.timestamp_ms - c.timestamp_ms) * 100000 + (s.timestamp_ms - c.timestamp_ms + 5000)) AS nt
  FROM ca c JOIN fx_samples s ON s.recording_id = c.recording_id AND s.segment_idx = c.segment_idx AND abs(s.timestamp_ms - c.timestamp_ms) <= 2500 GROUP BY c.peak_id),
ci AS (SELECT *, list_position(context_ms, nt) - 1 AS centre_idx FROM cx),
sn AS (SELECT *, greatest(0, centre_idx - 5) AS lo, least(len(context) - 1, centre_idx + 5) AS hi FROM ci),
sp AS (SELECT *, lo + list_position(context[lo + 1 : hi + 1], list_max(context[lo + 1 : hi + 1])) - 1 AS snapped_idx FROM sn)"""


def context(spark, sf):
    c = fx.beats(spark, sf).filter("event_type = 'purchase' and value > 100").select(
        "recording_id", "peak_id", "timestamp_ms", "segment_idx")
    return temporal.context_windows(c, fx.samples(spark, sf), 2500)


@query("c17_context_windows", f", {CTX} SELECT peak_id, context, context_ms, CAST(centre_idx AS INT) AS centre_idx FROM ci", "fx_samples")
def _(spark, sf):
    return context(spark, sf).select("peak_id", "context", "context_ms", "centre_idx")


@query("c18_snapped_context", f""", {CTX} SELECT peak_id, CAST(snapped_idx AS INT) AS snapped_idx,
  snapped_idx < 12 OR snapped_idx > len(context) - 1 - 12 AS at_edge FROM sp""", "fx_samples")
def _(spark, sf):
    return temporal.snap_context(context(spark, sf), 5, 12).select("peak_id", "snapped_idx", "at_edge")


# ---- intervals -------------------------------------------------------------


def merged_sql(src: str, adjacency: int, out: str) -> str:
    return f"""{out}_a AS (SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{out}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {adjacency} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {out}_a),
{out} AS (SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM {out}_b GROUP BY recording_id, g)"""


@query("i5_merge_intervals", f", {merged_sql('fx_intervals', 0, 'm')} SELECT * FROM m", "fx_intervals")
def _(spark, sf):
    return intervals.merge(fx.intervals(spark, sf))


@query("i6_coverage_merge", f", {merged_sql('fx_intervals', 1, 'm')} SELECT * FROM m", "fx_intervals")
def _(spark, sf):
    return intervals.merge(fx.intervals(spark, sf), 1)


# The request of a recording runs from 20 s after its first beat to 20 s before
# its last one, with ends reversed for odd recordings.
REQ = """rq AS (SELECT recording_id, least(min(timestamp_ms) + 20000, max(timestamp_ms) - 20000) AS a, greatest(min(timestamp_ms) + 20000, max(timestamp_ms) - 20000) AS b FROM fx_beats GROUP BY recording_id),
cl AS (SELECT recording_id, greatest(start_ms, a) AS start_ms, least(end_ms, b) AS end_ms FROM fx_intervals JOIN rq USING (recording_id) WHERE end_ms >= a AND start_ms <= b)"""
GAPS = f"""{REQ}, {merged_sql('cl', 1, 'm')},
gp AS (SELECT recording_id, coalesce(lag(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms) + 1, a) AS start_ms, start_ms - 1 AS end_ms
  FROM (SELECT * FROM m UNION ALL SELECT recording_id, b + 1, b + 1 FROM rq) JOIN rq USING (recording_id)),
gaps AS (SELECT * FROM gp WHERE start_ms <= end_ms)"""


def requests(spark, sf):
    a, b = F.min("timestamp_ms") + 20_000, F.max("timestamp_ms") - 20_000
    odd = F.col("recording_id") % 2 == 1
    return fx.beats(spark, sf).groupBy("recording_id").agg(a.alias("a"), b.alias("b")).select(
        "recording_id",
        F.when(odd, F.col("b")).otherwise(F.col("a")).alias("req_start_ms"),
        F.when(odd, F.col("a")).otherwise(F.col("b")).alias("req_end_ms"))


@query("i7_coverage_subtract", f", {GAPS} SELECT * FROM gaps", "fx_beats", "fx_intervals")
def _(spark, sf):
    return intervals.uncovered(fx.intervals(spark, sf), requests(spark, sf))


@query("i8_uncovered_range", f", {GAPS} SELECT recording_id, count(*) AS n_gaps, CAST(sum(end_ms - start_ms + 1) AS BIGINT) AS uncovered_ms FROM gaps GROUP BY recording_id", "fx_beats", "fx_intervals")
def _(spark, sf):
    g = intervals.uncovered(fx.intervals(spark, sf), requests(spark, sf))
    return g.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.sum(F.col("end_ms") - F.col("start_ms") + 1).alias("uncovered_ms"))


@query("i9_coverage_reset", f""", ct AS (SELECT recording_id, (min(timestamp_ms) + max(timestamp_ms)) // 2 AS cutoff_ms FROM fx_beats GROUP BY recording_id),
kp AS (SELECT recording_id, start_ms, least(end_ms, cutoff_ms - 1) AS end_ms FROM fx_intervals JOIN ct USING (recording_id) WHERE start_ms <= least(end_ms, cutoff_ms - 1)),
{merged_sql('kp', 1, 'm')} SELECT * FROM m""", "fx_beats", "fx_intervals")
def _(spark, sf):
    cut = fx.beats(spark, sf).groupBy("recording_id").agg(
        F.floor((F.min("timestamp_ms") + F.max("timestamp_ms")) / 2).cast("long").alias("cutoff_ms"))
    return intervals.reset_coverage(fx.intervals(spark, sf), cut)


@query("i10_incremental_filter", f""", {GAPS} SELECT g.recording_id, g.start_ms AS gap_ms, min(b.timestamp_ms) AS start_ms, max(b.timestamp_ms) AS end_ms
FROM gaps g JOIN fx_beats b ON b.recording_id = g.recording_id AND b.timestamp_ms BETWEEN g.start_ms AND g.end_ms GROUP BY ALL""", "fx_beats", "fx_intervals")
def _(spark, sf):
    gaps = intervals.uncovered(fx.intervals(spark, sf), requests(spark, sf))
    return intervals.realised(intervals.rows_in_gaps(fx.beats(spark, sf), gaps))


@query("i14_transition_windows", f", {RUNS}, {merged_sql('runs', 0, 'm')} SELECT * FROM m", "fx_labels")
def _(spark, sf):
    return intervals.merge(windows.flag_runs(fx.labels(spark, sf), "phys_event_window", 20_000))


# ---- thinning --------------------------------------------------------------

# The greedy rule, one recursive step per kept event.
def greedy_sql(src: str, tolerance: int) -> str:
    return f"""nx AS MATERIALIZED (SELECT recording_id, timestamp_ms AS t, min(timestamp_ms) OVER (PARTITION BY recording_id ORDER BY timestamp_ms
    RANGE BETWEEN {tolerance + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM (SELECT DISTINCT recording_id, timestamp_ms FROM {src})),
anc AS (WITH RECURSIVE r AS (SELECT recording_id, min(t) AS t FROM nx GROUP BY recording_id
    UNION ALL SELECT r.recording_id, nx.nt FROM r JOIN nx ON nx.recording_id = r.recording_id AND nx.t = r.t WHERE nx.nt IS NOT NULL)
  SELECT * FROM r)"""


@query("g2_greedy_dedup", f""", {greedy_sql('fx_noisy', 10)},
cl AS (SELECT n.*, a.t AS anchor FROM fx_noisy n ASOF JOIN anc a ON a.recording_id = n.recording_id AND n.timestamp_ms >= a.t),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, anchor ORDER BY CASE WHEN source = 'added' THEN 0 ELSE 1 END, timestamp_ms, peak_id) AS k FROM cl)
SELECT recording_id, peak_id, timestamp_ms, source FROM rk WHERE k = 1""", "fx_noisy")
def _(spark, sf):
    d = fx.noisy(spark, sf).withColumn("rank", F.when(F.col("source") == "added", 0).otherwise(1))
    return thinning.greedy_clusters(d, 10, ["rank"]).select("recording_id", "peak_id", "timestamp_ms", "source")


@query("g3_union_detections", f""", u AS (SELECT recording_id, timestamp_ms FROM fx_noisy UNION ALL SELECT recording_id, ref_ms FROM fx_refs),
{greedy_sql('u', 50)} SELECT recording_id, t AS timestamp_ms FROM anc""", "fx_noisy", "fx_refs")
def _(spark, sf):
    a = fx.noisy(spark, sf).select("recording_id", "peak_id", "timestamp_ms")
    b = fx.refs(spark, sf).select("recording_id", F.col("ref_id").alias("peak_id"), F.col("ref_ms").alias("timestamp_ms"))
    return thinning.union_detections(a, b, 50).select("recording_id", "timestamp_ms")


@query("g4_refractory", f", {greedy_sql('fx_noisy', 224)} SELECT recording_id, t AS timestamp_ms FROM anc", "fx_noisy")
def _(spark, sf):
    return thinning.refractory(fx.noisy(spark, sf), 225).select("recording_id", "timestamp_ms")
