"""Labels from one frame against a search over all references and intervals."""

import random
import re

from beatloom.operators import labelling
from beatloom.params import Params, Series

S = Series(bucket_ms=400)
P = Params(match_tolerance_ms=20)


def frames(spark, seed):
    rng = random.Random(seed)
    times = [rng.randrange(3000) for _ in range(250)]
    peaks = [(r, i, t, t // 500 if i % 9 else 0, i % 31 == 0) for i, t in enumerate(times) for r in [i % 2]] + [(0, 999, None, 1, False), (3, 1000, 77, 0, False)]
    refs = [[(rng.randint(0, 1), rng.randrange(3000)) for _ in range(n)] for n in (25, 20, 15)]
    refs[0] += [(0, times[0] + 20), (0, times[2] - 20), (0, times[4] + 21), (5, 3), (0, None)]
    spans = [(rng.randint(0, 1), a, a + rng.choice([0, 5, 300])) for a in (rng.randrange(3000) for _ in range(12))]
    regions = [(r, a, e, rng.randrange(7)) for r, a, e in ((rng.randint(0, 1), a, a + rng.choice([0, 80, 900])) for a in (rng.randrange(3000) for _ in range(25)))]
    ok = [(0, 1), (0, 1), (1, 4), (7, 7)]
    d = [
        spark.createDataFrame(peaks, "recording_id int, peak_id long, timestamp_ms long, segment_idx int, is_added_peak boolean"),
        *[spark.createDataFrame(r, "recording_id int, ref_ms long") for r in refs],
        spark.createDataFrame(spans, "recording_id int, start_ms long, end_ms long"),
        spark.createDataFrame(ok, "recording_id int, segment_idx int"),
        spark.createDataFrame(regions, "recording_id int, start_ms long, end_ms long, segment_idx int"),
    ]
    return d, peaks, refs, spans, ok, regions


def test_labels_equal_brute_force(spark):
    for seed in (1, 2):
        d, peaks, refs, spans, ok, regions = frames(spark, seed)
        got = {(r.recording_id, r.peak_id): tuple(r)[2:] for r in labelling.build_labels(*d, s=S, p=P).collect()}
        assert len(got) == len(peaks)
        for rec, k, t, seg, extra in peaks:
            near = lambda side: t is not None and any(r == rec and m is not None and abs(m - t) <= 20 for r, m in side)
            event = t is not None and any(r == rec and a <= t <= e for r, a, e in spans)
            bad = t is not None and any(r == rec and g == seg and a <= t <= e for r, a, e, g in regions)
            label = "artifact" if near(refs[0]) else "interpolated" if near(refs[1]) else "missed_original" if extra or near(refs[2]) else "phys_event" if event else "clean"
            assert got[rec, k] == (label, event, (rec, seg) in ok, bad), (rec, k, t)


def test_beats_are_shuffled_twice(spark, tmp_path):
    d, *_ = frames(spark, 3)
    d[0].write.parquet(str(tmp_path / "p"))
    plan = labelling.build_labels(spark.read.parquet(str(tmp_path / "p")), *d[1:], s=S, p=P)._jdf.queryExecution().executedPlan().toString()
    # shuffles of whole beats carry their struct; the counts per bucket do not
    rows = [x for x in re.findall(r"Exchange [^\n]*\n[^\n]*", plan) if "partial_" not in x]
    windows = plan.count("Window [")
    assert windows <= 6 and len([x for x in rows if "Union" in x or "Project" in x or "Filter" in x]) <= 6
    assert len(re.findall(r"FileScan parquet|BatchScan parquet", plan)) <= 2
