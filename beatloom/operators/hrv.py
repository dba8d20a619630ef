"""Heart-rate-variability metrics on tumbling windows.

Windows start at the first interval of the recording (the anchor) and are bounded by
their timeframe (24 h at most). What sums can say comes from five-minute states
(``rollup``), which every function builds for itself or takes ready-made; metrics of
whole windows run in Python, all timeframes of one day in one group. Differences to
neighbours are taken once on the whole series and count for a window only if the
neighbour lies in the same one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom.functions import complexity
from beatloom.functions.signal import detrend_linear, welch
from beatloom.operators import rollup
from beatloom.operators.rollup import Frames, States
from beatloom.params import ENTROPY_TIMEFRAMES, SERIES, TIMEFRAME_MIN_BEATS, TIMEFRAME_MS, Series
from beatloom.plans.ordered import over_rows, spread

RR = Series(tie="timestamp_ms", idx="rr_idx")
KEY = ["recording_id", "timeframe", "window_start_ms"]

ALL_FRAMES: Frames = {k: (TIMEFRAME_MS[k], TIMEFRAME_MIN_BEATS[k]) for k in TIMEFRAME_MS}
ENTROPY_FRAMES: Frames = {k: (TIMEFRAME_MS[k], v[1]) for k, v in ENTROPY_TIMEFRAMES.items()}


def rr_table(df: DataFrame, s: Series = SERIES) -> DataFrame:
    """recording, time, rr_ms and a dense rr_idx from indexed beats."""
    d = over_rows(df, 1, 0, lambda x, w: x.withColumn("rr_ms", F.col(s.ts) - F.lag(s.ts).over(w)), s)
    return d.filter(F.col("rr_ms").isNotNull()).select(
        *s.key, s.ts, F.col("rr_ms").cast("double").alias("rr_ms"), (F.col(s.idx) - 1).alias("rr_idx")
    )


def anchors(rr: DataFrame, s: Series = RR) -> DataFrame:
    """The first row of each recording: where its windows start."""
    return rollup.anchors(rr, s)


def _ready(rr: DataFrame | States, frames: Frames, anchor: DataFrame | None, s: Series) -> States:
    return rr if isinstance(rr, States) else rollup.states(rr, frames, anchor, s)


def to_windows(rr: DataFrame, length_ms: int, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """Each interval with the start of its window of ``length_ms``.

    ``anchor`` fixes where windows start; give a stored one for incremental runs
    so that windows do not move.
    """
    d = rr.join(anchors(rr, s) if anchor is None else anchor, list(s.key))
    step = F.floor((F.col(s.ts) - F.col("anchor_ms")) / length_ms).cast("long")
    return d.withColumn("window_start_ms", F.col("anchor_ms") + step * length_ms)


def window_counts(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR,
                  open_windows: bool = True) -> DataFrame:
    """Windows with enough beats. ``open_windows=False`` leaves out the last,
    possibly unfinished window of each recording and timeframe."""
    st = _ready(rr, frames, anchor, s)
    w = rollup.windows(st).select(*KEY, "length_ms", F.col("_n").alias("count"), "first_idx")
    if not open_windows:
        last = st.bins.groupBy(*s.key).agg(F.max("_b").alias("_last")).join(st.anchor, list(s.key))
        end = F.col("anchor_ms") + (F.col("_last") * st.base_ms)
        w = w.join(last.select(*s.key, end.alias("_end")), list(s.key)).filter(F.col("window_start_ms") + F.col("length_ms") <= F.col("_end")).drop("_end")
    return w.withColumn("window_end_ms", F.col("window_start_ms") + F.col("length_ms"))


def _variance(n: Column, sum_: Column, squares: Column) -> Column:
    """Sample variance from sums; null below two values."""
    return F.when(n > 1, F.greatest(squares - sum_ * sum_ / n, F.lit(0.0)) / (n - 1))


def moments(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """Mean- and difference-based metrics, Poincare and deceleration capacity."""
    g = rollup.windows(_ready(rr, frames, anchor, s))
    n, nd = F.col("_n"), F.when(F.col("_nd") > 0, F.col("_nd"))
    vx, vd = _variance(n, F.col("_sx"), F.col("_sxx")), _variance(nd, F.col("_sd"), F.col("_sdd"))
    g = g.select(
        *KEY, n.alias("count"), (F.col("_sx") / n).alias("mean_rr"), F.sqrt(vx).alias("sdnn"), F.sqrt(vd).alias("sdsd"),
        F.sqrt(F.col("_sdd") / nd).alias("rmssd"), (F.col("_n20") / nd * 100).alias("pnn20"), (F.col("_n50") / nd * 100).alias("pnn50"),
        (F.col("_s_dc") / F.when(F.col("_n_dc") > 0, F.col("_n_dc"))).alias("dc"),
        (-F.col("_s_ac") / F.when(F.col("_n_ac") > 0, F.col("_n_ac"))).alias("ac"),
        F.sqrt(0.5 * vd).alias("sd1"), F.sqrt(F.when(2 * vx >= 0.5 * vd, 2 * vx - 0.5 * vd)).alias("sd2"),
    )
    mean = F.when(F.col("mean_rr") != 0, F.col("mean_rr"))
    a, b = F.col("sd1"), F.col("sd2")
    return g.withColumns(
        {
            "cv": F.col("sdnn") / mean * 100,
            "cvsd": F.col("rmssd") / mean * 100,
            "sd1_sd2": F.when(b > 1e-9, a / b),
            "csi": F.when(a > 1e-9, b / a),
            "cvi": F.when((a > 0) & (b > 0), F.log10(a * b)),
        }
    )


_ORDER = ("count", "min_rr", "max_rr", "mxdmn", "med_rr", "iqr", "q20", "q80", "mad")
_GEOMETRIC = ("hti", "tinn", "amo50")


def _order_statistics(x: np.ndarray) -> dict[str, float]:
    q20, q25, med, q75, q80 = np.quantile(x, (0.2, 0.25, 0.5, 0.75, 0.8))
    lo, hi = x.min(), x.max()
    return dict(zip(_ORDER, (len(x), lo, hi, hi - lo, med, q75 - q25, q20, q80, np.median(np.abs(x - med)))))


def order_statistics(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """Median, extremes, quantiles, median absolute deviation."""
    q = _per_window(_ready(rr, frames, anchor, s), frames, None, _ORDER, lambda x, _: _order_statistics(x), s)
    return q.withColumns({"count": F.col("count").cast("long"), "mcv": F.when(F.col("med_rr") != 0, F.col("mad") / F.col("med_rr") * 100)})


def _geometric(x: np.ndarray) -> dict[str, float]:
    n, lo, span = len(x), x.min(), np.ptp(x)
    bins, width = 1, 1.0
    if span > 0:
        q25, q75 = np.quantile(x, (0.25, 0.75))
        sturges, fd = span / (np.log2(n) + 1.0), 2.0 * (q75 - q25) / n ** (1.0 / 3.0)
        bins = int(np.ceil(span / (min(fd, sturges) if fd > 0 else sturges)))
        width = span / bins
    # bins with values only: outliers may make very many
    at, size = np.unique(np.minimum(np.floor((x - lo) / width), bins - 1), return_counts=True)
    full = at[2 * size >= size.max()]
    wide = np.unique(np.minimum(np.floor((x - lo) / 50), max(1, np.ceil(span / 50)) - 1), return_counts=True)[1]
    return {"hti": n / size.max(), "tinn": (full[-1] - full[0] + 1) * width, "amo50": wide.max() / n * 100}


def geometric(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """Triangular index and width on automatic bins (the finer of the Sturges
    and Freedman-Diaconis widths), and the share of the fullest 50 ms bin."""
    return _per_window(_ready(rr, frames, anchor, s), frames, None, _GEOMETRIC, lambda x, _: _geometric(x), s)


def sub_bin_spread(
    rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, bin_ms: int = 300_000, s: Series = RR
) -> DataFrame:
    """SDANN / SDNNI: sd of the bin means and mean of the bin sds, with the
    beats spread evenly from window start to window end.

    Integer arithmetic places beat i of n at start + i * length / (n - 1). A bin is
    then a range of positions, and its sums are differences of prefix sums at the
    ranges' ends: beats meet the few ends, not every window.
    """
    st = _ready(rr, frames, anchor, s)
    w = rollup.windows(st).filter(F.col("_n") > 1).select(*KEY, "length_ms", "first_idx", F.col("_n").alias("_size"))
    w = w.withColumn("_bin", F.explode(F.expr(f"sequence(window_start_ms div {bin_ms}, (window_start_ms + length_ms) div {bin_ms} + 1)")))
    # the first position of the bin, at least 0 and at most n
    w = w.withColumn("_num", (F.col("_bin") * bin_ms - F.col("window_start_ms")) * (F.col("_size") - 1))
    first = F.least(F.greatest(F.expr("(_num + length_ms - 1) div length_ms"), F.lit(0)), F.col("_size"))
    w = w.select(*KEY, "_bin", (F.col("first_idx") + first - 1).alias(s.idx), first.alias("_i"))
    # before the first interval all sums are 0
    ends = w.join(rollup.prefix_sums(st), [*s.key, s.idx], "left").fillna(0.0, ["_px", "_pxx"])
    nxt = Window.partitionBy(*KEY).orderBy("_bin")
    ends = ends.withColumns({f"{c}2": F.lead(c).over(nxt) for c in ("_i", "_px", "_pxx", "_mid")})
    n = F.col("_i2") - F.col("_i")
    sx, sxx = F.col("_px2") - F.col("_px"), F.col("_pxx2") - F.col("_pxx")
    bins = ends.filter(n > 0).select(*KEY, (F.col("_mid2") + sx / n).alias("_m"), F.sqrt(_variance(n, sx, sxx)).alias("_s"))
    many = F.count(F.lit(1)) > 1
    return bins.groupBy(*KEY).agg(
        F.when(many, F.stddev_samp("_m")).alias("sdann5"), F.when(many, F.avg("_s")).alias("sdnni5")
    )


def permutation_entropy(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """Normalised entropy of the order patterns of three successive intervals;
    equal values keep their order."""
    g = rollup.windows(_ready(rr, frames, anchor, s))
    counts = [F.coalesce(F.col(f"_p{p}"), F.lit(0)) for p in range(rollup.PATTERNS)]
    total = sum(counts[1:], counts[0])
    # sum over patterns of p * log2 p, from counts alone
    weighted = [F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0)) for c in counts]
    g = g.withColumn("_t", total).withColumn("_s", sum(weighted[1:], weighted[0])).filter(F.col("_t") > 0)
    h = F.log2(F.col("_t").cast("double")) - F.col("_s") / F.col("_t")
    return g.select(*KEY, (h / math.log2(6)).alias("perm_en"))


# ---- metrics without a built-in counterpart: one bounded window per call ----

_BANDS = (("ulf", 0.0, 0.003), ("vlf", 0.003, 0.04), ("lf", 0.04, 0.15), ("hf", 0.15, 0.4))
FREQUENCY = ("total_power", "ulf", "vlf", "vlf_pct", "vlf_peak", "lf_hf", "lf", "lf_pct", "lf_peak", "hf", "hf_pct", "hf_peak")


def band_powers(rr: np.ndarray, fs: float = 4.0) -> dict[str, float]:
    """Band powers of the evenly resampled, detrended interval series."""
    t = np.cumsum(rr / 1000.0)
    t -= t[0]
    grid = np.arange(0, t[-1], 1 / fs)
    if len(rr) < 5 or len(grid) < 2:
        return dict.fromkeys(FREQUENCY, np.nan)
    f, p = welch(detrend_linear(np.interp(grid, t, rr)), fs, 8192)
    out: dict[str, float] = {}
    for name, lo, hi in _BANDS:
        sel = (f >= lo) & (f < hi)
        out[name] = float(np.trapezoid(p[sel], f[sel]))
        if name != "ulf":
            out[f"{name}_peak"] = float(f[sel][np.argmax(p[sel])]) if sel.any() else np.nan
    out["total_power"] = sum(out[n] for n, _, _ in _BANDS)
    out["lf_hf"] = out["lf"] / out["hf"] if out["hf"] > 1e-9 else np.nan
    for n in ("vlf", "lf", "hf"):
        out[f"{n}_pct"] = out[n] / out["total_power"] * 100 if out["total_power"] > 1e-9 else np.nan
    return {k: out[k] for k in FREQUENCY}


def _halves(rr: np.ndarray) -> dict[str, float]:
    cut = len(rr) // 2
    a1, a2 = (complexity.fluctuation_exponent(h) if len(h) > 10 else np.nan for h in (rr[:cut], rr[cut:]))
    return {"dfa_a1": a1, "dfa_a2": a2}


def _per_window(rr: DataFrame | States, frames: Frames, anchor: DataFrame | None, names: Sequence[str], fn, s: Series, together: bool = False, span_ms: int = 0) -> DataFrame:
    """Apply ``fn(values, timeframe) -> dict`` to each window with enough beats; with
    ``together``, ``fn`` takes a list of windows and returns a list of dicts.

    Timeframes that divide the longest one are computed from its windows, so each
    interval travels once; short ones are put together up to ``span_ms``. A group's
    windows of one timeframe come back as one row of lists and are spread by Spark.
    Groups are few rows and much work, so they are dealt over all shuffle partitions.
    """
    st = _ready(rr, frames, anchor, s)
    frames = st.frames if isinstance(rr, States) and frames is ALL_FRAMES else frames
    longest = max(ms for ms, _ in frames.values())
    longest *= max(1, span_ms // longest)
    inside = {n: v for n, v in frames.items() if longest % v[0] == 0}
    types = {f.name: f.dataType.simpleString() for f in st.rr.schema}
    lists = ["window_start_ms", *names]
    schema = ", ".join([*(f"{k} {types[k]}" for k in s.key), "timeframe string, window_start_ms array<long>", *(f"{n} array<double>" for n in names)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(s.ts, kind="stable")
        x, since = pdf["rr_ms"].to_numpy(), (pdf[s.ts] - pdf["window_start_ms"]).to_numpy()
        head = {k: pdf[k].iloc[0] for k in s.key}
        begin = int(pdf["window_start_ms"].iloc[0])
        rows = []
        for tf, (ms, least) in inside.items():
            part = since // ms
            cuts = np.flatnonzero(np.diff(part)) + 1
            spans = [(lo, hi) for lo, hi in zip([0, *cuts], [*cuts, len(x)]) if hi - lo >= least]
            if spans:
                parts = [x[lo:hi] for lo, hi in spans]
                values = fn(parts, tf) if together else [fn(p, tf) for p in parts]
                starts = [begin + int(part[lo]) * ms for lo, _ in spans]
                rows.append({**head, "timeframe": tf, "window_start_ms": starts, **{n: [float(v[n]) for v in values] for n in names}})
        return pd.DataFrame(rows, columns=[*s.key, "timeframe", *lists])

    d = to_windows(st.rr, longest, st.anchor, s).select(*s.key, "window_start_ms", s.ts, "rr_ms")
    out = spread(d, *s.key, "window_start_ms").groupBy(*s.key, "window_start_ms").applyInPandas(run, schema)
    out = out.select(*s.key, "timeframe", F.inline(F.arrays_zip(*lists)))
    out = out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})
    rest = {n: v for n, v in frames.items() if n not in inside}
    return out.unionByName(_per_window(st, rest, None, names, fn, s, together, span_ms)) if rest else out


def frequency_domain(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    return _per_window(rr, frames, anchor, FREQUENCY, lambda x, _: band_powers(x), s)


def sample_entropies(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    return _per_window(rr, frames, anchor, ["samp_en"], lambda x, _: {"samp_en": complexity.sample_entropy(x)}, s)


def fluctuation(rr: DataFrame | States, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """dfa_a1 from the first half of the window, dfa_a2 from the second."""
    return _per_window(rr, frames, anchor, ["dfa_a1", "dfa_a2"], lambda x, _: _halves(x), s)


def entropic(
    rr: DataFrame | States, frames: Frames = ENTROPY_FRAMES, dimensions: Mapping[str, int] | None = None,
    anchor: DataFrame | None = None, s: Series = RR,
) -> DataFrame:
    """Multiscale fuzzy entropy and correlation dimension, for short windows."""
    dims = dict(dimensions or {k: v[0] for k, v in ENTROPY_TIMEFRAMES.items()})

    def fn(windows: list[np.ndarray], tf: str) -> list[dict[str, float]]:
        m = dims.get(tf, 3)
        mfe = complexity.multiscale_fuzzy_entropies(windows, m)
        return [{"mfe": v, "corr_dim": complexity.correlation_dimension(x, m)} for v, x in zip(mfe, windows)]

    return _per_window(rr, frames, anchor, ["mfe", "corr_dim"], fn, s, together=True, span_ms=8 * 3_600_000)


def nonlinear_and_frequency(rr: DataFrame | States, frames: Frames, anchor: DataFrame | None = None, s: Series = RR) -> DataFrame:
    """The Python-side metrics in one pass over the windows."""

    def fn(x: np.ndarray, _: str) -> dict[str, float]:
        return {**band_powers(x), "samp_en": complexity.sample_entropy(x), **_halves(x)}

    return _per_window(rr, frames, anchor, [*FREQUENCY, "samp_en", "dfa_a1", "dfa_a2"], fn, s)


def hrv_metrics(rr: DataFrame, frames: Frames = ALL_FRAMES, anchor: DataFrame | None = None, s: Series = RR,
                names: Sequence[str] | None = None) -> DataFrame:
    """All metrics of every window; those a timeframe does not support are null.

    ``names`` asks for some metrics: groups of which none is wanted are not computed.
    """
    from beatloom.params import metrics_for

    st = rollup.states(rr, frames, anchor, s)
    short = {n: v for n, v in frames.items() if n in ENTROPY_FRAMES}
    plain = (*_ORDER, "mcv", *_GEOMETRIC)
    groups = [
        (("cv", "cvsd", "sdnn", "sdsd", "rmssd", "pnn20", "pnn50", "dc", "ac", "sd1", "sd2", "sd1_sd2", "csi", "cvi"), lambda: moments(st).drop("count", "mean_rr")),
        (("sdann5", "sdnni5"), lambda: sub_bin_spread(st)),
        (("perm_en",), lambda: permutation_entropy(st)),
        ((*FREQUENCY, "samp_en", "dfa_a1", "dfa_a2"), lambda: nonlinear_and_frequency(st, frames)),
        (("mfe", "corr_dim"), lambda: entropic(st, short) if short else None),
    ]
    # order statistics and bins of values come from one pass
    out = _per_window(st, frames, None, (*_ORDER, *_GEOMETRIC), lambda x, _: {**_order_statistics(x), **_geometric(x)}, s)
    out = out.withColumns({"count": F.col("count").cast("long"), "mcv": F.when(F.col("med_rr") != 0, F.col("mad") / F.col("med_rr") * 100)})
    known = [c for c in plain if names is None or c in names]
    for cols, build in groups:
        mine = [c for c in cols if names is None or c in names]
        if mine:
            part = build()
            if part is None:
                out = out.withColumns({c: F.lit(None).cast("double") for c in mine})
            else:
                out = out.join(part, KEY, "left")
            known += mine

    def valid(c: str) -> Column:
        ok = [t for t in frames if t not in TIMEFRAME_MS or c in metrics_for(t)]
        return F.when(F.col("timeframe").isin(ok), F.col(c)) if ok else F.lit(None).cast("double")

    return out.select(*KEY, *[valid(c).alias(c) for c in known])


def instantaneous_hr(rr: DataFrame, decimals: int = 1) -> DataFrame:
    ok = F.col("rr_ms") > 0
    return rr.filter(ok).withColumn("hr", F.round(F.lit(60000.0) / F.col("rr_ms"), decimals))


# ---- daily rhythm ----------------------------------------------------------


def cosinor(df: DataFrame, hour: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Least-squares fit of mean + cosine + sine of the hour of day.

    The 3x3 normal equations need nine sums per group, solved in closed form;
    null with fewer than three distinct hours.
    """
    d = df.filter(F.col(value).isNotNull() & F.col(hour).isNotNull())
    # counts per hour first: hour of day has 24 values
    h = d.groupBy(*group, hour).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_y"), F.sum(F.col(value) * F.col(value)).alias("_yy")
    )
    ang = F.col(hour) * (2 * math.pi / 24)
    c, sn, n = F.cos(ang), F.sin(ang), F.col("_n")
    g = h.groupBy(*group).agg(
        F.count(F.lit(1)).alias("hours"),
        F.sum("_n").alias("n"),
        F.sum(n * c).alias("_c"), F.sum(n * sn).alias("_s"), F.sum(n * c * c).alias("_cc"),
        F.sum(n * sn * sn).alias("_ss"), F.sum(n * c * sn).alias("_cs"),
        F.sum("_y").alias("_y"), F.sum(F.col("_y") * c).alias("_yc"), F.sum(F.col("_y") * sn).alias("_ys"),
        F.sum("_yy").alias("_yy"),
    )
    N, C, S, CC, SS, CS, Y, YC, YS = (F.col(k) for k in ("n", "_c", "_s", "_cc", "_ss", "_cs", "_y", "_yc", "_ys"))
    # centred sums leave a 2x2 system
    cc, ss, cs = CC - C * C / N, SS - S * S / N, CS - C * S / N
    yc, ys = YC - Y * C / N, YS - Y * S / N
    det = cc * ss - cs * cs
    g = g.withColumn("_b1", (yc * ss - ys * cs) / det).withColumn("_b2", (ys * cc - yc * cs) / det)
    b1, b2 = F.col("_b1"), F.col("_b2")
    tot = F.col("_yy") - Y * Y / N
    r2 = F.when(tot > 0, (b1 * yc + b2 * ys) / tot).otherwise(F.lit(0.0))
    phase = F.atan2(-b2, b1) * 24 / (2 * math.pi)
    ok = F.col("hours") >= 3
    return g.select(
        *group, "n",
        F.when(ok, (Y - b1 * C - b2 * S) / N).alias("mesor"),
        F.when(ok, F.sqrt(b1 * b1 + b2 * b2)).alias("amplitude"),
        F.when(ok, F.pmod(phase + 24, F.lit(24.0))).alias("acrophase"),
        F.when(ok, r2).alias("r_squared"),
    )


def hourly_profile(df: DataFrame, hour: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*group, hour).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n")
    )


def time_slices(df: DataFrame, ts_ms: str, kind: str, min_hours: int, group: Sequence[str] = ()) -> DataFrame:
    """slice_ms per row for days, or weeks from the first Monday on or after the
    group's first day; slices that span fewer hours are left out."""
    day = 86_400_000
    if kind == "daily":
        d = df.withColumn("slice_ms", F.floor(F.col(ts_ms) / day) * day)
    else:
        # the epoch began on a Thursday: Mondays are day 4 modulo 7
        monday = lambda t: (F.floor((F.floor(t / day) - 4) / 7) * 7 + 4) * day
        first = df.groupBy(*group).agg(F.min(ts_ms).alias("_t"))
        start = F.floor(F.col("_t") / day) * day
        first = first.withColumn("_from", F.when(monday(start) == start, start).otherwise(monday(start) + 7 * day)).drop("_t")
        d = df.join(first, list(group)) if group else df.crossJoin(F.broadcast(first))
        d = d.withColumn("slice_ms", monday(F.col(ts_ms))).filter(F.col("slice_ms") >= F.col("_from")).drop("_from")
    hour = F.floor(F.col(ts_ms) / 3_600_000)
    sizes = d.groupBy(*group, "slice_ms").agg((F.max(hour) - F.min(hour) + 1).alias("_h"))
    return d.join(sizes.filter(F.col("_h") >= min_hours).select(*group, "slice_ms"), [*group, "slice_ms"], "left_semi")
