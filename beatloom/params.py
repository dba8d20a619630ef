"""Thresholds and the description of an ordered series.

Every operator takes its thresholds as keyword arguments; the defaults live
here so that callers can override a whole set at once.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: physiological limits, tolerances and model thresholds ----


@dataclass(frozen=True)
class Params:
    segment_ms: int = 60_000
    dedup_tolerance_ms: int = 10
    match_tolerance_ms: int = 80
    min_valid_ms: int = 1_577_836_800_000
    refractory_ms: int = 225
    merge_tolerance_ms: int = 50
    sample_rate_hz: int = 130
    qrs_window: int = 65
    snap_samples: int = 8
    rr_short_ms: float = 275.0
    rr_long_ms: float = 2250.0
    rr_sandwich_ms: float = 175.0
    rr_normal_low_ms: float = 300.0
    rr_normal_high_ms: float = 1800.0
    hr_low_bpm: float = 45.0
    hr_high_bpm: float = 205.0
    hr_modal_low_bpm: float = 85.0
    hr_modal_high_bpm: float = 115.0
    transition_pad_ms: int = 20_000
    max_hr_rate: float = 25.0
    tachy_rise_bpm: float = 40.0
    tachy_lookback_ms: int = 60_000
    tachy_smooth_beats: int = 10
    bad_artifact_share: float = 0.50
    min_clean_beats: int = 10
    session_gap_ms: int = 10_000
    arrest_pause_ms: float = 1200.0
    arrest_ratio: float = 1.8
    arrest_baseline_beats: int = 11
    arrest_max_baseline_ms: float = 1500.0
    arrest_pre_ratio: float = 1.5
    arrest_recovery_beats: int = 15
    arrest_recovery_margin: float = 0.20
    rsa_amplitude_ms: float = 80.0
    rsa_cycles: int = 2
    rsa_min_half: int = 2
    rsa_max_half: int = 14
    rsa_baseline_beats: int = 27
    ensemble_alpha: float = 0.5
    ensemble_threshold: float = 0.5


DEFAULTS = Params()

# Length of each named timeframe in ms and the fewest beats a window needs.
TIMEFRAME_MS = {
    "5M": 300_000,
    "15M": 900_000,
    "30M": 1_800_000,
    "1H": 3_600_000,
    "2H": 7_200_000,
    "3H": 10_800_000,
    "4H": 14_400_000,
    "6H": 21_600_000,
    "12H": 43_200_000,
    "24H": 86_400_000,
}
TIMEFRAME_MIN_BEATS = {
    "5M": 250,
    "15M": 750,
    "30M": 1500,
    "1H": 3000,
    "2H": 6500,
    "3H": 9750,
    "4H": 15000,
    "6H": 24000,
    "12H": 48000,
    "24H": 96000,
}
# timeframe -> (embedding dimension, fewest beats) of the entropy set
ENTROPY_TIMEFRAMES = {"5M": (3, 250), "15M": (3, 750), "30M": (3, 1500), "1H": (4, 3400)}

# Metric columns by the shortest timeframe family they are valid for.
METRICS_ALL = (
    "count", "med_rr", "min_rr", "max_rr", "mxdmn", "iqr", "q20", "q80", "mad", "mcv", "sdsd",
    "sdnn", "rmssd", "pnn20", "pnn50", "cv", "cvsd", "dc", "ac", "hf", "hf_pct", "hf_peak", "lf",
    "lf_pct", "lf_peak", "lf_hf", "perm_en", "samp_en", "dfa_a1", "sd1", "sd2", "sd1_sd2", "csi",
    "cvi",
)
METRICS_SHORT = ("mfe", "corr_dim")
METRICS_LONG = ("vlf", "vlf_pct", "vlf_peak", "total_power", "dfa_a2")
METRICS_DAY = ("ulf", "sdann5", "sdnni5", "amo50", "hti", "tinn")
# Columns that describe a window rather than its variability.
STAT_COLUMNS = ("count", "med_rr", "min_rr", "max_rr", "mxdmn", "mad", "mcv", "iqr", "q20", "q80", "cv")

# Decimal places per metric; every other metric gets DEFAULT_DECIMALS.
DEFAULT_DECIMALS = 1
METRIC_DECIMALS = {
    "count": 0, "mad": 2, "mcv": 2, "rmssd": 2, "dc": 2, "ac": 2, "hti": 0, "tinn": 0,
    "total_power": 0, "ulf": 0, "vlf": 0, "vlf_peak": 3, "lf": 0, "lf_pct": 2,
    "lf_peak": 3, "hf": 0, "hf_pct": 2, "hf_peak": 3, "lf_hf": 2, "perm_en": 3,
    "samp_en": 3, "mfe": 3, "corr_dim": 3, "dfa_a1": 3, "dfa_a2": 3, "sdann5": 0,
    "sdnni5": 0, "sd1": 2, "sd2": 2, "sd1_sd2": 2, "csi": 2, "cvi": 2,
}
# metric -> (low, high): below is "low", above is "high"
METRIC_RANGES = {
    "sdnn": (30.0, 150.0),
    "rmssd": (27.0, 72.0),
    "pnn50": (3.0, 30.0),
    "pnn20": (1.0, 20.0),
    "lf_hf": (0.5, 2.0),
}
# Limits of the leaf categories (shares of clean or artifact beats).
LEAF_PRISTINE, LEAF_NORMAL, LEAF_LOW_AMPLITUDE, LEAF_NOISY, LEAF_ARTIFACT = 0.95, 0.90, 0.80, 0.70, 0.70
# Heart-rate classes (bpm) and spread limits of motif labels.
BRADYCARDIC_BPM, TACHYCARDIC_BPM = 65.0, 135.0
MOTIF_NOISY_SPREAD, MOTIF_ERRATIC_CV = 0.3, 0.25
LABELS = ("clean", "artifact", "interpolated", "phys_event", "missed_original")
QUALITY = ("clean", "noisy_ok", "bad")
# weight of each flag in the review priority score
PRIORITY_WEIGHTS = {
    "physio_implausible": 3.0,
    "rr_suspicious_short": 2.0,
    "rr_suspicious_long": 2.0,
    "hr_suspicious_high": 1.5,
    "hr_suspicious_low": 1.0,
    "pots_transition_candidate": 0.5,
    "tachy_transition_candidate": 0.5,
}


def metrics_for(timeframe: str) -> list[str]:
    """Metric columns that are valid for one timeframe."""
    ms = TIMEFRAME_MS[timeframe]
    out = list(METRICS_ALL)
    if ms < TIMEFRAME_MS["3H"]:
        out += METRICS_SHORT
    if ms >= TIMEFRAME_MS["3H"]:
        out += METRICS_LONG
    if ms >= TIMEFRAME_MS["24H"]:
        out += METRICS_DAY
    return out


@dataclass(frozen=True)
class Series:
    """Column names and bucket sizes of an ordered series.

    ``idx`` is the dense 0-based position inside one ``key``; it makes buckets
    of equal row counts possible, so one long recording becomes many tasks.
    """

    key: tuple[str, ...] = ("recording_id",)
    ts: str = "timestamp_ms"
    tie: str = "peak_id"
    idx: str = "beat_idx"
    bucket_rows: int = 65_536
    bucket_ms: int = 3_600_000


SERIES = Series()
