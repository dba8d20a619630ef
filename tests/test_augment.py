"""Augmentation kinds: what each changes, by how much, and that draws repeat."""

import numpy as np
import pytest

from beatloom.operators import models


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.sin(np.arange(128) / 7 + i).__add__(rng.normal(0, 0.1, 128)).tolist()) for i in range(40)]
    return spark.createDataFrame([*rows, (99, [0.0] * 128)], "peak_id long, waveform array<double>")


def changes(windows, out):
    before = {r.peak_id: np.array(r.waveform) for r in windows.collect()}
    return [(before[r.peak_id], np.array(r.waveform), before[r.peak_id].std() or 1e-3) for r in out.collect()]


def test_artifact_kinds(windows):
    make = lambda k: changes(windows, models.augment_artifacts(windows, 1, kind=k))
    for a, b, sd in make("electrode_pop"):
        d = b - a
        assert (d != 0).sum() == 1 and 3.0 <= abs(d).max() / sd <= 8.0
    for a, b, sd in make("emg_burst"):
        at = np.flatnonzero(b != a)
        assert 30 <= at[-1] - at[0] + 1 <= 80
    for low, high, kind in ((0.3, 1.5, "baseline_wander"), (1.0, 3.0, "motion_artifact")):
        assert all(abs(b - a).max() <= high * sd + 1e-9 for a, b, sd in make(kind))
    ratio = [(b - a).std() / sd for a, b, sd in make("gaussian_noise")]
    assert 0.15 < min(ratio) and max(ratio) < 0.75 and np.ptp(ratio) > 0.1
    for a, b, sd in make("lead_off_transient")[:40]:
        at = np.flatnonzero(b != a)
        low = np.flatnonzero(abs(b) <= 0.0501 * abs(a))
        assert 18 <= at[-1] - at[0] + 1 <= 60 and len(low) >= 10


def test_jitter_and_corruption_kinds(windows):
    for a, b, _ in changes(windows, models.augment_jitter(windows, 1, kind="timeshift")):
        assert any(np.array_equal(np.roll(a, s), b) for s in range(-2, 3))
    scale = [(b[3] / a[3]) for a, b, _ in changes(windows, models.augment_jitter(windows, 1, kind="amplitude")) if a.any()]
    assert 0.9 <= min(scale) < max(scale) <= 1.1
    for a, b, _ in changes(windows, models.corrupt(windows, 1, 0.25, kind="masking")):
        assert (b == 0).sum() >= 32 and (a.any() is False or (b != a).sum() <= 32)
    gauss = [(b - a).std() / sd for a, b, sd in changes(windows, models.corrupt(windows, 1, 1.0, kind="gaussian"))]
    assert abs(np.mean(gauss) - 0.3) < 0.02
    assert all(not np.array_equal(a, b) for a, b, _ in changes(windows, models.corrupt(windows, 1, kind="combined")) if a.any())
    assert all(np.array_equal(a, b) for a, b, _ in changes(windows, models.corrupt(windows, 1, 0.0, kind="amplitude_scaling")))


def test_draws_repeat_and_kinds_vary(windows):
    one = sorted(map(tuple, models.augment_artifacts(windows, 1).collect()), key=lambda r: r[0])
    again = sorted(map(tuple, models.augment_artifacts(windows.repartition(3), 1).collect()), key=lambda r: r[0])
    assert one == again and len({r[1] for r in one}) >= 4
    assert models.augment_artifacts(windows, 2).select("kind").collect() != models.augment_artifacts(windows, 1).select("kind").collect()
