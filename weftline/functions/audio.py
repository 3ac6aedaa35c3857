"""Properties of a signal, an array<float> column, as expressions over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import fixed


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(fixed.EPSILON)))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def rms(signal: Column) -> Column:
    return F.sqrt(_mean(F.transform(signal, lambda v: v.cast("double") * v.cast("double"))))


def peak(signal: Column) -> Column:
    return F.array_max(F.transform(signal, lambda v: F.abs(v.cast("double"))))


def clipping_pct(signal: Column) -> Column:
    return F.round(F.size(F.filter(signal, lambda v: F.abs(v.cast("double")) >= fixed.CLIP_AT)) * 100.0 / F.size(signal), 4)


def frames(signal: Column, frame: Column, hop: Column) -> Column:
    """Array of frames; a signal shorter than one is one frame."""
    n = F.when(F.size(signal) < frame, 1).otherwise(1 + F.floor((F.size(signal) - frame) / hop)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(signal, i * hop + 1, frame))


def frame_rms(signal: Column, frame: Column, hop: Column) -> Column:
    return F.transform(frames(signal, frame, hop), rms)


def quantile(values: Column, q: float) -> Column:
    """Linear interpolation between the sorted values around q."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (b - a) * (at - low)


def snr_db(levels: Column) -> Column:
    """Loud frames over quiet ones; null below four frames."""
    return F.when(F.size(levels) >= 4, F.round(decibels(quantile(levels, 0.9)) - decibels(quantile(levels, 0.1)), 2))


def silence_pct(levels: Column) -> Column:
    floor = quantile(levels, 0.9) * F.pow(F.lit(10.0), F.lit(fixed.SILENCE_DB / 20))
    return F.when(F.size(levels) >= 4, F.round(F.size(F.filter(levels, lambda v: v < floor)) * 100.0 / F.size(levels), 2))


def crossings(signal: Column) -> Column:
    """Share of neighbouring samples of different sign."""
    signs = F.transform(signal, lambda v: F.signum(v.cast("double")))
    pairs = F.zip_with(F.slice(signs, 1, F.size(signs) - 1), F.slice(signs, 2, F.size(signs) - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    return F.when(F.size(signal) >= 2, F.round(_mean(pairs), 5))


@F.pandas_udf(T.DoubleType())
def spectral_flatness(signal: pd.Series, frame: pd.Series) -> pd.Series:
    """Mean over frames of geometric by arithmetic mean of the power spectrum."""

    def one(x, frame):
        if x is None or not len(x):
            return None
        x, size = np.asarray(x, float), max(256, int(frame))
        hop = max(1, int(frame) // 2)
        x = np.pad(x, size // 2)
        starts = range(0, max(1, len(x) - size + 1), hop)
        window = np.hanning(size + 1)[:-1]
        power = np.array([np.abs(np.fft.rfft(np.resize(x[s : s + size], size) * window)) ** 2 for s in starts])
        power = np.maximum(power, 1e-10)
        return float((np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)).mean())

    return pd.Series([one(x, f) for x, f in zip(signal, frame)])


def grade(loudness: Column, snr: Column, clipping: Column, silence: Column, duration: Column, rate_khz: Column, flatness: Column) -> tuple[Column, Column]:
    """(label, notes): points off for each fault; good from 80, fair from 55."""
    faults = [
        (snr < 10, 40, "very noisy"),
        ((snr >= 10) & (snr < 20), 15, "some noise"),
        (loudness < -45, 30, "very quiet"),
        ((loudness >= -45) & (loudness < -35), 10, "quiet"),
        (loudness > -8, 15, "very loud"),
        (clipping > 0.1, 25, "clipping"),
        (silence > 70, 25, "mostly silence"),
        (duration < 1, 30, "very short"),
        (rate_khz < 8, 20, "low sample rate"),
        (flatness > 0.4, 15, "noise-like spectrum"),
    ]
    score = F.lit(100)
    for when, off, _ in faults:
        score = score - F.when(when, off).otherwise(0)
    notes = F.array_join(F.array_compact(F.array(*[F.when(when, F.lit(said)) for when, _, said in faults])), "; ")
    return F.when(score >= 80, "good").when(score >= 55, "fair").otherwise("poor"), notes


def properties(df, flat: bool = True):
    """decode()'s rows with every property; files without a signal are `unreadable` and
    keep only what the container says."""
    frame = F.greatest(F.lit(1), F.floor(F.col("sample_rate") * fixed.FRAME_SECONDS)).cast("int")
    hop = F.greatest(F.lit(1), F.floor(frame / 2)).cast("int")
    df = df.withColumn("_levels", F.when(F.size("signal") > 0, frame_rms(F.col("signal"), frame, hop)))
    s = F.col("signal")
    has = F.size("signal") > 0
    seconds = F.coalesce("container_duration", F.size("signal") / F.col("sample_rate"))
    df = df.withColumns(
        {
            "duration_sec": F.when(F.col("signal").isNotNull(), F.round(seconds, 3)).otherwise(F.round("container_duration", 3)),
            "sample_rate_khz": F.coalesce("container_rate", "sample_rate") / 1000.0,
            "bitrate_kbps": F.round(F.col("file_size_bytes") * 8 / seconds / 1000, 1),
            "loudness_db": F.when(has, F.round(decibels(rms(s)), 2)),
            "peak_db": F.when(has, F.round(decibels(peak(s)), 2)),
            "clipping_pct": F.when(has, clipping_pct(s)),
            "est_snr_db": snr_db(F.col("_levels")),
            "silence_pct": silence_pct(F.col("_levels")),
            "zcr_mean": F.when(has, crossings(s)),
            "spectral_flatness": F.round(spectral_flatness(s, frame), 5) if flat else F.lit(None).cast("double"),
        }
    )
    label, notes = grade(*[F.col(c) for c in ("loudness_db", "est_snr_db", "clipping_pct", "silence_pct", "duration_sec", "sample_rate_khz", "spectral_flatness")])
    return df.withColumns({"quality_label": F.when(has, label).otherwise("unreadable"), "quality_notes": F.when(has, notes)}).drop("signal", "_levels", "content")
