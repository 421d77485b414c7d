"""Clip measurements and scores.

Samples are ``array<float>`` between -1 and 1. Sums, peaks and shares are array expressions; envelopes and pitch, which
need windows of many samples, are measured in numpy by an Arrow UDF, and the scores are plain arithmetic on Columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .text import ascii_lower, ordinary_speech, ramp, stem, text_richness

# Weights of the score's components, and of where a clip comes from.
WEIGHTS = {"provenance": 0.16, "attribution": 0.08, "duration": 0.10, "loudness": 0.08, "cleanliness": 0.06, "naturalness": 0.10, "pitch": 0.08, "speech": 0.10, "text_richness": 0.14, "ordinary_speech": 0.10}
ORIGINS = {"dialogue_state": 1.0, "attribution_voiced": 0.9, "companion_dialogue": 0.85, "sound_slot": 0.6}
#: Frames of a clip whose spectra are held at once.
FRAMES = 512
#: Seconds that a clip must have to be bound.
LEAST_SECONDS = 0.6


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def level(samples: Column, rate: Column) -> list[Column]:
    """duration_secs, rms, peak, clipping_fraction and silence_fraction; an empty clip is all silence."""
    n = F.size(samples)
    wide = F.transform(samples, lambda s: F.abs(s.cast("double")))
    some = (n > 0) & (rate > 0)
    total = F.aggregate(wide, F.lit(0.0), lambda a, s: a + s * s)
    return [
        F.when(some, n / rate).otherwise(0.0).alias("duration_secs"),
        F.when(some, F.sqrt(total / n)).otherwise(0.0).alias("rms"),
        F.when(some, F.array_max(wide)).otherwise(0.0).alias("peak"),
        F.when(some, F.size(F.filter(samples, lambda s: F.abs(s) >= F.lit(0.997).cast("float"))) / n).otherwise(0.0).alias("clipping_fraction"),
        F.when(some, F.size(F.filter(samples, lambda s: F.abs(s) < F.lit(0.005).cast("float"))) / n).otherwise(1.0).alias("silence_fraction"),
    ]


def dynamic_range(samples: np.ndarray, rate: int) -> float:
    """20 log10 of the 95th over the 10th percentile (nearest rank) of the loudness of whole 25 ms windows."""
    window = round(rate * 0.025)
    if window == 0 or len(samples) < 4 * window:
        return 0.0
    frames = samples[: len(samples) // window * window].astype(np.float64).reshape(-1, window)
    loud = np.sort(np.sqrt((frames**2).mean(axis=1)))
    loud = loud[loud > 1e-4]
    if len(loud) < 4:
        return 0.0
    low, high = (loud[int(p * (len(loud) - 1) + 0.5)] for p in (0.10, 0.95))
    return float(20 * np.log10(high / low))


def pitch(samples: np.ndarray, rate: int) -> tuple[float, float]:
    """Upper median of the frames' fundamental frequency between 70 and 400 Hz (0 if none is voiced), and the
    share of loud frames that are strongly voiced (-1 with fewer than 4 loud frames)."""
    window, hop = round(rate * 0.04), round(rate * 0.02)
    low = int(rate / 400)
    high = min(int(rate / 70), window - 1)
    if not window or not hop or len(samples) < window or low == 0 or high <= low:
        return 0.0, -1.0
    views = np.lib.stride_tricks.sliding_window_view(samples, window)[::hop]
    lags, peaks = [], []
    for i in range(0, len(views), FRAMES):  # so that memory does not grow with the clip
        frames = views[i : i + FRAMES].astype(np.float64)
        frames = frames[np.sqrt((frames**2).mean(axis=1)) >= 0.02]
        frames = frames - frames.mean(axis=1, keepdims=True)
        energy = (frames**2).sum(axis=1)
        frames, energy = frames[energy >= 1e-8], energy[energy >= 1e-8]
        if not len(frames):
            continue
        spectrum = np.fft.rfft(frames, 2 * window, axis=1)
        match = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, low : high + 1] / energy[:, None]
        lags.append(match.argmax(axis=1))
        peaks.append(match[np.arange(len(frames)), lags[-1]])
    if not lags:
        return 0.0, -1.0
    best, peak = np.concatenate(lags), np.concatenate(peaks)
    tones = np.sort(rate / (low + best[peak >= 0.3]))
    voiced = float((peak >= 0.5).mean()) if len(peak) >= 4 else -1.0
    return (float(tones[len(tones) // 2]) if len(tones) else 0.0), voiced


@F.pandas_udf(_struct(dynamic_range_db=T.DoubleType(), pitch_hz=T.DoubleType(), voiced_fraction=T.DoubleType()))
def track(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    rows = []
    for s, r in zip(samples, rate, strict=True):
        clip = np.asarray([] if s is None else s, np.float32)
        rows.append((dynamic_range(clip, int(r)), *pitch(clip, int(r))) if len(clip) and r and r > 0 else (0.0, 0.0, -1.0))
    return pd.DataFrame(rows, columns=["dynamic_range_db", "pitch_hz", "voiced_fraction"])


def measure(clips: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """``clips`` with all measurements of M01 to M03 as columns."""
    ship(clips.sparkSession)
    return clips.withColumn("_track", track(samples, rate)).select("*", *level(F.col(samples), F.col(rate)), "_track.*").drop("_track")


def overall(**parts: Column) -> Column:
    """The weighted sum of the components, 0 to 1."""
    total = sum((F.lit(WEIGHTS[k]) * parts[k] for k in WEIGHTS), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def components(origin: Column, attribution: Column, text: Column) -> dict[str, Column]:
    """The ten components from the columns that ``measure`` adds."""
    c = F.col
    seconds, rms, dr, f0, voiced = c("duration_secs"), c("rms"), c("dynamic_range_db"), c("pitch_hz"), c("voiced_fraction")
    band = F.when(rms <= 0.25, ramp(rms, 0.03, 0.08)).otherwise(1.0 - ramp(rms, 0.25, 0.55))
    return {
        "provenance": F.coalesce(*(F.when(origin == k, F.lit(v)) for k, v in ORIGINS.items()), F.lit(0.0)),
        "attribution": F.least(F.greatest(attribution, F.lit(0.0)), F.lit(1.0)),
        "duration": F.when(seconds <= 12, ramp(seconds, 0.4, 1.2)).otherwise(F.greatest(F.lit(12.0) / seconds, F.lit(0.3))),
        "loudness": band * (F.lit(1.0) - c("clipping_fraction")),
        "cleanliness": (F.lit(1.0) - c("clipping_fraction")) * (F.lit(1.0) - c("silence_fraction")),
        "naturalness": F.when(dr <= 0, F.lit(1.0)).otherwise(ramp(dr, 6, 15)),
        "pitch": F.when(f0 <= 0, F.lit(1.0)).otherwise(F.lit(1.0) - ramp(f0, 220, 330) * 0.8),
        "speech": F.when(voiced < 0, F.lit(1.0)).otherwise(ramp(voiced, 0.08, 0.35)),
        "text_richness": text_richness(text),
        "ordinary_speech": ordinary_speech(text),
    }


def score(measured: DataFrame, origin: str = "origin", attribution: str = "attribution", text: str = "text") -> DataFrame:
    """``scores``, a struct of all components and ``overall``."""
    parts = components(F.col(origin), F.col(attribution), F.col(text))
    staged = measured.withColumn("_parts", F.struct(*(v.alias(k) for k, v in parts.items())))
    total = overall(**{k: F.col(f"_parts.{k}") for k in WEIGHTS})
    return staged.withColumn("scores", F.struct(total.alias("overall"), "_parts.*", F.col("duration_secs").alias("duration_secs"))).drop("_parts")


def vad_score(ratio: Column) -> Column:
    """M06."""
    return ramp(ratio, 0.10, 0.40)


def with_vad(scored: DataFrame, ratio: str) -> DataFrame:
    """Speech taken from a voice activity ratio, and overall computed anew."""
    speech = vad_score(F.col(ratio))
    total = overall(**{k: speech if k == "speech" else F.col(f"scores.{k}") for k in WEIGHTS})
    return scored.withColumn("scores", F.col("scores").withField("speech", speech).withField("overall", total))


def speech_ratio(segments: Column, total: Column) -> Column:
    """Share of time in (start, end) segments, 1 at most."""
    spoken = F.aggregate(segments, F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]))
    return F.when(total > 0, F.least(spoken / total, F.lit(1.0))).otherwise(0.0)


def bindable(seconds: Column) -> Column:
    """M07."""
    return F.coalesce(seconds >= LEAST_SECONDS, F.lit(False))


def owner_score(sound: Column, name: Column, hits: Column) -> Column:
    """Hits, and 100 for an equal stem or 50 for a sound that starts with a name's stem of 4 characters or more."""
    own, low = stem(name), ascii_lower(sound)
    near = F.when((own != "") & (stem(low) == own), 100).when((F.length(own) >= 4) & low.startswith(own), 50).otherwise(0)
    return F.greatest(hits, F.lit(0)) + near


def demographic_similarity(a: str, b: str) -> Column:
    """8 for the same sex, 4 for the same category, 2 for the same race, of two struct columns."""
    same = lambda n, w: F.when(F.col(f"{a}.{n}") == F.col(f"{b}.{n}"), w).otherwise(0)
    return same("sex", 8) + same("category", 4) + same("race", 2)


def composite(clips: DataFrame, group: str, candidate: str = "id", seconds: str = "seconds", rank: str = "rank", gap: float = 0.15) -> DataFrame:
    """For each group the best 2 to 4 of its up to 12 candidates: 6 to 12 s with gaps, 10 s or less preferred, then the first in rank.

    Candidates are at most 12 a group by contract, so the combinations of a group are bounded (781).
    """
    c = F.struct(F.col(rank).alias("rank"), F.col(candidate).alias("id"), F.col(seconds).alias("seconds"))
    groups = clips.where(F.col(rank) <= 12).groupBy(group).agg(F.sort_array(F.collect_list(c)).alias("cs"))
    one = F.transform("cs", lambda x: F.array(x))
    sets, found = one, []
    for _ in range(3):
        sets = F.flatten(F.transform(sets, lambda s: F.transform(F.filter("cs", lambda x: x["rank"] > F.element_at(s, -1)["rank"]), lambda x: F.concat(s, F.array(x)))))
        found.append(sets)
    length = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x["seconds"]) + (F.size(s) - 1) * gap
    scored = F.transform(F.concat(*found), lambda s: F.struct((length(s) > 10).alias("long"), F.transform(s, lambda x: x["rank"]).alias("ranks"), F.transform(s, lambda x: x["id"]).alias("ids"), length(s).alias("seconds")))
    best = F.array_min(F.filter(scored, lambda s: (s["seconds"] >= 6) & (s["seconds"] <= 12)))
    return groups.select(group, best.alias("best")).where("best IS NOT NULL").select(group, "best.ids", "best.seconds")


def build_composite(clips: Column, rate: int, gap: float = 0.15) -> Column:
    """Arrays of samples one after the other with silence between."""
    silence = F.array_repeat(F.lit(0.0).cast("float"), round(rate * gap))
    return F.aggregate(clips, F.array().cast("array<float>"), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.concat(a, silence, x)))


def diagnostics() -> Column:
    """Flags of a rendered clip from the columns of M01 and M03."""
    c = F.col
    return F.array_compact(F.array(
        F.when(c("duration_secs") < 0.25, "short"), F.when(c("silence_fraction") > 0.65, "mostly_silent"), F.when(c("clipping_fraction") > 0.02, "clipping"),
        F.when((c("voiced_fraction") >= 0) & (c("voiced_fraction") < 0.15), "low_speech"),
    ))


def rejected(rate: Column, seconds: Column, peak: Column) -> Column:
    """Why a decoded clip can't be bound; null if it can."""
    return F.when(rate != 22_050, "wrong sample rate").when(seconds <= 0, "no samples").when(~bindable(seconds), "too short").when(peak < 0.02, "silent")


@F.pandas_udf(_struct(silence_ratio=T.DoubleType(), clipped_samples=T.LongType(), peak_dbfs=T.DoubleType()))
def render_levels(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """Share of 20 ms windows below -45 dBFS, samples at 32760 and more, peak in dBFS, of 16-bit samples."""
    rows = []
    for s, r in zip(samples, rate, strict=True):
        x = np.asarray([] if s is None else s, np.float64)
        window = max(1, round(r * 0.02)) if r and r > 0 else 1  # a missing rate is NaN here
        frames = x[: len(x) // window * window].reshape(-1, window)
        quiet = np.sqrt((frames**2).mean(axis=1)) < 32768 * 10 ** (-45 / 20) if len(frames) else np.ones(1)
        peak = np.abs(x).max(initial=0)
        rows.append((float(quiet.mean()), int((np.abs(x) >= 32760).sum()), float(20 * np.log10(peak / 32768)) if peak else -120.0))
    return pd.DataFrame(rows, columns=["silence_ratio", "clipped_samples", "peak_dbfs"])


def normalize_peak(samples: Column, dbfs: float = -1.0) -> Column:
    """Scaled so that the largest sample is at ``dbfs``; silence stays."""
    peak = F.array_max(F.transform(samples, lambda s: F.abs(s)))
    return F.when(peak > 0, F.transform(samples, lambda s: (s * (10 ** (dbfs / 20)) / peak).cast("float"))).otherwise(samples)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def resample(samples: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    """To another rate, band-limited, by cutting or padding the spectrum."""

    def one(s, r, t):
        x = np.asarray([] if s is None else s, np.float64)
        n = round(len(x) * t / r) if r and r > 0 and t > 0 else 0  # a missing rate is NaN here
        if not n:
            return np.empty(0, np.float32)
        spectrum = np.fft.rfft(x)
        kept = np.zeros(n // 2 + 1, complex)
        k = min(len(kept), len(spectrum))
        kept[:k] = spectrum[:k]
        return (np.fft.irfft(kept, n) * n / len(x)).astype(np.float32)

    return pd.Series([one(*z) for z in zip(samples, rate, target, strict=True)])
