"""Synthesised signals with known answers, the WAV reader, and the stream of uploads."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import audio, fixed
from weftline.sources.audio import decode, read_wav, received, uploads
from weftline.streaming.submissions import landing, run_available

RATE = 44_100


def wav(x, rate=RATE, channels=1):
    body = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(body)) + body


def tone(seconds=2.0, level=0.3):
    t = np.arange(int(RATE * seconds)) / RATE
    return level * np.sin(2 * np.pi * 220 * t) * (0.05 + 0.95 * (np.sin(2 * np.pi * 1.5 * t) > 0))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("uploads")
    rng = np.random.default_rng(1)
    noisy = tone(level=0.02) + rng.normal(scale=0.15, size=len(tone()))
    for name, data in {"clean.wav": wav(tone()), "quiet.wav": wav(tone(level=0.003)), "noisy.wav": wav(noisy), "clipped.wav": wav(tone() * 8), "junk.wav": b"not audio", "empty.wav": b"", "skip.txt": b"x", "copy.wav": wav(tone())}.items():
        (at / name).write_bytes(data)
    return at


def test_properties(spark, files):
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.properties(decode(uploads(spark, f"file://{files}"))).collect()}
    assert set(rows) == {"clean.wav", "quiet.wav", "noisy.wav", "clipped.wav", "junk.wav", "copy.wav"}
    clean = rows["clean.wav"]
    assert abs(clean.duration_sec - 2) < 0.05 and clean.sample_rate_khz == 44.1 and clean.bitrate_kbps > 0 and -60 < clean.loudness_db < 0 and clean.codec == "pcm_s16le"
    assert abs(clean.loudness_db - rows["quiet.wav"].loudness_db - 40) < 3
    assert rows["noisy.wav"].est_snr_db < 10 and rows["noisy.wav"].quality_label == "poor"
    assert rows["clipped.wav"].clipping_pct > 1 and "clipping" in rows["clipped.wav"].quality_notes
    assert rows["junk.wav"].quality_label == "unreadable" and rows["junk.wav"].loudness_db is None
    assert clean.sha256 == rows["copy.wav"].sha256


def test_submissions_find_or_add_their_person(spark, files):
    from weftline.operators import serve

    known = audio.properties(decode(uploads(spark, f"file://{files}")), flat=False)
    paths = sorted(r.path for r in known.select("path").collect())
    phones = ["9000000001", "+919000000007", "09000000007", None, None, "1"]
    forms = spark.createDataFrame([(p, i + 1, f"name {i % 5}", t) for i, (p, t) in enumerate(zip(paths, phones))], "path string, submission_id long, submitted_name string, submitted_phone string")
    person = spark.createDataFrame([(4, "Asha Rao")], "person_id long, full_name string")
    held = spark.createDataFrame([(4, "+919000000001")], "person_id long, phone string")
    rows, people = serve.submit(known, forms, held, person)
    got = {r.submission_id: (r.person_id, r.matched_by) for r in rows.collect()}
    assert got[1] == (4, "phone") and got[2][0] == got[3][0] == 5 and len({p for p, _ in got.values()}) == len(people.collect()) + 1
    assert {r.person_id for r in people.collect()} == {p for p, m in got.values() if m == "new_person"}
    assert serve.duplicate_uploads(rows).count() == 1


def plain_grade(x):
    """The label of a signal at 16 kHz in frames of 8 by steps of 4, in numpy."""
    db = lambda v: 20 * np.log10(max(v, 1e-10))
    levels = np.array([np.sqrt((x[i : i + 8] ** 2).mean()) for i in range(0, len(x) - 7, 4)])
    loud, quiet = np.quantile(levels, 0.9), np.quantile(levels, 0.1)
    padded = np.pad(x, 128)
    power = np.array([np.abs(np.fft.rfft(padded[i : i + 256] * np.hanning(257)[:-1])) ** 2 for i in range(0, len(padded) - 255, 4)])
    power = np.maximum(power, 1e-10)
    flat = (np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)).mean()
    snr, level = db(loud) - db(quiet), db(np.sqrt((x**2).mean()))
    silent = 100 * (levels < loud * 10 ** (fixed.SILENCE_DB / 20)).mean()
    score = 100 - (40 if snr < 10 else 15 if snr < 20 else 0) - (30 if level < -45 else 10 if level < -35 else 15 if level > -8 else 0)
    score -= 25 * ((np.abs(x) >= fixed.CLIP_AT).mean() * 100 > 0.1) + 25 * (silent > 70) + 30 * (len(x) < 16000) + 15 * (flat > 0.4)
    return "good" if score >= 80 else "fair" if score >= 55 else "poor"


def test_grade_counts_clipping_and_flatness(spark):
    from pyspark.sql import functions as F

    from weftline.plans import queries as plans

    t, rng = np.arange(640) / 16000, np.random.default_rng(3)
    gate = 0.03 + 0.97 * (np.sin(2 * np.pi * 50 * t) > 0)
    clean, noise = 0.3 * np.sin(2 * np.pi * 220 * t) * gate, rng.normal(scale=0.1, size=len(t)) * gate
    signals = [clean, np.clip(clean * 4, -1, 1), noise, np.sin(2 * np.pi * 6000 * t) * 0.3 * gate, clean[:320], np.clip(noise[:64] * 40, -1, 1)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)], "i int, s array<double>").withColumn("l", audio.frame_rms(F.col("s"), F.lit(8), F.lit(4)))
    got = {r.i: r.label for r in df.select("i", plans.measured_grade().alias("label")).collect()}
    assert got == {i: plain_grade(x) for i, x in enumerate(signals)}
    left_out = audio.grade(F.round(audio.decibels(audio.rms(F.col("s"))), 2), audio.snr_db(F.col("l")), F.lit(0.0), audio.silence_pct(F.col("l")), F.size("s") / 16000.0, F.lit(16.0), audio.crossings(F.col("s")))[0]
    assert {r.i: r.label for r in df.select("i", left_out.alias("label")).collect()} != got


def test_wav_kinds():
    x = np.array([0.0, 0.5, -0.5, 0.25])
    for bits, tag in ((8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)):
        if tag == 3:
            body = x.astype(f"<f{bits // 8}").tobytes()
        elif bits == 8:
            body = (x * 128 + 128).astype(np.uint8).tobytes()
        else:
            body = b"".join(int(v * 2 ** (bits - 1)).to_bytes(4, "little", signed=True)[: bits // 8] for v in x)
        data = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, 1, 8000, 0, 0, bits) + b"data" + struct.pack("<I", len(body)) + body
        assert read_wav(data)[4] == pytest.approx(x, abs=0.01)
    assert read_wav(b"RIFF") == read_wav(b"") == (None,) * 5


def test_stream_of_uploads(spark, files, tmp_path):
    seen = []
    run_available(landing(spark, f"file://{files}"), lambda df, n: seen.extend(r.sha256 for r in df.select("sha256").collect()), f"file://{tmp_path}/state").awaitTermination()
    assert len(seen) == len(set(seen)) == 5


def test_refused_uploads_say_why(spark, files):
    got = {r.path.rsplit("/", 1)[1]: r for r in received(spark, f"file://{files}").collect()}
    assert {n: r.refused for n, r in got.items() if r.refused} == {"skip.txt": "kind"}
    assert all((r.content is None) == (r.refused is not None) == (r.sha256 is None) for r in got.values())


def test_flatness_of_known_spectra(spark):
    rng = np.random.default_rng(5)
    t = np.arange(RATE // 4) / RATE
    signals = {"tone": np.sin(2 * np.pi * 440 * t), "noise": rng.normal(size=len(t)) * 0.1}
    df = spark.createDataFrame([(n, x.tolist()) for n, x in signals.items()], "name string, signal array<double>")
    got = {r.name: r.flat for r in df.select("name", audio.spectral_flatness("signal", F.lit(1024)).alias("flat")).collect()}
    assert got["tone"] < 0.05 < 0.4 < got["noise"] <= 1
    for name, x in signals.items():  # frame by frame, from the definition
        x, ratios = np.concatenate([np.zeros(512), x, np.zeros(512)]), []
        window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / 1024) for i in range(1024)])
        for at in range(0, len(x) - 1023, 512):
            power = np.maximum(np.abs(np.fft.rfft(x[at : at + 1024] * window)) ** 2, 1e-10)
            ratios.append(np.exp(np.log(power).mean()) / power.mean())
        assert got[name] == pytest.approx(np.mean(ratios))
