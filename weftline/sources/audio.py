"""Uploaded audio files: checks, digests, container probe and decoding of PCM WAV."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import fixed
from weftline.runtime import ship

DECODED = "path string, sha256 string, file_size_bytes long, codec string, channels int, container_rate int, container_duration double, sample_rate int, signal array<float>"


def received(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, file_size_bytes, sha256, refused) of every file under path. refused
    is null for a file of an accepted kind and size, else `kind` or `size` (over 25 MiB);
    only accepted files keep their content and digest. Spark lists no empty files."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    refused = F.when(~kind.isin(*fixed.UPLOAD_SUFFIXES), "kind").when(F.col("length") > fixed.UPLOAD_BYTES, "size")
    content = F.when(refused.isNull(), F.col("content"))
    return files.select("path", content.alias("content"), F.col("length").alias("file_size_bytes"), F.sha2(content, 256).alias("sha256"), refused.alias("refused"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """received() files that are accepted: (path, content, file_size_bytes, sha256)."""
    return received(spark, path).where("refused is null").drop("refused")


def read_wav(data: bytes) -> tuple[str | None, int | None, int | None, float | None, np.ndarray | None]:
    """Codec, channels, rate, duration, and the mean of the channels in -1..1. What is
    not a PCM or float WAV has none of them."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, None, None, None
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(chunk) >= 16:
            form = struct.unpack("<HHIIHH", chunk[:16])
            if form[0] == 0xFFFE and len(chunk) >= 26:
                form = (struct.unpack("<H", chunk[24:26])[0], *form[1:])
        elif kind == b"data":
            body = chunk
        at += 8 + size + size % 2
    if form is None or body is None or not form[1] or not form[2]:
        return None, None, None, None, None
    tag, channels, rate, _, _, bits = form
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels] if width else b""
    if tag == 1 and bits in (8, 16, 24, 32):
        if bits == 8:
            x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
        elif bits == 24:
            b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
        else:
            x = np.frombuffer(body, f"<i{width}").astype(float) / 2 ** (bits - 1)
        codec = f"pcm_u8" if bits == 8 else f"pcm_s{bits}le"
    elif tag == 3 and bits in (32, 64):
        x, codec = np.frombuffer(body, f"<f{width}").astype(float), f"pcm_f{bits}le"
    else:
        return None, channels, rate, None, None
    mono = x.reshape(-1, channels).mean(axis=1)
    return codec, channels, rate, len(mono) / rate, mono


def resample(x: np.ndarray, rate: int, to: int = fixed.SAMPLE_RATE) -> np.ndarray:
    """Linear interpolation, after a mean over the samples that one new sample spans
    where the rate falls."""
    if rate == to or not len(x):
        return x
    if rate > to and (span := round(rate / to)) > 1:
        x = np.convolve(x, np.ones(span) / span, "same")
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def decode(files: DataFrame) -> DataFrame:
    """uploads() with what the container says and the signal, mono at 16 kHz; unreadable
    files keep their row with a null signal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codec, channels, rate, seconds, signal = read_wav(r["content"])
                made = resample(signal, rate) if signal is not None and len(signal) else None
                row = {"path": r["path"], "sha256": r["sha256"], "file_size_bytes": r["file_size_bytes"], "codec": codec, "channels": channels, "container_rate": rate, "container_duration": seconds}
                row |= {"sample_rate": fixed.SAMPLE_RATE if made is not None else None, "signal": made.astype(np.float32).tolist() if made is not None else None}
                kinds = [("path", pa.string()), ("sha256", pa.string()), ("file_size_bytes", pa.int64()), ("codec", pa.string()), ("channels", pa.int32()), ("container_rate", pa.int32()), ("container_duration", pa.float64()), ("sample_rate", pa.int32()), ("signal", pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_pylist([row], pa.schema(kinds))

    return files.mapInArrow(run, DECODED)
