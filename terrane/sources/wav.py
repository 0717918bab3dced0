"""PCM WAV files as rows of samples, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in -1..1) of 8, 16, 24 or 32 bit PCM; channels are averaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("no format or no samples")
    _, channels, rate, _, _, bits = form
    if bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif bits in (16, 32):
        x = np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<i{bits // 8}") / 2.0 ** (bits - 1)
    elif bits == 24:
        b = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    else:
        raise ValueError(f"{bits} bits")
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


def encode(x: np.ndarray, rate: int) -> bytes:
    """16 bit PCM mono."""
    body = (np.clip(x, -1, 1) * 32767).round().astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(body))
    return head + body


def read(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, rate, samples, error): every WAV file under a path; files that aren't PCM WAV carry an error instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rate, x, error = *decode(data), None
                except ValueError as e:
                    rate, x, error = None, None, str(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.float64())), pa.array([error], pa.string())],
                    ["utt_id", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "utt_id string, rate int, samples array<double>, error string")
