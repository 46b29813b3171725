"""Media columns: WAV files in a binary column and their spectral-peak fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

BLOCK = 576
RATE = 8000
HOP = BLOCK // 2
BANDS = 4
FAN_OUT = 3


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: np.ndarray, block: int = BLOCK, hop: int = HOP, bands: int = BANDS) -> np.ndarray:
    """The strongest frequency bin of each band in each frame; -1 where the band doesn't stand out."""
    at = np.arange(0, len(samples) - block + 1, hop)
    if not len(at):
        return np.empty((0, bands), np.int32)
    window = np.hanning(block).astype(np.float32)
    out = np.empty((len(at), bands), np.int32)
    view = np.lib.stride_tricks.sliding_window_view(samples, block)[::hop]
    for i in range(0, len(at), 4096):  # bounds the memory of very long files
        frames = view[i : i + 4096].astype(np.float32)
        frames -= frames.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(frames * window, axis=1))[:, 1:]
        width = power.shape[1] // bands
        split = power[:, : width * bands].reshape(len(power), bands, width)
        best = split.argmax(axis=2)
        strong = np.take_along_axis(split, best[:, :, None], 2)[:, :, 0] > 1.5 * split.mean(axis=2) + 1e-3
        out[i : i + 4096] = np.where(strong, best + 1 + np.arange(bands) * width, -1)
    return out


def peak_pairs(peaks: np.ndarray, fan_out: int = FAN_OUT) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of the pairs of a peak with one of its band in the next frames.

    A code holds both bins and the step in time: ``f1 << 16 | f2 << 4 | dt``.
    """
    times, codes = [], []
    for dt in range(1, fan_out + 1):
        a, b = peaks[:-dt], peaks[dt:]
        t, band = np.nonzero((a >= 0) & (b >= 0))
        times.append(t)
        codes.append((a[t, band] << 16) | (b[t, band] << 4) | dt)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(id, n_bytes, media)``: each whole text's UTF-8 bytes as the samples of a WAV file.

    Bytes 255 fill the payload up to a positive multiple of ``block``. A null text is
    empty, and so gives one block of filling. Repeated rows stay; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                data = text.as_py()
                sizes.append(len(data))
                media.append(encode_wav(data + b"\xff" * (block * max(1, -(-len(data) // block)) - len(data))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"]
            )

    rows = docs.select(id_col, text_or_empty(text_col).cast("binary").alias("data"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


def fingerprints(media: DataFrame, media_col: str = "media", block: int = BLOCK) -> DataFrame:
    """Adds ``payload`` (the samples, read back from the stored file) and the time-coded arrays ``times`` and ``codes``.

    The arrays are ordered by time, then code. A file too short for one frame has
    empty arrays; a null file has nulls. The other columns stay as they are.
    """
    names = media.columns
    at = names.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                payloads, times, codes = [], [], []
                for cell in part.column(at):
                    data = cell.as_py()
                    if data is None:
                        for x in (payloads, times, codes):
                            x.append(None)
                        continue
                    payload = decode_wav(data)
                    t, c = peak_pairs(spectral_peaks(np.frombuffer(payload, np.uint8), block, block // 2))
                    payloads.append(payload)
                    times.append(t)
                    codes.append(c)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(payloads, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))],
                    [*names, "payload", "times", "codes"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{schema}, payload binary, times array<int>, codes array<int>")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's WAV file, of what is read back from it and of its fingerprint, and that itself as time-coded arrays."""
    found = fingerprints(to_wav(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%016x", F.xxhash64("times", "codes")).alias("feature"),
        "times",
        "codes",
    )


QUERIES = {"op9_media_columns": op9_media_columns}
ORACLE_SQL: dict[str, str] = {}
