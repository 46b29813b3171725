"""Fingerprints against a transform written as plain sums, and the query's own arrays."""

from __future__ import annotations

import cmath
import math
import random

import numpy as np

from lodestrata.llm import media


def plain_pairs(payload: bytes, block: int, bands: int, fan_out: int) -> list[tuple[int, int]]:
    hop, peaks = block // 2, []
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * n / (block - 1)) for n in range(block)]
    for at in range(0, len(payload) - block + 1, hop):
        own = payload[at : at + block]
        mean = sum(own) / block
        power = [abs(sum((own[n] - mean) * hann[n] * cmath.exp(-2j * math.pi * k * n / block) for n in range(block))) for k in range(1, block // 2 + 1)]
        width = len(power) // bands
        row = []
        for b in range(bands):
            split = power[b * width : (b + 1) * width]
            best = max(range(width), key=lambda k: (split[k], -k))
            row.append(b * width + best + 1 if split[best] > 1.5 * sum(split) / width + 1e-3 else -1)
        peaks.append(row)
    out = []
    for t, row in enumerate(peaks):
        for dt in range(1, fan_out + 1):
            for band in range(bands):
                if t + dt < len(peaks) and row[band] >= 0 and peaks[t + dt][band] >= 0:
                    out.append((t, row[band] << 16 | peaks[t + dt][band] << 4 | dt))
    return sorted(out)


def test_fingerprints_are_those_of_plain_sums():
    rng = random.Random(3)
    for n in (0, 1, 4, 9):
        payload = bytes(min(255, int(128 + 60 * math.sin(k / 3) + 40 * math.sin(k / (2 + k / 400)) + rng.randrange(9))) for k in range(72 * n))
        times, codes = media.peak_pairs(media.spectral_peaks(np.frombuffer(payload, np.uint8), 72, 36))
        want = plain_pairs(payload, 72, media.BANDS, media.FAN_OUT)
        assert list(zip(times.tolist(), codes.tolist())) == want
        assert n < 4 or want


def test_arrays_in_the_result(spark, tmp_path):
    rows = [(1, "words of a text " * 90), (2, None), (3, ""), (4, "words of a text " * 90), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op9_media_columns(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[1].times and got[1].codes == got[4].codes and got[1].feature == got[4].feature
    for i, text in rows:
        data = (text or "").encode()
        data += b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        times, codes = media.peak_pairs(media.spectral_peaks(np.frombuffer(data, np.uint8)))
        assert (got[i].times, got[i].codes) == (times.tolist(), codes.tolist())
    assert media.fingerprints(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()[2:] == (None, None, None)
