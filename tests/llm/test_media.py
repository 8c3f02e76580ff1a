import hashlib
import zlib

import numpy as np
from helpers import awkward_docs, empty

from tidemark.llm import media


def test_round_trip():
    for data in (b"", b"a", b"x" * 576, b"y" * 577, bytes(range(256)) * 50):
        payload = media.pad(data)
        assert len(payload) % 576 == 0 and payload and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        assert len(payload) - len(data) < 576 or not data
        assert media.from_wav(media.to_wav(payload)) == payload


def test_peaks_by_brute_force(monkeypatch):
    monkeypatch.setattr(media, "BLOCK", 3)
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 576 * 11).astype(np.uint8)
    times, bins = media.peaks(samples)
    want = []
    for f in range(10):
        part = samples[f * 576 : f * 576 + 1152].astype(float)
        p = np.abs(np.fft.rfft((part - part.mean()) * np.hanning(1152)))
        tops = [k for k in range(1, 576) if p[k] > p[k - 1] and p[k] >= p[k + 1] and p[k] > media.HEIGHT * p.mean()]
        want += [(f, k) for k in sorted(tops, key=lambda k: -p[k])[: media.PEAKS]]
    assert list(zip(times.tolist(), bins.tolist())) == want
    codes = {int(c) for c in media.landmarks(samples)}
    pairs = set()
    for i, (t, k) in enumerate(want):
        for u, m in want[i + 1 : i + 1 + media.FAN]:
            if u - t <= media.REACH:
                pairs.add(t << 32 | k << 20 | m << 8 | (u - t))
    assert codes == pairs


def test_tone_is_found():
    t = np.arange(576 * 6)
    tone = (128 + 100 * np.sin(2 * np.pi * 100 * t / 1152)).astype(np.uint8)
    assert 100 in set(media.peaks(tone)[1].tolist())
    assert len(media.landmarks(np.full(576, 7, dtype=np.uint8))) == 0


def test_table(spark):
    df = awkward_docs(spark)
    got = media.media_table(df).collect()
    rows = df.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        data = (r["text"] or "").encode()
        payload = media.pad(data)
        wav = media.to_wav(payload)
        want.setdefault(r["doc_id"], set()).add((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest()))
    by_text = {}
    for r in got:
        assert tuple(r)[1:7] in want[r["doc_id"]]
        assert r["n_pairs"] == len(r["landmarks"])
        assert by_text.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert media.media_table(empty(df)).count() == 0
