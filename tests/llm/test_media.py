import hashlib
import io
import wave
import zlib

import numpy as np

from glossade.llm import media

from .conftest import ODD


def test_round_trip(spark, make):
    got = media.media_columns(make(ODD)).collect()
    assert len(got) == len(ODD)
    want = sorted(((d or 0), (t or "").encode()) for d, t in ODD)
    for r, (d, raw) in zip(sorted(got, key=lambda r: (r.doc_id or 0)), want):
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert w.readframes(w.getnframes()) == full
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(full), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(full[-64:])
    same = [r.feature for r in got if r.doc_id == 5]
    assert same[0] == same[1]
    assert media.media_columns(make([])).count() == 0


def test_blocks_do_not_show(monkeypatch):
    raw = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    whole = media.fingerprints(raw)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (media.fingerprints(raw) == whole).all() and len(whole) > 100


def test_tone_has_its_bin():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / media.FRAME * t)).astype(np.uint8).tobytes()
    frame, bins = media.peaks(tone)
    assert 20 in bins[frame == 10]
    marks = media.fingerprints(tone)
    assert ((marks & 0xFF) <= media.REACH).all() and (np.diff(marks) >= 0).all()


def plain_landmarks(raw):
    """Frame by frame and pair by pair."""
    x = [b - 128 for b in raw]
    frames = max(1, -(-max(0, len(x) - 256) // 128) + 1)
    window = np.hanning(256).astype(np.float32)
    best = []
    for k in range(frames):
        part = x[128 * k : 128 * k + 256]
        spectrum = np.fft.rfft(np.array(part + [0] * (256 - len(part)), dtype=np.float32) * window)
        power = np.log1p(spectrum.real**2 + spectrum.imag**2)
        best.append([max((power[f], -f) for f in range(a, b)) for a, b in media.BANDS])
    mean = [np.mean([row[k][0] for row in best], dtype=np.float64) for k in range(len(media.BANDS))]
    found = [(k, -f) for k, row in enumerate(best) for (p, f), m in zip(row, mean) if p >= m]
    out = []
    for t, f in found:
        out += [t << 32 | f << 20 | g << 8 | u - t for u, g in [(u, g) for u, g in found if u > t][:2] if u - t <= 6]
    return frames, sorted(out)


def test_features_are_the_definition(spark, make):
    rng = np.random.default_rng(5)
    rows = [(1, ""), (2, None), (3, "short"), (4, "x" * 700), *((10 + k, "".join(rng.choice(list("abcdefgh é\n"), rng.integers(50, 3000)))) for k in range(12))]
    for r in media.media_columns(make(rows)).collect():
        raw = media.padded((dict(rows)[r.doc_id] or "").encode())
        frames, marks = plain_landmarks(raw)
        assert r.landmarks == marks
        assert r.feature == f"{frames}:{len(marks)}:{hashlib.blake2b(np.array(marks, dtype='<i8').tobytes(), digest_size=16).hexdigest()}"
