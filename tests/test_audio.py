"""Ranges of audio files against whole reads and the filter's promises."""

import struct

import numpy as np
import pytest

from confab.sources import audio as a


def wave(path, x, rate, channels=1, kind=(1, 16), extra=b""):
    code, bits = kind
    data = {(1, 16): lambda: np.round(x * 32767).astype("<i2"), (1, 8): lambda: np.round(x * 127 + 128).astype("u1"), (3, 32): lambda: x.astype("<f4")}[kind]().tobytes()
    fmt = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    path.write_bytes(b"RIFF\0\0\0\0WAVE" + struct.pack("<4sI", b"fmt ", 16) + fmt + extra + struct.pack("<4sI", b"data", len(data)) + data)
    return f"file://{path}"


def joined(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.at)):
        assert r.at == len(out.setdefault(r.path, []))
        out[r.path] += r.samples
    return out


@pytest.mark.parametrize("rates", [(44_100, 16_000), (8000, 16_000), (16_000, 16_000), (48_000, 16_000)])
def test_ranges_equal_a_whole_read(spark, tmp_path, rates):
    x = np.random.default_rng(1).uniform(-1, 1, 70_001)
    path = wave(tmp_path / "a.wav", x, rates[0])
    whole, cut = (joined(a.read_ranges(spark, [path], rates[1], n))[path] for n in (1 << 30, 9_973))
    assert whole == cut and len(whole) == -(-70_001 * rates[1] // rates[0])


def test_tones_pass_and_aliases_do_not(spark, tmp_path):
    """A tone in the band keeps its level and place; one above half the new rate is 65 dB lower at least."""
    t = np.arange(48_000 * 2) / 48_000
    low, high = (wave(tmp_path / f"{f}.wav", 0.5 * np.sin(2 * np.pi * f * t), 48_000, kind=(3, 32)) for f in (1000, 9500))
    got = joined(a.read_ranges(spark, [low, high]))
    mid = slice(2000, 30_000)
    want = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(32_000) / 16_000)
    assert np.abs(np.array(got[low])[mid] - want[mid]).max() < 1e-3
    assert np.sqrt((np.array(got[high])[mid] ** 2).mean()) < 0.5 / np.sqrt(2) * 10 ** (-65 / 20)


def test_forms_and_odd_files(spark, tmp_path):
    x = np.array([0.5, -0.5, 0.25, 0.75])
    stereo = wave(tmp_path / "s.wav", x, 16_000, channels=2, extra=struct.pack("<4sI", b"LIST", 3) + b"abc\0")
    small = wave(tmp_path / "u.wav", x, 16_000, kind=(1, 8))
    none = wave(tmp_path / "n.wav", x[:0], 16_000)
    got = joined(a.read_ranges(spark, [stereo, small, none]))
    assert np.allclose(got[stereo], [0, 0.5], atol=1e-4) and np.allclose(got[small], x, atol=0.01) and none not in got
    assert a.read_ranges(spark, []).collect() == []
    (tmp_path / "bad.wav").write_bytes(b"no audio here")
    with pytest.raises(Exception, match="no RIFF"):
        a.read_ranges(spark, [f"file://{tmp_path / 'bad.wav'}"]).collect()


def test_many_files_are_few_tasks(spark, tmp_path):
    """Files come as a table, are read by as many tasks as a shuffle has parts, and give what they hold."""
    rows = [(f"{i}-a", list(range(i, i + i % 30))) for i in range(300)]
    paths = a.write_waves(spark.createDataFrame(rows, "name string, pcm array<int>"))
    got = a.read_ranges(spark, paths, 16_000, 7)
    assert got.rdd.getNumPartitions() == 4
    want = {name: [v / 32768 for v in pcm] for name, pcm in rows if pcm}
    assert {path.rsplit("/", 1)[1][:-4]: x for path, x in joined(got).items()} == want
