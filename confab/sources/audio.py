"""Audio as a table: rows are ranges of samples of a file, at one rate.

Tasks read the headers of a table of paths and cut each file into ranges of output samples, so neither many files nor a
recording of hours pass through the driver or one task, and no row holds a file as a whole. The resampler is polyphase: an output sample is a weighted
sum of the samples around its place, with the weights of its phase. A range reads the samples that its first and last sums reach over its
borders, so ranges joined are the samples of a whole read, bit for bit.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.sources.storage import scratch_path, written

#: Zero crossings of the filter on either side, share of the band that passes, and the window's shape (stop band below -70 dB).
CROSSINGS, PASS, BETA = 48, 0.93, 8.0
BLOCK = 1 << 15
#: Folders that written files are dealt over.
_FOLDERS = 256
#: Sample formats of a header (format, bits): fixed values of the container.
_FORMATS = {(1, 8): ("u1", 128.0, 128.0), (1, 16): ("<i2", 0.0, 32768.0), (1, 32): ("<i4", 0.0, 2147483648.0), (3, 32): ("<f4", 0.0, 1.0), (3, 64): ("<f8", 0.0, 1.0)}


@dataclass
class Header:
    rate: int
    channels: int
    kind: tuple[int, int]
    at: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * self.kind[1] // 8


def _open(path: str):
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def header(f) -> Header:
    """Of a RIFF file with PCM or float samples; other files are refused. Data that ends early has as many frames as are there."""
    size = f.size()
    if f.read_at(12, 0)[:4] != b"RIFF":
        raise ValueError("no RIFF file")
    at, form = 12, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", f.read_at(8, at))
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
            if code == 0xFFFE and n >= 26:
                code = struct.unpack("<H", f.read_at(2, at + 32))[0]
            if (code, bits) not in _FORMATS or not channels or not rate:
                raise ValueError(f"samples of format {code} with {bits} bits")
            form = rate, channels, (code, bits)
        elif name == b"data" and form:
            n = min(n, size - at - 8)
            return Header(*form, at + 8, n // (form[1] * form[2][1] // 8))
        at += 8 + n + n % 2
    raise ValueError("no samples")


def samples(f, head: Header, first: int, last: int) -> np.ndarray:
    """Frames ``first`` to ``last``, channels averaged, -1 to 1; zeros beyond the file's ends."""
    a, b = max(0, first), min(head.frames, last)
    kind, zero, scale = _FORMATS[head.kind]
    raw = f.read_at(max(0, b - a) * head.width, head.at + a * head.width) if b > a else b""
    x = (np.frombuffer(raw, kind).astype(np.float64).reshape(-1, head.channels).mean(axis=1) - zero) / scale
    return np.concatenate([np.zeros(max(0, min(last, a) - first)), x, np.zeros(max(0, last - max(b, first, a)))])[: last - first]


class Resampler:
    """From ``rate`` to ``to``: output i is at place i * down / up of the input, in phase i * down mod up."""

    def __init__(self, rate: int, to: int):
        g = math.gcd(rate, to)
        self.up, self.down = to // g, rate // g
        band = min(1.0, self.up / self.down)
        self.half = 0 if self.up == self.down else math.ceil(CROSSINGS / band)
        if self.half:
            t = np.arange(self.up)[:, None] / self.up - np.arange(-self.half + 1, self.half + 1)[None]
            shape = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / self.half) ** 2))) / np.i0(BETA)
            weights = np.sinc(t * band * PASS) * shape
            self.weights = weights / weights.sum(axis=1, keepdims=True)

    def length(self, frames: int) -> int:
        return -(-frames * self.up // self.down)

    def needs(self, first: int, last: int) -> tuple[int, int]:
        """Input frames that outputs ``first`` to ``last`` are made of."""
        if last <= first or not self.half:
            return first, last
        return first * self.down // self.up - self.half + 1, (last - 1) * self.down // self.up + self.half + 1

    def outputs(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """Outputs ``first`` to ``last`` from the frames that they need."""
        if not self.half:
            return x
        i = np.arange(first, last)
        place, phase = i * self.down // self.up, i * self.down % self.up
        around = np.lib.stride_tricks.sliding_window_view(x, 2 * self.half)
        return np.einsum("ij,ij->i", around[place - place[0]], self.weights[phase])


#: Header fields that a range takes with it.
_HEAD = "path string, rate int, channels int, code int, bits int, data_at long, frames long"
#: Samples and rows after which a batch is handed on.
_MOST, _ROWS = 1 << 18, 4096


def _headers(paths: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                with _open(path) as f:
                    head = header(f)
                out.append((path, head.rate, head.channels, *head.kind, head.at, head.frames))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int32()] * 4, *[pa.int64()] * 2], strict=True)], ["path", "rate", "channels", "code", "bits", "data_at", "frames"])

    return paths.select("path").mapInArrow(run, _HEAD)


def read_ranges(spark: SparkSession, paths: list[str] | DataFrame, rate: int = 16_000, range_: int = 1 << 20) -> DataFrame:
    """(path, at, samples): blocks of each file's samples at ``rate``; ``at`` is the place of a block's first. Empty files have no rows.

    ``paths`` is a list or a table with a column path. Headers are read by tasks, a row for each file; its ranges are rows too, and
    are dealt over as many tasks as a shuffle has parts: ranges near each other go together, and a task opens a file once for them.
    """
    df = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.expr(f"(frames * {rate} + rate - 1) div rate")
    rows = _headers(df.repartition(tasks, "path")).withColumn("n", n).filter("n > 0")
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(range_).cast("long"))))
    rows = rows.withColumn("last", F.least("n", F.col("first") + range_)).drop("n")
    near = F.expr(f"first div {max(range_, 1 << 20)}")
    rows = rows.repartition(tasks, "path", near).sortWithinPartitions("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Resampler] = {}
        name, f = None, None
        held: list[tuple[str, int, np.ndarray]] = []

        def batch_of() -> pa.RecordBatch:
            own = [y for _, _, y in held]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in held]), pa.array([a for _, a, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], ["path", "at", "samples"])

        try:
            size = 0
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != name:
                        if f is not None:
                            f.close()
                        name, f = r["path"], _open(r["path"])
                    head = Header(r["rate"], r["channels"], (r["code"], r["bits"]), r["data_at"], r["frames"])
                    if head.rate not in made:
                        made[head.rate] = Resampler(head.rate, rate)
                    make = made[head.rate]
                    for a in range(r["first"], r["last"], BLOCK):
                        b = min(r["last"], a + BLOCK)
                        held.append((name, a, make.outputs(samples(f, head, *make.needs(a, b)), a, b).astype(np.float32)))
                        size += b - a
                        if size >= _MOST or len(held) >= _ROWS:
                            yield batch_of()
                            held, size = [], 0
            if held:
                yield batch_of()
        finally:
            if f is not None:
                f.close()

    return rows.mapInArrow(run, "path string, at long, samples array<float>")


def write_waves(pcm: DataFrame, label: str = "audio", rate: int = 16_000) -> DataFrame:
    """Writes each row's ``pcm`` (array<int>, 16 bits) as a file named by its ``name``, in the shared folder; gives a written table of the paths.

    Files are dealt over folders by their names' checksums, so that none holds them all.
    """
    spark = pcm.sparkSession
    folder, tasks = scratch_path(spark, label), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(folder)
        there = set()
        for batch in batches:
            names = []
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = own.values.cast(pa.int16()).to_numpy().astype("<i2").tobytes() if own.is_valid else b""
                part = f"{zlib.crc32(name.encode()) % _FOLDERS:03d}"
                if part not in there:
                    files.create_dir(f"{top}/{part}", recursive=True)
                    there.add(part)
                with files.open_output_stream(f"{top}/{part}/{name}.wav") as f:
                    f.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data)
                names.append(f"{folder}/{part}/{name}.wav")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return written(pcm.selectExpr("cast(name as string) name", "pcm").repartition(tasks, "name").mapInArrow(run, "path string"), "paths")
