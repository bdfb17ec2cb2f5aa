"""Sampled audio as rows: a data source that plans byte ranges of PCM files as partitions.

A file is raw little-endian 16-bit samples, channels interleaved, named ``<id>.pcm``. A long recording is cut into ranges of whole frames, each a
partition of its own, so many tasks meter one file; a short one is one range, and ranges are never longer than ``range_bytes``. Files are read through ``pyarrow.fs``, so the folder must be
one that it reaches from every executor. Samples are between -1 and 1: the stored number over 32767.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import shared_folder

SCALE = 32767
RANGE_BYTES = 8 << 20
BATCH = 50_000


def _file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


@dataclass
class FrameRange(InputPartition):
    """Frames [first, first + count) of a file."""

    path: str
    first: int
    count: int


class FrameSource(DataSource):
    """``spark.read.format("pcm_frames").option("channels", 2).option("range_bytes", n).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "pcm_frames"

    def schema(self) -> str:
        return "id long, frame long, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options["path"], int(self.options.get("channels", 1)), int(self.options.get("range_bytes", RANGE_BYTES)))


class FrameReader(DataSourceReader):
    def __init__(self, folder: str, channels: int, range_bytes: int) -> None:
        self.folder, self.channels, self.step = folder, channels, max(1, range_bytes // (2 * channels))

    def partitions(self) -> list[FrameRange]:
        files, root = _file_system(self.folder)
        found = sorted((f.path, f.size // (2 * self.channels)) for f in files.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.endswith(".pcm"))
        return [FrameRange(path, at, min(self.step, n - at)) for path, n in found for at in range(0, n, self.step)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(self.folder)
        width, name = 2 * self.channels, int(partition.path.rsplit("/", 1)[-1].removesuffix(".pcm"))
        with files.open_input_file(partition.path) as f:
            f.seek(partition.first * width)
            for at in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - at)
                samples = np.frombuffer(f.read(n * width), "<i2").astype(np.float32) / np.float32(SCALE)
                offsets = pa.array(np.arange(0, len(samples) + 1, self.channels), type=pa.int32())
                first = partition.first + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, name)), pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(offsets, pa.array(samples, type=pa.float32()))], names=["id", "frame", "samples"]
                )


def write_frames(rows: DataFrame, samples: str, folder: str | None = None) -> str:
    """Writes ``id`` and an array of samples per row as one-channel PCM files; gives the folder. A task that runs twice renames the same bytes over the first ones."""
    folder = folder or f"{shared_folder(rows.sparkSession)}/kindred-frames-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        files.create_dir(root)
        for batch in batches:
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.clip(np.nan_to_num(np.array(values.as_py() or [], dtype=np.float64)), -1, 1)
                temporary = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(temporary) as f:
                    f.write(np.rint(data * SCALE).astype("<i2").tobytes())
                files.move(temporary, f"{root}/{name}.pcm")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["written"])

    rows.select("id", samples).filter(F.col("id").isNotNull()).mapInArrow(write, "written long").agg(F.sum("written")).collect()  # one number
    return folder


def read_frames(spark: SparkSession, folder: str, channels: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``id, frame, samples``, as ``waveform.measure`` wants them."""
    spark.dataSource.register(FrameSource)
    return spark.read.format("pcm_frames").option("channels", channels).option("range_bytes", range_bytes).load(folder)
