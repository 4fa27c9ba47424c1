"""Videos as a data source whose partitions are ranges of frames, so that one large file keeps many tasks busy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import BinaryIO, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from spotrace.model import FRAMES

FRAMES_PER_TASK = 64
# Frames that a task hands on at once (8 MB each at full size).
FRAMES_PER_BATCH = 4


class Decoder(Protocol):
    """What the caller brings for a video format; files are seekable, so a range reads its own bytes only."""

    def count(self, file: BinaryIO) -> int:
        """Number of frames, from the file's headers."""

    def read(self, file: BinaryIO, start: int, stop: int) -> Iterator[tuple[int, int, Sequence[float]]]:
        """(height, width, values in row order) of the frames from ``start`` to ``stop``, 0-based, end excluded."""


def _opened(path: str):
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(inside)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def list_videos(path: str) -> list[str]:
    """Files of a folder, or the file itself; names that begin with ``_`` or ``.`` do not count."""
    from pyarrow import fs

    where, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    info = where.get_file_info(inside)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inside))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class FrameRange(InputPartition):
    def __init__(self, path: str, datum: int, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.datum, self.start, self.stop = path, datum, start, stop


def frame_ranges(path: str, datum: int, n_frames: int, per_task: int) -> list[FrameRange]:
    return [FrameRange(path, datum, s, min(s + per_task, n_frames)) for s in range(0, n_frames, per_task)]


class VideoReader(DataSourceReader):
    def __init__(self, videos: list[tuple[str, int]], decoder: Decoder, per_task: int):
        self.videos, self.decoder, self.per_task = videos, decoder, per_task

    def partitions(self) -> Sequence[InputPartition]:
        ranges = []
        for path, datum in self.videos:
            with _opened(path) as file:
                ranges += frame_ranges(path, datum, self.decoder.count(file), self.per_task)
        # A source without partitions is read once, with none.
        return ranges or [FrameRange("", 0, 0, 0)]

    def read(self, partition: FrameRange):
        import pyarrow as pa

        if partition is None or partition.start >= partition.stop:
            return
        schema = to_arrow_schema(FRAMES)
        held: list[dict] = []
        with _opened(partition.path) as file:
            found = self.decoder.read(file, partition.start, partition.stop)
            for number, (height, width, values) in enumerate(found, partition.start + 1):
                held.append({"datum": partition.datum, "frame": number, "height": height, "width": width, "pixels": values})
                if len(held) == FRAMES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def read_videos(
    spark: SparkSession, path: str, decoder: Decoder, manifest: DataFrame, frames_per_task: int = FRAMES_PER_TASK
) -> DataFrame:
    """Packed frames of all videos under ``path``; every task decodes a range of one file's frames.

    A file belongs to the recording whose manifest ``filepath`` has its name; a file of none is an error.  Only file
    names and frame counts come to the driver.  The decoder must be picklable.
    """
    named = {_name(r["filepath"]): r["datum"] for r in manifest.select("datum", "filepath").collect() if r["filepath"]}
    found = list_videos(path)
    unknown = [f for f in found if _name(f) not in named]
    if unknown:
        raise ValueError(f"no recording for video {unknown[0]}")
    videos = [(f, named[_name(f)]) for f in found]

    class Videos(DataSource):
        @classmethod
        def name(cls) -> str:
            return "spotrace_video"

        def schema(self):
            return FRAMES

        def reader(self, schema) -> DataSourceReader:
            return VideoReader(videos, decoder, frames_per_task)

    spark.dataSource.register(Videos)
    return spark.read.format("spotrace_video").load()
