"""Sequences as a Python data source: `spark.read.format("wayline-sequence")` and, replayed by time, readStream.

Options: path (a folder of sequences, or one), sensor (cam or imu). Files are listed on the driver and read by
byte ranges in tasks, through pyarrow's file systems (local, HDFS, S3), so a remote path works too.

A stream replays all sequences by recorded time: with the options stepMs and checkpoint (the query's
checkpointLocation) each batch goes so much of it further, else all there is makes one batch. An offset is a time and nothing else, so a restart from a checkpoint asks for the same lines again;
which byte ranges hold a time is looked up in an index of ranges made once at the start, one row each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .sequence import IMU, SENSORS

NAME = "wayline-sequence"
SCHEMAS = {"cam": "seq_id string, ts_ns long, filename string", "imu": "seq_id string, ts_ns long, " + ", ".join(f"{c} double" for c in IMU)}
#: Bytes of one range, and rows of one Arrow batch.
RANGE, ROWS = 16 << 20, 10_000


class Part(InputPartition):
    """Bytes of one file, less lines outside [since, until) where these are given."""

    def __init__(self, path: str, seq: str, begin: int, end: int, since: int | None = None, until: int | None = None):
        self.path, self.seq, self.begin, self.end, self.since, self.until = path, seq, begin, end, since, until


def opened(path: str):
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


def parts_of(root: str, sensor: str, size: int) -> list[Part]:
    """Byte ranges of the sensor's files below root, by sequence and place."""
    fs, top = opened(root)
    found = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(top, recursive=True)), key=lambda i: i.path):
        if info.is_file and info.path.endswith("/" + SENSORS[sensor]):
            folder = info.path[: -len(SENSORS[sensor]) - 1].removesuffix("/mav0")
            uri = info.path if isinstance(fs, pafs.LocalFileSystem) else root.split("://")[0] + "://" + info.path
            found += [Part(uri, folder.rsplit("/", 1)[-1], at, min(at + size, info.size)) for at in range(0, max(info.size, 1), size)]
    return found


def lines_in(part: Part) -> Iterator[bytes]:
    """Lines that begin within the part's bytes; the first byte of a line is its place."""
    fs, path = opened(part.path)
    with fs.open_input_file(path) as f:
        size = f.size()
        at = max(0, part.begin - 1)
        f.seek(at)
        rest, skip = b"", part.begin > 0  # up to the line end before or at begin - 1 belongs to the part before
        while True:
            block = f.read(1 << 20)
            last = not block
            rest += block
            pieces = rest.split(b"\n")
            rest = b"" if last else pieces.pop()
            for line in pieces:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begin >= part.end or begin >= size:
                    return
                yield line
            if last:
                return


def rows_in(part: Part, sensor: str) -> Iterator[tuple]:
    for raw in lines_in(part):
        line = raw.strip()
        if not line or line.startswith(b"#"):
            continue
        fields = [x.strip() for x in line.decode().split(",")]
        try:
            ts = int(fields[0])
            if part.since is not None and not part.since <= ts < part.until:
                continue
            if ts < 0 or (len(fields) != 7 if sensor == "imu" else len(fields) < 2 or not fields[1]):
                raise ValueError("fields")
            values = [float(x) for x in fields[1:]] if sensor == "imu" else fields[1:2]
            if sensor == "imu" and not all(x - x == 0 for x in values):
                raise ValueError("not finite")
        except ValueError as e:
            raise ValueError(f"no valid line of {sensor} in {part.seq}: {line[:80]!r} ({e})") from e
        yield (part.seq, ts, *values)


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)


def arrow_schema(sensor: str) -> pa.Schema:
    value = [("filename", pa.string())] if sensor == "cam" else [(c, pa.float64()) for c in IMU]
    return pa.schema([("seq_id", pa.string()), ("ts_ns", pa.int64()), *value])


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def sensor(self) -> str:
        sensor = self.options.get("sensor", "imu")
        if sensor not in SCHEMAS:
            raise ValueError(f"sensor must be one of {sorted(SCHEMAS)}")
        return sensor

    def schema(self) -> str:
        return SCHEMAS[self.sensor()]

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options["path"], self.sensor(), int(self.options.get("rangebytes", RANGE)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SequenceStream(self.options["path"], self.sensor(), int(self.options.get("rangebytes", RANGE)), int(self.options.get("stepms", 0)), self.options.get("checkpoint", ""))


class SequenceReader(DataSourceReader):
    def __init__(self, path: str, sensor: str, size: int):
        self.path, self.sensor, self.size = path, sensor, size

    def partitions(self) -> list[Part]:
        return parts_of(self.path, self.sensor, self.size) or [Part("", "", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from batches(rows_in(part, self.sensor), arrow_schema(self.sensor))


class SequenceStream(DataSourceStreamReader):
    """Offsets are {"ns": time}: lines of a batch have start <= time < end."""

    def __init__(self, path: str, sensor: str, size: int, step_ms: int = 0, checkpoint: str = ""):
        if step_ms and not checkpoint:
            raise ValueError("stepMs needs the option checkpoint, the query's checkpointLocation")
        self.path, self.sensor, self.size, self.step, self.checkpoint = path, sensor, size, step_ms * 1_000_000, checkpoint
        self.index: list[tuple[int, int, Part]] | None = None
        self.at: int | None = None

    def ranges(self) -> list[tuple[int, int, Part]]:
        """(least time, greatest time, range) of each range with lines; files needn't be in order of time."""
        if self.index is None:
            self.index = []
            for part in parts_of(self.path, self.sensor, self.size):
                times = [int(x.split(b",", 1)[0]) for x in (raw.strip() for raw in lines_in(part)) if x and not x.startswith(b"#")]
                if times:
                    self.index.append((min(times), max(times), part))
        return self.index

    def initialOffset(self) -> dict:
        return {"ns": min((lo for lo, _, _ in self.ranges()), default=0)}

    def logged(self) -> int | None:
        """The last offset in the checkpoint. Spark doesn't tell a reader where a restart begins, and an offset
        before that would repeat lines."""
        fs, top = opened(self.checkpoint)
        found = fs.get_file_info(pafs.FileSelector(f"{top}/offsets", allow_not_found=True))
        last = max((int(i.base_name) for i in found if i.base_name.isdigit()), default=None)
        if last is None:
            return None
        with fs.open_input_stream(f"{top}/offsets/{last}") as f:
            said = [json.loads(x) for x in f.read().decode().splitlines() if x.startswith("{")]
        return next(x["ns"] for x in said if "ns" in x)

    def latestOffset(self) -> dict:
        end = max((hi for _, hi, _ in self.ranges()), default=-1) + 1
        if not self.step:
            return {"ns": end}
        if self.at is None:
            at = self.logged()
            self.at = self.initialOffset()["ns"] if at is None else at
        if self.at < end:
            self.at = min(end, self.at + self.step)
        return {"ns": self.at}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = end["ns"] if self.at is None else max(end["ns"], self.at)  # after a restart within a batch
        since, until = start["ns"], end["ns"]
        found = [Part(p.path, p.seq, p.begin, p.end, since, until) for lo, hi, p in self.ranges() if lo < until and hi >= since]
        return found or [Part("", "", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from batches(rows_in(part, self.sensor), arrow_schema(self.sensor))

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)
