"""Stacks of frames as a Spark data source: ``spark.read.format("frames")`` and ``df.write.format("frames")``.

Reading plans one partition for each file and band of rows. Filters on frame, path and y reach the reader: files and rows that they rule out are not
opened or read, and of a strip only the bytes of the wanted rows are sought. Writing is a commit in two phases: tasks write hidden
temporary siblings, check them by reading them back, and only when all tasks are done the driver renames them; when one fails, all are removed.

Paths may be in any file system that pyarrow knows; a path without a scheme is local.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import operator
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from . import BITS, CHANNELS, COMPRESSION, COUNTS, FORMAT, HEIGHT, OFFSETS, PREDICTOR, SIGNATURE, STRIP_ROWS, WIDTH, decode_png, tiff_fields, tiff_head

#: Rows of a partition when reading; rows of a strip when writing.
BAND = 256
STRIP = 64
#: Largest size of a classic TIFF file.
MOST_BYTES = (1 << 32) - 1
MANIFEST = "manifest.json"
BOUNDS = {ds.EqualTo: (operator.eq,), ds.GreaterThan: (operator.gt,), ds.GreaterThanOrEqual: (operator.ge,), ds.LessThan: (operator.lt,), ds.LessThanOrEqual: (operator.le,)}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Layout:
    """Where the rows of a file lie."""

    height: int
    width: int
    dtype: str
    packing: int
    strip_rows: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]


def layout(fetch: Callable[[int, int], bytes]) -> Layout:
    """The layout of an RGB TIFF in strips, of which ``fetch(at, size)`` gives bytes; only the directory is read."""
    order, tags = tiff_fields(fetch)
    bits, packing, form = tags[BITS][0], tags.get(COMPRESSION, (1,))[0], tags.get(FORMAT, (1,))[0]
    if tags.get(CHANNELS, (1,))[0] != 3 or (form, bits) not in ((1, 8), (1, 16), (3, 32)) or packing not in (1, 8, 32946) or tags.get(PREDICTOR, (1,))[0] != 1 or OFFSETS not in tags:
        raise ValueError("only RGB of 8 or 16 bits or floats, in strips, plain or deflated, is read")
    height = tags[HEIGHT][0]
    return Layout(height, tags[WIDTH][0], order + ("f4" if form == 3 else f"u{bits // 8}"), packing, min(tags.get(STRIP_ROWS, (height,))[0], height) or 1, tags[OFFSETS], tags[COUNTS])


def rows_of(fetch: Callable[[int, int], bytes], of: Layout, first: int, last: int) -> np.ndarray:
    """Rows ``first`` to ``last - 1`` as (rows, width, 3); of plain strips only their own bytes are fetched."""
    line = of.width * 3 * np.dtype(of.dtype).itemsize
    parts, y = [], first
    while y < last:
        strip, inside = divmod(y, of.strip_rows)
        end = min(last, (strip + 1) * of.strip_rows)
        if of.packing == 1:
            parts.append(fetch(of.offsets[strip] + inside * line, (end - y) * line))
        else:
            parts.append(zlib.decompress(fetch(of.offsets[strip], of.counts[strip]))[inside * line : (inside + end - y) * line])
        y = end
    return np.frombuffer(b"".join(parts), of.dtype).reshape(last - first, of.width, 3)


@dataclass
class Band(ds.InputPartition):
    frame: int
    path: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.frame, self.first, self.last))


class FrameReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif,*.tiff,*.png")
        self.band, self.floats = int(options.get("band", BAND)), options.get("samples", "codes") == "floats"
        self.tests: list[tuple[str, Callable, object]] = []
        self.bytes_read = 0

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Takes comparisons of frame, path and y; Spark evaluates the others."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("frame", "path", "y") and type(f) in BOUNDS:
                self.tests.append((column, BOUNDS[type(f)][0], f.value))
            elif column in ("frame", "path", "y") and isinstance(f, ds.In):
                self.tests.append((column, lambda value, held: value in held, frozenset(f.value)))
            elif not (column in ("frame", "path", "y") and isinstance(f, ds.IsNotNull)):
                yield f

    def _holds(self, **values: object) -> bool:
        return all(test(values[column], value) for column, test, value in self.tests if column in values)

    def _fetcher(self, fs: pafs.FileSystem, path: str) -> Callable[[int, int], bytes]:
        stream = fs.open_input_file(path)

        def fetch(at: int, size: int) -> bytes:
            self.bytes_read += size
            return stream.read_at(size, at)

        return fetch

    def _size(self, fs: pafs.FileSystem, path: str) -> tuple[int, int]:
        fetch = self._fetcher(fs, path)
        if path.lower().endswith(".png"):
            head = fetch(0, 26)
            if head[:8] != SIGNATURE:
                raise ValueError(f"{path}: not a PNG file")
            return int.from_bytes(head[20:24], "big"), 0
        found = layout(fetch)
        return found.height, self.band

    def partitions(self) -> list[Band]:
        fs, root = opened(self.path)
        patterns = self.pattern.split(",")
        files = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and any(fnmatch.fnmatch(i.base_name.lower(), p) for p in patterns) and not i.base_name.startswith("."))
        out = []
        for frame, path in enumerate(files):
            if self._holds(frame=frame, path=path):
                height, band = self._size(fs, path)
                wanted = [y for y in range(height) if self._holds(y=y)]
                if wanted:
                    first, last = wanted[0], wanted[-1] + 1
                    # A packed image is one piece; other files are cut at multiples of the band.
                    edges = [first, *(range((first // band + 1) * band, last, band) if band else ()), last]
                    out += [Band(frame, path, a, b) for a, b in zip(edges, edges[1:])]
        return out or [Band(-1, "", 0, 0)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        if partition.frame < 0:
            return
        fs, _ = opened(self.path)
        fetch = self._fetcher(fs, partition.path)
        if partition.path.lower().endswith(".png"):
            image = decode_png(fetch(0, fs.get_file_info(partition.path).size))
            height, pixels = len(image), lambda a, b: image[a:b]
        else:
            found = layout(fetch)
            height, pixels = found.height, lambda a, b: rows_of(fetch, found, a, b)
        kind = pa.float64() if self.floats else pa.int64()
        for at in range(partition.first, partition.last, STRIP):
            ys = np.array([y for y in range(at, min(at + STRIP, partition.last)) if self._holds(y=y)], np.int32)
            if not len(ys):
                continue
            rows = pixels(int(ys[0]), int(ys[-1]) + 1)[ys - ys[0]]
            n, width = rows.shape[:2]
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            bands = [pa.ListArray.from_arrays(ends, pa.array(rows[:, :, c].ravel().astype(np.float64 if self.floats else np.int64), kind)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([partition.frame] * n, pa.int32()), pa.array([partition.path] * n), pa.array(ys), *bands, pa.array([height] * n, pa.int32())], names=["frame", "path", "y", "r", "g", "b", "height"])


@dataclass
class Written(ds.WriterCommitMessage):
    """The files of a task: (temporary path, name, height, width, SHA-256 of the samples)."""

    files: list[tuple[str, str, int, int, str]]


class FrameWriter(ds.DataSourceArrowWriter):
    """Rows (frame, y, r, g, b, height), those of a frame in one task and in the order of y, become one file for each frame."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.bits, self.overwrite = options["path"], int(options.get("bits", 16)), overwrite
        self.strip = int(options.get("strip", STRIP))
        if self.bits not in (8, 16, 32):
            raise ValueError(f"bits must be 8, 16 or 32, not {self.bits}")
        self.job = uuid.uuid4().hex

    def _samples(self, values: np.ndarray) -> np.ndarray:
        """Whole numbers are codes; others are clamped to [0, 1] and rounded half up, or kept as floats of 32 bits."""
        if values.dtype.kind in "iu":
            top = (1 << self.bits) - 1
            if self.bits < 32 and len(values) and (values.min() < 0 or values.max() > top):
                raise ValueError(f"codes must lie in 0 to {top}")
        elif not np.isfinite(values).all():
            raise ValueError("samples must be finite")
        elif self.bits < 32:
            values = np.floor(np.clip(values, 0, 1) * ((1 << self.bits) - 1) + 0.5)
        return values.astype("<f4" if self.bits == 32 else f"<u{self.bits // 8}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        task = TaskContext.get()
        done, state = [], {}

        def begin(frame: int, height: int, width: int) -> None:
            # Samples, two numbers a strip, and the fixed fields.
            size = height * width * 3 * self.bits // 8 + 8 * (height // self.strip + 1) + 512
            if size > MOST_BYTES:
                raise ValueError(f"frame {frame} needs {size} bytes, more than a TIFF file can hold")
            if isinstance(fs, pafs.LocalFileSystem) and shutil.disk_usage(root).free < size:
                raise OSError(f"frame {frame} needs {size} bytes, more than are free")
            temporary = f"{root}/.{self.job}-{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}-{frame:04d}"
            done.append([temporary, f"{frame:04d}.tif", height, width, ""])
            state.update(frame=frame, height=height, width=width, next=0, digest=hashlib.sha256(), stream=fs.open_output_stream(temporary))
            state["stream"].write(tiff_head(height, width, self.bits, self.strip))

        def end() -> None:
            if not state:
                return
            state["stream"].close()
            if state["next"] != state["height"]:
                raise ValueError(f"frame {state['frame']} has {state['next']} of {state['height']} rows")
            done[-1][4] = state["digest"].hexdigest()
            self._check(fs, *done[-1])
            state.clear()

        try:
            for batch in iterator:
                table = {c: batch.column(c) for c in ("frame", "y", "height")}
                for i, (frame, y, height) in enumerate(zip(*(table[c].to_pylist() for c in ("frame", "y", "height")))):
                    bands = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in "rgb"]
                    if state.get("frame") != frame:
                        end()
                        begin(frame, height, len(bands[0]))
                    if y != state["next"] or any(len(b) != state["width"] for b in bands):
                        raise ValueError(f"frame {frame}: row {y} of {len(bands[0])} samples in the place of row {state['next']} of {state['width']}; rows must come in order")
                    line = self._samples(np.stack(bands, axis=1)).tobytes()
                    state["digest"].update(line)
                    state["stream"].write(line)
                    state["next"] += 1
            end()
        except BaseException:
            if state:
                state["stream"].close()
            for temporary, *_ in done:
                _remove(fs, temporary)
            raise
        return Written([tuple(x) for x in done])

    def _check(self, fs: pafs.FileSystem, temporary: str, name: str, height: int, width: int, digest: str) -> None:
        """Opens a file again: its size, its kind of samples and every sample must be those that were written."""
        with fs.open_input_file(temporary) as stream:
            fetch = lambda at, size: stream.read_at(size, at)
            found = layout(fetch)
            if (found.height, found.width, np.dtype(found.dtype).itemsize * 8) != (height, width, self.bits):
                raise OSError(f"{name} was not written whole")
            held = hashlib.sha256()
            for y in range(0, height, self.strip):
                held.update(rows_of(fetch, found, y, min(y + self.strip, height)).tobytes())
            if held.hexdigest() != digest:
                raise OSError(f"{name}: samples changed in writing")

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1])
        names = [f[1] for f in files]
        if len(set(names)) < len(names):
            raise ValueError("rows of one frame came from several tasks; repartition by frame")
        if not self.overwrite:
            there = [i.path for i in fs.get_file_info([f"{root}/{n}" for n in names]) if i.type != pafs.FileType.NotFound]
            if there:
                raise FileExistsError(f"{there[0]} exists")
        for temporary, name, *_ in files:
            _publish(fs, temporary, f"{root}/{name}")
        # The list of files comes last and in one piece, so who reads by it sees a whole export.
        listed = {name: {"height": h, "width": w, "bits": self.bits, "sha256": digest} for _, name, h, w, digest in files}
        body = json.dumps(listed, indent=2, sort_keys=True).encode()
        temporary = f"{root}/.{self.job}-{MANIFEST}"
        with fs.open_output_stream(temporary) as stream:
            stream.write(body)
        _publish(fs, temporary, f"{root}/{MANIFEST}")
        self._sweep(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        self._sweep(fs, root)

    def _sweep(self, fs: pafs.FileSystem, root: str) -> None:
        """Removes what this job's tasks left, also tasks whose executor was lost."""
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f".{self.job}-"):
                _remove(fs, info.path)


def _remove(fs: pafs.FileSystem, path: str) -> None:
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)


def _publish(fs: pafs.FileSystem, temporary: str, target: str) -> None:
    """One rename, which replaces the target where the file system can do so; else the target is deleted first."""
    if not isinstance(fs, pafs.LocalFileSystem):
        _remove(fs, target)
    fs.move(temporary, target)


class FrameSource(ds.DataSource):
    """Options: path; reading: ``pattern`` (comma-separated), ``band`` (rows of a partition), ``samples`` (codes or floats); writing: ``bits`` (8, 16, or 32 for
    floats), ``strip`` (rows of a strip). Mode overwrite replaces files of the same name, append refuses to."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        kind = "double" if self.options.get("samples", "codes") == "floats" else "bigint"
        return "frame int, path string, y int, " + ", ".join(f"{c} array<{kind}>" for c in "rgb") + ", height int"

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader({k: self.options[k] for k in ("path", "pattern", "band", "samples") if k in self.options})

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        missing = {"frame", "y", "r", "g", "b", "height"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        fs, root = opened(self.options["path"])
        fs.create_dir(root, recursive=True)
        return FrameWriter({k: self.options[k] for k in ("path", "bits", "strip") if k in self.options}, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources."""
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def export_frames(frames, folder: str, bits: int = 16, overwrite: bool = False) -> None:
    """Writes ``frames(frame, y, r, g, b, height)`` with the format ``frames``: rows are dealt by frame and sorted, then streamed to their files."""
    register(frames.sparkSession)
    dealt = frames.select("frame", "y", *"rgb", "height").repartition("frame").sortWithinPartitions("frame", "y")
    dealt.write.format("frames").option("bits", bits).mode("overwrite" if overwrite else "append").save(folder)


def read_stack(spark: SparkSession, folder: str, **options: object):
    """(frame, path, y, r, g, b, height) of the files of a folder, numbered by path; filters on frame, path and y are pushed down."""
    register(spark)
    return spark.read.format("frames").options(**{k: str(v) for k, v in options.items()}).load(folder)
