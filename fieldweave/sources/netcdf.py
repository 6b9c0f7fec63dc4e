"""Classic netCDF files (CDF-1, CDF-2 and CDF-5) as a Spark data source.

register(spark) adds `netcdf`, which reads (time, point, lat, lon, value) of one variable from a file or from all .nc files of a folder; point is the place within the dimensions other than time. Tasks take blocks of
the variable's first dimension. Values are unpacked (scale_factor, add_offset); fill values and NaN are null, as is the time of a variable without one (a mask). Longitudes come out in [-180, 180).

Options: path, variable (default: the first that is no coordinate), task_bytes, and inclusive ranges time_from, time_to (ISO), lat_from, lat_to, lon_from, lon_to. Blocks of the first dimension outside a range are not
read. Ranges are options as pushed filters are not safe with Python sources (numpy_files).

Writing takes (time, node, lat, lon, value): a task writes a file of its own times over (time, points), so a field is a folder of files and no task holds more than one time.

Times are counted in seconds to weeks since a date of the Gregorian calendar; other calendars are refused, as are netCDF-4 files, which are HDF5 (`nccopy -k cdf5` turns them)."""

from __future__ import annotations

import json
import math
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from .numpy_files import TASK_BYTES, Written, _fs

SCHEMA = "time timestamp_ntz, point int, lat double, lon double, value double"
#: Values of one Arrow batch.
BATCH = 1 << 19
#: Fixed values of the format: types by number, and tags of the lists in a header.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Names of coordinates, seconds of time units, names of the Gregorian calendar.
NAMES = {"time": ("time",), "lat": ("lat", "latitude"), "lon": ("lon", "longitude")}
SECONDS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400, "week": 604800}
CALENDARS = {"standard", "gregorian", "proleptic_gregorian"}
SINCE = re.compile(r"\s*([a-z]+?)s?\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?\s*(?:z|utc|gmt|[+-]?0?0:?00)?\s*", re.I)
EPOCH = datetime(1970, 1, 1)


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: tuple[int, ...]
    attrs: dict
    dtype: np.dtype
    begin: int
    record: bool


@dataclass
class Header:
    attrs: dict
    dims: dict[str, int]
    variables: dict[str, Variable]
    stride: int  # bytes of one record of all record variables


def header(f, size: int) -> Header:
    """What an open file says of itself."""
    magic = f.read(4)
    if magic[:4] == b"\x89HDF":
        raise ValueError("a netCDF-4 file, which is HDF5: turn it with nccopy -k cdf5")
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no classic netCDF file")
    count, offset = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")

    def number(form: str = count) -> int:
        return struct.unpack(form, f.read(struct.calcsize(form)))[0]

    def padded(n: int) -> bytes:
        return f.read(n + -n % 4)[:n]

    def name() -> str:
        return padded(number()).decode()

    def entries(tag: int) -> range:
        found, n = number(">i"), number()
        if found not in (0, tag) or n < 0:
            raise ValueError(f"a list of the header has tag {found}, not {tag}")
        return range(n)

    def attributes() -> dict:
        out = {}
        for _ in entries(ATTRIBUTES):
            key, kind, n = name(), number(">i"), number()
            dtype = np.dtype(TYPES[kind])
            raw = padded(n * dtype.itemsize)
            out[key] = raw.decode(errors="replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, dtype).tolist()
        return out

    records = number()
    dims = [(name(), number()) for _ in entries(DIMENSIONS)]
    attrs, found = attributes(), []
    for _ in entries(VARIABLES):
        key = name()
        ids = [number() for _ in range(number())]
        own, kind, _, begin = attributes(), number(">i"), number(), number(offset)
        found.append((key, ids, own, np.dtype(TYPES[kind]), begin))
    over = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
    sizes = [math.prod(dims[d][1] for d in v[1][1:]) * v[3].itemsize for v in over]
    stride = sizes[0] if len(sizes) == 1 else sum(s + -s % 4 for s in sizes)  # a lone record variable is not padded
    if over and records < 0:  # written as a stream: counted by size
        records = (size - min(v[4] for v in over)) // stride
    length = {d: n or (records if over else 0) for d, n in dims}
    names = [d for d, _ in dims]
    variables = {k: Variable(k, [names[d] for d in ids], tuple(length[names[d]] for d in ids), own, t, begin, bool(ids) and dims[ids[0]][1] == 0) for k, ids, own, t, begin in found}
    return Header(attrs, length, variables, stride)


class File:
    def __init__(self, path: str):
        fs, at = _fs(path)
        self.file = fs.open_input_file(at)
        self.header = header(self.file, self.file.size())

    def raw(self, v: Variable, first: int, last: int) -> np.ndarray:
        """Entries first to last of a variable's first dimension, as stored, flat."""
        row = math.prod(v.shape[1:]) * v.dtype.itemsize
        if not v.record:
            self.file.seek(v.begin + first * row)
            raw = self.file.read((last - first) * row)
        else:
            raw = b"".join(self._at(v.begin + k * self.header.stride, row) for k in range(first, last))
        if len(raw) != (last - first) * row:
            raise ValueError(f"the file ends within {v.name}")
        return np.frombuffer(raw, v.dtype)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def values(self, v: Variable, first: int, last: int) -> np.ndarray:
        """Unpacked numbers; NaN where there is none."""
        raw = self.raw(v, first, last)
        x = raw.astype(np.float64)
        for key in ("_FillValue", "missing_value"):
            for gap in v.attrs.get(key, []):
                x[raw == gap] = np.nan
        return x * v.attrs.get("scale_factor", [1.0])[0] + v.attrs.get("add_offset", [0.0])[0]

    def coordinate(self, what: str, v: Variable) -> tuple[Variable, np.ndarray] | None:
        """A coordinate of a variable whose dimensions it shares: degrees, or microseconds since 1970."""
        for name, c in self.header.variables.items():
            if name.lower() in NAMES[what] and c.dims and set(c.dims) <= set(v.dims):
                x = self.values(c, 0, c.shape[0]).reshape(c.shape)
                return c, microseconds(x, c.attrs) if what == "time" else (x + 180) % 360 - 180 if what == "lon" else x
        return None

    def variable(self, name: str | None) -> Variable:
        known = self.header.variables
        if name is None:
            listed = {w for v in known.values() for w in str(v.attrs.get("coordinates", "")).split()}
            bounds = {str(v.attrs.get("bounds", "")) for v in known.values()}
            free = [k for k, v in known.items() if k not in self.header.dims and k not in listed | bounds and v.dims and v.dtype.kind != "S" and k.lower() not in sum(NAMES.values(), ())]
            if not free:
                raise ValueError("the file has no variable besides coordinates")
            return known[free[0]]
        if name not in known:
            raise ValueError(f"the file has no variable {name}, but {sorted(known)}")
        return known[name]


def microseconds(x: np.ndarray, attrs: dict) -> np.ndarray:
    """Counts of a unit since a date as whole microseconds since 1970."""
    if str(attrs.get("calendar", "standard")).lower() not in CALENDARS:
        raise ValueError(f"times of calendar {attrs['calendar']} are no dates")
    found = SINCE.fullmatch(str(attrs.get("units", "")))
    if not found or found[1].lower() not in SECONDS:
        raise ValueError(f"times in units {attrs.get('units')!r} cannot be read")
    day = datetime(int(found[2]), int(found[3]), int(found[4]), int(found[5] or 0), int(found[6] or 0))
    start = (day - EPOCH).total_seconds() + float(found[7] or 0)
    whole = np.floor(x)
    unit = SECONDS[found[1].lower()]
    return (whole * unit + start).astype(np.int64) * 1_000_000 + np.round((x - whole) * unit * 1e6).astype(np.int64)


@dataclass
class Block(InputPartition):
    path: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.name, self.task_bytes = options["path"], options.get("variable"), int(options.get("task_bytes", TASK_BYTES))
        self.ranges = {}
        for what in NAMES:
            low, high = options.get(f"{what}_from"), options.get(f"{what}_to")
            if low is not None or high is not None:
                plain = (lambda s: int((datetime.fromisoformat(s) - EPOCH).total_seconds() * 1_000_000)) if what == "time" else float
                self.ranges[what] = (plain(low) if low is not None else -math.inf, plain(high) if high is not None else math.inf)

    def _files(self) -> list[str]:
        fs, at = _fs(self.path)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            return [self.path]
        mark = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return [mark + i.path for i in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda x: x.path) if i.path.endswith(".nc")]

    def partitions(self) -> list[Block]:
        out = []
        for path in self._files():
            f = File(path)
            v = f.variable(self.name)
            placed = {d for what in NAMES if (c := f.coordinate(what, v)) for d in c[0].dims}
            if more := [d for d, n in zip(v.dims, v.shape, strict=True) if d not in placed and n > 1]:
                raise ValueError(f"{v.name} has dimensions without time and place: {more}")
            low, high = 0, v.shape[0]
            for what, (a, b) in self.ranges.items():
                c = f.coordinate(what, v)
                if c and c[0].dims == v.dims[:1]:
                    at = np.flatnonzero((c[1] >= a) & (c[1] <= b))
                    low, high = (max(low, int(at[0])), min(high, int(at[-1]) + 1)) if len(at) else (0, 0)
            step = max(1, self.task_bytes // max(1, math.prod(v.shape[1:]) * v.dtype.itemsize))
            out += [Block(path, k, min(k + step, high)) for k in range(low, high, step)]
        return out or [Block("", 0, 0)]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.path:
            return
        f = File(block.path)
        v = f.variable(self.name)
        own = {what: f.coordinate(what, v) for what in NAMES}
        width = math.prod(v.shape[1:])
        step = max(1, BATCH // max(1, width))
        for k in range(block.first, block.last, step):
            upto = min(k + step, block.last)
            at = dict(zip(v.dims, np.unravel_index(np.arange(k * width, upto * width), v.shape), strict=True))
            x = f.values(v, k, upto)
            cols = {what: c[1][tuple(at[d] for d in c[0].dims)] if c else None for what, c in own.items()}
            keep = np.ones(len(x), bool)
            for what, (a, b) in self.ranges.items():
                if cols[what] is not None:
                    keep &= (cols[what] >= a) & (cols[what] <= b)
            over = set(own["time"][0].dims) if own["time"] else set()
            space = [d for d in v.dims if d not in over]
            point = np.ravel_multi_index([at[d] for d in space], [f.header.dims[d] for d in space]) if space else np.zeros(len(x), int)
            n = int(keep.sum())
            time = pa.nulls(n, pa.timestamp("us")) if cols["time"] is None else pa.array(cols["time"][keep].astype("datetime64[us]"))
            place = [pa.nulls(n, pa.float64()) if cols[c] is None else pa.array(cols[c][keep]) for c in ("lat", "lon")]
            yield pa.RecordBatch.from_arrays([time, pa.array(point[keep].astype(np.int32)), *place, pa.array(x[keep], from_pandas=True)], ["time", "point", "lat", "lon", "value"])


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(attrs: dict) -> bytes:
    out = struct.pack(">ii", ATTRIBUTES if attrs else 0, len(attrs))
    for key, value in attrs.items():
        out += _text(key)
        if isinstance(value, str):
            out += struct.pack(">i", 2) + _text(value)
        elif isinstance(value, (bool, int)) and abs(value) < 2**31:
            out += struct.pack(">iii", 4, 1, value)
        else:
            out += struct.pack(">iid", 6, 1, float("nan") if value is None else value)
    return out


def field_header(name: str, times: int, points: int, attrs: dict) -> bytes:
    """The header of a CDF-2 file of lat(points), lon(points), time(time), name(time, points), all doubles, time being the record dimension."""
    listed = [
        ("lat", [1], {"units": "degrees_north"}, points * 8),
        ("lon", [1], {"units": "degrees_east"}, points * 8),
        ("time", [0], {"units": "seconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}, 8),
        (name, [0, 1], {"_FillValue": math.nan, "coordinates": "lat lon"}, points * 8),
    ]

    def made(start: int) -> bytes:
        out = b"CDF\x02" + struct.pack(">iii", times, DIMENSIONS, 2) + _text("time") + struct.pack(">i", 0) + _text("points") + struct.pack(">i", points)
        out += _attributes(attrs) + struct.pack(">ii", VARIABLES, len(listed))
        for key, dims, own, size in listed:
            out += _text(key) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + _attributes(own) + struct.pack(">iIq", 6, min(size, 2**32 - 1), start)
            start += size
        return out

    return made(len(made(0)))


class Writer(DataSourceArrowWriter):
    """A file a task; half-written files carry other names and are deleted."""

    def __init__(self, path: str, name: str, attrs: dict, overwrite: bool):
        self.path, self.name, self.attrs, self.overwrite = path, name, attrs, overwrite

    def _times(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(time, columns node, lat, lon, value) of each time, which comes in one piece and in order."""
        held, now = [], None
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in ("time", "node", "lat", "lon", "value")}
            if any(col[c].null_count for c in ("time", "node", "lat", "lon")):
                raise ValueError("a row lacks its time, node or place")
            t = col["time"].cast(pa.int64()).to_numpy()
            x = np.stack([col[c].to_numpy(zero_copy_only=False).astype(float) for c in ("node", "lat", "lon", "value")]) if len(t) else np.zeros((4, 0))
            ends = np.append(np.flatnonzero(np.diff(t)) + 1, len(t))
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                if hi > lo:
                    if held and t[lo] != now:
                        yield now, np.concatenate(held, 1)
                        held = []
                    now = t[lo]
                    held.append(x[:, lo:hi])
        if held:
            yield now, np.concatenate(held, 1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        points, times = None, 0
        with tempfile.TemporaryFile() as body:  # of this task alone: the header before it counts the times
            for t, x in self._times(iterator):
                if points is None:
                    points = x[:3]
                    if (np.diff(points[0]) <= 0).any():
                        raise ValueError("a time has a node twice, or nodes out of order")
                elif x.shape[1] != points.shape[1] or (x[:3] != points).any():
                    raise ValueError("each time needs the same points once: fill gaps with nulls")
                body.write(struct.pack(">d", t / 1e6) + x[3].astype(">f8").tobytes())
                times += 1
            if points is None:
                return Written(None, 0)
            fs, at = _fs(self.path)
            fs.create_dir(at)
            name = f"{at}/{uuid.uuid4().hex}.part"
            body.seek(0)
            with fs.open_output_stream(name) as f:
                f.write(field_header(self.name, times, points.shape[1], self.attrs) + points[1].astype(">f8").tobytes() + points[2].astype(">f8").tobytes())
                while part := body.read(TASK_BYTES):
                    f.write(part)
        return Written(name, times)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _fs(self.path)
        fs.create_dir(at)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.path.endswith(".nc")]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(at)
        for p in old:
            fs.delete_file(p)
        for k, m in enumerate(m for m in messages if m is not None and m.path):
            fs.move(m.path, f"{at}/part_{k:05d}.nc")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            if m is not None and m.path and fs.get_file_info(m.path).type != pafs.FileType.NotFound:
                fs.delete_file(m.path)


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("variable", "value"), json.loads(self.options.get("meta", "{}")), overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NetcdfSource)
    return spark


def read_field(spark: SparkSession, path: str, variable: str | None = None, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, time: tuple[str, str] | None = None, **options) -> DataFrame:
    """(time, point, lat, lon, value) within inclusive ranges, as tables.read_field gives from parquet."""
    given = {f"{what}_{end}": str(x) for what, r in (("lon", lon), ("lat", lat), ("time", time)) if r for end, x in zip(("from", "to"), r, strict=True)}
    if variable is not None:
        given["variable"] = variable
    return register(spark).read.format("netcdf").options(**given, **options).load(path)


def write_field(df: DataFrame, path: str, variable: str = "value", files: int = 8, meta: dict | None = None, overwrite: bool = False) -> None:
    """(time, node, lat, lon, value) as a folder of files, cut by time."""
    register(df.sparkSession)
    rows = df.select(F.col("time").cast("timestamp_ntz").alias("time"), "node", "lat", "lon", "value").repartitionByRange(files, "time").sortWithinPartitions("time", "node")
    rows.write.format("netcdf").options(variable=variable, meta=json.dumps(meta or {})).mode("overwrite" if overwrite else "append").save(path)


def read_attrs(path: str) -> dict:
    """A file's own attributes; numbers are lists."""
    return File(path).header.attrs
