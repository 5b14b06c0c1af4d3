"""Gridded files in the classic NetCDF format (versions 1, 2 and 5), read by hyperslabs.

The header is a list of dimensions, attributes and variables with the place where each
begins; a variable's values follow in row order, a record variable's record by record. A scan
reads the header and the axes, then for each of a task's times only the rows of the grid
that a box needs.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from .stores import StagedWriter, Stretch, files_of, located, stretches

# Fixed values of the format: types by number, tags of the header's lists.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12

TIME, LEVEL, LAT, LON = "time", "lev", "lat", "lon"


@dataclass
class Variable:
    name: str
    dims: list[str]
    facts: dict
    dtype: np.dtype
    begin: int
    record: bool


@dataclass
class Header:
    dims: dict[str, int]
    facts: dict
    variables: dict[str, Variable]
    record_bytes: int


class _Cursor:
    """Reads a header, fetching more of the file as it goes."""

    def __init__(self, file):  # noqa: ANN001
        self.file, self.data, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            self.file.seek(len(self.data))
            more = self.file.read(max(8192, self.at + n - len(self.data)))
            if not more:
                raise ValueError("the header is cut short")
            self.data += more
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, wide: int = 4) -> int:
        return int.from_bytes(self.take(wide), "big")


def read_header(file) -> Header:  # noqa: ANN001
    """The header of a classic NetCDF file; other formats are refused."""
    c = _Cursor(file)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file (NetCDF-4 files are HDF5)")
    count = 8 if magic[3] == 5 else 4
    offset = 4 if magic[3] == 1 else 8
    records = c.number(count)

    def padded(n: int) -> bytes:
        out = c.take(n)
        c.take(-n % 4)
        return out

    def name() -> str:
        return padded(c.number(count)).decode()

    def items(tag: int) -> range:
        found, n = c.number(), c.number(count)
        if found not in (0, tag):
            raise ValueError("the header isn't one of a NetCDF file")
        return range(n)

    def facts() -> dict:
        out = {}
        for _ in items(_ATTRIBUTE):
            key, kind = name(), c.number()
            n = c.number(count)
            dtype = np.dtype(_TYPES[kind])
            raw = padded(n * dtype.itemsize)
            out[key] = raw.decode("utf-8", "replace").rstrip("\x00") if kind == 2 else np.frombuffer(raw, dtype).tolist()
            if kind != 2 and n == 1:
                out[key] = out[key][0]
        return out

    lengths = [(name(), c.number(count)) for _ in items(_DIMENSION)]
    everywhere = facts()
    variables, sizes = {}, []
    for _ in items(_VARIABLE):
        own = name()
        dims = [lengths[c.number(count)] for _ in range(c.number(count))]
        about = facts()
        dtype = np.dtype(_TYPES[c.number()])
        c.number(count)  # the stated size, which a large variable overflows
        begin, record = c.number(offset), bool(dims) and dims[0][1] == 0
        variables[own] = Variable(own, [d for d, _ in dims], about, dtype, begin, record)
        if record:
            sizes.append(dtype.itemsize * int(np.prod([n for _, n in dims[1:]], dtype=np.int64)))
    if records == (1 << 8 * count) - 1:
        raise ValueError("the number of records isn't stated (a file still being written)")
    record_bytes = sizes[0] if len(sizes) == 1 else sum(s + -s % 4 for s in sizes)
    return Header({n: size or records for n, size in lengths}, everywhere, variables, record_bytes)


def hyperslab(file, header: Header, variable: Variable, lead: tuple[int, ...], rows: slice) -> np.ndarray:  # noqa: ANN001
    """Rows of one grid of a variable: ``lead`` are its indices on the axes before the last two. One seek, one read."""
    shape = [header.dims[d] for d in variable.dims]
    wide, item = shape[-1], variable.dtype.itemsize
    start, ahead = variable.begin, list(lead)
    if variable.record:
        start += ahead.pop(0) * header.record_bytes
        shape = shape[1:]
    flat = 0
    for k, n in zip(ahead, shape):
        flat = flat * n + k
    start += (flat * shape[-2] + rows.start) * wide * item
    n = (rows.stop - rows.start) * wide
    file.seek(start)
    return _values(np.frombuffer(file.read(n * item), variable.dtype).reshape(-1, wide), variable.facts)


def axis(file, header: Header, name: str) -> np.ndarray:  # noqa: ANN001
    """The values of a variable of one dimension."""
    v = header.variables[name]
    n = header.dims[v.dims[0]]
    if not v.record:
        file.seek(v.begin)
        return _values(np.frombuffer(file.read(n * v.dtype.itemsize), v.dtype), v.facts)
    out = []
    for k in range(n):
        file.seek(v.begin + k * header.record_bytes)
        out.append(file.read(v.dtype.itemsize))
    return _values(np.frombuffer(b"".join(out), v.dtype), v.facts)


def _values(raw: np.ndarray, facts: dict) -> np.ndarray:
    out = raw.astype(float)
    for gone in ("_FillValue", "missing_value"):
        if gone in facts and not isinstance(facts[gone], (str, list)):
            out[raw == np.array(facts[gone]).astype(raw.dtype)] = np.nan
    return out * facts.get("scale_factor", 1.0) + facts.get("add_offset", 0.0)


_STEPS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def clock(facts: dict, values: np.ndarray) -> list[datetime]:
    """Times from "<unit>s since <instant>", or a unit with begin_date (YYYYMMDD) and begin_time (HHMMSS)."""
    units = str(facts.get("units", ""))
    unit = next((s for u, s in _STEPS.items() if units.lower().startswith(u)), None)
    if unit is None:
        raise ValueError(f"no unit of time in {units!r}")
    if "begin_date" in facts:
        begin = datetime.strptime(f"{int(facts['begin_date']):08d}{int(facts.get('begin_time', 0)):06d}", "%Y%m%d%H%M%S")
    else:
        found = re.search(r"since\s+(\d+)-(\d+)-(\d+)(?:[ T](\d+):(\d+)(?::(\d+))?)?", units)
        if not found:
            raise ValueError(f"no instant in {units!r}")
        begin = datetime(*(int(x or 0) for x in found.groups()))
    return [begin + timedelta(seconds=float(v) * unit) for v in values]


def within(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Indices of an axis between two bounds, both included; axes may rise or fall."""
    return np.flatnonzero((values >= low) & (values <= high))


def in_order(values: np.ndarray, wanted: list[float]) -> list[int]:
    """The index of each wanted level, in the order asked for; a level that isn't there stops the scan."""
    out = []
    for w in wanted:
        k = np.flatnonzero(np.isclose(values, w))
        if not len(k):
            raise ValueError(f"no level {w} among {values.tolist()}")
        out.append(int(k[0]))
    return out


def _grid_variables(header: Header, asked: list[str]) -> tuple[list[str], bool]:
    """The variables of a scan, and whether they have levels; all must lie on the same axes."""
    flat, deep = [TIME, LAT, LON], [TIME, LEVEL, LAT, LON]
    names = asked or [n for n, v in header.variables.items() if v.dims in (flat, deep)]
    missing = [n for n in names if n not in header.variables]
    if missing:
        raise ValueError(f"no variable {', '.join(missing)}")
    kinds = {tuple(header.variables[n].dims) for n in names}
    if len(kinds) != 1 or [*kinds][0] not in (tuple(flat), tuple(deep)):
        raise ValueError(f"{names} must all lie on ({', '.join(flat)}) or all on ({', '.join(deep)})")
    return names, kinds == {tuple(deep)}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.suffix = options["path"], options.get("suffix", ".nc")
        self.box = [float(x) for x in options["box"].split(",")] if "box" in options else [-np.inf, np.inf] * 2
        self.levels = [float(x) for x in options["levels"].split(",")] if "levels" in options else None
        self.wide = int(options.get("stretch", 64 << 20))
        self.names = [f.name for f in schema if f.name not in ("file", TIME, LEVEL, LAT, LON)]
        self.columns = [f.name for f in schema]

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, self.suffix, self.wide)

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_file(part.place) as file:
            header = read_header(file)
            names, deep = _grid_variables(header, self.names)
            times = clock(header.variables[TIME].facts, axis(file, header, TIME))
            lat, lon = axis(file, header, LAT), axis(file, header, LON)
            rows, across = within(lat, *self.box[:2]), within(lon, *self.box[2:])
            if not len(rows) or not len(across):
                return
            span = slice(int(rows[0]), int(rows[-1]) + 1)
            every = axis(file, header, LEVEL) if deep else np.zeros(1)
            levels = (in_order(every, self.levels) if self.levels else range(len(every))) if deep else [None]
            n = len(rows) * len(across)
            place = {"file": pa.array([part.place.rsplit("/", 1)[-1]] * n), LAT: pa.array(np.repeat(lat[rows], len(across))), LON: pa.array(np.tile(lon[across], len(rows)))}
            for t in range(len(times) * part.part // part.parts, len(times) * (part.part + 1) // part.parts):
                for level in levels:
                    lead = (t,) if level is None else (t, level)
                    got = place | {TIME: pa.array([times[t]] * n, pa.timestamp("us"))}
                    if level is not None:
                        got[LEVEL] = pa.array(np.full(n, every[level]))
                    for name in names:
                        x = hyperslab(file, header, header.variables[name], lead, span)[:, across].ravel()
                        got[name] = pa.array(x, mask=np.isnan(x))
                    yield pa.RecordBatch.from_arrays([got[c] for c in self.columns], self.columns)


def classic_file(axes: dict[str, np.ndarray], begin: datetime, variables: dict[str, np.ndarray], facts: dict[str, str] | None = None) -> bytes:
    """A NetCDF file (version 2) of variables on the axes; times are minutes since ``begin``, NaN is the fill value.

    Time is the record dimension. ``axes``: time (minutes), lev if there are levels, lat, lon.
    """
    fill = -9999.0
    text = lambda s: struct.pack(">I", len(s)) + s + bytes(-len(s) % 4)

    def attribute(key: str, value: str | float | int) -> bytes:
        if isinstance(value, str):
            return text(key.encode()) + struct.pack(">I", 2) + text(value.encode())
        kind, form = (6, ">d") if isinstance(value, float) else (4, ">i")
        return text(key.encode()) + struct.pack(">II", kind, 1) + struct.pack(form, value)

    def listed(tag: int, parts: list[bytes]) -> bytes:
        return struct.pack(">II", tag if parts else 0, len(parts)) + b"".join(parts)

    names = list(axes)
    number = {n: k for k, n in enumerate(names)}
    about = {TIME: {"units": "minutes", "begin_date": int(f"{begin:%Y%m%d}"), "begin_time": int(f"{begin:%H%M%S}")}}
    arrays = {n: np.asarray(axes[n], ">f8") for n in names} | {n: np.where(np.isnan(x), fill, x).astype(">f8") for n, x in variables.items()}
    dims = {n: [n] if n in number else names for n in arrays}
    size = lambda n: arrays[n].nbytes // (len(axes[TIME]) if dims[n][0] == TIME else 1)

    def head(begins: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">I", len(axes[TIME]))
        out += listed(_DIMENSION, [text(n.encode()) + struct.pack(">I", 0 if n == TIME else len(axes[n])) for n in names])
        out += listed(_ATTRIBUTE, [attribute(k, v) for k, v in (facts or {}).items()])
        parts = []
        for n in arrays:
            own = about.get(n, {} if n in number else {"_FillValue": fill})
            ids = b"".join(struct.pack(">I", number[d]) for d in dims[n])
            parts.append(text(n.encode()) + struct.pack(">I", len(dims[n])) + ids + listed(_ATTRIBUTE, [attribute(k, v) for k, v in own.items()]) + struct.pack(">IIQ", 6, size(n), begins[n]))
        return out + listed(_VARIABLE, parts)

    at, begins = len(head(dict.fromkeys(arrays, 0))), {}
    fixed = [n for n in arrays if dims[n][0] != TIME]
    by_record = [n for n in arrays if dims[n][0] == TIME]
    for n in [*fixed, *by_record]:
        begins[n] = at
        at += size(n)
    body = b"".join(arrays[n].tobytes() for n in fixed)
    body += b"".join(arrays[n][t : t + 1].tobytes() for t in range(len(axes[TIME])) for n in by_record)
    return head(begins) + body


class _Writer(StagedWriter):
    """One file for each value of ``file``; its rows must all be in one task."""

    def __init__(self, path: str, overwrite: bool, names: list[str], deep: bool):
        super().__init__(path, overwrite)
        self.names, self.deep = names, deep

    def put(self, batches: Iterator[pa.RecordBatch], begin) -> Iterator[str]:  # noqa: ANN001
        kinds = pa.schema([("file", pa.string()), (TIME, pa.timestamp("us")), *([(LEVEL, pa.float64())] if self.deep else []), (LAT, pa.float64()), (LON, pa.float64()), *((n, pa.float64()) for n in self.names)])
        held = [pa.Table.from_batches([b]).select(kinds.names).cast(kinds) for b in batches if len(b)]
        if not held:
            return
        table = pa.concat_tables(held)
        places = table.column("file").combine_chunks().dictionary_encode()
        which = places.indices.to_numpy()
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(places.dictionary) + 1))
        for k, name in enumerate(places.dictionary.to_pylist()):
            own = table.take(order[cuts[k] : cuts[k + 1]])
            with begin(f"{name}.nc") as out:
                out.write(self._file(own))
            yield f"{name}.nc"

    def _file(self, own: pa.Table) -> bytes:
        dims = [TIME, LEVEL, LAT, LON] if self.deep else [TIME, LAT, LON]
        micros = own.column(TIME).cast(pa.int64()).to_numpy()
        given = {TIME: micros} | {d: own.column(d).to_numpy() for d in dims[1:]}
        axes, place = {}, []
        for d in dims:
            axes[d], at = np.unique(given[d], return_inverse=True)
            place.append(at)
        shape = [len(axes[d]) for d in dims]
        flat = np.ravel_multi_index(place, shape)
        if len(np.unique(flat)) != len(flat):
            raise ValueError("two rows for one cell")
        begin = datetime(1970, 1, 1) + timedelta(microseconds=int(micros.min()))
        begin = begin.replace(microsecond=0)
        axes[TIME] = (axes[TIME] - int((begin - datetime(1970, 1, 1)).total_seconds()) * 1_000_000) / 60e6
        variables = {}
        for n in self.names:
            x = np.full(int(np.prod(shape)), np.nan)
            x[flat] = own.column(n).to_numpy(zero_copy_only=False).astype(float)
            variables[n] = x.reshape(shape)
        return classic_file(axes, begin, variables)


class NetcdfGrids(DataSource):
    """Format ``netcdf_grid``.

    Read options: path (a file or a folder), suffix (.nc), variables (commas between; all on the
    grid if left out), box (lat_min,lat_max,lon_min,lon_max, bounds included), levels (values, in
    the order wanted), stretch (bytes a task). Rows: file, time, lev where there are levels, lat,
    lon and a column for each variable, null at the fill value.

    Written columns: file, time, lev if any, lat, lon, variables; cells not given are filled.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf_grid"

    def schema(self) -> str:
        path = self.options["path"]
        first, _ = files_of(path, self.options.get("suffix", ".nc"))[0]
        store, _ = located(path)
        with store.open_input_file(first) as f:
            names, deep = _grid_variables(read_header(f), list(filter(None, self.options.get("variables", "").split(","))))
        return ", ".join(["file string", "time timestamp_ntz", *(["lev double"] if deep else []), "lat double", "lon double", *(f"`{n}` double" for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        names = [f.name for f in schema if f.name not in ("file", TIME, LEVEL, LAT, LON)]
        return _Writer(self.options["path"], overwrite, names, LEVEL in schema.names)


def read_grids(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Cells of classic NetCDF files: see NetcdfGrids for options and columns."""
    spark.dataSource.register(NetcdfGrids)
    return spark.read.format("netcdf_grid").options(path=path, **options).load()


def write_grids(df: DataFrame, path: str) -> None:
    """Rows (file, time, lev?, lat, lon, variables) as one NetCDF file for each ``file``, all published at once.

    A file's rows meet in one task, which holds its grid.
    """
    df.sparkSession.dataSource.register(NetcdfGrids)
    df.repartition("file").write.format("netcdf_grid").option("path", path).mode("overwrite").save()
