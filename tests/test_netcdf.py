"""Classic netCDF: files laid out by hand, and fields written and read back."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.sources import netcdf


def laid_out(version: int, shape=(5, 3, 4), records=True, more=False, units="hours since 1999-12-31 12:00", calendar=None) -> tuple[bytes, np.ndarray]:
    """Shorts t(time, lat, lon), packed, of which -1 is a gap; `more` adds a second record variable of one short, so that records are padded."""
    nn, off = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    n = lambda x: struct.pack(nn, x)
    name = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    text = lambda k, v: name(k) + struct.pack(">i", 2) + n(len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    num = lambda k, t, f, v: name(k) + struct.pack(">i", t) + n(1) + struct.pack(f, v) + b"\0" * (-struct.calcsize(f) % 4)
    attrs = lambda *a: (struct.pack(">i", 12) + n(len(a)) + b"".join(a)) if a else b"\0" * 4 + n(0)
    lengths = [0 if records else shape[0], *shape[1:]]
    raw = (np.arange(math.prod(shape)) % 50 - 1).reshape(shape).astype(">i2")
    time = [text("units", units)] + ([text("calendar", calendar)] if calendar else [])
    cols = [
        ("lat", [1], attrs(text("units", "degrees_north")), 5, np.linspace(-10, 10, shape[1]).astype(">f4")),
        ("lon", [2], attrs(), 6, np.array([0.0, 90.0, 200.0, 350.0][: shape[2]]).astype(">f8")),
        ("time", [0], attrs(*time), 6, (np.arange(shape[0]) * 6.5).astype(">f8")),
        ("t", [0, 1, 2], attrs(num("scale_factor", 6, ">d", 0.5), num("add_offset", 6, ">d", 10.0), num("_FillValue", 3, ">h", -1)), 3, raw),
    ]
    if more:
        cols.append(("flag", [0], attrs(), 3, np.arange(shape[0]).astype(">i2")))

    def made(starts):
        out = b"CDF" + bytes([version]) + n(shape[0] if records else 0) + struct.pack(">i", 10) + n(3)
        for d, k in zip(("time", "lat", "lon"), lengths, strict=True):
            out += name(d) + n(k)
        out += attrs(text("title", "by hand")) + struct.pack(">i", 11) + n(len(cols))
        for (key, dims, own, kind, x), start in zip(cols, starts, strict=True):
            size = x[0].nbytes if records and dims[0] == 0 else x.nbytes
            out += name(key) + n(len(dims)) + b"".join(n(d) for d in dims) + own + struct.pack(">i", kind) + n(size + -size % 4) + struct.pack(off, start)
        return out

    fixed = [c for c in cols if not (records and c[1][0] == 0)]
    over = [c for c in cols if records and c[1][0] == 0]
    at, starts = len(made([0] * len(cols))), {}
    for c in fixed:
        starts[c[0]] = at
        at += c[4].nbytes + -c[4].nbytes % 4
    for c in over:
        starts[c[0]] = at
        at += c[4][0].nbytes + -c[4][0].nbytes % 4
    out = made([starts[c[0]] for c in cols])
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    out += b"".join(pad(c[4].tobytes()) for c in fixed)
    for k in range(shape[0] if over else 0):
        out += b"".join(pad(c[4][k : k + 1].tobytes()) for c in over)
    return out, raw


@pytest.mark.parametrize("version,records,more", [(1, True, False), (1, False, False), (2, True, True), (5, True, True), (5, False, False)])
def test_reads_files_laid_out_by_hand(spark, tmp_path, version, records, more):
    data, raw = laid_out(version, records=records, more=more)
    (tmp_path / "a.nc").write_bytes(data)
    df = netcdf.read_field(spark, str(tmp_path / "a.nc"), task_bytes=48)
    got = {(str(r["time"]), round(r["lat"], 4), r["lon"]): (r["point"], r["value"]) for r in df.collect()}
    assert len(got) == raw.size and df.rdd.getNumPartitions() == 3
    lons, lats = [0.0, 90.0, -160.0, -10.0], [-10.0, 0.0, 10.0]
    stamps = [str(np.datetime64("1999-12-31T12:00") + np.timedelta64(390 * k, "m")).replace("T", " ") + ":00" for k in range(5)]
    for (k, i, j), v in np.ndenumerate(raw):
        assert got[stamps[k], lats[i], lons[j]] == (i * 4 + j, None if v == -1 else v * 0.5 + 10)
    assert netcdf.read_attrs(str(tmp_path / "a.nc")) == {"title": "by hand"}
    some = netcdf.read_field(spark, str(tmp_path / "a.nc"), "t", lon=(-20, 0), lat=(0, 90), time=("1999-12-31 18:30:00", "2000-01-01 01:00:00"), task_bytes=24)
    assert some.count() == 2 * 2 * 2 and some.rdd.getNumPartitions() == 2
    assert netcdf.read_field(spark, str(tmp_path / "a.nc"), time=("2001-01-01", "2002-01-01")).count() == 0
    if more:
        assert [r["value"] for r in netcdf.read_field(spark, str(tmp_path / "a.nc"), "flag").orderBy("time").collect()] == [0, 1, 2, 3, 4]


def test_refuses_what_it_cannot_read(spark, tmp_path):
    cases = {"HDF5": b"\x89HDF\r\n\x1a\n", "no classic": b"plain text", "calendar": laid_out(1, calendar="360_day")[0], "units": laid_out(1, units="months since 2000-01-01")[0], "ends within": laid_out(1)[0][:-30]}
    for said, data in cases.items():
        (tmp_path / "x.nc").write_bytes(data)
        with pytest.raises(Exception, match=said):
            netcdf.read_field(spark, str(tmp_path / "x.nc")).collect()
    (tmp_path / "x.nc").write_bytes(laid_out(1)[0])
    with pytest.raises(Exception, match="no variable"):
        netcdf.read_field(spark, str(tmp_path / "x.nc"), "u").count()


def test_variables_without_time_or_place(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(laid_out(2, more=True)[0])
    rows = netcdf.read_field(spark, str(tmp_path / "a.nc"), "lat").collect()
    assert [(r["time"], r["point"], r["lat"], r["lon"], r["value"]) for r in rows] == [(None, k, x, None, x) for k, x in enumerate((-10.0, 0.0, 10.0))]
    var = struct.pack(">ii", 11, 1) + struct.pack(">i", 3) + b"lsm\0" + struct.pack(">iiiiiii", 1, 0, 0, 0, 1, 4, 88)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">iii", 10, 1, 6) + b"points\0\0" + struct.pack(">i", 3) + struct.pack(">ii", 0, 0) + var
    (tmp_path / "m.nc").write_bytes(head[:-4] + struct.pack(">i", len(head)) + bytes([1, 0, 1, 0]))
    with pytest.raises(Exception, match="without time and place"):
        netcdf.read_field(spark, str(tmp_path / "m.nc")).count()


def field(spark, days=20, nodes=6):
    d = spark.range(days).select(F.expr("date_add(DATE'1959-12-25', CAST(id AS INT))").alias("time")).join(spark.range(nodes).select(F.col("id").cast("int").alias("node")))
    return d.withColumns({"lat": F.col("node") * 1.5, "lon": F.col("node") * -2.25, "value": F.when(F.col("node") != 2, F.dayofyear("time") + F.col("node") / 7)})


def test_writes_and_reads_back(spark, tmp_path):
    df = field(spark)
    netcdf.write_field(df, str(tmp_path / "f"), "tp", files=4, meta={"grid_step": 2.5, "an": 1, "name": "trial"})
    back = netcdf.read_field(spark, f"file://{tmp_path}/f")
    assert len(list((tmp_path / "f").glob("*.nc"))) > 1 and not list((tmp_path / "f").glob("*.part"))
    rows = lambda x, p: sorted((str(r["time"])[:10], r[p], r["lat"], r["lon"], -1.0 if r["value"] is None else r["value"]) for r in x.collect())
    assert rows(back, "point") == rows(df, "node")
    assert netcdf.read_attrs(str(next((tmp_path / "f").glob("*.nc")))) == {"grid_step": [2.5], "an": [1], "name": "trial"}
    with pytest.raises(Exception, match="FileExistsError"):
        netcdf.write_field(df, str(tmp_path / "f"))
    netcdf.write_field(df.filter("node < 3"), str(tmp_path / "f"), files=2, overwrite=True)
    assert netcdf.read_field(spark, str(tmp_path / "f")).count() == 60
    netcdf.write_field(df.filter("false"), str(tmp_path / "none"))
    assert netcdf.read_field(spark, str(tmp_path / "none")).count() == 0


def test_gaps_and_repeats_are_refused(spark, tmp_path):
    df = field(spark, 3)
    for bad, said in ((df.filter("node <> 1 OR dayofmonth(time) <> 26"), "same points"), (df.union(df), "twice"), (df.withColumn("lat", F.lit(None).cast("double")), "lacks")):
        with pytest.raises(Exception, match=said):
            netcdf.write_field(bad, str(tmp_path / "bad"), files=1)
        assert not list((tmp_path / "bad").glob("*.nc"))
