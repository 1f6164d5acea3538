import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tesserae.sources import boards, order_store, sheets


def test_delimited():
    assert sheets.parse_delimited('﻿a,b\r\n"x ""y"", z",1\r"two\nlines",\n') == [["a", "b"], ['x "y", z', "1"], ["two\nlines", ""]]
    assert sheets.parse_delimited('a"b,c"d,e') == [["ab,cd", "e"]]
    assert sheets.parse_delimited("") == []
    assert [sheets.sniff(t) for t in ("a\tb,c", "a;b;c,d", "a,b;c", "abc")] == ["\t", ";", ",", "\t"]


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>be</t></r><r><t>ad</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row><c r="B2" t="s"><v>1</v></c><c r="AA2" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook():
    rows = sheets.parse_workbook(workbook())
    assert rows[0] == ["name", "", "2.5"] and rows[1][1] == "bead" and rows[1][26] == "far" and len(rows[1]) == 27


def test_read_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    (tmp_path / "b.xlsx").write_bytes(workbook())
    got = {(r.path.rsplit("/", 1)[-1], r.line): r.cells for r in sheets.read(spark, str(tmp_path)).collect()}
    assert got["a.csv", 1] == ["1", "2"] and got["b.xlsx", 0] == ["name", "", "2.5"] and len(got) == 4


ODD_SHEETS = {
    "quotes": '\ufeff \r\n\n name,"a ""q"" b\r\n,c"x,\r\n\n"é\n\n,",2\r"r\r""",3\nplain,4\n"",5,""""\n\n \t\n',
    "open": 'a;b\n1;2 ";\n3;4\n  \n',
    "tabs": "\n\nx\ty,z\t\t\n",
    "one": "a,b\t",
    "blank": " \n\r\n\t",
    "empty": "",
    "old": 'a,b\r"c\rd",e\r',
    "lines": "".join(f'{i},"{i}\n"\n' if i % 3 else f"{i},x\r\n" for i in range(12)),
}


@pytest.mark.parametrize("size", [1, 2, 5, 17, 1000])
def test_delimited_texts_cut_anywhere(spark, tmp_path, monkeypatch, size):
    """Blocks of `size` bytes; of 1: every place is a cut."""
    for name, text in ODD_SHEETS.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    write, names = sheets.materialise, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def in_blocks(df, name):
        old = [spark.conf.get(n) for n in names]
        for n in names if name == "pieces" else ():
            spark.conf.set(n, size)
        out = write(df, name)
        for n, value in zip(names, old, strict=True):
            spark.conf.set(n, value)
        return out

    monkeypatch.setattr(sheets, "materialise", in_blocks)
    found = sheets.read_delimited(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.line):
        name = r.path.rsplit("/", 1)[-1].removesuffix(".csv")
        assert r.line == len(got.setdefault(name, []))
        got[name].append(r.cells)
    assert got == {name: rows for name, text in ODD_SHEETS.items() if (rows := sheets.parse_delimited(text))}


def test_cells_are_those_of_the_whole_parser():
    rng = random.Random(3)
    for _ in range(3000):
        record = "".join(rng.choice('",,a"x') for _ in range(rng.randint(1, 12)))
        assert sheets.cells_of(record, ",") == sheets.parse_delimited(record, ",")[0]


@pytest.mark.parametrize("separator", [",", "\t"])
def test_sheet_round_trip(spark, tmp_path, separator):
    df = spark.createDataFrame([("a,\tb", 'q"x"', "1"), ("plain", "two", "3")], "a string, b string, c string")
    sheets.write(df, str(tmp_path / "o"), separator)
    assert sorted(map(tuple, sheets.read_plain(spark, str(tmp_path / "o"), separator).collect())) == sorted(map(tuple, df.collect()))
    assert {r.line for r in sheets.with_mark(df).collect()} == {'"a,\tb","q""x""",1', "plain,two,3"}


def test_boards(spark):
    texts = spark.createDataFrame([(1, "A1|#FAF4C8,.;.,B2|#zz;C3")], "grid_id int, text string")
    got = {(r.row, r.col): (r.code, r.hex) for r in boards.from_text(texts).collect()}
    assert got == {(0, 0): ("A1", "#FAF4C8"), (0, 1): (None, None), (1, 0): (None, None), (1, 1): ("B2", None), (2, 0): ("C3", None)}
    assert boards.blank(spark, 4, 3).count() == 12


def test_projects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type": "pattern", "version": 1, "name": "n", "gridData": "A1", "settings": {"brand": "b", "cropZoom": 1.5}}')
    (tmp_path / "b.json").write_text('{"type": "other", "gridData": "A1"}')
    (tmp_path / "c.json").write_text('{"type": "pattern"}')
    got = boards.read_projects(spark, str(tmp_path), "pattern").collect()
    assert [(r.name, r.settings.cropZoom) for r in got] == [("n", 1.5)]
    boards.write_projects(boards.read_projects(spark, str(tmp_path), "pattern"), str(tmp_path / "out"))
    assert boards.read_projects(spark, str(tmp_path / "out"), "pattern").count() == 1


def test_stores_and_gallery(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.json").write_text('{"id": 1}\n{broken\n')
    kind = "id int, status string"
    assert [tuple(r) for r in boards.read_latest(spark, [str(tmp_path / "none"), str(tmp_path / "old")], kind).filter("id is not null").collect()] == [(1, None)]
    assert boards.read_latest(spark, [str(tmp_path / "none")], kind).count() == 0
    gallery = spark.createDataFrame([(f"t{i}", i, "old") for i in range(20)], "title string, created_at int, note string")
    item = spark.createDataFrame([("t3", 99, "new")], gallery.schema)
    got = boards.into_gallery(gallery, item).collect()
    assert len(got) == 18 and got[0].note == "new" and sum(r.title == "t3" for r in got) == 1


def png(w, h, pixel):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(png(3, 2, lambda x, y: (x * 10, y * 20, 7)))
    (tmp_path / "y.png").write_bytes(b"no image")
    got = {(r.row, r.col): (r.r, r.g, r.b, r.a) for r in boards.read_images(spark, str(tmp_path)).collect()}
    assert got == {(y, x): (x * 10, y * 20, 7, 255) for y in range(2) for x in range(3)}


def test_crop_windows():
    assert boards.crop_window(100, 50, 10, 10) == (25.0, 0.0, 50.0, 50.0)
    assert boards.crop_window(100, 50, 10, 10, "contain") == (0.0, -25.0, 100.0, 100.0)
    assert boards.crop_window(100, 50, 10, 10, "stretch", 2.0) == (0.0, 0.0, 100.0, 50.0)
    assert boards.crop_window(100, 50, 10, 10, x=1.0)[0] == 50.0
    assert boards.page_capacity(10) == (73, 106)


def test_shared_folder(spark):
    from tesserae.session import materialise, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialise(spark.range(5).select(F.col("id").alias("x")), "t")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]


def _orders(spark, rows):
    return spark.createDataFrame(rows, "orderNo string, submittedAt string, contact string, note string, files array<struct<originalName:string,fileName:string,key:string,size:bigint,contentType:string,content:binary>>")


def _order(i, name="a.png", content=b"\x89PNG\r\n\x1a\n...", at="2024-01-10T17:30:00Z"):
    return (f"PB-0101-{i:05}", at, f"c{i}", None, [(name, "file-1.png", "k", len(content), "image/png", content), (name, "file-2.png", "k", len(content), "image/png", content + bytes([i % 256]))])


def test_orders_are_stored_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [_order(i) for i in range(30)] + [_order(3)] + [_order(40, content=b"no picture"), _order(41, at="2024-01-11T15:59:59Z")]
    bad = order_store.write(_orders(spark, rows).repartition(4), path).collect()
    assert [(r.orderNo, r.fault) for r in bad] == [("PB-0101-00040", "content")]
    got = {r.orderNo: r for r in order_store.read(spark, path).collect()}
    assert len(got) == 31 and order_store.read(spark, path).count() == 31 and not list(tmp_path.glob("store/_orders-*"))
    assert str(got["PB-0101-00003"].date) == "2024-01-11" == str(got["PB-0101-00041"].date)
    for r in got.values():
        assert [open(f.file_path, "rb").read() for f in r.files] == [bytes(f[5]) for f in next(x for x in rows if x[0] == r.orderNo)[4]]
    order_store.write(_orders(spark, rows), path)  # again: nothing new
    assert order_store.read(spark, path).count() == 31


def test_a_failed_job_leaves_no_order(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="late failure"):
        df = _orders(spark, [_order(i) for i in range(20)]).coalesce(1)
        failing = F.when(F.col("orderNo") == "PB-0101-00019", F.raise_error(F.lit("late failure"))).otherwise(F.col("contact"))
        order_store.write(df.withColumn("contact", failing.cast("string")), path)
    assert not list(tmp_path.glob("store/date=*")) and not list(tmp_path.glob("store/_orders-*"))


def test_a_task_that_is_killed_or_runs_twice(tmp_path):
    """The writer by hand: one attempt dies halfway, one finishes but is not the one that counts, one counts."""
    path = str(tmp_path / "store")
    rows = [Row(orderNo=f"PB-0101-{i:05}", submittedAt="x", contact=None, note=None, date="2024-01-10", files=[Row(originalName="a", fileName="file-1.png", key="k", size=1, contentType="", content=bytes([i]))]) for i in range(5)]
    writer = order_store._Writer(path)

    def dies():
        yield from rows[:3]
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(dies())
    writer.write(iter(rows))
    counts = writer.write(iter(rows))
    assert not list(tmp_path.glob("store/date=*"))
    writer.commit([counts, None])
    lines = [x for f in tmp_path.glob("store/date=2024-01-10/*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 5 and not list(tmp_path.glob("store/_orders-*"))
    assert [(tmp_path / f"store/files/PB-0101-{i:05}/file-1.png").read_bytes() for i in range(5)] == [bytes([i]) for i in range(5)]
    assert not list(tmp_path.glob("store/files/*/*.draft"))


@pytest.mark.parametrize("mode", ["cover", "contain", "stretch"])
@pytest.mark.parametrize(("zoom", "x", "y"), [(1.0, 0.0, 0.0), (1.7, -1.0, 0.4), (3.0, 0.9, -0.5)])
def test_area_resampling_is_an_integral(spark, mode, zoom, x, y):
    rng = np.random.default_rng(4)
    h, w, th, tw = 11, 17, 8, 6
    px = np.concatenate([rng.integers(0, 256, (h, w, 3)), rng.choice([0, 90, 255], (h, w, 1))], axis=2)
    window = boards.crop_window(w, h, tw, th, mode, zoom, x, y)

    def shares(n, to, origin, size):  # of each pixel in each cell
        edges = origin + size / to * np.arange(to + 1)
        return np.maximum(0, np.minimum(np.arange(n) + 1, edges[1:, None]) - np.maximum(np.arange(n), edges[:-1, None]))

    sy, sx = shares(h, th, window[1], window[3]), shares(w, tw, window[0], window[2])
    mean = lambda v: sy @ v @ sx.T
    weight = mean(px[..., 3].astype(float))
    want = np.stack([np.where(weight > 0, np.floor(mean(px[..., c] * px[..., 3].astype(float)) / np.where(weight > 0, weight, 1) + 0.5 + 1e-9), 0) for c in range(3)] + [np.floor(weight / (window[2] / tw * window[3] / th) + 0.5 + 1e-9)], axis=2)
    rows = [("g", r, c, *map(int, px[r, c])) for r in range(h) for c in range(w)]
    got = {(q.row, q.col): (q.r, q.g, q.b, q.a) for q in boards.resample_area(spark.createDataFrame(rows, "grid_id string, row int, col int, r int, g int, b int, a int"), window, tw, th).collect()}
    assert got == {(r, c): tuple(map(int, want[r, c])) for r in range(th) for c in range(tw)}


def test_windows_of_a_composition():
    assert boards.crop_window(40, 20, 10, 10, "stretch", 3.0, 1.0, 1.0) == (0.0, 0.0, 40.0, 20.0)
    assert boards.crop_window(40, 20, 10, 10, "cover", 1.0, -1.0, 1.0) == (0.0, 0.0, 20.0, 20.0)
    assert boards.crop_window(40, 20, 10, 10, "cover", 2.0, 1.0, 0.0) == (30.0, 5.0, 10.0, 10.0)
    assert boards.crop_window(40, 20, 10, 10, "contain", 1.0, 1.0, 1.0) == (0.0, -20.0, 40.0, 40.0)  # at the bottom of the target
    assert boards.crop_window(40, 20, 10, 10, "contain", 3.0, 1.0, 0.0)[0] == (40 - 40 / 3) / 2  # no room to move


def test_composed_texts(spark):
    import unicodedata

    from tesserae.functions.normal import nfc

    rng = random.Random(2)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["e", "a", "A", "o", "\u1100", "\u1161", "\u11a8", "\uac00", "\u09c7", "\u09be", "\u2126", "x"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None, "", "plain", "caf\u00e9"]
    texts += ["".join(map(chr, range(lo, lo + 64))) for lo in range(0, 0x30000, 64) if not 0xD800 <= lo < 0xE000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.n for r in df.select("i", nfc(F.col("t")).alias("n")).collect()} == {i: t and unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) for c in range(0x300))


def test_money_and_percent(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from tesserae.functions import money

    rng = random.Random(1)
    values = [None, float("nan"), 0.0, -0.0, 0.125, 1.005, -2.5, 1234567.895, 0.3525, 0.3515, -0.0004, -0.00051, 0.99949, 0.9995, 12.5, *[rng.uniform(-5, 5) for _ in range(500)], *[rng.randint(-4000, 4000) / 4000 for _ in range(500)]]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", money.money_text(F.col("v")).alias("m"), money.percent_text(F.col("v")).alias("p")).orderBy("i").collect()
    for v, r in zip(values, got, strict=True):
        v = 0.0 if v is None or v != v else v
        assert r.m.replace("-0.00", "0.00") == f"{Decimal(repr(v)).quantize(Decimal('0.01'), ROUND_HALF_UP):,}".replace("-0.00", "0.00")
        y = v * 100
        assert r.p == ("-" if y < 0 else "") + f"{Decimal(abs(y)).quantize(Decimal('0.1'), ROUND_HALF_UP)}%"


def test_composing_holds_few_texts():
    """F3 of round 3: a batch's texts were all held as Python's strings, twice."""
    import tracemalloc
    import unicodedata

    import pyarrow as pa
    from tesserae.functions.normal import composed

    text = "汉字e\u0301" * 20_000
    texts = pa.array([text] * 100 + [None, ""])
    tracemalloc.start()
    got = composed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [unicodedata.normalize("NFC", text)] * 100 + [None, ""] and peak < 40 * len(text)
