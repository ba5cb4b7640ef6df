"""Element files: every encoding read back, row ranges, hand-written files, errors."""

import io
import struct

import numpy as np
import pytest

from tessera.sources import elements


@pytest.fixture(scope="module")
def source(spark):
    elements.register(spark)
    return spark


@pytest.mark.parametrize("encoding", elements.FORMATS)
@pytest.mark.parametrize("compress", [None, "gzip", "bzip2"])
def test_round_trip(source, tmp_path, encoding, compress):
    rows = [(i, i * 0.1, f" a{i}\n é", [1.5 * i] * (i % 3), {"shape": [2, i % 2], "data": list(range(2 * (i % 2)))}) for i in range(25)] + [(25, float("inf"), "", [], {"shape": [0, 0], "data": []})]
    df = source.createDataFrame(rows, "id long, x double, t string, v array<float>, m struct<shape: array<long>, data: array<int>>").repartition(2)
    w = df.write.format("elements").option("encoding", encoding).option("element", "thing").mode("append")
    (w.option("compress", compress) if compress else w).save(f"{tmp_path}/out")
    got = source.read.format("elements").option("element", "thing").load(f"{tmp_path}/out").orderBy("id").collect()
    assert [(r.id, r.x, r.t, r.v.data, r.m.shape, r.m.data) for r in got] == [(i, x, t, v, m["shape"], m["data"]) for i, x, t, v, m in rows]


def test_row_ranges_and_types(source, tmp_path):
    names = list(elements.NUMBERS)
    for order, form in (("<", "binary_little_endian"), (">", "binary_big_endian")):
        image = elements.Element("pixel", [3, 7], [(n, n) for n in names])
        first = elements.Element("skipped", [5], [("a", "nat16")])
        h = elements.Header(form, [first, image], 0, type=["image"], meta={"k": "v w", "n": 3, "f": 0.5}, comments=["hello"])
        values = [tuple((200 if n[0] != "i" else -100) + i if n[0] != "r" else i / 4 for n in names) for i in range(21)]
        with open(f"{tmp_path}/{form}", "wb") as f:
            elements.write_file(f, h, [[(9,)] * 5, values])
        back = elements.header_of(f"{tmp_path}/{form}")
        assert back.meta == {"k": "v w", "n": 3, "f": 0.5} and back.comments == ["hello"] and back.type == ["image"]
        df = source.read.format("elements").option("element", "pixel").option("rows", 4).load(f"{tmp_path}/{form}")
        assert df.rdd.getNumPartitions() == 6
        got = df.orderBy("_i0", "_i1").collect()
        assert [(r._i0, r._i1) for r in got] == [(i // 7, i % 7) for i in range(21)]
        assert [tuple(float(r[n]) for n in names) for r in got] == [tuple(float(x) for x in v) for v in values]


def test_hand_written(source, tmp_path):
    text = "ply\nformat ascii 2.0\ntype mesh\nelement vertex 2\nproperty real32 x\nproperty string:nat8 s\nelement face 1\nproperty array:1:nat8:nat32 at\nend_header\n1.5 3  ab\n-2e1\n0 \n3 0 1 2\n"
    (tmp_path / "a.mesh").write_text(text)
    got = source.read.format("elements").load(f"{tmp_path}/a.mesh").collect()
    assert [(r.x, r.s) for r in got] == [(1.5, " ab"), (-20.0, "")]
    face = source.read.format("elements").option("element", "face").load(f"{tmp_path}/a.mesh").first()
    assert face["at"]["data"] == [0, 1, 2]
    raw = b"ply\nformat binary_big_endian 2.0\nelement e 2\nproperty int16 a\nproperty real64 b\nend_header\n" + struct.pack(">hdhd", -3, 0.5, 7, 1e9)
    (tmp_path / "b").write_bytes(raw)
    assert [tuple(r) for r in source.read.format("elements").load(f"{tmp_path}/b").collect()] == [(-3, 0.5), (7, 1e9)]


@pytest.mark.parametrize(
    "head, error",
    [("plx\nformat ascii 2.0\nend_header\n", ValueError), ("ply\nformat ascii 1.0\nend_header\n", ValueError), ("ply\nformat ascii 2.0\n", EOFError), ("ply\nformat ascii 2.0\nelement a 1\nproperty int128 x\nend_header\n", NotImplementedError), ("ply\nformat ascii 2.0\nproperty int8 x\nend_header\n", ValueError), ("ply\nformat ascii 2.0\nmeta string:nat32 k 9 ab\nend_header\n", ValueError)],
)
def test_bad_headers(head, error):
    with pytest.raises(error):
        elements.parse_header(io.BytesIO(head.encode()))


def test_no_end_and_short_bodies():
    with pytest.raises(BufferError):
        elements.parse_header(io.BytesIO(b"ply\nformat ascii 2.0\n" + b"comment\n" * elements.HEADER_LINES))
    h = elements.parse_header(io.BytesIO(b"ply\nformat ascii 2.0\nlength 5\nend_header\n"))
    with pytest.raises(EOFError):
        elements.read_body(io.BytesIO(b"123"), h)
    with pytest.raises(ValueError):
        elements._encoded(None, "int8", "<", True)
    assert np.isclose(float(elements._number(0.1, "real64")), 0.1)
