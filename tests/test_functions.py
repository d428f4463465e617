import os

import pytest
from pyspark.sql import functions as F

from corpusbench.functions import grids as G
from corpusbench.functions import headers as H
from corpusbench.functions import holdout
from corpusbench.functions import identity as I
from corpusbench.functions import labels as L


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, (bytes, bytearray)) else 'string'}" for k, v in values.items()))
    return row.select(col.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("AI", 1), ("", None), ("photo", 0), ("2", 2), (" 1 ", 1), ("no", 0), ("x", None)])
def test_labels(spark, raw, want):
    assert one(spark, L.normalize_label(F.col("a")), a=raw) == want


def test_label_map_and_flags(spark):
    assert one(spark, L.normalize_label(F.col("a"), {0: 1, 1: 0}), a="0") == 1
    assert one(spark, L.normalize_label(F.col("a"), {"7": 1}), a="07") == 1
    assert one(spark, L.to_bool(F.col("a")), a="False") is False
    assert one(spark, L.to_bool(F.col("a")), a=" Yes") is True


@pytest.mark.parametrize("path", ["/a//b/./c", "a/../b", "/../x", "../../y", "//h/p", "///z/", ".", "a/b/..", "", "a/../../b"])
def test_normpath(spark, path):
    assert one(spark, I.normpath(F.col("a")), a=path) == os.path.normpath(path)


def test_names(spark):
    assert one(spark, I.slug(F.col("a")), a="") == "unknown"
    assert one(spark, I.slug(F.col("a")), a=" a b/c ") == "a_b_c"
    assert one(spark, I.file_part(F.col("a"), 5), a="..ab cd ef") == "ab_cd"
    assert one(spark, I.shard_tag(F.col("a")), a="x/train-00001-of-00186.parquet") == "train-00001_00186"


@pytest.mark.parametrize("raw,want", [("['a', 'b']", ["a", "b"]), ("[]", []), ('""', []), ("['a'", []), ("['jpeg']", ["jpeg"])])
def test_parse_list(spark, raw, want):
    assert one(spark, L.parse_list(F.col("a")), a=raw) == want


def test_held_out(spark):
    assert one(spark, holdout.held_out_reason(F.col("a")), a="D:\\WildFake\\DALLE\\x.jpg") == "demo-val"
    assert one(spark, holdout.held_out_reason(F.col("a")), a="openfake/train/x.jpg") is None
    df = spark.createDataFrame([("s", "/x/coco-val2017/1.jpg")], "source string, path string")
    with pytest.raises(ValueError, match="demo-val"):
        holdout.assert_no_held_out(df, "source", F.col("path"))
    assert holdout.assert_no_held_out(df.where("false"), "source", F.col("path")).count() == 0


def jpeg(width, height):
    skipped = b"\xff\xe0\x00\x04ab" + b"\xff\xc4\x00\x03x"
    return b"\xff\xd8" + skipped + b"\xff\xc2\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" * 12


@pytest.mark.parametrize("data,want", [
    (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"x" * 8, (640, 480)),
    (b"GIF89a" + (320).to_bytes(2, "little") + (200).to_bytes(2, "little") + b"xx", (320, 200)),
    (jpeg(1024, 768), (1024, 768)),
    (b"\xff\xd8\xff\xd9", (None, None)),
])
def test_image_size(spark, data, want):
    col = H.image_size(F.col("a"), H.container(F.col("a")))
    got = one(spark, col, a=bytearray(data))
    assert (got["width"], got["height"]) == want


def test_magic_needs_size(spark):
    assert one(spark, H.magic_type(F.col("a")), a=bytearray(b"\xff\xd8" + b"x" * 100)) is None
    assert one(spark, H.magic_type(F.col("a")), a=bytearray(b"RIFF\0\0\0\0WEBP" + b"x" * 3000)) == "webp"


def test_sweeps():
    assert len(G.sweep_names("all")) == 15 and len(G.sweep_names("extra")) == 39
    assert len(G.sweep_names("all+extra")) == 54 and G.sweep_names("clean") is None
    with pytest.raises(ValueError, match="known"):
        G.kernel("nope")
    with pytest.raises(NotImplementedError):
        G.kernel("jpeg90")
    G.register_kernel("mine", G.k_shift(3.0))
    assert G.sweep_names("mine") == ["mine"]
    del G.KERNELS["mine"]


def test_mask_and_paste(spark):
    occ = F.array(*[F.lit(1.0 if i in (9, 10, 17) else 0.0) for i in range(64)])
    df = spark.range(1)
    b = df.select(G.mask_bbox(occ).alias("b")).first().b
    assert (b.y0, b.x0, b.y1, b.x1, b.area) == (1, 1, 3, 3, 3)
    assert df.select(G.mask_bbox(F.array_repeat(F.lit(0.0), 64)).alias("b")).first().b is None
    ones, zeros = F.array_repeat(F.lit(1.0), 64), F.array_repeat(F.lit(0.0), 64)
    got = df.select(G.paste(zeros, ones, occ).alias("x")).first().x
    assert [i for i, v in enumerate(got) if v] == [9, 10, 17]
    assert df.select(G.blend(zeros, ones, F.array_repeat(F.lit(0.25), 64)).alias("x")).first().x[0] == 0.25
