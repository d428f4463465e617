import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusbench.operators.probe import batch_score
from corpusbench.sources import files as S
from corpusbench.sources import metrics_json as J
from corpusbench.sources import readers as R
from corpusbench.sources import sinks
from corpusbench.streaming import scoring as T


def test_folder_scan_reads_names_only(spark, tmp_path):
    for name in ("real/cam/a.JPG", "real/cam/b.txt", "real/x/c.png", "real/coco-val2017/d.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 10)
    listing = S.list_files(spark, str(tmp_path), S.IMAGE_EXTS)
    got = {(r.path.rsplit("/", 1)[1], r.generator, r.label) for r in S.folder_index(listing, F.lit(0)).collect()}
    assert got == {("a.JPG", "cam", 0), ("c.png", "x", 0)}
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    with pytest.raises(FileNotFoundError):
        S.folder_pair(listing.where("false"), listing.where("false"))


def test_natural_order(spark):
    df = spark.createDataFrame([("shard_10",), ("shard_2",), ("shard_1b",)], "n string")
    assert [r.n for r in df.orderBy(S.natural_key(F.col("n"))).collect()] == ["shard_1b", "shard_2", "shard_10"]


def test_metrics_scan(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"n": 3, "macro_accuracy": 0.5, "auroc": NaN,\n "per_architecture": {"a": {"n": 1, "recall": 1.0}},'
                                        ' "error_analysis": [{"kind": "fp", "rank": 1, "prob_ai": 0.9, "label": 0, "generator": "0123456789abcdef0123"}]}')
    (tmp_path / "summary.json").write_text('{"n": 9}')
    (tmp_path / "broken.json").write_text('{"n": 3, ')
    (tmp_path / "empty.json").write_text('{"dataset": "x"}')
    found = J.scan(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[1] for r in found.collect()) == ["empty.json", "good.json"]
    rec = J.normalize(found).collect()
    assert [r.name for r in rec] == ["good"] and rec[0].auroc is None and rec[0].n == 3
    assert rec[0].errors[0].generator == J.HASH_NAME and rec[0].errors[0].kind == "fp"
    assert [(r.table, r.key, r.recall) for r in J.breakdown(J.normalize(found)).collect()] == [("per_architecture", "a", 1.0)]
    assert J.scan(spark, str(tmp_path), only_summary=True).count() == 1


def test_progress_skips_torn_lines(spark, tmp_path):
    good = json.dumps({"image_path": "a", "pred": 0.5})
    (tmp_path / "p.jsonl").write_text(good + "\n" + json.dumps({"image_path": "b", "pred": None}) + "\n" + good[:12])
    got = {r.image_path: r.pred for r in T.read_progress(spark, str(tmp_path)).collect()}
    assert got == {"a": 0.5, "b": None}


def test_readers(spark):
    df = spark.createDataFrame([(bytearray(b"x"), None, "False"), (bytearray(b"y"), "bad", "True"), (bytearray(b"z"), "1", "True")],
                               "image_data binary, label string, nsfw_flag string")
    got = [(r.label, r.nsfw_flag, r.generator) for r in R.forensics_rows(df).collect()]
    assert got == [(0, False, ""), (1, True, "")]
    with pytest.raises(ValueError):
        R.split_select(spark.range(1), "nope")
    with pytest.raises(ValueError):
        R.url_metadata(spark.range(1), 1, 1.0, 1.0)
    urls = spark.createDataFrame([("http://a", "100", "x"), ("http://b", "x", "1"), ("ftp://c", "900", "900"), ("http://d", "900", "900")],
                                 "URL string, WIDTH string, HEIGHT string")
    assert sorted(r.resolved_url for r in R.url_metadata(urls, 256, 0.5, 0.5).collect()) == ["http://b", "http://d"]


def test_failed_row_does_not_fail_its_batch(spark):
    def model():
        def run(pdf: pd.DataFrame) -> pd.Series:
            if (pdf["x"] < 0).any():
                raise ValueError("negative")
            return pdf["x"] * 0.5

        return run

    df = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 0.4)], "id int, x double").coalesce(1)
    got = {r.id: (r.pred, r.error) for r in batch_score(df, model, ["id"]).collect()}
    assert got == {1: (0.5, None), 2: (None, "ValueError: negative"), 3: (0.2, None)}


def test_scratch_is_under_the_checkpoint_folder(spark):
    from corpusbench.session import materialize, scratch, shared_dir

    base = shared_dir(spark)
    assert base == shared_dir(spark) and spark.sparkContext.getCheckpointDir() is not None
    assert scratch(spark, "x").startswith(base) and scratch(spark, "x") != scratch(spark, "x")
    assert materialize(spark.range(5), "x").count() == 5


def test_first_seen_with_a_watermark(spark, tmp_path):
    rows = spark.range(60).selectExpr("id % 7 as k", "timestamp_seconds(id) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = T.first_seen(T.shard_stream(spark, str(tmp_path / "in"), rows.schema, None), "k", ("ts", "1 hour"))
    out = T.run_to_files(stream, "w", str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted(r.k for r in spark.read.schema(rows.schema).parquet(out).collect()) == list(range(7))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_document_is_one_json_value(spark, tmp_path, parts):
    rows = [(f"img/{k:03d}", None if k % 7 == 0 else k / 10, {"w": k}, [[k + 0.5], [None]], 'say "hi",\n{[') for k in range(50)] + [("img/001", 0.1, None, None, None)]
    df = spark.createDataFrame(rows, "image_path string, pred double, size struct<w int>, heatmap array<array<double>>, note string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = str(tmp_path / "preds.json")
    for _ in range(2):  # a second run replaces the document
        sinks.write_document(df, out, sinks.run_header(df, checkpoint="a\"b"), "image_path")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    doc = json.loads((tmp_path / "preds.json").read_text())
    assert (doc["checkpoint"], doc["n_images"], doc["n_scored"], doc["n_failed"]) == ('a"b', 51, 43, 8)
    assert [p["image_path"] for p in doc["predictions"]] == sorted(r[0] for r in rows)
    assert doc["predictions"][0] == {"image_path": "img/000", "pred": None, "size": {"w": 0}, "heatmap": [[0.5], [None]], "note": 'say "hi",\n{['}
    back, head = sinks.read_document(spark, out, "image_path string, pred double, size struct<w int>, heatmap array<array<double>>, note string")
    assert head == {k: v for k, v in doc.items() if k != "predictions"}
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_empty_document(spark, tmp_path):
    df = spark.createDataFrame([], "image_path string, pred double")
    sinks.write_document(df, str(tmp_path / "none.json"), sinks.run_header(df), "image_path")
    assert json.loads((tmp_path / "none.json").read_text()) == {"threshold": 0.5, "n_images": 0, "n_scored": 0, "n_failed": 0, "predictions": []}
    assert sinks.read_document(spark, str(tmp_path / "none.json"), "image_path string, pred double")[0].count() == 0


def test_slices_of_a_shard_are_replaced(spark, tmp_path):
    path = str(tmp_path / "slices")
    rows = spark.range(4000).select((F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("g/"), F.col("id") % 3).alias("generator"),
                                    (F.col("id") % 5).cast("int").alias("shard"), "id")
    sinks.write_slices(rows, path, list(range(5)), rows_per_file=40)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "slices").rglob("*.parquet")}
    assert all(pd.read_parquet(f).shape[0] <= 40 for f in files)
    again = rows.where("shard = 3 and label = 1").withColumn("id", -F.col("id"))
    for _ in range(2):
        sinks.write_slices(again, path, [3], rows_per_file=40)
        back = spark.read.parquet(path).select("label", "generator", "shard", "id")
        want = {tuple(r) for r in rows.where("shard <> 3").collect()} | {tuple(r) for r in again.collect()}
        got = [tuple(r) for r in back.collect()]
        assert set(got) == want and len(got) == len(want)
    kept = {f: t for f, t in files.items() if "shard=3" not in str(f)}
    assert kept == {f: f.stat().st_mtime_ns for f in kept}
    plan = spark.read.parquet(path).where("shard = 3 and generator = 'g/1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "generator" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    with pytest.raises(Exception, match="not named: 1"):
        sinks.write_slices(rows.where("shard = 1"), path, [3])
    assert spark.read.parquet(path).count() == len(want)
