"""Tables that change together, fallbacks of stored manifests, unit index."""

import json

import pytest
from pyspark.sql import functions as F

from tabularium.operators import splits
from tabularium.sources import manifest as M, snapshots


@pytest.fixture
def root(spark, tmp_path):
    place = str(tmp_path / "runs")
    rows = spark.range(40).select(F.col("id").alias("task_id"))
    task = rows.select("task_id", (F.col("task_id") % 4).cast("int").alias("stage_no"), F.when(F.col("task_id") % 2 == 0, "a").otherwise("b").alias("model_type"),
                       F.when(F.col("task_id") % 5 > 0, F.col("task_id") + 100).alias("checkpoint_slot_id"))
    hot = spark.range(300).select(F.when(F.col("id") % 3 == 0, 2).otherwise(F.col("id") % 40).alias("task_id"))
    snapshots.replace(spark, place, {
        **{n: hot for n in ("epoch_metric_log", "fold_run_result", "convergence_diagnostic_summary", "checkpoint_file")}, "task": task,
        "checkpoint_slot": task.select("checkpoint_slot_id").dropna(), "stage_information": task.select("stage_no", "model_type", F.lit(False).alias("is_active")).distinct(),
    })
    return place


def test_a_stage_is_purged_in_one_version(spark, root):
    assert snapshots.current(spark, root)[0] == 0
    snapshots.reset_stage(spark, root, 2, "a")
    assert snapshots.current(spark, root)[0] == 1
    gone = {i for i in range(40) if i % 4 == 2}
    for name in snapshots.TASK_TABLES:
        assert not {r.task_id for r in snapshots.open_table(spark, root, name).collect()} & gone
    assert snapshots.open_table(spark, root, "epoch_metric_log").count() == sum(1 for i in range(300) if i % 3 and i % 40 not in gone)
    slots = {r[0] for r in snapshots.open_table(spark, root, "checkpoint_slot").collect()}
    assert slots == {i + 100 for i in range(40) if i % 5 and i not in gone}
    active = {(r.stage_no, r.model_type) for r in snapshots.open_table(spark, root, "stage_information").collect() if r.is_active}
    assert active == {(2, "a")}


def test_a_writer_lost_before_the_pointer_leaves_the_old_version(spark, root, monkeypatch):
    before = {n: snapshots.open_table(spark, root, n).count() for n in snapshots.TASK_TABLES}
    make = spark.createDataFrame

    def lost(*args, **kwargs):
        if len(args) > 1 and args[1] == snapshots.POINTER:
            raise ConnectionError("driver lost")
        return make(*args, **kwargs)

    monkeypatch.setattr(spark, "createDataFrame", lost)
    with pytest.raises(ConnectionError):
        snapshots.reset_stage(spark, root, 1, "b")
    monkeypatch.undo()
    assert snapshots.current(spark, root)[0] == 0 and {n: snapshots.open_table(spark, root, n).count() for n in snapshots.TASK_TABLES} == before
    snapshots.reset_stage(spark, root, 1, "b")  # again, by a new driver
    assert snapshots.current(spark, root)[0] == 1


def test_an_unknown_task_removes_nothing(spark, root):
    snapshots.purge_tasks(spark, root, spark.createDataFrame([(999,)], "task_id long"))
    assert snapshots.open_table(spark, root, "task").count() == 40 and snapshots.open_table(spark, root, "checkpoint_slot").count() == 32


def test_no_version(spark, tmp_path):
    assert snapshots.current(spark, str(tmp_path / "none")) == (-1, {})


def test_final_manifest_falls_back_to_the_folder(spark, tmp_path):
    for name in ("b/2.png", "a/1.png", "a/deep/3.png", "a/4.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    with pytest.warns(UserWarning, match="listing"):
        got = [(r["class"], r["filename"]) for r in M.load_final_manifest(spark, str(tmp_path / "none.csv"), str(tmp_path)).collect()]
    assert got == [("a", "1.png"), ("b", "2.png"), ("deep", "3.png")]
    with pytest.raises(ValueError, match="no manifest"):
        M.load_final_manifest(spark, str(tmp_path / "none.csv"), str(tmp_path / "empty"))
    path = M.scan_recursive(spark, str(tmp_path)).where("filename = '1.png'").first().path
    (tmp_path / "m.csv").write_text(f"path,class,filename\n{path},a,1.png\n")
    assert M.load_final_manifest(spark, str(tmp_path / "m.csv"), str(tmp_path)).count() == 1
    (tmp_path / "bad.csv").write_text("path,class,filename\n/nowhere.png,a,1.png\n")
    with pytest.raises(ValueError, match="not found"):
        M.load_final_manifest(spark, str(tmp_path / "bad.csv"), str(tmp_path))


def test_final_features(spark, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    with pytest.raises(FileNotFoundError):
        M.load_final_feature_set(spark, first, second)
    df = spark.createDataFrame([("p", "c", 1.0, 2, "t")], "path string, class string, u double, original_path int, note string")
    df.write.parquet(second)
    with pytest.warns(UserWarning, match="1 rows of features for 2"):
        assert M.load_final_feature_set(spark, first, second, spark.range(2))[1] == ["u"]
    df.withColumn("v", F.lit(3)).write.parquet(first)
    assert M.load_final_feature_set(spark, first, second, spark.range(1))[1] == ["u", "v"]
    (tmp_path / "three.csv").write_text("path,class,filename,w\np,c,f,0.5\n")
    assert M.load_final_feature_set(spark, str(tmp_path / "three.csv"), second)[1] == ["w"]
    df.drop("u").write.parquet(str(tmp_path / "four"))
    with pytest.raises(ValueError, match="no numeric"):
        M.load_final_feature_set(spark, str(tmp_path / "four"), second)


def test_natural_manifest_prefers_the_exported_folder(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(12).select("id", F.lit(3).alias("stage_id"), F.lit(0).alias("repeat_id"), (F.col("id") % 2).cast("int").alias("fold_id"), F.lit("train").alias("subset"))
    with pytest.raises(FileNotFoundError):
        M.natural_manifest(spark, root, 3)
    rows.drop("repeat_id").write.parquet(f"{root}/assignments")  # a filter without its column does not apply
    assert {r.id for r in M.natural_manifest(spark, root, 3, 4, 1).collect()} == {1, 3, 5, 7, 9, 11}
    rows.where("id < 4").write.partitionBy("stage_id", "repeat_id", "fold_id", "subset").parquet(f"{root}/subsets")
    assert {r.id for r in M.natural_manifest(spark, root, 3, 0, 1).collect()} == {1, 3}


def test_index_of_units(spark):
    rows = [(0, 0, "train", "a")] * 3 + [(0, 0, "train", None), (0, 0, "train", "null"), (0, 0, "validation", "b"), (0, 1, "train", "a")]
    df = spark.createDataFrame(rows, "repeat_id int, fold_id int, subset string, c string")
    got = {r.fold_id: r for r in splits.subset_index(df, ["repeat_id", "fold_id"], "c", "out").collect()}
    assert (got[0].n_train_natural, got[0].n_validation_natural, got[1].n_validation_natural) == (5, 1, 0)
    assert json.loads(got[0].train_class_count_json) == {"a": 3, "null": 2} and got[1].validation_class_count_json == "{}"
    assert got[0].validation_path == "out/repeat_id=0/fold_id=0/subset=validation"
    shares = {(r.fold_id, r.subset, r.c): r.percent for r in splits.subset_distribution(df, ["repeat_id", "fold_id"], "c").collect()}
    assert shares[0, "train", "a"] == 0.6 and shares[1, "train", "a"] == 1.0
