"""Semantics that are easy to get wrong, on small hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions import scalars as S
from tabularium.functions import tails
from tabularium.functions.search_space import parse
from tabularium.operators import matrix, monitor, outliers, relate, runs, selection, splits, states, stats, tables
from tabularium.operators.skew import grouped_quantiles
from tabularium.plans import curriculum
from tabularium.sources import logs, manifest as M

COUNTS = {"c0": 191, "c1": 204, "c2": 195, "c3": 208, "c4": 209, "c5": 200, "c6": 203, "c7": 196, "c8": 205, "c9": 190}
DEV = {"c0": 172, "c1": 184, "c2": 175, "c3": 187, "c4": 188, "c5": 180, "c6": 183, "c7": 176, "c8": 184, "c9": 171}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"{c}-{i}", c) for c, n in COUNTS.items() for i in range(n)]
    return spark.createDataFrame(rows, "id STRING, cls STRING")


def test_published_split_sizes(items):
    got = {(r["cls"], r["split"]): r["count"] for r in splits.global_split(items, "id", "cls").groupBy("cls", "split").count().collect()}
    assert sum(v for (c, s), v in got.items() if s == "development") == 1800
    assert sum(v for (c, s), v in got.items() if s == "holdout_test") == 201
    assert {c: got[c, "development"] for c in DEV} == DEV


def test_published_stage_sizes(items):
    dev = splits.global_split(items, "id", "cls").where("split = 'development'").drop("split")
    assigned = curriculum.assignments(dev, "id", "cls").cache()
    sizes = {r["stage_id"]: r for r in splits.size_summary(assigned, "stage_id", ["repeat_id", "fold_id"]).collect()}
    assert [sizes[s]["n_units"] for s in range(1, 6)] == [1, 1, 5, 5, 25]
    assert [(sizes[s]["min_train"], sizes[s]["max_validation"]) for s in range(1, 6)] == [(72, 18), (360, 90), (720, 180), (1440, 360), (1440, 360)]
    once = assigned.where("stage_id >= 3 and subset = 'validation'").groupBy("stage_id", "repeat_id", "id").count()
    assert once.where("count <> 1").count() == 0
    relate.require_no_overlap(assigned, curriculum.UNIT, "id", "subset")
    with pytest.raises(ValueError):
        relate.require_no_overlap(assigned.unionByName(assigned.withColumn("subset", F.lit("other"))), curriculum.UNIT, "id", "subset")


def test_balance_modes(items):
    equal = splits.balance(items, "id", "cls", [], 210).groupBy("cls").count().collect()
    assert {r["count"] for r in equal} == {190}
    capped = {r["cls"]: r["count"] for r in splits.balance(items, "id", "cls", [], 200, "cap_only").groupBy("cls").count().collect()}
    assert capped["c4"] == 200 and capped["c0"] == 191
    with pytest.raises(ValueError):
        splits.balance(items, "id", "cls", [], 200, "other")


def test_plan_reaches_target_and_no_further(items):
    unit = items.withColumns({"stage_id": F.lit(1), "repeat_id": F.lit(0), "fold_id": F.lit(0)})
    plan = splits.augmentation_plan(unit, "id", "cls", curriculum.UNIT, F.lit(205)).cache()
    got = {r["cls"]: r["count"] for r in plan.groupBy("cls").count().collect()}
    assert got == {c: 205 - n for c, n in COUNTS.items() if n < 205}
    assert plan.select("augmentation_id").distinct().count() == plan.count()
    assert plan.where("not planned_output_path like 'augmented/stage_1/repeat_0/fold_0/%'").count() == 0


def test_op_pairs(spark):
    pairs = splits.op_pairs(spark).orderBy("pair_no").collect()
    assert len(pairs) == 53 and pairs[0]["op1"] == "rotate_small" and pairs[0]["op2"] == "brightness_small"


def test_epoch_seeds(spark):
    cases = [(42, 0, 0, 1, 43), (42, 0, 3, 1, 343), (42, 1, 3, 5, 1347), (42, 3, 2, 50, 3292)]
    df = spark.createDataFrame(cases, "b INT, r INT, f INT, e INT, want INT")
    assert df.where(S.epoch_seed(F.col("b"), F.col("r"), F.col("f"), F.col("e")) != F.col("want")).count() == 0


def test_stage_table_rounds_half_to_even(spark):
    stages = [curriculum.Stage(1, "a", 5, 1, "holdout", final_augmented_per_class=5, augmentation_fraction=0.5), curriculum.Stage(2, "b", 5, 1, "holdout", augmentation_fraction=0.0)]
    assert [r["target_per_class"] for r in curriculum.stage_table(spark, stages).orderBy("stage_id").collect()] == [2, 1]


def test_manifest_aliases_and_errors(spark, tmp_path):
    df = spark.createDataFrame([("a\\b/c.PNG", 3)], "FilePath STRING, Kelas INT")
    row = M.normalize(df).first()
    assert row["class"] == "3" and row["filename"] == "c.PNG" and len(row["source_id"]) == 16
    with pytest.raises(ValueError, match="class"):
        M.normalize(df.drop("Kelas"))
    with pytest.raises(ValueError, match="unsupported"):
        M.read_manifest(spark, "x.json")
    with pytest.raises(ValueError, match="b, c"):
        M.require_columns(spark.range(1), ["id", "b", "c"])
    assert M.scan_folder(spark, str(tmp_path)).columns == ["path", "class", "filename", "suffix"]
    for name in ("k/one.PNG", "k/two.txt", "three.png", "k/deep/four.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [(r["class"], r["filename"]) for r in M.scan_folder(spark, str(tmp_path)).collect()] == [("k", "one.PNG")]
    with pytest.raises(Exception, match="unknown class"):
        M.require_known(M.encode_class(df, "FilePath", ["x"]), "class_index", "FilePath").collect()


def test_path_functions(spark):
    df = spark.createDataFrame([("/a/b/c.tar.gz",), ("x",), ("a/.hidden",)], "p STRING")
    got = [tuple(r) for r in df.select(S.basename(F.col("p")), S.stem(F.col("p")), S.suffix(F.col("p")), S.parent_name(F.col("p"))).collect()]
    assert got == [("c.tar.gz", "c.tar", ".gz", "b"), ("x", "x", "", ""), (".hidden", ".hidden", "", "a")]
    with pytest.raises(Exception, match="epoch is required"):
        df.select(S.checkpoint_file_name(F.lit("EPOCH"), F.lit(None).cast("int"))).collect()


def test_search_space_errors(spark):
    def rows(text):
        return parse(spark.createDataFrame([(1, text)], "id INT, s STRING"), "s").collect()

    assert rows('{"lr": {"type": "float", "low": 0.1, "high": 1}}')[0]["log_scale"] is False
    for bad in ('{"a": {"type": "int", "low": 1}}', '{"a": {"type": "categorical", "choices": []}}', '{"a": {"type": "other"}}'):
        with pytest.raises(Exception, match="required|unknown"):
            rows(bad)


def test_bounds_are_strict_and_small_groups_skipped(spark):
    rows = [("a", float(v)) for v in (0, 1, 2, 3, 4, 7)] + [("b", 1.0), ("b", 2.0), ("b", 99.0)]
    df = spark.createDataFrame(rows, "cls STRING, v DOUBLE")
    # quartiles of a are 1.25 and 3.75, so the upper bound is 7.5 and 7 is inside
    summary = stats.outlier_summary(df, "cls", ["v"]).collect()
    assert [(r["cls"], r["n_outliers"], r["upper"]) for r in summary] == [("a", 0, 7.5)]
    edge = spark.createDataFrame([("a", float(v)) for v in (0, 1, 2, 3, 4, 7.5, 7.6)], "cls STRING, v DOUBLE")
    q1, q3 = np.quantile([0, 1, 2, 3, 4, 7.5, 7.6], [0.25, 0.75])
    assert stats.outlier_flags(edge, "cls", ["v"]).where("v_outlier").count() == sum(v > q3 + 1.5 * (q3 - q1) for v in (7.5, 7.6))


def test_impute_ignores_infinite(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),), (None,), (6.0,)], "v DOUBLE")
    assert sorted(r["v"] for r in stats.impute_median(df, ["v"]).collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 6.0]


def test_tails():
    assert abs(tails.f_tail(4.0, 2, 10) - 1.8**-5) < 1e-12 and abs(tails.f_tail(0.3, 2, 60) - 1.01**-30) < 1e-12
    assert abs(tails.chi2_quantile(0.975, 8) - 17.53454614) < 1e-6
    assert abs(tails.chi2_quantile(0.95, 1) - 3.84145882) < 1e-6


def test_digamma(spark):
    got = spark.range(1, 60).select("id", tails.digamma(F.col("id")).alias("d")).collect()
    for r in got:
        assert abs(r["d"] - (sum(1 / k for k in range(1, r["id"])) - 0.5772156649015329)) < 1e-12


def test_vif_matches_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) + 2
    x = np.column_stack([x, x[:, 0] + 0.3 * x[:, 1] + 0.2 * rng.normal(size=300)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    got = {r["feature"]: r["vif"] for r in stats.vif(df, list("abcd")).collect()}
    for i, f in enumerate("abcd"):
        rest = np.delete(x, i, 1)
        left = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert abs(got[f] - (x[:, i] ** 2).sum() / (left**2).sum()) < 1e-6 * got[f]
    doubled = df.withColumn("e", 2 * F.col("a"))
    pruned = stats.prune_by_vif(doubled, list("abcde"), 10.0).collect()
    first = [r for r in pruned if r["removed_at"] == 1][0]
    assert math.isinf(first["vif"]) and first["feature"] in ("a", "e")


def test_information_separates(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, float(rng.normal() + 6 * (i % 2)), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "cls INT, good DOUBLE, noise DOUBLE")
    got = {r["feature"]: r["information"] for r in stats.neighbour_information(stats.unpivot(df, ["cls"], ["good", "noise"]), ["feature"], "cls").collect()}
    assert abs(got["good"] - math.log(2)) < 0.05 and 0 <= got["noise"] < 0.08


def test_selection_fallback(spark):
    rows = [("a", 1.0, 9.0), ("b", 2.0, 8.0), ("c", 9.0, 1.0), ("d", 8.0, 2.0)]
    df = spark.createDataFrame(rows, "feature STRING, anova_rank_mean DOUBLE, info_rank_mean DOUBLE").withColumn(
        "consensus_rank", (F.col("anova_rank_mean") + F.col("info_rank_mean")) / 2)
    got = {r["feature"]: r["selection_group"] for r in selection.select_core(df, 2).collect()}
    assert got == {"a": "Fallback_Consensus_Core", "b": "Top_ANOVA_Only_Residual", "c": "Top_IG_Only_Residual", "d": "Top_IG_Only_Residual"}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in ("a", "b"):
        mix = rng.normal(size=(4, 4))
        x = rng.normal(size=(120, 4)) @ mix
        x[:6] += 40
        rows += [(f"{c}{i}", c, [float(v) for v in p]) for i, p in enumerate(x)]
    rows += [(f"t{i}", "tiny", [float(i), 0.0, 1.0, 2.0]) for i in range(4)]
    return rows, spark.createDataFrame(rows, "id STRING, cls STRING, x ARRAY<DOUBLE>")


def planted(i):
    return i[0] in "ab" and int(i[1:]) < 6


def test_robust_distance_finds_planted_rows(cloud):
    rows, df = cloud
    got = outliers.robust_mahalanobis(df, "cls", "x", 4).toPandas().set_index("id")
    assert len(got) == len(rows)
    assert all(got.loc[i, "flag_mahalanobis"] for i in got.index if planted(i))
    assert got.loc[[i for i in got.index if planted(i)], "mahalanobis_score"].min() > 10 * got.loc[[i for i in got.index if i[0] in "ab" and not planted(i)], "mahalanobis_score"].max()
    moved = df.withColumn("x", F.transform("x", lambda v: v * 3 + 7))
    again = outliers.robust_mahalanobis(moved, "cls", "x", 4).toPandas().set_index("id")
    np.testing.assert_allclose(again.loc[got.index, "mahalanobis_score"].median(), got["mahalanobis_score"].median(), rtol=0.35)


def test_plain_distance_matches_numpy(cloud):
    rows, df = cloud
    got = outliers.mahalanobis(df, "cls", "x", 4).toPandas().set_index("id")["mahalanobis_score"]
    x = np.array([r[2] for r in rows if r[1] == "a"])
    gap = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(np.cov(x.T, bias=True)), gap)
    np.testing.assert_allclose([got[r[0]] for r in rows if r[1] == "a"], want, rtol=1e-8)


def test_isolation_and_reconstruction(cloud):
    rows, df = cloud
    iso = outliers.isolation_forest(df, "id", "cls", "x", trees=40).toPandas().set_index("id")
    assert len(iso) == len(rows)
    assert iso.loc[[i for i in iso.index if planted(i)], "isolation_forest_score"].min() > iso.loc[[i for i in iso.index if i[0] in "ab" and not planted(i)], "isolation_forest_score"].median()
    assert (iso.loc[[f"t{i}" for i in range(4)], "isolation_forest_score"] == 0).all() and not iso.loc["t0", "flag_isolation_forest"]
    again = outliers.isolation_forest(df.repartition(5), "id", "cls", "x", trees=40).toPandas().set_index("id")
    np.testing.assert_allclose(again.loc[iso.index, "isolation_forest_score"], iso["isolation_forest_score"])
    rec = outliers.pca_reconstruction(df, "cls", "x", 4).toPandas().set_index("id")["pca_reconstruction_error"]
    x = np.array([r[2] for r in rows if r[1] == "b"])
    gap = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    want = ((gap @ vectors[:, :1]) ** 2).sum(1) / 4
    np.testing.assert_allclose([rec[r[0]] for r in rows if r[1] == "b"], want, rtol=1e-6)
    tiny = np.array([r[2] for r in rows if r[1] == "tiny"])
    np.testing.assert_allclose([rec[f"t{i}"] for i in range(4)], ((tiny - tiny.mean(0)) ** 2).sum(1))


def test_components_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    out, loadings = matrix.hybrid_pca(df, ["id"], ["a"], ["b", "c", "d"], 2)
    z = (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    want = z @ matrix.orient(vectors[:, ::-1][:, :2])
    got = out.orderBy("id").toPandas()
    np.testing.assert_allclose(got[["PC_Residual_1", "PC_Residual_2"]], want, atol=1e-8)
    np.testing.assert_allclose(got["a"], x[:, 0])
    assert abs(loadings.agg(F.max("cumulative")).first()[0] - values[1:].sum() / values.sum()) < 1e-9
    assert matrix.hybrid_pca(df, ["id"], ["a"], [])[0].columns == ["id", "a"]
    with pytest.raises(ValueError):
        matrix.hybrid_pca(df, ["id"], [], ["b"])


def test_early_stop_walk(spark):
    rng = np.random.default_rng(9)
    runs_of = {r: [float(v) for v in np.round(rng.normal(size=80).cumsum() * 0.3, 2)] for r in range(6)}
    runs_of[6] = [float(-i) for i in range(60)]
    df = spark.createDataFrame([(r, e + 1, v) for r, vs in runs_of.items() for e, v in enumerate(vs)], "run BIGINT, epoch BIGINT, value DOUBLE")
    for delta in (0.0, 0.5, 2.5):
        for block in (7, 10_000):
            got = {r["run"]: r for r in runs.early_stop(df, "run", "epoch", "value", 6, delta, block=block).collect()}
            for run, values in runs_of.items():
                best = at = stop = None
                wait = 0
                for e, v in enumerate(values, 1):
                    if best is None or v < best - delta:
                        best, at, wait = v, e, 0
                    else:
                        wait += 1
                        if wait >= 6:
                            stop = e
                            break
                assert (got[run]["stop_epoch"], got[run]["best_epoch"], got[run]["best_value"]) == (stop, at, best)


def test_best_epoch_takes_the_earliest_tie(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 3.0), (1, 4, float("nan"))], "run INT, epoch INT, v DOUBLE")
    assert runs.best_epoch(df, "run", "epoch", "v").first()["best_epoch"] == 2


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "a")], "y STRING, p STRING")
    m = runs.classification_metrics(df, [], "y", "p").first()
    assert abs(m["macro_precision"] - (0.5 + 0 + 0) / 3) < 1e-12 and abs(m["balanced_accuracy"] - 0.25) < 1e-12
    assert abs(m["accuracy"] - 1 / 3) < 1e-12 and abs(m["macro_f1"] - 0.5 / 3) < 1e-12


def test_task_guards(spark):
    log = [(1, 1, "claim", 7), (1, 2, "heartbeat", 8), (1, 3, "stale", 0), (1, 4, "take_over", 8), (1, 5, "done", 7), (1, 6, "done", 8), (1, 7, "claim", 9)]
    df = spark.createDataFrame([(t, e, e, a, w) for t, e, a, w in log], "task_id BIGINT, ts BIGINT, event_id BIGINT, action STRING, worker BIGINT")
    r = states.fold_tasks(df).first()
    assert (r["status"], r["owner"], r["hijack_count"], r["n_applied"], r["n_rejected"]) == ("DONE", 8, 1, 4, 3)


def test_heartbeat_fields(spark):
    rows = [("w", 1, 1, "RUNNING", "n1", 5), ("w", 2, 2, None, None, None), ("w", 3, 3, "IDLE", None, None)]
    df = spark.createDataFrame(rows, "worker_uid STRING, ts INT, beat_id INT, status STRING, worker_name STRING, task_id INT")
    r = tables.fold_heartbeats(df, ["status", "task_id"], ["worker_name"]).first()
    assert (r["status"], r["task_id"], r["worker_name"]) == ("IDLE", None, "n1")


def test_silence_rules(spark):
    """A working worker goes STALE and not OFFLINE as well; an idle one only OFFLINE, after five minutes."""
    rows = [("run", 0, 0, "RUNNING"), ("idle3", 0, 1, "IDLE"), ("idle3", 180, 2, "IDLE"), ("idle9", 0, 3, "IDLE"), ("off", 0, 4, "OFFLINE"), ("edge", 0, 5, "FAILED"), ("edge", 120, 6, "OFFLINE")]
    df = spark.createDataFrame(rows, "worker_uid STRING, s INT, beat_id INT, status STRING").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r["worker_uid"], r["event_type"]) for r in monitor.silence_events(df, F.timestamp_seconds(F.lit(470))).collect()]
    assert sorted(got) == [("idle9", "OFFLINE"), ("run", "STALE")]


def test_slot_pointers(spark):
    rows = [(1, 1, "FINAL", 1, None), (2, 1, "EPOCH", 1, 1), (2, 2, "FINAL", 2, 2), (2, 3, "BEST", 3, 3), (3, 1, "BEST", 1, 1)]
    df = spark.createDataFrame([(s, f + 10 * s, k, t, e, 0.5) for s, f, k, t, e in rows], "slot_id INT, file_id INT, kind STRING, created_at INT, epoch INT, metric DOUBLE")
    got = {r["slot_id"]: (r["latest_file_id"], r["best_file_id"], r["final_file_id"], r["resume_status"]) for r in tables.fold_slots(df).collect()}
    assert got == {1: (11, None, 11, "FINALIZED"), 2: (21, 23, 22, "FINALIZED"), 3: (None, 31, None, "EMPTY")}


def test_log_schema(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "task_id BIGINT, val_loss DOUBLE")
    logs.append(rows, "epoch_metric", str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/epoch_metric").first()
    assert back["val_loss"] == 0.5 and back["train_loss"] is None and back["created_at"] is not None
    with pytest.raises(ValueError, match="unknown columns"):
        logs.conform(rows.withColumn("other", F.lit(1)), "epoch_metric")
    for name in logs.LOGS:
        assert "log_id" in logs.conform(spark.createDataFrame([], "stage_no INT"), name).columns


def test_guards(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k INT, v STRING")
    with pytest.raises(ValueError, match="left side repeats"):
        relate.one_to_one(a, a.limit(1), "k")
    with pytest.raises(ValueError):
        relate.require_same_count(a, a.limit(1), "rows")
    assert relate.label_conflicts(a.limit(1), a.where("v = 'y'"), "k", "v").count() == 1
    missing = tables.task_defaults(
        spark.createDataFrame([(1, 9, "m", None, None)], "task_id INT, stage_no INT, model_type STRING, direction STRING, tell_status STRING"),
        spark.createDataFrame([(1, "m", 3, "minimize")], "stage_no INT, model_type STRING, trials INT, direction STRING"))
    assert missing.first()["stage_found"] is False
    with pytest.raises(Exception, match="no stage 9"):
        tables.require_stage(missing).collect()


def test_statistics_skip_nan_and_infinite_values(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, float("nan"), float("inf"), None)] + [("b", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "c string, v double")
    got = {r["c"]: r for r in stats.class_statistics(df, "c", ["v"]).collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["max"]) == (2.5, 2.5, 4.0)
    assert got["b"]["mean"] is None and got["b"]["median"] is None
    flags = [(r["v"], r["v_outlier"]) for r in stats.outlier_flags(df, "c", ["v"]).where("c = 'a'").collect()]
    assert [v for v, f in flags if f] == [float("inf")]
    summary = stats.outlier_summary(df, "c", ["v"]).collect()
    assert [(r["c"], r["n_outliers"], r["n_rows"]) for r in summary] == [("a", 1, 7)]


@pytest.mark.parametrize("group_rows", [2, 1_000_000])
def test_quantiles_agree_on_both_sides_of_the_bound(spark, group_rows):
    rows = [("a", float(v), None) for v in (3, 1, 4, 1, 5, 9, 2, 6)] + [("b", None, 0.1), ("b", None, 0.7), (None, 1.5, None)]
    df = spark.createDataFrame(rows, "c string, v double, w double")
    got = {r["c"]: (r["v"], r["w"]) for r in grouped_quantiles(df, ["c"], ["v", "w"], [0.1, 0.5], group_rows).collect()}
    want = {r["c"]: (r["v"], r["w"]) for r in df.groupBy("c").agg(F.percentile("v", [0.1, 0.5]).alias("v"), F.percentile("w", [0.1, 0.5]).alias("w")).collect()}
    assert got == want and got["b"][0] is None


def test_a_given_source_id_stays_and_a_leaking_family_raises(spark, tmp_path):
    manifest = spark.createDataFrame([("x/1.png", "a", "s1"), ("x/2.png", "a", "s1")], "filepath string, label string, source_image_id string")
    assert {r["source_id"] for r in M.normalize(manifest).collect()} == {"s1"}
    dev = spark.createDataFrame([(i, "a" if i % 2 else "b", i // 40) for i in range(400)], "k long, c string, family long")
    with pytest.raises(ValueError):
        curriculum.build(dev, "k", "c", str(tmp_path / "out"), source="family")


def test_upsert_takes_the_last_of_repeated_updates(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "x", 5), (2, "w", 6)], "k int, v string, at int")
    got = tables.upsert(old, new, ["k"], order=["at"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "c", 2), (2, "w", 6)]


def test_a_run_without_finite_values_stops_after_the_patience(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, e, nan) for e in range(1, 6)] + [(2, e, v) for e, v in enumerate((nan, nan, 1.0, 2.0, 3.0, 4.0), 1)] + [(3, 1, inf), (3, 2, 5.0)]
    log = spark.createDataFrame(rows, "run long, epoch long, value double")
    got = {r["run"]: (r["stop_epoch"], r["best_epoch"], r["best_value"]) for r in runs.early_stop(log, "run", "epoch", "value", 3).collect()}
    assert got == {1: (3, None, None), 2: (6, 3, 1.0), 3: (None, 2, 5.0)}


def test_moments_do_not_cancel_far_from_zero(spark):
    rows = [("a", [1e8 + i % 5, 1e8 - i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, x array<double>")
    n, mean, cov = matrix.unpack(matrix.moments(df, "c", "x", 2).toPandas(), 2)
    want = np.array([r[1] for r in rows])
    assert n == 60 and np.allclose(mean, want.mean(0), rtol=1e-15) and np.allclose(cov, np.cov((want - 1e8).T, bias=True), rtol=1e-9)


def test_policies_of_wanted_stages_are_listed(spark):
    rows = [(3, "a", 5), (3, "b", None), (4, "a", 2), (7, "a", 1), (None, "a", 1)]
    df = spark.createDataFrame(rows, "stage INT, model STRING, folds INT")
    got = relate.policy_listing(df, "stage", [3, 4, 5, 5], ["folds"])
    assert got.columns == ["stage", "model", "folds", "state"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(3, "a", 5, "OK"), (3, "b", None, "INCOMPLETE"), (4, "a", 2, "OK"), (5, None, None, "MISSING")], key=repr)
    assert {r["state"] for r in relate.policy_listing(df.limit(0), "stage", [3], ["folds"]).collect()} == {"MISSING"}
    listed = relate.column_listing(df, ["folds", "size"]).collect()
    assert [tuple(r) for r in listed] == [("folds", "int", True, "OK"), ("size", None, None, "MISSING")]


def test_class_counts_agree_with_assigned_items(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"c{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "id BIGINT, cls STRING")
    unit = [*curriculum.UNIT, "subset", "cls"]
    want = curriculum.assignments(df, "id", "cls").groupBy(*unit).count()
    got = curriculum.class_counts(df, "id", "cls")
    assert sorted(map(tuple, got.select(*unit, "n").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
