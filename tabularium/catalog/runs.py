"""Classification metrics, epochs and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.operators import runs, tables
from tabularium.operators.skew import numbered

EPOCH_SQL = """
WITH log AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value, event_id FROM events)
"""


def epochs(t):
    """Events of a user as the epochs of a run, numbered hour by hour."""
    rows = t.events.select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    return numbered(rows, ["run"], F.date_trunc("HOUR", "ts"), [F.col("ts"), F.col("event_id")], "epoch").drop("ts")


METRIC_SQL = """
per AS (SELECT {by} c, sum(tp) AS tp, sum(sup) AS sup, sum(pos) AS pos FROM (
  SELECT {by} label AS c, count(*) FILTER (WHERE label = predicted) AS tp, count(*) AS sup, 0 AS pos FROM d GROUP BY ALL
  UNION ALL SELECT {by} predicted, 0, 0, count(*) FROM d GROUP BY ALL) GROUP BY ALL)
SELECT {by} round(sum(tp) / sum(sup), 8) AS accuracy, round(avg(coalesce(tp / nullif(pos, 0), 0)), 8) AS macro_precision,
  round(avg(coalesce(tp / nullif(sup, 0), 0)), 8) AS macro_recall, round(avg(2 * tp / (sup + pos)), 8) AS macro_f1,
  round(sum(2 * tp / (sup + pos) * sup) / sum(sup), 8) AS weighted_f1, round(avg(tp / sup) FILTER (WHERE sup > 0), 8) AS balanced_accuracy,
  CAST(sum(sup) AS BIGINT) AS n_rows FROM per {group}
"""


def rounded(df):
    names = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "balanced_accuracy")
    return df.withColumns({n: F.round(n, 8) for n in names})


@query("label_metrics", "A25", "WITH d AS (SELECT lang, quality AS label, toxic AS predicted FROM labels JOIN documents USING (doc_id)), " + METRIC_SQL.format(by="lang,", group="GROUP BY lang"))
def label_metrics(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return rounded(runs.classification_metrics(rows, ["lang"], "quality", "toxic"))


@query("overall_label_metrics", "A25", "WITH d AS (SELECT quality AS label, toxic AS predicted FROM labels), " + METRIC_SQL.format(by="", group=""))
def overall_label_metrics(t):
    return rounded(runs.classification_metrics(t.labels, [], "quality", "toxic"))


@query("centroid_classifier_metrics", "A25", """
WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL),
q AS (SELECT v.vec_id, v.label, c.label AS guess, sum(pow(x - m, 2)) AS s FROM v JOIN c USING (i) GROUP BY ALL),
d AS (SELECT label, arg_min(guess, s) AS predicted FROM q GROUP BY vec_id, label),
""" + METRIC_SQL.format(by="", group=""))
def centroid_classifier_metrics(t):
    """Nearest class centroid as the prediction; the centroids are k rows, packed into one broadcast row."""
    from tabularium.operators.matrix import minus, square_sum
    from tabularium.operators.skew import small_table

    rows = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    means = small_table(rows.groupBy("label").agg(F.array(*[F.avg(f"x{i}") for i in range(64)]).alias("m")))[0]
    packed = means.agg(F.collect_list(F.struct("label", "m")).alias("all"))
    x = F.array(*[F.col(f"x{i}") for i in range(64)])
    joined = rows.select("label", x.alias("x")).join(F.broadcast(packed))
    guess = F.array_min(F.transform("all", lambda c: F.struct(square_sum(minus(F.col("x"), c["m"])).alias("d"), c["label"].alias("label"))))
    return rounded(runs.classification_metrics(joined.withColumn("predicted", guess["label"]), [], "label", "predicted"))


@query("weighted_losses", "A26", """
SELECT l_returnflag, round(sum(l_tax * l_quantity) / greatest(sum(l_quantity), 1), 8) AS loss, round(sum(floor(l_quantity * l_discount)) / greatest(sum(l_quantity), 1), 8) AS accuracy
FROM lineitem GROUP BY 1
""")
def weighted_losses(t):
    rows = t.lineitem.withColumn("correct", F.floor(F.col("l_quantity") * F.col("l_discount")))
    out = runs.weighted_loss(rows, ["l_returnflag"], "l_tax", "l_quantity", "correct")
    return out.withColumns({"loss": F.round("loss", 8), "accuracy": F.round("accuracy", 8)})


@query("mean_fold_objective", "A27", """
WITH f AS (SELECT event_type, user_id % 5 AS fold, avg(value) AS v FROM events GROUP BY ALL)
SELECT event_type, round(avg(v), 6) AS mean_objective, round(stddev_samp(v), 6) AS std_objective, count(*) AS n_folds FROM f GROUP BY 1
""")
def mean_fold_objective(t):
    folds = t.events.groupBy("event_type", (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("v"))
    return runs.mean_objective(folds, ["event_type"], "v").withColumns({c: F.round(c, 6) for c in ("mean_objective", "std_objective")})


@query("best_trials", "A32", """
SELECT o_custkey % 50 AS study, CASE WHEN o_custkey % 2 = 0 THEN 'maximize' ELSE 'minimize' END AS direction, o_orderkey AS best_trial, o_totalprice AS best_value
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY CASE WHEN o_custkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END, o_orderkey) = 1
""")
def best_trials(t):
    rows = t.orders.select(
        (F.col("o_custkey") % 50).alias("study"), F.when(F.col("o_custkey") % 2 == 0, "maximize").otherwise("minimize").alias("direction"),
        "o_orderkey", "o_totalprice",
    )
    return runs.best_trial(rows, ["study"], "o_orderkey", "o_totalprice", "direction")


@query("latest_events", "W9", """
SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_events(t):
    return tables.latest(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type", "ts"])


@query("best_epochs", "W12", EPOCH_SQL + """
SELECT run, epoch AS best_epoch, value AS best_value, event_id FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY value, epoch) = 1
""")
def best_epochs(t):
    return runs.best_epoch(epochs(t), "run", "epoch", "value", "min", ["event_id"])


STOP_SQL = EPOCH_SQL + """
, m AS (SELECT *, min({v}) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, max(epoch) OVER (PARTITION BY run) AS last_epoch FROM log),
i AS (SELECT *, lead(epoch) OVER (PARTITION BY run ORDER BY epoch) AS nxt FROM m WHERE low IS NULL OR {v} < low),
s AS (SELECT *, coalesce(nxt - 1, last_epoch) - epoch >= {p} AS stops FROM i)
"""


@query("early_stops", "W11", STOP_SQL.format(v="value", p=10) + """
SELECT run, last_epoch, min(epoch) FILTER (WHERE stops) + 10 AS stop_epoch, coalesce(min(epoch) FILTER (WHERE stops), max(epoch)) AS best_epoch,
  coalesce(arg_min(value, epoch) FILTER (WHERE stops), arg_max(value, epoch)) AS best_value FROM s GROUP BY run, last_epoch
""")
def early_stops(t):
    return runs.early_stop(epochs(t), "run", "epoch", "value", 10)


@query("early_stops_with_delta", "W11", EPOCH_SQL.replace("WITH", "WITH RECURSIVE") + """
, walk(run, epoch, best, best_epoch, wait, stopped) AS (
  SELECT run, epoch, value, epoch, 0, false FROM log WHERE epoch = 1
  UNION ALL
  SELECT w.run, l.epoch, CASE WHEN NOT w.stopped AND l.value > w.best + 2.5 THEN l.value ELSE w.best END,
    CASE WHEN NOT w.stopped AND l.value > w.best + 2.5 THEN l.epoch ELSE w.best_epoch END,
    CASE WHEN w.stopped THEN w.wait WHEN l.value > w.best + 2.5 THEN 0 ELSE w.wait + 1 END, w.stopped OR (NOT l.value > w.best + 2.5 AND w.wait + 1 >= 8)
  FROM walk w JOIN log l ON l.run = w.run AND l.epoch = w.epoch + 1)
SELECT run, max(epoch) AS last_epoch, min(epoch) FILTER (WHERE stopped) AS stop_epoch, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best, epoch) AS best_value FROM walk GROUP BY run
""")
def early_stops_with_delta(t):
    """Maximising with a least gain of 2.5, patience 8."""
    return runs.early_stop(epochs(t), "run", "epoch", "value", 8, 2.5, "max")


@query("epoch_diagnostics", "W13", EPOCH_SQL + """
, l AS (SELECT run, epoch, value / 10 AS tl, value AS vl, 1 / (1 + value) AS ta, 1 / (2 + value) AS va, value * 10 AS g FROM log),
m AS (SELECT *, min(vl) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low, max(epoch) OVER (PARTITION BY run) AS last_epoch FROM l),
i AS (SELECT *, lead(epoch) OVER (PARTITION BY run ORDER BY epoch) AS nxt FROM m WHERE low IS NULL OR vl < low),
s AS (SELECT run, min(epoch) FILTER (WHERE coalesce(nxt - 1, last_epoch) - epoch >= 20) AS start FROM i GROUP BY run),
z AS (SELECT run, bool_or(g < 20) AS vanishing_gradient, bool_or(g > 1500) AS exploding_gradient, min(vl) AS best_val_loss, max(va) AS best_val_acc,
  arg_max(vl - tl, epoch) AS loss_gap, arg_max(ta, epoch) AS ta, arg_max(ta - va, epoch) AS acc_gap FROM l GROUP BY run)
SELECT run, start IS NOT NULL AS plateau, start AS plateau_start_epoch, false AS nan_loss, vanishing_gradient, exploding_gradient, loss_gap > 0.2 AS overfitting, ta < 0.5 AS underfitting,
  round(loss_gap, 6) AS loss_gap, round(acc_gap, 6) AS acc_gap, best_val_loss, round(best_val_acc, 6) AS best_val_acc FROM z JOIN s USING (run)
""")
def epoch_diagnostics(t):
    v = F.col("value")
    log = epochs(t).select("run", "epoch", (v / 10).alias("tl"), v.alias("vl"), (1 / (1 + v)).alias("ta"), (1 / (2 + v)).alias("va"), (v * 10).alias("g"))
    out = runs.diagnostics(log, "run", "epoch", "tl", "vl", "ta", "va", "g", window=20, vanish=20, explode=1500)
    return out.withColumns({c: F.round(c, 6) for c in ("loss_gap", "acc_gap", "best_val_acc")})
