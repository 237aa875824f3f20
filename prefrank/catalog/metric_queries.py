"""Evaluation metrics, losses, gates, run history."""

from pyspark.sql import functions as F

from prefrank import session
from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.operators import metrics, runs
from prefrank.operators.ordering import chunk
from prefrank.plans.evaluation import GateFailed, gate_and_report
from prefrank.sources.tables import path_exists


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _auc_sql(source: str, by: str = "") -> str:
    """Rank-sum form of the one-vs-rest AUC, independent of the bucketed prefix sums."""
    lead = f"{by}, " if by else ""
    return f"""scored AS (
    SELECT {lead}0 AS class, p0 AS score, (label = 0)::INT AS y FROM {source} WHERE label IS NOT NULL
    UNION ALL SELECT {lead}1, p1, (label = 1)::INT FROM {source} WHERE label IS NOT NULL
    UNION ALL SELECT {lead}2, p2, (label = 2)::INT FROM {source} WHERE label IS NOT NULL),
  ranked AS (SELECT *, rank() OVER (PARTITION BY {lead}class ORDER BY score)
      + (count(*) OVER (PARTITION BY {lead}class, score) - 1) / 2.0 AS r FROM scored),
  aucs AS (SELECT {lead}class, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives,
      (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
        / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM ranked GROUP BY {lead}class)"""


_LOSS = ("-ln(least(greatest(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16), "
         "1 - 2.220446049250313e-16))")
_POINT = (f"round(avg((pred = label)::INT), 6) AS accuracy, round(avg({_LOSS}), 6) AS log_loss, "
          "round(avg(conf), 6) AS preference_score_mean, count(*) AS n")


@query("auc_by_class", f"""WITH {v.ORDERS_SQL}, {_auc_sql('preds')}
  SELECT class, round(auc, 6) AS auc, positives, negatives FROM aucs""")
def auc_by_class(spark, folder):
    return _rounded(metrics.auc_by_class(v.order_predictions(spark, folder)), "auc")


@query("classification_metrics", f"""WITH {v.ORDERS_SQL}, {_auc_sql('preds')}
  SELECT (SELECT round(avg(auc), 6) FROM aucs) AS auc, {_POINT} FROM preds""")
def classification_metrics(spark, folder):
    rows = metrics.classification_metrics(v.order_predictions(spark, folder))
    return _rounded(rows, "accuracy", "auc", "log_loss", "preference_score_mean")


@query("metrics_by_model", f"""WITH {v.ORDERS_SQL}, {_auc_sql('preds', 'model')},
  m AS (SELECT model, round(avg(auc), 6) AS auc FROM aucs GROUP BY model)
  SELECT model, any_value(auc) AS auc, {_POINT} FROM preds JOIN m USING (model) GROUP BY model""")
def metrics_by_model(spark, folder):
    rows = metrics.classification_metrics(v.order_predictions(spark, folder), ["model"])
    return _rounded(rows, "accuracy", "auc", "log_loss", "preference_score_mean")


@query("metrics_by_segment", f"""WITH {v.VECTORS_SQL}, {_auc_sql('preds', 'segment')},
  m AS (SELECT segment, round(avg(auc), 6) AS auc FROM aucs GROUP BY segment)
  SELECT segment, any_value(auc) AS auc, {_POINT} FROM preds JOIN m USING (segment) GROUP BY segment""")
def metrics_by_segment(spark, folder):
    rows = metrics.classification_metrics(v.vector_predictions(spark, folder), ["segment"])
    return _rounded(rows, "accuracy", "auc", "log_loss", "preference_score_mean")


_BINS = """bins AS (SELECT CASE WHEN conf < 1 THEN
    list_max(list_filter(range(0, 10), lambda i: conf >= i * (1.0::DOUBLE / 10))) END AS bin,
    (pred = label)::INT AS ok, conf FROM preds),
  binned AS (SELECT bin, count(*) AS n, avg(ok) AS accuracy, avg(conf) AS confidence FROM bins GROUP BY bin)"""
_ECE = ("(SELECT sum(CASE WHEN bin IS NOT NULL THEN n * abs(accuracy - confidence) ELSE 0 END) / sum(n)"
        " FROM binned)")


@query("calibration_bins", f"""WITH {v.ORDERS_SQL}, {_BINS} SELECT bin::INT AS bin, n,
  round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence FROM binned""")
def calibration_bins(spark, folder):
    rows = metrics.calibration_bins(v.order_predictions(spark, folder))
    return _rounded(rows, "accuracy", "confidence")


@query("calibration_error", f"WITH {v.VECTORS_SQL}, {_BINS} SELECT round({_ECE}, 6) AS ece")
def calibration_error(spark, folder):
    return _rounded(metrics.expected_calibration_error(v.vector_predictions(spark, folder)), "ece")


def _gate(rules: str) -> str:
    return f"""WITH {v.ORDERS_SQL}, {_auc_sql('preds')}, {_BINS},
  m AS (SELECT (SELECT avg(auc) FROM aucs) AS auc, {_ECE} AS ece,
        (SELECT avg((pred = label)::INT) FROM preds) AS accuracy)
  {rules}"""


@query("acceptance_gate", _gate("""SELECT 'auc' AS metric, round(auc, 6) AS value, 0.7 AS threshold,
    CASE WHEN auc >= 0.7 THEN 'ok' ELSE 'fail' END AS status FROM m
  UNION ALL SELECT 'ece', round(ece, 6), 0.05, CASE WHEN ece < 0.05 THEN 'ok' ELSE 'warn' END FROM m"""))
def acceptance_gate(spark, folder):
    result = metrics.evaluation_metrics(v.order_predictions(spark, folder))
    return _rounded(metrics.acceptance_gate(result), "value")


@query("strict_gate", _gate("""SELECT 'auc' AS metric, round(auc, 6) AS value, 0.8 AS threshold,
    CASE WHEN auc >= 0.8 THEN 'ok' ELSE 'fail' END AS status FROM m
  UNION ALL SELECT 'accuracy', round(accuracy, 6), 0.75, CASE WHEN accuracy >= 0.75 THEN 'ok' ELSE 'fail' END FROM m
  UNION ALL SELECT 'ece', round(ece, 6), 0.05, CASE WHEN ece <= 0.05 THEN 'ok' ELSE 'fail' END FROM m"""))
def strict_gate(spark, folder):
    from prefrank.fixed_values import STRICT_GATE

    result = metrics.evaluation_metrics(v.order_predictions(spark, folder))
    return _rounded(metrics.acceptance_gate(result, STRICT_GATE), "value")


_SEGMENT_RULES = (("auc", "min", 0.0, "fail"), ("accuracy", "min", 0.4, "warn"))


@query("gate_report", f"""WITH {v.VECTORS_SQL}, {_auc_sql('preds', 'segment')},
  m AS (SELECT segment, avg(auc) AS auc FROM aucs GROUP BY segment),
  a AS (SELECT segment, avg((pred = label)::INT) AS accuracy, count(*) AS n FROM preds GROUP BY segment)
  SELECT segment, 'auc' AS metric, round(auc, 6) AS value, 0.0 AS threshold, 'ok' AS status, n FROM m JOIN a USING (segment)
  UNION ALL SELECT segment, 'accuracy', round(accuracy, 6), 0.4, CASE WHEN accuracy >= 0.4 THEN 'ok' ELSE 'warn' END, n FROM a""")
def gate_report(spark, folder):
    """Gate of each segment beside the row counts of the report, which is written and read back."""
    path = session.scratch_path(spark, "gate-report")
    result = session.reliable_checkpoint(metrics.evaluation_metrics(v.vector_predictions(spark, folder), ["segment"]))
    gate = gate_and_report(result, path, _SEGMENT_RULES, by=["segment"])
    report = spark.read.schema("segment string, n long").json(path)
    return _rounded(gate, "value").join(report, "segment")


@query("gate_refuses", f"""WITH {v.VECTORS_SQL}, a AS (SELECT segment, avg((pred = label)::INT) AS accuracy FROM preds GROUP BY segment),
  middle AS (SELECT round(avg(accuracy), 6) AS limit_ FROM a)
  SELECT segment, round(accuracy, 6) AS value, CASE WHEN accuracy >= limit_ THEN 'ok' ELSE 'fail' END AS status,
    true AS refused, false AS report_written, accuracy < limit_ AS named FROM a, middle""")
def gate_refuses(spark, folder):
    """A limit between the segments' accuracies: the gate raises, names the segments that fail, and writes no report."""
    path = session.scratch_path(spark, "gate-refused")
    result = session.reliable_checkpoint(metrics.evaluation_metrics(v.vector_predictions(spark, folder), ["segment"]))
    limit = result.agg(F.round(F.avg("accuracy"), 6)).first()[0]
    rules = (("accuracy", "min", limit, "fail"),)
    try:
        gate_and_report(result, path, rules, by=["segment"])
        error = ""
    except GateFailed as failure:
        error = str(failure)
    gate = metrics.acceptance_gate(result, rules, ["segment"])
    return _rounded(gate, "value").select(
        "segment", "value", "status", F.lit(bool(error)).alias("refused"), F.lit(path_exists(spark, path)).alias("report_written"),
        F.contains(F.lit(error), F.concat(F.lit("'"), "segment", F.lit("'"))).alias("named"))


def _dcg_sql(name: str, order: str) -> str:
    """Per query: every row's discount by rank, averaged inside tied groups."""
    return f"""{name}_r AS (SELECT q, {order} AS o, rel,
      CASE WHEN row_number() OVER (PARTITION BY q ORDER BY {order} DESC) <= 10
           THEN 1 / log2(row_number() OVER (PARTITION BY q ORDER BY {order} DESC) + 1) ELSE 0 END AS d FROM lists),
  {name}_g AS (SELECT q, avg(rel) * sum(d) AS g FROM {name}_r GROUP BY q, o),
  {name} AS (SELECT q, sum(g) AS g FROM {name}_g GROUP BY q)"""


def _ndcg_sql(lists: str) -> str:
    return f"""WITH lists AS ({lists}), {_dcg_sql('actual', 'score')}, {_dcg_sql('ideal', 'rel')}
  SELECT q AS query_id, round(CASE WHEN ideal.g = 0 THEN 0 ELSE actual.g / ideal.g END, 6) AS ndcg
  FROM actual JOIN ideal USING (q)"""


@query("ndcg_at_10", _ndcg_sql(
    "SELECT vec_id % 25 AS q, embedding[1]::DOUBLE AS score, (label % 4)::DOUBLE AS rel FROM embeddings"))
def ndcg_at_10(spark, folder):
    rows = v.table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 25).alias("query_id"), F.col("embedding")[0].alias("score"),
        (F.col("label") % 4).alias("relevance"))
    return _rounded(metrics.ndcg(rows, k=10), "ndcg")


@query("ndcg_of_orders", _ndcg_sql("""SELECT o_orderpriority AS q, floor(o_totalprice / 1000) AS score,
  CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 1.0 ELSE 0.0 END AS rel FROM orders"""))
def ndcg_of_orders(spark, folder):
    """Five very long lists with many ties."""
    status = F.col("o_orderstatus")
    rows = v.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("query_id"), F.floor(F.col("o_totalprice") / 1000).alias("score"),
        F.when(status == "F", 2.0).when(status == "O", 1.0).otherwise(0.0).alias("relevance"))
    return _rounded(metrics.ndcg(rows, k=10), "ndcg")


_TERMS = """terms AS (SELECT *, ln(e0 + e1 + e2) + greatest(l0, l1, l2) AS lse FROM preds),
  losses AS (SELECT *,
    -(0.1 / 3) * ((l0 - lse) + (l1 - lse) + (l2 - lse))
      - 0.9 * (CASE label WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END - lse) AS cls,
    CASE WHEN label <> 2 THEN greatest(0, -(CASE WHEN label = 0 THEN 1 ELSE -1 END) * (p0 - p1) + 0.1) END AS rnk
    FROM terms)"""


@query("loss_terms", f"""WITH {v.VECTORS_SQL}, {_TERMS}
  SELECT vec_id, round(cls, 6) AS cls_term, round(rnk, 6) AS rank_term FROM losses""")
def loss_terms(spark, folder):
    rows = metrics.with_losses(v.vector_predictions(spark, folder)).select("vec_id", "cls_term", "rank_term")
    return _rounded(rows, "cls_term", "rank_term")


@query("combined_loss", f"""WITH {v.VECTORS_SQL}, {_TERMS}
  SELECT segment, round(0.7 * avg(cls) + 0.3 * coalesce(avg(rnk), 0), 6) AS loss, round(avg(cls), 6) AS cls_loss,
         round(coalesce(avg(rnk), 0), 6) AS rank_loss FROM losses GROUP BY segment""")
def combined_loss(spark, folder):
    rows = metrics.combined_loss(v.vector_predictions(spark, folder), ["segment"])
    return _rounded(rows, "loss", "cls_loss", "rank_loss")


@query("epoch_losses", f"""WITH {v.VECTORS_SQL}, {_TERMS},
  b AS (SELECT vec_id // 200 AS epoch, vec_id // 16 AS batch, 0.7 * avg(cls) + 0.3 * coalesce(avg(rnk), 0) AS loss,
        avg(cls) AS c, coalesce(avg(rnk), 0) AS r FROM losses GROUP BY 1, 2)
  SELECT epoch, round(avg(loss), 6) AS loss, round(avg(c), 6) AS cls_loss, round(avg(r), 6) AS rank_loss
  FROM b GROUP BY epoch""")
def epoch_losses(spark, folder):
    rows = v.vector_predictions(spark, folder).withColumns({
        "epoch": F.floor(F.col("vec_id") / 200), "batch": F.floor(F.col("vec_id") / 16)})
    return _rounded(metrics.epoch_losses(rows), "loss", "cls_loss", "rank_loss")


@query("row_chunks", """WITH p AS (SELECT o_orderkey, o_totalprice,
    (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS chunk FROM orders)
  SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total
  FROM p GROUP BY chunk""")
def row_chunks(spark, folder):
    rows = v.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return chunk(rows, "o_orderkey", 16).groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))


_BEST = """marked AS (SELECT *, row_number() OVER w AS i,
    greatest(coalesce(max(val_auc) OVER (PARTITION BY run_id ORDER BY epoch
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS before
    FROM history WINDOW w AS (PARTITION BY run_id ORDER BY epoch)),
  best AS (SELECT *, val_auc > before AS improved, greatest(before, val_auc) AS best_so_far,
    i - coalesce(max(CASE WHEN val_auc > before THEN i END) OVER (PARTITION BY run_id ORDER BY epoch), 0) AS streak
    FROM marked)"""


@query("running_best", f"""WITH {v.HISTORY_SQL}, {_BEST}
  SELECT run_id, epoch, val_auc, improved, best_so_far, streak::INT AS no_improve_count FROM best""")
def running_best(spark, folder):
    return runs.running_best(v.run_history(spark, folder)).select(
        "run_id", "epoch", "val_auc", "improved", "best_so_far", "no_improve_count")


@query("early_stopping", f"""WITH {v.HISTORY_SQL}, {_BEST},
  stops AS (SELECT run_id, min(epoch) AS stop_epoch FROM best WHERE streak >= 2 GROUP BY run_id),
  ran AS (SELECT best.*, stop_epoch FROM best LEFT JOIN stops USING (run_id)
          WHERE stop_epoch IS NULL OR epoch <= stop_epoch)
  SELECT run_id, epoch, val_auc, stop_epoch,
         max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id) AS best_epoch FROM ran""")
def early_stopping(spark, folder):
    return runs.early_stopping(v.run_history(spark, folder)).select(
        "run_id", "epoch", "val_auc", "stop_epoch", "best_epoch")


@query("top_checkpoints", f"""WITH {v.HISTORY_SQL}, r AS (SELECT *,
    row_number() OVER (PARTITION BY run_id ORDER BY val_auc DESC, epoch) AS place FROM history)
  SELECT run_id, epoch, val_auc, place::INT AS place FROM r WHERE place <= 2""")
def top_checkpoints(spark, folder):
    return runs.top_checkpoints(v.run_history(spark, folder)).select("run_id", "epoch", "val_auc", "place")
