"""Training on the combined loss."""

from pyspark.sql import functions as F

from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.catalog.scoring_queries import _REDACTED_SQL, _rounded
from prefrank.operators import metrics, runs
from prefrank.plans import preference_training as training
from prefrank.session import reliable_checkpoint, scratch_path

_LABELLED_SQL = f"""{v.PAIRS_SQL}, labelled AS (SELECT pairs.*, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS label
  FROM pairs JOIN labels USING (doc_id))"""


def labelled_pairs(spark, folder):
    """Document pairs with a class from the labels of the first one."""
    labels = v.table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("label"))
    return v.document_pairs(spark, folder).join(labels, "doc_id").withColumn(
        "conversation_id", F.col("doc_id").cast("string"))


@query("train_classifier", f"""WITH {_LABELLED_SQL}, fitted AS (SELECT label FROM labelled WHERE doc_id % 5 <> 0 AND label IS NOT NULL)
  SELECT c::INT AS label, (SELECT count(*) FROM fitted) AS fitted,
    round(0.9 * (SELECT avg((label = c)::INT) FROM fitted) + 0.1 / 3, 4) AS mean_probability FROM range(0, 3) r(c)""")
def train_classifier(spark, folder):
    """Fit four fifths of the pairs to convergence on the classification loss, without a hidden layer.

    At its minimum the mean probability of a class is its mean smoothed target, as biases carry no penalty.
    """
    fitted = labelled_pairs(spark, folder).where(F.col("doc_id") % 5 != 0)
    rows = training.training_rows(fitted, hidden=False)
    head, _ = training.minimize(rows, training.Objective(cls_weight=1.0, l2=0.01), tolerance=1e-8)
    means = training.predict_rows(head, rows).agg(
        F.count("*").alias("fitted"), *[F.avg(F.col("probabilities")[c]).alias(f"p{c}") for c in range(3)])
    return means.select("fitted", F.inline(F.array(*[
        F.struct(F.lit(c).alias("label"), F.round(f"p{c}", 4).alias("mean_probability")) for c in range(3)])))


@query("train_epochs")
def train_epochs(spark, folder):
    """Epochs on the combined loss with early stopping; the history, and the best head's metrics on rows held out."""
    pairs = labelled_pairs(spark, folder).select(
        "doc_id", "conversation_id", "prompt", "response_a", "response_b", "segment", "label")
    rows, held_out = (training.training_rows(pairs.where(part), steps=4) for part in ("doc_id % 5 <> 0", "doc_id % 5 = 0"))
    path = scratch_path(spark, "training")
    head = training.train(rows, path, "epochs", held_out, schedule=training.Schedule(epochs=4, steps=4, learning_rate=0.05))
    best = metrics.evaluation_metrics(reliable_checkpoint(training.predict_rows(head, held_out))).first()
    history = runs.early_stopping(training.run_history(spark, path))
    return history.select("epoch", "loss", "cls_loss", "rank_loss", "val_auc", "stop_epoch", "best_epoch",
                          *[F.lit(best[c]).alias(f"best_{c}") for c in ("auc", "accuracy", "log_loss")])


@query("training_objective", f"""WITH {_LABELLED_SQL}, clean AS (SELECT * FROM labelled WHERE label IS NOT NULL
    AND trim(coalesce(prompt, '')) <> '' AND trim(response_a) <> '' AND trim(response_b) <> ''),
  {_REDACTED_SQL}, {v.pair_features_sql('f', 'redacted')}, {v.fusion_sql('logit', 'f')}, {v.softmax_sql('preds', 'logit')},
  terms AS (SELECT label, -(CASE WHEN label = 0 THEN 0.9 + 0.1 / 3 ELSE 0.1 / 3 END) * ln(p0)
      - (CASE WHEN label = 1 THEN 0.9 + 0.1 / 3 ELSE 0.1 / 3 END) * ln(p1)
      - (CASE WHEN label = 2 THEN 0.9 + 0.1 / 3 ELSE 0.1 / 3 END) * ln(p2) AS cls,
    CASE WHEN label = 0 THEN greatest(0, 0.1 - (p0 - p1)) WHEN label = 1 THEN greatest(0, 0.1 + (p0 - p1)) END AS rnk FROM preds)
  SELECT round(avg(cls), 6) AS cls_loss, round(avg(rnk), 6) AS rank_loss,
    round(0.7 * avg(cls) + 0.3 * coalesce(avg(rnk), 0), 6) AS loss FROM terms""")
def training_objective(spark, folder):
    """The trainer's own loss of a given head, summed in partitions."""
    losses = training.objective_value(training.training_rows(labelled_pairs(spark, folder)), v.example_head())
    return _rounded(spark.createDataFrame([(losses["cls_loss"], losses["rank_loss"], losses["loss"])],
                                          "cls_loss double, rank_loss double, loss double"), "cls_loss", "rank_loss", "loss")
