"""Views of the check tables in the shape the operators expect.

Each view exists twice: as a DataFrame and as the SQL text of a common table
expression, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.scoring import FusionHead, softmax


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(values, index) -> Column:
    """The ``index``-th value of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


SEGMENTS = ("MEI", "VAREJO", "CORPORATE")


def triples(spark, folder) -> DataFrame:
    """User turn, the reply after it, and the next reply; unique (conversation, turn) keys."""
    turns = table(spark, folder, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = turns.where(F.col("role") == "assistant")
    first = reply.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_a"))
    second = reply.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("response_b"))
    rows = user.join(first, ["conv_id", "turn"]).join(second, ["conv_id", "turn"], "left")
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("conversation_id"),
        "prompt", "response_a", "response_b",
        pick(("model_a", "model_b", "tie", "tie (bothbad)"), (F.col("conv_id") * 7 + F.col("turn")) % 4)
        .alias("winner"),
        pick(SEGMENTS, F.col("conv_id") % 3).alias("merchant_segment"))


TRIPLES_SQL = """triples AS (
  SELECT u.conv_id || '-' || u.turn AS conversation_id, u.text AS prompt,
         a.text AS response_a, b.text AS response_b,
         ['model_a','model_b','tie','tie (bothbad)'][(u.conv_id * 7 + u.turn) % 4 + 1] AS winner,
         ['MEI','VAREJO','CORPORATE'][u.conv_id % 3 + 1] AS merchant_segment
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn + 3 AND b.role = 'assistant'
  WHERE u.role = 'user')"""

CLEAN_ONLY_SQL = """clean AS (
  SELECT conversation_id, prompt, response_a, response_b,
         CASE WHEN upper(merchant_segment) IN ('MEI','VAREJO','CORPORATE')
              THEN upper(merchant_segment) ELSE 'VAREJO' END AS segment,
         CASE lower(winner) WHEN 'model_a' THEN 0 WHEN 'model_b' THEN 1
              WHEN 'tie' THEN 2 WHEN 'tie (bothbad)' THEN 2 END AS label
  FROM triples
  WHERE prompt IS NOT NULL AND response_a IS NOT NULL AND response_b IS NOT NULL)"""
CLEAN_SQL = f"{TRIPLES_SQL}, {CLEAN_ONLY_SQL}"


def document_pairs(spark, folder) -> DataFrame:
    """Each document against the next one."""
    docs = table(spark, folder, "documents")
    left = docs.select("doc_id", F.col("source").alias("prompt"), F.col("text").alias("response_a"))
    right = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("response_b"))
    return left.join(right, "doc_id").withColumn("segment", pick(SEGMENTS, F.col("doc_id") % 3))


PAIRS_SQL = """pairs AS (
  SELECT l.doc_id, l.source AS prompt, l.text AS response_a, r.text AS response_b,
         ['MEI','VAREJO','CORPORATE'][l.doc_id % 3 + 1] AS segment
  FROM documents l JOIN documents r ON r.doc_id = l.doc_id + 1)"""


def vector_predictions(spark, folder) -> DataFrame:
    """Logits from the first three vector components."""
    rows = table(spark, folder, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 10)
    return rows.select(
        "vec_id", (F.col("label") % 3).cast("int").alias("label"), logits.alias("logits"),
        pick(SEGMENTS, F.col("vec_id") % 3).alias("segment"),
    ).withColumn("probabilities", softmax("logits"))


def _softmax_sql(name: str, source: str) -> str:
    """Common table expressions turning l0, l1, l2 into p0, p1, p2, conf, pred."""
    return f"""{name}_e AS (
  SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
         exp(l2 - greatest(l0, l1, l2)) AS e2 FROM {source}),
{name}_p AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1,
         e2 / (e0 + e1 + e2) AS p2 FROM {name}_e),
{name} AS (SELECT *, greatest(p0, p1, p2) AS conf,
         CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM {name}_p)"""


VECTORS_SQL = """vectors AS (
  SELECT vec_id, label % 3 AS label, embedding[1]::DOUBLE * 10 AS l0, embedding[2]::DOUBLE * 10 AS l1,
         embedding[3]::DOUBLE * 10 AS l2, ['MEI','VAREJO','CORPORATE'][vec_id % 3 + 1] AS segment
  FROM embeddings), """ + _softmax_sql("preds", "vectors")


def order_predictions(spark, folder) -> DataFrame:
    """A large prediction table: return flag against price and discount of a line."""
    rows = table(spark, folder, "lineitem")
    logits = F.array(F.col("l_extendedprice") / 50000, F.col("l_discount") * 20, F.lit(0.5))
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return rows.select(label.alias("label"), F.col("l_linestatus").alias("model"),
                       softmax(logits).alias("probabilities"))


ORDERS_SQL = """lines AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS label,
         l_linestatus AS model, l_extendedprice / 50000 AS l0, l_discount * 20 AS l1, 0.5::DOUBLE AS l2
  FROM lineitem), """ + _softmax_sql("preds", "lines")


def requests(spark, folder) -> DataFrame:
    """Served requests with latency, intent and segment."""
    rows = table(spark, folder, "events")
    return rows.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("intent"), pick(SEGMENTS, F.col("user_id") % 3).alias("segment"),
        F.col("value").alias("latency_ms"))


REQUESTS_SQL = """requests AS (
  SELECT event_id, user_id, ts, event_type AS intent,
         ['MEI','VAREJO','CORPORATE'][user_id % 3 + 1] AS segment, value AS latency_ms
  FROM events)"""


def run_history(spark, folder) -> DataFrame:
    """Orders per month and priority read as epochs of five runs."""
    rows = table(spark, folder, "orders")
    month = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate")).cast("int")
    return rows.groupBy(F.col("o_orderpriority").alias("run_id"), month.alias("epoch")).agg(
        F.round(F.avg("o_totalprice") / 1000000, 4).alias("val_auc"))


HISTORY_SQL = """history AS (
  SELECT o_orderpriority AS run_id,
         CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) AS INTEGER) AS epoch,
         round(avg(o_totalprice) / 1000000, 4) AS val_auc
  FROM orders GROUP BY 1, 2)"""


def example_head(embedding_dim: int = 0) -> FusionHead:
    """Fusion head with weights from a rule; the same rule is used in the oracle."""
    size = len(PROJECTION)
    projection = [[PROJECTION[i] if i == j else 0.0 for j in range(size)] for i in range(size)]
    width = embedding_dim + size
    return FusionHead(projection, [0.01] * size,
                      [[_weight(c, j) for j in range(width)] for c in range(3)],
                      [0.1, 0.0, -0.1])


PROJECTION = (1e-4, 0.05, 1.0, 1e-4, 0.05, 1.0, 1.0, 1.0, 0.05, 1.0, 1.0, 1.0)


def _weight(c: int, j: int) -> float:
    return ((c * 7 + j * 13) % 11 - 5) / 50


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '\\S+')"


def sentence_words_sql(text: str) -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    kept = f"list_filter(string_split({text}, '.'), lambda s: length(trim(s, {blank})) > 0)"
    return (f"coalesce(list_avg(list_transform({kept}, "
            f"lambda s: len(regexp_extract_all(s, '\\S+')))), 0)")


def ttr_sql(text: str) -> str:
    return f"coalesce(len(list_distinct({_words(text)}))::DOUBLE / nullif(len({_words(text)}), 0), 0)"


def jaccard_sql(a: str, b: str) -> str:
    both = f"list_distinct(list_concat({_words(a)}, {_words(b)}))"
    shared = f"list_intersect(list_distinct({_words(a)}), list_distinct({_words(b)}))"
    return f"coalesce(len({shared})::DOUBLE / nullif(len({both}), 0), 0)"


def pair_features_sql(name: str, source: str, a: str = "response_a", b: str = "response_b") -> str:
    """Common table expressions adding the twelve features x0..x11 to ``source``."""
    return f"""{name}_s AS (
  SELECT *, length({a})::DOUBLE AS x0, {sentence_words_sql(a)} AS x1, {ttr_sql(a)} AS x2,
         length({b})::DOUBLE AS x3, {sentence_words_sql(b)} AS x4, {ttr_sql(b)} AS x5,
         {jaccard_sql(a, b)} AS x7 FROM {source}),
{name} AS (
  SELECT *, abs(x0 - x3) / greatest(x0 + x3, 1) AS x6, abs(x1 - x4) AS x8,
         (segment = 'MEI')::INT::DOUBLE AS x9, (segment = 'VAREJO')::INT::DOUBLE AS x10,
         (segment = 'CORPORATE')::INT::DOUBLE AS x11 FROM {name}_s)"""


def fusion_sql(name: str, source: str, embedding_dim: int = 0) -> str:
    """Common table expression adding logits l0, l1, l2 of :func:`example_head`.

    Features pass through single precision, as the stored vector does.
    """
    hidden = [f"greatest({w!r} * x{j}::FLOAT::DOUBLE + 0.01, 0)" for j, w in enumerate(PROJECTION)]
    logits = []
    for c, bias in enumerate((0.1, 0.0, -0.1)):
        terms = [f"{_weight(c, j)!r} * embedding[{j + 1}]::DOUBLE" for j in range(embedding_dim)]
        terms += [f"{_weight(c, embedding_dim + j)!r} * {h}" for j, h in enumerate(hidden)]
        logits.append(f"{bias!r} + " + " + ".join(terms) + f" AS l{c}")
    return f"{name} AS (SELECT *, " + ", ".join(logits) + f" FROM {source})"


def softmax_sql(name: str, source: str) -> str:
    return _softmax_sql(name, source)


MAIN_RULES_SQL = tuple((pattern, placeholder) for _, pattern, placeholder in fixed.PII_MAIN)
PORTUGUESE_RULES_SQL = tuple((pattern, placeholder) for _, pattern, placeholder in fixed.PII_PORTUGUESE)


def redact_sql(text: str, rules=MAIN_RULES_SQL) -> str:
    """Chained replacement; the extra step evens out ASCII word boundaries after a card."""
    for pattern, placeholder in rules:
        text = f"regexp_replace({text}, '{pattern}', '{placeholder}', 'g')"
        if "CARD" in placeholder or "CARTAO" in placeholder:
            mark = placeholder.strip("[]")
            text = (f"regexp_replace({text}, '\\[{mark}\\][ -]([^\\x00-\\x7f])', "
                    f"'{placeholder}\\1', 'g')")
    return text


def pii_sql(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p, _ in MAIN_RULES_SQL) + ")"
