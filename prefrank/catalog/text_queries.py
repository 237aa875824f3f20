"""Features, input text, tokens, keys."""

from pyspark.sql import functions as F

from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.functions import features, text
from prefrank.operators import dataset, monitoring


@query("struct_features", f"""SELECT doc_id, length(text)::BIGINT AS chars,
  round({v.sentence_words_sql('text')}, 6) AS sentence_words, round({v.ttr_sql('text')}, 6) AS ttr
  FROM documents""")
def struct_features(spark, folder):
    rows = features.with_struct_features(v.table(spark, folder, "documents"), "text", "d")
    return rows.select("doc_id", F.col("d_chars").cast("long").alias("chars"),
                       F.round("d_sentence_words", 6).alias("sentence_words"),
                       F.round("d_ttr", 6).alias("ttr"))


_NAMES = list(zip(
    ("a_chars", "a_sentence_words", "a_ttr", "b_chars", "b_sentence_words", "b_ttr", "len_delta",
     "jaccard", "sentence_delta"), range(9)))


@query("pair_features", f"""WITH {v.PAIRS_SQL}, {v.pair_features_sql('f', 'pairs')}
  SELECT doc_id, {', '.join(f'floor(x{i} * 1e6 + 0.5) / 1e6 AS {n}' for n, i in _NAMES)} FROM f""")
def pair_features(spark, folder):
    rows = features.with_pair_features(v.document_pairs(spark, folder))
    # Ratios can be exact ties, which round() breaks differently in different engines.
    return rows.select("doc_id", *[(F.floor(F.col(n).cast("double") * 1e6 + 0.5) / 1e6).alias(n) for n, _ in _NAMES])


@query("aux_vectors", f"""WITH {v.CLEAN_SQL}, {v.pair_features_sql('f', 'clean')}
  SELECT conversation_id, {', '.join(f'round(x{i}::FLOAT::DOUBLE, 4) AS x{i}' for i in range(12))} FROM f""")
def aux_vectors(spark, folder):
    rows = features.with_aux_vector(dataset.clean_preferences(v.triples(spark, folder)))
    return rows.select("conversation_id", *[
        F.round(F.col("x_aux")[i].cast("double"), 4).alias(f"x{i}") for i in range(12)])


@query("embedding_cosine", """SELECT a.vec_id,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
        (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) *
         sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, folder):
    rows = v.table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select(
        "vec_id", F.round(features.cosine("embedding", "other"), 6).alias("cosine"))


@query("turn_counts", "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def turn_counts(spark, folder):
    return monitoring.turn_counts(v.table(spark, folder, "conversations"), "conv_id")


_INPUT_SQL = ("'[' || segment || '] <prompt>' || prompt || '</prompt> <response_a>' || response_a || "
              "'</response_a> <response_b>' || response_b || '</response_b>'")


@query("input_text", f"WITH {v.CLEAN_SQL} SELECT conversation_id, {_INPUT_SQL} AS input_text FROM clean")
def input_text(spark, folder):
    rows = dataset.clean_preferences(v.triples(spark, folder))
    return rows.select("conversation_id", text.input_text(
        "prompt", "response_a", "response_b", "segment").alias("input_text"))


@query("cache_keys", f"""WITH {v.PAIRS_SQL} SELECT doc_id,
  'pref:' || sha256(prompt || '|' || response_a || '|' || response_b || '|' || segment) AS key FROM pairs""")
def cache_keys(spark, folder):
    rows = v.document_pairs(spark, folder)
    return rows.select("doc_id", text.cache_key(
        "prompt", "response_a", "response_b", "segment").alias("key"))


@query("truncate_tokens", f"""WITH {v.CLEAN_SQL}, t AS (
  SELECT conversation_id, regexp_extract_all(prompt, '\\S+') AS p,
         regexp_extract_all(response_a, '\\S+') AS a, regexp_extract_all(response_b, '\\S+') AS b FROM clean),
  s AS (SELECT *, 64 - 10 - len(p) AS budget FROM t),
  c AS (SELECT *, CASE WHEN budget < 0 THEN 2 ELSE budget // 2 END AS share,
               CASE WHEN budget < 0 THEN 50 ELSE len(p) END AS room FROM s)
  SELECT conversation_id, array_to_string(p[1:room], ' ') AS prompt,
         array_to_string(a[1:share], ' ') AS response_a, array_to_string(b[1:share], ' ') AS response_b FROM c""")
def truncate_tokens(spark, folder):
    rows = dataset.clean_preferences(v.triples(spark, folder))
    kept = rows.select("conversation_id", *[
        text.words(c).alias(c) for c in ("prompt", "response_a", "response_b")]).withColumn(
        "kept", text.truncate_triple("prompt", "response_a", "response_b", 64))
    return kept.select("conversation_id", *[
        F.array_join(F.col("kept")[c], " ").alias(c) for c in ("prompt", "response_a", "response_b")])


@query("pad_encoding", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents),
  ids AS (SELECT doc_id, len(ws) AS n, list_transform(ws[1:256], lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000) AS ids FROM w)
  SELECT doc_id, least(n, 256)::BIGINT AS attended,
    md5(array_to_string(list_concat(ids, list_transform(range(n, 256), lambda i: -1)), ',')) AS ids,
    md5(array_to_string(list_transform(range(0, 256), lambda i: (i < n)::INT), ',')) AS mask FROM ids""")
def pad_encoding(spark, folder):
    """Ids from a hash that SQL has too; both arrays as digests."""
    ids = text.token_ids("text", 50_000, 256, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    rows = v.table(spark, folder, "documents").select("doc_id", text.pad_encoding(ids, 256, -1).alias("e"))
    ones = F.aggregate(F.col("e.attention_mask"), F.lit(0), lambda s, m: s + m)
    return rows.select(
        "doc_id", ones.cast("long").alias("attended"),
        *[F.md5(F.array_join(f"e.{c}", ",")).alias(name) for c, name in (("input_ids", "ids"), ("attention_mask", "mask"))])
