"""Query of phrase collocations over ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.collocations import mine_collocations

OP12_SQL = r"""WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
  lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
  places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
  grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM places, range(1, 6) t(k)
    WHERE i + k - 1 <= len(ws)),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
  totals AS (SELECT lang, sum(len(ws)) AS n FROM lists GROUP BY lang),
  kept AS (SELECT p.lang, p.k, p.phrase, p.f AS a FROM f p WHERE p.k > 1 AND NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = p.lang AND q.k > p.k AND 100 * q.f >= 100 * p.f
      AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
  cuts AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM kept),
  scored AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, t.n,
      (1000::HUGEINT * c.a::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')
    JOIN totals t ON t.lang = c.lang),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
  SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""


def op12_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
