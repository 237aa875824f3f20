"""Intent detection, routing tables and reasoning prompts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import _col
from prefrank.session import scratch_path

#: Characters of the rules that become one automaton and travel to the tasks with the plan.
SHARD_CHARS = 4_000_000


def detect_intent(message, rules=fixed.INTENT_RULES, default: str = fixed.DEFAULT_INTENT) -> Column:
    """Intent of the first rule whose keyword the lower-cased message contains."""
    lower = F.lower(_col(message))
    return F.coalesce(
        *[F.when(F.contains(lower, F.lit(keyword)), F.lit(intent)) for keyword, intent in rules],
        F.lit(default))


def _first_place(rules: list[tuple]):
    """Function from a batch of texts to the place, in ``rules``, of the first rule whose keyword each contains.

    A trie of the keywords with failure links reports all that a text contains in one run over it. It is
    built with the first batch of a task.
    """
    built = []

    def build():
        import ahocorasick

        trie = ahocorasick.Automaton()
        for place in range(len(rules) - 1, -1, -1):
            if rules[place][1]:
                trie.add_word(rules[place][1], place)  # of equal keywords the first rule stays
        trie.make_automaton()
        return trie if len(trie) else None, next((i for i, r in enumerate(rules) if not r[1]), None)

    def places(texts: pa.Array) -> list[int | None]:
        if not built:
            built.append(build())
        trie, always = built[0]
        found = []
        for text in texts.to_pylist():
            best = None if text is None else always
            if trie is not None and text:
                first = min((place for _, place in trie.iter(text)), default=None)
                best = first if best is None or first is not None and first < best else best
            found.append(best)
        return found

    return places


def _intent_of(rules: list[tuple]):
    places = _first_place(rules)

    @F.arrow_udf("string")
    def intent(texts: pa.Array) -> pa.Array:
        return pa.array([None if i is None else rules[i][2] for i in places(texts)], pa.string())

    return intent


def _place_of(rules: list[tuple]):
    places = _first_place(rules)

    @F.arrow_udf("int")
    def place(texts: pa.Array) -> pa.Array:
        return pa.array(places(texts), pa.int32())

    return place


def _shards(rules: DataFrame) -> tuple[DataFrame, int]:
    """Rules with the number of their shard, of `SHARD_CHARS` characters each on average, and how many there are."""
    size = rules.agg(F.sum(F.length("keyword") + F.length("intent") + 16)).first()[0] or 0
    count = -(-size // SHARD_CHARS) or 1
    return rules.withColumn("_shard", F.pmod(F.xxhash64("keyword"), F.lit(count))), count


def _rules_of(shard: DataFrame) -> list[tuple]:
    """(ord, keyword, intent) in the order in which rules win."""
    rows = [tuple(r) for r in shard.select("ord", "keyword", "intent").collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or ""))


def match_rule_table(df: DataFrame, rules: DataFrame, message: str = "message",
                     default: str = fixed.DEFAULT_INTENT, out: str = "intent") -> DataFrame:
    """The same with rules from a table (ord, keyword, intent).

    The rule with the smallest ``ord`` wins; an empty keyword is in every message. Keywords become an
    automaton that runs once over each message, without a shuffle. Rules of more than `SHARD_CHARS`
    characters are cut into shards by a hash of the keyword; then the different messages are stored and run through one
    shard after the other, each with its own job, and the hits are joined back.
    """
    placed, count = _shards(rules.where(F.col("keyword").isNotNull()))
    lower = F.lower(F.col(message))
    if count == 1:
        found = _rules_of(placed)
        return df.withColumn(out, F.coalesce(_intent_of(found)(lower), F.lit(default)))
    spark = df.sparkSession
    place = scratch_path(spark, "rule-table")
    df.where(F.col(message).isNotNull()).select(lower.alias("_text")).distinct().withColumn(
        "_key", F.md5("_text")).write.parquet(f"{place}/texts")
    texts = spark.read.schema("_text string, _key string").parquet(f"{place}/texts")
    placed.select("ord", "keyword", "intent", "_shard").write.partitionBy("_shard").parquet(f"{place}/rules")
    stored = spark.read.parquet(f"{place}/rules")
    schema = "_key string, ord int, keyword string, intent string"
    for shard in range(count):
        found = _rules_of(stored.where(F.col("_shard") == shard))
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "_at int, ord int, keyword string, intent string")
        hits = texts.withColumn("_at", _place_of(found)("_text")).where("_at is not null")
        hits.join(table, "_at").select("_key", "ord", "keyword", "intent").write.parquet(f"{place}/hits/{shard}")
    hits = spark.read.schema(schema).parquet(*[f"{place}/hits/{shard}" for shard in range(count)])
    best = hits.groupBy("_key").agg(F.min_by("intent", F.struct("ord", "keyword", "intent")).alias("_intent"))
    return (df.withColumn("_own", F.md5(lower)).join(best, F.col("_own") == F.col("_key"), "left")
            .withColumn(out, F.coalesce("_intent", F.lit(default))).drop("_own", "_key", "_intent"))


def _lookup(mapping: dict, key, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(key)), F.lit(default))


def segment_tone(segment) -> Column:
    return _lookup(fixed.SEGMENT_TONES, segment, fixed.DEFAULT_TONE)


def action_hint(intent) -> Column:
    return _lookup(fixed.ACTION_HINTS, intent, fixed.DEFAULT_ACTION_HINT)


def intent_actions(spark) -> DataFrame:
    """Routing table: intent, action, priority, description."""
    return spark.createDataFrame(
        list(fixed.INTENT_ACTIONS), "intent string, action string, priority int, description string")


def segment_policy(spark) -> DataFrame:
    """Policy table: segment, confidence threshold, answer limit, human review."""
    return spark.createDataFrame(
        list(fixed.SEGMENT_POLICY),
        "segment string, confidence_threshold double, max_response_tokens int, require_human_review boolean")


def route(df: DataFrame, actions: DataFrame | None = None, intent: str = "intent",
          default: str = fixed.DEFAULT_INTENT) -> DataFrame:
    """Add action, priority and description; unknown intents follow the default row.

    The routing table carries no broadcast hint: Spark broadcasts it while it is
    below its size threshold and shuffles otherwise.
    """
    actions = intent_actions(df.sparkSession) if actions is None else actions
    fallback = actions.where(F.col("intent") == default)
    named = actions.select(F.col("intent").alias("_intent"), F.struct(
        "action", "priority", "description").alias("_route"))
    otherwise = fallback.agg(F.first(F.struct("action", "priority", "description"))).scalar()
    chosen = F.coalesce(F.col("_route"), otherwise)
    return (df.join(named, df[intent] == F.col("_intent"), "left")
            .withColumns({c: chosen[c] for c in ("action", "priority", "description")})
            .drop("_intent", "_route"))


def reasoning_prompt(message, segment, intent, company: str) -> Column:
    """Fill the reasoning prompt from message, segment and intent."""
    values = {"company": F.lit(company), "tone": segment_tone(segment), "segment": _col(segment),
              "message": _col(message), "intent": _col(intent), "action": action_hint(intent)}
    pieces = []
    for part in fixed.REASONING_PROMPT.split("{"):
        name, brace, tail = part.partition("}")
        pieces += [values[name], F.lit(tail)] if brace else [F.lit(part)]
    return F.concat(*pieces)


def intent_confusion(df: DataFrame, expected: str = "expected_intent",
                     detected: str = "intent") -> DataFrame:
    """Rows per (expected, detected) pair."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(detected).alias("detected")).agg(
        F.count("*").alias("n"))


def intent_accuracy(df: DataFrame, expected: str = "expected_intent",
                    detected: str = "intent") -> DataFrame:
    """Share of rows whose detected intent is the expected one."""
    return df.agg(F.count("*").alias("n"),
                  F.avg((F.col(expected) == F.col(detected)).cast("double")).alias("accuracy"))


def confidence_gate(df: DataFrame, confidence: str = "confidence", segment: str = "segment",
                    policy=fixed.SEGMENT_POLICY) -> DataFrame:
    """Add the segment's threshold and whether a person must look at the row."""
    cases = {name: (threshold, review) for name, threshold, _, review in policy}
    thresholds = F.create_map(*[F.lit(x) for s, (t, _) in cases.items() for x in (s, t)])
    reviews = F.create_map(*[F.lit(x) for s, (_, r) in cases.items() for x in (s, r)])
    limit = F.try_element_at(thresholds, F.col(segment))
    below = F.col(confidence) < limit
    return df.withColumns({
        "confidence_threshold": limit,
        "needs_review": F.coalesce(below | F.try_element_at(reviews, F.col(segment)), F.lit(True)),
    })
