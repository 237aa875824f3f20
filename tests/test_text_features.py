import hashlib

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefrank.functions import features, text

TEXT = st.text(alphabet=st.sampled_from(list("abAB.. \n\t \x1cçÉ")), max_size=30)


def sentence_mean(value):
    parts = [p for p in value.split(".") if p.strip()]
    return sum(len(p.split()) for p in parts) / len(parts) if parts else 0.0


def ratio(value):
    tokens = value.lower().split()
    return len(set(tokens)) / len(tokens) if tokens else 0.0


def overlap(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, TEXT, st.sampled_from(["MEI", "VAREJO", "CORPORATE"])), min_size=5, max_size=30))
def test_vector_equals_definition(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, response_a string, response_b string, segment string")
    got = features.with_aux_vector(df).orderBy("i").collect()
    for row, (a, b, segment) in zip(got, rows):
        want = [len(a), sentence_mean(a), ratio(a), len(b), sentence_mean(b), ratio(b),
                abs(len(a) - len(b)) / max(len(a) + len(b), 1), overlap(a, b),
                abs(sentence_mean(a) - sentence_mean(b)),
                *[float(segment == s) for s in ("MEI", "VAREJO", "CORPORATE")]]
        assert np.array_equal(np.float32(row["x_aux"]), np.float32(want))


def test_every_feature_is_computed_once(spark):
    df = spark.createDataFrame([("a b", "b c", "MEI")], "response_a string, response_b string, segment string")
    plan = features.with_aux_vector(df)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("array_distinct("), plan.count("array_intersect("), plan.count("lower(")) == (2, 1, 2)


def test_loops_over_words_are_evaluated_apart(spark):
    df = spark.createDataFrame([("a b. c a", "b c", "MEI"), (None, "", "MEI")], "response_a string, response_b string, segment string")
    found = features.with_pair_features(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(array(struct(") == 7  # words, words of a sentence and distinct words of two texts; the common words
    first, second = found.collect()
    assert [first[c] for c in features.PAIR_FEATURES] == [8, 2.0, 0.75, 3, 2.0, 1.0, 5 / 11, 0.25, 0.0]
    assert second["a_chars"] is None and second["b_ttr"] == 0.0


def test_words_are_taken_out_of_a_text_once(spark):
    df = spark.createDataFrame([("a b", "b c", "MEI")], "response_a string, response_b string, segment string")
    for found, texts in ((features.with_pair_features(df), 2), (features.with_struct_features(df, "response_a", "x"), 1)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f"{text.WORD}, 0)") == plan.count("]+, 0)") == texts


def test_words_of_sentences_at_every_space_and_stop(column):
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    marks = [*spaces, ".", "/", "-", "!", "~", "\x7f", "\x00", "\u200b", "\u0130", "é", "語", "\U0001f600", "\U0001d400"]
    values = [f"{a}.{b}x" for a in marks for b in marks] + [f"x{a}{b}." for a in marks for b in marks] + [
        "...", ". . .", ".a", "a.", "..a..b..", "a .b", "a. b", "a.b.c d", ".\U0001f600.\U0001f600", "\U0001f600.", " .", ""]
    assert column(features.words_per_sentence("t"), values) == [sentence_mean(v) for v in values]
    assert column(features.words_per_sentence("t", F.size(features.lower_words("t"))), values) == [sentence_mean(v) for v in values]
    assert column(text.words("t"), values) == [v.split() for v in values]


def test_known_values(column):
    assert column(features.type_token_ratio(features.lower_words("t")),
                  ["one two three four", "the the the the", ""]) == [1.0, 0.25, 0.0]
    assert column(features.words_per_sentence("t"), ["hello world how are you", "", "a b. c."]) == [5.0, 0.0, 1.5]
    assert column(features.finite(F.col("t")), [float("nan"), float("inf"), float("-inf"), 2.5], "double") == [
        0.0, 1e6, -1e6, 2.5]
    assert column(features.segment_index("t"), ["MEI", "CORPORATE", "x"]) == [0, 2, None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(features.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(2 ** -0.5)
    assert got[1] is None


def test_input_text_and_key(spark):
    df = spark.createDataFrame([("p", "a", "b", "MEI")], "p string, a string, b string, s string")
    row = df.select(text.input_text("p", "a", "b", "s").alias("x"), text.cache_key("p", "a", "b", "s", "ns:").alias("k")).first()
    assert row.x == "[MEI] <prompt>p</prompt> <response_a>a</response_a> <response_b>b</response_b>"
    assert row.k == "ns:" + hashlib.sha256(b"p|a|b|MEI").hexdigest()


@pytest.mark.parametrize("sizes,limit,want", [
    ((5, 20, 20), 30, (5, 7, 7)), ((5, 2, 20), 30, (5, 2, 7)), ((40, 9, 9), 30, (16, 2, 2)),
    ((20, 9, 9), 30, (20, 0, 0)), ((3, 9, 9), 12, (0, 2, 2))])
def test_truncation(spark, sizes, limit, want):
    df = spark.createDataFrame([tuple(list(range(n)) for n in sizes)], "p array<int>, a array<int>, b array<int>")
    got = df.select(text.truncate_triple("p", "a", "b", limit).alias("t")).first().t
    assert tuple(len(x) for x in got) == want
    assert all(list(x) == list(range(len(x))) for x in got)


def test_encoding(spark):
    df = spark.createDataFrame([("um dois  três",), ("",)], "t string")
    rows = df.select(text.pad_encoding(text.token_ids("t", 1000), 2).alias("e"),
                     text.pad_encoding(text.token_ids("t", 1000), 5, -1).alias("l")).collect()
    ids = [(np.int64(np.uint64(xxhash.xxh64(w.encode(), seed=42).intdigest()).astype(np.int64))) % 1000
           for w in ("um", "dois", "três")]
    assert rows[0].e.input_ids == ids[:2] and rows[0].e.attention_mask == [1, 1]
    assert rows[0].l.input_ids == [*ids, -1, -1] and rows[0].l.attention_mask == [1, 1, 1, 0, 0]
    assert rows[1].l.attention_mask == [0] * 5


def test_markers(column):
    assert column(text.between("t", "<think>", "</think>"), [
        "antes <think>conteúdo\n pensamento</think> depois </think>", "nada", "<think>só início"]) == [
        "conteúdo\n pensamento", "", ""]
    assert column(text.after("t", "</think>"), ["</think>resposta", "a</think>b</think>c", "nada"]) == [
        "resposta", "b</think>c", ""]
    parsed = column(text.parse_generated("t"), ["<think>x</think> sim ", "<think>x</think>  ", " só texto "])
    assert [(p.thinking, p.response) for p in parsed] == [
        ("x", "sim"), ("x", "<think>x</think>"), ("", "só texto")]


def test_cuts(column):
    assert column(text.cut("t", 3), ["abcd", "ab"]) == ["abc", "ab"]
    assert column(text.ellipsis("t", 3), ["abcd", "abc"]) == ["abc...", "abc"]
