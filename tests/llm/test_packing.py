import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prefrank.llm.packing import pack, plan_runs
from prefrank.llm.tokens import WordIds, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(runs):
    places = {}
    for length, first, end, sequence, offset in runs:
        for k in range(end - first):
            places.setdefault(sequence + k, []).append((offset, length))
    return {s: sorted(p) for s, p in places.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_plans_place_every_piece_without_gaps(lengths):
    counts = Counter(lengths)
    runs = plan_runs(dict(counts), 60)
    for length, n in counts.items():
        ranks = sorted(r for a, b in ((r[1], r[2]) for r in runs if r[0] == length) for r in range(a, b))
        assert ranks == list(range(n))
    for places in laid_out(runs).values():
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= 60 and sum(3 * n > 60 for _, n in places) <= 2


def test_large_pieces_are_matched_best():
    assert len(laid_out(plan_runs({35: 2, 25: 2, 30: 3}, 60))) == 4
    assert len(laid_out(plan_runs({40: 1, 21: 1, 20: 1}, 60))) == 2


def test_packing_comes_close_to_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 20000).astype(int) + 1).tolist()
    assert len(laid_out(plan_runs(dict(Counter(lengths))))) <= sum(lengths) / 4096 * 1.01 + 1


def test_lengths_outside_the_capacity_are_errors(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 5000)], "id int, length int"))
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, None)], "id int, length int"))
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0)], "id int, length int"))


TEXTS = ["Hello, WORLD! it's John's 1234. naïve Ünïcode İstanbul ΣΑΣ …  x y", "", None, "a  b\n\tc\r\x0bd\x0c e.", "...,,, a.b, 3.14.",
         "<|endoftext|> and <|ENDOFTEXT|> x<|startoftext|>.", "日本語 テキスト。", "word " * 9000, "é e ́x", "q" * 500, "\x1c\x1d z"]


def test_ids_are_those_of_the_tokenizer():
    tokenizer, known = Tokenizer.from_file(PATH), WordIds(PATH)
    for text in TEXTS:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(known.ids((text or "").encode()), "<u4").tolist() == want, text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    tokenizer = test_ids_of_any_text.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    known = test_ids_of_any_text.__dict__.setdefault("k", WordIds(PATH))
    assert np.frombuffer(known.ids(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip_and_pack(spark, table):
    docs = table([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (0, TEXTS[0])], "length")
    pieces = token_pieces(docs, PATH)
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: r.piece):
        ids = np.array(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length and r.start == 4096 * r.piece
        if r.doc_id not in (None, 0):
            got[r.doc_id] = got.get(r.doc_id, []) + r.ids
    tokenizer = Tokenizer.from_file(PATH)
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS) if i}
    placed = pack(pieces).collect()
    assert len(placed) == pieces.count()
    spans = {}
    for r in placed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(token_pieces(table([]), PATH)).count() == 0


def test_new_words_are_encoded_together():
    known = WordIds(PATH)
    plain, calls = known.tokenizer, []

    class Counting:
        def encode(self, *args, **settings):
            calls.append(args[0])
            return plain.encode(*args, **settings)

    known.tokenizer = Counting()
    for text in (" ".join(f"wq{i}x{'.' * (i % 3)}" for i in range(200)), "É中. İa, ½ \x00 é. a\u00a0b ẞΣ. 😀😀, .. ,", "z" * 100 + ". y" * 70):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.ids(text.encode()), "<u4").tolist() == want
    assert len(calls) < 40
