import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import prose

from prefrank.llm.piece_encoding import decode_pieces, encode_pieces
from prefrank.llm.piece_encoding_queries import MODEL, op11_prefix_table
from prefrank.llm.piece_model import PieceModel

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = PieceModel(MODEL)
TEXTS = ["", None, " ", "   ", " a  b ", "Hello\nworld  x\t", "▁a▁▁b", "ＡＢ ﬁ", "\x00\x01", "日本 𠀀 😀", "</s> <unk> <0x41>", "=" * 70,
         "a" * 999, "naïve, l'été; Grüße.\r\n\r\nx", "word " * 500]


def library(text):
    return LIBRARY.encode(text or "", add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\nabtheinr=-1é日"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_and_texts_of_any_text(text):
    ids = list(OWN.encode(text)) + [OWN.end_id]
    assert ids == library(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999), st.just(28705)), max_size=12))
def test_texts_of_any_ids(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_runs_of_pieces():
    rng = random.Random(3)
    pieces = list(OWN.ids)
    for _ in range(3000):
        text = "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(1, 25)))
        assert list(OWN.encode(text)) == LIBRARY.encode(text), text


def test_every_prefix_ends_with_its_entry():
    text = "▁international▁untied's▁1999"
    table = OWN.prefix_table(text)
    for end in range(1, len(text) + 1):
        assert table[end] == LIBRARY.encode(text[1:end])[-1] if end > 1 else OWN.ids["▁"]


def test_pairs_are_compatible_if_the_library_leaves_them():
    rng = random.Random(4)
    tokens = [i for p, i in OWN.ids.items() if "▁" not in p]
    sure = [t for t in tokens if LIBRARY.encode("x " + OWN.pieces[t])[-1] == t]
    for _ in range(3000):
        left, right = rng.choice(tokens), rng.choice(tokens)
        word = OWN.ids["▁"]
        got = LIBRARY.encode(OWN.pieces[left] + OWN.pieces[right])
        if got == [word, left, right]:
            assert OWN.compatible(left, right)
    assert sure


@pytest.mark.parametrize("text", [
    " " * 300_000, "x" * 300_000, "日" * 300_000, "a " * 400_000, prose(1, 60_000), "\n" * 300_000,
    "".join(map(chr, random.Random(5).choices(range(33, 0x2fff), k=200_000)))], ids=range(7))
def test_very_long_texts(text):
    if set(text) == {" "} or set(text) == {"x"}:
        ids = OWN.encode(text)  # the library needs minutes for such a run
        assert OWN.decode(ids) == text
        assert list(OWN.encode(text[:2000])) == LIBRARY.encode(text[:2000])
    else:
        assert list(OWN.encode(text)) == LIBRARY.encode(text)


def test_frames(spark, table):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, TEXTS[3]), (4, "other text")]
    docs = table(rows, "IDS")
    coded = encode_pieces(docs, MODEL)
    assert coded.columns == ["doc_id", "text", "ids"]
    got = decode_pieces(coded, MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library(r.text) and r.decoded == LIBRARY.decode(r.ids)
    plain = decode_pieces(encode_pieces(docs, MODEL, end_id=False), MODEL, text="Text").collect()
    assert sorted(r.Text for r in plain) == sorted((t or "").replace("▁", " ") for _, t in rows)
    both = encode_pieces(docs, MODEL, decoded="text")
    assert both.columns == ["doc_id", "ids", "text"]
    assert sorted((list(r.ids), r.text) for r in both.collect()) == sorted((list(r.ids), r.decoded) for r in got)
    assert decode_pieces(encode_pieces(table([]), MODEL), MODEL).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0xE4, 2, 3 + 0x92])], "k int, ids array<int>")
    assert [r.decoded for r in decode_pieces(odd, MODEL).orderBy("k").collect()] == ["", "", "��"]


@pytest.mark.parametrize("ids", [[-1], [32000], [5, None]])
def test_unknown_ids_are_errors(spark, ids):
    with pytest.raises(Exception, match="ids are numbers|index out of range"):
        decode_pieces(spark.createDataFrame([(ids,)], "ids array<int>"), MODEL).collect()


def test_other_models_are_errors(tmp_path):
    with pytest.raises(Exception):
        PieceModel(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    data = open(MODEL, "rb").read()
    assert data.endswith(b"\x12\x00\x18\x01 \x002\x00")
    (tmp_path / "m").write_bytes(data[:-6] + b"\x18\x01 \x012\x00")  # removes extra blanks
    with pytest.raises(ValueError, match="normalises"):
        PieceModel(str(tmp_path / "m"))


def test_query(spark):
    rows = {r.doc_id: r for r in op11_prefix_table(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
