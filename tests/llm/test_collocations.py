import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from samples import prose

from prefrank.llm import collocations
from prefrank.llm.collocations import PhraseGraph, mine_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return n, f


def mined(rows, least, top=2000):
    n, f = counted(rows)
    out = []
    for lang in f:
        often = {p: c for p, c in f[lang].items() if c >= least}
        phrases = []
        for p, a in often.items():
            words = p.split(" ")
            if len(words) == 1 or any(c == a and len(q) > len(p) and f" {p} " in f" {q} " for q, c in often.items()):
                continue
            best = min((1000 * a * n[lang] // (f[lang][" ".join(words[:j])] * f[lang][" ".join(words[j:])]), j)
                       for j in range(1, len(words)))
            j = best[1]
            phrases.append((-best[0], -a, p.encode(), f[lang][" ".join(words[:j])], f[lang][" ".join(words[j:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def run(spark, rows, least, **options):
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id int, lang string, text string, rank string")
    return sorted(tuple(r) for r in mine_collocations(docs, min_count=least, **options).collect())


def texts(seed, n, words="a b c dd É ee A. B, c; \t f\n 日本 ' g\x00".split(" ")):
    rng = random.Random(seed)
    known = [" ".join(rng.choices(words, k=rng.randrange(2, 14))) for _ in range(4)]
    return [(rng.choice(["en", "fr", None, "und"]), " ".join(
        rng.choice(known) if rng.random() < .4 else rng.choice([*words, "  "]) for _ in range(rng.randrange(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed, least, bits", [(1, 3, None), (2, 5, 3), (3, 2, 16)])
def test_against_counting_everything(spark, seed, least, bits):
    rows = texts(seed, 60) + [(None, None), ("en", ""), ("xx", "."), ("en", "\n\t "), ("", "q r q r q r q r q r")]
    got = run(spark, rows, least, bits=bits)
    assert got and got == mined(rows, least)


def test_long_passages_become_paths(spark):
    passage = prose(7, 300)
    rows = [("en", passage + ". " + prose(20 + i, 30)) for i in range(4)] + [("en", " ".join(passage.split()[100:120]))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = passage.split()
    # Nodes where another text begins or ends are no inner ones: the run of 20 words is a path of its own.
    want = [(words[:104], 4), (words[100:120], 5), (words[116:], 4)]
    got = PhraseGraph(docs, min_count=4).paths().collect()
    assert sorted((r.phrase, r.c) for r in got) == sorted((" ".join(w), c) for w, c in want)
    assert run(spark, rows, 4) == mined(rows, 4)


def test_runs_longer_than_a_row(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PATH_EDGES", 8)
    rows = [("en", prose(9, 40))] * 3 + [("de", prose(9, 40))] * 2
    assert run(spark, rows, 2) == mined(rows, 2)


def test_ties_and_the_first_ranks(spark):
    rows = [("en", f"{w} x{w}. ") for w in "é z a b ab".split()] * 3
    got = run(spark, rows, 3, top=3)
    assert got == mined(rows, 3, 3) and [r[2] for r in got] == ["a xa", "ab xab", "b xb"]


def test_very_long_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 300)
    rng = random.Random(11)
    line = " ".join(rng.choices("a b c d eee".split(), k=6000))
    rows = [("en", line), ("en", line.replace("a b", "a. b")), ("en", "q" * 2000 + " a b " + "r" * 900), ("en", " " * 3000 + "a b\t\tc")]
    assert run(spark, rows, 40) == mined(rows, 40)


def test_parts_own_every_word_once():
    rng = random.Random(12)
    for limit in (1, 2, 7, 20):
        text = "".join(rng.choices("ab  .\n", k=400)).encode()
        got = list(collocations.parts([text, b"c d", b""], limit))
        words = [w for owned, _ in got for w in re.findall(rb"[^ \n]+", owned)]
        assert words == re.findall(rb"[^ \n.]+", text + b" c d")
        for owned, ahead in got:
            assert len(ahead.split()) <= 4


def test_a_million_words(spark):
    rows = [("en", " ".join(["tick tock"] * 250_000)), ("en", "tick" + " " * 500_000 + "tock")]
    got = run(spark, rows, 100)
    assert got == mined(rows, 100) and got[0][2:4] == ("tick tock", 250_001)


def test_nothing_to_find(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [("en", None), (None, "one two. three")], 2) == []


def test_scores_pass_64_bits(spark):
    rows = [("en", "a b")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert [r.score for r in mine_collocations(docs, min_count=5).collect()] == [1000 * 5 * 10 // 25]
    big = spark.sql("SELECT (1000BD * cast(4000000000000000 as decimal(16,0)) * cast(9000000000000000 as decimal(16,0))) div "
                    "(cast(5000000000000000 as decimal(18,0)) * cast(4000000000000000 as decimal(18,0))) AS s").first().s
    assert big == 1000 * 4 * 9 * 10 ** 30 // (5 * 4 * 10 ** 30)


def test_slots_are_merged_and_handed_on_in_small_batches(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=200)) for _ in range(20)]

    def slots(gathered):
        monkeypatch.setattr(collocations, "GATHERED", gathered)
        monkeypatch.setattr(collocations, "HANDED_ON", 64, raising=False)
        batches = (pa.record_batch([pa.array(["en"]), pa.array([t])], ["lang", "text"]) for t in texts)
        counts, most = Counter(), 0
        for batch in collocations._counter(20)(batches):
            if batch.column(0).null_count:
                most = max(most, batch.num_rows)
                counts.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
        return counts, most

    (once, a), (often, b) = slots(10 ** 6), slots(300)
    assert once == often and sum(once.values()) == 20 * 199
    assert max(a, b) <= 64
