import re

from hypothesis import given, settings
from hypothesis import strategies as st

from prefrank.llm.quality_rules import apply_rules
from samples import prose

BLANK = r"[\x20\x09-\x0D]"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    at, covered = {}, set()
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(k for i in places for k in range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, kept string")
    for r in apply_rules(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == by_hand(texts[r.doc_id]), texts[r.doc_id]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab #|\n\t\u00a0\x1fé😀", max_size=90), min_size=1, max_size=40))
def test_counts_of_any_text(spark, texts):
    check(spark, texts)


def test_counts_of_long_and_odd_texts(spark):
    run = prose(1, 12)
    check(spark, [None, "", " \n\t ", f"{run} {run}", f"{run} x {run} y {run}", "a " * 40, "a b " * 30, prose(2, 5000),
                  prose(3, 300) + " " + run + "\n" + prose(4, 300) + " " + run, "x\n\nx\n \nx \nx", "é😀" * 30])


def test_verdicts(spark):
    good = "\n".join(prose(i, 30) + "." for i in range(4))
    menu = " | ".join(prose(9, 40).split())
    soup = " ".join(w + "***" for w in prose(10, 60).split())
    shout = " ".join(w.upper() + "!!" for w in prose(11, 60).split())
    texts = {1: (good, True), 2: (f"{good}\nHome | About | News | Help\nAll rights reserved.", True), 3: (menu, False), 4: (soup, False),
             5: (shout, False), 6: (f"{prose(12, 25)}.\n{shout}", False), 7: (prose(13, 19), False), 8: (None, False), 9: (good, True)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id int, text string")
    got = {r.doc_id: r for r in apply_rules(docs).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: keep for i, (_, keep) in texts.items()}
    assert got[2].cleaned == good and got[8].cleaned == ""
    assert apply_rules(docs.where("false")).count() == 0


def test_the_plan_is_native(spark, capsys):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    apply_rules(docs).explain()
    assert not re.search("Python|Arrow|Pandas|Exchange", capsys.readouterr().out)
