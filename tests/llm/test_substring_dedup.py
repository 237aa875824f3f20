import random
import re

import pyarrow as pa

from prefrank.llm.similarity import bags, linked, similarity
from prefrank.llm.substring_dedup import repeated_passages, tune_bands
from samples import prose


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_bands_reach_the_recall():
    for threshold, recall, hashes in ((0.8, 0.995, 30), (0.8, 0.9, 16), (0.9, 0.999, 64), (0.5, 0.9, 24)):
        bands, rows = tune_bands(threshold, recall, hashes)
        assert bands * rows <= hashes and 1 - (1 - threshold ** rows) ** bands >= recall


def test_every_shared_run_of_51_words_is_found_and_nothing_else(table):
    rng = random.Random(6)
    passages = [prose(700 + i, 51 + i) for i in range(6)]
    rows, planted = [], {}
    for i in range(60):
        words = prose(i, rng.randrange(5, 200)).split()
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passages[i % 6].split()
            planted.setdefault(i % 6, set()).add(i)
        text = " ".join(words)
        rows.append((i, text if i % 4 else text.replace(" ", "\n", 1)))
    rows += [(200, None), (201, ""), (202, "x " * 500)]
    got = repeated_passages(table(rows, "start")).toPandas()
    assert set(got.doc_id) == set().union(*planted.values())
    for docs in planted.values():
        classes = [set(got[got.doc_id == d].class_id) for d in docs]
        assert set.intersection(*classes)
    text = dict(rows)
    for _, group in got.groupby("class_id"):
        assert (~group.removed).sum() == 1 and len(group) == group.occurrences.iloc[0] and group.doc_id.nunique() > 1
        assert group[~group.removed].doc_id.iloc[0] == group.first_doc_id.iloc[0] == group.doc_id.min()
        blocks = {tuple(words_of(text[r.doc_id][r.start:r.end])) for r in group.itertuples()}
        assert group.paragraph.iloc[0] or len(blocks) == 1


def test_paragraphs_with_edits_form_classes(table):
    rng = random.Random(8)
    base = prose(1, 130).split()
    rows = []
    for i in range(6):
        words = list(base)
        words[rng.randrange(130)] = f"edit{i}"
        rows.append((i, f"{prose(100 + i, 30)}\n{' '.join(words)}\n{prose(200 + i, 30)}"))
    got = repeated_passages(table(rows)).toPandas()
    lines = got[got.paragraph]
    assert lines.class_id.nunique() == 1 and set(lines.doc_id) == set(range(6)) and (lines.n_words == 130).all()


def test_repeats_inside_one_document_and_repeated_rows(table):
    line = prose(3, 30)
    once = repeated_passages(table([(1, f"{line}\n{line}"), (2, prose(4, 30))]))
    assert once.count() == 0
    twice = repeated_passages(table([(1, line), (1, line), (None, line)])).toPandas()
    assert twice.removed.sum() == (~twice.removed).sum() * 2 and (twice.first_doc_id == 1).all()
    assert repeated_passages(table([])).count() == 0


def test_paragraphs_are_compared_by_plain_jaccard(table):
    rows = []
    for i in range(8):
        loop = " ".join([prose(400 + i, 10)] * 25)  # 10 shingles found about 25 times each
        rows += [(2 * i, f"{prose(500 + i, 5)} {loop}"), (2 * i + 1, f"{prose(600 + i, 5)} {loop}")]
    held = bags(pa.array([text for _, text in rows]))
    for a, b in zip(held[::2], held[1::2]):
        assert similarity(a, b) > 0.8 > 0.6 > similarity(a, b, weighted=False)
        assert linked([a], [b], 0.8).all() and not linked([a], [b], 0.8, weighted=False).any()
    got = repeated_passages(table(rows)).toPandas()
    assert not got.paragraph.any()
