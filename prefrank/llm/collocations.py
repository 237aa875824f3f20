"""Phrase collocations from a weighted de Bruijn graph of word grams.

Edges are grams of five words between overlapping nodes of four; where a piece ends sooner, the shorter
gram that begins there is kept as a correction. So every position of a text gives one gram, and the
count of a shorter phrase is what flows out of it: the grams that continue it and the corrections that
end with it. Runs of edges without a branch between them are compacted to paths, phrases of
any length with one count.

Grams that cannot hold a phrase often enough are never built: pairs of words are counted by hash slots
first, then triples of those that are frequent; a slot below the least count ends the gram before it (other
phrases keep their exact counts).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefrank.llm.scratch import Scratch, small_batches
from prefrank.llm.words import mix

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
NO_LANG = "und"
#: Text handled at once (twice that if lines are long), and words remembered by a task: below 2**21 numbers in all.
PART_BYTES = 2 << 20
VOCABULARY = 400_000
#: Slots gathered by a task before it hands them on.
GATHERED = 2_000_000
#: Slots of one batch of them.
HANDED_ON = 1 << 17
#: Slots for a count of words, and their bounds: two maps of 32 MB at most. Too few of them only prune less.
WORDS_PER_SLOT = 12
LEAST_BITS, MOST_BITS = 16, 28
#: Edges in a row of a compacted path.
PATH_EDGES = 256

_U = np.uint64
_PLACES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
_BREAK, _NOTHING = 0, 1
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_AHEAD = re.compile(rb"(?: *[^ \n]+){0,%d}" % (LONGEST - 1))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)


class Vocabulary(dict):
    """Word -> number, with a hash and a count of each."""

    def __init__(self, lang: str):
        super().__init__({b"\n": _BREAK, b"": _NOTHING})
        self.seed = _U(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))
        self._hashes = array("Q", [0, 0])
        self.counts = np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self._hashes.append(int.from_bytes(blake2b(word, digest_size=8).digest(), "little"))
        return number

    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, dtype=_U)

    def add(self, numbers: np.ndarray) -> None:
        found = np.bincount(numbers)
        if len(found) > len(self.counts):
            self.counts = np.r_[self.counts, np.zeros(max(len(found), len(self.counts)), np.int64)]
        self.counts[:len(found)] += found


class Kept(dict):
    """Numbers of the words of grams, few beside those of a vocabulary."""

    def __init__(self):
        super().__init__({b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, vocabulary: Vocabulary, columns: list[np.ndarray]) -> list[np.ndarray]:
        used, names = np.unique(np.concatenate(columns)), list(vocabulary)
        own = np.array([self[names[i]] for i in used.tolist()], np.int64)
        return [own[np.searchsorted(used, column)] for column in columns]


def parts(texts: list[bytes], limit: int = PART_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """(owned, ahead): lowered text with breaks as line feeds, cut between words; grams begin in ``owned`` only."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_TABLE)
        if len(text) > limit:
            at = 0
            while len(text) - at > limit:
                cut = text.find(b"\n", at + limit, at + 2 * limit)
                if cut < 0:
                    blank, line = text.find(b" ", at + limit), text.find(b"\n", at + limit)
                    cut = min((p for p in (blank, line) if p >= 0), default=len(text))
                yield text[at:cut], _AHEAD.match(text, cut).group()
                at = cut
            text = text[at:]
        if held and size + len(text) > limit:
            yield b"\n".join(held), b""
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield b"\n".join(held), b""


class Tokens:
    """Words of a part, breaks between pieces among them, and how many of them may begin a gram."""

    def __init__(self, owned: bytes, ahead: bytes, vocabulary: Vocabulary):
        words = owned.replace(b"\n", b" \n ").split(b" ")
        own = len(words)
        words += ahead.split(b" ") if ahead else []
        numbers = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        filled = numbers != _NOTHING
        self.own = int(filled[:own].sum())
        self.place = np.flatnonzero(filled)
        self.words, self.numbers = words, numbers[self.place]
        self.vocabulary = vocabulary

    def slots(self, at: np.ndarray, size: int, bits: int) -> np.ndarray:
        """Slots of the ``size`` words from each position."""
        hashes = self.vocabulary.hashes()[self.numbers]
        code = self.vocabulary.seed + sum(hashes[at + k] * _PLACES[k] for k in range(size))
        return (mix(code) >> _U(64 - bits)).astype(np.int64)

    def pairs(self) -> np.ndarray:
        """Positions of words with a following one in their piece."""
        return np.flatnonzero((self.numbers[:-1] != _BREAK) & (self.numbers[1:] != _BREAK))

    def frequent(self, at: np.ndarray, size: int, bits: int, often: np.ndarray) -> np.ndarray:
        """For every position whether it begins ``size`` words of a frequent slot; ``at``: those that may."""
        slot = self.slots(at, size, bits)
        good = np.zeros(len(self.numbers) + LONGEST, bool)
        good[at] = _BITS[often[slot >> 3], slot & 7]
        return good

    def triples(self, bits: int, often: np.ndarray) -> np.ndarray:
        """Positions that begin two frequent pairs."""
        good = self.frequent(self.pairs(), 2, bits, often)
        return np.flatnonzero(good[:-1] & good[1:])

    def grams(self, bits: int, often: np.ndarray, often3: np.ndarray, kept: Kept) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grams (as two keys of numbers of ``kept``) and counts, of positions that begin a frequent pair.

        A gram goes on as long as its triples are frequent.
        """
        good = self.frequent(self.pairs(), 2, bits, often)
        triple = self.frequent(np.flatnonzero(good[:-1] & good[1:]), 3, bits, often3)
        begin = np.flatnonzero(good[:self.own])
        columns = [self.numbers[begin], self.numbers[begin + 1]]
        on = np.ones(len(begin), bool)
        for j in range(2, LONGEST):
            on = on & triple[begin + j - 2]
            # Breaks are no words: their number fills grams that end sooner.
            columns.append(np.where(on, self.numbers[np.where(on, begin + j, 0)], _BREAK))
        columns = kept.numbers(self.vocabulary, columns)
        # Numbers stay below 2**21, so two 64-bit keys hold a gram exactly.
        high = (columns[0] << 42) | (columns[1] << 21) | columns[2]
        return _summed(high, (columns[3] << 21) | columns[4], np.ones(len(begin), np.int64))


def _summed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys and the sums of their counts."""
    if not len(high):
        return high, low, n
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return high[new], low[new], np.add.reduceat(n[order], new)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    groups: dict[str, list[bytes]] = {}
    langs = batch.column(0).fill_null(NO_LANG).to_pylist()
    for lang, text in zip(langs, batch.column(1).fill_null("").cast(pa.large_binary()).to_pylist()):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _tokens(batches: Iterator[pa.RecordBatch], known: dict[str, Vocabulary]) -> Iterator[tuple[str, Tokens]]:
    for batch in batches:
        for lang, texts in _by_lang(batch):
            for owned, ahead in parts(texts):
                yield lang, Tokens(owned, ahead, known.get(lang) or known.setdefault(lang, Vocabulary(lang)))


_COUNTED = pa.schema([("lang", pa.string()), ("key", pa.binary()), ("c", pa.int64())])


def _counter(bits: int, often=None):
    """Counts of words (lang, word), of all words (lang, null) and of the slots of pairs (null, slot).

    With the frequent pairs: counts of the slots of triples alone.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        gathered, held = [], 0

        def words() -> Iterator[pa.RecordBatch]:
            for lang, vocabulary in known.items():
                n = len(vocabulary) - 2
                counts = np.r_[vocabulary.counts, np.zeros(max(0, n + 2 - len(vocabulary.counts)), np.int64)][2:n + 2]
                keys = pa.array([*list(vocabulary)[2:], None], pa.binary())
                yield pa.record_batch([pa.array([lang] * (n + 1), pa.string()), keys,
                                       pa.array(np.r_[counts, counts.sum()])], schema=_COUNTED)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            slot, n = (np.concatenate(a) for a in zip(*gathered))
            gathered.clear()
            order = np.argsort(slot)
            slot, n = slot[order], n[order]
            del order
            new = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            return slot[new], np.add.reduceat(n, new, dtype=np.int64)

        def slots() -> Iterator[pa.RecordBatch]:
            slot, n = merged()
            for a in range(0, len(slot), HANDED_ON):
                part, counts = slot[a:a + HANDED_ON], n[a:a + HANDED_ON]
                data = pa.py_buffer(part.astype(">u4").tobytes())
                keys = pa.Array.from_buffers(pa.binary(4), len(part), [None, data]).cast(pa.binary())
                yield pa.record_batch([pa.nulls(len(part), pa.string()), keys, pa.array(counts.astype(np.int64))], schema=_COUNTED)

        for _, tokens in _tokens(batches, known):
            if often is None:
                tokens.vocabulary.add(tokens.numbers[:tokens.own])
                at, size = tokens.pairs(), 2
            else:
                at, size = tokens.triples(bits, np.frombuffer(often.value, np.uint8)), 3
            slot, n = np.unique(tokens.slots(at[at < tokens.own], size, bits), return_counts=True)
            if len(slot):
                # A part has fewer than 2**32 words; only merged counts need long numbers.
                gathered.append((slot.astype(np.uint32), n.astype(np.uint32)))
                held += len(slot)
            if held > GATHERED:
                gathered.append(merged())
                held = len(gathered[0][0])
                if held > GATHERED // 2:
                    yield from slots()
                    gathered, held = [], 0
            if sum(map(len, known.values())) > VOCABULARY:
                if often is None:
                    yield from words()
                known.clear()
        if often is None:
            yield from words()
        if gathered:
            yield from slots()

    return count


_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("words", pa.int32()), ("c", pa.int64())])


def _builder(bits: int, often, often3):
    def rows(lang: str, kept: Kept, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        words, mask = list(kept), (1 << 21) - 1
        numbers = np.stack([high >> 42, high >> 21 & mask, high & mask, low >> 21, low & mask])
        length = (numbers != _BREAK).sum(0)
        gram = [b" ".join([words[i] for i in column if i]) for column in numbers.T.tolist()]
        return pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.binary()).cast(pa.string()),
                                pa.array(length, pa.int32()), pa.array(n)], schema=_GRAMS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        kept: dict[str, Kept] = {}
        gathered: dict[str, list] = {}
        held = 0
        maps = [np.frombuffer(o.value, np.uint8) for o in (often, often3)]

        def merge() -> int:
            for lang, parts_ in gathered.items():
                gathered[lang] = [_summed(*(np.concatenate(a) for a in zip(*parts_)))]
            return sum(len(parts_[0][0]) for parts_ in gathered.values())

        def flush() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, [keys] in gathered.items():
                for a in range(0, len(keys[0]), 1 << 16):
                    yield rows(lang, kept[lang], *(k[a:a + (1 << 16)] for k in keys))
            gathered.clear()
            kept.clear()

        for lang, tokens in _tokens(batches, known):
            found = tokens.grams(bits, *maps, kept.setdefault(lang, Kept()))
            if len(found[0]):
                gathered.setdefault(lang, []).append(found)
                held += len(found[0])
            if held > GATHERED:
                held = merge()
            if held > GATHERED // 2 or sum(map(len, kept.values())) > VOCABULARY:
                yield from flush()
                held = 0
            if sum(map(len, known.values())) > VOCABULARY:
                known.clear()
        yield from flush()

    return build


def _first(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def _last(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def _often(slots: DataFrame, bits: int) -> bytes:
    """Bitmap of slots (as big-endian keys): 2**bits bits."""
    slot = F.conv(F.hex("key"), 16, 10).cast("bigint") + 1
    blocks = slots.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    held = bytearray(max(1, 1 << bits >> 3))
    for row in blocks.toLocalIterator():
        begin = (row["block"] - 1) * 4096
        held[begin:begin + 4096] = row["bits"][:len(held) - begin]
    return bytes(held)


class PhraseGraph:
    """Counts of words and grams of a table, built on construction; all tables are saved.

    ``totals`` (lang, n), ``single`` (lang, gram, c), ``grams`` (lang, gram, words, c): one
    gram for each position. ``flow[k]`` (lang, gram, c): phrases of k words; those with ``min_count`` or more are exact and complete.
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 bits: int | None = None):
        spark = docs.sparkSession
        self.scratch = scratch = Scratch(spark, "collocations")
        self.min_count = min_count
        small_batches(spark, 2000)
        table = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
        if bits is None:
            size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            bits = min(MOST_BITS, max(LEAST_BITS, (size // 6 // WORDS_PER_SLOT).bit_length()))
        counted = table.mapInArrow(_counter(bits), "lang string, key binary, c bigint")
        self.counted = scratch.save(
            counted.groupBy("lang", "key").agg(F.sum("c").alias("c")).where(F.col("key").isNull() | (F.col("c") >= min_count)),
            "counted")
        self.totals = self.counted.where("key is null").select("lang", F.col("c").alias("n"))
        self.single = self.counted.where("lang is not null and key is not null").select(
            "lang", F.col("key").cast("string").alias("gram"), "c")
        often = spark.sparkContext.broadcast(_often(self.counted.where("lang is null and key is not null"), bits))
        triples = table.mapInArrow(_counter(bits, often), "lang string, key binary, c bigint").groupBy("key").agg(
            F.sum("c").alias("c")).where(F.col("c") >= min_count)
        often3 = spark.sparkContext.broadcast(_often(triples, bits))
        grams = table.mapInArrow(_builder(bits, often, often3), "lang string, gram string, words int, c bigint")
        self.grams = scratch.save(grams.groupBy("lang", "gram", "words").agg(F.sum("c").alias("c")), "grams")
        self.flow = {LONGEST: self.grams.where(F.col("words") == LONGEST).select("lang", "gram", "c")}
        for k in range(LONGEST - 1, 1, -1):
            ended = self.grams.where(F.col("words") == k).select("lang", "gram", "c")
            out = self.flow[k + 1].select("lang", _first("gram", k).alias("gram"), "c")
            self.flow[k] = scratch.save(
                out.union(ended).groupBy("lang", "gram").agg(F.sum("c").alias("c")), f"flow-{k}")

    def often(self, k: int) -> DataFrame:
        """Phrases of k words with the least count."""
        table = self.single if k == 1 else self.flow[k]
        return table.where(F.col("c") >= self.min_count)

    def paths(self) -> DataFrame:
        """(lang, phrase, c): edges with the least count, runs without a branch compacted.

        A node is passed over if all its flow comes in by one edge and goes out by one. Pointers to earlier edges
        double until they reach the head of a run; a row holds at most `PATH_EDGES` edges.
        """
        edges = self.scratch.save(self.often(LONGEST), "edges")
        k = LONGEST - 1
        into = edges.select("lang", _last("gram", k).alias("node"), F.col("gram").alias("before"), "c")
        out = edges.select("lang", _first("gram", k).alias("node"), "gram", "c")
        nodes = self.often(k).select("lang", F.col("gram").alias("node"), "c")
        step = self.scratch.save(
            into.join(out, ["lang", "node", "c"]).join(nodes, ["lang", "node", "c"], "left_semi").select(
                "lang", "gram", F.col("before").alias("head"), F.lit(1).alias("steps")), "steps")
        while True:
            far = step.select("lang", F.col("gram").alias("head"), F.col("head").alias("far"), F.col("steps").alias("more"))
            if step.join(far, ["lang", "head"], "left_semi").isEmpty():
                break
            step = self.scratch.save(step.join(far, ["lang", "head"], "left").select(
                "lang", "gram", F.coalesce("far", "head").alias("head"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "steps")
        placed = edges.join(step, ["lang", "gram"], "left").select(
            "lang", "gram", "c", F.coalesce("head", "gram").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"))
        runs = placed.groupBy("lang", "head", F.floor(F.col("steps") / PATH_EDGES).alias("part")).agg(
            F.max("c").alias("c"), F.array_sort(F.collect_list(F.struct("steps", "gram"))).alias("run"))
        words = F.concat(F.split(F.col("run")[0]["gram"], " "), F.transform(
            F.slice("run", 2, PATH_EDGES), lambda e: F.substring_index(e["gram"], " ", -1)))
        return runs.select("lang", F.array_join(words, " ").alias("phrase"), "c")


def _windows(paths: DataFrame, k: int) -> DataFrame:
    """(lang, gram, c) of all runs of k words of the paths."""
    words = F.split("phrase", " ")
    return paths.withColumn("words", words).select(
        "lang", "c", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (k - 1))).alias("at")).select(
        "lang", F.array_join(F.slice("words", F.col("at"), k), " ").alias("gram"), "c")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                      top: int = TOP, bits: int | None = None) -> DataFrame:
    """Best-scored phrases of 2 to 5 words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lowered (A-Z) and cut at ``.,;:!?`` and line ends into pieces, pieces at blanks and tabs into words. A
    phrase occurs ``a >= min_count`` times inside pieces, overlaps included; its score is the least
    ``floor(1000 * a * n / (l * r))`` over its cuts into two parts that occur ``l`` and ``r`` times among ``n`` words (of equal
    cuts the first). Phrases inside a longer one as frequent are left out. Ties of scores go by ``a`` and then
    by the phrase. Null texts are empty, null languages are ``und``, repeated rows count again, other columns are
    not read. Texts of any length are read whole, cut between words with the words that follow. An empty
    table, or one without a frequent phrase, gives no rows. ``bits``: size of the hash table that
    prunes rare bigrams; results do not depend on it.
    """
    graph = PhraseGraph(docs, text, lang, min_count, bits)
    scratch = graph.scratch
    paths = scratch.save(graph.paths(), "paths")
    # Longer phrases as frequent cover a phrase: one word more is enough, as counts only fall with length.
    levels, inside = [], []
    for k in range(2, LONGEST + 1):
        found = _windows(paths, LONGEST) if k == LONGEST else graph.often(k)
        levels.append(found.withColumn("k", F.lit(k)))
    for k in range(2, LONGEST - 1):
        longer = graph.often(k + 1)
        inside += [longer.select("lang", part("gram", k).alias("gram"), "c") for part in (_first, _last)]
    inside.append(_windows(paths, LONGEST - 1))
    covered = inside[0]
    for part in inside[1:]:
        covered = covered.union(part)
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.union(level)
    kept = phrases.join(covered.distinct(), ["lang", "gram", "c"], "left_anti")
    counts = graph.often(1)
    for k in range(2, LONGEST):
        counts = counts.union(graph.often(k))
    cuts = kept.select("lang", "gram", "k", F.col("c").alias("a"),
                       F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "gram", "a", "cut", F.expr("substring_index(gram, ' ', cut)").alias("first"),
        F.expr("substring_index(gram, ' ', cut - k)").alias("rest"))
    left = counts.select("lang", F.col("gram").alias("first"), F.col("c").alias("l"))
    right = counts.select("lang", F.col("gram").alias("rest"), F.col("c").alias("r"))
    score = F.expr("(1000BD * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div "
                   "(cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(graph.totals, "lang").select(
        "lang", "gram", "a", "n", F.struct(score.alias("score"), "cut", "l", "r").alias("best"))
    best = scored.groupBy("lang", "gram").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("best").alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("gram"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("gram").alias("phrase"), "a", F.col("best.l").alias("l"),
                         F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
