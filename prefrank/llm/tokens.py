"""Sub-word token ids of whole texts with a given tokenizer file.

The tokenizers this is for drop white space and never let a token cross it, so the ids of a
text are the ids of its words one after the other. A worker keeps the ids of words it has met;
only new words go through the merges.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import small_batches, tidy
from prefrank.llm.words import utf8

#: Words remembered by a worker (about 200 bytes each), and their longest.
CACHED_WORDS = 400_000
CACHED_BYTES = 64
#: New words of a text that go through the merges by one call.
WORDS_AT_ONCE = 64

_caches: dict[str, WordIds] = {}


def _stem(word: bytes) -> bytes:
    """The word without a full stop or comma after a letter or digit, which is a token of its own."""
    return word[:-1] if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalnum() else word


class WordIds(dict):
    """Word (UTF-8) -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalnum():
            ids = self[word[:-1]] + self[word[-1:]]  # punctuation after a letter or digit is a token of its own
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < CACHED_WORDS and len(word) <= CACHED_BYTES:
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        # Special tokens are matched before letters are lowered, so texts that may hold one stay as they are.
        if b"<|" in text:
            return b"".join(map(self.__getitem__, text.split()))
        words = text.lower().split()
        found = list(map(self.get, words))
        if None in found:
            stems = {_stem(w) for w, ids in zip(words, found) if ids is None and len(w) <= CACHED_BYTES}
            new = self._encoded([w for w in stems if w not in self])
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    stem = _stem(word)
                    ids = new.get(stem) or self[stem]
                    found[i] = ids = ids if stem is word else ids + self[word[-1:]]
                    if len(self) < CACHED_WORDS and len(word) <= CACHED_BYTES:
                        self[word] = ids
        return b"".join(found)

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words, many of them by one call: a token begins in the word that it belongs to."""
        known = {}
        for a in range(0, len(words), WORDS_AT_ONCE):
            part = words[a:a + WORDS_AT_ONCE]
            texts = [w.decode() for w in part]
            coded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            begins = [begin for begin, _ in coded.offsets]
            at, place = 0, 0
            for word, text in zip(part, texts):
                place += len(text) + 1
                end = bisect_left(begins, place, at)
                known[word] = ids[4 * at:4 * end]
                at = end
            if len(self) < CACHED_WORDS:
                self.update((w, known[w]) for w in part)
        return known


def _ids_of(path: str) -> WordIds:
    if path not in _caches:
        _caches[path] = WordIds(path)
    return _caches[path]


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    kind = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:array<int>" * keep_ids

    @F.arrow_udf(f"array<struct<{kind}>>")
    def cut(texts: pa.Array) -> pa.Array:
        known, tail = _ids_of(path), np.array([end_id], "<u4").tobytes()
        data, offsets = utf8(texts)
        piece, start, length, crc, ids, bounds = [], [], [], [], [], [0]
        for i in range(len(texts)):
            coded = known.ids(data[offsets[i]:offsets[i + 1]].tobytes()) + tail
            for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                part = coded[at:at + 4 * capacity]
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            bounds.append(len(piece))
        columns = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                   "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if keep_ids:
            columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
        rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = 4096, end_id: int = 1,
                 keep_ids: bool = True) -> DataFrame:
    """One row for each piece of each text: ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids``.

    A text is its token ids and then ``end_id``, cut into pieces of ``capacity`` ids; null and empty
    texts are the end id alone. Other columns but ``text`` pass through, those with an added name
    are replaced. ``tokenizer`` is the path of a file that every executor can open.
    """
    small_batches(docs.sparkSession)
    added = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kept = [F.col(c) for c in tidy(docs, *added).columns if c != text]
    return docs.select(*kept, F.inline(_pieces(tokenizer, end_id, capacity, keep_ids)(F.col(text))))
