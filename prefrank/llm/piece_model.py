"""Merge-type sentence-piece models: reading the file, encoding with a prefix table, decoding.

Merging takes the best-scored adjacent pair whose union is a piece, the leftmost of equals, until
there is none. So the merges inside a run of result tokens do not depend on what stands around it, and

* the tokens of a prefix of a result are the result of that prefix: every prefix of a text has one last token;
* tokens are a result exactly if each two neighbours are, taken alone: they are *compatible*.

An automaton over all pieces reports those that end at a place. The last token there is the one
of them that is compatible with the last token of the prefix before it. Ids are recovered from the end.

Two characters that stand side by side in no piece are never merged over, so a text falls into
fragments that are encoded apart. Fragments that are new to a worker go through the table together, place by place.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import ahocorasick
import numpy as np

SPACE = "▁"
# Fixed values of the model file: types of pieces, the model type for merging.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGING = 2

#: Words and fragments remembered by a worker (each), the longest of them, and a power of two of pairs of tokens.
CACHED = 250_000
CACHED_CHARS = 64
PAIR_BITS = 20
#: Characters handled together; longer texts are cut between words. Fragments in one table.
PART_CHARS = 1 << 19
FRAGMENTS = 4_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


class PieceModel:
    """A model file with merging, no text normalisation, a blank before the text and blanks kept as they are."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        trainer = {n: v for number, value in message if number == 2 for n, v in _fields(value)}
        rules = {n: v for number, value in message if number == 3 for n, v in _fields(value)}
        if trainer.get(3, 1) != MERGING or trainer.get(24, 0):
            raise ValueError("not a merge-type model with blanks before words")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("the model normalises texts")
        if not rules.get(3, 1):
            raise ValueError("the model adds no blank before texts")
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("user-defined and unused pieces are not covered")
        self.unknown_id = self.types.index(UNKNOWN)
        surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.fallback = bool(trainer.get(35, 0))
        self.end_id = self.pieces.index(trainer.get(47, b"</s>").decode())
        self.score = {p: scores[i] for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.bytes = [self._bytes_of(i, surface) for i in range(len(self.pieces))]
        self._automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self._automaton.add_word(piece, i)
        self._automaton.make_automaton()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece goes on over the start of a word")
        self._lengths = [len(p) for p in self.pieces]
        self._sizes = np.array(self._lengths)
        self._histories: dict[int, tuple] = {}
        self._pairs: dict[int, bool] = {}
        self._keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self._good = np.zeros(1 << PAIR_BITS, bool)
        # Merges of every token met, by place: score, and the tokens that then stand first and last.
        steps = max(self._lengths)
        self._met = np.zeros(len(self.pieces), bool)
        self._whole = np.zeros(len(self.pieces), bool)
        self._scores = np.full((len(self.pieces), steps), -np.inf)
        self._heads = np.zeros((len(self.pieces), steps), np.int32)
        self._tails = np.zeros((len(self.pieces), steps), np.int32)
        unions = {ids << 16 | self.ids[p[k:]]: self.score[p] for p in self.ids for k in range(1, len(p))
                  if (ids := self.ids.get(p[:k])) is not None and p[k:] in self.ids}
        self._unions = np.array([*sorted(unions), 1 << 40])
        self._union_scores = np.array([*(unions[k] for k in sorted(unions)), -np.inf])
        # Characters as small numbers (0: no piece) and which of them stand side by side in a piece.
        known = sorted({c for p in self.ids for c in p})
        self._codes = np.zeros(0x110000, np.uint16)
        self._codes[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self._build_trie()
        self._beside = np.zeros((len(known) + 1,) * 2, bool)
        for piece in self.ids:
            codes = self._codes[[ord(c) for c in piece]]
            self._beside[codes[:-1], codes[1:]] = True
        self._stop = next(chr(c) for c in range(0x110000) if not self._codes[c])
        self._single = {c: np.int32(i).tobytes() for c, i in self.ids.items() if len(c) == 1}
        self._words: dict[str, bytes] = {}
        self._fragments: dict[str, bytes] = {}

    def _bytes_of(self, i: int, surface: bytes) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == CONTROL else surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def _build_trie(self) -> None:
        """States of all beginnings of pieces; ``state * 2**16 + character`` finds the next state."""
        nodes: dict[int, int] = {}
        states, token = 1, [-1]
        for piece, i in self.ids.items():
            state = 0
            for code in self._codes[[ord(c) for c in piece]].tolist():
                key = state << 16 | code
                state = nodes.get(key, 0)
                if not state:
                    state = nodes[key] = states
                    states += 1
                    token.append(-1)
            token[state] = i
        self._edges = np.array(sorted(nodes))
        self._next = np.array([nodes[k] for k in sorted(nodes)])
        self._token = np.array(token)
        self._roots = np.zeros(1 << 16, np.int64)
        self._roots[[k for k in nodes if k < 1 << 16]] = [i for k, i in nodes.items() if k < 1 << 16]

    def _matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of all pieces in a text: the automaton runs from every place at once."""
        start, depth, found = np.flatnonzero(codes), 1, []
        state = self._roots[codes[start]]
        codes = np.r_[codes, 0].astype(np.int64)
        while len(start):
            token = self._token[state]
            ends = token >= 0
            found.append((start[ends], depth, token[ends]))
            next_code = codes[start + depth]
            on = np.flatnonzero(next_code)
            key = state[on] << 16 | next_code[on]
            place = np.searchsorted(self._edges, key)
            place[place == len(self._edges)] = 0
            good = self._edges[place] == key
            start, state = start[on[good]], self._next[place[good]]
            depth += 1
        return (np.concatenate([s for s, _, _ in found]), np.concatenate([s + d for s, d, _ in found]),
                np.concatenate([t for _, _, t in found]))

    # Pair compatibility

    def _history(self, token: int) -> tuple:
        """(ends as one token, first character, last character, merges as (score, first part, last part))."""
        known = self._histories.get(token)
        if known is None:
            text = self.pieces[token] if token >= 0 else chr(~token)
            parts, steps = list(text), []
            while len(parts) > 1:
                best, at = max(((self.score.get(parts[i] + parts[i + 1], float("-inf")), -i)
                                for i in range(len(parts) - 1)))
                if best == float("-inf"):
                    break
                parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
                steps.append((best, parts[0], parts[-1]))
            known = self._histories[token] = (len(parts) == 1, text[0], text[-1], steps)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of two tokens gives these two tokens; an unknown character c is token ~ord(c)."""
        key = left * (1 << 21) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >> PAIR_BITS - 2:
                self._pairs.clear()
            known = self._pairs[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        (whole, _, last, before), (sound, first, _, after) = self._history(left), self._history(right)
        if not (whole and sound):
            return False
        i = j = 0
        while True:
            over = self.score.get(last + first)
            a = before[i][0] if i < len(before) else None
            b = after[j][0] if j < len(after) else None
            if over is not None and (a is None or over > a) and (b is None or over >= b):
                return False  # the best pair, or the leftmost of the best ones, crosses the border
            if a is not None and (b is None or a >= b):
                last, i = before[i][2], i + 1
            elif b is not None:
                first, j = after[j][1], j + 1
            else:
                return True

    # Encoding

    def prefix_table(self, text: str) -> array:
        """Last token of every prefix; entry 0 stands for the empty one."""
        table = array("i", bytes(4 * (len(text) + 1)))
        unknown = {c for c in set(text) if c not in self.ids}
        if unknown:
            for i, c in enumerate(text):
                if c in unknown:
                    table[i + 1] = ~ord(c)
        lengths, pairs, done = self._lengths, self._pairs, 0
        for end, token in self._automaton.iter(text):
            end += 1
            if end == done:
                continue
            start = end - lengths[token]
            if start:
                before = table[start]
                good = pairs.get(before * (1 << 21) + token)
                if good is None:
                    good = self.compatible(before, token)
            else:
                good = self._history(token)[0]
            if good:
                table[end] = token
                done = end
        return table

    def _ids_of(self, text: str) -> array:
        table, at = self.prefix_table(text), len(text)
        found = array("i")
        while at:
            token = table[at]
            if token >= 0:
                found.append(token)
                at -= self._lengths[token]
            else:
                if self.fallback:
                    found.extend([self.byte_ids[b] for b in reversed(chr(~token).encode())])
                elif not found or found[-1] != self.unknown_id or at == len(text) or table[at + 1] >= 0:
                    found.append(self.unknown_id)
                at -= 1
        found.reverse()
        return found

    def _meet(self, tokens: np.ndarray) -> None:
        for token in np.unique(tokens[~self._met[tokens]]).tolist():
            whole, first, last, steps = self._history(token)
            self._met[token], self._whole[token] = True, whole
            self._heads[token, 0], self._tails[token, 0] = self.ids[first], self.ids[last]
            for k, (score, head, tail) in enumerate(steps):
                self._scores[token, k] = score
                self._heads[token, k + 1], self._tails[token, k + 1] = self.ids[head], self.ids[tail]

    def _check_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_check` of many pairs, one merge of each at a time."""
        self._meet(left)
        self._meet(right)
        good = self._whole[left] & self._whole[right]
        pair = np.flatnonzero(good)
        left, right = left[pair], right[pair]
        i, j = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        while len(pair):
            key = self._tails[left, i].astype(np.int64) << 16 | self._heads[right, j]
            place = np.searchsorted(self._unions, key)
            over = np.where(self._unions[place] == key, self._union_scores[place], -np.inf)
            a, b = self._scores[left, i], self._scores[right, j]
            none = np.maximum(a, b) == -np.inf
            crossed = (over > a) & (over >= b)
            good[pair[crossed]] = False
            ahead = a >= b
            i, j = i + ahead, j + ~ahead
            going = ~(crossed | none)
            pair, left, right, i, j = pair[going], left[going], right[going], i[going], j[going]
        return good

    def _compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        slot = (key * 0x9E3779B1 >> 12) & (1 << PAIR_BITS) - 1
        good = self._good[slot]
        lost = np.flatnonzero(self._keys[slot] != key)
        if len(lost):
            new, back = np.unique(key[lost], return_inverse=True)
            good[lost] = self._check_all(new >> 16, new & 0xFFFF)[back]
            self._keys[slot[lost]], self._good[slot[lost]] = key[lost], good[lost]
        return good

    def _whole_all(self, tokens: np.ndarray) -> np.ndarray:
        self._meet(tokens)
        return self._whole[tokens]

    def _solve(self, fragments: list[str]) -> list[bytes]:
        """Ids of fragments of characters that are pieces: one prefix table for all, filled place by place."""
        text = self._stop.join(fragments)
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        start, end, token = self._matches(self._codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)])
        first = np.repeat(begin, sizes + 1)[end - 1]
        place = (end - first).astype(np.int16)
        order = np.argsort(place, kind="stable")
        table = np.zeros(len(text) + 1, np.int64)
        bounds = np.searchsorted(place[order], np.arange(1, sizes.max() + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            now = order[a:b]
            here, tokens, heads = start[now], token[now], start[now] == first[now]
            good = np.zeros(len(now), bool)
            good[heads] = self._whole_all(tokens[heads])
            good[~heads] = self._compatible_all(table[here[~heads]], tokens[~heads])
            table[end[now[good]]] = tokens[good]
        at, owner = begin + sizes, np.arange(len(fragments))
        tokens, owners = [], []
        while len(owner):
            last = table[at]
            tokens.append(last)
            owners.append(owner)
            at = at - self._sizes[last]
            going = at > begin[owner]
            at, owner = at[going], owner[going]
        owner = np.concatenate(owners[::-1])
        order = np.argsort(owner, kind="stable")
        data = np.concatenate(tokens[::-1])[order].astype(np.int32).tobytes()
        cuts = (4 * np.r_[0, np.cumsum(np.bincount(owner, minlength=len(fragments)))]).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _encode_fragments(self, fragments: Iterable[str]) -> dict[str, bytes]:
        """Ids of different fragments; new ones are remembered."""
        held, new = self._fragments, []
        found = {}
        for fragment in fragments:
            ids = held.get(fragment)
            if ids is None:
                if len(fragment) == 1 and fragment not in self._single or len(fragment) > CACHED_CHARS:
                    found[fragment] = self._ids_of(fragment).tobytes()
                else:
                    new.append(fragment)
            else:
                found[fragment] = ids
        for a in range(0, len(new), FRAGMENTS):
            part = new[a:a + FRAGMENTS]
            solved = dict(zip(part, self._solve(part)))
            found.update(solved)
            if len(held) + len(solved) > CACHED:
                held.clear()
            held.update(solved)
        return found

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of a blank and each of the words."""
        text = SPACE + SPACE.join(words)
        codes = self._codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cut = np.r_[True, ~self._beside[codes[:-1], codes[1:]]]
        starts = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
        cut[starts[:-1]] = True
        places = np.flatnonzero(cut)
        bounds = [*places.tolist(), len(text)]
        fragments = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        ids = list(map(self._encode_fragments(set(fragments)).__getitem__, fragments))
        upto = np.searchsorted(places, starts).tolist()
        return [b"".join(ids[a:b]) if b - a > 1 else ids[a] for a, b in zip(upto[:-1], upto[1:])]

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of an escaped text that begin at the start of a word."""
        begin = 0
        while len(text) - begin > PART_CHARS:
            border = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, begin + PART_CHARS)
            if border is None:
                break
            yield text[begin:border.start()]
            begin = border.start()
        yield text[begin:]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as 32-bit numbers, without an end id."""
        held: list[tuple[list[str], bool]] = []
        size = 0
        for text in texts:
            parts = list(self._cut(SPACE + text.replace(" ", SPACE))) if text else [""]
            for k, part in enumerate(parts):
                words = part.split(SPACE)[1:]
                if "" in words:
                    # More than one blank: all but the first of them lead the word.
                    words = [run[1:] for run in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", part)]
                held.append((words, k == len(parts) - 1))
                size += len(part)
                if size > PART_CHARS:
                    yield from self._encode_held(held)
                    held, size = [], 0
        yield from self._encode_held(held)

    _begun = b""

    def _encode_held(self, held: list[tuple[list[str], bool]]) -> Iterator[bytes]:
        wanted = set(chain.from_iterable(words for words, _ in held))
        new = list(wanted.difference(self._words))
        if len(self._words) + len(new) > CACHED:
            self._words = {w: self._words[w] for w in wanted.intersection(self._words)}
        if new:
            self._words.update(zip(new, self._encode_words(new)))
        for words, last in held:
            ids = self._begun + b"".join(map(self._words.__getitem__, words))
            self._begun = b"" if last else ids
            if last:
                yield ids
        if len(self._words) > CACHED:
            self._words = {}

    def encode(self, text: str) -> array:
        """Ids of a text, without an end id."""
        ids = array("i")
        ids.frombytes(b"".join(self.encode_all([text])))
        return ids

    # Decoding

    def decode(self, ids) -> str:
        """Text of ids: control ids are empty, bytes that are no UTF-8 become U+FFFD one by one."""
        held = [self.bytes[i] for i in ids]
        # The blank before the text goes; ids that give nothing do not count as its start.
        for k, i in enumerate(ids):
            if held[k]:
                if self.types[i] == NORMAL and held[k][:1] == b" ":
                    held[k] = held[k][1:]
                break
        try:
            return b"".join(held).decode() if all(held[:-1]) else "".join(_lenient(held))
        except UnicodeDecodeError:
            return "".join(_lenient(held))


def _lenient(parts: list[bytes]) -> Iterator[str]:
    """Text of byte runs; a part that is empty ends a character."""
    for full, run in groupby(parts, key=bool):
        data, at = b"".join(run) if full else b"", 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    yield data[at:at + size].decode()
                    break
                except UnicodeDecodeError:
                    pass
            else:
                yield "\ufffd"
                size = 1
            at += size
