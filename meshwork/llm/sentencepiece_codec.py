"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their log scores are read from a model file. The best segmentation of a text maximises the sum of scores.
No piece has a white-space marker after another character, so texts are cut before such markers and each segment's
best path is found on its own; equal segments share it, and many segments are searched at once by array operations.
Characters that no piece covers cost less than any piece and are written as byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import annotate

MARK = "▁"
_SEGMENT = re.compile(" *[^ ]+| +$")
_CUT = re.compile("[^ ] ")
#: Below the least score of all pieces by as much.
UNKNOWN_PENALTY = 10.0
#: Longer segments are searched alone and not remembered.
LONGEST_KNOWN = 64
#: Characters of which segments are looked up together, about, and bytes of segments that are searched together.
RUN_CHARS, CELLS = 1 << 19, 1 << 18
#: Bytes of the character that a byte begins; 0xFF is in no UTF-8 and ends segments.
_WIDTH = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 8 + [0] * 8, np.int64)


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte c is t = base[s] + c where check[t] == s."""

    def __init__(self, keys: list[bytes]):
        """Values are the places of the keys in the list; keys are distinct and not empty."""
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for value, key in enumerate(keys):
            node = 0
            for c in key:
                to = tree[node].get(c)
                if to is None:
                    to = tree[node][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                node = to
            ends[node] = value
        size = 1 << 10
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        place, queue, start = {0: 0}, [0], 1
        for node in queue:  # level by level
            children = sorted(tree[node])
            if not children:
                continue
            base, tries = max(1, start - children[0]), 0
            while True:
                if base + 256 >= size:
                    for own, empty in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        own += [empty] * size
                    size *= 2
                if all(self.check[base + c] == -1 for c in children):
                    break
                base += 1
                tries += 1
            if tries > 64:  # the region behind is nearly full
                start = base + children[0] - 32
            state = place[node]
            self.base[state] = base
            for c in children:
                child = tree[node][c]
                self.check[base + c] = state
                self.value[base + c] = ends[child]
                place[child] = base + c
                queue.append(child)
        numbers = list(range(max(size, len(keys))))  # one object a number: lists are read faster than packed arrays
        self.arrays = tuple(np.array(own, np.int64) for own in (self.base, self.check, self.value))
        self.base, self.check, self.value = ([numbers[x] if x >= 0 else -1 for x in own] for own in (self.base, self.check, self.value))

    def prefixes(self, text: bytes, at: int = 0):
        """(end, value) of every key that begins at a place, shortest first."""
        base, check, value = self.base, self.check, self.value
        state = 0
        for i in range(at, len(text)):
            to = base[state] + text[i]
            if check[to] != state or to == 0:
                return
            state = to
            if value[state] >= 0:
                yield i + 1, value[state]


class Codec:
    """Encoder and decoder of a model file. max_bytes bounds about the memory of segments that have been seen."""

    def __init__(self, model_path: str, max_bytes: int = 32 << 20):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in plain]
        if any(MARK in n.lstrip(MARK) for n in names):
            raise ValueError("a piece has a white-space marker after another character")
        self.trie = DoubleArray([n.encode() for n in names])
        self.ids, self.scores = plain, [sp.get_score(i) for i in plain]
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        # by the places of pieces; behind them, unknown characters of 0 to 4 bytes
        self.gains = np.array(self.scores + [self.unknown] * 5)
        self.widths = np.array([len(n.encode()) for n in names] + [0, 1, 2, 3, 4])
        self.bytes = [-1] * 256
        self.spelling = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.bytes[b] = i
                self.spelling[i] = bytes([b])
        for i, n in zip(plain, names, strict=True):
            self.spelling[i] = n.replace(MARK, " ").encode()
        self.all_ids, self.all_bytes = np.array(plain + [-1] * 5, np.int32), np.array(self.bytes, np.int32)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[[b for b in self.bytes if b >= 0]] = True
        self.known: dict[str, bytes] = {}
        self.held, self.max_bytes = 0, max_bytes

    def viterbi(self, segment: str) -> list[int]:
        """Ids of the best path; of equal ones that whose last piece begins first."""
        text = segment.encode()
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, unknown = self.trie.base, self.trie.check, self.trie.value, self.scores, self.unknown
        at = 0
        while at < n:
            lead = text[at]
            end_of_char = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here = best[at]  # every character's start is reached
            state, i, single = 0, at, False
            while i < n:
                to = base[state] + text[i]
                if check[to] != state:
                    break
                state = to
                i += 1
                v = value[state]
                if v >= 0:
                    single = single or i == end_of_char
                    s = here + scores[v]
                    old = best[i]
                    if old is None or s > old:
                        best[i], back[i] = s, (at, v)
            if not single:
                s = here + unknown
                old = best[end_of_char]
                if old is None or s > old:
                    best[end_of_char], back[end_of_char] = s, (at, -1)
            at = end_of_char
        ids: list[int] = []
        while n:
            start, v = back[n]
            if v >= 0:
                ids.append(self.ids[v])
            else:
                ids.extend(self.bytes[b] for b in reversed(text[start:n]))
            n = start
        ids.reverse()
        return ids

    def paths(self, segments: list[str]) -> list[bytes]:
        """What viterbi gives for each, by array operations; blocks hold segments of about one size."""
        texts = [s.encode() for s in segments]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order] + 1
        found, first = [b""] * len(texts), 0
        while first < len(texts):
            cells = np.arange(1, min(len(texts) - first, CELLS) + 1)
            cells *= sizes[first : first + len(cells)]
            last = first + max(1, int(np.searchsorted(cells, CELLS, "right")))
            places = order[first:last].tolist()
            for place, ids in zip(places, self._block([texts[i] for i in places], int(sizes[last - 1])), strict=True):
                found[place] = ids
            first = last
        return found

    def _block(self, texts: list[bytes], rows: int) -> list[bytes]:
        """Paths of texts shorter than rows. Cell r * n + k has byte r of text k, so its next byte is n cells on."""
        base, check, value = self.trie.arrays
        n = len(texts)
        text = np.frombuffer(b"".join([t.ljust(rows, b"\xff") for t in texts]), np.uint8).reshape(n, rows).T.ravel()
        width = _WIDTH[text]
        starts = at = np.flatnonzero(width)
        state = np.zeros(len(at), np.int64)
        single = np.zeros(len(text), bool)
        begins, pieces, depth = [], [], 0
        while len(at):  # all places at which a character begins go down the trie together
            to = base[state] + text[at + depth * n]
            down = check[to] == state
            at, state = at[down], to[down]
            depth += 1
            v = value[state]
            ends = v >= 0
            begins.append(at[ends])
            pieces.append(v[ends])
            if depth <= 4:
                single[begins[-1][width[begins[-1]] == depth]] = True
        alone = starts[~single[starts]]
        begin = np.concatenate([*begins, alone])
        piece = np.concatenate([*pieces, len(self.ids) + width[alone]])
        row = np.repeat(np.arange(rows, dtype=np.uint16 if rows < 1 << 16 else np.int64), n)[begin]
        order = np.argsort(row, kind="stable")
        begin, piece, bounds = begin[order], piece[order], np.searchsorted(row[order], np.arange(rows + 1)).tolist()
        gain, end = self.gains[piece], begin + self.widths[piece] * n
        best, back = np.full(len(text), -np.inf), np.zeros(len(text), np.int64)
        best[:n] = 0.0
        for low, high in zip(bounds, bounds[1:], strict=False):  # what begins in a row ends in distinct cells behind it
            s, e = best[begin[low:high]] + gain[low:high], end[low:high]
            better = s > best[e]
            e = e[better]
            best[e], back[e] = s[better], piece[low:high][better]
        ids = np.full(len(text), -1, np.int32)
        at = np.array([len(t) for t in texts]) * n + np.arange(n)
        while len(at := at[at >= n]):
            v = back[at]
            at = at - self.widths[v] * n
            ids[at] = self.all_ids[v]
            other = v >= len(self.ids)
            if other.any():
                for k in range(4):
                    cells = at[other & (self.widths[v] > k)] + k * n
                    ids[cells] = self.all_bytes[text[cells]]
        ids = ids.reshape(rows, n).T
        used = ids >= 0
        packed, cuts = ids[used].astype("<i4").tobytes(), [0, *(4 * np.cumsum(used.sum(axis=1))).tolist()]
        return [packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, segments: set[str]) -> list[str]:
        """Paths of new segments go to what is known; returns those that are too long to stay there."""
        short, long = [], []
        for s in segments:
            (short if len(s) < LONGEST_KNOWN else long).append(s)
        found = self.paths([MARK + s.replace(" ", MARK) for s in short])
        self.known.update(zip(short, found, strict=True))
        self.held += 250 * len(short) + 2 * sum(map(len, short)) + sum(map(len, found))  # with entries and their objects
        for s in long:
            self.known[s] = array("i", self.viterbi(MARK + s.replace(" ", MARK))).tobytes()
        return long

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; a space before a text is assumed, none for an empty one."""
        found: list[list[bytes]] = [[] for _ in texts]
        run: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            if self.held > self.max_bytes:
                self.known.clear()
                self.held = 0
            known = self.known
            long = self._learn(set().union(*[segments for _, segments in run]).difference(known))
            for place, segments in run:
                found[place].append(b"".join([known[s] for s in segments]))
            for s in long:
                del known[s]
            run.clear()

        for place, text in enumerate(texts):
            for segments, chars in _segments(text):
                run.append((place, segments))
                size += chars
                if size >= RUN_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(f) for f in found]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text without the assumed space; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        spelling = self.spelling
        return b"".join([spelling[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode(errors="replace").removeprefix(" ")


def _segments(text: str):
    """Runs of a text's segments with their sizes in characters. Each segment is without its first marker, others in it are spaces."""
    if not text:
        return
    text = " " + text.replace(MARK, " ")
    first = 0
    while first < len(text):
        cut = _CUT.search(text, first + RUN_CHARS) if len(text) - first > RUN_CHARS else None
        last = cut.start() + 1 if cut else len(text)
        part = text[first:last]
        yield [s[1:] for s in _SEGMENT.findall(part)] if "  " in part or part[-1] == " " else part[1:].split(" "), last - first
        first = last


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    """One for each worker process."""
    return Codec(model_path)


def _lists(found: list[bytes], nulls: list[bool]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")), mask=pa.array(nulls))


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and the ids of the text.

    A null text has null ids, an empty one none. Whole texts of any length; rows are independent, repeated rows are
    encoded alike. A column of docs named as the ids is replaced.
    """

    def judge(column):
        own, texts = codec(model_path), column.to_pylist()
        return [_lists(own.encode_all([t or "" for t in texts]), [t is None for t in texts])]

    return annotate(docs, text, judge, {ids: "array<int>"})


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of docs and the text of the ids: null for null. A marker U+2581 of the original reads as a space."""

    def judge(column):
        own = codec(model_path)
        return [pa.array([None if x is None else own.decode(np.array(x, "<i4").tobytes()) for x in column.to_pylist()], pa.string())]

    return annotate(docs, ids, judge, {text: "string"})


def piece_digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (ids as little-endian 32-bit integers), round_trip of every row.

    round_trip: decoding gives the text again, U+2581 read as a space. A null text counts as empty.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def judge(column):
        own = codec(model_path)
        n, fallback, digests, same = [], [], [], []
        texts = [t or "" for t in column.to_pylist()]
        for t, ids in zip(texts, own.encode_all(texts), strict=True):
            n.append(len(ids) // 4)
            fallback.append(int(own.is_byte[np.frombuffer(ids, "<i4")].sum()))
            digests.append(hashlib.sha256(ids).hexdigest())
            same.append(own.decode(ids) == t.replace(MARK, " "))
        return [pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]

    return annotate(rows, "text", judge, {"n_pieces": "bigint", "n_byte_pieces": "bigint", "ids_sha256": "string", "round_trip": "boolean"}).drop("text")
