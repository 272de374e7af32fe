"""Token counts by a compiled finite-state transducer.

A byte-pair tokenizer whose merges follow piece scores is compiled, state by state as texts need it, to a
deterministic transducer over characters. The canonical tokens of a prefix are those of a shorter prefix and one
more piece, and a piece may follow another exactly if merging the two alone leaves them as they are. So all that a
state has to know of the prefix is, for each of its ends that begins some piece, the last token before that end and
the count there. A transition carries the change of the token count; a character outside the vocabulary emits its
bytes and leads back to the start.

No piece has a white-space marker after another character, so a cut before such a marker is always a token border:
the transducer goes back to its start there. Texts are cut in chunks anywhere. A chunk's map takes a state to the
state after the chunk and the tokens emitted; what follows the chunk's first cut is the same for all states, and a
chunk without a cut is run from a state until it meets the run from the start. Maps are composed by a prefix scan.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import map_batches

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class BpeTransducer:
    """The transducer of a SentencePiece BPE model. max_states and max_words bound the memory; beyond, tables start anew."""

    def __init__(self, model_path: str, max_states: int = 200_000, max_words: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has a white-space marker after another character")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.chars = {c for p in self.score for c in p}
        self.max_states, self.max_words = max_states, max_words
        self.stable: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ("", ((0, "", 0),))
        self.ids = {start: 0}
        self.keys = [start]
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.words: dict[str, int] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """The model's merges: best score first, then leftmost."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        if not left:
            return self.stable.setdefault(("", right), self.merge(list(right)) == [right])
        if (known := self.stable.get((left, right))) is None:
            if len(self.stable) > 600_000:
                self.stable.clear()
            known = self.stable[left, right] = self.merge(list(left + right)) == [left, right]
        return known

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state: the state after it and the change of the count."""
        if char not in self.chars:
            return self.next[state].setdefault(char, (0, len(char.encode())))
        tail, known = self.keys[state]
        found = []
        for k, last, count in known:
            piece = (tail[len(tail) - k :] if k else "") + char
            if piece in self.score and self.follows(last, piece):
                found.append((piece, count + 1))
        if len(found) != 1:
            raise ValueError(f"no single tokenization of {tail + char!r}")
        token, count = found[0]
        kept = [(0, token, 0)]
        for k, last, before in known:
            begun = (tail[len(tail) - k :] if k else "") + char
            if begun in self.begins:
                kept.append((k + 1, last, before - count))
        longest = kept[-1][0]
        key = ((tail + char)[len(tail) + 1 - longest :] if longest else "", tuple(kept))
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return self.next[state].setdefault(char, (to, count))

    def run(self, segment: str) -> int:
        """Tokens of a segment: markers, then other characters."""
        state = total = 0
        table = self.next
        for char in segment:
            step = table[state].get(char)
            if step is None:
                step = self._compile(state, char)
            state, change = step
            total += change
        return total

    def word(self, segment: str) -> int:
        if len(self.words) > self.max_words:
            self.words.clear()
        n = self.words[segment] = self.run(segment)
        return n

    def segments(self, text: str) -> int:
        """Tokens of a text that begins and ends at cuts."""
        words, total = self.words, 0
        if MARK + MARK in text or text[-1:] == MARK or text[:1] != MARK:
            for s in _SEGMENT.findall(text):
                total += words.get(s) or self.word(s)
            return total
        get, word = words.get, self.word
        for s in text[1:].split(MARK):
            total += get(s) or self._plain(s, word)
        return total

    def _plain(self, s: str, word) -> int:
        n = self.run(MARK + s)
        if len(self.words) > self.max_words:
            self.words.clear()
        self.words[s] = n
        return n

    def step(self, state: int, char: str) -> tuple[int, int]:
        found = self.next[state].get(char)
        return self._compile(state, char) if found is None else found

    def walk(self, entry: Entry, text: str) -> tuple[Entry, int]:
        """The state after a text without a cut inside, and the tokens emitted."""
        state, marked = entry
        if text[:1] == MARK and not marked:
            state = 0  # the cut is before the text
        total = 0
        for char in text:
            state, change = self.step(state, char)
            total += change
        return (state, text[-1:] == MARK), total

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefixes of the composition, in log2(n) rounds of pairwise compositions."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps = maps[:step] + [Composed(maps[i - step], maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def count(self, text: str, chunk_chars: int = 1 << 12) -> int:
        if not text:
            return 0
        if len(self.keys) > self.max_states:  # between texts: states of one text's maps belong together
            self._reset()
        text = MARK + text.replace(" ", MARK)
        maps = [ChunkMap(self, text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        return self.scan(maps)[-1].of(START)[1]


#: A state, and whether the character before was a marker.
Entry = tuple[int, bool]
START: Entry = (0, False)


class StateMap:
    """A map from states to (state after, tokens emitted), made for a state when it is first asked for."""

    def __init__(self):
        self.known: dict[Entry, tuple[Entry, int]] = {}

    def of(self, entry: Entry) -> tuple[Entry, int]:
        if (found := self.known.get(entry)) is None:
            found = self.known[entry] = self._make(entry)
        return found

    def _make(self, entry: Entry) -> tuple[Entry, int]:
        raise NotImplementedError


class Composed(StateMap):
    """First a, then b."""

    def __init__(self, a: StateMap, b: StateMap):
        super().__init__()
        self.a, self.b = a, b

    def _make(self, entry: Entry) -> tuple[Entry, int]:
        middle, first = self.a.of(entry)
        last, second = self.b.of(middle)
        return last, first + second


class ChunkMap(StateMap):
    """The map of a chunk: all states agree after its first cut, or from where they meet the run from the start."""

    def __init__(self, machine: BpeTransducer, chunk: str):
        super().__init__()
        self.machine = machine
        first = _CUT.search(chunk)
        self.head, self.rest, self.trace = chunk, None, None
        if first is not None:
            at, last = first.start(), _last_cut(chunk)
            self.head = chunk[:at]
            after, n = machine.walk(START, chunk[last:])
            self.rest = after, n + (machine.segments(chunk[at:last]) if last > at else 0)

    def _make(self, entry: Entry) -> tuple[Entry, int]:
        if self.rest is not None:
            _, n = self.machine.walk(entry, self.head)
            return self.rest[0], n + self.rest[1]
        if entry == START or self.head[:1] == MARK:
            return self.machine.walk(entry, self.head)
        if self.trace is None:  # states and counts of the run from the start, by place
            state = total = 0
            self.trace = [(0, 0)]
            for char in self.head:
                state, change = self.machine.step(state, char)
                total += change
                self.trace.append((state, total))
        state, total = entry[0], 0
        for place, char in enumerate(self.head, 1):
            state, change = self.machine.step(state, char)
            total += change
            other, so_far = self.trace[place]
            if state == other:
                last, whole = self.trace[-1]
                return (last, self.head[-1] == MARK), total + whole - so_far
        return (state, self.head[-1:] == MARK), total


def _last_cut(chunk: str) -> int:
    at = len(chunk)
    while (at := chunk.rfind(MARK, 0, at)) > 0:
        if chunk[at - 1] != MARK:
            return at
    return -1


@lru_cache(maxsize=2)
def transducer(model_path: str) -> BpeTransducer:
    """One machine for each worker process: what one task has compiled serves the next."""
    return BpeTransducer(model_path)


def token_counts(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    A null text counts as empty: no bytes, no tokens. Rows are kept as they are: repeated ids give repeated rows, a
    null id stays null. Texts of any length are counted whole. Columns besides id and text are not read.
    """

    def count(batches):
        machine = transducer(model_path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n = [machine.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
