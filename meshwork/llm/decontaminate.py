"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

Automata are built on the driver from parts of the benchmark of bounded size and broadcast; documents stream through
them word by word, once for each part. After each word it knows the longest run of words, ending there, that occurs within some item. A document word
is hit when it lies in an occurrence of a window: `window` consecutive words of an item, or a whole shorter item.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import annotate, materialize

#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII becomes a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of item texts in one automaton, which the driver and every worker hold: some 100 bytes of memory for each.
#: A larger benchmark takes several automata and as many passes; an item is never cut.
PART_BYTES = 2 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_TABLE).split()


class SuffixAutomaton:
    """All runs of words of the items. items: (id or None, UTF-8 text)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = 10):
        if window < 1:
            raise ValueError("window must be positive")
        self.window = window
        self.vocab: dict[bytes, int] = {}
        rows = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)]) for i, t in items]
        rows = [(i, w) for i, w in rows if w]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in rows:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # by state: its ancestor that holds the runs' last `window` words, and the nearest that holds a whole short item
        self.anchor, self.near = [0] * len(self.next), [0] * len(self.next)
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for s in order[1:]:
            up = self.link[s]
            self.anchor[s] = s if self.length[up] < window else self.anchor[up]
        owners: dict[int, set] = {}
        #: by state: length of the whole short item that it holds, and the ids of those items
        self.whole: dict[int, tuple[int, set]] = {}
        for item, words in rows:
            state = 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= window:
                    owners.setdefault(self.anchor[state], set()).add(item)
            if len(words) < window:
                self.whole.setdefault(state, (len(words), set()))[1].add(item)
        for s in order[1:]:
            self.near[s] = s if s in self.whole else self.near[self.link[s]]
        #: by state: the number of its set of items that have a window there; equal sets are one
        self.sets: list[frozenset] = []
        numbers: dict[frozenset, int] = {}
        self.owners: dict[int, int] = {}
        for s, items_ in owners.items():
            own = frozenset(items_)
            if own not in numbers:
                numbers[own] = len(self.sets)
                self.sets.append(own)
            self.owners[s] = numbers[own]
        self.least = min([window, *(n for n, _ in self.whole.values())]) if rows else 0

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Merged hit spans of word positions (end exclusive), the items whose windows occur, the longest match."""
        if not self.least or len(words) < self.least:
            return [], set(), 0
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans: list[tuple[int, int]] = []
        met: set[int] = set()
        found, longest = set(), 0
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first >= self.least:  # a match holds known words only
                longest = max(longest, self._stream(ids[first:end].tolist(), first, spans, found, met))
        return spans, found.union(*[self.sets[k] for k in met]), longest

    def _stream(self, ids: list[int], first: int, spans: list, found: set, met: set) -> int:
        nxt, link, length, window, whole = self.next, self.link, self.length, self.window, self.whole
        anchor, near, owners = self.anchor, self.near, self.owners
        state = n = longest = 0
        for k, w in enumerate(ids):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state = to
            n += 1
            if n > longest:
                longest = n
            hit = 0
            if n >= window:
                hit = window
                met.add(owners[anchor[state]])
            s = near[state]
            while s:  # fewer than `window` of them: their lengths differ
                size, items = whole[s]
                if size <= n:
                    hit = max(hit, size)
                    found |= items
                s = near[link[s]]
            if hit:
                end = first + k + 1
                if spans and spans[-1][1] >= end - hit:
                    start = end - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, end))
                else:
                    spans.append((end - hit, end))
        return longest


def word_positions(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.frombuffer(raw.translate(WORD_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans, each from its first word's start to its last word's end."""
    start, end = word_positions(raw)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*kept, raw[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES):
    """Automata over parts of the benchmark, one at a time: items come to the driver in a stream, part_bytes of them at once."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    part, size = [], 0
    for r in rows.toLocalIterator():
        raw = r.text.encode()
        if part and size + len(raw) > part_bytes:
            yield SuffixAutomaton(part, window)
            part, size = [], 0
        part.append((r.id, raw))
        size += len(raw)
    yield SuffixAutomaton(part, window)


_FOUND = pa.struct([("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, text: str, part_bytes: int, last, fields: dict[str, str]) -> DataFrame:
    """docs with the fields that last(text, words, spans, items, longest) gives over all automata; of several, all but the
    last write what they find beside the rows."""
    spark, rows, parts = docs.sparkSession, docs, []
    machines = automata(benchmark, window, part_bytes=part_bytes)
    machine = next(machines)
    while (after := next(machines, None)) is not None:
        shared = spark.sparkContext.broadcast(machine)

        def note(column, shared=shared):
            out = []
            for t in column.cast(pa.large_binary()):
                spans, items, longest = shared.value.matches(words_of(t.as_py() or b""))
                out.append({"spans": spans, "items": [i for i in items if i is not None], "longest": longest})
            return [pa.array(out, _FOUND)]

        parts.append(f"_hits_part{len(parts)}")
        rows = materialize(annotate(rows, text, note, {parts[-1]: "struct<spans:array<array<bigint>>,items:array<string>,longest:bigint>"}), "hits")
        shared.unpersist()
        machine = after
    shared = spark.sparkContext.broadcast(machine)

    def judge(column, *noted):
        out = []
        for k, t in enumerate(column.cast(pa.large_binary())):  # one text at a time
            raw = t.as_py()
            words = words_of(raw or b"")
            spans, items, longest = shared.value.matches(words)
            for p in noted:
                more = p[k].as_py()
                spans, items, longest = merged(spans + [tuple(s) for s in more["spans"]]), items | set(more["items"]), max(longest, more["longest"])
            out.append(last(raw, words, spans, sorted(i for i in items if i is not None), longest))
        return [pa.array([r[j] for r in out], kind) for j, kind in enumerate(_KINDS[tuple(fields)])]

    return annotate(rows, text, judge, fields, tuple(parts)).drop(*parts)


_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())), ("clean_text", pa.string()), ("drop", pa.bool_())])
#: Arrow types of the fields that are asked for.
_KINDS = {("_hits",): (_HITS,), ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"): (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", max_coverage: float = 0.5, part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of docs and a struct `_hits`: n_words, n_hit, longest, items (sorted strings), clean_text, drop.

    clean_text lacks the hit spans (equal to the text without any); drop says that hit words exceed max_coverage of
    the document. A null text has no words and stays null; documents or items without words match nothing; items
    with a null id are matched but not listed; repeated item ids are one item; repeated documents are judged alike;
    an empty benchmark or table gives no hits. Other columns pass through; those named `_hits` or `_hits_part0` and so
    on are replaced.
    """

    def last(raw, words, spans, items, longest):
        n = sum(b - a for a, b in spans)
        clean = raw if not spans else without(raw, spans)
        return ({"n_words": len(words), "n_hit": n, "longest": longest, "items": items, "clean_text": None if clean is None else clean.decode(), "drop": n > max_coverage * len(words)},)

    return _judged(docs, benchmark, window, text, part_bytes, last, {"_hits": "struct<n_words:bigint,n_hit:bigint,longest:bigint,items:array<string>,clean_text:string,drop:boolean>"})


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; the cases of decontaminate() hold."""

    def last(raw, words, spans, items, longest):
        n = sum(b - a for a, b in spans)
        return len(words), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fields = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    return _judged(rows, benchmark, window, "text", part_bytes, last, fields).drop("text")


#: DuckDB: the same by windows as strings, without an automaton.
CONTAMINATION_SQL = """
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.s = v.s
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT f.doc_id, len(f.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
