"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

Texts become counts of hashed n-grams of letters; a vector is (1 + log count) * idf, scaled to length one. For each
language several centroids are found by spherical clustering of its training vectors, and a text takes the language
of the centroid with the largest cosine. It is rejected when that cosine is below what texts of that language and of
as many distinct n-grams reach against centroids that were found without them.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.llm.common import annotate, blocks, map_batches

UNDETERMINED = "und"
#: Dimensions of the vectors; an n-gram's dimension is its hash modulo this.
DIMENSIONS = 4096
#: Training rows a language gives at most: those with the smallest hashes of their ids.
MAX_PER_LANGUAGE = 600
#: Languages at most: one row of each comes to the driver.
MAX_LANGUAGES = 1000
#: Characters of the excerpts by which training texts tell what short texts reach; they grow to whole words.
EXCERPTS = (1, 8, 16, 32, 64, 128, 256, 512)
#: Characters by which an excerpt grows at each end at most: scripts without spaces have no word ends.
REACH = 32
#: Parts into which a language's training rows fall; each is judged by centroids of the others.
FOLDS = 3


def letters() -> np.ndarray:
    """By byte: a-z folded, bytes beyond ASCII as they are, all else 0 (a word's end)."""
    return np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


_LETTERS = letters()


#: Bytes whose n-grams are hashed at a time.
PIECE = 1 << 17
_ONE, _TWO = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def dimension(code: np.ndarray) -> np.ndarray:
    """n-grams as numbers of 32 bits to dimensions: two rounds of multiplying, and the upper bits."""
    x = code * _ONE
    x ^= x >> np.uint32(15)
    x *= _TWO
    return (x >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)


def counts_of(column: pa.Array):
    """Dimension counts of each text: n-grams of one to three bytes that begin with a letter, words set off by a mark.

    By a letter b after a byte a and before a byte c, the n-grams are b, bc and abc, where other bytes and the text's
    ends are 0. Memory is bounded by PIECE, whatever a text's length.
    """
    for _, n, raw, bounds in blocks(column, PIECE):
        for i in range(n):
            found = np.zeros(DIMENSIONS, np.int64)
            for first in range(bounds[i], bounds[i + 1], PIECE):
                last = min(first + PIECE, bounds[i + 1])
                code = np.zeros(last - first + 2, np.uint32)
                code[1:-1] = _LETTERS[raw[first:last]]
                if first > bounds[i]:
                    code[0] = _LETTERS[raw[first - 1]]
                if last < bounds[i + 1]:
                    code[-1] = _LETTERS[raw[last]]
                at = np.flatnonzero(code[1:-1])
                b = code[1:][at]
                two = b << np.uint32(8) | code[2:][at]
                grams = np.concatenate([b, two | np.uint32(1 << 24), two | code[at] << np.uint32(16) | np.uint32(1 << 25)])
                found += np.bincount(dimension(grams), minlength=DIMENSIONS)
            yield found


_ASCII_LETTER = re.compile(b"[A-Za-z]")


def has_letter(text: bytes | pa.Buffer | None) -> bool:
    """Whether a text in UTF-8 holds a letter of any script."""
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in bytes(text).decode()))


@dataclass(frozen=True)
class Centroids:
    languages: tuple[str, ...]
    idf: np.ndarray
    #: one row each, of length one
    vectors: np.ndarray
    #: index of the language of each row
    owner: np.ndarray
    #: least cosine that is not rejected, by language and number of distinct n-grams; constant after the last
    least: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def judge(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, cosine in 0 to 1, rejected."""
        if not counts.any() or not self.languages:
            return UNDETERMINED, 0.0, True
        cosines = self.vectors @ self.vector(counts)
        k = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[k])))
        own = self.least[self.owner[k]]
        return self.languages[self.owner[k]], score, score < float(own[min(np.count_nonzero(counts), len(own) - 1)])


def _clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from rows spread over the data: each start is the row least like those before."""
    starts = [int(np.argmax(x @ x.mean(0)))]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(1))))
    centers = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, 1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def excerpts(text: str, seed: int) -> list[str]:
    """A passage of each of the lengths in EXCERPTS that is at most half of the text, at places drawn by the seed."""
    rng, plain = random.Random(seed), re.sub(r"\s", " ", text)
    found = []
    for n in EXCERPTS:
        if 2 * n > len(plain):
            break
        a = rng.randrange(len(plain) - n + 1)
        b = a + n
        start, end = plain.rfind(" ", max(0, a - REACH), a) + 1, plain.find(" ", b, b + REACH)
        found.append(plain[start or (0 if a <= REACH else a) : end if end >= 0 else len(plain) if b + REACH >= len(plain) else b])
    return found


def _bounds(sizes: np.ndarray, cosines: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """By number of distinct n-grams: slack times the quantile of the cosines of texts of about that number."""
    order = np.argsort(sizes, kind="stable")
    groups = np.array_split(order, max(1, min(24, len(order) // 10)))
    at = np.array([np.log(sizes[g]).mean() for g in groups])
    low = np.array([np.quantile(cosines[g], quantile) for g in groups])
    low = np.minimum.accumulate(low[::-1])[::-1]  # longer texts reach more
    return slack * np.interp(np.log(np.maximum(1, np.arange(DIMENSIONS + 1))), at, low)


def learn(rows: list[tuple[str, np.ndarray, np.ndarray, list]], per_language: int = 4, quantile: float = 0.01, slack: float = 0.6) -> Centroids:
    """rows: language, dimensions, their counts, and the same two of each excerpt.

    least: of each language, slack times the cosine that all but the quantile of rows and excerpts of about the same
    number of distinct n-grams reach, each against centroids of the language's other rows.
    """
    languages = tuple(sorted({lang for lang, at, _, _ in rows if len(at)}))
    df, n = np.zeros(DIMENSIONS), 0
    for _, at, _, _ in rows:
        df[at] += 1
        n += len(at) > 0
    idf = np.log((1 + n) / (1 + df)) + 1
    found, least = [], []
    for name in languages:  # one language's vectors at a time
        own = [(at, c, parts) for lang, at, c, parts in rows if lang == name and len(at)]
        x = np.zeros((len(own), DIMENSIONS))
        for i, (at, c, _) in enumerate(own):
            x[i, at] = (1 + np.log(c)) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found.append(_clustered(x, per_language))
        fold = np.arange(len(own)) % FOLDS
        sizes, cosines = [], []
        for k in range(min(FOLDS, len(own))):
            # a single row has no others: its excerpts are held against itself
            others = _clustered(x[fold != k], per_language) if len(own) > 1 else x
            for i in np.flatnonzero(fold == k):
                at, c, parts = own[i]
                for at, c in [(at, c), *parts]:
                    v = (1 + np.log(c)) * idf[at]
                    sizes.append(len(at))
                    cosines.append((others[:, at] @ v).max() / np.linalg.norm(v))
        least.append(_bounds(np.array(sizes), np.array(cosines), quantile, slack))
    vectors = np.concatenate(found) if found else np.zeros((0, DIMENSIONS))
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(int)
    return Centroids(languages, idf, vectors, owner, np.array(least) if found else np.zeros((0, DIMENSIONS + 1)))


def held_out(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string")) % 3 == 1)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 4, most: int = MAX_PER_LANGUAGE) -> Centroids:
    """Learns from the rows that are not held out and have a language: of each, the `most` with the smallest hash of the id.

    Rows of one id go by their texts' hashes, so that no more than `most` rows of a language are ever counted, however
    often an id repeats. Whole texts and their excerpts are counted on the executors and only their vectors collected.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("rank", F.xxhash64("doc_id"))
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # the rank below which about twice the sample lies; exact order decides among those, before texts are counted
    low, high = -(1 << 63) + 1, (1 << 63) - 1
    cut = lambda n: min(high, low + int(min(1.0, (2 * most + 64) / n) * (1 << 64)))
    cuts = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(cut(r["count"]))) for r in sizes], F.lit(low))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank", F.xxhash64("text"), "text"))
    near = rows.where(F.col("rank") <= cuts).withColumn("place", first).where(F.col("place") <= most).select("lang", "rank", "text").repartition(16)

    def packed(c, kind):
        at = np.flatnonzero(c)
        return np.stack([at, c[at]]).astype(kind).tobytes()

    def count(batches):
        for batch in batches:
            data, parts = [], []
            for c, rank, own in zip(counts_of(batch.column(2)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data.append(packed(c, np.int32))
                cut = [t for t in excerpts(own, rank) if has_letter(t.encode())]
                parts.append([packed(p, np.uint16) for p in counts_of(pa.array(cut, pa.string()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(parts, pa.list_(pa.binary()))], names=["lang", "rank", "data", "parts"])

    found: dict[str, list] = {}
    for r in map_batches(near, count, "lang string, rank long, data binary, parts array<binary>").collect():
        found.setdefault(r["lang"], []).append((r["rank"], bytes(r["data"]), [bytes(p) for p in r["parts"]]))
    rows_ = []
    for name in sorted(found):
        for _, data, parts in sorted(found[name]):
            rows_.append((name, *np.frombuffer(data, np.int32).reshape(2, -1), [np.frombuffer(p, np.uint16).reshape(2, -1) for p in parts]))
    return learn(rows_, per_language)


def identify(docs: DataFrame, model: Centroids, text: str = "text", names: tuple[str, str, str] = ("_lang", "_cosine", "_rejected")) -> DataFrame:
    """All columns of docs and three more: the language, the cosine, whether it is rejected.

    A null text or one without letters is `und`, cosine 0, rejected. Rows are judged one by one by their whole
    texts, so repeated rows are judged alike; ties go to the language first in order. Without any training rows all
    is `und`. Columns of docs that have one of the names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(column):
        found = [shared.value.judge(c) if has_letter(t.as_buffer()) else (UNDETERMINED, 0.0, True) for t, c in zip(column.cast(pa.large_binary()), counts_of(column), strict=True)]
        return [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return annotate(docs, text, judge, dict(zip(names, ("string", "double", "boolean"), strict=True)))


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Centroids | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; the cases of identify() hold. A null id is not held out."""
    model = model or train(docs, doc_id, text, lang)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(held_out(F.col(f"`{doc_id}`")), F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return identify(rows, model, names=("lang_pred", "score", "rejected")).drop("text")
