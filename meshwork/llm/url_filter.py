"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams, in SQL functions.

The model is fitted on the driver from a small labelled table of URLs; weights are rounded to integers, so a URL's
sum is exact in any order. Judging is one projection over the urls: no shuffle, no Python.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights are multiples of 1 / SCALE.
SCALE = 1 << 20
BUCKETS = 4096
SIZES = (3, 4)
#: Labelled URLs the fit may take at most.
MAX_LABELLED = 10_000

# Words of hosts that are to be blocked, and of others.
_UNWANTED = (
    "casino", "poker", "slots", "roulette", "bets", "betting", "jackpot", "lottery", "win", "prize", "pills", "pharma", "viagra", "cheap", "replica", "adult",
    "xxx", "sex", "porn", "cams", "escort", "ads", "adserver", "banner", "popup", "click", "track", "spam", "farm", "warez", "crack", "torrent",
    "payday", "loans", "free", "bonus",
)
_PLAIN = (
    "news", "docs", "wiki", "journal", "library", "school", "museum", "garden", "history", "science", "recipes", "travel", "music", "weather", "health", "sport",
    "city", "river", "forest", "mountain", "kitchen", "letters", "physics", "biology", "chess", "cinema", "theatre", "poetry", "market", "bridge", "harbour", "village",
    "photo", "code", "data", "atlas",
)
_SYLLABLES = ("the", "ra", "tion", "lo", "sch", "mi", "er", "ka", "ver", "no", "ung", "ta", "ment", "si", "eau", "do", "ing", "lu", "est", "pa")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block or 0 to allow).

    Both kinds have the shapes of page addresses: the same subdomains, top-level domains, languages and paths, names of
    one word or of two with and without a hyphen. What tells them apart is the words of the host. Names without meaning
    are among those to allow.
    """
    rows = []

    def add(name: str, k: int, y: int, section: str = "") -> None:
        sub, tld, lang = ("", "www.", "m.", "blog.")[k % 4], ("com", "net", "org")[k % 3], ("en", "de", "fr", "es")[k // 2 % 4]
        tail = ("", ".html", "/", "?page=2&ref=x", "#top", "?utm_source=feed")[k % 6]
        rows.append((f"http{'s' * (k % 2)}://{sub}{name}.example.{tld}/{lang}/{section}{(k * 7919 + 13) % 6000}{tail}", y))

    for y, words in ((1, _UNWANTED), (0, _PLAIN)):
        n = len(words)
        for k, word in enumerate(words):
            names = (word, f"{word}-{words[(5 * k + 7) % n]}", f"{words[(11 * k + 3) % n]}-{word}", f"{word}{words[(13 * k + 1) % n]}")
            for j, name in enumerate(names):
                add(name, 4 * k + 5 * j + k // 4, y)
            add(names[k % 4], 3 * k + 1, y, f"{words[(17 * k + 5) % n]}/")  # a word in the path, too
    for k in range(144):
        parts = [_SYLLABLES[(k * (2 * j + 3) + 5 * j * j + k // 20) % len(_SYLLABLES)] for j in range(2 + k % 2)]
        add(("-" if k % 4 == 3 else "").join(parts), 7 * k + k // 3, 0)
    return rows


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path), as host_and_path() gives them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    return rest[:end].translate(str.maketrans(_UPPER, _LOWER)), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def grams(host: str, path: str) -> Counter:
    """Buckets of the n-grams of host and path, each between marks."""
    found: Counter = Counter()
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            for i in range(len(text) - n + 1):
                found[int(hashlib.md5(f"{part}{text[i : i + n]}".encode()).hexdigest()[:3], 16) % BUCKETS] += 1
    return found


@lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[str, int], ...], rounds: int, rate: float, decay: float) -> tuple[tuple[int, ...], int]:
    mixed = sorted(rows, key=lambda r: hashlib.md5(r[0].encode()).digest())  # steps must not see one kind after the other
    data = [(grams(*split_url(u)), y) for u, y in mixed]
    weights, bias = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for x, y in data:
            z = bias + sum(weights[b] * c for b, c in x.items())
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            bias -= rate * g
            for b, c in x.items():
                weights[b] -= rate * (g * c + decay * weights[b])
    return tuple(round(w * SCALE) for w in weights), round(bias * SCALE)


def fit(rows: list[tuple[str, int]] | None = None, rounds: int = 40, rate: float = 0.02, decay: float = 1e-3) -> tuple[tuple[int, ...], int]:
    """Integer weights by bucket and the bias, by gradient steps over the labelled table in the order of its hashes."""
    rows = labelled_urls() if rows is None else rows
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(rows)} rows; at most {MAX_LABELLED} are fitted")
    return _fitted(tuple((u, int(y)) for u, y in rows if u is not None and y is not None), rounds, rate, decay)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _buckets(part: str, text: Column, n: int) -> Column:
    gram = lambda i: F.concat(F.lit(part), F.substring(text, i, F.lit(n)))
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(F.md5(gram(i)), 1, 3), 16, 10).cast("int") % BUCKETS)


def judge_urls(pages: DataFrame, rules=RULES, model: tuple[tuple[int, ...], int] | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    A rule fits its host and all subdomains of it where the path begins with the rule's; of several the longest name
    wins, then block. rule is its name or null; verdict is the rule's, else block where score (the probability of
    block) is over one half. A null url or one without `://` has an empty host and path and is judged as such. Rows
    are independent: repeated rows repeat, null ids stay, other columns are not read.
    """
    weights, bias = model or fit()
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    fits = lambda r: ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
    pick = lambda value: F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ranked]) if ranked else F.lit(None).cast("string")
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<long>")  # folded to one literal
    marked = {p: F.concat(F.lit("^"), F.col(c), F.lit("$")) for p, c in (("h", "host"), ("p", "path"))}
    found = F.concat(*[_buckets(p, text, n) for p, text in marked.items() for n in SIZES])
    z = F.aggregate(found, F.lit(bias).cast("long"), lambda a, b: a + F.get(table, b))
    judged = rows.select("page_id", "host", "path", pick(lambda r: r.name).alias("rule"), pick(lambda r: r.verdict).alias("ruled"), z.alias("z"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("z") > 0, "block").otherwise("allow")).alias("verdict"), F.round(1 / (1 + F.exp(-F.col("z") / SCALE)), 6).alias("score"))


def judge_sql(rules=RULES) -> str:
    """DuckDB: the same rules and weights."""
    weights, bias = fit()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})"
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN {quoted(value(r))}" for r in ranked) + " END"
    grams_ = [f"list_transform(range(1, length({c}) + 2 - {n} + 2), lambda i: {quoted(p)} || substr('^' || {c} || '$', i, {n}))" for p, c in (("h", "host"), ("p", "path")) for n in SIZES]
    found = reduce(lambda a, b: f"list_concat({a}, {b})", grams_)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
w AS (SELECT [{','.join(map(str, weights))}]::BIGINT[] AS w),
z AS (SELECT page_id, host, path, {bias}::BIGINT + list_sum(list_transform({found}, lambda g: w[(('0x' || md5(g)[1:3])::INT % {BUCKETS}) + 1]))::BIGINT AS z FROM u, w)
SELECT page_id, host, path, {pick(lambda r: r.name)} AS rule, coalesce({pick(lambda r: r.verdict)}, CASE WHEN z > 0 THEN 'block' ELSE 'allow' END) AS verdict, round(1 / (1 + exp(-z::DOUBLE / {SCALE})), 6) AS score
FROM z
"""
