"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over case-folded trigrams that every match must contain, as in
index-backed regular expression search: an AND of ORs of ANDs. postings() is the index: for blocks of documents, a
list of ids for each of the rules' trigrams, found in one pass over a text. candidates() intersects and unites the
lists of a block as a rule's query says. scan() runs a rule's pattern on its candidates only; rules without a
mandatory trigram run on all rows. Spans are found in time linear in a text and its matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import materialize

_parser = re._parser


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group `group` has at least `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: In the order of their names in lists of spans. The base kinds come first.
RULES = (
    Rule("assign", "(" + "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),  # the matches of 20 and more of AKIA[A-Z0-9]+
    Rule("hex", "[0-9a-f]{24,}", base=True),  # the runs of 24 and more
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query: all of these must hold; each is a set of alternatives, each alternative a set of trigrams.
Query = tuple[frozenset[frozenset[str]], ...]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str, most: int = 64) -> Query:
    """What the folded text of every match must contain; empty if nothing is mandatory."""
    clauses: list[frozenset[frozenset[str]]] = []

    def close(run: set[str]) -> None:
        if run and all(len(s) >= 3 for s in run):
            found = {trigrams(s) for s in run}
            clauses.append(frozenset(a for a in found if not any(b < a for b in found)))

    def exact(items) -> set[str] | None:
        """All folded strings that the items match, or None if there are too many."""
        run = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "IN":
                more = _class(arg, most)
            elif name == "SUBPATTERN":
                more = exact(arg[3])
            elif name == "BRANCH":
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] <= 3 and (inner := exact(arg[2])) is not None:
                more = set().union(*({s for s in _times(inner, k)} for k in range(arg[0], arg[1] + 1)))
            else:
                more = None
            if more is None or len(run) * len(more) > most:
                return None
            run = {a + b for a in run for b in more}
        return run

    run = {""}
    for item in _flat(_parser.parse(pattern)):
        more = exact([item])
        if more is not None and len(run) * len(more) <= most:
            run = {a + b for a in run for b in more}
        else:
            close(run)
            run = more if more is not None and len(more) <= most else {""}
    close(run)
    return tuple(clauses)


def _flat(items):
    for op, arg in items:
        if str(op) == "SUBPATTERN":
            yield from _flat(arg[3])
        else:
            yield op, arg


def _times(strings: set[str], k: int) -> set[str]:
    return reduce(lambda a, _: {x + y for x in a for y in strings}, range(k), {""})


def _class(items, most: int) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            found.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < most:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None  # a wide class ends a run of characters


def all_trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for alternative in clause for t in alternative})


#: Documents of a block of the index, on average.
BLOCK_DOCS = 4096
#: Candidates up to which every executor is told them all: ids and rule numbers, about 100 bytes each.
TOLD_ROWS = 500_000


def _any_of(grams: list[str]) -> str:
    """A pattern that stops where one of the trigrams begins, and captures it: alternatives by first and second sign."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in grams:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    e = re.escape
    inner = lambda more: "|".join(f"{e(b)}(?:{'|'.join(map(e, cs))})" for b, cs in more.items())
    return "(?=(" + "|".join(f"{e(a)}(?:{inner(more)})" for a, more in tree.items()) + "))"


def postings(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The inverted index: block, lists (map from trigram to the distinct ids of the block's documents that hold it).

    Only the rules' trigrams are indexed. Ids are dealt to blocks by hash, so a block has about block_docs distinct
    ids, however often one repeats. Null texts and null ids have no entry.
    """
    grams = all_trigrams(rules)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.lower(F.col(f"`{text}`")).alias("folded")).where("id IS NOT NULL")
    if not grams:
        return rows.select(F.lit(0).alias("block"), F.create_map(F.lit(""), F.array("id")).alias("lists")).limit(0)
    blocks = max(1, -(-docs.count() // block_docs))
    held = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("folded", F.lit(_any_of(grams)), F.lit(1)))).alias("trigram"))
    entries = held.distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    lists = entries.groupBy("block", "trigram").agg(F.collect_list("id").alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(rank, id) of rules with a query: rank is the rule's place, id one of whose texts may match."""
    none = F.filter(F.flatten(F.map_values("lists")), lambda _: F.lit(False))  # an empty list of ids
    listed = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    found = []
    for rank, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            alternative = lambda a: reduce(F.array_intersect, [listed(t) for t in sorted(a)])
            clause = lambda c: reduce(F.array_union, [alternative(a) for a in sorted(c, key=sorted)])
            found.append(F.struct(F.lit(rank).alias("rank"), reduce(F.array_intersect, [clause(c) for c in query]).alias("ids")))
    if not found:
        return index.select(F.lit(0).alias("rank"), F.explode(F.flatten(F.map_values("lists"))).alias("id")).limit(0)
    return index.select(F.explode(F.array(*found)).alias("r")).select("r.rank", F.explode("r.ids").alias("id"))


_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"
#: Members of a block in running folds over arrays.
FOLD = 64


def _let(value: Column, body) -> Column:
    """body(value), with the value made once, also where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _before(values: Column, fold, levels: int = 2) -> Column:
    """For each of an array of ints, the fold of all before it (0 for none): blocks, blocks of blocks, then those."""
    every = lambda x: F.aggregate(x, F.lit(0), fold)
    if not levels:
        return _let(values, lambda v: F.transform(v, lambda _, i: every(F.slice(v, 1, i))))
    cut = lambda v: F.transform(_places(F.ceil(F.size(v) / FOLD).cast("int")), lambda k: F.slice(v, k * FOLD + 1, FOLD))
    inner = lambda blocks: _let(_before(F.transform(blocks, every), fold, levels - 1), lambda out: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda _, i: fold(F.get(out, k), every(F.slice(b, 1, i)))))))
    return _let(values, lambda v: _let(cut(v), inner))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the rule's matches that are long enough: what lies between matches gives their places."""
    match, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else match
    # lengths of what is before a match, of the match, and of what must be long
    sizes = F.transform(F.arrays_zip(between.alias("b"), match.alias("m"), part.alias("p")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["p"]).alias("p")))
    whole = F.filter(sizes, lambda x: x["m"].isNotNull())  # the last piece has no match behind it

    def placed(rows: Column) -> Column:
        starts = _before(F.transform(rows, lambda x: x["b"] + x["m"]), lambda a, b: a + b)
        span = lambda x, at: F.struct((at + x["b"]).cast("int").alias("start"), F.lit(rank).alias("rank"), (at + x["b"] + x["m"]).cast("int").alias("stop"), F.lit(rule.kind).alias("kind"))
        told = _let(starts, lambda at: F.transform(rows, lambda x, i: F.struct(span(x, F.get(at, i)).alias("s"), x["p"].alias("p"))))
        return F.transform(F.filter(told, lambda t: t["p"] >= rule.least), lambda t: t["s"]).cast(_SPANS)

    return _let(whole, placed)


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs and `_spans`: array of (start, rank, stop, kind) in code points, by start, then rule order.

    Null and empty texts have no spans. Rows that share an id are candidates together, and each is verified by itself;
    rows of a null id are verified by every rule. Extra columns pass through; only names that begin with `_spans` are
    taken. The table is read twice, for the index and for the verification.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    found = materialize(candidates(postings(docs, rules, doc_id, text), rules), "secret-candidates")
    told = found.groupBy("id").agg(F.collect_set("rank").alias("_spans_rules")).withColumnRenamed("id", "_spans_id")
    if found.count() <= TOLD_ROWS:  # of checked size; beyond it texts are shuffled by id
        told = F.broadcast(told)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.join(told, F.col(f"`{doc_id}`") == F.col("_spans_id"), "left")
    spans = []
    for rank, rule in enumerate(rules):
        may = (F.col(f"`{doc_id}`").isNull() | F.coalesce(F.array_contains("_spans_rules", rank), F.lit(False))) if queries[rank] else F.lit(True)
        spans.append(F.when(may & body.rlike(rule.pattern), _spans(body, rule, rank)).otherwise(F.array().cast(_SPANS)))
    return rows.withColumn("_spans", F.array_sort(F.concat(*spans))).drop("_spans_id", "_spans_rules")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a count n_<kind> for each base rule, base_sha256 and spans of every row; the cases of scan() hold."""
    found = scan(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), rules)
    base = [k for k, r in enumerate(rules) if r.base]
    of = lambda k: F.filter("_spans", lambda s: s["rank"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    own = F.filter("_spans", lambda s: s["rank"].isin(base))
    return found.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


#: Code points of the pieces in which a text is cut.
PIECE = 4096


def redact(docs: DataFrame, rules=RULES, text: str = "text", mask: str = "[REDACTED]", doc_id: str = "doc_id") -> DataFrame:
    """docs with every span of the text replaced by the mask, overlapping spans by one; a null text stays null."""
    body = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))

    def cut(held: Column, a: Column, z: Column) -> Column:
        """The code points from a to z, of the pieces that hold them."""
        own = lambda k: F.substring(F.get(held, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(z - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0)))
        some = F.sequence((a / PIECE).cast("int"), ((z - 1) / PIECE).cast("int"))
        return F.when(z > a, F.array_join(F.transform(some, own), "")).otherwise("")

    def masked(held: Column) -> Column:
        ends = _before(F.transform("_spans", lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
        gap = lambda s, at: F.when(s["start"] >= at, F.concat(cut(held, at, s["start"]), F.lit(mask))).otherwise("")
        told = _let(ends, lambda at: F.array_join(F.transform("_spans", lambda s, i: gap(s, F.get(at, i))), ""))
        return F.concat(told, cut(held, F.array_max(F.transform("_spans", lambda s: s["stop"])), F.length(body)))

    return scan(docs, rules, doc_id, text).withColumn(text, F.when(F.size("_spans") > 0, _let(pieces, masked)).otherwise(body)).drop("_spans")


def secrets_sql(rules=RULES) -> str:
    """DuckDB: every rule runs on every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(rules):
        parts.append(
            f"SELECT doc_id, {rank} AS rank, {quoted(r.kind)} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'least': length(g[i])}})) AS s "
            f"FROM (SELECT doc_id, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g, string_split_regex(t, {quoted(r.pattern)}) AS b FROM d)"
        )
    base = ",".join(str(k) for k, r in enumerate(rules) if r.base)
    counts = "".join(f"coalesce(count(*) FILTER (WHERE rank = {k}), 0)::BIGINT AS n_{r.kind}, " for k, r in enumerate(rules) if r.base)
    least = "CASE rank " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(rules)) + " END"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(parts)}), "
        f"k AS (SELECT doc_id, rank, s.start::BIGINT AS start, kind || ':' || s.start::BIGINT || ':' || (s.start + s.n)::BIGINT AS name FROM s WHERE s.least >= {least}) "
        f"SELECT d.doc_id, {counts}sha256(coalesce(string_agg(name, ',' ORDER BY start, rank) FILTER (WHERE rank IN ({base})), '')) AS base_sha256, "
        "coalesce(string_agg(name, ',' ORDER BY start, rank), '') AS spans FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id"
    )
