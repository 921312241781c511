r"""Secret scans by a trigram inverted index, in DataFrame functions alone.

Each rule's regex is parsed on the driver into a Boolean query over trigrams: a disjunction of conjunctions, of which every
match satisfies one. The index is (trigram, text) postings of the trigrams that some query names; a conjunction's postings
are intersected by counting, for each text, how many of its trigrams list that text. Texts that satisfy a rule's query
are its candidates and are verified with the regex itself. A rule without mandatory trigrams (the hex rule) has no query
and scans every text in the pass that makes the index.

That pass is the only one over all texts. It leaves a text out of the index that lacks the first or the last trigram of every
conjunction, as no intersection can hold it; what it lists is written to the shared folder once. Listed texts are known by their SHA-256: copies are
combined within each task before they are shuffled, so they are intersected and verified once and a hot text comes to
few rows. Postings are counted by text, never gathered by trigram. The verified spans go back to the rows of listed texts
alone, dealt over SALTS parts of a text. The terms of the queries stand in the plan as literals; nothing is broadcast by force.

Defined cases: a null text is empty and has no span; a very long text is scanned whole; spans that start together are ordered by rule; repeated rows each give a row; an
empty table gives no row; columns other than id and text aren't read. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import itertools
import operator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import columns_of, fresh, texts_of
from tidestep.storage import cut


@dataclass(frozen=True)
class Rule:
    """pattern: a regex that Java and Python read alike. A match is kept if group `group` has at_least characters."""

    kind: str
    pattern: str
    group: int
    at_least: int


#: Fixed values. The base rules, in the order in which ties are listed; [0-9a-f]{24,} and AKIA[A-Z0-9]{16,} match where the contract's open-ended forms match and pass their length test, since runs are matched whole.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Fixed values. What the index adds at no further pass.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)
RULES = BASE_RULES + MORE_RULES


def _trigrams(text: str) -> frozenset[str]:
    """As many of a string's trigrams as cover it: each third and the last."""
    return frozenset(text[i : i + 3] for i in {*range(0, len(text) - 2, 3), len(text) - 3} if i >= 0)


def _absorb(conjunctions: set[frozenset[str]]) -> set[frozenset[str]]:
    return {c for c in conjunctions if not any(d < c for d in conjunctions)}


def _and(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    return _absorb({x | y for x, y in itertools.product(a, b)})


ALWAYS = {frozenset()}
MOST_EXACT = 64


def trigram_query(pattern: str) -> set[frozenset[str]]:
    """Conjunctions of lower-case trigrams of which every match of the pattern satisfies one; {empty}: no mandatory trigram."""

    def walk(items) -> tuple[set[str] | None, set[frozenset[str]]]:
        """(the exact lower-case strings, if few, else None; the query)."""
        exact: set[str] | None = {""}
        whole, query = True, ALWAYS
        for op, arg in items:
            strings, own = one(op, arg)
            if strings is not None and "" in strings and all(len(x) > 2 for x in exact):
                strings = None  # what may be missing adds conjunctions, but makes none of them stricter
            if strings is not None and len(exact) * len(strings) <= MOST_EXACT:
                exact = {a + b for a, b in itertools.product(exact, strings)}
                continue
            query = _and(_and(query, _absorb({_trigrams(x) for x in exact})), own if strings is None else ALWAYS)
            exact, whole = ({""}, False) if strings is None else (strings, False)
        return (exact, query) if whole else (None, _and(query, _absorb({_trigrams(x) for x in exact})))

    def one(op, arg) -> tuple[set[str] | None, set[frozenset[str]]]:
        if op is rc.LITERAL:
            return {chr(arg).lower()}, ALWAYS
        if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}, ALWAYS
        if op is rc.SUBPATTERN:
            return walk(arg[3])
        if op is rc.BRANCH:
            parts = [walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                return set().union(*(s for s, _ in parts)), ALWAYS
            return None, _absorb(set().union(*(q if s is None else {_trigrams(x) for x in s} for s, q in parts)))
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            least, most, inner = arg
            strings, own = walk(inner)
            if strings is not None and (least, most) == (0, 1):
                return strings | {""}, ALWAYS
            if strings is not None and least == most and len(strings) ** least <= MOST_EXACT:
                return {"".join(x) for x in itertools.product(strings, repeat=least)}, ALWAYS
            return None, ALWAYS if not least else own if strings is None else _absorb({_trigrams(x) for x in strings})
        return None, ALWAYS

    strings, query = walk(rp.parse(pattern))
    return query if strings is None else _absorb({_trigrams(x) for x in strings})


SPANS = "array<struct<start:int,rule:int,stop:int>>"


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, rule number, stop>> of a rule's kept matches, leftmost and not overlapping.

    The pieces between the matches and the matches are laid end to end: a match begins at the sum of the lengths before it.
    """
    none = F.array().cast(SPANS)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("n"), F.transform(tested, F.length).alias("t"))
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(number).alias("rule"), (at + x["gap"] + x["n"]).alias("stop"))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("kept")),
        lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.when(x["t"] >= rule.at_least, F.concat(s["kept"], F.array(span(s["at"], x)))).otherwise(s["kept"]).cast(SPANS).alias("kept")),
    )
    return F.when(text.rlike(rule.pattern), walked["kept"]).otherwise(none)


#: Parts in which the rows of one text are dealt, as very many may hold it.
SALTS = 8


class Index:
    """The rules' trigram queries: the named trigrams, and for each its (rule, conjunction, how many trigrams that has)."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        queries = [trigram_query(r.pattern) for r in rules]
        self.rules = rules
        self.full = [i for i, q in enumerate(queries) if q == ALWAYS]
        conjunctions = [(i, sorted(c)) for i, q in enumerate(queries) if q != ALWAYS for c in sorted(q, key=sorted)]
        self.ends = sorted({(c[0], c[-1]) for _, c in conjunctions})
        self.named = sorted({t for _, c in conjunctions for t in c})
        self.terms = [[(i, k, len(c)) for k, (i, c) in enumerate(conjunctions) if t in c] for t in self.named]

    def may_hold(self, lower: Column) -> Column:
        """Whether a text has the first and the last trigram of some conjunction."""
        return functools.reduce(operator.or_, (lower.contains(a) & lower.contains(b) for a, b in self.ends), F.lit(False))

    def trigrams(self, lower: Column) -> Column:
        return F.array_compact(F.array(*(F.when(lower.contains(t), F.lit(k)) for k, t in enumerate(self.named))))

    def full_spans(self, text: Column) -> Column:
        """The spans of the rules that scan fully."""
        return F.concat(F.array().cast(SPANS), *(spans_of(text, self.rules[i], i) for i in self.full))

    def candidates(self, listed: DataFrame) -> DataFrame:
        """(text_key, rules) of (text_key, trigrams): each text's rules of which some conjunction's postings all list it."""
        distinct = listed.groupBy("text_key").agg(F.first("trigrams").alias("trigrams"))
        postings = distinct.select("text_key", F.explode("trigrams").alias("trigram"))
        terms = F.array(*(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("conjunction"), F.lit(n).alias("n")) for r, k, n in own)) for own in self.terms))
        asked = postings.select("text_key", F.explode(terms[F.col("trigram")]).alias("term")).select("text_key", "term.*")
        met = asked.groupBy("text_key", "conjunction", "rule", "n").agg(F.count("*").alias("found")).filter("found = n")
        return met.groupBy("text_key").agg(F.collect_set("rule").alias("rules"))

    def verified(self, listed: DataFrame) -> DataFrame:
        """(text_key, salt, found): the spans of the indexed rules in the texts of (text_key, text, trigrams), for each of SALTS parts of the text's rows."""
        if not self.named:
            return listed.select("text_key", F.lit(0).alias("salt"), F.array().cast(SPANS).alias("found")).limit(0)
        none = F.array().cast(SPANS)
        texts = listed.groupBy("text_key").agg(F.first("text").alias("text")).join(self.candidates(listed), "text_key")
        own = (F.when(F.array_contains("rules", i), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(self.rules) if i not in self.full)
        found = texts.select("text_key", F.concat(none, *own).alias("found")).filter(F.size("found") > 0)
        return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def salt_of(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; a span's rule is its number in rules."""
    index = Index(rules)
    texts = texts_of(docs, id_col, text_col).withColumn("lower", F.lower("text")).withColumn("may_hold", index.may_hold(F.col("lower")))
    only = lambda c: F.when(F.col("may_hold"), c)
    scanned = cut(texts.select("doc_id", index.full_spans(F.col("text")).alias("spans"), only(key_of(F.col("text"))).alias("text_key"), only(F.col("text")).alias("text"), only(index.trigrams(F.col("lower"))).alias("trigrams")))
    listed = scanned.filter("text_key is not null")
    # the order of rows is no part of the salt, so a lost task deals its rows as before
    rows = listed.select("doc_id", "spans", "text_key", salt_of(F.col("doc_id")).alias("salt"))
    back = rows.join(index.verified(listed), ["text_key", "salt"], "left")
    merged = F.array_sort(F.concat("spans", F.coalesce("found", F.array().cast(SPANS))))
    rest = scanned.filter("text_key is null").select("doc_id", F.array_sort("spans").alias("spans"))
    return rest.unionByName(back.select("doc_id", merged.alias("spans")))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rule"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def without_spans(text: Column, spans: Column, rules: tuple[Rule, ...]) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first stands for both."""
    kinds = F.array(*(F.lit(f"[{r.kind}]") for r in rules))
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["stop"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), kinds[x["rule"]])).alias("out"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(walked["out"], text.substr(walked["at"] + 1, F.length(text)))).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows, of any columns, with every span of `text` replaced by its kind in brackets; of spans that overlap the first stands for both.

    Only rows of listed texts are shuffled, to meet their spans; the others, whose only spans are those of the rules that scan
    fully, pass through.
    """
    index = Index(rules)
    text, lower, key, salt, found = fresh(docs, "whole", "lower", "text_key", "salt", "found")
    held = docs.withColumn(text, F.coalesce(docs["text"].cast("string"), F.lit(""))).withColumn(lower, F.lower(text))
    may_hold, whole = index.may_hold(F.col(lower)), F.col(text)
    listed = held.filter(may_hold).withColumn(key, key_of(whole))
    indexed = cut(listed.select(F.col(key).alias("text_key"), whole.alias("text"), index.trigrams(F.col(lower)).alias("trigrams")))
    spans = index.verified(indexed).select(F.col("text_key").alias(key), F.col("salt").alias(salt), F.col("found").alias(found))
    back = listed.withColumn(salt, salt_of(docs["doc_id"])).join(spans, [key, salt], "left")
    merged = F.array_sort(F.concat(index.full_spans(whole), F.coalesce(F.col(found), F.array().cast(SPANS))))
    # a row's other columns stay as they are; a null text stays null
    clean = lambda df, own: df.withColumn("text", F.when(F.col("text").isNotNull(), without_spans(whole, own, rules))).select(*columns_of(docs.columns))
    return clean(held.filter(~may_hold), F.array_sort(index.full_spans(whole))).unionByName(clean(back, merged))
