"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A document is a set of weighted terms: its distinct words, in lower case, each with its number of occurrences. For every
one of `samples` independent samplers k and every term t, hashes of (t, k) give r and c from Gamma(2, 1) and b from
U(0, 1). With q = floor(ln w / r + b) the term's value is a = c * exp(-r * (q - b) - r), and the least value's (t, q) is
the k-th sample. Two documents share it with a probability that equals their generalised Jaccard similarity, the sum of
the lesser weights over the sum of the greater, so the share of equal samples estimates it.

A sample is the least ln a alone, a double that depends on (t, q, k) and nothing else: equal (t, q) give equal bits, and its hash
identifies them. So a document's samples are plain minima. Terms are counted in the row (sorted words, runs of equal ones)
and never shuffled; the texts of a range of documents, which a partition holds, share most of their terms, so there each (term, weight) is sampled once.

Defined cases: a null text is empty; an empty text (or one of white space) has the fingerprint '' and is alike (1.0) only
to such texts; a very long text is sampled whole; equal texts have equal fingerprints; repeated rows each give a row; of documents that tie by
doc_id the order of their texts tells which is next; an empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidestep.llm.common import shuffle_parts, texts_of

BITS = 21
#: A likeness s has a standard error of sqrt(s (1 - s) / SAMPLES): 0.060 at 0.37, 0.050 at 0.8.
SAMPLES = 64
#: A SHA-256 in parts.
DIGITS, DIGEST_PARTS = 13, 5


def _uniform(h: Column, part: int) -> Column:
    """In (0, 1), from BITS of a hash."""
    return (F.shiftrightunsigned(h, BITS * part).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit(0.5)) / F.lit(float(1 << BITS))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th sampler's ln a of a term, a function of (term, q) alone; null without a weight."""
    h = F.xxhash64(term, F.lit(k))
    g = F.xxhash64(h)
    r = -F.log(_uniform(h, 0) * _uniform(h, 1))
    c = -F.log(_uniform(h, 2) * _uniform(g, 0))
    b = _uniform(g, 1)
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + F.lit(1.0))


def term_runs(text: Column) -> Column:
    """The distinct words of a text, each repeated as often as it occurs: 'the the the '."""
    words = F.array_sort(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    return F.regexp_extract_all(F.concat(F.array_join(words, " "), F.lit(" ")), F.lit(r"(\S+ )\1*"), F.lit(0))


def sampled(texts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """The keys and samples s0, s1, ... (null for a text without words) of (keys, text); rows of one key must be one text."""
    runs = texts.select(*keys, F.explode_outer(term_runs(F.col("text"))).alias("run"))
    word = F.substring_index("run", " ", 1)
    terms = runs.select(*keys, F.xxhash64(word).alias("term"), F.log(F.length("run") / (F.length(word) + F.lit(1))).alias("log_weight"))
    # a text without words has a null weight and so null samples; a condition around them would keep Spark from computing what they share once
    return terms.groupBy(*keys).agg(*(F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)))


def digest_parts(digest: Column) -> list[Column]:
    """64 hexadecimal digits as whole numbers of DIGITS digits each; aggregates of numbers need no sort."""
    return [F.conv(F.substring(digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("long") for i in range(DIGEST_PARTS)]


def digest_of(parts: list[Column]) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(p)), min(DIGITS, 64 - DIGITS * i), "0") for i, p in enumerate(parts)))


def sampled_once(sides: DataFrame, samples: int) -> DataFrame:
    """(range, rid, fact0 ..., s0 ...) of (range, rid, text, facts): texts share most of their words, so in each range a term of a weight is sampled once.

    Terms of a range, which is a partition, are gathered as (term, weight) with the numbers of the texts that have it, sampled, and dealt back to these: no exchange.
    A list holds at most the range's texts. Each text has one entry without a term, which carries its facts.
    """
    entries = F.concat(F.array(F.lit("")), term_runs(F.col("text")))
    runs = sides.select("range", "rid", "facts", F.explode(F.coalesce(entries, F.array(F.lit("")))).alias("run"))
    word = F.substring_index("run", " ", 1)
    first = F.col("run") == ""
    facts = F.when(first, F.coalesce("facts", F.array().cast("array<bigint>")))
    terms = runs.select("range", "rid", F.when(~first, F.xxhash64(word)).alias("term"), F.when(~first, F.log(F.length("run") / (F.length(word) + F.lit(1)))).alias("log_weight"), facts.alias("facts"))
    gathered = terms.groupBy("range", "term", "log_weight").agg(F.collect_list("rid").alias("rids"), F.collect_list("facts").alias("facts"))
    # the filter, which drops nothing, keeps the many expressions out of one method too long to be compiled
    each = gathered.select("range", F.filter("rids", lambda x: x.isNotNull()).alias("rids"), "facts", *(sample(F.col("term"), F.col("log_weight"), k).alias(f"s{k}") for k in range(samples)))
    dealt = each.select("range", F.explode(F.arrays_zip("rids", "facts")).alias("v"), *(f"s{k}" for k in range(samples))).select("range", F.col("v.rids").alias("rid"), F.col("v.facts").alias("facts"), *(f"s{k}" for k in range(samples)))
    return dealt.groupBy("range", "rid").agg(*(F.max(F.get("facts", F.lit(i))).alias(f"fact{i}") for i in range(3 + DIGEST_PARTS)), *(F.min(f"s{k}").alias(f"s{k}") for k in range(samples)))


def packed(samples: int) -> Column:
    """The samples' identities; null for a text without words."""
    return F.when(F.col("s0").isNotNull(), F.array(*(F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples))))


def likeness(a: Column, b: Column, samples: int) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))
    return F.when(a.isNull() | b.isNull(), F.when(a.isNull() & b.isNull(), 1.0).otherwise(0.0)).otherwise(same)


def text_of(signature: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signature array<long>, fingerprint) of every row."""
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    found = sampled(texts, ["doc_id", "row"], samples)
    return found.select("doc_id", packed(samples).alias("signature")).withColumn("fingerprint", text_of(F.col("signature")))


def range_of(place: Column, cuts: list[int], width: int = 64) -> Column:
    """How many of the sorted cuts are at most `place`: first among each width-th cut, then within one stretch."""
    whole = F.array(*(F.lit(x) for x in cuts)).cast("array<bigint>")
    coarse = F.array(*(F.lit(x) for x in cuts[width - 1 :: width])).cast("array<bigint>")
    passed = F.size(F.filter(coarse, lambda x: x <= place)) * width
    return passed + F.size(F.filter(F.slice(whole, passed + 1, F.lit(width)), lambda x: x <= place))


def keys_apart(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many hash partitions an integer that is dealt to it."""
    tried, found = parts, {}
    while len(found) < parts:
        tried *= 8
        dealt = spark.range(tried).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k"))
        found = {r.p: r.k for r in dealt.collect()}
    return [found[p] for p in range(parts)]


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint against those of its edited text (its latter half replaced by the start of the next document) and of the next document.

    Documents are dealt into ranges of doc_id; the first row of each range also goes, as a ghost, to the end of the range
    before (the very first to the last range). Each range has a partition of its own: its key is a number that hashes there. So every row meets its successor in its own range: the texts are shuffled
    once, and the windows and sums after it need no further exchange. A null doc_id comes first; rows of one doc_id are ordered by text.
    """
    spark = docs.sparkSession
    rows = texts_of(docs).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = shuffle_parts(spark)
    cuts = rows.agg(F.percentile_approx("place", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(10_000))).first()[0] if parts > 1 else None
    located = rows.withColumn("range", range_of(F.col("place"), sorted(set(cuts or ()))))
    firsts = sorted(tuple(r) for r in located.groupBy("range").agg(F.min("place")).collect())
    heads, befores = [None] * (firsts[-1][0] + 1 if firsts else 1), [None] * (firsts[-1][0] + 1 if firsts else 1)
    for i, (r, place) in enumerate(firsts):
        heads[r], befores[r] = place, firsts[i - 1][0]
    at = lambda values, kind: F.array(*(F.lit(x) for x in values)).cast(f"array<{kind}>")[F.col("range")]
    keys_of = F.array(*(F.lit(x) for x in keys_apart(spark, parts))).cast("array<int>")
    target = F.when(F.col("place") == at(heads, "bigint"), at(befores, "int"))
    dealt = located.select("doc_id", "place", "text", F.explode(F.when(target.isNotNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("ghost")), F.struct(target.alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("ghost"))))).alias("to"))
    dealt = dealt.select("doc_id", "place", "text", keys_of[F.col("to.range")].alias("range"), F.col("to.ghost").alias("ghost"))
    w = Window.partitionBy("range").orderBy("ghost", "place", "text")
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    paired = dealt.withColumns({"row": F.row_number().over(w), "next": F.lead("text").over(w)})
    edited = F.when(F.col("ghost"), None).otherwise(F.concat(F.col("text").substr(F.lit(1), n_chars - half), F.col("next").substr(F.lit(1), half)))
    known = paired.select("range", "row", "ghost", "doc_id", n_chars.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    facts = F.array(F.col("doc_id"), F.col("n_chars"), F.col("ghost").cast("long"), *digest_parts(F.sha2("edited", 256)))
    side = lambda k, text, told: F.struct((F.col("row").cast("long") * 2 + k).alias("rid"), text.alias("text"), told.alias("facts"))
    sides = known.select("range", F.inline(F.array(side(0, F.col("text"), facts), side(1, F.col("edited"), F.lit(None).cast("array<bigint>")))))
    found = sampled_once(sides, samples)
    told = ["doc_id", "n_chars", "ghost", *(f"d{i}" for i in range(DIGEST_PARTS))]
    found = found.select("range", "rid", *(F.col(f"fact{i}").alias(c) for i, c in enumerate(told)), packed(samples).alias("signature"))
    both = Window.partitionBy("range").orderBy("rid")
    # the texts of a range stand as own, edited, the next row's own ...
    joined = found.withColumns({"own_edited": F.lead("signature", 1).over(both), "of_next": F.lead("signature", 2).over(both)}).filter("rid % 2 = 0 AND ghost = 0")
    own = F.col("signature")
    return joined.select(
        "doc_id", "n_chars", digest_of([F.col(f"d{i}") for i in range(DIGEST_PARTS)]).alias("edited_sha256"), text_of(own).alias("fingerprint"), text_of(F.col("own_edited")).alias("edited_fingerprint"),
        likeness(own, F.col("own_edited"), samples).alias("near_edited"), likeness(own, F.col("of_next"), samples).alias("near_next"),
    )
