"""Secret scans against Python's regexes over whole texts."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidestep.llm.queries import queries
from tidestep.llm.secret_scan import BASE_RULES, RULES, listed, redact, scan_secrets, trigram_query

BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in re.finditer(p, text) if len(m[g]) >= n)
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in found]


def base_spans(frame):
    own = frame.select("doc_id", listed(F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))).alias("s"))
    return Counter(map(tuple, own.collect()))


def test_query_against_regexes(spark, sf, doc_rows):
    got = {r.doc_id: r for r in queries()["op9_secret_scan"](spark, sf).collect()}
    assert len(got) == len(doc_rows)
    for i, t in doc_rows:
        want, r = spans(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k[0] + ":") for x in want) for k in BASE]
        assert set(want) <= set(r.spans.split(","))


TRICKY = [
    "password=token:abcdef and secret = 'a1b2c3d4'", "PassWord : \"xyz_123-=.+/\" 🙂 api-key=zzzzzzzz APIKEY=abc12 api_key=abc123", "AKIA" + "A" * 16, "AKIAAKIA" + "Z" * 11, "xAKIA" + "0" * 40,
    "f" * 23, "f" * 24 + "g" + "0" * 30, "🙂🙂 deadbeef" * 3 + "a" * 30, "token=abcdef012345678901234567890123456789abcdef", "password='' secret: \"short\" token==== abcdefgh", "Kpassword=ıİsecret=abcdefg", "passwd:password=secret",
]


def test_tricky_texts(spark):
    frame = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    assert base_spans(scan_secrets(frame)) == Counter((i, ",".join(spans(t))) for i, t in enumerate(TRICKY))


def test_added_rules_are_found(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "x ghp_" + "Z9y" * 12 + " y", "xoxb-1234567890-abc", "ghp_short"]
    got = {r.doc_id: [RULES[s.rule].kind for s in r.spans] for r in scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ["private_key"], 1: ["github"], 2: ["slack"], 3: []}


def test_odd_rows(odd, odd_rows, none):
    assert base_spans(scan_secrets(odd)) == Counter((i, ",".join(spans(t))) for i, t in odd_rows)
    assert scan_secrets(none).count() == 0 and redact(none).count() == 0


def test_redaction(spark, odd):
    frame = spark.createDataFrame([(1, "a token = \"" + "0a" * 20 + "\" b AKIA" + "Q" * 16 + "!", 5), (2, None, None), (3, "clean", 1), (3, "clean", 1)], "doc_id long, text string, spans int")
    assert Counter(map(tuple, redact(frame).collect())) == Counter({(1, "a [assign]\" b [access]!", 5): 1, (2, None, None): 1, (3, "clean", 1): 2})
    assert Counter((r.doc_id, r.text) for r in redact(odd).collect()) == Counter((r.doc_id, r.text) for r in odd.collect())


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_matches_satisfy_their_query(rule):
    texts = [*TRICKY, "-----BEGIN EC PRIVATE KEY-----", "gho_" + "Zz9" * 12, "xoxp-" + "1-a" * 5, "PASSWD=123456", "Api_Key : 1234567"]
    for t in texts:
        if re.search(rule.pattern, t):
            assert any(all(g in t.lower() for g in c) for c in trigram_query(rule.pattern))


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("abc", {frozenset({"abc"})}), ("abcd", {frozenset({"abc", "bcd"})}), ("a+", {frozenset()}), ("(abc|xyz)d?", {frozenset({"abc"}), frozenset({"xyz"})}), ("abc|.", {frozenset()}), ("ab[cd]", {frozenset({"abc"}), frozenset({"abd"})}), ("(?:abc)+", {frozenset({"abc"})}), ("(?:abc)*x", {frozenset()})],
)
def test_queries_of_patterns(pattern, want):
    assert trigram_query(pattern) == want


def test_main_path_is_native(spark, sf, monkeypatch):
    from tidestep.llm import secret_scan

    monkeypatch.setattr(secret_scan, "cut", lambda df: df)
    plan = queries()["op9_secret_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_secret_text_in_many_rows(spark, monkeypatch):
    """A hot text is verified once, and its rows are dealt over several parts."""
    from tidestep.llm import secret_scan

    hot = "some words before password=hunter2hunter2 " + "and after " * 20
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, hot).otherwise(F.concat(F.lit("text without any of it "), F.col("id"))).alias("text")).repartition(8)
    seen = {}
    whole = secret_scan.Index.verified
    monkeypatch.setattr(secret_scan.Index, "verified", lambda self, listed: seen.setdefault("spans", whole(self, listed)))
    got = scan_secrets(frame)
    assert got.filter(F.size("spans") == 1).count() == 6_667 and got.count() == 20_000
    assert seen["spans"].count() == secret_scan.SALTS
    parts = frame.filter("doc_id % 3 = 0").groupBy(secret_scan.salt_of(F.col("doc_id"))).count().collect()
    assert len(parts) == secret_scan.SALTS and max(r["count"] for r in parts) < 1_000
    assert redact(frame).filter(F.col("text").contains("[assign]")).count() == 6_667


def test_clashing_names(spark):
    names = ["whole", "lower", "text_key", "salt", "found", "__text", "__key", "Spans", "a.b", "c`d"]
    frame = spark.createDataFrame([(1, "x password=abcdefgh y", *names), (2, None, *names), (None, "f" * 30, *names)], ["doc_id", "text", *names])
    got = redact(frame)
    assert got.columns == frame.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, "x [assign] y", *names), (2, None, *names), (None, "[hex]", *names)])


def test_rules_without_a_query_or_alone(spark):
    frame = spark.createDataFrame([(1, "f" * 30 + " password=abcdefgh")], "doc_id long, text string")
    for rules, n in ((BASE_RULES[2:], 1), (BASE_RULES[:1], 1), (BASE_RULES, 2)):
        assert len(scan_secrets(frame, rules).first().spans) == n
