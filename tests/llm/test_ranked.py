"""Ranked search against brute force; pieces of long texts; the accumulators' limit."""

import math
import re
from collections import Counter

import duckdb
import pytest

from tidestep.llm import ranked as own
from tidestep.llm.queries import oracle_sql, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def key(rows):
    return sorted(map(str, rows))


def test_query_against_brute_force_and_sql(spark, sf, doc_rows):
    got = [tuple(r) for r in queries()["op12_ranked_search"](spark, sf).select("item_id", "rank", "doc_id", "score").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert key(got) == key(brute(doc_rows, items))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert key(got) == key(c.sql(f"SELECT item_id, rank, doc_id, score FROM ({oracle_sql()['op12_ranked_search']})").fetchall())


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_odd_documents(spark, odd, odd_rows, none, monkeypatch, piece):
    """Nulls, empty and long texts, repeated rows, a null id; the items' ids repeat too."""
    monkeypatch.setattr(own, "PIECE", piece)
    values = [(1, "the same WORDS"), (1, "again text"), (2, None), (3, "zzz qqq"), (None, "naïve 漢字 two 1234"), (4, "word1 of short")]
    items = spark.createDataFrame(values, "item_id long, text string")
    got = [tuple(r) for r in own.ranked(odd, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert key(got) == key(brute(odd_rows, values))
    assert own.ranked(none, items).count() == 0
    assert own.ranked(odd, items.limit(0)).count() == 0


def test_pieces_are_cut_between_terms(monkeypatch):
    text = ("Ab cd--" * 50 + "é" * 40 + " x" * 30 + "Z" * 90).encode()
    whole = own.counted(text)
    for piece in (1, 3, 16, 64):
        monkeypatch.setattr(own, "PIECE", piece)
        assert own.counted(text) == whole
    assert whole[0] == len(terms(text.decode()))


def test_accumulators_are_limited_and_survivors_exact():
    """Common terms come last: by then the first k have more than they can add, so no document gets an accumulator for them, and the result is that of all."""
    import pyarrow as pa

    docs = [(i, 20, ["rare", "common"] if i < 12 else ["common"], [9 if i < 12 else 1, 1][: 2 if i < 12 else 1]) for i in range(5000)]
    table = pa.table([pa.array(c) for c in zip(*docs, strict=True)], names=["doc_id", "n", "terms", "counts"]).combine_chunks().to_batches()[0]
    lists = own.Lists(table, 5000, 100_000)
    seen = []
    plain = lists.held

    class Watched(type(plain)):
        def __setitem__(self, at, value):
            if value is True:
                seen.append(len(at))
            super().__setitem__(at, value)

    lists.held = plain.view(Watched)
    rows, score = lists.ranked(["rare", "common"], [6000, 10], 10)
    assert sum(seen) == 12 and len(rows) == 10 and lists.ids[rows].tolist() == list(range(10))
    m = 10 + 90 * 20 * 5000 // 100_000
    assert score[0] == 6000 * (9 * 10**9 // (9000 + 8 * m)) + 10 * (10**9 // (1000 + 8 * m))
    assert not lists.held.any() and not lists.sums.any()
