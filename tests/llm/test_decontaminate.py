"""Edit matching against dynamic programming over whole texts."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestep.llm.decontaminate import Matcher, Pattern, contaminations, normal_form, without_items
from tidestep.llm.queries import queries


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@given(st.text("abc", min_size=1, max_size=30), st.text("abc", max_size=60))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    assert Pattern(pattern).distance(text) == distance(pattern, text)


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_matches_are_those_of_brute_force(data):
    words = st.lists(st.sampled_from("the quick brown fox jumps over lazy dogs and runs".split()), min_size=3, max_size=14).map(" ".join)
    item, around = data.draw(words), data.draw(words)
    edited = list(item)
    for _ in range(data.draw(st.integers(0, len(item) // 10 + 2))):
        at = data.draw(st.integers(0, max(len(edited) - 1, 0)))
        edited[at : at + data.draw(st.integers(0, 1))] = data.draw(st.text("xyz", max_size=1))
    text = f"{around} {''.join(edited)} {around}"
    want = distance(f" {normal_form(item)} ", f" {normal_form(text)} ")
    got = Matcher([(1, item)], 0.1).match(text)
    assert got == ({0: want} if want <= int(0.1 * len(normal_form(item))) else {})


def test_query_finds_the_planted_passages(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if f" {normal_form(b.text)} " in f" {normal_form(d.text or '')} "}
    got = queries()["op6_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == whole and all(r.distance <= r.budget for r in got)


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(25)]
    texts = []
    for d in range(60):
        passage = list(items[d % 25][1])
        for _ in range(rng.randint(0, len(passage) // 8)):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y z"])
        texts.append((d, " ".join([*(word() for _ in range(20)), "".join(passage), *(word() for _ in range(20))])))
    got = {(r.doc_id, r.item_id): r.distance for r in contaminations(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): n for d, t in texts for i, item in items if (n := distance(f" {normal_form(item)} ", f" {normal_form(t)} ")) <= int(0.1 * len(normal_form(item)))}
    assert got == want and any(want.values())


def test_short_items_match_whole_words(spark):
    items = spark.createDataFrame([(1, "no"), (2, "art")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "we know a party"), (2, "No."), (3, "the art, of it")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminations(docs, items).collect()) == [(2, 1), (3, 2)]
    assert [r.doc_id for r in without_items(docs, items).collect()] == [1]


def test_blocks_give_the_same(spark, sf, docs):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert Counter(map(tuple, contaminations(docs, benchmark, block_bytes=2000).collect())) == Counter(map(tuple, contaminations(docs, benchmark).collect()))


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "The same, words! stand here once more and then AGAIN today"), (2, None), (3, ""), (4, "..."), (5, "short"), (5, "short"), (None, "x" * 120)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in contaminations(odd, items).collect())
    assert got == {(4, 1): 2, (9, 5): 1, (6, None): 1}
    kept = without_items(odd, items)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 7: 1, 8: 1}


def test_empty_tables(spark, none, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contaminations(none, empty).count() == contaminations(odd, empty).count() == 0
    assert without_items(odd, empty).count() == odd.count()


@pytest.mark.parametrize("seed", range(3))
def test_clean_texts_stay(seed, sf, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(seed)
    words = [w for _, t in items for w in t.split()]
    assert Matcher(items, 0.1).match(" ".join(rng.choice(words) for _ in range(3000))) == {}
