"""The n-gram join against all pairs."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidestep.llm.components import components
from tidestep.llm import ngram_join as module
from tidestep.llm.ngram_join import blocks_between, columns_product, least_overlap, ngram_join, overlaps, prefix_size, tile_edges
from tidestep.llm.queries import queries
from tidestep.llm.shingles import shingle_set


def sets(text, n):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts, n, num, den):
    """The component of each position, by comparing all pairs."""
    own, up = [sets(t, n) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = own[i], own[j]
        both = len(a & b)
        if both and den * both >= num * (len(a) + len(b) - both):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return own, [root(i) for i in range(len(texts))]


def test_query_against_all_pairs(spark, sf, doc_rows):
    rows = sorted(doc_rows)
    own, comp = brute([t for _, t in rows], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op5_ngram_join"](spark, sf).collect()}
    assert got == {rows[i][0]: (len(own[i]), rows[comp[i]][0]) for i in range(len(rows))}


@pytest.fixture(scope="module")
def chained(spark):
    """Chains of near copies in which the ends don't link, copies, and texts that share a passage."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = []
    for _ in range(6):
        now = [word() for _ in range(60)]
        for _ in range(12):
            texts.append(" ".join(now))
            now = list(now)
            now[int(rng.integers(0, 60))] = word()
    shared = " ".join(word() for _ in range(50))
    texts += [f"{shared} {' '.join(word() for _ in range(k))}" for k in range(1, 40, 3)]
    texts += [texts[0]] * 5 + [texts[0].upper(), "  " + texts[0].replace(" ", "\n\t")]
    return texts


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_chains_against_all_pairs(spark, chained, n, num):
    own, comp = brute(chained, n, num, 100)
    frame = spark.createDataFrame(list(enumerate(chained)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame, n, num, 100).collect()}
    assert got == {i: (len(own[i]), comp[i]) for i in range(len(chained))}
    kept = Counter(r.component_id for r in ngram_join(frame, n, num, 100).filter("kept").collect())
    assert set(kept.values()) == {1} and set(kept) == set(comp)


def test_odd_rows(odd, odd_rows):
    got = ngram_join(odd, 4, 85, 100).collect()
    assert len(got) == len(odd_rows)
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.n_shingles == 0)
    fours = [r for r in got if r.doc_id == 4]
    assert len(fours) == 3 and {r.component_id for r in fours} == {4}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty_table(none):
    assert ngram_join(none).count() == 0


def test_tiles_and_products_against_pairs():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(6)]
    own = [np.unique(np.r_[b[rng.random(len(b)) > 0.05], rng.integers(300, 9000, 3).astype(np.uint64)]) for b in base for _ in range(5)]
    links = {(i, j) for i, j in combinations(range(30), 2) if 100 * (x := len(np.intersect1d(own[i], own[j]))) >= 85 * (len(own[i]) + len(own[j]) - x)}

    def joined(edges):
        up = list(range(30))
        for i, j in edges:
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up]
        return up

    tiles = [(i, j) for i, j in tile_edges(own, None, 85, 100)]
    assert set(tiles) <= links and joined(tiles) == joined(links)
    across = set(tile_edges(own[:13], own[13:], 85, 100))
    assert across <= links and joined([*across, *(x for x in links if x[1] < 13 or x[0] >= 13)]) == joined(links)
    rows = sorted((int(t), len(s), i, i, p) for i, s in enumerate(own) for p, t in enumerate(s[: prefix_size(len(s), 85, 100)]))
    token, size, cid, comp, pos = np.array(rows).T
    found = {(int(a), int(b)) for c in columns_product(token, (cid, comp, size, pos), 85, 100) for a, b in zip(c[0], c[1], strict=True)}
    assert links <= found
    for n, m in ((30, 0), (13, 17)):
        got = overlaps(np.concatenate(own), np.repeat(np.arange(30), [len(s) for s in own]), n, m)
        assert all(got[i, j - (n if m else 0)] == len(np.intersect1d(own[i], own[j])) for i in range(n) for j in range(n if m else i + 1, 30))


def test_blocks_of_a_column():
    spans = [(1, 10, None), (10, 11, 7), (11, 13, 7), (13, 90, None)]
    assert blocks_between(spans, 85, 100) == [(0, 0), (0, 1), (0, 2), (2, 3), (3, 3)]


@pytest.mark.parametrize("column", [7, 1024])
def test_popular_passages_against_all_pairs(spark, monkeypatch, column):
    """Texts made of a few passages: every shingle is in many classes, so columns are split into blocks."""
    monkeypatch.setattr(module, "COLUMN", column)
    monkeypatch.setattr(module, "TILE", 8)
    rng = np.random.default_rng(9)
    passages = [" ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(9)) for _ in range(14)]
    texts = [" ".join(passages[i] for i in rng.permutation(14)[: int(rng.integers(8, 14))]) for _ in range(120)]
    texts += [" ".join(passages[i] for i in range(14) if i != k) for k in range(14)] + [" ".join(passages)]
    own, comp = brute(texts, 4, 85, 100)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in ngram_join(frame, 4, 85, 100).collect()} == dict(enumerate(comp))


def test_many_near_copies_make_few_rows(spark, monkeypatch):
    """Near copies of one template that mostly link, and texts of one shared shingle: rows made grow with the classes, not with their square."""
    rng, n = np.random.default_rng(3), 6_000
    template = [f"w{i}" for i in range(160)]
    near = []
    for i in range(n):
        now = list(template)
        for k in rng.integers(4, 156, 1 + i % 2):  # two of the latter don't link, but both link with the former
            now[k] = f"x{i}"
        near.append(" ".join(now))
    hot = [f"one shared passage here {' '.join(f'y{i}n{k}' for k in range(9))}" for i in range(n)]
    made = {}
    for name in ("stars_of", "tiles_of", "product_pairs"):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name: made.setdefault(_n, _f(*a)))
    frame = spark.createDataFrame(list(enumerate(near + hot)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in ngram_join(frame, 4, 85, 100).collect()}
    assert all(got[n + i] == n + i for i in range(n))
    assert sum(got[i] == 0 for i in range(n)) > 0.99 * n
    stars, tiles, pairs = (made[k] for k in ("stars_of", "tiles_of", "product_pairs"))
    assert stars.count() < 1.2 * n * module.LEADS and max(r["count"] for r in stars.groupBy("x", "y").count().collect()) < 3 * module.STAR
    assert tiles.count() < n and pairs.count() < n


def test_near_misses_make_few_rows(spark, monkeypatch):
    """Near copies of one template of which no two link, though each pair shares first shingles: their pairs aren't written."""
    rng, n = np.random.default_rng(4), 900
    triples = list(combinations(range(5, 155, 5), 3))
    template = [f"w{i}" for i in range(160)]
    texts = []
    for i, own in enumerate(rng.choice(len(triples), n, replace=False)):
        now = list(template)
        for k in triples[own]:
            now[k] = f"x{i}n{k}"
        texts.append(" ".join(now))
    made, plain = [], module.cut

    def counted(df):
        out = plain(df)
        if out.columns[0] == "kind":
            made.append(out.filter("kind = 0").count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in ngram_join(frame, 4, 85, 100).collect()}
    own = [np.unique(shingle_set(t.encode(), 4)) for t in texts[:60]]
    assert all(100 * (x := len(np.intersect1d(u, v))) < 85 * (len(u) + len(v) - x) for u, v in combinations(own, 2))
    assert got == {i: i for i in range(n)}
    assert sum(made) < 20 * n


def test_the_rest_of_a_group_meets_all_of_it(spark):
    """Ten classes that no head linked meet every class of their group; without any there is no tile."""
    leaders = spark.createDataFrame([(7, i, 0) for i in range(1000)] + [(2000, 2000 + i, 0) for i in range(20)], "lead long, cid long, place int")
    known = spark.createDataFrame([(i, 0) for i in range(990)], "node long, component long")
    rows = module.rest_of(leaders, known).collect()
    tiles = {}
    for r in rows:
        tiles.setdefault((r.x, r.y), (set(), set()))[r.second].add(r.cid)
    assert {(a, b) for x, y in tiles.values() for a in x for b in y} == {(a, b) for a in range(1000) for b in range(990, 1000)}
    assert max(len(x) + len(y) for x, y in tiles.values()) < 3 * module.STAR and len(rows) < 1200
    assert module.rest_of(leaders, spark.createDataFrame([(i, 0) for i in range(1000)], known.schema)).count() == 0


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 3000, int(m)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for m in rng.integers(1, 2500, 40)]
    marks = module.marks_array([*(module.marks_of(s) for s in own), None])
    x, y = np.triu_indices(41, 1)
    for i, j, least in zip(x, y, module.unlike(marks, x, y), strict=True):
        assert least <= (len(np.setxor1d(own[i], own[j])) if j < 40 else 0)
    few = module.marks_array([module.marks_of(own[0]), module.marks_of(np.unique(np.r_[own[0], np.uint64(1), np.uint64(2)]))])
    assert module.unlike(few, np.array([0]), np.array([1])).tolist() == [2]


def test_bounds():
    for a in range(1, 40):
        for b in range(1, 40):
            assert all((100 * o >= 85 * (a + b - o)) == (o >= least_overlap(a, b, 85, 100)) for o in range(min(a, b) + 1))


def test_shingles():
    assert len(shingle_set(b"", 4)) == len(shingle_set(b" \n", 4)) == 0
    assert len(shingle_set(b"one two", 4)) == 1 and shingle_set(b"one two", 4) == shingle_set(b" ONE\ttwo ", 4)
    assert shingle_set(b"a b", 4) != shingle_set(b"b a", 4) and shingle_set("é".encode(), 4) != shingle_set("É".encode(), 4)
    assert len(shingle_set(b"a b c d a b c d", 4)) == 4


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + star + [(7, 7), (5000, 4999)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 5000: 4999, 4999: 4999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_without_an_id_are_read_once(spark, monkeypatch):
    """3,000 equal texts without an id and six near copies: a tile reads one text of each class."""
    base = [f"word{i}" for i in range(80)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(10, 70, 10)]
    frame = spark.createDataFrame([(None, " ".join(base))] * 3000 + [(i, t) for i, t in enumerate(near)], "doc_id long, text string").repartition(8)
    read = []
    plain = module.links

    def counted(texts, classes, wanted, *more):
        placed = wanted.join(classes.select("cid", "rep_row", "rep_hash"), "cid")
        met = texts.join(placed, (texts["text_hash"] == placed["rep_hash"]) & (texts["row"] == placed["rep_row"]))
        read.extend(r["count"] for r in met.groupBy("x", "y").count().collect())
        return plain(texts, classes, wanted, *more)

    monkeypatch.setattr(module, "links", counted)
    got = ngram_join(frame, 4, 85, 100).collect()
    assert len(got) == 3006 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert max(read) < 20


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from tidestep.llm import shingles

    text = (" ".join(f"Wörd{i % 37}" for i in range(500)) + "\t" + "x" * 300 + "\n\n end").encode()
    whole = shingles.word_hashes(text).tolist()
    for piece in (1, 5, 64, 1000):
        monkeypatch.setattr(shingles, "PIECE", piece)
        assert shingles.word_hashes(text).tolist() == whole


def test_texts_that_no_tile_asks_for_are_not_shuffled(spark):
    """300 long texts, of which four are near copies: all shuffles together hold less than the texts."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (600, 24))) for _ in range(296)]
    texts += [t + " and one more" for t in texts[:4]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    jvm = spark.sparkContext._jvm
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)))
    frame = module.filed(frame)
    before = max((s.stageId() for s in stages()), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large to be broadcast
    try:
        got = {r.doc_id: r.component_id for r in ngram_join(frame, 4, 85, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i % 296 for i in range(300)}
    assert 0 < sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > before) < sum(map(len, texts))
