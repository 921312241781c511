"""Chat examples: their round trip, their masks, and the query against SQL."""

import hashlib
from collections import Counter, defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidestep.llm.chat_format import TURN, chat_examples, digests, digests_of, escape, escape_role, examples_of, unescape, unescape_role
from tidestep.llm.queries import OP10_SQL, queries

control = st.text(alphabet=st.sampled_from("<|\\im_endstart>\n aé🙂"), max_size=30)


@given(control)
@settings(max_examples=300, deadline=None)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", ""]), control), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_examples_give_the_conversation_back(turns):
    made = list(examples_of(iter([(1, *t) for t in turns])))
    replies = [t for r, t in turns if r == "assistant"]
    trained = [x for x in made if not x[6]]
    assert [unescape(x[3][x[4] : x[5]]) for x in trained] == replies
    assert len(made) == len(replies) + (turns[-1][0] != "assistant")
    for x in made:
        back = [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(x[3])]
        assert back == turns[: x[2]]
    assert made[-1][2] == len(turns)
    ((conv, n, sha, chars, loss, total),) = digests_of(iter([(x[0], x[3], x[4], x[5]) for x in made]))
    assert (conv, n, chars, total) == (1, len(turns), sum(map(len, replies)), sum(len(x[3]) for x in made))
    assert sha == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() and loss == hashlib.sha256("".join(replies).encode()).hexdigest()


def test_query_against_sql(spark, sf):
    got = queries()["op10_chat_format"](spark, sf).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = c.sql(OP10_SQL).df()[list(got.columns)]
    assert Counter(got.itertuples(index=False, name=None)) == Counter(want.itertuples(index=False, name=None))
    assert -1 in set(got.conv_id)


def test_rows_without_a_conversation_grow_linearly(spark):
    frame = spark.createDataFrame([(None, i, "user" if i % 2 else "assistant", "x" * 100) for i in range(400)], "conv_id long, turn long, role string, text string")
    made = chat_examples(frame).collect()
    assert len(made) == 400 and sum(len(r.formatted) for r in made) < 400 * 150
    got = digests(chat_examples(frame))
    assert got.count() == 400 and got.filter("n_turns = 1").count() == 400


def test_odd_rows(spark):
    values = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 5, "user", ""), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (3, 0, "assistant", "long " * 50_000)]
    frame = spark.createDataFrame([(*v, "clash") for v in values], "conv_id long, turn long, role string, text string, formatted string")
    got = digests(chat_examples(frame)).collect()
    turns = defaultdict(list)
    for k, (c, n, r, t) in enumerate(sorted(values, key=lambda v: (v[0] or 0, v[1] is not None, v[1] or 0, v[2] or ""))):
        turns[c, k if c is None else 0].append((r or "", t or ""))
    assert Counter((r.conv_id, r.turns_sha256) for r in got) == Counter((c, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest()) for (c, _), x in turns.items())
    assert Counter((r.conv_id, r.n_turns, r.loss_chars) for r in got) == Counter([(1, 3, 2), (2, 2, 0), (None, 1, 0), (None, 1, 1), (3, 1, 250_000)])
    assert chat_examples(frame.limit(0)).count() == 0
