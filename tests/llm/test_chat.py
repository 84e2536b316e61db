from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.llm import chat
from tests.compare import connect, rows_of

TREE = "tree string, node long, parent long, score double, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\n\\n<|x|>"]), st.text(alphabet="<|\\>im_startend\n é", max_size=30)), max_size=6))
def test_template_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == chat.ASSISTANT]


def test_best_branches_and_loops(spark):
    rows = [
        ("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a"), ("t", 3, 1, 5.0, "assistant", "b"), ("t", 4, 3, None, "user", None),
        ("t", 5, 2, 4.0, "user", "tie"), ("u", 1, 9, 1.0, "user", "orphan is a root"), ("v", 1, 2, 1.0, "user", "loop"), ("v", 2, 1, 1.0, "user", "loop"), ("v", 3, 1, 1.0, "user", "tail"),
    ]
    df = spark.createDataFrame(rows, TREE)
    got = {(r.tree, r.branch): chat.parse_turns(r.formatted) for r in chat.format_conversations(df, 2).collect()}
    # both paths of t score 5: the smaller leaf comes first
    assert got[("t", 1)] == [("user", "q"), ("assistant", "b"), ("user", "")]
    assert got[("t", 2)] == [("user", "q"), ("assistant", "a"), ("user", "tie")]
    assert got[("u", 1)] == [("user", "orphan is a root")]
    assert not [k for k in got if k[0] == "v"]


def test_long_thread_and_empty(spark):
    rows = [("t", i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(300)]
    r = chat.format_conversations(spark.createDataFrame(rows, TREE)).collect()
    assert [t for _, t in chat.parse_turns(r[0].formatted)] == [str(i) for i in range(300)]
    assert chat.format_conversations(spark.createDataFrame([], TREE)).count() == 0


def test_query_matches_sql(spark, sf):
    df = chat.op1_chat(spark, sf)
    ref = connect(sf).execute(chat.OP1_SQL)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in ref.description], ref.fetchall())


def test_nulls_ties_and_repeats(spark):
    said = [(1, 1, "user", None), (1, 1, "user", None), (None, 0, None, "x"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.digest_conversations(chat.format_conversations(chat.turns_as_replies(df))).collect()}
    assert got["1"].n_turns == 3 and got["null"].n_turns == 1
    assert got["1"].turns_sha256 == hashlib.sha256(b"assistant\nfirst\nuser\n\nuser\n\n").hexdigest()


def test_repeated_messages_are_one(spark):
    rows = [("t", i, i - 1 if i else None, 1.0, "user", f"m{i}") for i in range(24)]
    df = spark.createDataFrame(rows * 2 + [("t", 5, 4, 0.5, "user", "zz")], TREE).selectExpr("*", "'x' AS anc", "1 AS up", "1 AS leaf")
    got = chat.format_conversations(df).collect()
    assert len(got) == 1 and [t for _, t in chat.parse_turns(got[0].formatted)] == [f"m{i}" for i in range(24)]
    assert chat.reply_paths(df).count() == 24
