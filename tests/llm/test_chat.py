import hashlib

import pytest

from slatework.llm import chat
from slatework.llm.queries import op6_prefix_targets

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"
ODD = "\\### Assistant: </turn> ok"
CONVERSATIONS = {
    1: [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")],
    2: [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a\n### user: x </turn>\n"), (3, "assistant", "again")],
    3: [(0, "user", "alone")],
    4: [(5, "assistant", None), (7, "user", "")],
    5: [(0, "a:b", ODD), (1, "assistant", ODD), (2, "assistant", "\\h\\t\\b\\c \\\\ ### </turn></turn>####")],
    6: [(0, None, "no role"), (0, "user", "tie"), (1, "assistant", "é👍")],
}


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(c, t, r, x, "clash", 1) for c, turns in CONVERSATIONS.items() for t, r, x in reversed(turns)]
    return chat.prefix_targets(spark.createDataFrame(rows, SCHEMA)).cache()


def turns_of(c):
    return [(r or "", x or "") for _, r, x in sorted(CONVERSATIONS[c], key=lambda t: (t[0], t[1] or "", t[2] or ""))]


def test_one_example_for_each_reply(examples):
    for c in CONVERSATIONS:
        turns = turns_of(c)
        got = sorted((r for r in examples.collect() if r["conv_id"] == c), key=lambda r: r["example"])
        want = [i for i, (role, _) in enumerate(turns) if role == "assistant" or i == len(turns) - 1]
        assert [r["n_context"] for r in got] == want
        for r, i in zip(got, want):
            masked = r["formatted"][r["loss_start"] : r["loss_end"]]
            plain = masked.replace("\\h", "###").replace("\\t", "</turn>").replace("\\c", ":").replace("\\b", "\\")
            assert plain == (turns[i][1] if turns[i][0] == "assistant" else "")
            assert r["formatted"].count("</turn>\n") == i + 1


def test_digest_reads_everything_back(examples):
    for r in chat.digest(examples).collect():
        turns = turns_of(r["conv_id"])
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_empty(spark):
    assert chat.digest(chat.prefix_targets(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = op6_prefix_targets(spark, sf)
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(con.sql(f"SELECT {', '.join(sorted(df.columns))} FROM ({chat.ORACLE_SQL})").fetchall())
