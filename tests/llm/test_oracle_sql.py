import duckdb
import pytest

from leakscan.llm import chat, queries

SF = "/root/testdata/sf0.001"


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracles()[name])
    cols = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    found = got.collect()
    assert found and rows(got.columns, found) == rows(cols, want.fetchall())


def test_sql_counts_escapes(spark):
    """Control strings, backslashes, nulls and repeated rows, by both."""
    data = [(1, 0, "user", "a\\b <|end|> </s>[INST]"), (1, 0, "user", "a\\b <|end|> </s>[INST]"), (1, 1, "assistant", "<<SYS>> \\\\ <|turn|>"),
            (1, None, None, None), (2, 3, "assistant", "é 😀 <s"), (2, 3, "assistant", None), (None, 1, "<s>", "x")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    want = con.execute(queries.oracles()["op7_chat_format"])
    cols = [d[0] for d in want.description]
    got = chat.digests(chat.format_conversations(df))
    assert rows(got.columns, got.collect()) == [r for r in rows(cols, want.fetchall()) if -1 not in r]
