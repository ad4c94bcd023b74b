"""Small inputs with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
import re

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, ids string, "
          "n_words bigint, kept string, block int")
LONG = "wort für wört " * 20000


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


TEXTS = [None, "", " ", "\n\n", "one", "a b c a b c a b c", "x\ny\nx\n\ny\nx", "Don't  stop #now $5\t<|endoftext|>\x1cq\x85",
         "日本語 テスト é ́ 😀 " * 9, "the of and to " * 40, LONG, "same text here", "same text here", "|".join(["cell"] * 300)]


def edge_rows():
    rows = []
    for k, t in enumerate(TEXTS):
        rows.append((k, t, [None, "en", "de", "xx"][k % 4], [None, "a", "ä", "b", ""][k % 5], None, 7, "clash", 3, "no", 1))
    rows.append(rows[5])             # a repeated row
    return rows


def edge_docs(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
