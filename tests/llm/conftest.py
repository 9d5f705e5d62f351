"""Documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, drop string, copy string, bucket string, rank string"


def edge_rows() -> list[tuple[int | None, str | None]]:
    shared = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"x{i % 997}y{i % 13}" for i in range(20_000))
    return [
        (9000, None), (9001, ""), (9002, " \t\x0b "), (9003, "\n\n"), (9004, "a"), (9005, "one two"), (9006, "One TWO"), (9007, "one two"),
        (9008, f"start {shared} end"), (9009, f"other words {shared} tail of it"), (9010, shared), (9011, long), (9012, long), (9013, long + " more"),
        (9014, "ha " * 120), (9015, "<|endoftext|> x<|endoftext|>y"), (9016, "日本語テキスト " * 40), (9017, "a\x1cb\x85c　d  e\n f"), (9018, "z" * 5000), (9018, "z" * 5000),
        (9019, "same id " * 30), (9019, "other text " * 30), (None, "no id " * 60), (-5, f"negative id {shared}"), *[(9100 + i, f"Boiler Plate \n own line {i}\nboiler plate") for i in range(12)],
    ]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    real = duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1").fetchall()
    rows = [(*r, "r", "i", "d", "c", "b", "k") for r in real]
    rows += [(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 == 0 else "host", None, None, "i", None, "c", "b", "k") for i, t in edge_rows()]
    folder = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
