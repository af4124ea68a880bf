from __future__ import annotations

import duckdb
import pytest

# Names that operators use for results or inside; they must not get in the way.
CLASHING = [
    "row", "shard", "slot", "score", "copy", "order_key", "hits", "class_id", "keep", "bucket", "n",
    "text_hash", "features", "key", "block", "w", "base", "rid",
]
LONG = "several words of one very long text " * 8000


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns of clashing names."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", *["x"] * len(CLASHING)) for r in rows]
        schema = "doc_id long, text string, source string, lang string, "
        return spark.createDataFrame(full, schema + ", ".join(f"{c} string" for c in CLASHING))

    return build


@pytest.fixture(scope="session")
def messy(make_docs):
    """Nulls, empty and very long texts, ties, repeated rows, many alphabets."""
    return make_docs(
        (1, "One plain text of a few words. It has two sentences!\nAnd two lines."),
        (2, None), (3, ""), (4, "  \n\t "), (None, "a text without id"), (5, "repeated row"), (5, "repeated row"),
        (5, "same id, other text"), (6, LONG, None), (7, "Ünï çödé 漢字 🙂 ÀÉ \u0085 x", "t"),
        (8, LONG + "end", "t"), (None, None, None),
    )


@pytest.fixture(scope="session")
def documents(sf_dir):
    """The small table's documents as (doc_id, text)."""
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def docs_table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
