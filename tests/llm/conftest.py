import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from echoframe.llm.textbytes import PIECE_BYTES  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Column names that operators use inside or return.
CLASH = ("score", "predicted", "row_", "token", "d1", "component_id", "_id", "held_out", "y", "group", "slot")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, blanks, ties, repeated rows, a very long text, clashing extra columns."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(PIECE_BYTES // 8))
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, "Ünï çödé <|endoftext|> 12 don't  stop"),
        (7, base + " thirteen"), (7, "other text of the same id with enough words"), (8, long), (9, long + " end"), (10, "\u0000\u0001 a\u2028b"), (11, "x" * 3000),
    ]
    table = [(i, t, None, "src0", 0 if t is None else len(t)) + tuple(str(k) for k in range(len(CLASH))) for i, t in rows]
    return spark.createDataFrame(table, DOCS + "".join(f", {c} string" for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
