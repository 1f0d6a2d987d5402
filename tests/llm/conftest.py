import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents((id, text), ...) with the table's columns, and columns whose names operators use themselves."""

    def make(*rows, extra=False):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("gone", "blob", "spans", "uid", "component", "shard", "slot", "id", "bucket", "node", "score", "kept"):
                frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make
