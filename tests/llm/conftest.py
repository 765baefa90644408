import pytest


@pytest.fixture
def table(spark, tmp_path):
    """A table written as Parquet and read again, as operators that number rows want a scan."""
    made = []

    def make(rows, schema):
        path = str(tmp_path / f"t{len(made)}")
        made.append(path)
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def documents(table):
    # Columns beyond the needed ones have names that operators use inside.
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, n long"

    def make(rows):
        full = [(*r, None, None, None, None)[:4] for r in rows]
        return table([(*r, 1, 2, 3, 4) for r in full], schema)

    return make
