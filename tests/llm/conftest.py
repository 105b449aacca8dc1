import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Writes tables, {name: (rows, schema)}, and gives their folder."""

    def put(**tables):
        folder = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return put


@pytest.fixture(scope="session")
def docs(write):
    """Writes a documents table of (doc_id, text) or (doc_id, text, lang) rows with extra columns of awkward names."""

    def put(rows, **more):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, 1, 1, 1.0, "x") for r in rows]
        return write(documents=(full, DOCS + ", fp bigint, piece int, score double, host string"), **more)

    return put
