import tempfile

import pytest

from nlsql_spark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nlsql-test-"))
    return session


CATALOG = (
    "database_name string, table_name string, table_pos int, column_name string, column_pos int, data_format string, "
    "default_value string, is_not_null boolean, is_primary_key boolean, is_foreign_key boolean"
)


@pytest.fixture(scope="session")
def make_catalog(spark):
    """A catalogue from {table: [column or (column, pk, fk)]}, formats 'text'."""

    def make(tables, database="db"):
        rows, place = [], 0
        for t, (table, columns) in enumerate(tables.items()):
            for column in columns:
                name, pk, fk = column if isinstance(column, tuple) else (column, False, False)
                rows.append((database, table, t, name, place, "text", None, False, pk, fk))
                place += 1
        return spark.createDataFrame(rows, CATALOG)

    return make


@pytest.fixture(scope="session")
def eval_col(spark):
    """Evaluate a column expression over one literal row."""

    def run(column, schema=None, row=None):
        df = spark.range(1) if schema is None else spark.createDataFrame([row], schema)
        return df.select(column.alias("x")).first()["x"]

    return run
