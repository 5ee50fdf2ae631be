import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMAS = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())],
}
# Columns that queries make up themselves; a table may have them, too.
CLASHING = ["fp", "score", "key", "row", "ids", "_quality", "_whole", "_d", "_cut", "_leak", "word", "first", "bucket", "shard", "record", "runs", "collapsed", "pack", "turns", "before", "f1", "rep"]


@pytest.fixture()
def folder(tmp_path):
    """Writes tables: lists of rows in the order of their columns; texts alone are numbered from 0."""

    def write(clashing=False, **tables):
        for name, fields in SCHEMAS.items():
            rows = []
            for k, row in enumerate(tables.get(name, [])):
                row = (k, row) if row is None or isinstance(row, str) else row
                rows.append(tuple(row) + (None,) * (len(fields) - len(row)))
            columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(fields)}
            if clashing:
                columns |= {n: pa.array(["x"] * len(rows), pa.string()) for n in CLASHING}
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture()
def rows_of(spark):
    def run(name, folder):
        from tilewright.llm.queries import QUERIES

        return [r.asDict() for r in QUERIES[name](spark, folder).collect()]

    return run
