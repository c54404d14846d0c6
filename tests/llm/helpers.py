"""Tables for the tests of the training-data operators."""

import pyarrow as pa
import pyarrow.parquet as pq

DOCUMENTS = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
)


def write_documents(folder, texts, ids=None, langs=None, **extra):
    """A documents table; extra columns may clash with names that operators use."""
    n = len(texts)
    columns = [
        pa.array(ids if ids is not None else list(range(n)), pa.int64()),
        pa.array(texts, pa.string()),
        pa.array(langs or ["en"] * n, pa.string()),
        pa.array(["s"] * n, pa.string()),
        pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    ]
    out = pa.Table.from_arrays(columns, schema=DOCUMENTS)
    for name, values in extra.items():
        out = out.append_column(name, pa.array(values))
    pq.write_table(out, f"{folder}/documents.parquet")
    return str(folder)


CLASHING = {name: 7 for name in ("id", "fp", "a", "b", "shard", "slot", "size", "node", "component", "part", "piece", "group")}


def clashing(n):
    return {name: [value] * n for name, value in CLASHING.items()}
