"""The JSON document sink."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions.values import TEXT_TIMESTAMP, json_sanitize

# What a document row has besides the tables; an export leaves it out.
BOOKKEEPING = ("doc_key",)
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": TEXT_TIMESTAMP,
    "timestampNTZFormat": TEXT_TIMESTAMP,
}


def export_name(project_id: str, asset: str, epoch: int | None = None, extension: str = "json") -> str:
    """`<project>_<epoch>_<asset>.json`, lower case."""
    seconds = int(time.time()) if epoch is None else epoch
    return f"{project_id}_{seconds}_{asset}.{extension}".lower()


def to_json(docs: DataFrame, alias: str = "json") -> Column:
    """One document as JSON text: explicit nulls, timestamps as text. Sanitize the frame first."""
    fields = [c for c in docs.columns if c not in BOOKKEEPING]
    return F.to_json(F.struct(*fields), JSON_OPTIONS).alias(alias)


def _first_list(table: T.StructField) -> str | None:
    return next((f.name for f in table.dataType.fields if isinstance(f.dataType, T.ArrayType)), None)


def metrics(docs: DataFrame) -> dict[str, Column]:
    """What a write counts as it goes: documents, and for each table with lists the items in them.

    All lists of a table are equally long, so its first one tells; an empty or missing list has no items."""
    out = {"documents": F.count(F.lit(1))}
    for table in docs.schema.fields:
        if isinstance(table.dataType, T.StructType) and table.name not in BOOKKEEPING and (name := _first_list(table)):
            size = F.coalesce(F.size(F.col(f"`{table.name}`.`{name}`")), F.lit(0))
            out[table.name] = F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0))
    return out


def write_docs(
    docs: DataFrame, path: str, max_records: int = 100_000, bookkeeping: bool = False, mode: str = "errorifexists"
) -> dict[str, int]:
    """JSON Lines, one document per row, one file set per job; no task holds more than the rows it is writing.

    Returns how many documents were written and how many items each of their tables has. They are counted by the job that
    writes, in the rows that it writes; nothing is read a second time."""
    if not bookkeeping:
        docs = docs.drop(*BOOKKEEPING)
    counted = metrics(docs)
    seen = Observation()
    docs = docs.observe(seen, *(count.alias(name) for name, count in counted.items()))
    # Timestamps stay typed here: the sink has its own text format for them.
    json_sanitize(docs, timestamps=False).write.mode(mode).options(**JSON_OPTIONS, maxRecordsPerFile=str(max_records)).json(path)
    return dict(seen.get)


def export(docs: DataFrame, folder: str, project_id: str, asset: str, **options) -> dict:
    """Write an asset's documents under their export name; returns where they went, how many there are, the items of each table, and
    a line that says so."""
    path = f"{folder.rstrip('/')}/{export_name(project_id, asset)}"
    items = write_docs(docs, path, **options)
    written = items.pop("documents")
    return {"asset": asset, "out_file": path, "documents": written, "items": items, "message": f"json docs written: {written}"}
