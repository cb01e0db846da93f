"""A paged service that serves the rows of tables: what a remote store is to the pulls, with the tables as its contents.

It stands where an HTTP client would be injected. Each worker reads the columns it serves once and keeps them, so it is meant for
tests and small stores; the pulls (``paged``) hold nothing.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds

#: kind: table, columns served, order, filter
KINDS = {
    "traces": ("traces", ["delivery_id", "trace_id", "name"], "delivery_id", None),
    "observations": ("observations", ["obs_key", "traceid", "type"], "obs_key", None),
    "datasets": ("create_document", ["dataset_id"], "dataset_id", None),
    "documents": ("create_document", ["document_id", "dataset_id"], "document_id", None),
    "segments": ("chunk_catalog", ["chunk_row", "segment_id", "status"], "chunk_row", None),
    "completed": ("chunk_catalog", ["chunk_row", "segment_id", "status"], "chunk_row", ("status", "completed")),
}


@lru_cache(maxsize=8)
def _held(folder: str, kind: str) -> pa.Table:
    name, columns, order, keep = KINDS[kind]
    rows = ds.dataset(f"{folder}/{name}.parquet").to_table(columns=columns, filter=None if keep is None else ds.field(keep[0]) == keep[1])
    if kind == "datasets":
        rows = pa.table({"dataset_id": pc.unique(rows["dataset_id"].combine_chunks()).drop_null()})
    return rows.sort_by(order)


class TableService:
    """``client(kind, page, limit)``; a kind with a value behind a colon is filtered (``observations:<trace id>``)."""

    def __init__(self, folder: str, broken: tuple[int, ...] = ()):
        self.folder, self.broken = folder, broken

    def __call__(self, kind: str, page: int, limit: int) -> list[dict]:
        if page in self.broken:
            raise TimeoutError(f"page {page}")
        kind, _, value = kind.partition(":")
        rows = _held(self.folder, kind)
        if value:
            rows = rows.filter(pc.equal(rows["traceid"], value))
        return rows.slice((page - 1) * limit, limit).to_pylist()
