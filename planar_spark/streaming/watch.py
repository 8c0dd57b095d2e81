"""Keeping a topology current: a stream over the edit log, a micro-batch at a time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dml
from ..plans.solve import TopoSession
from ..store import Conflict, written

EDIT = "seq long, table string, op string, id int, geometry binary, type string, map_layer int"
TABLES = ("linework", "polygon")


def apply_edits(session: TopoSession, edits: DataFrame, stream: str | None = None, batch: int | None = None, tries: int = 5) -> int:
    """Of several edits of one row the last by ``seq`` counts; then what they touch is solved once for the whole batch.

    Edits and all that follows from them are one commit, which also says that this batch of this stream is applied: a batch that comes again is
    skipped, and one that failed on its way has left nothing. If another writer was first, the batch is worked out anew on its version.
    """
    if stream is not None and session.store.applied(stream) >= batch:
        return session.store.latest()
    last = written(dml.last_wins(edits, ["table", "id"], ["seq"]), "edits")
    for left in reversed(range(tries)):
        changed = {}
        for name in TABLES:
            mine = last.where(F.col("table") == name)
            if mine.isEmpty():
                continue
            old = session.store.read(name)
            new = mine.where("op <> 'DELETE'").select("id", "geometry", "type", "map_layer")
            changed[name] = dml.delete_keys(old, mine, ["id"]).unionByName(new, allowMissingColumns=True)
        try:
            return session.update(changed, None if stream is None else {stream: batch})
        except Conflict:
            if not left:
                raise
    raise AssertionError


def stream_id(session: TopoSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: another checkpoint is another stream, whose batches count from 0 again."""
    return json.loads(session.store.text(f"{checkpoint.rstrip('/')}/metadata"))["id"]


def watch(session: TopoSession, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Read edits (Parquet, ``EDIT``) as they come. A burst is one micro-batch, hence one solve of what it touches, applied exactly once."""
    edits = session.spark.readStream.schema(EDIT).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            apply_edits(session, rows, stream_id(session, checkpoint), number)

    writer = edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
