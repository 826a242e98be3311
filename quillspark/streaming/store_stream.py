"""The document store over a stream of operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id string, live boolean, dead boolean, version long, payload string, seq long"
_STATE = "live boolean, dead boolean, version long, payload string"


def _apply(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    live, dead, version, payload = state.get if state.exists else (False, False, 0, None)
    rows = pd.concat(list(parts)).sort_values("seq")  # a micro-batch is in no order
    for r in rows.itertuples():
        newer = not (live or dead) or r.version > version
        if r.op == "evict":
            if live and version <= r.version:
                live, dead, version, payload = False, False, 0, None
        elif r.op == "delete":
            if newer:
                live, dead, version, payload = False, True, int(r.version), None
        elif newer and (r.op == "put" or not live):
            live, dead, version, payload = True, False, int(r.version), r.payload
    state.update((live, dead, version, payload))
    yield pd.DataFrame([[key[0], live, dead, version, payload, int(rows["seq"].max())]], columns=["id", "live", "dead", "version", "payload", "seq"])


def fold_stream(ops: DataFrame) -> DataFrame:
    """Each changed id's state after a micro-batch (update mode). Tombstones are kept for good, so there is no timeout."""
    return ops.groupBy("id").applyInPandasWithState(_apply, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_table(ops: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs all that is available and returns each id's last state.

    A batch writes a folder named by its number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    ops_out = (
        fold_stream(ops)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    ops_out.awaitTermination()
    rows = ops.sparkSession.read.schema(f"{OUT}, batch long").parquet(path)
    last = rows.groupBy("id").agg(F.max(F.struct("batch", "live", "dead", "version", "payload")).alias("s"))
    return last.select("id", "s.live", "s.dead", "s.version", "s.payload")
