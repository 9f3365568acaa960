"""The guidance fold over a stream of fixes, with one state a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanternway.operators.guidance import RESULT, Progress, Route, fold, followable, prepared
from lanternway.runtime import Scratch

STATE = "along double, arrival_since double, arrived boolean, last_ts double"


def guide_stream(fixes: DataFrame, routes: DataFrame) -> DataFrame:
    """RESULT for every admitted fix of a streaming DataFrame, emitted as it comes; see operators.guidance.

    routes is static: session_id, points. Fixes later than the watermark are dropped, and so is a fix
    older than one its session has already taken, as progress has moved on. A session's state leaves
    with an hour of event-time silence.
    """
    lines = followable(routes)
    live = fixes.withWatermark("ts", "20 seconds")
    ok = prepared(live.select("session_id", "fix_id", "lat", "lon", "accuracy", "ts", "processed_at"), "ts").join(lines, "session_id")
    columns = [c.split()[0] for c in RESULT.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        along, since, arrived, last = state.get if state.exists else (0.0, None, False, float("-inf"))
        kept = Progress(along, since, arrived)
        rows = pd.concat(list(batches)).sort_values(["ts_s", "fix_id"])
        rows = rows[rows["ts_s"] >= last]
        if len(rows):
            route = Route.of(rows.iloc[0])
            out = fold(int(key[0]), rows, route, kept)
            last = float(rows["ts_s"].iloc[-1])
            yield pd.DataFrame(out, columns=columns)
        state.update((kept.along, kept.arrival_since, kept.arrived, last))
        state.setTimeoutTimestamp(int(max(last * 1000, state.getCurrentWatermarkMs())) + 3_600_000)

    return ok.groupBy("session_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(fixes_path: str, schema, routes: DataFrame) -> DataFrame:
    """Guidance over all files of a folder as a stream, run until nothing is left; the written result."""
    spark = routes.sparkSession
    scratch = Scratch(spark, "guidance-stream")
    stream = spark.readStream.schema(schema).parquet(fixes_path)
    out, state = f"{scratch.root}/out", f"{scratch.root}/state"
    query = guide_stream(stream, routes).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RESULT).parquet(out)
