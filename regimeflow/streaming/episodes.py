"""Episodes of equal states over a stream of samples (an extension: the batch operators have no stream of their own).

The state of a run is its open episode. A sample of another state, or one that comes more than `max_gap` after the last,
closes it. Samples of a batch are put in order; one that is older than the open episode's last sample comes too late
and is dropped, as the watermark would. A run that rests for `timeout` of event time gives out its open episode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run_id int, state int, start_idx bigint, end_idx bigint, len bigint"
OPEN = "state int, start_idx bigint, end_idx bigint, len bigint"


def stream_episodes(samples: DataFrame, max_gap: int = 5, late: str = "10 minutes", timeout_ms: int = 600_000) -> DataFrame:
    """Closed episodes of a stream (run_id, t_idx, state, loaded_at); rows with a null among these are dropped."""

    def track(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            done = [(key[0], *group.get)]
            group.remove()
            yield pd.DataFrame(done, columns=names)
            return
        now = list(group.get) if group.exists else None
        rows = pd.concat(list(frames)).drop_duplicates("t_idx").sort_values("t_idx")
        done, newest = [], 0
        for t, state, at in zip(rows["t_idx"], rows["state"], rows["loaded_at"]):
            newest = max(newest, int(at.timestamp() * 1000))
            if now and t <= now[2]:
                continue
            if now and state == now[0] and t - now[2] <= max_gap:
                now[2], now[3] = int(t), now[3] + 1
            else:
                if now:
                    done.append((key[0], *now))
                now = [int(state), int(t), int(t), 1]
        if now:
            group.update(tuple(now))
            group.setTimeoutTimestamp(max(newest, group.getCurrentWatermarkMs()) + timeout_ms)
        if done:
            yield pd.DataFrame(done, columns=names)

    names = ["run_id", "state", "start_idx", "end_idx", "len"]
    clean = samples.select("run_id", "t_idx", "state", "loaded_at").dropna().withWatermark("loaded_at", late)
    return clean.groupBy("run_id").applyInPandasWithState(track, SCHEMA, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
