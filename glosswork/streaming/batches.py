"""Operators over streams: table operators on each micro-batch, and operators whose state outlives batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glosswork.operators.durable import ship


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Apply a table operator to every micro-batch and write the result under the batch's number.

    A batch that runs again after a failure overwrites its own folder, so each row is written once. With ``once``
    the query ends when what there is has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_of_key(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key, keys being forgotten once the watermark is past them by ``late``."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def last_of_key(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of the columns ``order``, whatever batch it came in; for the output modes update and complete.

    Of rows that tie the one that is greatest in its other columns stays, so the result doesn't depend on how the stream is cut.
    """
    rest = [c for c in stream.columns if c not in keys and c not in order]
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(*keys, "_last.*").select(*stream.columns)


def rolling_captions(stream: DataFrame, key: str = "doc_id", index: str = "cue", at: str = "at", late: str = "10 minutes") -> DataFrame:
    """``sequence.rolling`` over a stream of cues (key, index, at, words): (key, index, kind, emitted), for the output mode append.

    The state of a key is its last cue and the cues that wait. A cue waits until the watermark, ``late`` behind the latest time seen, has passed its
    time; those that are due are then read in the order of ``index``, which must not fall where ``at`` rises. So cues that
    come out of order, or in any cut into batches, give what a table of them gives. A cue that comes later than ``late`` is
    dropped, as the watermark drops it; null words count as none; a null key is a key.
    """
    ship(stream.sparkSession)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, index)}
    out = f"`{key}` {kinds[key]}, `{index}` {kinds[index]}, kind string, emitted string"

    def step(own: tuple, parts: Iterator, state: GroupState) -> Iterator:
        last, waiting = (json.loads(x) for x in state.get) if state.exists else ([], [])
        for part in parts:
            waiting += [[int(i), int(t.value // 1_000_000), [] if w is None else [str(x) for x in w]] for i, t, w in zip(part[index], part[at], part["words"], strict=True)]
        limit = state.getCurrentWatermarkMs()
        due = sorted((c for c in waiting if c[1] < limit), key=lambda c: c[0])
        waiting = [c for c in waiting if c[1] >= limit]
        rows = []
        for i, _, words in due:
            shared = max(k for k in range(min(len(last), len(words)) + 1) if k == 0 or last[-k:] == words[:k])
            left = words[shared:]
            kind = "empty" if not words else "duplicate" if words == last else "no_new" if not left else "overlap" if shared else "new"
            rows.append((own[0], i, kind, " ".join(left) if kind in ("overlap", "new") else None))
            last = words
        state.update((json.dumps(last), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(c[1] for c in waiting), limit) + 1)
        yield pd.DataFrame(rows, columns=[key, index, "kind", "emitted"])

    cues = stream.select(key, index, at, "words").withWatermark(at, late)
    return cues.groupBy(key).applyInPandasWithState(step, out, "last string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
