"""Circuit breakers with a timed reset over a log of calls, each key with its own.

``threshold`` failures in a row open a breaker. While it is open, a call that asks is refused and
changes nothing; the first that asks ``reset`` or later closes it, and counts anew. A call that does not ask
(it was under way already) is recorded in any case: its success closes the breaker, its failure opens it again,
from then on. A key's calls are taken by time, then by id.

A key may have any share of the rows, so its calls are cut into chunks of time, folded in three steps.
First each chunk, by itself, says what it leaves behind for every state that it may be entered in: a
count of failures, or open until a time. Of the latter only times up to ``reset`` after the chunk's first
call differ, and neighbouring ones that end alike are one entry. Then these tables, a row a chunk, are folded in order of time
for each key, which gives the state that each chunk is entered in. Last, the chunks are gone through from there.

Defined cases: calls without a time are left out; a null key is a key; a null ``failed`` is a success and a null
``asks`` asks; repeated calls are separate calls;
a null id stays null and comes first at its time; an empty log gives no row; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A state is a count of failures below the threshold, or this and the time of the opening (microseconds).
OPEN = 1 << 62
_LEAST_OPEN = 1 << 61
_STAYS = -1


def record(state: int, at: int, asks: bool, failed: bool, threshold: int, reset: int) -> tuple[int, bool, bool]:
    """The state after a call, whether the call was refused, and whether it opened the breaker."""
    count = state
    if state > _LEAST_OPEN:
        if asks and at - (state - OPEN) < reset:
            return state, True, False
        count = 0 if asks else threshold
    if not failed:
        return 0, False, False
    return (OPEN + at, False, True) if count + 1 >= threshold else (count + 1, False, False)


def passages(at: np.ndarray, asks: np.ndarray, failed: np.ndarray, threshold: int, reset: int) -> tuple[list[int], list[int], list[int]]:
    """What calls in order leave behind: for each count on entry; and for a breaker that is open on
    entry, by the time that it may be asked again: the last such time of each entry but the last, and the state left."""
    n = len(at)
    places = np.arange(n)
    next_of = lambda flag: np.append(np.minimum.accumulate(np.where(flag, places, n)[::-1])[::-1], n)
    asking, other = next_of(asks), next_of(~asks)
    ready = np.searchsorted(at, at + reset, "left")
    counted = [list(range(threshold))] * (n + 1)
    opened = [0] * (n + 1)

    def entered_open(place: int, may_ask: int) -> int:
        first, beside = asking[max(place, may_ask)], other[place]
        if first == beside == n:
            return _STAYS
        if first < beside:
            return counted[first][0]
        return opened[beside] if failed[beside] else counted[beside + 1][0]

    for i in range(n - 1, -1, -1):
        if failed[i]:
            left = entered_open(i + 1, int(ready[i]))
            opened[i] = OPEN + int(at[i]) if left == _STAYS else left
            counted[i] = counted[i + 1][1:] + [opened[i]]
        else:
            counted[i] = [counted[i + 1][0]] * threshold
    edges: list[int] = []
    left: list[int] = []
    for p in range(int(ready[0]) + 1 if n else 1):
        out = entered_open(0, p)
        if left and out == left[-1]:
            edges[-1:] = [int(at[p])] if p < n else []
            continue
        left.append(out)
        edges += [int(at[p])] if p < n else []
    return counted[0], edges[: len(left) - 1], left


def passed(state: int, counted: list[int], edges: list[int], left: list[int], reset: int) -> int:
    """The state after a chunk by its table."""
    if state <= _LEAST_OPEN:
        return int(counted[state])
    out = int(left[int(np.searchsorted(edges, state - OPEN + reset, "left"))])
    return state if out == _STAYS else out


def _stretches(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal values of ``by``, whole also where they go over several batches."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        codes = [np.asarray(pc.fill_null(batch.column(c).dictionary_encode().indices, -1)) for c in by]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), rows.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = rows.slice(start, end - start)
            if held and any(held[0].column(c)[0].as_py() != part.column(c)[0].as_py() for c in by):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _batch(rows: pa.Table, **columns: pa.Array) -> pa.RecordBatch:
    """Columns of ``rows`` and further ones as one batch."""
    own = {c: rows.column(c).combine_chunks() for c in rows.column_names} | columns
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.values()], names=list(own))


def outcomes(calls: DataFrame, key: str, call_id: str, at: Column, failed: Column, asks: Column | None = None, threshold: int = 3, reset: float = 30.0, chunk: float = 86_400.0) -> DataFrame:
    """key, call_id, refused, opens and failures in a row (``threshold`` while open) after each call. ``reset`` and ``chunk`` are seconds."""
    span, width = round(reset * 1e6), round(chunk * 1e6)
    micros = F.unix_micros(at.cast("timestamp"))
    rows = calls.select(
        F.col(key).alias("key"),
        F.col(call_id).alias("id"),
        micros.alias("at"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
        F.coalesce(asks if asks is not None else F.lit(True), F.lit(True)).alias("asks"),
        F.floor(micros / width).alias("chunk"),
    ).where("at IS NOT NULL")
    kind, id_kind = rows.schema["key"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    flat = ["key", "chunk", "at", "id", "failed", "asks"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _stretches(batches, ["key", "chunk"]):
            counted, edges, left = passages(*(own.column(c).to_numpy() for c in ("at", "asks", "failed")), threshold, span)
            yield _batch(own.slice(0, 1).select(["key", "chunk"]), counted=pa.array([counted]), edges=pa.array([edges], pa.list_(pa.int64())), left=pa.array([left]))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), 0
        for batch in batches:
            entered = []
            for row in batch.to_pylist():
                key, state = row["key"], state if row["key"] == key else 0
                entered.append(state)
                state = passed(state, row["counted"], row["edges"], row["left"], span)
            yield _batch(pa.Table.from_batches([batch]).select(["key", "chunk"]), state=pa.array(entered, pa.int64()))

    def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _stretches(batches, ["key", "chunk"]):
            state, found = own.column("state")[0].as_py(), []
            own = own.slice(1)
            for t, a, f in zip(*(own.column(c).to_pylist() for c in ("at", "asks", "failed")), strict=True):
                state, refused, opens = record(state, t, a, f, threshold, span)
                found.append((refused, opens, threshold if state > _LEAST_OPEN else state))
            refused, opens, failures = zip(*found, strict=True)
            yield _batch(own.select(["key", "id"]), refused=pa.array(refused), opens=pa.array(opens), failures=pa.array(failures, pa.int64()))

    dealt = rows.select(*flat).repartition("key", "chunk").sortWithinPartitions(*flat[:4])
    tables = dealt.mapInArrow(summed, f"key {kind}, chunk long, counted array<long>, edges array<long>, left array<long>")
    entries = tables.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(chained, f"key {kind}, chunk long, state long")
    # A chunk's entry is a row of it, before its calls: no join, so no rows are dealt otherwise than by key and chunk.
    both = rows.unionByName(entries, allowMissingColumns=True).repartition("key", "chunk")
    own = both.sortWithinPartitions("key", "chunk", F.col("state").isNull(), "at", "id").mapInArrow(gone_through, f"key {kind}, id {id_kind}, refused boolean, opens boolean, failures long")
    return own.select(F.col("key").alias(key), F.col("id").alias(call_id), "refused", "opens", "failures")
