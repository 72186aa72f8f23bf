"""Order-dependent machines over a session, cut into chunks that are read in parallel.

A machine says in a chunk's summary what the chunk makes of any state it may be entered with. The
summaries of a session then pass on the state from chunk to chunk, one small step each, and every
chunk is read once more with the state that it is entered with. So a task holds one chunk, whatever
the size of a session.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.ticks import bucket_start

KEYS = ["session_id", "symbol"]
CHUNK = 1_000_000  # sequence numbers that one task holds
State = list[int | None]


class Machine(Protocol):
    start: State

    def summary(self, chunk: pa.Table) -> Any: ...

    def after(self, summary: Any, state: State) -> State: ...

    def rows(self, chunk: pa.Table, state: State) -> pa.Table:
        """What comes out, without the keys: a row for each row of the chunk."""


def edges(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> list[int]:
    """Where runs of equal keys begin, and the number of rows."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        column = batch[k] if isinstance(batch, pa.RecordBatch) else batch[k].combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0)))
        new[1:] |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
    return [*np.flatnonzero(new).tolist(), n]


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, each whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        at = edges(batch, keys)
        for a, b in zip(at[:-1], at[1:], strict=True):
            key = tuple(batch[k][a].as_py() for k in keys)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def keyed(key: tuple, keys: Sequence[str], rows: pa.Table, like: pa.Table) -> pa.Table:
    """rows with the key in front."""
    return pa.table([*(pa.array([v] * rows.num_rows, like.schema.field(k).type) for k, v in zip(keys, key[: len(keys)], strict=True)), *rows.columns], [*keys, *rows.column_names])


def scan(rows: DataFrame, machine: Machine, schema: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("seq",), chunk: int = CHUNK, back: bool = False) -> DataFrame:
    """keys and the machine's columns (schema) for each row, which is entered in order, or last first with back."""
    keys, each = list(keys), [*keys, "_chunk"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    ordered = [F.desc(c) if back else F.asc(c) for c in order]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in groups(batches, each):
            one = pa.table({"summary": pa.array([pickle.dumps(machine.summary(part))], pa.binary())})
            yield from keyed(key, each, one, part).to_batches()

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                key = tuple(batch[k][i].as_py() for k in keys)
                if key != last:
                    last, state = key, machine.start
                out.append(state)
                state = machine.after(pickle.loads(batch["summary"][i].as_py()), state)
            yield pa.record_batch([*(batch[c] for c in each), pa.array(out, pa.list_(pa.int64()))], [*each, "_state"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in groups(batches, each):
            yield from keyed(key, keys, machine.rows(part, part["_state"][0].as_py()), part).to_batches(max_chunksize=10_000)

    dealt = rows.withColumn("_chunk", bucket_start(F.col("seq"), chunk)).repartition(*each)
    made = dealt.sortWithinPartitions(*each, *ordered).mapInArrow(summaries, f"{head}, _chunk long, summary binary")
    entered = made.repartition(*keys).sortWithinPartitions(*keys, F.desc("_chunk") if back else F.asc("_chunk")).mapInArrow(states, f"{head}, _chunk long, _state array<long>")
    return dealt.join(entered, each).sortWithinPartitions(*each, *ordered).mapInArrow(results, f"{head}, {schema}")
