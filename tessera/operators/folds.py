"""Ordered folds over a key's rows, of any number.

Where no key has many rows, each key's rows reach one task in order and are folded as they stream by. A larger key is cut: rows are
dealt by ranges of key and order, so its rows fill as many tasks as they need. Each task sums up the runs of rows at its two
ends as a function from the state before them to the state behind them; the functions are applied one after the other, which gives
the state with which each task begins; then each task folds its rows from there. A task has two runs at its ends however
many rows there are, so little is ever gathered.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.graph import cut

#: Rows of one key that one task folds.
ROWS_OF_A_TASK = 1_000_000


class Fold(NamedTuple):
    """step(state, *fields) from start on.

    summary: of the fields' values in order, what ``follow`` needs to go from any state to the state behind them. added: how many
    of the state's first members only count up; summaries leave them out, and parts' counts are added in the end.
    """

    start: tuple
    step: Callable[..., tuple]
    summary: Callable[[list[list]], Any]
    follow: Callable[[Any, tuple], tuple]
    added: int = 0


def _runs(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[tuple[Any, int, list[list]]]:
    """(key, part, values of the fields) of each run of rows with one key."""
    at, part, held = None, 0, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[: 2 + fields]]
        edges = [0, *(k for k in range(1, len(batch)) if columns[0][k] != columns[0][k - 1]), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held is not None and columns[0][a] == at:
                for kept, new in zip(held, columns[2:], strict=True):
                    kept.extend(new[a:b])
                continue
            if held is not None:
                yield at, part, held
            at, part, held = columns[0][a], columns[1][a], [c[a:b] for c in columns[2:]]
    if held is not None:
        yield at, part, held


def _over(fold: Fold, state: tuple, values: list[list]) -> tuple:
    for row in zip(*values, strict=True):
        state = fold.step(state, *row)
    return state


def _streamed(fold: Fold, names: list[str], kinds: list[pa.DataType], fields: int):
    """A row for each key, whose rows follow each other in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done, seen = None, fold.start, [], False

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            values = [c.to_pylist() for c in batch.columns[: 2 + fields]]
            for k, _, *row in zip(*values, strict=True):
                if k != at or not seen:
                    if seen:
                        done.append((at, *state[: len(names) - 1]))
                    at, state, seen = k, fold.start, True
                state = fold.step(state, *row)
            if len(done) > 5_000:
                yield flush()
                done = []
        if seen:
            done.append((at, *state[: len(names) - 1]))
        if done:
            yield flush()

    return work


def _ends(fold: Fold, kind: pa.DataType, fields: int):
    """(part, place, key, summary) of the runs at both ends of a task's rows; those between belong to it alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for run in _runs(batches, fields):
            if last is None:
                rows.append((run[1], 0, run[0], pickle.dumps(fold.summary(run[2]))))
                last = ()
            else:
                last = run
        if last:
            rows.append((last[1], 1, last[0], pickle.dumps(fold.summary(last[2]))))
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), kind, pa.binary()), strict=True)], ["part", "place", "key", "summary"])

    return work


def _begun(fold: Fold, ends: list) -> dict[int, tuple]:
    """The state with which each part begins, where its first key goes on from the part before."""
    out, key, state = {}, None, None
    for row in sorted(ends, key=lambda r: (r.part, r.place)):
        if state is not None and row.key == key:
            out[row.part] = (*fold.start[: fold.added], *state[fold.added :])
        else:
            key, state = row.key, fold.start
        state = fold.follow(pickle.loads(bytes(row.summary)), state)
    return out


def _parts(fold: Fold, begun: dict[int, tuple], names: list[str], kinds: list[pa.DataType], fields: int):
    """A row (key, state, part) for each run of a task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, first = [], True
        for key, part, values in _runs(batches, fields):
            state = begun.get(part, fold.start) if first else fold.start
            done.append((key, *_over(fold, state, values)[: len(names) - 1], part))
            first = False
            if len(done) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [*kinds, pa.int32()], strict=True)], [*names, "fold_part"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [*kinds, pa.int32()], strict=True)], [*names, "fold_part"])

    return work


def folded(rows: DataFrame, key: str, order: list[str], fields: list[str], fold: Fold, out: str, rows_of_a_task: int = ROWS_OF_A_TASK) -> DataFrame:
    """(key and the state's first members as declared in out) after the fold over each key's rows in order; a null key has no row.

    order: columns that together are different for each row of a key.
    """
    names = [key, *(x.split(" ")[0] for x in out.split(", "))]
    schema = f"`{key}` {dict(rows.dtypes)[key]}, {out}"
    kinds = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema).fields]
    rows = rows.where(F.col(key).isNotNull())
    ordered = [F.col(c).alias(f"fold_order_{k}") for k, c in enumerate(order)]
    by = [f"fold_order_{k}" for k in range(len(order))]
    dealt = rows.select(F.col(key).alias("fold_key"), *[F.col(f).alias(f"fold_{k}") for k, f in enumerate(fields)], *ordered)
    values = [f"fold_{k}" for k in range(len(fields))]
    most = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= rows_of_a_task:
        dealt = dealt.repartition("fold_key").sortWithinPartitions("fold_key", *by)
        return dealt.select("fold_key", F.lit(0).alias("fold_part"), *values, *by).mapInArrow(_streamed(fold, names, kinds, len(fields)), schema)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_of_a_task))
    dealt = dealt.repartitionByRange(parts, "fold_key", *by).sortWithinPartitions("fold_key", *by)
    dealt = cut(dealt.select("fold_key", F.spark_partition_id().alias("fold_part"), *values))
    kind = dict(rows.dtypes)[key]
    ends = dealt.mapInArrow(_ends(fold, kinds[0], len(fields)), f"part int, place int, key {kind}, summary binary").collect()  # two rows a task
    each = dealt.mapInArrow(_parts(fold, _begun(fold, ends), names, kinds, len(fields)), f"{schema}, fold_part int")
    ended = [(F.sum(c) if k < fold.added else F.max_by(c, "fold_part")).cast(dict(each.dtypes)[c]).alias(c) for k, c in enumerate(names[1:])]
    return each.groupBy(key).agg(*ended)
