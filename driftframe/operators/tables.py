"""Sparse tables from a long table of signal updates (t, signal, value, seq, ...)."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from driftframe.errors import InvalidArgument, SchemaError

RESERVED = ("timestamp", "source_sequence")


def check_names(names: list[str], selected: list[str] | None = None) -> list[str]:
    """The names to make columns of, in schema order; reserved, repeated, missing or no names are errors."""
    chosen = names if selected is None else [n for n in names if n in set(selected)]
    if selected is not None:
        if not selected:
            raise SchemaError("no signal selected")
        if missing := sorted(set(selected) - set(names)):
            raise SchemaError(f"unknown signals: {', '.join(missing)}")
    if bad := [n for n in chosen if n in RESERVED]:
        raise SchemaError(f"reserved name: {bad[0]}")
    if repeated := [n for i, n in enumerate(chosen) if n in chosen[:i]]:
        raise SchemaError(f"repeated name: {repeated[0]}")
    return chosen


def last_by(value: Column | str, seq: str = "seq") -> Column:
    """The last value in source order, whatever order rows arrive in."""
    return F.max_by(value, seq)


def wide(updates: DataFrame, signals: list, by: tuple[str, ...] = ("timestamp",), key: str = "signal", value: str = "value", seq: str = "seq", names: dict | None = None, order: bool = True) -> DataFrame:
    """One row for each by, one column for each of signals: the last update in source order, null without one.

    Updates of other signals are filtered before grouping, so a row exists only where one of signals was updated.
    One shuffle on by; aggregation is partial before it.
    """
    kept = updates.where(F.col(key).isin(list(signals)))
    out = kept.groupBy(*by).pivot(key, list(signals)).agg(last_by(value, seq))
    for s in signals:
        if names and names[s] != str(s):
            out = out.withColumnRenamed(str(s), names[s])
    return out.orderBy(*by) if order else out


def sparse(updates: DataFrame, arms: dict[str, list], by: tuple[str, ...] = ("timestamp",), key: str = "signal", seq: str = "seq", sequence: str | None = None) -> DataFrame:
    """wide() over updates with one value column for each physical type: arms has the signals whose value is in each.

    One pass for any number of signals: the last update of each signal first, aggregated before the shuffle, then the row of them.
    sequence names a column for the largest seq of the row. Rows come in no order.
    """
    of = {s: arm for arm, signals in arms.items() for s in signals}
    if not of:
        raise SchemaError("no signal selected")
    kept = updates.where(F.col(key).isin(list(of)))
    last = kept.groupBy(*by, key).agg(F.max_by(F.struct(*arms), seq).alias("x"), F.max(seq).alias("s"))
    rows = last.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(key, "x"))).alias("m"), F.max("s").alias("s"))
    extra = [F.col("s").alias(sequence)] if sequence else []
    return rows.select(*by, *extra, *(F.try_element_at("m", F.lit(s))[arm].alias(str(s)) for s, arm in of.items()))


def narrow(updates: DataFrame, group: str, signals: list, group_col: str = "device", by: str = "timestamp", key: str = "signal", value: str = "value", seq: str = "seq", order: bool = True) -> DataFrame:
    """The table of one group, with source_sequence: the largest source offset that fed the row."""
    kept = updates.where((F.col(group_col) == group) & F.col(key).isin(list(signals)))
    # the pivot's aggregates, spelled out so that source_sequence comes from the same pass
    cols = [F.max_by(F.when(F.col(key) == s, F.col(value)), F.when(F.col(key) == s, F.col(seq))).alias(str(s)) for s in signals]
    out = kept.groupBy(by).agg(F.max(seq).alias("source_sequence"), *cols).select(by, "source_sequence", *map(str, signals))
    return out.orderBy(by) if order else out


def narrow_all(updates: DataFrame, groups: dict[str, list], **names) -> dict[str, DataFrame]:
    """A narrow table for each group, in lexicographic order of groups."""
    return {g: narrow(updates, g, groups[g], **names) for g in sorted(groups)}


def union_narrow(tables: list[DataFrame]) -> DataFrame:
    """All rows over the union of columns; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def forward_fill(table: DataFrame, columns: list[str], order: list[str], by: list[str]) -> DataFrame:
    """Each of columns carried on from the last row, in order within by, that has a value. What by keeps together is one task's work."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def collapse_equal(table: DataFrame, timestamp: str = "timestamp", sequence: str = "source_sequence", by: list[str] = ()) -> DataFrame:
    """Of rows with one timestamp (within by) that of the largest source sequence."""
    rest = [c for c in table.columns if c != timestamp and c not in by]
    return table.groupBy(*by, timestamp).agg(F.max_by(F.struct(*rest), sequence).alias("x")).select(*by, timestamp, "x.*")


def batches(table: DataFrame, rows: int, call) -> int:
    """call(Arrow table) with just rows rows each, in order, the last with fewer; an exception ends it. How many rows there were.

    The driver holds a batch and a partition of the table's rows at a time.
    """
    if rows < 1:
        raise InvalidArgument("rows per batch must be positive")
    schema, n = to_arrow_schema(table.schema), 0
    found = map(tuple, table.toLocalIterator())
    while held := list(islice(found, rows)):
        call(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema))
        n += len(held)
    return n
