"""How many tasks rows are dealt to, so that what one task holds doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

TASK_ROWS = 1 << 17  # that a task groups or sorts: some 100 MB
LEAST_ROWS = 1 << 14  # below which a task is not worth its start


def tasks_for(table: DataFrame, each: int = 1) -> int:
    """Tasks for the rows of a written table, whose files know their number, with so many rows made of ``each``; not fewer than the
    session's, unless the table is small."""
    rows, usual = table.count() * each, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // TASK_ROWS), min(usual, -(-rows // LEAST_ROWS)))


def dealt(rows: DataFrame, tasks: int | None, *keys: str | Column) -> DataFrame:
    """rows dealt to so many tasks by keys before they are grouped by these, or as they are. Where keys hardly repeat, this spares the
    map of all keys that a task makes of its input first."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


def distinct(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Different rows, found in so many tasks, by some of their columns or all."""
    return dealt(rows, tasks, *(keys or rows.columns)).distinct()
