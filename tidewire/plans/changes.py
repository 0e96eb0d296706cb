"""SQL of row-level changes to tables of a v2 catalog, and the views it reads from."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _same(key: Sequence[str]) -> str:
    return " AND ".join(f"t.{_name(k)} = s.{_name(k)}" for k in key)


def append_once_sql(target: str, source: str, columns: Sequence[str], key: Sequence[str]) -> str:
    """Add the rows whose key the table does not have; run again it adds nothing."""
    names, values = (", ".join(p + _name(c) for c in columns) for p in ("", "s."))
    return f"MERGE INTO {target} AS t USING {source} AS s ON {_same(key)} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


def upsert_sql(target: str, source: str, columns: Sequence[str], key: Sequence[str]) -> str:
    """Replace the rows of the same key, add the others."""
    sets = ", ".join(f"t.{_name(c)} = s.{_name(c)}" for c in columns if c not in key)
    names, values = (", ".join(p + _name(c) for c in columns) for p in ("", "s."))
    return (
        f"MERGE INTO {target} AS t USING {source} AS s ON {_same(key)} "
        f"WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
    )


def delete_sql(target: str, condition: str) -> str:
    return f"DELETE FROM {target} WHERE {condition}"


def update_sql(target: str, condition: str, values: dict[str, str]) -> str:
    sets = ", ".join(f"{_name(c)} = {v}" for c, v in values.items())
    return f"UPDATE {target} SET {sets} WHERE {condition}"


@contextmanager
def view_of(rows: DataFrame) -> Iterator[str]:
    """The name of a view of some rows, for one statement."""
    name = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        rows.sparkSession.catalog.dropTempView(name)
