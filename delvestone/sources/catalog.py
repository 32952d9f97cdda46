"""A store of named tables: definition, rows, statistics, search, transactions, backup.

A store is a folder with one numbered commit log; a commit names, for each
table, its schema, its folders and its statistics.  One commit may therefore
change several tables at once, a reader sees one state of them all, and of two
writers one gets :class:`~.tables.Conflict`.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Conflict, Log, conform

#: The standard tables of a knowledge base.
STANDARD = {
    "documents": "id string, title string, content string, file_path string, file_type string, metadata string, embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chunks": "id string, document_id string, content string, chunk_index int, metadata string, embedding array<float>, created_at timestamp_ntz",
    "search_history": "id string, kb_name string, query string, results_count int, response_time_ms int, created_at timestamp_ntz",
    "user_activities": "id string, activity_type string, payload string, duration double, success boolean, created_at timestamp_ntz",
    "system_metrics": "id string, name string, value double, unit string, tags string, created_at timestamp_ntz",
    "chat_sessions": "session_id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz, settings string, message_count int",
    "chat_messages": "id string, session_id string, role string, content string, timestamp timestamp_ntz, search_logs string, is_streaming boolean",
    "knowledge_clusters": (
        "id string, name string, description string, content string, scripts string, resources string, evidences string, patterns string, constraints string, "
        "confidence double, abstraction_level string, landmark_potential double, hotness double, lifecycle string, create_time timestamp_ntz, last_modified timestamp_ntz, "
        "version int, related_clusters string, search_results string, queries string, merge_count int, embedding_vector array<float>, embedding_model string, "
        "embedding_timestamp timestamp_ntz, embedding_text_hash string"
    ),
}


class Store:
    """Named tables under one folder; null rows, empty frames and missing columns are stored as such."""

    def __init__(self, spark: SparkSession, path: str, keep: float = 86_400.0):
        self.spark, self.path, self.keep, self.log = spark, path.rstrip("/"), keep, Log(spark, path)
        self._open: tuple[int | None, dict] | None = None

    def _state(self) -> tuple[int | None, dict]:
        if self._open is not None:
            return self._open
        last = self.log.last()
        return last, {} if last is None else self.log.read(last)["tables"]

    def _commit(self, last: int | None, tables: dict) -> None:
        if self._open is not None:
            self._open = last, tables
            return
        self.log.commit(0 if last is None else last + 1, {"tables": tables})
        self.clean()

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """Changes within the block become visible together at its end, or not at all if it raises."""
        if self._open is not None:
            raise RuntimeError("a transaction is open")
        last, tables = self._state()
        self._open = last, tables
        try:
            yield self
            changed = self._open[1]
        finally:
            self._open = None
        if changed != tables:
            self._commit(last, changed)

    # definition
    def create(self, name: str, schema: str | T.StructType, if_not_exists: bool = True) -> None:
        if not re.match(r"(?:[A-Za-z_][A-Za-z0-9_]*)\Z", name):
            raise ValueError(f"{name!r} is no name of a table")
        last, tables = self._state()
        if name in tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self._commit(last, tables | {name: {"schema": struct.jsonValue(), "folders": [], "stats": None}})

    def create_standard(self) -> None:
        with self.transaction():
            for name, schema in STANDARD.items():
                self.create(name, schema)

    def drop(self, name: str, if_exists: bool = True) -> None:
        last, tables = self._state()
        if name not in tables:
            if if_exists:
                return
            raise KeyError(name)
        self._commit(last, {n: t for n, t in tables.items() if n != name})

    def tables(self) -> list[str]:
        return sorted(self._state()[1])

    def exists(self, name: str) -> bool:
        return name in self._state()[1]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._state()[1][name]["schema"])

    def describe(self, name: str | None = None) -> DataFrame:
        """(table_name, column_name, data_type, position) of one table or all."""
        rows = [(n, f.name, f.dataType.simpleString(), i) for n in ([name] if name else self.tables()) for i, f in enumerate(self.schema(n).fields)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")

    def search(self, term: str) -> DataFrame:
        """(table_name, column_name): tables and columns with the term in their name, whatever its case; a table's own hit has a null column."""
        low = term.lower()
        rows = [(n, None) for n in self.tables() if low in n.lower()]
        rows += [(n, f.name) for n in self.tables() for f in self.schema(n).fields if low in f.name.lower()]
        return self.spark.createDataFrame(rows, "table_name string, column_name string")

    # rows
    def read(self, name: str) -> DataFrame:
        table = self._state()[1][name]
        schema = T.StructType.fromJson(table["schema"])
        if not table["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in table["folders"]])

    def insert(self, name: str, rows: DataFrame | dict | list | object, replace: bool = False) -> None:
        """Append a frame, a row, a list of rows or a pandas frame; missing columns are null, others are dropped."""
        last, tables = self._state()
        table = tables[name]
        schema = T.StructType.fromJson(table["schema"])
        if isinstance(rows, dict):
            rows = [rows]
        if isinstance(rows, list):
            rows = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
        elif not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(rows)
        folder = f"{name}/{uuid.uuid4().hex}"
        conform(rows, schema).write.parquet(f"{self.path}/{folder}")
        try:
            self._commit(last, tables | {name: table | {"folders": [folder] if replace else [*table["folders"], folder], "stats": None}})
        except Conflict:
            self.log.remove(folder)
            raise

    def delete(self, name: str, condition: str) -> None:
        """Delete the rows for which a condition holds; those for which it is null stay."""
        self.insert(name, self.read(name).where(~F.coalesce(F.expr(condition), F.lit(False))), replace=True)

    def update(self, name: str, values: dict[str, str], condition: str) -> None:
        """Set columns to expressions in the rows for which a condition holds."""
        hit = F.coalesce(F.expr(condition), F.lit(False))
        kind = {f.name: f.dataType for f in self.schema(name).fields}
        self.insert(name, self.read(name).withColumns({c: F.when(hit, F.expr(e)).otherwise(F.col(c)).cast(kind[c]) for c, e in values.items()}), replace=True)

    # upkeep
    def analyze(self, name: str) -> dict:
        """Rows, and of each atomic column its nulls, least and greatest value (as text), kept in the commit."""
        last, tables = self._state()
        plain = [f.name for f in self.schema(name).fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]
        parts = [F.count("*").alias("n")]
        for c in plain:
            parts += [F.count_if(F.col(c).isNull()).alias(f"{c}__n"), F.min(c).cast("string").alias(f"{c}__a"), F.max(c).cast("string").alias(f"{c}__b")]
        row = self.read(name).agg(*parts).first()
        stats = {"rows": row["n"], "columns": {c: {"nulls": row[f"{c}__n"], "min": row[f"{c}__a"], "max": row[f"{c}__b"]} for c in plain}}
        self._commit(last, tables | {name: tables[name] | {"stats": stats}})
        return stats

    def cluster(self, name: str, columns: list[str], files: int = 0) -> None:
        """In place of an index: rows sorted by range of the columns, so that scans skip files by their statistics."""
        rows = self.read(name)
        rows = rows.repartitionByRange(files, *columns) if files else rows.repartitionByRange(*columns)
        self.insert(name, rows.sortWithinPartitions(*columns), replace=True)

    def vacuum(self, name: str | None = None, files: int = 0) -> None:
        """Merge each table's folders into one."""
        for n in [name] if name else self.tables():
            if len(self._state()[1][n]["folders"]) > 1:
                rows = self.read(n)
                self.insert(n, rows.coalesce(files) if files else rows, replace=True)

    def clean(self) -> None:
        """Delete commits, and the folders that no later commit names, replaced more than ``keep`` seconds ago."""
        numbers = self.log.numbers()
        old = [n for n, new in zip(numbers, numbers[1:]) if time.time() - self.log.read(new)["at"] > self.keep]
        if not old:
            return
        own = lambda n: {f for t in self.log.read(n)["tables"].values() for f in t["folders"]}
        named = {f for n in numbers if n not in old for f in own(n)}
        for n in old:
            for folder in own(n) - named:
                self.log.remove(folder)
            self.log.remove(f"_log/{n:012d}")

    def version(self) -> int | None:
        return self._state()[0]

    def changed(self, since: int | None) -> bool:
        """Did any writer commit after the version that a reader holds?"""
        return self.log.last() != since

    # whole stores
    def backup(self, path: str) -> None:
        """Copy every table and its definition to a new store; one commit makes the copy whole."""
        other = Store(self.spark, path, self.keep)
        if other.log.last() is not None:
            raise ValueError(f"{path} holds a store already")
        _, tables = self._state()
        copied = {}
        for n, t in tables.items():
            folders = []
            if t["folders"]:
                folders = [f"{n}/{uuid.uuid4().hex}"]
                self.read(n).write.parquet(f"{other.path}/{folders[0]}")
            copied[n] = t | {"folders": folders}
        other.log.commit(0, {"tables": copied})

    def restore(self, path: str) -> None:
        """Take over every table of another store in one commit; tables of the same name are replaced."""
        _, theirs = Store(self.spark, path)._state()
        last, tables = self._state()
        new = {}
        for n, t in theirs.items():
            folders = []
            if t["folders"]:
                folders = [f"{n}/{uuid.uuid4().hex}"]
                source = self.spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(*[f"{path.rstrip('/')}/{f}" for f in t["folders"]])
                source.write.parquet(f"{self.path}/{folders[0]}")
            new[n] = t | {"folders": folders}
        self._commit(last, tables | new)

    def overview(self) -> DataFrame:
        """(table_name, n_columns, n_folders, n_rows); rows are null until a table is analysed."""
        rows = [(n, len(self.schema(n).fields), len(t["folders"]), (t["stats"] or {}).get("rows")) for n, t in sorted(self._state()[1].items())]
        return self.spark.createDataFrame(rows, "table_name string, n_columns int, n_folders int, n_rows bigint")


class Flusher:
    """Gathers changed rows and merges them into a keyed table after so many rows or seconds."""

    def __init__(self, table, order: str, rows: int = 100, seconds: float = 60.0, clock=time.monotonic):
        self.table, self.order, self.rows, self.seconds, self.clock = table, order, rows, seconds, clock
        self.waiting: list[DataFrame] = []
        self.size, self.since = 0, clock()

    def put(self, changes: DataFrame, n: int) -> bool:
        """Take in ``n`` changed rows; was there a flush?"""
        self.waiting.append(changes)
        self.size += n
        return self.flush() if self.size >= self.rows or self.clock() - self.since >= self.seconds else False

    def flush(self) -> bool:
        from ..operators.joins import upsert

        if not self.waiting:
            self.since = self.clock()
            return False
        changes, key = self.waiting[0], self.table.key
        for more in self.waiting[1:]:
            changes = changes.unionByName(more)
        changes = upsert(changes.limit(0), changes, key, self.order)
        self.table.merge(changes, lambda base, new: new if base is None else upsert(base, new, key, self.order))
        self.waiting, self.size, self.since = [], 0, self.clock()
        return True
