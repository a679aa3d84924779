"""The index as keyed state of a stream: a file's record, symbols and imports change in one step.

Each path is a key of a ``transformWithState`` operator. Its record, its symbols and
its imports are state variables in RocksDB, of which Spark writes the changes alone, so a batch
costs what its files cost, whatever the index holds. An event whose time is known changes nothing,
one with the same hash only the time, another one replaces all; an event of a file that is gone
clears its key. The index is read back from the state store as three tables.

The layout of the state has a number, kept in the folder's name beside the records: a folder of another layout is refused, or
deleted and built anew by replaying the source, which therefore must be able to (files or tables can)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from corpusmill.sources.shared import delete, folders

#: Layout of the state that this module writes.
LAYOUT = 2
FILE = "layout int, size long, mtime double, hash string"
SYMBOL = "kind string, name string, signature string, line long"
IMPORT = "target string, reexport boolean"
EVENTS = f"path string, ord long, gone boolean, size long, mtime double, hash string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ',')}>>"
CHANGES = "path string, ord long, action string, symbols int, imports int"
_PREFIX = "layout-"


class Indexer(StatefulProcessor):
    """Applies the events of a path in their order; a row for each tells what it did."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", FILE)
        self.symbols = handle.getListState("symbols", SYMBOL)
        self.imports = handle.getListState("imports", IMPORT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.file.get() if self.file.exists() else None
        for e in sorted(rows, key=lambda r: r.ord):
            if e.gone:
                action = "delete" if known else "unchanged"
                for one in (self.file, self.symbols, self.imports):
                    one.clear()
                known = None
            elif known and known[2] == e.mtime:
                action = "unchanged"
            elif known and e.hash and known[3] == e.hash:
                action, known = "touch", (LAYOUT, known[1], e.mtime, known[3])
                self.file.update(known)
            else:
                action, known = "upsert", (LAYOUT, e.size, e.mtime, e.hash)
                self.file.update(known)
                self._replace(self.symbols, e.symbols, SYMBOL)
                self._replace(self.imports, e.imports, IMPORT)
            counts = (len(e.symbols or ()), len(e.imports or ())) if action == "upsert" else (0, 0)
            yield Row(path=key[0], ord=e.ord, action=action, symbols=counts[0], imports=counts[1])

    @staticmethod
    def _replace(held, rows, schema: str) -> None:
        if rows:
            names = [c.split()[0] for c in schema.split(", ")]
            held.put([tuple(r[c] for c in names) for r in rows])
        else:
            held.clear()


def opened(spark: SparkSession, folder: str, layout: int = LAYOUT, rebuild: bool = True) -> tuple[str, int | None]:
    """The checkpoint folder of an index of this layout below ``folder``, and the layout that
    was there before (null if none). One of another layout is deleted, or refused without ``rebuild``."""
    there = [int(name.removeprefix(_PREFIX)) for name in folders(spark, folder) if name.startswith(_PREFIX)]
    before = max(there, default=None)
    if before is not None and before != layout:
        if not rebuild:
            raise ValueError(f"index has layout {before}, not {layout}")
        for one in there:
            delete(spark, f"{folder}/{_PREFIX}{one}")
    return f"{folder}/{_PREFIX}{layout}", before


def follow(events: DataFrame, checkpoint: str, changes: str | None = None) -> StreamingQuery:
    """Takes all events (EVENTS) that there are into the index at ``checkpoint``; what each
    did (CHANGES) is appended to Parquet at ``changes``, if given."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    done = events.groupBy("path").transformWithState(Indexer(), CHANGES, "Append", "None")
    out = done.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.format("parquet").option("path", changes).start() if changes else out.format("noop").start()


def _variable(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def indexed(spark: SparkSession, checkpoint: str) -> dict[str, DataFrame]:
    """The tables of the index: files (path, layout, size, mtime, hash), symbols and imports with their paths."""
    files = _variable(spark, checkpoint, "file").select(F.col("key.path").alias("path"), "value.*")
    lists = {name: _variable(spark, checkpoint, name).select(F.col("key.path").alias("path"), "list_element.*") for name in ("symbols", "imports")}
    return {"files": files, **lists}


def status(files: DataFrame, layout: int = LAYOUT) -> DataFrame:
    """One row: files, bytes, latest time, and whether every record has the layout."""
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.max("mtime").alias("latest"),
        F.coalesce(F.every(F.col("layout") == layout), F.lit(True)).alias("current"),
    )


def as_events(files: DataFrame, symbols: Column, imports: Column) -> DataFrame:
    """Events (EVENTS) of files (path, ord, gone, size, mtime, hash and what the two arrays are made of)."""
    row = files.select("path", "ord", "gone", "size", "mtime", "hash", symbols.alias("symbols"), imports.alias("imports"))
    return row.to(row.sparkSession.createDataFrame([], EVENTS).schema)
