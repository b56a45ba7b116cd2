"""Saved tables of a run: Parquet inside, CSV for exchange, and the choice of the newest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rankloom.config import HORIZON_NAMES

#: The tables that a run may leave.
TABLES = (
    "returns", "momentum", "fundamentals", "fundamentals_partial", "final", "curves", "normalized_curves", "periods",
    "allocation", "performance", *(f"{h}_{t}" for h in ("fii", "dii") for t in ("partial", "marketcap_partial", "all", "top", "momentum", "final")),
)

#: Names that exports have, by internal name.
EXPORT_NAMES: dict[str, str] = {
    "ticker": "Ticker", "name": "Name", "symbol": "YFinance Ticker", "page_url": "Page URL", "cmp": "CMP Rs.", "data_points": "Data Points", "price_error": "Price Error",
    "score": "Momentum Score", "pass": "Momentum Pass", "market_cap": "Market Cap", "market_cap_cr": "Market Cap Cr", "quarterly_growth_pct": "Quarterly Revenue Growth %",
    "annual_growth_pct": "Annual Revenue Growth %", "promoter_change_pct": "Promoter Holding Change %", "fundamental_pass": "Fundamental Pass", "fundamental_notes": "Fundamental Notes",
    "rebalance_date": "Rebalance Date", "signal_date": "Signal Date", "exit_date": "Exit Date", "selected_tickers": "Selected Tickers", "selected_names": "Selected Names",
    "starting_capital": "Starting Capital", "ending_capital": "Ending Capital", "return_pct": "Return %", "rank": "Rank", "weight": "Weight", "amount": "Amount Allocated",
    "shares": "Approx Shares", "series": "Series", "start": "Start", "end": "End", "start_value": "Start Value", "end_value": "End Value", "max_drawdown_pct": "Max Drawdown %",
    **{f"ret_{h}": name for h, name in HORIZON_NAMES.items()},
}
HOLDER_NAMES = {
    "previous_period": "{} Previous Period", "latest_period": "{} Latest Period", "previous_holding_pct": "{} Previous Holding %",
    "latest_holding_pct": "{} Latest Holding %", "holding_change_pct": "{} Holding Change %", "scan_notes": "{} Scan Notes",
}


def for_export(rows: DataFrame, holder: str | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` under the names of exports; a holder's columns get its prefix."""
    known = dict(EXPORT_NAMES) | (dict(names) if names else {})
    if holder:
        known |= {k: v.format(holder.upper()) for k, v in HOLDER_NAMES.items()}
    return rows.toDF(*[known.get(c, c) for c in rows.columns])


class Store:
    """Tables under one folder, written once each or not at all.

    Data goes to a folder of its own, which no reader knows of. A table is what the last entry of its log names: the
    folders with their files, rows and metrics, the schema, and the run that wrote it. The entry comes last and by one
    rename, so that a run which stops at any point, a task that fails in mid-append among them, leaves the table as it
    was; what it wrote is cleared away by the next save. A batch that was appended once is not appended again. Writing
    replaces, also with no rows. One writer to a table at a time, as runs have it.

    Numbers of rows and other metrics (aggregates in SQL, by name) are observed while a table is written; asking for them
    reads no table.
    """

    def __init__(self, spark: SparkSession, folder: str, run: str | None = None):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), run or uuid.uuid4().hex
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def begin(self, run: str | None = None) -> Store:
        """The same tables for another run to write."""
        return Store(self.spark, self.folder, run)

    def _base(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(f"no such table: {name}")
        return f"{self.folder}/{name}"

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def entry(self, name: str) -> dict | None:
        """The last entry of the table's log."""
        log = f"{self._base(name)}/_log"
        found = [n for n in self._names(log) if n.endswith(".json")]
        if not found:
            return None
        stream = self._fs.open(self._path(f"{log}/{found[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, entry: dict, number: int) -> None:
        log = f"{self._base(name)}/_log"
        begun, done = self._path(f"{log}/begun-{uuid.uuid4().hex}"), self._path(f"{log}/{number:08d}.json")
        stream = self._fs.create(begun, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if self._fs.exists(done) or not self._fs.rename(begun, done):
            self._fs.delete(begun, False)
            raise FileExistsError(f"another writer was faster: {done}")

    def _write(self, name: str, rows: DataFrame, metrics: Mapping[str, str] | None, batch: str | None) -> dict:
        """Write a folder and tell what it holds."""
        folder, seen = f"data-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.expr(c).alias(n) for n, c in (metrics or {}).items()]).write.parquet(f"{self._base(name)}/{folder}")
        found = seen.get
        files = [[s.getPath().getName(), s.getLen()] for s in self._fs.listStatus(self._path(f"{self._base(name)}/{folder}")) if s.getPath().getName().startswith("part-")]
        return {"folder": folder, "files": files, "batch": batch, "rows": found.get("rows", 0), "metrics": {n: found.get(n) for n in metrics or {}}}

    def _put(self, name: str, rows: DataFrame, before: dict | None, old: dict | None, metrics: Mapping[str, str] | None, batch: str | None) -> DataFrame:
        part = self._write(name, rows, metrics, batch)
        known = StructType.fromJson(before["schema"]) if before else StructType([])
        fresh = [StructField(f.name, f.dataType) for f in rows.schema if f.name not in known.names]
        schema = StructType([*known, *fresh])
        number = (old["number"] if old else 0) + 1
        self._commit(name, {"number": number, "run": self.run, "at": time.time_ns(), "schema": schema.jsonValue(), "parts": [*(before["parts"] if before else []), part]}, number)
        return self.require(name)

    def save(self, name: str, rows: DataFrame, metrics: Mapping[str, str] | None = None) -> DataFrame:
        """Replace the table, and then clear away what it was. The rows may come from the table that they replace."""
        saved = self._put(name, rows, None, self.entry(name), metrics, None)
        kept = {p["folder"] for p in self.entry(name)["parts"]}
        for found in self._names(self._base(name)):
            if found.startswith("data-") and found not in kept:
                self._fs.delete(self._path(f"{self._base(name)}/{found}"), True)
        return saved

    def append(self, name: str, rows: DataFrame, metrics: Mapping[str, str] | None = None, batch: str | None = None) -> DataFrame:
        """Add rows. A named batch that the table has already is left out."""
        now = self.entry(name)
        if now and batch and batch in [p["batch"] for p in now["parts"]]:
            return self.require(name)
        return self._put(name, rows, now, now, metrics, batch)

    def exists(self, name: str) -> bool:
        return self.entry(name) is not None

    def run_of(self, name: str) -> str | None:
        """The run that wrote the table last."""
        found = self.entry(name)
        return found and found["run"]

    def rows(self, name: str) -> int:
        """How many rows the table has, as counted while it was written."""
        found = self.entry(name)
        return sum(p["rows"] for p in found["parts"]) if found else 0

    def metrics(self, name: str) -> list[dict]:
        """What was observed of each part of the table."""
        found = self.entry(name)
        return [p["metrics"] for p in found["parts"]] if found else []

    def load(self, name: str) -> DataFrame | None:
        """The table, or None where it was never written or has no rows."""
        return self.require(name) if self.rows(name) else None

    def load_or_empty(self, name: str, schema: str) -> DataFrame:
        """The table, or one of this schema without rows where it was never written."""
        return self.require(name) if self.exists(name) else self.spark.createDataFrame([], schema)

    def require(self, name: str) -> DataFrame:
        """The table; an error where it was never written or where files that its log names are gone."""
        found, base = self.entry(name), self._base(name)
        if found is None:
            raise FileNotFoundError(f"nothing saved as {name} in {self.folder}")
        for part in found["parts"]:
            there = set(self._names(f"{base}/{part['folder']}"))
            if lost := [f for f, _ in part["files"] if f not in there]:
                raise FileNotFoundError(f"{name} lacks {lost} in {part['folder']}")
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(*[f"{base}/{p['folder']}" for p in found["parts"]])

    def newest(self, names: Sequence[str]) -> str | None:
        """Which of the tables was written last."""
        found = [(e["at"], n) for n in names if (e := self.entry(n))]
        return max(found)[1] if found else None

    def csv_path(self, name: str) -> str:
        return f"{self.folder}/{name}.csv"

    def export_csv(self, name: str, rows: DataFrame, holder: str | None = None) -> str:
        """One CSV file with a header, for bounded results."""
        folder, target = f"{self.folder}/_{name}.csv", self.csv_path(name)
        for_export(rows, holder).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)
        part = next(s.getPath() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-"))
        self._fs.delete(self._path(target), False)
        self._fs.rename(part, self._path(target))
        self._fs.delete(self._path(folder), True)
        return target

    def load_csv(self, name: str, schema: str, holder: str | None = None) -> DataFrame:
        """An exported file under internal names, with the columns and types of ``schema``; columns that it lacks are
        null, and without the file there are no rows."""
        fields = StructType.fromDDL(schema)
        if not self._fs.exists(self._path(self.csv_path(name))):
            return self.spark.createDataFrame([], fields)
        raw = self.spark.read.option("header", True).csv(self.csv_path(name))
        known = {**EXPORT_NAMES, **({k: v.format(holder.upper()) for k, v in HOLDER_NAMES.items()} if holder else {})}
        found = {f.name: next((c for c in (known.get(f.name, f.name), f.name) if c in raw.columns), None) for f in fields}
        return raw.select(*[(F.col(f"`{found[f.name]}`").try_cast(f.dataType) if found[f.name] else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
