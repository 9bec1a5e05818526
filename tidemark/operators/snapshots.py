"""Append-only snapshot history: tables partitioned by kind, as_of and revision, and a manifest table."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contract import ID, TARGET, TIME, validate_panel
from ..functions.errors import DataContractError, EngineError

NEEDS = {"panel": (ID, TIME, TARGET), "forecast": (ID, TIME, "yhat"), "deals": ("opp_id", "amount", "stage")}
MANIFEST = "kind string, as_of string, revision int, rows long, label string, created_at string, columns array<string>, token string"


class SnapshotStore:
    """Every write is a new revision; nothing is overwritten. A revision is a row of the manifest, a file of its own that appears by one
    rename once the data is complete: a writer that dies before leaves only data that no row names, and of two writers of one
    revision the later takes the next number."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, kind: str, as_of: str, revision: int, token: str) -> str:
        return f"{self.root}/data/kind={kind}/as_of={as_of}/revision={revision}/token={token}"

    @staticmethod
    def _day(as_of) -> str:
        try:
            return (as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))).date().isoformat()
        except ValueError as e:
            raise ValueError(f"as_of must be a date, not {as_of!r}") from e

    def manifest(self) -> DataFrame:
        path = f"{self.root}/manifest"
        at, fs = self._path(path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], MANIFEST)
        try:
            out = self.spark.read.schema(MANIFEST).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
            out.count()  # one small row a snapshot
        except Exception as e:  # noqa: BLE001  whatever the storage raises
            raise EngineError(f"the manifest at {path} cannot be read: {str(e)[:200]}") from e
        return out.orderBy("kind", "as_of", "revision")

    def _claim(self, entry: dict) -> bool:
        """Puts the entry into the manifest in one step; false where its revision is taken."""
        name = f"{entry['kind']}-{entry['as_of']}-{entry['revision']}"
        (target, fs), (draft, _) = self._path(f"{self.root}/manifest/{name}.json"), self._path(f"{self.root}/manifest/.{name}-{entry['token']}.draft")
        if fs.exists(target):
            return False
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.exists(target) and fs.rename(draft, target):
            return True
        fs.delete(draft, False)
        return False

    def snapshot(self, frame: DataFrame, as_of, kind: str = "panel", label: str | None = None, created_at=None) -> str:
        if kind not in NEEDS:
            raise ValueError(f"kinds are {sorted(NEEDS)}")
        if missing := [c for c in NEEDS[kind] if c not in frame.columns]:
            raise DataContractError(f"a {kind} snapshot needs column(s) {missing}")
        if kind == "panel":
            frame = validate_panel(frame)
        elif frame.isEmpty():
            raise DataContractError("the snapshot is empty")
        day, token = self._day(as_of), uuid.uuid4().hex
        taken = self.manifest().filter((F.col("kind") == kind) & (F.col("as_of") == day)).agg(F.max("revision")).first()[0]
        revision = 0 if taken is None else taken + 1
        path = self._at(kind, day, revision, token)
        frame.drop("as_of").write.mode("errorifexists").parquet(path)
        entry = {"kind": kind, "as_of": day, "rows": self.spark.read.parquet(path).count(), "label": label, "created_at": self._day(created_at) if created_at else day, "columns": frame.columns, "token": token}
        while not self._claim(entry | {"revision": revision}):  # another writer was first
            (here, fs), revision = self._path(path), revision + 1
            path = self._at(kind, day, revision, token)
            there, _ = self._path(path)
            fs.mkdirs(there.getParent())
            fs.rename(here, there)
        return path

    def as_of_dates(self, kind: str = "panel") -> DataFrame:
        return self.manifest().filter(F.col("kind") == kind).select("as_of").distinct().orderBy("as_of")

    def _latest(self, kind: str) -> list:
        w = Window.partitionBy("as_of").orderBy(F.desc("revision"))
        return self.manifest().filter(F.col("kind") == kind).withColumn("_r", F.row_number().over(w)).filter("_r = 1").orderBy("as_of").collect()  # one row a snapshot date

    def load(self, as_of=None, kind: str = "panel") -> DataFrame:
        found = self._latest(kind)
        if as_of is not None:
            found = [r for r in found if r.as_of == self._day(as_of)]
        if not found:
            raise EngineError(f"no {kind} snapshot" + (f" as of {self._day(as_of)}" if as_of is not None else ""))
        r = found[-1]
        return self.spark.read.parquet(self._at(kind, r.as_of, r.revision, r.token))

    def history(self, kind: str = "panel", series=None, latest_only: bool = False, ordered: bool = True) -> DataFrame:
        """All snapshots with as_of (and revision), in order of both and of the rows' keys unless not asked for; series filters reach the scan,
        revisions are pruned by the manifest."""
        rows = self._latest(kind) if latest_only else self.manifest().filter(F.col("kind") == kind).collect()
        if not rows:
            raise EngineError(f"no {kind} snapshots")
        out = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true").parquet(*[self._at(r.kind, r.as_of, r.revision, r.token) for r in rows])
        out = out.withColumn("as_of", F.col("as_of").cast("timestamp_ntz")).drop("kind", "token")
        if series is not None:
            out = out.filter(F.col(ID if ID in out.columns else "opp_id").isin(*([series] if isinstance(series, str) else series)))
        return out.orderBy("as_of", "revision", *[c for c in (ID, TIME, "opp_id") if c in out.columns]) if ordered else out


def latest_only(history: DataFrame) -> DataFrame:
    """Rows of the last revision of each as_of."""
    last = history.groupBy("as_of").agg(F.max("revision").alias("revision"))
    return history.join(last, ["as_of", "revision"], "left_semi")


def evolution(history: DataFrame, target_ds, value_col: str = TARGET, series=None) -> DataFrame:
    """How the value of one ds changed over the snapshots."""
    out = history.filter(F.col(TIME) == F.lit(target_ds).cast("timestamp_ntz"))
    if series is not None:
        out = out.filter(F.col(ID) == series)
    return out.select("as_of", ID, TIME, value_col).orderBy(ID, "as_of")


def forecast_vs_actual(history: DataFrame, actual: DataFrame, value_col: str = "yhat") -> DataFrame:
    """Forecasts joined to actuals (one row a key, the smallest y of repeats), with error, abs_error and pct_error."""
    one = actual.groupBy(ID, TIME).agg(F.min(TARGET).alias(TARGET))
    e = F.col(value_col) - F.col(TARGET)
    out = history.join(one, [ID, TIME])
    return out.select("as_of", ID, TIME, value_col, TARGET, e.alias("error"), F.abs(e).alias("abs_error"), F.when(F.abs(TARGET) > 1e-12, F.try_divide(e, F.col(TARGET))).alias("pct_error"))


def accuracy_over_time(fva: DataFrame) -> DataFrame:
    total = F.sum(F.abs(TARGET))
    return fva.groupBy("as_of").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.avg("error").alias("bias"), F.when(total >= 1e-12, F.try_divide(F.sum("error"), total)).alias("pct_bias")).orderBy("as_of")
