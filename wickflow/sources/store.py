"""A stored table of candles that is replaced in one step.

Data files are never changed. A manifest, one small file for each version, names the folder of each timeframe and 30 days; a merge writes
the folders that it touches anew and then puts the next manifest in place by a rename, which either happens or doesn't. Readers take
the latest manifest, so they see a merge whole or not at all, and what a failed merge has written is never read. A version that
someone else has put in place first makes the merge start over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .candles import COLUMNS, SCHEMA

#: Days of candles in a folder.
FOLDER_MS = 30 * 86_400_000
KEYS = ["symbol", "timeframe", "open_time"]
#: Attempts of a merge at a version that others take first.
ATTEMPTS = 20


def newest(rows: DataFrame) -> DataFrame:
    """One row for each series and time: of several versions of a candle the one of most trades, which is the latest; then that of the last batch (_batch), then by its values."""
    rest = [c for c in COLUMNS if c not in KEYS]
    order = F.struct(F.coalesce("trades", F.lit(-1)), F.col("_batch"), F.struct(*rest))
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), order).alias("_")).select(*KEYS, "_.*").select(*COLUMNS)


class CandleStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        root = self._at("")
        self._fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):  # noqa: ANN202
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the latest manifest; 0 if there is none."""
        folder = self._at("manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(x.removesuffix(".json")) for x in names if x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """folders: from timeframe/part to the folder of its data; batches: the last batch of each stream."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "folders": {}, "batches": {}}
        stream = self._fs.open(self._at(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self._folders(list(self.manifest(version)["folders"].values()))

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{x}" for x in folders))

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest is now that version's; someone else's stays."""
        name, target = self._at(f"manifests/.{uuid.uuid4().hex}.tmp"), self._at(f"manifests/{manifest['version']:012d}.json")
        out = self._fs.create(name, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        won = not self._fs.exists(target) and self._fs.rename(name, target)
        if not won:
            self._fs.delete(name, False)
        return bool(won)

    def merge(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """The version after new is merged in. A batch of a stream that was merged before changes nothing."""
        for _ in range(ATTEMPTS):
            before = self.manifest()
            if stream is not None and before["batches"].get(stream, -1) >= batch:
                return before["version"]
            part = F.floor(F.col("open_time") / FOLDER_MS).cast("long")
            rows = new.select(*COLUMNS).withColumn("_batch", F.lit(1))
            touched = sorted(f"{t}/{p}" for t, p in rows.select("timeframe", part.alias("part")).distinct().collect())  # a batch spans few folders
            stored = self._folders([before["folders"][x] for x in touched if x in before["folders"]]).select(*COLUMNS).withColumn("_batch", F.lit(0))
            own = f"data/{uuid.uuid4().hex}"
            merged = newest(stored.unionByName(rows)).withColumns({"_tf": F.col("timeframe"), "_part": part})
            merged.write.partitionBy("_tf", "_part").parquet(f"{self.path}/{own}")
            folders = before["folders"] | {x: f"{own}/_tf={x.split('/')[0]}/_part={x.split('/')[1]}" for x in touched}
            batches = before["batches"] | ({stream: batch} if stream is not None else {})
            after = {"version": before["version"] + 1, "folders": folders, "batches": batches}
            if self._put(after):
                return after["version"]
        raise RuntimeError("others were always first to put a version in place")

    def into(self, stream: str):  # noqa: ANN201
        """A foreachBatch function that merges each batch; one that runs again is merged once."""
        return lambda rows, batch: self.merge(rows, stream, batch)

    def vacuum(self, keep: int = 1) -> None:
        """Removes what none of the last versions names: older versions, and what failed merges have left. Not while others merge or read older versions."""
        last = self.version()
        kept = {x.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for x in self.manifest(v)["folders"].values()}
        for folder, stays in (("data", lambda x: x in kept), ("manifests", lambda x: x.endswith(".json") and int(x.removesuffix(".json")) > last - keep)):
            if self._fs.exists(self._at(folder)):
                for status in self._fs.listStatus(self._at(folder)):
                    if not stays(status.getPath().getName()):
                        self._fs.delete(status.getPath(), True)
