"""Plan store as a log: a delta per batch, compaction by bucket, one manifest per commit.

Layout under the store's folder: ``data/piece=<order>/bucket=<hash bucket>/*.parquet`` and ``manifest/<number>.json``. A manifest names the last batch and, for every live piece, its live
buckets; readers follow the newest one, so a commit is one file and a reader never sees half of it. Writing a batch costs what the batch holds, however large the
store is. A key stands in one bucket, so a bucket of a single piece is read as it is, and only buckets of several pieces are merged.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.sources.store import KEEP_OLD

#: Fields that the first row of a key decides, and fields that keep their last value that is not null; the last row decides the others.
FIRST = ["query", "normalized", "created_at", "hit_count", "seq"]
KEPT = [*KEEP_OLD, "has_signature"]


class PlanLog:
    """Keyed rows (``query_hash``, unique inside a batch), merged by the rules of ``upsert_plans``, or, with ``first_stays``, by keeping the row of the first batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, key: str = "query_hash", first_stays: bool = False):
        self.spark, self.folder, self.buckets, self.key, self.first_stays = spark, folder.rstrip("/"), buckets, key, first_stays

    # --- files ------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self) -> dict:
        """The newest manifest: ``batch`` and ``live`` (piece to buckets)."""
        numbers = self._numbers()
        if not numbers:
            return {"batch": -1, "live": {}}
        file = self._fs.open(self._path("manifest", f"{numbers[-1]:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        found = json.loads(text)
        return {"batch": found["batch"], "live": {int(p): b for p, b in found["live"].items()}}

    def _commit(self, state: dict) -> None:
        number = (self._numbers() or [-1])[-1] + 1
        made = self._path("manifest", f".{number:012d}.tmp")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(made, self._path("manifest", f"{number:012d}.json")):
            raise RuntimeError(f"another writer has made manifest {number} of {self.folder}")

    def _write(self, rows: DataFrame, piece: int) -> list[int]:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/piece={piece}")
        return [int(n.split("=")[1]) for n in self._names("data", f"piece={piece}") if n.startswith("bucket=")]

    # --- writing ----------------------------------------------------------------------
    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; False (and nothing written) for one that is already in the store. Batches come in rising order."""
        state = self.manifest()
        if batch <= state["batch"]:
            return False
        held = self._write(rows, 2 * batch)
        live = state["live"] | ({2 * batch: held} if held else {})
        self._commit({"batch": batch, "live": live})
        return True

    def compact(self, least: int = 4) -> list[int]:
        """Rewrite the buckets that at least ``least`` pieces share as one piece; returns them. Other buckets are not touched."""
        state = self.manifest()
        pieces = {b: [p for p, held in state["live"].items() if b in held] for b in range(self.buckets)}
        due = [b for b, p in pieces.items() if len(p) >= max(2, least)]
        if due:
            piece = 2 * state["batch"] + 1
            self._write(self._merged(state, due), piece)
            live = {p: [b for b in held if b not in due] for p, held in state["live"].items()}
            live[piece] = sorted({*live.get(piece, []), *due})
            self._commit({"batch": state["batch"], "live": {p: b for p, b in live.items() if b}})
        return due

    def vacuum(self) -> int:
        """Delete buckets and manifests that the newest manifest does not need, once no reader of an older one is left; returns the number of deleted buckets."""
        live, done = self.manifest()["live"], 0
        for name in self._names("data"):
            piece = int(name.split("=")[1])
            for inner in self._names("data", name):
                if inner.startswith("bucket=") and int(inner.split("=")[1]) not in live.get(piece, []):
                    done += bool(self._fs.delete(self._path("data", name, inner), True))
            if piece not in live:
                self._fs.delete(self._path("data", name), True)
        for number in self._numbers()[:-1]:
            self._fs.delete(self._path("manifest", f"{number:012d}.json"), False)
        return done

    # --- reading ----------------------------------------------------------------------
    def _rows(self, state: dict, pairs: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.folder}/data/piece={p}/bucket={b}" for p, b in pairs]
        return self.spark.read.option("basePath", f"{self.folder}/data").parquet(*paths)

    def _merged(self, state: dict, buckets: list[int]) -> DataFrame:
        rows = self._rows(state, [(p, b) for p, held in state["live"].items() for b in held if b in buckets])
        fields = [c for c in rows.columns if c not in (self.key, "piece", "bucket")]

        if self.first_stays:
            return rows.groupBy(self.key).agg(F.min_by(F.struct(*fields), "piece").alias("r")).select(self.key, "r.*")

        def pick(c):
            known = F.when(F.col(c).isNotNull(), F.col("piece"))
            return F.min_by(c, known) if c in FIRST else F.max_by(c, known) if c in KEPT else F.max_by(c, "piece")

        return rows.groupBy(self.key).agg(*[pick(c).alias(c) for c in fields])

    def read(self, keys: list | None = None) -> DataFrame:
        """The merged store; with ``keys`` only their buckets are read."""
        state = self.manifest()
        if not state["live"]:
            raise FileNotFoundError(f"{self.folder} holds no batch")
        wanted = range(self.buckets)
        if keys is not None:
            made = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} string")
            wanted = [r[0] for r in made.select(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).distinct().collect()]
        count = {b: sum(b in held for held in state["live"].values()) for b in wanted}
        single = [(p, b) for p, held in state["live"].items() for b in held if count.get(b) == 1]
        several = [b for b, n in count.items() if n > 1]
        parts = []
        if single:
            parts.append(self._rows(state, single).drop("piece", "bucket"))
        if several:
            parts.append(self._merged(state, several))
        if not parts:
            some = next((p, b) for p, held in state["live"].items() for b in held)
            parts.append(self._rows(state, [some]).drop("piece", "bucket").limit(0))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out.where(F.col(self.key).isin(list(keys))) if keys is not None else out
