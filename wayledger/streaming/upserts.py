"""A keyed table that a stream upserts, kept as a few sorted runs of growing size.

A micro-batch becomes a small run, sorted by key in buckets of the key's hash. When the runs
before it aren't much larger than it, they are merged with it into one: each run then is more
than ``ratio`` times all newer ones together, so n rows lie in O(log n) runs and a row is
rewritten O(log n) times. A manifest names the live runs; a batch and the merge it sets off are
one manifest, so readers see the table before the batch or after it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifests import Manifests

#: Manifests, and with them the runs they name, that are kept for readers that have begun.
KEPT = 10


class UpsertStore:
    """``schema`` is a DDL text of all columns, ``keys`` are some of them. A null key is a key.

    One writer at a time: a second one that commits in between fails instead of losing rows.
    ``app`` tells apart the queries that write: each counts its own batches.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, ratio: float = 1.0, buckets: int = 4):
        self.spark, self.root, self.keys, self.schema, self.ratio, self.buckets = spark, root.rstrip("/"), keys, schema, ratio, buckets
        self.manifests = Manifests(spark, self.root)

    def manifest(self) -> dict:
        known = self.manifests.versions()
        return self.manifests.read(known[-1]) if known else {"version": 0, "order": 0, "batches": {}, "runs": []}

    def _open(self, names: list[str]) -> DataFrame:
        full = self.spark.read.schema(f"{self.schema}, _order long")
        return reduce(DataFrame.unionByName, [full.parquet(f"{self.root}/runs/{n}") for n in names])

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_order").alias("_row")).select(*self.keys, "_row.*")

    def _run(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
        rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").sortWithinPartitions("_bucket", *self.keys).drop("_bucket").write.parquet(f"{self.root}/runs/{name}")
        return {"name": name, "rows": self.spark.read.parquet(f"{self.root}/runs/{name}").count()}

    def write(self, df: DataFrame, batch: int, app: str = "") -> None:
        """A foreachBatch sink. A batch that has been written is left out when it comes again;
        of rows with equal keys in a batch one is kept."""
        before = self.manifest()
        if batch <= before["batches"].get(app, -1):
            return
        order = before["order"] + 1
        names = [f.split(" ")[0].strip() for f in _columns(self.schema)]
        new = self._run(self._newest(df.select(*names).withColumn("_order", F.lit(order).cast("long"))))
        runs = [*before["runs"], new] if new["rows"] else before["runs"]
        merge, total = 1, new["rows"]
        while new["rows"] and merge < len(runs) and runs[-merge - 1]["rows"] <= self.ratio * total:
            total += runs[-merge - 1]["rows"]
            merge += 1
        if merge > 1:
            runs = [*runs[:-merge], self._run(self._newest(self._open([r["name"] for r in runs[-merge:]])))]
        entry = {"version": before["version"] + 1, "order": order, "batches": before["batches"] | {app: batch}, "runs": runs}
        if not self.manifests.publish(entry):
            raise RuntimeError(f"another writer has committed to {self.root}")
        if entry["version"] % KEPT == 0:
            self.clean()

    def clean(self) -> None:
        """Delete the runs that only manifests older than the newest KEPT name."""
        live = {r["name"] for m in self.manifests.forget(KEPT) for r in m["runs"]}
        for name in self.manifests.names(f"{self.root}/runs"):
            if name not in live:
                self.manifests.delete(f"{self.root}/runs/{name}")

    def read(self) -> DataFrame:
        """The table: of each key the row of its newest batch. A single run is read as it is."""
        runs = [r["name"] for r in self.manifest()["runs"]]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self._open(runs)
        return (rows if len(runs) == 1 else self._newest(rows)).drop("_order")


def _columns(schema: str) -> list[str]:
    """The columns of a DDL text; commas within types don't count."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
