"""The nightly merge as a stream: drift check, merge, and the gate before anything is switched off.

A night's rows come as one micro-batch. The listing table is a row of versions
in a shared folder; a night writes its version, and then one line of the ledger,
which makes the version count. A night whose line is there changes nothing,
whether Spark repeats the micro-batch or the night is delivered again. A job that
dies between the two leaves a version that no line names, and is done anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listaro.operators import aggregates as A
from listaro.operators import control as C
from listaro.operators import joins as J
from listaro.operators import merge as M

LEDGER = "night string, number bigint, crawled bigint, failed bigint, verdict string, drift array<string>, inserted bigint, updated bigint, deactivated bigint"


@dataclass(frozen=True)
class NightlyMerge:
    """A function for foreachBatch over crawled pages: night, id, ok (was it parsed?), event_id (its place), and the listing's columns.

    ``root``: the shared folder. ``columns``: the listing's columns, those whose
    fill rates are watched among them. Within a night an id's last row counts.
    """

    root: str
    columns: tuple[str, ...]
    schema: StructType

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One line per night that has been merged."""
        path = f"{self.root}/ledger"
        return spark.read.schema(LEDGER).parquet(path) if _there(spark, path) else spark.createDataFrame([], LEDGER)

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, active, updated_at, columns): the listings after the last merged night."""
        last = self.ledger(spark).agg(F.max_by("night", "number")).first()[0]
        return spark.read.parquet(self._version(last)).select("id", "active", "updated_at", *self.columns) if last else spark.createDataFrame([], self._listing())

    def _version(self, night: str) -> str:
        return f"{self.root}/versions/night={night}"

    def _listing(self) -> str:
        return ", ".join(["id string", "active boolean", "updated_at timestamp", *(f"{f.name} {f.dataType.simpleString()}" for f in self.schema if f.name in self.columns)])

    def __call__(self, batch: DataFrame, number: int) -> None:
        """Merge the nights of a micro-batch, in order. A batch holds few nights; their counts alone come to the driver."""
        for gate in sorted(C.ingest_gate(batch.filter("night is not null"), "night").collect(), key=lambda g: g.night):
            self._merge(batch.sparkSession, batch.filter(F.col("night") == gate.night), gate)

    def _merge(self, spark: SparkSession, pages: DataFrame, gate: Row) -> None:
        """One join per night: the version written has what the night brought and what was there, so counts and drift are read from it."""
        night, done = gate.night, self.ledger(spark)
        if not done.filter(F.col("night") == night).isEmpty():
            return
        parsed = J.first_per_key(pages.filter("ok and id is not null"), ["id"], F.col("event_id").desc()).select("id", *self.columns)
        before = self.table(spark)
        merged = M.upsert_listings(before, parsed, list(self.columns), F.lit(night).cast("timestamp"), marks=True)
        # A night that saw too little switches nothing off.
        active = F.col("active") & F.col("came") if gate.verdict == "ok" else F.col("active")
        left = merged.withColumn("active", active).withColumn("gone", F.col("was_active") & ~F.col("active"))
        left.write.mode("overwrite").parquet(self._version(night))
        version = spark.read.parquet(self._version(night))
        # Drift is told before the night counts: its rows are held against the version before it, of which they are no part.
        drift = A.drift_findings(A.fill_rates(version.filter("came"), list(self.columns)), A.fill_rates(before, list(self.columns)))
        fallen = sorted(r["column"] for r in drift.collect())
        counts = version.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("inserted", "updated")], F.count_if("gone").alias("gone")).first()
        line = (night, done.count(), gate.crawled, gate.failed, gate.verdict, fallen, counts.inserted, counts.updated, counts.gone)
        spark.createDataFrame([line], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
