"""Identities of everything that was emitted: a bucketed table, appended pass by pass, probed by a new pass alone.

An identity is 32 bytes made of queue and content hash. The table is bucketed by it, so that a probe shuffles the new
pass only and reads one narrow column of the old ones where it lies. Each pass is a partition that redoing the pass
replaces, and a pass is compared with earlier passes only, so a pass that is redone emits what it did before.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.tables import _store, remove, subfolders

BUCKETS = 64


def identity(queue: str = "queue_slug", content: str = "content_hash") -> Column:
    """Queue and content hash as 32 bytes; the lengths keep parts apart, a null counts as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (queue, content)]
    return F.unhex(F.sha2(F.concat(F.octet_length(parts[0]).cast("string"), F.lit("|"), *parts), 256))


@dataclass(frozen=True)
class IdentityStore:
    """A store in ``folder``. ``buckets`` counts when the store is made; an existing store keeps its own number, see ``rebuild``."""

    folder: str
    buckets: int = BUCKETS

    def _place(self, spark: SparkSession) -> tuple[str, int]:
        """Folder and number of buckets of the newest complete version."""
        versions = [v for v in subfolders(spark, self.folder) if v.startswith("v") and "-" in v]
        newest = max(versions, key=lambda v: int(v[1:].split("-")[0]), default=f"v1-{self.buckets}")
        return f"{self.folder}/{newest}", int(newest.split("-")[1])

    def table(self, spark: SparkSession) -> tuple[str, int]:
        """The store as a table this session knows by name, and its number of buckets."""
        place, buckets = self._place(spark)
        return _known(spark, place, buckets), buckets

    def passes(self, spark: SparkSession) -> list[str]:
        place, _ = self._place(spark)
        return [p.removeprefix("pass_id=") for p in subfolders(spark, place) if p.startswith("pass_id=")]

    def earlier(self, spark: SparkSession, before: str | None) -> DataFrame:
        """Identities of the passes before one, or of all."""
        name, _ = self.table(spark)
        stored = spark.table(name)
        return (stored if before is None else stored.filter(F.col("pass_id") < before)).select("identity")

    def fresh(self, events: DataFrame, order: list[str], pass_id: str | None = None) -> DataFrame:
        """Events of a new pass whose ``identity`` no earlier pass has, the first by ``order`` of each.

        ``order`` must tell the rows of one identity apart. Only (identity, order) is compared with the store; texts are shuffled once,
        by identity and order together, so a content that a third of all rows share is spread.
        """
        spark = events.sparkSession
        _, buckets = self.table(spark)
        firsts = events.groupBy("identity").agg(F.min(F.struct(*order)).alias("_first"))
        # As many partitions as buckets, by the same hash: the store is read bucket by bucket and not shuffled. An anti-join would be
        # pushed below the repartition, and the store shuffled after all; so what has no partner is looked for by hand.
        seen = self.earlier(spark, pass_id).withColumn("_seen", F.lit(True))
        new = firsts.repartition(buckets, "identity").join(seen, "identity", "left").filter("_seen IS NULL")
        keys = new.select(F.col("identity").alias("_identity"), *(F.col(f"_first.{c}").alias(f"_{c}") for c in order))
        same = F.col("identity") == F.col("_identity")
        for c in order:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return events.join(keys, same, "left_semi")

    def record(self, identities: DataFrame, pass_id: str) -> None:
        """Store the identities of a pass, in place of those an earlier try of it stored. Call after its events are written, with what was written."""
        spark = identities.sparkSession
        name, buckets = self.table(spark)
        _put(identities.select("identity").distinct(), name, buckets, pass_id)

    def rebuild(self, spark: SparkSession, before: str, buckets: int | None = None) -> None:
        """Fold the passes before one into a single one, in a new version of the table, with another number of buckets if given.

        Many small passes make many small files, and a store that grew wants more buckets. Readers take the newest version
        that has its marker; the old one goes last, so a crash in between leaves at least one whole.
        """
        place, now = self._place(spark)
        old = [p for p in self.passes(spark) if p < before]
        if not old:
            return
        version = int(place.rsplit("/v", 1)[1].split("-")[0]) + 1
        # Written under a name that readers don't take for a version, then renamed.
        draft, final = f"{self.folder}/draft-{version}", f"{self.folder}/v{version}-{buckets or now}"
        remove(spark, [draft])
        name = _known(spark, draft, buckets or now)
        stored = spark.table(self.table(spark)[0])
        _put(stored.filter(F.col("pass_id") < before).select("identity").distinct(), name, buckets or now, old[-1])
        for later in self.passes(spark)[len(old) :]:
            _put(stored.filter(F.col("pass_id") == later).select("identity"), name, buckets or now, later)
        spark.sql(f"DROP TABLE {name}")
        fs, source = _store(spark, draft)
        fs.rename(source, _store(spark, final)[1])
        remove(spark, [place])


def _known(spark: SparkSession, place: str, buckets: int) -> str:
    """Declare the table of a folder in this session. The folder holds everything; the catalog entry is only its description."""
    name = "identities_" + hashlib.md5(place.encode()).hexdigest()
    fs, folder = _store(spark, place)
    fs.mkdirs(folder)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (identity BINARY, pass_id STRING) USING parquet PARTITIONED BY (pass_id) "
        f"CLUSTERED BY (identity) SORTED BY (identity) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.recoverPartitions(name)  # passes that other sessions wrote
    return name


def _put(identities: DataFrame, name: str, buckets: int, pass_id: str) -> None:
    """Write one pass of a table, one file a bucket, in place of what it held."""
    spark = identities.sparkSession
    rows = f"rows_{uuid.uuid4().hex}"
    identities.repartition(buckets, "identity").createOrReplaceTempView(rows)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (pass_id = '{pass_id}') SELECT identity FROM {rows}")
    spark.catalog.dropTempView(rows)
