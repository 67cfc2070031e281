"""A keyed audit table that takes every turn once, however late a repeat comes.

Rows lie in buckets by a hash of their turn. Each epoch of a stream writes a folder with the rows that are
new, found against the keys of the buckets it touches, and then a manifest that lists every folder of every
bucket. Readers take the newest manifest, so they see whole epochs. A bucket of more than
``MAX_FOLDERS`` folders is rewritten into one by the epoch that touches it next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
MAX_FOLDERS = 8
KEYS = ["session_id", "turn_id"]
_MANIFEST = "epoch bigint, bucket int, folder string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str, epoch: int | None = None) -> list[tuple[int, str]]:
    """(bucket, folder) of the newest epoch, or of the newest one before ``epoch``."""
    if not _exists(spark, f"{path}/manifest"):
        return []
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    if epoch is not None:
        rows = rows.filter(F.col("epoch") < epoch)
    newest = rows.agg(F.max("epoch")).first()[0]
    return [] if newest is None else sorted((r.bucket, r.folder) for r in rows.filter(F.col("epoch") == newest).collect())  # buckets times folders


def read_audit(spark: SparkSession, path: str, schema: str, sessions: list[str] | None = None) -> DataFrame:
    """Rows of the newest whole epoch."""
    folders = sorted({folder for _, folder in manifest(spark, path)})
    rows = spark.read.schema(f"{schema}, bucket int").option("basePath", path).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], f"{schema}, bucket int")
    if sessions is not None:
        rows = rows.filter(F.col("session_id").isin(sessions))
    return rows.drop("bucket")


def audit_table(path: str, buckets: int = BUCKETS, max_folders: int = MAX_FOLDERS):
    """``foreachBatch`` body: the first row (by ``id``) of each turn that the table does not have yet.

    A repeated epoch replaces what its first run left; an epoch that was committed changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # The bucket is a plain folder name below the epoch's, read with the rows.
        known = manifest(spark, path, epoch)
        keyed = batch.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
        first = keyed.groupBy(*KEYS).agg(F.min_by(F.struct(*keyed.columns), F.col("id")).alias("r")).select("r.*")
        touched = {r.bucket for r in first.select("bucket").distinct().collect()}  # at most ``buckets``
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema.fields)

        def stored(which: list[tuple[int, str]]) -> DataFrame:
            return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{folder}" for _, folder in which])

        old = [(b, f) for b, f in known if b in touched]
        crowded = {b for b in touched if sum(1 for x, _ in old if x == b) >= max_folders}
        fresh = first
        if old:
            # Only the keys of touched buckets are read; nulls are keys like any other.
            before = stored(old).select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
            fresh = first.join(before, F.expr(" AND ".join(f"{k} <=> _{k}" for k in KEYS)), "left_anti")
        folded = [(b, f) for b, f in old if b in crowded]
        rows = fresh.unionByName(stored(folded).select(*fresh.columns)) if folded else fresh
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        written = {int(r.bucket) for r in spark.read.schema(schema).option("basePath", path).parquet(f"{path}/data/epoch={epoch}").select("bucket").distinct().collect()} if touched else set()
        now = [(b, f) for b, f in known if b not in crowded] + [(b, f"data/epoch={epoch}/bucket={b}") for b in sorted(written)]
        # One file, put in place by one rename: the epoch is there as a whole or not at all.
        spark.createDataFrame([(epoch, b, f) for b, f in now], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/part={epoch}")

    return write
