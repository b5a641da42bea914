"""Helpers that every operator shares: tables, lineage cuts, redeliveries, global ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir`` or the checkpoint folder set on its context.

    A folder of our own is used only where neither is set and everything runs in this process (tests); a cluster without
    a shared folder raises, as executors would write to their own disks.
    """
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="jurisgrid-")
    return _own


_own: str | None = None
_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _written.pop(path, None)


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table into the shared checkpoint folder and read that.

    Unlike ``checkpoint()`` the rows are computed once, and the optimizer knows the table's size afterwards.
    Any executor can be lost without recomputing what came before. ``replaces`` is an earlier cut that
    nothing but ``df`` reads any more; its files are deleted. The rest goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{_shared_dir(spark).rstrip('/')}/jurisgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    old = getattr(replaces, "_cut_path", None)
    if old:
        _delete(spark, old)
    return out


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; a temporary folder is removed below
            continue
    if _own:
        shutil.rmtree(_own, ignore_errors=True)


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row for each key: the one loaded last.

    ``max`` over a struct is combined on the map side and never gathers the rows of a key. Equal
    ``by`` values fall back on the remaining columns, so the choice is deterministic; a null ``by``
    is older than any other.
    """
    rest = [c for c in df.columns if c not in keys and c != by]
    row = F.struct(F.col(by).alias("_by"), *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max(row).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row._by").alias(by))


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add the dense position (from 0) of every row in the order of ``order``, without a window.

    Range partitions are sorted on their own; the only thing gathered is one row count a
    partition. The sorted rows are checkpointed first, so the ranges cannot move between the count
    and its use. ``order`` must identify a row, else ties are ranked in an arbitrary order.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    small = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(small), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_before", "_at")
    )


def id_key(c: Column) -> Column:
    """Form in which ids are compared: letter case and surrounding blanks don't count; blank is null."""
    k = F.lower(F.regexp_replace(c, r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))
    return F.when(k != "", k)
