"""References to records that do not exist, by key ranges and periods of compressed bitmaps.

Keys are dictionary-encoded as dense integers by one range sort. For each key range of 32768 keys
and each period the referenced keys and the keys known before the period are bitmaps
(``bitmap_construct_agg``: combined on the map side, so a key that a third of all rows refer to costs one
bit a task). Containers with few bits are packed as sorted 16-bit numbers. reference AND-NOT
parent leaves the candidates; only their rows are decoded and judged exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.common import cut, global_rank

RANGE = 32768
SPARSE = 2048  # up to so many bits 16-bit numbers are shorter than a bitmap


def _pack(raw: bytes) -> bytes:
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))
    return b"s" + bits.astype("<u2").tobytes() if len(bits) < SPARSE else b"d" + raw


def _bits(packed: bytes | None) -> np.ndarray:
    out = np.zeros(RANGE, bool)
    if packed:
        if packed[:1] == b"s":
            out[np.frombuffer(packed, "<u2", offset=1)] = True
        else:
            raw = np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little")
            out[: len(raw)] = raw.astype(bool)
    return out


@F.pandas_udf(T.BinaryType())
def pack_container(raw: pd.Series) -> pd.Series:
    """Bitmap to the shorter of a bitmap and a list of 16-bit numbers."""
    return raw.map(lambda b: _pack(bytes(b)) if b is not None else None)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def and_not(refs: pd.Series, parents: pd.Series) -> pd.Series:
    """Positions that are set in the first container and not in the second."""
    return pd.Series([np.flatnonzero(_bits(a) & ~_bits(b)).astype("int32").tolist() for a, b in zip(refs, parents)])


def find_orphans(refs: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Orphan references with their state.

    ``refs`` has the key columns, table_name, record_id and created_at; ``parents`` has the key columns,
    first_loaded and deleted. One row for each (table_name, record_id, created_at) of ``refs`` comes out if its key is
    'missing' among the parents, 'deleted', or 'late' (first loaded after created_at). References
    with a null key are no cases; a null created_at has no period, so such a row is kept with period null
    and can be missing or deleted but not late. Empty tables give no rows.
    """
    full = lambda df: df.dropna(subset=keys)
    refs, parents = full(refs).withColumn("period", F.date_format(F.to_utc_timestamp(F.col("created_at"), F.current_timezone()), "yyyy-MM")), full(parents)
    parents = parents.groupBy(*keys).agg(F.min("first_loaded").alias("first_loaded"), F.max("deleted").alias("deleted"))
    words = refs.select(*keys).union(parents.select(*keys)).distinct()
    codes = cut(global_rank(words, keys, "code"))
    # Inner joins on the dictionary; it has each key once, so skewed references can be split by AQE.
    refs_c = cut(refs.join(codes, keys).select("code", "table_name", "record_id", "created_at", "period"))
    parents_c = cut(parents.join(codes, keys).select("code", "first_loaded", "deleted"))
    at, slot = (F.col("code") % RANGE).cast("long"), F.expr(f"code div {RANGE}").alias("slot")
    ref_maps = refs_c.groupBy("table_name", F.coalesce("period", F.lit("")).alias("period"), slot).agg(pack_container(F.bitmap_construct_agg(at)).alias("refs"))
    alive = parents_c.where("not deleted").withColumn("since", F.date_format(F.to_utc_timestamp(F.col("first_loaded"), F.current_timezone()), "yyyy-MM"))
    # Keys known before a period: an OR over the earlier periods of a range, at most one row a period.
    by_month = alive.groupBy(slot, "since").agg(F.bitmap_construct_agg(at).alias("bits"))
    order = Window.partitionBy("slot").orderBy("since")
    known = by_month.withColumn("known", F.bitmap_or_agg("bits").over(order)).withColumn("until", F.lead("since").over(order)).select("slot", "since", "until", pack_container("known").alias("known"))
    pairs = ref_maps.join(known, (ref_maps["slot"] == known["slot"]) & (known["since"] < ref_maps["period"]) & (known["until"].isNull() | (known["until"] >= ref_maps["period"])), "left").select("table_name", "period", ref_maps["slot"], "refs", "known")
    left = pairs.select("table_name", "period", "slot", F.explode(and_not("refs", "known")).alias("bit")).select("table_name", "period", (F.col("slot") * RANGE + F.col("bit")).alias("code"))
    rows = refs_c.withColumn("period_key", F.coalesce("period", F.lit(""))).join(left.withColumnRenamed("period", "period_key"), ["table_name", "period_key", "code"], "left_semi")
    state = F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first_loaded") > F.col("created_at"), "late")
    judged = rows.join(parents_c, "code", "left").withColumn("state", state)
    return judged.where("state is not null").select("table_name", "record_id", "period", "state")


def orphan_report(orphans: DataFrame, total: DataFrame) -> DataFrame:
    """Orphans of each table, month and state, with the number of references of that table and month."""
    counts = orphans.groupBy("table_name", "period", "state").agg(F.count(F.lit(1)).alias("orphans"))
    return counts.join(total.groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("refs")), ["table_name", "period"]).select("table_name", "period", "state", "orphans", "refs")


def period_of(ts: Column) -> Column:
    """UTC month of a timestamp, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")
