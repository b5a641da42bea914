"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. Every document gets a hash-random key; documents are range-sorted
by (source, key), so a source with a third of all rows spreads over many partitions; prefix sums of the
token counts come from sums within a range plus the sums of the ranges before it. Each source is cut
at its exact budget: the last document in is marked with the number of its tokens that count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurisgrid.common import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counter(path: str = TOKENIZER, pattern: str = PATTERN):  # noqa: ANN201
    """Arrow-batched UDF: tokens of a text (null: null); the vocabulary is read once by each worker."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(enc.encode_ordinary(t)) if t is not None else None).astype("Int64")

    return count


def _prefix_sums(sized: DataFrame) -> DataFrame:
    """Add ``before``: the tokens of the same source that come earlier in the order of (key, doc)."""
    ranged = cut(sized.repartitionByRange("source", "key", "doc").sortWithinPartitions("source", "key", "doc").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("source", "part").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("inner", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    sums = ranged.groupBy("source", "part").agg(F.sum("tokens").alias("n"))  # one row for each source in each range
    offsets = sums.withColumn("outer", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(offsets.select("source", "part", "outer"), ["source", "part"]).select("source", "doc", "key", "tokens", (F.col("inner") + F.col("outer")).alias("before"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: Column | int | None = None) -> DataFrame:
    """(source, available, target_share, max_repeats, budget): one row for each source of either table.

    Shares are rescaled over the sources that have tokens. ``total_tokens`` defaults to the largest
    mix in which no source exceeds its repeats; a larger wish is cut to what the repeats allow, and
    the report shows the share that results. Sources without a target get budget 0.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = t.join(sizes, "source", "full").select("source", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    live = (F.col("available") > 0) & (F.col("target_share") > 0)
    norm = both.agg(F.sum(F.when(live, F.col("target_share"))).alias("shares"), F.sum(F.when(live, F.lit(1))).alias("k"))
    both = both.crossJoin(norm).withColumn("share", F.when(live, F.col("target_share") / F.col("shares")).otherwise(0.0))  # norm is one row
    most = both.agg(F.min(F.when(live, F.col("available") * F.col("max_repeats") / F.col("share"))).alias("most"))
    wish = F.lit(total_tokens) if total_tokens is not None else F.col("most")
    both = both.crossJoin(most).withColumn("budget", F.coalesce(F.least(F.floor(wish * F.col("share") + F.lit(1e-6)), F.col("available") * F.col("max_repeats")), F.lit(0)).cast("long"))
    return both.select("source", "available", "target_share", "max_repeats", "budget")


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (doc, source, epoch, tokens, take) and its report.

    ``take`` is the number of the document's tokens that count (all, but for the document that crosses the
    budget). Epoch e > 1 repeats the source in the same order. Report: source, available, target_share,
    max_repeats, budget, taken, repeats, actual_share. Null texts and sources without a target are not
    taken (a null source is reported as such with 0); repeated rows count as often as they come.
    """
    count = token_counter(tokenizer)
    sized = documents.select(F.col(source).alias("source"), F.col(key).alias("doc"), count(F.col(text)).alias("tokens")).where("tokens > 0")
    sized = cut(sized.withColumn("key", F.xxhash64(F.lit(seed), "doc")))
    sizes = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = cut(budgets(sizes, targets, total_tokens))
    wanted = plan.where("budget > 0").join(targets.select("source").distinct(), "source", "left_semi")  # the optimizer knows the size of a cut
    placed = _prefix_sums(sized.join(wanted.select("source"), "source", "left_semi")).join(wanted, "source")
    # Epoch e covers the positions from (e - 1) * available on.
    epochs = F.floor((F.col("budget") - F.col("before") - 1) / F.col("available")) + 1
    rows = placed.where("before < budget").select("doc", "source", "tokens", "before", "budget", "available", F.explode(F.sequence(F.lit(1), epochs.cast("int"))).alias("epoch"))
    taken = rows.select("doc", "source", "epoch", "tokens", F.least("tokens", F.col("budget") - F.col("before") - (F.col("epoch") - 1) * F.col("available")).alias("take"))
    spent = taken.groupBy("source").agg(F.sum("take").alias("taken"), F.max("epoch").alias("repeats"))
    unsourced = sized.where("source is null").agg(F.sum("tokens").alias("available")).where("available > 0").select(F.lit(None).cast("string").alias("source"), "available", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), F.lit(0).cast("long").alias("budget"))
    report = plan.unionByName(unsourced).join(spent, "source", "left").na.fill(0, ["taken", "repeats"])
    grand = spent.agg(F.sum("taken").alias("grand"))
    report = report.crossJoin(grand).withColumn("actual_share", F.coalesce(F.col("taken") / F.col("grand"), F.lit(0.0))).drop("grand")
    return taken, report
