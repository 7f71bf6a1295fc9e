"""Two-pass external shuffle into shards."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_kept, tasks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 32 << 20
#: Buckets up to which the table of their first slots goes to every task.
BROADCAST_BUCKETS = 200_000


def shard_of(key: str, shards: int, seed: int = 0):
    """The shard whose seeded hash with the key is highest: one more shard only takes rows into itself. A null key hashes as such."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards))))["s"]


def _shuffled(seed: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Fisher-Yates over the rows of one bucket, from an order that doesn't depend on how the rows came."""
        group = group.take(pa.array(np.argsort(group["_order"].to_numpy(), kind="stable")))
        rng = np.random.Generator(np.random.PCG64([seed, int(key[0].as_py()), int(key[1].as_py())]))
        at = np.arange(len(group))
        rng.shuffle(at)
        group = group.take(pa.array(at))
        return group.append_column("_place", pa.array(np.arange(len(group)), pa.int64())).drop_columns(["_order"])

    return run


@columns_kept("_shard", "_bucket", "_slot", inner=("_order", "_place", "_start", "_n"))
def shuffle_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with ``_shard`` (by key and shard count alone), ``_bucket`` and ``_slot`` (the row's place in its shard, gapless from 0).

    Pass one scatters rows by a seeded hash of the whole row into buckets of about ``bucket_bytes``; pass two shuffles each bucket in memory. Slots of a bucket follow those of the shard's lower buckets. Tasks get about four buckets each, however large the table is.
    Rows of one key share a shard, not a bucket; rows equal in all columns share both, and any of them may have any of their slots. Columns of types that can't be hashed (maps) don't count. All columns pass through; a null text counts as empty; an empty table gives none.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16
    total = docs.agg(F.sum(size.cast("bigint")).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    whole = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = lambda n: F.xxhash64(F.lit(seed + n), *whole)
    dealt = docs.withColumn("_shard", shard_of(key, shards, seed)).withColumn("_bucket", F.pmod(row(1), F.lit(buckets)).cast("int"))
    schema = dealt.withColumn("_place", F.lit(0).cast("bigint")).schema
    rows = dealt.withColumn("_order", row(2)).repartition(tasks(docs, total, 4 * bucket_bytes), "_shard", "_bucket")
    out = rows.groupBy("_shard", "_bucket").applyInArrow(_shuffled(seed), schema)
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    small = shards * buckets <= BROADCAST_BUCKETS  # as many rows as there are buckets
    return out.join(F.broadcast(starts) if small else starts, ["_shard", "_bucket"]).withColumn("_slot", F.col("_start") + F.col("_place")).select(*docs.columns, "_shard", "_bucket", "_slot")


def write_shards(docs: DataFrame, path: str, **args) -> None:
    """Write the shuffled rows under ``path``, one folder for each shard, files in slot order.

    Rows as in ``shuffle_shards``; ``path`` must not exist yet, an empty table leaves a folder without shards, and of a shard without rows there is no folder.
    """
    out = shuffle_shards(docs, **args)
    out.repartition(out.rdd.getNumPartitions(), "_shard", "_bucket").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
