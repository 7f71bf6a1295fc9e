"""What the training-data operators share: reading, words, folds."""

from __future__ import annotations

import functools
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import discard, materialize

__all__ = ["columns_kept", "discard", "materialize", "remainder", "replaced", "table", "tasks", "words"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Bytes of a table up to which operators send it to every task; its size is checked first, and there is another way beyond.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names: an operator's own columns replace those of the input."""
    return df.drop(*names)


def columns_kept(*added: str, inner: tuple[str, ...] = ()):
    """For operators (docs, ...) -> docs with the columns ``added``: these replace input columns of their names; input columns with the names of ``inner`` columns, which an operator makes and drops, bear other names meanwhile and come out as they were."""

    def wrap(operator):
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **named) -> DataFrame:
            docs = replaced(docs, *added)
            asked = {a for a in (*args, *named.values()) if isinstance(a, str)}
            away = {c: f"kept \u00b7{c}" for c in docs.columns if c in inner and c not in asked}
            return operator(docs.withColumnsRenamed(away), *args, **named).withColumnsRenamed({v: k for k, v in away.items()})

        return run

    return wrap


def words(text: str | None) -> list[bytes]:
    """The runs of bytes other than 0x20 and 0x09-0x0D; bytes.split() cuts at exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def tasks(df: DataFrame, total_bytes: int, each: int) -> int:
    """Partitions so that each gets about ``each`` bytes; at least those of the session's shuffles."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total_bytes // each))
