"""Line dedup: repeated runs of lines by a suffix array over line ids, built by distributed prefix doubling."""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import columns_kept, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ranked(pairs: DataFrame) -> DataFrame:
    """pairs (r1, r2, first), distinct by (r1, r2) -> with ``rank``, dense in order of (r1, r2). Sorted by range; only the partitions' sizes meet in one place."""
    lined = materialize(pairs.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")))
    part = lined.groupBy("part").agg(F.count("*").alias("size"), F.min("m").alias("least"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.select("part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("least") + 1).alias("base"))
    return lined.join(base, "part").select("r1", "r2", "first", (F.col("base") + F.col("m")).alias("rank"))


def _suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """lines (o, k, p, v, long): line id v at place p of sequence k; sequences stand in order (o, k) -> for h = 1, 2, 4, ... the suffixes whose first h lines come elsewhere too: (o, k, p, rank, first, later, long); rank in order of those h lines, first the earliest place (o, k, p) of them.

    Round by round ranks of h lines become ranks of 2h: pairs (rank at p, rank at p + h) are counted map-side, those found more than once are sorted by range and ranked, and a suffix whose pair is unique leaves. Rounds end when none is left: the ranks are then the suffix array of all that repeats.
    """
    at = F.struct("o", "k", "p")
    first = F.min(at).alias("first")
    kept = ("o", "k", "p", "rank", "first", (at > F.col("first")).alias("later"), "long")
    ranks = _ranked(lines.groupBy(F.col("v").alias("r1")).agg(F.count("*").alias("n"), first).filter("n > 1").select("r1", F.lit(0).cast("bigint").alias("r2"), "first"))
    out, h = [materialize(lines.join(ranks, lines["v"] == ranks["r1"]).select(*kept))], 1
    while True:
        live = out[-1]
        pairs = live.select("o", "k", "p", "long", F.col("rank").alias("r1")).join(live.select("k", (F.col("p") - h).alias("p"), F.col("rank").alias("r2")), ["k", "p"])
        ranks = _ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n"), first).filter("n > 1").drop("n"))
        live = materialize(pairs.join(ranks, ["r1", "r2"]).select(*kept))
        if live.isEmpty():
            return out
        out.append(live)
        h *= 2


def repeated_runs(levels: list[DataFrame], shortest: int) -> DataFrame:
    """The ranks of ``_suffix_ranks`` -> (k, p, depth, fo, fk, fp): maximal runs of at least ``shortest`` (a power of two) lines that also stand at an earlier place (fo, fk, fp).

    A suffix is held against the earliest place that shares the most doublings with it. Of suffixes one after another with sources one after another only the first is kept, as its run holds the others'. Its longest common prefix with the source is then found by descent: from h lines, h / 2, h / 4, ... more are added where both places have one rank.
    """
    each = [x.filter("later").select("k", "p", F.lit(1 << i).alias("h"), "first") for i, x in enumerate(levels) if 1 << i >= shortest]
    if not each:
        return levels[0].limit(0).select("k", "p", F.lit(0).alias("depth"), F.col("first.o").alias("fo"), F.col("first.k").alias("fk"), F.col("first.p").alias("fp"))
    found = reduce(DataFrame.unionByName, each).groupBy("k", "p").agg(F.max_by(F.struct("h", "first"), "h").alias("x"))
    found = found.select("k", "p", "x.h", F.col("x.first.o").alias("fo"), F.col("x.first.k").alias("fk"), F.col("x.first.p").alias("fp"))
    before = lambda c: F.lag(c).over(Window.partitionBy("k").orderBy("p"))
    goes_on = (before("p") == F.col("p") - 1) & (before("fk") == F.col("fk")) & (before("fp") == F.col("fp") - 1)
    runs = materialize(found.withColumn("_on", F.coalesce(goes_on, F.lit(False))).filter("not _on").drop("_on").withColumn("depth", F.col("h")))
    for i in range(len(levels) - 2, -1, -1):
        ranks = levels[i]
        own = ranks.select(F.col("k").alias("k1"), F.col("p").alias("p1"), F.col("rank").alias("r1"))
        other = ranks.select(F.col("k").alias("k2"), F.col("p").alias("p2"), F.col("rank").alias("r2"))
        goes = F.when(F.col("h") > 1 << i, F.col("depth"))  # those of fewer lines meet nothing
        more = runs.join(own, (F.col("k") == F.col("k1")) & (F.col("p") + goes == F.col("p1")), "left").join(other, (F.col("fk") == F.col("k2")) & (F.col("fp") + goes == F.col("p2")), "left")
        runs = more.withColumn("depth", F.col("depth") + F.when(F.col("r1") == F.col("r2"), 1 << i).otherwise(0)).select(*runs.columns)
        if i % 3 == 0:  # so that plans stay short
            runs = materialize(runs)
    return runs.drop("h")


@columns_kept("_lines", "_clean", "_runs", "_copies", inner=("_key", "_k", "_found"))
def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 2, words: int | None = None) -> DataFrame:
    """docs with ``_lines``, ``_clean`` (the text without later copies of line runs), ``_runs`` (array of first line, number of lines: the runs removed, none touching) and ``_copies`` (array of (line, lines, source_id, source_line): each maximal repeated run and its earliest place).

    Lines are cut at \\n and compared whole, blank ones too, by a 64-bit hash. A line goes if it lies in a run of at least ``shortest`` (a power of two) lines that also starts at an earlier place, in order of id (null first), hash of the text, line. With ``words``, a line of more words than that also goes if it stands at an earlier place by itself. Overlapping and adjoining runs merge. Rows of one id and text are one document and get one result; a null text has no lines and stays null; an empty table gives none.
    """
    if shortest < 1 or shortest & (shortest - 1):
        raise ValueError("shortest must be a power of two")
    key = F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.octet_length(text_col).alias("n"))  # a hash alone would meet another among very many texts
    own = lambda x: F.struct(F.xxhash64(x).alias("v"), (F.lit(False) if words is None else F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) > words).alias("long"))
    slim = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("o"), key.alias("k"), F.transform(F.split(F.col(text_col), "\n"), own).alias("vs")).dropDuplicates(["k"])
    lines = materialize(slim.select("o", "k", F.posexplode("vs").alias("p", "x")).select("o", "k", "p", "x.v", "x.long"))
    levels = _suffix_ranks(lines)
    found = repeated_runs(levels, shortest)
    if words is not None:
        source = ("k", "p", F.lit(1).alias("depth"), F.col("first.o").alias("fo"), F.col("first.k").alias("fk"), F.col("first.p").alias("fp"))
        found = found.unionByName(levels[0].filter("later and long").select(*source))
    spans = found.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("p", "depth", F.col("fo").alias("id"), "fp"))).alias("_found")).withColumnRenamed("k", "_k")
    copies = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("source_id", docs.schema[id_col].dataType), T.StructField("source_line", T.LongType())]))
    more = [T.StructField("_lines", T.LongType()), T.StructField("_clean", T.StringType()), T.StructField("_runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_copies", copies)]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), to_arrow_type(copies)]

    def run(batches):
        for b in batches:
            texts, founds = b.column(b.schema.get_field_index(text_col)).to_pylist(), b.column(b.schema.get_field_index("_found")).to_pylist()
            cols = [[], [], [], []]
            for t, found in zip(texts, founds):
                parts, runs = [] if t is None else t.split("\n"), []
                for x in found or ():
                    a, z = x["p"], x["p"] + x["depth"]
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                kept, at = [], 0
                for a, z in [*runs, [len(parts)] * 2]:
                    kept += parts[at:a]
                    at = z
                again = [{"line": x["p"], "lines": x["depth"], "source_id": x["id"], "source_line": x["fp"]} for x in found or ()]
                for c, v in zip(cols, (len(parts), None if t is None else "\n".join(kept), [[a, z - a] for a, z in runs], again)):
                    c.append(v)
            own = [c for n, c in zip(b.schema.names, b.columns) if n != "_found"]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*(n for n in b.schema.names if n != "_found"), *(f.name for f in more)])

    joined = docs.withColumn("_key", key).join(spans, F.col("_key") == F.col("_k"), "left").select(*docs.columns, "_found")
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
