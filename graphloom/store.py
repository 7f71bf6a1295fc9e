"""Snapshots of the graph's tables, and writes as new snapshots."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text
from .model import narrow, widened


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what ``setCheckpointDir`` named.

    Where neither is set a local session gets a temporary one; on a cluster that is an error, as each executor would write to its own disk.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spread(files: DataFrame) -> DataFrame:
    """The files dealt over all tasks by their paths: a table of a few bytes a file has few partitions, and what is made of its rows takes long."""
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return files.repartition(tasks, "repo_id", "file_path")


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once what was made of it is written too."""
    delete_path(df.sparkSession, df.written_to)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of highest ``order`` for each key; of equal ones the highest by the columns of plain types, from the left."""
    plain = [c for c, kind in rows.dtypes if c not in (*keys, order) and not kind.startswith(("map", "variant"))]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *map(F.desc, plain)))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of old rows of the same keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def valid_edges(edges: DataFrame) -> DataFrame:
    """No missing ends or types, and one edge for each (from, type, to). A task drops its own repeats and sends the rest sorted, in fewer bytes."""
    kept = edges.dropna(subset=["from_id", "edge_type", "to_id"])
    rest = [c for c in edges.columns if c not in ("from_id", "to_id")]
    kept = kept.select(*narrow("from_id", "_from"), *narrow("to_id", "_to"), *(f"`{c}`" for c in rest))
    one = Window.partitionBy("_from_t", "_from_n", "_to_t", "_to_n", "edge_type").orderBy("_from_n")
    kept = kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return kept.select(*({"from_id": widened("_from"), "to_id": widened("_to")}.get(c, F.col(f"`{c}`")).alias(c) for c in edges.columns))


def delete_elements(elements: DataFrame, edges: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the elements in ``victims`` (id), and without the edges that touch them on either side. The victims are found once: what is left is held against them three times, in each branch of a union."""
    ids = materialize(victims.select("id").distinct())
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return elements.join(ids, "id", "left_anti"), kept


def delete_files(elements: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (repo_id, file_path)."""
    return delete_elements(elements, edges, elements.join(materialize(files.select("repo_id", "file_path").distinct()), ["repo_id", "file_path"], "left_semi"))


def delete_repo(elements: DataFrame, edges: DataFrame, repo_id: str) -> tuple[DataFrame, DataFrame]:
    return delete_elements(elements, edges, elements.filter(F.col("repo_id") == repo_id))


def changed_files(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Files of a scan that are new, or whose time of change differs from the index."""
    known = index.select("repo_id", "file_path", F.col("last_modified").alias("_known"))
    return scan.join(known, ["repo_id", "file_path"], "left").filter(F.col("_known").isNull() | (F.col("_known") != F.col("last_modified"))).drop("_known")


class ConcurrentWrite(RuntimeError):
    """Another writer made the next version of a store first; read again and repeat."""


class GraphStore:
    """Parquet snapshots under a root: elements by repo_id and file, edges by edge_type, repos and file_index whole, postings of the elements' texts by range of terms. Elements are kept once more by id (by_id), and each edge once more for either end (adjacency), in buckets of ids and sorted within, so what is known of one id is read from one bucket.

    A table is a base and layers over it: a change of files or of a repository writes its new rows and the keys of the rows below that it hides, and nothing of the rest. Beyond ``LAYERS`` layers they are merged into one, and into the base once they hold a quarter of its bytes.

    A write makes new folders beside those being read, and then one small file that names the folders of all tables. The file of a version is created only if it isn't there, so readers never see half a write and of two writers one fails. The version before stays for those who read it; older folders are deleted.
    """

    PARTS = {"elements": ["repo_id"], "edges": ["edge_type"], "repos": [], "file_index": [], "postings": ["bucket"], "posting_stats": [], "by_id": ["bucket"], "adjacency": ["bucket"]}
    #: The order of rows within a folder, by which readers skip.
    SORTED = {"elements": ["repo_id", "file_path", "id"], "edges": ["edge_type", "from_id"], "by_id": ["bucket", "id"], "adjacency": ["bucket", "node", "way", "edge_type"], "postings": ["bucket", "term"]}
    #: Columns of a table that are held, one set after the other, against the hidden keys (id, or repo_id and file_path).
    HIDDEN_BY = {"elements": [{"id": "id"}], "postings": [{"id": "id"}], "edges": [{"from_id": "id"}, {"to_id": "id"}], "file_index": [{"repo_id": "repo_id", "file_path": "file_path"}], "by_id": [{"id": "id"}], "adjacency": [{"node": "id"}, {"other": "id"}]}
    BUCKETS = 64
    LAYERS = 8
    #: Repositories or files of one change up to which a scan is told their names, so that it opens no other's.
    PRUNED = 100

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(f"{self.root}/current").getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/current")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))

    def _tables(self, version: int) -> dict[str, tuple[list[list[str | None]], str]]:
        """name -> (layers of (folder, folder of hidden keys), schema), the base first."""
        if not version:
            return {}
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/current/v{version}").first()[0]
        return {k: tuple(v) for k, v in json.loads(text).items()}

    def _current(self) -> tuple[int, dict[str, tuple[list[list[str | None]], str]]]:
        version = max(self._versions(), default=0)
        return version, self._tables(version)

    def read(self, name: str) -> DataFrame | None:
        found = self._current()[1].get(name)
        return self._visible(name, *found) if found else None

    def _visible(self, name: str, layers: list[list[str | None]], schema: str) -> DataFrame:
        """The rows of each layer that no later one hides."""
        read = self.spark.read.schema(T.StructType.fromJson(json.loads(schema)))
        if len(layers) == 1:
            return read.parquet(layers[0][0])
        rows = reduce(DataFrame.unionByName, (read.parquet(p).withColumn("_layer", F.lit(i)) for i, (p, _) in enumerate(layers)))
        hidden = reduce(DataFrame.unionByName, (self.spark.read.parquet(g).withColumn("_from", F.lit(i)) for i, (_, g) in enumerate(layers) if i))
        if name in ("edges", "adjacency"):
            hidden = hidden.filter("victim")
        for columns in self.HIDDEN_BY[name]:
            last = hidden.groupBy(*(F.col(k).alias(f"_{k}") for k in columns.values())).agg(F.max("_from").alias("_from"))
            same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{k}") for c, k in columns.items()))
            rows = rows.join(last, same & (F.col("_layer") < F.col("_from")), "left_anti")
        return rows.drop("_layer")

    def _put(self, name: str, version: int, df: DataFrame) -> str:
        path, parts = f"{self.root}/{name}/v{version}-{uuid.uuid4().hex[:8]}", self.PARTS.get(name)
        if parts:
            df = df.hint("rebalance", *parts)
            order = [c for c in self.SORTED.get(name, []) if c in df.columns]
            (df.sortWithinPartitions(*order) if order else df).write.partitionBy(*parts).parquet(path)
        else:
            df.write.parquet(path)
        return path

    @staticmethod
    def _folders(tables: dict[str, tuple[list[list[str | None]], str]]) -> set[str]:
        return {p for layers, _ in tables.values() for layer in layers for p in layer if p}

    def _commit(self, version: int, kept: dict, new: dict) -> None:
        """Make ``version`` of the tables kept and new; where it is there already the new folders go."""
        made = self._folders(new) - self._folders(kept)
        body = bytearray(json.dumps(kept | new).encode())
        try:
            out = self._fs.create(self._path(f"{self.root}/current/v{version}"), False)
        except Exception as e:
            for path in made:
                delete_path(self.spark, path)
            raise ConcurrentWrite(f"version {version} of {self.root} is there already") from e
        out.write(body)
        out.close()
        for old in self._versions()[:-2]:
            needed = self._folders(self._tables(version - 1)) | self._folders(self._tables(version))
            for path in self._folders(self._tables(old)) - needed:
                delete_path(self.spark, path)
            delete_path(self.spark, f"{self.root}/current/v{old}")

    def write(self, **tables: DataFrame) -> None:
        """All tables of one call become current together; postings follow the elements unless they are given."""
        version, kept = self._current()
        if "elements" in tables:
            tables = {"postings": self._posts(tables["elements"]), "posting_stats": text.field_stats(tables["elements"]), "by_id": self._by_id(tables["elements"])} | tables
        if "edges" in tables:
            tables = {"adjacency": self._adjacency(tables["edges"])} | tables
        self._commit(version + 1, kept, {n: ([[self._put(n, version + 1, df), None]], df.schema.json()) for n, df in tables.items()})

    def _posts(self, elements: DataFrame) -> DataFrame:
        return text.postings(elements).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))

    def _bucket(self, id: Column) -> Column:
        return F.pmod(F.xxhash64(id), F.lit(self.BUCKETS)).cast("int")

    def _by_id(self, elements: DataFrame) -> DataFrame:
        return elements.withColumn("bucket", self._bucket(F.col("id")))

    def _adjacency(self, edges: DataFrame) -> DataFrame:
        """Each edge at both of its ends."""
        rest = [c for c in edges.columns if c not in ("from_id", "to_id")]
        end = lambda a, b, way: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(way).alias("way"), *rest)
        return end("from_id", "to_id", "OUTGOING").unionByName(end("to_id", "from_id", "INCOMING")).withColumn("bucket", self._bucket(F.col("node")))

    def _near(self, name: str, key: str, ids: list[str]) -> DataFrame | None:
        """Rows of a bucketed table by ids: only their buckets are read, and of those the pages where they may be."""
        found = self.read(name)
        if found is None:
            return None
        hit = reduce(lambda a, b: a | b, ((F.col("bucket") == self._bucket(F.lit(i))) & (F.col(key) == i) for i in ids), F.lit(False))
        return found.filter(hit)

    def elements_of(self, ids: list[str]) -> DataFrame:
        found = self._near("by_id", "id", ids)
        return self.read("elements").filter(F.col("id").isin(ids)) if found is None else found.drop("bucket")

    def edges_of(self, ids: list[str], direction: str = "BOTH") -> DataFrame:
        """Edges that touch one of the ids on its outgoing, incoming or either side, each once."""
        found = self._near("adjacency", "node", ids)
        if found is None:
            out, back = F.col("from_id").isin(ids), F.col("to_id").isin(ids)
            return self.read("edges").filter({"OUTGOING": out, "INCOMING": back}.get(direction, out | back))
        out = F.col("way") == "OUTGOING"
        if direction != "BOTH":
            found = found.filter(F.col("way") == direction)
        else:  # an edge between two of the ids is there at both ends
            found = found.filter(out | ~F.col("other").isin(ids))
        ends = {"from_id": F.when(out, F.col("node")).otherwise(F.col("other")), "to_id": F.when(out, F.col("other")).otherwise(F.col("node"))}
        return found.withColumns(ends).drop("node", "other", "way", "bucket")

    def postings(self, terms: list[str]) -> tuple[DataFrame, DataFrame] | None:
        """(postings of the terms, statistics of the fields): only the buckets of the terms are read."""
        found = self.read("postings")
        if found is None:
            return None
        hit = reduce(lambda a, b: a | b, ((F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(self.BUCKETS)).cast("int")) & (F.col("term") == t) for t in terms), F.lit(False))
        return found.filter(hit), self.read("posting_stats")

    def _replace(self, files: DataFrame, keys: list[str], elements: DataFrame, edges: DataFrame, index: DataFrame | None, **whole: DataFrame) -> None:
        """A layer over each table: elements of the same ``keys`` as ``files`` are hidden with all edges that touch them, elements of the same ids are replaced; ``whole`` tables are written anew. Ids belong to one repository."""
        version, kept = self._current()
        n, new = version + 1, {}
        e, g = self.read("elements"), self.read("edges")
        over = lambda name, path, gone: new.update({name: ([*kept[name][0], [path, gone]], kept[name][1])})
        files = files.select(*keys).distinct()
        put = self._put("elements", n, elements.select(*e.columns))
        made = self._visible("elements", [[put, None]], kept["elements"][1])
        repos = [r[0] for r in files.select("repo_id").union(made.select("repo_id")).distinct().limit(self.PRUNED + 1).collect()]
        near = e.filter(F.col("repo_id").isin(repos)) if len(repos) <= self.PRUNED else e
        own = near
        if "file_path" in keys:
            paths = [r[0] for r in files.select("file_path").distinct().limit(self.PRUNED + 1).collect()]
            own = near.filter(F.col("file_path").isin(paths)) if len(paths) <= self.PRUNED else near
        victims = own.join(files, keys, "left_semi").select("id", F.lit(True).alias("victim")).unionByName(made.select("id", F.lit(False).alias("victim")))
        gone = self._put("hidden", n, victims.groupBy("id").agg(F.max("victim").alias("victim")))
        hidden = self.spark.read.parquet(gone)
        over("elements", put, gone)

        # Of the new edges those that are there already, and stay, aren't written again.
        ends, by = hidden.filter("victim").select("id"), ["from_id", "edge_type", "to_id"]
        fresh = valid_edges(edges.select(*g.columns))
        if "adjacency" in kept:  # only the buckets where the new edges begin
            fresh = materialize(fresh)
            buckets = [r[0] for r in fresh.select(self._bucket(F.col("from_id"))).distinct().collect()]
            there = self.read("adjacency").filter(F.col("bucket").isin(buckets) & (F.col("way") == "OUTGOING")).select(F.col("node").alias("from_id"), "edge_type", F.col("other").alias("to_id"))
        else:
            there = g.select(*by)
        same = there.join(fresh.select(*by), by, "left_semi")
        same = same.join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        put = self._put("edges", n, fresh.join(same, by, "left_anti"))
        over("edges", put, gone)
        if "adjacency" in kept:
            added = self._visible("edges", [[put, None]], kept["edges"][1])
            over("adjacency", self._put("adjacency", n, self._adjacency(added).select(*self.read("adjacency").columns)), gone)
        if "by_id" in kept:
            over("by_id", self._put("by_id", n, self._by_id(made).select(*self.read("by_id").columns)), gone)

        if "postings" in kept:
            over("postings", self._put("postings", n, self._posts(made).select(*self.read("postings").columns)), gone)
            signed = lambda stats, by: stats.select("field", (F.col("docs") * by).alias("docs"), (F.col("total") * by).alias("total"))
            parts = (signed(self.read("posting_stats"), 1), signed(text.field_stats(near.join(hidden, "id", "left_semi")), -1), signed(text.field_stats(made), 1))
            whole["posting_stats"] = reduce(DataFrame.unionByName, parts).groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).filter("docs > 0")
        if "file_index" in kept:
            known = self.read("file_index")
            rows = known.limit(0) if index is None else index.select(*known.columns)
            over("file_index", self._put("file_index", n, rows), self._put("hidden", n, known.join(files, keys, "left_semi").select("repo_id", "file_path")))
        elif index is not None:
            whole["file_index"] = index
        new |= {name: ([[self._put(name, n, df), None]], df.schema.json()) for name, df in whole.items()}
        self._commit(n, kept, new)
        if any(len(layers) > self.LAYERS for layers, _ in new.values()):
            self.compact()

    def _bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def compact(self) -> None:
        """Merge the layers of each table into one, or into the base where they hold a quarter of its bytes. A writer that comes first leaves them as they are, for the next time."""
        version, kept = self._current()
        new = {}
        for name, (layers, schema) in kept.items():
            base, *rest = layers
            if not rest:
                continue
            if 4 * sum(self._bytes(p) for p, _ in rest) >= self._bytes(base[0]):
                new[name] = ([[self._put(name, version + 1, self._visible(name, layers, schema)), None]], schema)
            elif len(rest) > 1:
                keys = reduce(DataFrame.unionByName, (self.spark.read.parquet(g) for _, g in rest))
                keys = keys.groupBy("id").agg(F.max("victim").alias("victim")) if "victim" in keys.columns else keys.distinct()
                new[name] = ([base, [self._put(name, version + 1, self._visible(name, rest, schema)), self._put("hidden", version + 1, keys)]], schema)
        try:
            self._commit(version + 1, kept, new)
        except ConcurrentWrite:
            return

    def replace_files(self, files: DataFrame, elements: DataFrame, edges: DataFrame, index: DataFrame | None = None) -> None:
        """Delete what came from ``files`` and put the new rows in, in postings and file_index (``index``: its new rows) too."""
        if "elements" not in self._current()[1]:
            self.write(elements=elements, edges=valid_edges(edges), **({"file_index": index} if index is not None else {}))
        else:
            self._replace(files, ["repo_id", "file_path"], elements, edges, index)

    def replace_repo(self, repo_id: str, elements: DataFrame, edges: DataFrame, index: DataFrame) -> None:
        """As ``replace_files``, of all that a repository holds."""
        if "elements" not in self._current()[1]:
            self.write(elements=elements, edges=valid_edges(edges), file_index=index)
        else:
            self._replace(self.spark.createDataFrame([(repo_id,)], "repo_id string"), ["repo_id"], elements, edges, index)

    def set_repo(self, row: DataFrame) -> None:
        """A row of repos in place of that of its id."""
        repos = self.read("repos")
        self.write(repos=row if repos is None else upsert(repos, row.select(*repos.columns), ["id"]))

    def remove_repo(self, repo_id: str) -> None:
        """Its elements, their edges and postings, its indexed files and its row."""
        repos = self.read("repos")
        whole = {} if repos is None else {"repos": repos.filter(F.col("id") != repo_id)}
        self._replace(self.spark.createDataFrame([(repo_id,)], "repo_id string"), ["repo_id"], self.read("elements").limit(0), self.read("edges").limit(0), None, **whole)
