"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

import sys
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import connected_components
from .common import columns_kept, materialize, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a tile within a task, and of the parts that a large block is cut into; bytes of shingle hashes that such a part holds in the exact check.
TILE, PART, PART_BYTES = 256, 4096, 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, A-Z lower-cased, repeats included; fewer words: of all of them; none: empty."""
    w = [x.lower() for x in words(text)]
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(x) + 1 for x in w]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(w) - k + 1)


def _remixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(((seed + 1) * 0x632BE59BD9B4E019) & ((1 << 64) - 1))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """``width`` 64-bit words as signed integers; a bit is 1 if set in over half the hashes, no hashes give zeros. Words after the first take remixed hashes."""
    out = []
    for i in range(width):
        h = _remixed(hashes, -i - 1) if i else hashes
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(np.ascontiguousarray(h[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]) if len(h) else 0)
    return out


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3, width: int = 1, minhashes: int = 0, sets: bool = False) -> DataFrame:
    """The columns ``keep`` with (_fp array<bigint>, _mins array<bigint>): the fingerprint, and the least remixed hash under each of ``minhashes`` seeds. With ``sets`` each shingle counts once, and also (_own bigint, _size bigint): a hash of the set of shingles and their number."""
    more = T._parse_datatype_string("_fp array<bigint>, _mins array<bigint>" + ", _own bigint, _size bigint" * sets).fields
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.int64(), pa.int64()] * sets

    def run(batches):
        for b in batches:
            cols = [[] for _ in kinds]
            for t in b.column(len(b.schema) - 1).to_pylist():
                h = np.unique(shingle_hashes(t, shingle)) if sets else shingle_hashes(t, shingle)
                cols[0].append(fingerprint(h, width))
                cols[1].append([int(_remixed(h, s).view(np.int64).min()) if len(h) else s for s in range(minhashes)])
                if sets:
                    cols[2].append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)))
                    cols[3].append(len(h))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keep, *(f.name for f in more)])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *more]))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduce(np.add, (np.bitwise_count(a[:, None, i] ^ b[None, :, i]).astype(np.uint16) for i in range(a.shape[1])))


def linked(fp: np.ndarray, radius: int) -> np.ndarray:
    """For rows of words: the index of the first row of each row's component under links of at most ``radius`` bits.

    Rows are tiled in order of their population counts; tile pairs whose counts lie further apart than the radius are skipped.
    """
    count = reduce(np.add, (np.bitwise_count(fp[:, i]).astype(np.int64) for i in range(fp.shape[1])))
    order = np.argsort(count, kind="stable")
    a, pc, n = fp[order], count[order], len(fp)
    label = np.arange(n)
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            if pc[j] - pc[min(i + TILE, n) - 1] > radius:
                break
            x, y = np.nonzero(_distance(a[i : i + TILE], a[j : j + TILE]) <= radius)
            p, q = label[x + i], label[y + j]
            if not (p != q).any():
                continue
            pairs, parent = np.unique(np.stack([p, q], 1)[p != q], axis=0), {}

            def find(v, parent=parent):
                while v in parent:
                    v = parent[v]
                return v

            for u, v in pairs.tolist():
                if (u := find(u)) != (v := find(v)):
                    parent[max(u, v)] = min(u, v)
            if parent:
                keys = np.fromiter(parent, np.int64)
                to = np.arange(n)
                to[keys] = [find(k) for k in keys.tolist()]
                label = to[label]
    first, back = np.full(n, n), np.empty(n, np.int64)
    np.minimum.at(first, label, order)
    back[order] = first[label]
    return back


def _forest(width: int, radius: int):
    """Sorted rows (block, fp) -> for each block a forest of links; a block of parts holds at most two parts."""

    def close(block: np.ndarray, fp: np.ndarray):
        cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]).any(axis=1)])
        size = np.diff(np.r_[cut, len(block)])
        for n in np.unique(size[size > 1]).tolist():
            at = cut[size == n]
            if n <= 8:  # all blocks of one small size at once
                rows = fp[at[:, None] + np.arange(n)]
                for i, j in combinations(range(n), 2):
                    d = np.bitwise_count(rows[:, i] ^ rows[:, j]).sum(axis=1, dtype=np.int64)
                    yield rows[d <= radius, i], rows[d <= radius, j]
            else:
                for s in at.tolist():
                    own = fp[s : s + n]
                    root = linked(own, radius)
                    moved = root != np.arange(n)
                    yield own[moved], own[root[moved]]

    def run(batches):
        kept = []
        for b in (*batches, None):
            if b is not None:
                if not len(b):
                    continue
                kept.append((b[["k", "c", "p", "q"]].to_numpy(np.int64), np.stack(b["fp"].to_numpy()).astype(np.int64)))
                block, fp = (np.concatenate(x) for x in zip(*kept))
                last = int(np.flatnonzero((block != block[-1]).any(axis=1)).max(initial=-1)) + 1
                kept = [(block[last:], fp[last:])]
                block, fp = block[:last], fp[:last]
            elif kept:
                block, fp = (np.concatenate(x) for x in zip(*kept))
            else:
                return
            if not len(block):
                continue
            for x, y in close(block, fp.view(np.uint64).reshape(-1, width)):
                if len(x):
                    yield pd.DataFrame({"a": list(x.view(np.int64)), "b": list(y.view(np.int64))})

    return run


def near_links(rows: DataFrame, radius: int, width: int = 1) -> DataFrame:
    """rows (block columns k, c; fp) -> links (a, b) between fingerprints of one block that differ in at most ``radius`` bits, thinned to a forest.

    Blocks of one fingerprint go. A block over PART rows is cut by population count into bands about half a radius wide, and a band over PART rows by hash; each pair of parts whose counts come within the radius goes to a task of its own, so no task gathers a large block and distant parts never meet. A block has few bands, as many as there are counts at most.
    """
    step = max(1, (radius + 1) // 2)
    rows = materialize(rows.groupBy("k", "c", "fp").agg(F.lit(1).alias("_one")).drop("_one").withColumn("band", F.expr(f"aggregate(fp, 0, (n, x) -> n + bit_count(x)) div {step}").cast("int")))
    sizes = rows.groupBy("k", "c", "band").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("k", "c").agg(F.sum("n").alias("n"), F.collect_list(F.struct("band", F.ceil(F.col("n") / PART).cast("int").alias("parts"))).alias("bands")).filter("n > 1")
    whole = F.col("n") <= PART
    parts = F.filter("bands", lambda b: b["band"] == F.col("band"))[0]["parts"]
    cut = rows.join(bands, ["k", "c"]).select("k", "c", "fp", "n", "bands", F.when(whole, 0).otherwise(F.col("band")).alias("band"), F.when(whole, 0).otherwise(F.pmod(F.xxhash64(F.lit(7), "fp"), parts)).alias("s"))
    tile = lambda band, part: band.cast("bigint") * (1 << 32) + part
    near = F.filter("bands", lambda b: (F.abs(b["band"] - F.col("band")) - 1) * step < radius)
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), b["parts"] - 1), lambda i: tile(b["band"], i))))
    own = tile(F.col("band"), F.col("s"))
    spread = cut.select("k", "c", "fp", own.alias("s"), F.explode(F.when(whole, F.array(own)).otherwise(others)).alias("t")).select("k", "c", F.least("s", "t").alias("p"), F.greatest("s", "t").alias("q"), "fp")
    return spread.repartition("k", "c", "p", "q").sortWithinPartitions("k", "c", "p", "q").mapInPandas(_forest(width, radius), "a array<bigint>, b array<bigint>")


def bit_blocks(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Blocks that lose no pair: two words within ``radius`` bits agree on at least blocks - radius of ``blocks`` bit ranges."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edge[i + 1]) - (1 << edge[i]) for i in some) for some in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("c"), F.col("fp")[0].bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for i, m in enumerate(signed)))).alias("x")).select("x.k", "x.c", "fp")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have at least this Jaccard similarity; two empty ones have 1."""
    least, most = sorted((len(a), len(b)))
    if least < similarity * most - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (least + most - both) - 1e-9


def _stars(shingle: int, similarity: float):
    """Rows sorted by (root, part, kind), the pivot of a group (kind 0) ahead of its members -> the members with ``core``: similar to the pivot."""

    def run(batches):
        pivot = np.zeros(0, np.uint64)
        for b in batches:
            core = []
            for kind, t in zip(b["kind"], b["text"]):
                own = np.unique(shingle_hashes(t, shingle))
                if kind == 0:
                    pivot = own
                core.append(kind == 1 and _similar(pivot, own, similarity))
            yield b.assign(core=core)[b["kind"] == 1].drop(columns="kind")

    return run


def _grid(shingle: int, similarity: float, radius: int):
    """Rows sorted by (root, a, r) -> for each such group the links between its rows of kind 0 (a part of all rows) and of kind 1 (a part of those unlike the pivot), thinned to a forest."""

    def close(rows):
        every, rest = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        parent: dict[int, int] = {}

        def find(v):
            while v in parent:
                v = parent[v]
            return v

        core = [r[1] for r in every if r[2]]
        parent |= {v: core[0] for v in core[1:]}  # linked by way of the pivot
        for i in range(0, len(every), TILE):
            x = every[i : i + TILE]
            for j in range(0, len(rest), TILE):
                y = rest[j : j + TILE]
                for p, q in zip(*np.nonzero(_distance(np.stack([r[3] for r in x]), np.stack([r[3] for r in y])) <= radius)):
                    u, v = x[p][1], y[q][1]
                    if (s := find(u)) != (t := find(v)) and _similar(x[p][4], y[q][4], similarity):
                        parent[t] = s
                        yield u, v

    def run(batches):
        key, rows, links = None, [], []
        for b in batches:
            for root, a, r, kind, row, core, fp, t in zip(b["root"], b["a"], b["r"], b["kind"], b["row"], b["core"], b["fp"], b["text"]):
                if (root, a, r) != key:
                    links += close(rows)
                    key, rows = (root, a, r), []
                rows.append((kind, row, core, np.asarray(fp, np.int64).view(np.uint64), np.unique(shingle_hashes(t, shingle))))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []
        if links := list(close(rows)):
            yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _parts(n, size):
    return F.ceil(F.greatest(n / PART, size / PART_BYTES)).cast("int")


def exact_links(reps: DataFrame, texts: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """reps (root, row, fp, size) and texts (row, text) -> links (a, b) between rows of one root whose shingle sets have the Jaccard similarity, thinned, no component lost.

    Each root's rows are held against one of them, the pivot. Rows like it are linked by it and need no comparison among themselves; only the others are held against all rows of the root, where fingerprints lie within ``radius``. Both sides are cut by count and bytes into parts, so a group of near copies costs one comparison for each row and no task gathers it.
    """
    weight = F.sum(F.col("size") * 8 + 128)
    sizes = reps.groupBy("root").agg(F.count("*").alias("n"), weight.alias("w"), F.min("row").alias("pivot")).filter("n > 1")
    sizes = materialize(sizes.select("root", "pivot", _parts(F.col("n"), F.col("w")).alias("parts")))
    members = reps.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64(F.lit(7), "row"), F.col("parts")).cast("int"))
    pivots = reps.join(sizes, reps["row"] == sizes["pivot"]).drop(sizes["root"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["root", "part", "parts", "pivot", "row", "fp", "size"]
    both = members.select(*columns, F.lit(1).alias("kind")).unionByName(pivots.select(*columns, F.lit(0).alias("kind"))).join(texts, "row")
    flags = both.repartition("root", "part").sortWithinPartitions("root", "part", "kind").mapInPandas(_stars(shingle, similarity), both.drop("kind").schema.add("core", "boolean"))
    flags = materialize(flags)
    rest = flags.filter("not core").groupBy("root").agg(_parts(F.count("*"), weight).alias("rests"), F.min("parts").alias("parts"))
    unlike = flags.join(rest.select("root", "rests", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["root", "part"])
    at = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = unlike.select("root", F.col("part").alias("a"), at("rests").alias("r"), F.lit(0).alias("kind"), "row", "core", "fp", "text")
    few = unlike.filter("not core").select("root", at("parts").alias("a"), F.pmod(F.xxhash64(F.lit(8), "row"), F.col("rests")).cast("int").alias("r"), F.lit(1).alias("kind"), "row", "core", "fp", "text")
    found = every.unionByName(few).repartition("root", "a", "r").sortWithinPartitions("root", "a", "r").mapInPandas(_grid(shingle, similarity, radius), "a bigint, b bigint")
    return flags.filter("core").select(F.col("row").alias("a"), F.col("pivot").alias("b")).unionByName(found)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """(id, fp bigint, component): each row's 64-bit fingerprint and the least id among all rows reachable over links of at most ``radius`` bits.

    Null and empty texts get fingerprint zero and link like others; repeated rows stay; a null id never names a component unless all its ids are null. An empty table gives none.
    Fingerprints, not documents, are compared, each distinct one once, so copies of a text cost one row.
    """
    fps = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", shingle).select("id", F.col("_fp").alias("fp")))
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    root = connected_components(near_links(bit_blocks(least.select("fp"), radius, blocks), radius))
    placed = materialize(least.join(root, least["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return fps.join(named, "fp").select("id", F.col("fp")[0].alias("fp"), "component")


def _similar_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, width: int, minhashes: int) -> tuple[DataFrame, DataFrame]:
    """(docs with _row and _fp, _own; the placed sets (fp, own, least, root)): see ``simhash_similar``."""
    radius = int(64 * width * (1 - similarity) + 1e-9)
    fps = materialize(fingerprints(docs, docs.columns, text_col, shingle, width, minhashes, sets=True).withColumn("_row", F.monotonically_increasing_id()))
    slim = fps.select(F.col(id_col).alias("id"), F.col("_fp").alias("fp"), F.col("_mins").alias("mins"), F.col("_own").alias("own"), F.col("_size").alias("size"), F.col("_row").alias("row"))
    blocks = slim.select("fp", F.posexplode("mins").alias("c", "k")).select("k", F.col("c").cast("bigint").alias("c"), "fp")
    near = connected_components(near_links(blocks, radius, width))
    reps = slim.groupBy("fp", "own").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.first("size").alias("size"))
    reps = materialize(reps.join(near, reps["fp"] == near["node"], "left").select("fp", "own", "least", "row", "size", F.xxhash64(F.coalesce("root", "fp")).alias("root")))
    alike = connected_components(exact_links(reps, fps.select(F.col("_row").alias("row"), F.col(text_col).alias("text")), shingle, similarity, radius))
    return fps, materialize(reps.drop("root").join(alike, reps["row"] == alike["node"], "left").select("fp", "own", "least", F.coalesce("root", "row").alias("root")))


@columns_kept(inner=("_fp", "_mins", "_own", "_size", "_row", "_text"))
def simhash_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, width: int = 8, minhashes: int = 6) -> DataFrame:
    """(id, component) under links between texts whose sets of shingles have at least this Jaccard similarity.

    Candidates are fingerprints of the sets, of 64 * width bits, of which at least that share agree, found by the tiled comparison: a pair of Jaccard similarity 0.8 differs in 78 of 512 bits on average with a deviation of 8, so about one in a thousand lies beyond the radius of 102. Pairs down to 0.65 get within it too, so within the groups that fingerprints make the sets themselves decide.

    At this radius bit ranges tell nothing apart, so tiles are made of rows that share the least hash under one of ``minhashes`` seeds: a pair of Jaccard similarity s is missed with probability (1 - s) ** minhashes (0.8 and 6 seeds: 0.00006).
    Null and empty texts have the empty set and link with each other; texts of fewer words than a shingle have one; repeated rows stay; a null id never names a component unless all its ids are null. An empty table gives none.
    """
    fps, placed = _similar_sets(docs, id_col, text_col, shingle, similarity, width, minhashes)
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "own", "component")
    return fps.select(F.col(id_col).alias("id"), F.col("_fp").alias("fp"), F.col("_own").alias("own")).join(named, ["fp", "own"]).select("id", "component")


@columns_kept(inner=("_fp", "_mins", "_own", "_size", "_row", "_text", "_kept_row"))
def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, width: int = 8, minhashes: int = 6) -> DataFrame:
    """docs with one row left of each group of ``simhash_similar``: that of least id (null last), then of least hash of the text, then the first as read.

    Rows, not ids, make groups: of rows with one id and unlike texts each stays or goes by its own group, and of wholly equal rows one stays. Other columns pass through; an empty table gives none.
    """
    fps, placed = _similar_sets(docs, id_col, text_col, shingle, similarity, width, minhashes)
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col("_row").alias("r"))
    least = fps.select(F.col("_fp").alias("fp"), F.col("_own").alias("own"), order.alias("o")).groupBy("fp", "own").agg(F.min("o").alias("o"))
    kept = placed.join(least, ["fp", "own"]).groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.r").alias("_kept_row"))
    return fps.join(kept, F.col("_row") == F.col("_kept_row"), "left_semi").drop("_fp", "_mins", "_own", "_size", "_row")
