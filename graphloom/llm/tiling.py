"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matches."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, columns_kept, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a test counts for beside its text where their size is bounded, so that very many small ones count too.
ROW_BYTES = 64
WORD = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)
_ADDED = ("_coverage", "_item", "_tiles")


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def karp_rabin(ids: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-token window, modulo 2**64, by doubling; none if there are fewer tokens."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    h, size, out, done = ids.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                n = len(h) - done
                out = out[:n] * np.uint64(pow(int(_BASE), size, 1 << 64)) + h[done : done + n]
                done += size
        if size * 2 > k:
            return out[: len(ids) - k + 1]
        h = h[:-size] * np.uint64(pow(int(_BASE), size, 1 << 64)) + h[size:]
        size *= 2


def _free(used: np.ndarray, k: int) -> np.ndarray:
    """Whether each k-token window holds no used token."""
    total = np.r_[0, np.cumsum(used)]
    return total[k:] == total[:-k]


def _common(a: np.ndarray, b: np.ndarray, used_a: np.ndarray, used_b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts in a, hashes of all of a): the free k-token windows of a that b has free as well."""
    ha = karp_rabin(a, k)
    return np.flatnonzero(_free(used_a, k) & np.isin(ha, karp_rabin(b, k)[_free(used_b, k)])), ha


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> tuple[int, int]:
    """(tokens of the item that tiles cover, tiles), for arrays of token ids.

    Greedy string tiling: the longest match whose tokens are free on both sides is marked, again and again, down to k tokens. The longest length is found by halving over Karp-Rabin hashes of all windows of a length; matches of that length are marked in order of their places in the text, then in the item. So a round costs a few passes over both arrays, however often tokens repeat.
    """
    used_doc, used_item, marked, tiles, longest = np.zeros(len(doc), bool), np.zeros(len(item), bool), 0, 0, min(len(doc), len(item))
    while longest >= k:
        low, high = k - 1, longest
        while low < high:  # a common window of n tokens holds common windows of all fewer
            n = (low + high + 1) // 2
            if len(_common(doc, item, used_doc, used_item, n)[0]):
                low = n
            else:
                high = n - 1
        if low < k:
            break
        longest = n = low
        starts, h = _common(doc, item, used_doc, used_item, n)
        hi = karp_rabin(item, n)
        order = np.argsort(hi, kind="stable")
        ranked, end = hi[order], 0
        done: dict[int, int] = {}  # by hash: how many of its places in the item are behind
        hit = False
        for d in starts.tolist():
            if d < end:
                continue
            x = int(h[d])
            i = done.get(x)
            if i is None:
                i = int(np.searchsorted(ranked, h[d]))
            while i < len(ranked) and int(ranked[i]) == x:
                p = int(order[i])
                i += 1
                if not used_item[p : p + n].any() and (doc[d : d + n] == item[p : p + n]).all():
                    used_doc[d : d + n] = used_item[p : p + n] = True
                    marked, tiles, end, hit = marked + n, tiles + 1, d + n, True
                    break
            done[x] = i
        if not hit:  # two windows of one hash
            longest -= 1
    return marked, tiles


class Items:
    """An index of the tests' k-token windows: seeds of matches. A test of fewer than k tokens has one seed, all of it."""

    def __init__(self, rows: list[tuple], k: int):
        """rows: (order, text); of equal coverage the lower order wins."""
        self.vocabulary, self.items = {}, []
        found: dict[int, dict[int, list[int]]] = {}
        for name, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], np.uint64)
            if not len(ids):
                continue
            size = min(k, len(ids))
            for h in dict.fromkeys(karp_rabin(ids, size).tolist()):
                found.setdefault(size, {}).setdefault(h, []).append(len(self.items))
            self.items.append((name, ids, size))
        self.seeds = {size: (np.array(sorted(places), np.uint64), places) for size, places in found.items()}

    def match(self, text: str | None) -> tuple[float, object, int]:
        """(highest share of a test's tokens that tiles cover, the order of that test, its tiles)."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens(text)], np.uint64)
        best = (0.0, None, 0)
        if not ids.any():
            return best
        shared: dict[int, set[int]] = {}
        for size, (seeds, places) in self.seeds.items():
            h = np.unique(karp_rabin(ids, size))
            at = np.searchsorted(seeds, h)
            for x in h[seeds[np.minimum(at, len(seeds) - 1)] == h].tolist():
                for i in places[x]:
                    shared.setdefault(i, set()).add(x)
        bounds = []
        for i, own in shared.items():  # only tokens under a shared seed can be covered
            name, item, size = self.items[i]
            cover = np.zeros(len(item) + 1, np.int64)
            at = np.flatnonzero(np.isin(karp_rabin(item, size), np.fromiter(own, np.uint64, len(own))))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            bounds.append((-int((np.cumsum(cover) > 0).sum()) / len(item), name, i))
        for bound, name, i in sorted(bounds):
            if -bound < best[0] or -bound == best[0] and best[1] is not None and best[1] < name:
                break
            n, tiles = tile(ids, self.items[i][1], self.items[i][2])
            share = n / len(self.items[i][1])
            if share > best[0] or share == best[0] and share and name < best[1]:
                best = (share, name, tiles)
        return best


def _held(docs: DataFrame, rows: list[tuple], text_col: str, k: int) -> DataFrame:
    """docs with (_coverage, _n, _tiles), all tests in every task."""

    def run(batches):
        index = Items(rows, k)
        for b in batches:
            found = list(zip(*map(index.match, b.column(b.schema.get_field_index(text_col)).to_pylist()))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(found, (pa.float64(), pa.int64(), pa.int64())))], [*b.schema.names, "_coverage", "_n", "_tiles"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string("_coverage double, _n bigint, _tiles bigint").fields]))


def _seeds(rows: DataFrame, k: int, sizes: list[int] | None) -> DataFrame:
    """rows (n, t) -> (n, h, w, s): the distinct hashes of their k-token windows and sizes; for tests (no ``sizes``) those of their seeds, with how many tokens of the test such windows may cover, and how many it has."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for b in batches:
            ns, hs, ws, lengths = [], [], [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([digest(w.encode("utf-8", "surrogatepass"), 42) for w in tokens(t)], np.uint64)
                for size in sizes or [min(k, len(ids))]:
                    if size:
                        h, times = np.unique(karp_rabin(ids, size) + np.uint64(size), return_counts=True)
                        ns += [n] * len(h)
                        hs += h.view(np.int64).tolist()
                        ws += (times * size).tolist()
                        lengths += [len(ids)] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ns, hs, ws, lengths)], ["n", "h", "w", "s"])

    return rows.mapInArrow(run, "n bigint, h bigint, w bigint, s bigint")


def _joined(docs: DataFrame, tests: DataFrame, text_col: str, k: int) -> DataFrame:
    """As ``_held``, for tests too large to hold: seeds of both sides are joined on the executors and only counted by pair, which bounds what a test's tiles can cover. Each text is tiled with the test of its highest bound, and then only with those whose bound is above what that gave; so few texts travel, and none of the best is missed."""
    docs = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    texts = docs.select(F.col("_row").alias("d"), F.col(text_col).alias("x"))

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([min(k, len(tokens(t))) for t in b.column(0).to_pylist()], pa.int32())], ["s"])

    sizes = sorted(r["s"] for r in tests.select("t").mapInArrow(lengths, "s int").distinct().collect() if r["s"])  # at most k
    found = materialize(_seeds(tests, k, None))
    own = _seeds(texts.withColumnsRenamed({"d": "n", "x": "t"}), k, sizes).select(F.col("n").alias("d"), "h")
    pairs = own.join(found, "h").groupBy("d", "n").agg((F.sum("w") / F.max("s")).alias("bound"))
    pairs = materialize(pairs.withColumn("bound", F.least(F.lit(1.0), "bound")))

    def run(batches):
        for b in batches:
            d, n, t, x = (c.to_pylist() for c in b.columns)
            got = [Items([(0, test)], k).match(text) for test, text in zip(t, x)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], ["d", "n", "c", "t"])

    tiled = lambda some: materialize(some.select("d", "n").join(tests, "n").join(texts, "d").select("d", "n", "t", "x").mapInArrow(run, "d bigint, n bigint, c double, t bigint"))
    first = tiled(pairs.groupBy("d").agg(F.min(F.struct((-F.col("bound")).alias("b"), "n")).alias("o")).select("d", "o.n"))
    had = first.select("d", F.col("n").alias("n1"), F.col("c").alias("c1"))
    rest = pairs.join(had, "d").filter((F.col("n") != F.col("n1")) & ((F.col("bound") > F.col("c1")) | (F.col("bound") == F.col("c1")) & (F.col("n") < F.col("n1"))))
    best = first.unionByName(tiled(rest)).filter("c > 0").groupBy("d").agg(F.min(F.struct((-F.col("c")).alias("c"), "n", "t")).alias("b"))
    out = docs.join(best, F.col("_row") == F.col("d"), "left")
    return out.select(*(c for c in docs.columns if c != "_row"), F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("_coverage"), F.col("b.n").alias("_n"), F.coalesce("b.t", F.lit(0)).cast("bigint").alias("_tiles"))


@columns_kept("_coverage", "_item", "_tiles", inner=("_n", "_row", "_m", "d", "b"))
def decontaminate(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shortest: int = 5, held_bytes: int = BROADCAST_BYTES // 8) -> DataFrame:
    """docs with ``_coverage`` (highest share of one test's tokens that tiles of at least ``shortest`` tokens cover), ``_item`` (its id; of equal shares the least, null first) and ``_tiles``.

    Tokens are lower-cased runs of word characters, so case and punctuation don't hide a passage, and tiles may come in any order. A test of fewer tokens than ``shortest`` is covered where all of it occurs; one without tokens (null and empty too) never is. Null and empty texts have coverage 0; repeated rows and other columns stay; an empty table gives none.
    Tests of up to ``held_bytes`` bytes in all, 64 a test counted in, go to every task, and texts take one narrow pass. Larger ones never come to the driver: seeds of both sides are joined. The rows are the same either way.
    """
    given = tests.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    ordered = materialize(given.orderBy(F.col("i").asc_nulls_first(), "t").withColumn("n", F.monotonically_increasing_id()))
    total = ordered.agg(F.sum(F.octet_length("t").cast("bigint") + ROW_BYTES).alias("b")).first()["b"] or 0
    if total <= held_bytes:
        out = _held(docs, [(r["n"], r["t"]) for r in ordered.select("n", "t").collect()], text_col, shortest)
    else:
        out = _joined(docs, ordered.select("n", "t"), text_col, shortest)
    names = ordered.select(F.col("n").alias("_m"), F.col("i").alias("_item"))
    named = out.join(F.broadcast(names) if total <= held_bytes else names, F.col("_n") == F.col("_m"), "left")
    return named.select(*docs.columns, "_coverage", "_item", "_tiles")
