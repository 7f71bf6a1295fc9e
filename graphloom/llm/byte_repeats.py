"""Suffix-array dedup: bytes under strings found twice, by bucket-pointer refinement of suffix buckets."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_kept, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the anchoring q-gram; window starts refined at once in a task; contexts of one q-gram up to which one task takes them.
GRAM, WORK, GROUP = 32, 1 << 20, 20_000
#: Documents whose contexts a task takes at once, and contexts that it holds before it hands them on; equal ones that it hands on apart are counted together later.
DOCUMENTS, CONTEXTS = 64, 40_000
_POS = 21
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-byte string, by doubling."""
    h, size, out, done = _TABLE[raw], 1, None, 0
    while True:
        if q & size:
            if out is None:
                out, done = h, size
            else:
                n = len(h) - done
                out = out[:n] * np.uint64(pow(_B, size, _M64 + 1)) + h[done : done + n]
                done += size
        if size * 2 > q:
            return out[: len(raw) - q + 1]
        h = h[:-size] * np.uint64(pow(_B, size, _M64 + 1)) + h[size:]
        size *= 2


def _pieces(texts: list[bytes], length: int):
    """(document index, offset, bytes) of at most 2**20 window starts, packed into buffers under 2**21 bytes."""
    pack, total = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), 1 << 20):
            own = t[at : at + (1 << 20) + length - 1]
            if total + len(own) >= 1 << _POS:
                yield pack
                pack, total = [], 0
            pack.append((i, at, own))
            total += len(own)
    if pack:
        yield pack


def anchors(texts: list[bytes], length: int):
    """For runs of window starts: (document, anchor, first start, last start, hash of the anchor's q-gram).

    A window of ``length`` bytes is anchored at its q-gram of least hash, the leftmost of equal ones: equal windows have equal q-grams at equal distances, wherever they stand.
    """
    for pack in _pieces(texts, length):
        raw = np.frombuffer(b"".join(x[2] for x in pack), np.uint8)
        sizes = np.array([len(x[2]) for x in pack])
        ends = np.cumsum(sizes)
        h = _mix(_gram_hashes(raw, GRAM))
        m = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        span, wide = 1, length - GRAM + 1
        while span * 2 <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < wide:
            m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
        own = np.repeat(np.arange(len(pack)), sizes)[: len(m)]
        at = np.flatnonzero(np.arange(len(m)) + length <= ends[own])
        a, own = (m[at] & np.uint64((1 << _POS) - 1)).astype(np.int64), own[at]
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (own[1:] != own[:-1])])
        last = at[np.r_[cut[1:], len(at)] - 1]
        own, a, lo = own[cut], a[cut], at[cut]
        shift = np.array([x[1] for x in pack])[own] - (ends - sizes)[own]
        yield np.array([x[0] for x in pack])[own], a + shift, lo + shift, last + shift, h[a].view(np.int64)


def refine(raw: np.ndarray, starts: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts`` share the next ``length`` bytes with another of them; ``left``: for each byte of ``raw`` the bytes from it to the end of its own context.

    Bucket-pointer refinement: each place points to the bucket of its q-gram. A round sorts the places whose bucket has others on (own bucket, bucket at the later offset) and writes the finer buckets back, so the next round finds at its later offset what this one has refined: buckets of s bytes become buckets of 2s, and at last of ``length``. Places alone in their bucket are left out for good, as is whoever meets one at the later offset.
    """
    q = min(length, max(GRAM, length // 4))
    pointer = np.full(len(raw), -1, np.int64)
    live, size = np.flatnonzero(left >= q), q
    if not len(live):
        return np.zeros(len(starts), bool)

    def settle(code: np.ndarray) -> np.ndarray:
        _, bucket, count = np.unique(code, return_inverse=True, return_counts=True)
        more = count[bucket] > 1
        pointer.fill(-1)
        pointer[live] = np.where(more, bucket, -1)
        return live[more]

    live = settle(_mix(_gram_hashes(raw, q))[live])
    while size < length and len(live):
        step = min(size, length - size)
        live = live[left[live] >= size + step]
        live = live[pointer[live + step] >= 0]
        live = settle(pointer[live] * len(raw) + pointer[live + step])
        size += step
    out = np.zeros(len(raw), bool)
    out[live] = True
    return out[starts]


def _runs(flag: np.ndarray) -> np.ndarray:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] - 1], 1)


def _group_runs(length: int):
    """Contexts sorted by key -> (key, ctx, runs): the window starts of each distinct context whose window is found elsewhere too."""

    def work(rows):
        key, ctx, off, n, text = (np.concatenate(x) if i < 4 else sum(x, []) for i, x in enumerate(zip(*rows)))
        order = np.lexsort((ctx, key))
        first = np.r_[True, (key[order][1:] != key[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])]
        group = np.cumsum(first) - 1
        count = np.bincount(group, weights=n[order])
        pick = order[first]
        sizes = np.array([len(text[i]) for i in pick])
        wins, begin = sizes - length + 1, np.cumsum(sizes) - sizes
        base = np.cumsum(wins) - wins
        at = np.arange(wins.sum()) - np.repeat(base, wins)
        left = np.repeat(begin + sizes, sizes) - np.arange(sizes.sum())
        hit = refine(np.frombuffer(b"".join(text[i] for i in pick), np.uint8), np.repeat(begin, wins) + at, left, length) | np.repeat(count > 1, wins)
        out = [_runs(hit[b : b + w]).ravel().tolist() for b, w in zip(base.tolist(), wins.tolist())]
        some = [i for i, x in enumerate(out) if x]
        return pa.RecordBatch.from_arrays([pa.array(key[pick][some]), pa.array(ctx[pick][some]), pa.array([out[i] for i in some], pa.list_(pa.int64()))], ["key", "ctx", "runs"])

    def run(batches):
        kept, size = [], 0
        for b in batches:
            own = (*(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)), b.column(4).to_pylist())
            kept.append(own)
            size += sum(map(len, own[4])) - (length - 1) * len(own[4])
            if size < WORK:
                continue
            key, cols = np.concatenate([x[0] for x in kept]), None
            last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1  # the last key's contexts may go on
            if not last:
                continue
            cols = [np.concatenate([x[i] for x in kept]) for i in range(4)] + [sum((x[4] for x in kept), [])]
            yield work([tuple(c[:last] for c in cols)])
            kept = [tuple(c[last:] for c in cols)]
            size = sum(map(len, kept[0][4])) - (length - 1) * len(kept[0][4])
        if kept and sum(len(x[0]) for x in kept):
            yield work(kept)

    return run


def _large_runs(contexts: DataFrame, length: int) -> DataFrame:
    """As _group_runs, for keys with so many contexts that one task must not take them: windows themselves are the buckets, counted map-side and joined back."""
    each = contexts.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.first("off").alias("off"), F.first("bytes").alias("bytes"))

    def run(batches):
        q = length // 4
        for b in batches:
            for key, ctx, n, off, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                g = _mix(_gram_hashes(np.frombuffer(text, np.uint8), max(q, length - 3 * q)))
                w = len(text) - length + 1
                h = (np.arange(w) - off + 4096).astype(np.uint64) + np.uint64(key & _M64)
                for s in (0, q, 2 * q, length - max(q, length - 3 * q)):
                    h = _mix(h * np.uint64(_B)) + g[s : s + w]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.full(w, x)) for x in (key, ctx, n)), pa.array(np.arange(w))], ["h", "key", "ctx", "n", "j"])

    wins = each.select("key", "ctx", "n", "off", "bytes").mapInArrow(run, "h bigint, key bigint, ctx bigint, n bigint, j bigint")
    twice = wins.groupBy("h").agg(F.sum("n").alias("_n")).filter("_n > 1").select("h")
    found = wins.join(twice, "h").withColumn("_g", F.col("j") - F.row_number().over(Window.partitionBy("key", "ctx").orderBy("j")))
    return found.groupBy("key", "ctx", "_g").agg(F.min("j").alias("a"), F.max("j").alias("z")).groupBy("key", "ctx").agg(F.flatten(F.collect_list(F.array("a", "z"))).alias("runs"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group: int = GROUP) -> DataFrame:
    """(uid, size, spans array of (start, end)): for each text the bytes under ``length``-byte strings that also start elsewhere; uid is xxhash64(id, text), size the bytes of the text. Spans may overlap, and are as many as the text has bytes at most.

    1. Each window is anchored at a q-gram of its own content; q-grams found once are left behind (counted map-side, so copies are a few rows).
    2. Windows of one anchor are one context of under 2 * length bytes; equal contexts collapse in the tasks and leave slim rows.
    3. Contexts of one q-gram, the initial bucket, are refined to full length by bucket pointers; a q-gram with more than ``group`` contexts is spread over all tasks by window.
    """
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def raws(b, i):
        return [t.encode("utf-8", "surrogatepass") for t in b.column(i).to_pylist()]

    def count(batches):
        for b in batches:
            for *_, h in anchors(raws(b, 0), length):
                k, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.minimum(n, 2))], ["key", "n"])

    def place(batches):
        for b in batches:
            uid, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            for d, a, lo, hi, h in anchors(raws(b, 2), length):
                yield pa.RecordBatch.from_arrays([pa.array(uid[d]), pa.array(size[d]), pa.array(h), pa.array((a << 20) | ((a - lo) << 10) | (hi - lo))], ["uid", "size", "key", "at"])

    # written, so that both sides of the join are plain exchanges and a hot q-gram's partition can be split
    twice = materialize(keyed.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))
    found = keyed.mapInArrow(place, "uid bigint, size int, key bigint, at bigint").join(twice, "key").groupBy("uid", "size").agg(F.collect_set(F.struct("key", "at")).alias("found")).withColumnsRenamed({"uid": "_u", "size": "_s"})

    def handed(rows, kinds=(pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())):
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 20_000]), kinds)], ["kind", "key", "ctx", "uid", "size", "lo", "off", "n", "bytes"])

    def contexts(batches):
        def whole(full):
            return handed([(1, k, c, None, None, None, off, n, own) for (k, c), (off, n, own) in full.items()])

        for batch in batches:
            full = {}
            for i in range(0, len(batch), DOCUMENTS):
                b, slim = batch.slice(i, DOCUMENTS), []
                uids, sizes, founds = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
                for uid, size, text, found in zip(uids, sizes, raws(b, 2), founds):
                    keys, places = (found.values.field(c).to_pylist() for c in ("key", "at"))
                    for key, at in zip(keys, places):
                        lo = (at >> 20) - (at >> 10 & 1023)
                        own = text[lo : lo + (at & 1023) + length]
                        ctx = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                        slim.append((0, key, ctx, uid, size, lo, None, None, None))
                        if (key, ctx) in full:
                            full[key, ctx][1] += 1
                        else:
                            full[key, ctx] = [at >> 10 & 1023, 1, own]
                        if len(slim) >= CONTEXTS:
                            yield from handed(slim)
                            slim = []
                        if len(full) >= CONTEXTS:
                            yield from whole(full)
                            full = {}
                yield from handed(slim)
            yield from whole(full)

    made = materialize(keyed.join(found, (F.col("uid") == F.col("_u")) & (F.col("size") == F.col("_s"))).select("uid", "size", "text", "found").mapInArrow(contexts, "kind int, key bigint, ctx bigint, uid bigint, size int, lo bigint, off bigint, n bigint, bytes binary"))
    whole = made.filter("kind = 1").select("key", "ctx", "off", "n", "bytes")
    large = whole.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > group).select("key")
    runs = whole.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_group_runs(length), "key bigint, ctx bigint, runs array<bigint>")
    if not large.isEmpty():
        runs = runs.unionByName(_large_runs(whole.join(large, "key", "left_semi"), length))
    spans = made.filter("kind = 0").select("key", "ctx", "uid", "size", "lo").join(runs, ["key", "ctx"])
    start = F.transform("runs", lambda r: r + F.col("lo"))
    return spans.select("uid", "size", start.alias("r")).groupBy("uid", "size").agg(F.collect_set("r").alias("spans"))


@columns_kept("_bytes", "_removed", "_kept", inner=("_uid", "_u", "_s", "_spans"))
def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group: int = GROUP) -> DataFrame:
    """docs with ``_bytes``, ``_removed`` (array of start, end: maximal removed runs), ``_kept`` (binary: what is left).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, the same text and overlaps included; all copies go, judged on the input. Null texts count as empty; repeated rows are copies of each other; other columns pass through; an empty table gives none. Equal q-grams, contexts and windows are told by 64-bit hashes, texts by a hash and their length.
    """
    spans = repeated_spans(docs, id_col, text_col, length, group).select(F.col("uid").alias("_u"), F.col("size").alias("_s"), F.col("spans").alias("_spans"))
    more = [T.StructField("_bytes", T.LongType()), T.StructField("_removed", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("_kept", T.BinaryType())]

    def run(batches):
        for b in batches:
            cols = [[], [], []]
            for t, found in zip(b.column(b.schema.get_field_index(text_col)).to_pylist(), b.column(b.schema.get_field_index("_spans")).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                gone: list[list[int]] = []
                for a, z in sorted((r[i], r[i + 1] + length) for r in found or () for i in range(0, len(r), 2)):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], z)
                    else:
                        gone.append([a, z])
                kept, at = [], 0
                for a, z in [*gone, [len(raw)] * 2]:
                    kept.append(raw[at:a])
                    at = z
                for c, v in zip(cols, (len(raw), gone, b"".join(kept))):
                    c.append(v)
            own = [n for n in b.schema.names if n != "_spans"]
            kinds = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in own), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*own, *(f.name for f in more)])

    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    same = (F.col("_uid") == F.col("_u")) & (F.coalesce(F.octet_length(text_col), F.lit(0)) == F.col("_s"))
    joined = docs.withColumn("_uid", uid).join(spans, same, "left").select(*docs.columns, "_spans")
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
