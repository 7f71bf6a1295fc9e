"""Brown class-based n-grams: classes by exchange, smoothed class transitions and word emissions."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_kept, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that exchange moves one by one until none moves, ahead of all others; classes.
CORE, CLASSES = 1000, 32
#: A word seen at least so often in training joins a class by exchange, against the classes of those before it: every word of the training rows.
SEEN = 1
#: Words that every task holds (the commonest, none of over 256 bytes); all others go through joins. Sizes of the model's parts, not limits on the corpus: counts are of all of it.
HELD, HELD_BYTES = 200_000, 256
#: Classes by shape: of the end of a text, of unseen words, of words ahead of their exchange.
SHAPES, END = 7, b""
_FLUSH, _CHUNK, _LEFT, _RIGHT = 400_000, 1 << 19, 0, 128


def shape(w: bytes) -> int:
    """0 the end; 1-2 ends with a full stop or comma; 3 with another sign or digit; 4-6 up to 5, 10 and more bytes."""
    if not w:
        return 0
    last = w[-1]
    if last == 46:
        return 1
    if last == 44:
        return 2
    if last < 97:
        return 3
    return 4 if len(w) <= 5 else 5 if len(w) <= 10 else 6


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, h, s, c): each token, its 64-bit hash, its shape, its count over all rows. Counted in the tasks first, so a common word is a few rows."""

    def run(batches):
        seen: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    def finish(batches):
        for b in batches:
            ws = b.column(0).to_pylist()
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in ws), np.uint64, len(ws)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h), pa.array([shape(w) for w in ws], pa.int32()), b.column(1)], ["w", "h", "s", "c"])

    return docs.select(text_col).mapInArrow(run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c")).mapInArrow(finish, "w binary, h bigint, s int, c bigint")


def encode(docs: DataFrame, training: Column, held: list[bytes], text_col: str) -> DataFrame:
    """docs without the text, with _row (a number of its own), _train, _ids (binary: for each token its place among ``held``, or -1 - shape) and _rare (binary: the hashes of the others, in turn). Each text is cut into tokens once; all later passes read this."""
    names = [c for c in docs.columns if c != text_col]

    def run(batches):
        get, digest = {w: i for i, w in enumerate(held)}.get, xxhash.xxh64_intdigest
        for b in batches:
            ids, rare = [], []
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                ws = tokens(t)
                own = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                odd = [ws[i] for i in np.flatnonzero(own < 0).tolist()]
                if odd:
                    own[own < 0] = [-1 - shape(w) for w in odd]
                ids.append(own.tobytes())
                rare.append(np.fromiter((digest(w, 42) for w in odd), np.uint64, len(odd)).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in (*names, "_train")), pa.array(ids, pa.binary()), pa.array(rare, pa.binary())], [*names, "_train", "_ids", "_rare"])

    kinds = [*(docs.schema[c] for c in names), *T._parse_datatype_string("_train boolean, _ids binary, _rare binary").fields]
    return materialize(docs.withColumn("_train", F.coalesce(training, F.lit(False))).mapInArrow(run, T.StructType(kinds)).withColumn("_row", F.monotonically_increasing_id()))


def _chunks(batches):
    """Batches of (_ids, _rare) -> (ids, hashes of the rare ones, tokens of each text) of several texts after one another."""
    for b in batches:
        ids, rare = (b.column(b.schema.get_field_index(c)) for c in ("_ids", "_rare"))
        sizes = np.array([len(x) // 4 for x in ids.to_pylist()], np.int64) if len(ids) else np.zeros(0, np.int64)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), _CHUNK, "right")) + at)
            yield np.frombuffer(b"".join(ids[at:to].to_pylist()), np.int32), np.frombuffer(b"".join(rare[at:to].to_pylist()), np.uint64).view(np.int64), sizes[at:to]
            at = to


def _classes_of(ids: np.ndarray, classes: np.ndarray, first_shape: int) -> np.ndarray:
    return np.where(ids >= 0, classes[np.maximum(ids, 0)] if len(classes) else 0, first_shape - 1 - ids)


def square_counts(coded: DataFrame, classes: np.ndarray, n: int) -> np.ndarray:
    """Counts of neighbours in the training rows by the given class of each held word (a text's first token follows an end; class n - SHAPES + s for a word of shape s); a square of fixed size.

    Tasks count in a square of their own and send its rows; those are added up by 256 tasks, then over all.
    """

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(n * n, np.int64)
        for ids, _, _ in _chunks(batches):
            k = _classes_of(ids, classes, n - SHAPES)
            total += np.bincount(np.r_[n - SHAPES, k[:-1]] * n + k, minlength=n * n)
        total = total.reshape(n, n)
        full = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), TaskContext.get().partitionId() // 256)), pa.array([zlib.compress(total[i].tobytes(), 1) for i in full], pa.binary())], ["i", "p", "c"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = np.zeros(n, np.int64)
        for c in group["c"].to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.int64)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "p": pa.array([0], pa.int64()), "c": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "i bigint, p bigint, c binary"
    rows = coded.filter("_train").select("_ids", "_rare").mapInArrow(run, schema).groupBy("i", "p").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)
    out = np.zeros((n, n), np.int64)
    for r in rows.select("i", "c").collect():  # n rows at most
        out[r["i"]] = np.frombuffer(zlib.decompress(r["c"]), np.int64)
    return out


def _packed(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each key once, with its values of x (below 256) and how often each comes, in one binary: x + 256 * count as 64-bit numbers."""
    order = np.lexsort((x, keys))
    keys, x = keys[order], x[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (x[1:] != x[:-1])]) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(keys)])
    keys, code = keys[new], x[new] + 256 * count
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    offsets = np.r_[first, len(keys)].astype(np.int32) * 8
    return keys[first], pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(code.astype(np.int64).tobytes())])


def _by_word(batches, block: int = 4000):
    """Rows (k, s, v) sorted by k -> (k, s, starts, x, n) for about ``block`` whole words at once: the entries of each begin at ``starts``. A word's rows are added up as they come, so a common word takes no room."""
    kept = None

    def merged(k, s, x, n):
        order = np.lexsort((x, k))
        k, s, x, n = k[order], s[order], x[order], n[order]
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
        return k[new], s[new], x[new], np.add.reduceat(n, new)

    def out(k, s, x, n):
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return k[starts], s[starts], starts, x, n

    for b in batches:
        if not len(b):
            continue
        v = b.column(2).to_pylist()
        sizes = np.array([len(e) // 8 for e in v])
        code = np.frombuffer(b"".join(v), np.int64)
        own = (np.repeat(b.column(0).to_numpy(), sizes), np.repeat(b.column(1).to_numpy(), sizes), code & 255, code >> 8)
        kept = merged(*(own if kept is None else (np.concatenate(c) for c in zip(kept, own))))
        last = int(np.searchsorted(kept[0], kept[0][-1]))  # the last word may go on
        if last and len(np.unique(kept[0][:last])) >= block:
            yield out(*(c[:last] for c in kept))
            kept = tuple(c[last:] for c in kept)
    if kept is not None:
        yield out(*kept)


def _f(x):
    return x * np.log(np.maximum(x, 1))


def settle(starts: np.ndarray, x: np.ndarray, n: np.ndarray, own: np.ndarray, grid: np.ndarray, learned: int) -> np.ndarray:
    """The class that raises the class bigram likelihood most, of the ``learned`` ones and the word's own, for many words at once against fixed classes.

    Entries of a word: x is _LEFT + class before it or _RIGHT + class after it, n how often. A word's own counts are taken out of its own class ahead of the comparison; cells that it shares with the class it leaves count as they are.
    """
    total = len(grid)
    cells = np.zeros((256, total))
    cells[_LEFT : _LEFT + total], cells[_RIGHT : _RIGHT + total] = grid, grid.T
    logs, word = _f(cells), np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    gain = np.zeros((len(starts), total))
    ends = np.r_[starts, len(x)]
    for a in range(0, len(starts), 500):
        z = min(a + 500, len(starts))
        e = slice(ends[a], ends[z])
        each = _f(cells[x[e]] + n[e, None]) - logs[x[e]]
        at = np.arange(e.stop - e.start)
        mine = own[word[e]]
        each[at, mine] = _f(cells[x[e], mine]) - _f(np.maximum(cells[x[e], mine] - n[e], 0))
        gain[a:z] = np.add.reduceat(each, starts[a:z] - e.start, axis=0)
    for side, margin in ((x < _RIGHT, grid.sum(0)), (x >= _RIGHT, grid.sum(1))):
        count = np.bincount(word, np.where(side, n, 0), len(starts))
        at = np.arange(len(starts))
        less = np.tile(margin, (len(starts), 1)).astype(float)
        less[at, own] = np.maximum(less[at, own] - count, 0)
        gain -= _f(less + count[:, None]) - _f(less)
    both = np.zeros((2, len(starts), total))  # a class before and after the word: one cell gets both
    np.add.at(both, ((x >= _RIGHT).astype(int), word, x & 127), n)
    at, (l, r) = np.arange(len(starts)), both  # noqa: E741
    diagonal, sign = np.tile(np.diag(grid), (len(starts), 1)).astype(float), np.ones_like(gain)
    diagonal[at, own] = np.maximum(diagonal[at, own] - l[at, own] - r[at, own], 0)
    sign[at, own] = -1
    gain += sign * (_f(diagonal + l + r) - _f(diagonal + l) - _f(diagonal + r) + _f(diagonal))
    allowed = np.zeros_like(gain, bool)
    allowed[:, :learned] = True
    allowed[np.arange(len(starts)), own] = True
    return np.where(allowed, gain, -np.inf).argmax(axis=1)


def settle_rest(coded: DataFrame, classes: np.ndarray, core: int, hashes: np.ndarray, shapes: np.ndarray, grid: np.ndarray, learned: int, seen: int) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(classes of the held words, (h, class) of the words that no task holds, how many tokens and words of theirs each class gets).

    Every word beyond the ``core`` is moved once, against the classes on both sides of it: learned ones of core words, those by shape of all others. Held or not, a word is moved by the same counts against the same ``grid``.
    """
    total = len(grid)
    moved = (np.arange(len(hashes)) >= core) & (shapes > 0)

    def count(batches):
        keys, kinds, xs, size = [], [], [], 0
        for ids, rare, _ in _chunks(batches):
            k, odd = _classes_of(ids, classes, total - SHAPES), ids < 0
            word = np.maximum(ids, 0)
            at = np.flatnonzero(odd | moved[word] if len(moved) else odd)
            h = np.zeros(len(ids), np.int64)
            h[odd] = rare
            if len(hashes):
                h[~odd] = hashes[ids[~odd]]
            kind = np.where(odd, -1 - ids, 8 + shapes[word] if len(shapes) else 0)
            keys += [h[at], h[at]]
            kinds += [kind[at], kind[at]]
            xs += [_LEFT + np.r_[total - SHAPES, k[:-1]][at], _RIGHT + np.r_[k[1:], total - SHAPES][at]]
            size += len(at)
            if size > 2 * _FLUSH:
                yield rows(keys, kinds, xs)
                keys, kinds, xs, size = [], [], [], 0
        if keys:
            yield rows(keys, kinds, xs)

    def rows(keys, kinds, xs):
        keys, kinds = np.concatenate(keys), np.concatenate(kinds)
        h, v = _packed(keys, np.concatenate(xs))
        s = np.zeros(len(h), np.int32)
        s[np.searchsorted(h, keys)] = kinds
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), v], ["k", "s", "v"])

    def choose(batches):
        sizes = np.zeros((2, total), np.int64)
        for k, s, starts, x, n in _by_word(batches):
            own, held, times = (total - SHAPES + (s & 7)).astype(np.int64), s >= 8, np.add.reduceat(np.where(x < _RIGHT, n, 0), starts)
            c = np.where((times >= seen) & (s & 7 > 0), settle(starts, x, n, own, grid, learned), own)
            np.add.at(sizes, (0, c[~held]), times[~held])
            np.add.at(sizes, (1, c[~held]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(held, 2, 0).astype(np.int32)), pa.array(k), pa.array(c.astype(np.int64))], ["kind", "h", "x"])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(2 * total, np.int32)), pa.array(np.arange(2 * total)), pa.array(sizes.ravel())], ["kind", "h", "x"])

    found = coded.filter("_train").select("_ids", "_rare").mapInArrow(count, "k bigint, s int, v binary")
    made = materialize(found.repartition("k").sortWithinPartitions("k").mapInArrow(choose, "kind int, h bigint, x bigint"))
    sizes = np.zeros(2 * total, np.int64)
    for r in made.filter("kind = 1").groupBy("h").agg(F.sum("x").alias("x")).collect():  # two rows a class
        sizes[r["h"]] = r["x"]
    out, got = classes.copy(), made.filter("kind = 2").select("h", "x").toArrow()  # at most as many rows as words are held
    if len(got):
        order = np.argsort(hashes, kind="stable")
        out[order[np.searchsorted(hashes, got["h"].to_numpy(), sorter=order)]] = got["x"].to_numpy()
    return out, made.filter("kind = 0").select("h", F.col("x").cast("int").alias("class")), sizes.reshape(2, total)


def rare_steps(coded: DataFrame, outside: DataFrame, classes: np.ndarray, total: int) -> DataFrame:
    """(_r, _train, _more, _add, _old, _new) of rows with words that no task holds, in one row or some: how many of these words ``outside`` (h, c, class) knows, the log10 of their counts plus one, and the steps from class to class that their classes change: with all of them in the class of their shape, and as they are (binary: 16-bit class before * total + class)."""
    first = total - SHAPES

    def cut(batches):
        for b in batches:
            rows, train = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            done = 0
            for ids, hashes, sizes in _chunks([b]):
                k, odd, text = _classes_of(ids, classes, first), ids < 0, np.repeat(np.arange(len(sizes)), sizes)
                head, tail = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
                before, after = np.where(np.r_[False, odd[:-1]], 0, np.r_[first, k[:-1]] + 1), np.where(np.r_[odd[1:], False], 0, np.r_[k[1:], first] + 1)
                before[head], after[tail] = first + 1, 0
                each = np.bincount(text[odd], minlength=len(sizes))
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(each) - each, each)
                at = done + text[odd]
                x = place << 20 | train[at] << 19 | (-1 - ids[odd]).astype(np.int64) << 16 | before[odd] << 8 | after[odd]
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(hashes), pa.array(x)], ["_r", "h", "x"])
                done += len(sizes)

    def steps(batches):
        last = np.zeros(2, np.int64)
        for b in batches:
            if not len(b):
                continue
            r, x, found, c = (col.to_numpy() for col in b.columns)
            shaped = first + (x >> 16 & 7)
            cls = np.where(found < 0, shaped, found)
            before, after = x >> 8 & 255, x & 255
            codes = []
            for k, own in enumerate((shaped, cls)):
                codes.append(np.c_[np.where(before > 0, before - 1, np.r_[last[k], own[:-1]]) * total + own, np.where(after > 0, own * total + after - 1, 0)].ravel())
                last[k] = own[-1]
            kept = codes[0] != codes[1]
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            offsets = pa.py_buffer((2 * np.r_[0, np.cumsum(np.add.reduceat(kept.astype(np.int64), 2 * starts))]).astype(np.int32).tobytes())
            sums = (np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(c + 1.0), starts))
            changed = (pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(e[kept].astype(np.uint16).tobytes())]) for e in codes)
            yield pa.RecordBatch.from_arrays([pa.array(r[starts]), pa.array((x[starts] >> 19 & 1).astype(bool)), *map(pa.array, sums), *changed], ["_r", "_train", "_more", "_add", "_old", "_new"])

    each = coded.select("_row", "_train", "_ids", "_rare").mapInArrow(cut, "_r bigint, h bigint, x bigint").join(outside, "h", "left")
    each = each.select("_r", "x", F.coalesce("class", F.lit(-1)).cast("bigint").alias("class"), F.coalesce("c", F.lit(0)).cast("bigint").alias("c"))
    return materialize(each.repartition("_r").sortWithinPartitions("_r", "x").mapInArrow(steps, "_r bigint, _train boolean, _more bigint, _add double, _old binary, _new binary"))


def changed_counts(steps: DataFrame, total: int) -> np.ndarray:
    """What the training rows of ``steps`` move in the counts of (class before, class)."""

    def run(batches):
        cells = np.zeros(total * total, np.int64)
        for b in batches:
            for column, sign in zip(b.columns, (-1, 1)):
                cells += sign * np.bincount(np.frombuffer(b"".join(column.to_pylist()), np.uint16), minlength=total * total)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["i", "x"])

    out = np.zeros(total * total, np.int64)
    for r in steps.filter("_train").select("_old", "_new").mapInArrow(run, "i bigint, x bigint").groupBy("i").agg(F.sum("x").alias("x")).collect():  # total squared at most
        out[r["i"]] = r["x"]
    return out.reshape(total, total)


def exchange(pairs: np.ndarray, words_: int, classes: int = CLASSES) -> np.ndarray:
    """The class of each row of ``pairs``: the first ``words_`` are moved to the class that raises the class bigram likelihood most, in turn, until none moves; each other row keeps a class of its own. Moves that raise it by no more than a float's last digits end it too, so it ends for any counts."""
    n = len(pairs)
    total = classes + n - words_
    cls = np.r_[np.arange(words_) % classes, np.arange(classes, total)]
    one = np.eye(total)[cls]
    right, left = pairs @ one, pairs.T @ one  # by word: counts to and from each class
    grid = one.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1))
    best, moved = -np.inf, 1
    while moved and (now := f(grid).sum() - f(grid.sum(0)).sum() - f(grid.sum(1)).sum()) > best:
        best, moved = now, 0
        for w in range(words_):
            a, own = cls[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            if not r.any() and not l.any():
                continue
            base = grid.copy()
            base[a] -= r
            base[:, a] -= l
            base[a, a] += own
            r[a] -= own
            l[a] -= own
            rows, cols, self_ = base[:classes], base[:, :classes].T, base[np.arange(classes), np.arange(classes)]
            gain = (f(rows + r) - f(rows)).sum(1) + (f(cols + l) - f(cols)).sum(1)
            at = np.arange(classes)
            gain += f(self_ + r[at] + l[at] + own) - f(self_ + r[at]) - f(self_ + l[at]) + f(self_)
            out, into = base.sum(1)[:classes] + l[:classes], base.sum(0)[:classes] + r[:classes]
            gain -= f(out + r.sum() + own) - f(out) + f(into + l.sum() + own) - f(into)
            b = int(gain.argmax())
            if b != a and gain[b] > gain[a] + 1e-9:
                moved += 1
                cls[w] = b
                col, row = pairs[:, w], pairs[w]
                right[:, a] -= col
                right[:, b] += col
                left[:, a] -= row
                left[:, b] += row
                grid = base
                grid[b] += r
                grid[:, b] += l
                grid[b, b] += own
    return cls


def core_words(vocab: DataFrame, core: int) -> Column:
    """Which rows of ``vocab`` (w, c) are of the ``core`` commonest words, small ones before those of greater bytes; the end is none."""
    small = (F.octet_length("w") <= HELD_BYTES) & (F.octet_length("w") > 0)
    last = vocab.filter(small).select("c", "w").orderBy(F.desc("c"), "w").limit(core).orderBy("c", F.desc("w")).first() if core > 0 else None
    if last is None:
        return F.lit(False)
    return small & ((F.col("c") > last["c"]) | ((F.col("c") == last["c"]) & (F.col("w") <= F.lit(bytes(last["w"])))))


def held_words(vocab: DataFrame, held: int) -> Column:
    """Which rows of ``vocab`` (w, h, c) every task holds: the commonest, ``held`` at most. Of words seen equally often that don't all fit, those of the first of 4,096 parts by their hash."""
    small, part = F.octet_length("w") <= HELD_BYTES, F.shiftrightunsigned("h", 52)
    room, level, parts = held, 0, 0
    for r in vocab.filter(small).groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if r["count"] <= room:
            room -= r["count"]
            continue
        level = r["c"]
        for p in vocab.filter(small & (F.col("c") == level)).groupBy(part.alias("p")).count().orderBy("p").collect():  # 4,096 at most
            if p["count"] > room:
                break
            room, parts = room - p["count"], p["p"] + 1
        break
    return small & ((F.col("c") > level) | ((F.col("c") == level) & (part < parts)))


@columns_kept("_n_tokens", "_n_known", "_train_tokens", "_base", "_score", inner=("_row", "_r", "_held", "_logs", "_moves", "_more", "_add", "_better", "_train", "_ids", "_rare"))
def score_texts(docs: DataFrame, training: Column, text_col: str = "text", core: int = CORE, classes: int = CLASSES, seen: int = SEEN, held: int = HELD) -> DataFrame:
    """docs (without the text) with ``_n_tokens``, ``_n_known``, ``_train_tokens``, ``_base`` and ``_score``: log10 probabilities of the whole text.

    base: add-one unigrams. score: P(class | class before) P(word | class), both add-one; V + 1 words of a class, for one unseen. Statistics are of all rows where ``training`` holds.
    Exchange runs in two steps: the ``core`` commonest words one by one until none moves, then every other word once, against the classes found by then; words seen fewer than ``seen`` times keep the class of their shape, as unseen ones do.
    Counts and classes of the core and of the ``held`` commonest words go to every task; those of the others are joined by hash. ``held`` decides where a word's count lies and nothing else: scores are equal for any value, but for the last digits of sums. A null text counts as empty (its end is still a token); repeated rows stay; with no training rows every count is 0; an empty table gives none.
    """
    names = [c for c in docs.columns if c != text_col]
    vocab = materialize(word_counts(docs.filter(training), text_col))
    v, n = vocab.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    is_held = core_words(vocab, core) | held_words(vocab, held) | (F.octet_length("w") == 0)
    got = vocab.filter(is_held).select("w", "c", "h").toArrow()
    common = {w: (c, h) for w, c, h in zip(*(got[c].to_pylist() for c in ("w", "c", "h")))}
    order = sorted(common, key=lambda w: (w == END, -common[w][0], w))
    top, counts, hashes = min(core, len(order) - (END in common)), *(np.array([common[w][i] for w in order], np.int64) for i in (0, 1))
    shapes = np.array([shape(w) for w in order], np.int64)
    coded = encode(docs, training, order, text_col)
    square = np.where(np.arange(len(order)) < top, np.arange(len(order)), top + shapes)
    pairs = square_counts(coded, square, top + SHAPES)
    cls = exchange(pairs, top, min(classes, max(1, top)))
    total = int(cls.max()) + 1
    learned = total - SHAPES
    one = np.eye(total, dtype=np.int64)[cls]
    placed = cls[square] if len(order) else np.zeros(0, np.int64)
    placed, rare, (tokens_, words_) = settle_rest(coded, placed, top, hashes, shapes, one.T @ pairs @ one, learned, seen)
    outside = materialize(vocab.filter(~is_held).select("h", "c").join(rare, "h"))
    grid = square_counts(coded, placed, total)
    steps = rare_steps(coded, outside, placed, total)
    grid += changed_counts(steps, total)
    step = np.log10((grid + 1) / (grid.sum(1, keepdims=True) + total))
    size, types = np.bincount(placed, counts, total) + tokens_, np.bincount(placed, minlength=total) + words_
    moves = step - np.log10(size + types + 1)
    floor = -np.log10(n + v + 1)
    logs = np.log10(counts + 1.0)

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(4)]
            for ids, _, sizes in _chunks([b]):
                k = _classes_of(ids, placed, learned)
                before = np.r_[learned, k[:-1]]
                starts, odd = np.cumsum(sizes) - sizes, ids < 0
                each = np.where(odd, 0.0, logs[np.maximum(ids, 0)] if len(logs) else 0.0)
                cols[0] += sizes.tolist()
                cols[1] += (sizes - np.add.reduceat(odd.astype(np.int64), starts)).tolist()
                cols[2] += np.add.reduceat(each, starts).tolist()
                cols[3] += np.add.reduceat(moves[before, k], starts).tolist()
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in (*names, "_row")), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*names, "_row", "_n_tokens", "_held", "_logs", "_moves"])

    def change(batches):
        flat = moves.ravel()
        for b in batches:
            better = [float((flat[np.frombuffer(z, np.uint16)] - flat[np.frombuffer(a, np.uint16)]).sum()) for a, z in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(better, pa.float64())], ["_r", "_more", "_add", "_better"])

    more = "_row bigint, _n_tokens bigint, _held bigint, _logs double, _moves double"
    done = coded.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *T._parse_datatype_string(more).fields]))
    found = steps.select("_r", "_more", "_add", "_old", "_new").mapInArrow(change, "_r bigint, _more bigint, _add double, _better double").groupBy("_r").agg(*(F.sum(c).alias(c) for c in ("_more", "_add", "_better")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    known_logs = F.col("_logs") + zero("_add")
    return done.join(found, F.col("_row") == F.col("_r"), "left").select(
        *names, "_n_tokens", (F.col("_held") + F.coalesce("_more", F.lit(0))).alias("_n_known"), F.lit(n).cast("bigint").alias("_train_tokens"), (known_logs + F.col("_n_tokens") * F.lit(float(floor))).alias("_base"), (known_logs + F.col("_moves") + zero("_better")).alias("_score")
    )
