"""Each operator against a brute-force version or an exact round trip, on the smallest tables and on awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import attention_mil, brown, byte_repeats, chat, line_crf, line_runs, mixing, queries, sharding, simhash, tiling
from graphloom.llm.common import table
from graphloom.plans import components

LONG = " ".join(f"word{i % 997} tail{i % 13}." for i in range(9000))
AWKWARD = [
    (1, "A b c d e f", "en", None), (1, "A b c d e f", "en", None), (2, None, None, "x"), (3, "", "de", "x"), (None, "no id here at all", "de", "y"), (4, LONG, "en", "x"), (5, LONG + " and more", "en", "x"), (6, "a\nb\n\na\nb\nc", None, None), (7, "a\nb\n\n", "fr", "z"), (8, "ÄÖÜ ß é   x\x0by", "fr", "z"), (9, "   \n\t ", "fr", "z"),
]


#: Names that operators give to columns of their own and drop again.
INNER = ("_r", "_held", "_logs", "_moves", "_more", "_add", "_better", "_train", "_ids", "_rare", "_place", "_found", "_uid", "_s", "_spans", "_fp", "_mins", "_own", "_size", "_text", "_kept_row", "_l0", "_l1", "_l2", "_full", "_times", "_m", "d", "b")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and long texts, ties, repeats, and columns named like the operators' own."""
    own = ["key", "h", "n", "k", "p", "uid", "full", "rank", "_key", "_k", "_u", "_n", "_cut", "_order", "_start", "_score", "_kept", "_tokens", "_row", *INNER]
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(own)))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").collect()


def prints(text, k=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check_simhash(rows, got):
    fps = [prints(r[1]) for r in rows]
    root = groups(fps, 2)
    least = defaultdict(list)
    for i, r in zip(root, rows):
        least[i] += [r[0]] * (r[0] is not None)
    want = Counter((r[0], fp, min(least[i], default=None)) for r, fp, i in zip(rows, fps, root))
    assert want == Counter((r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in got)


def test_simhash(spark, docs, awkward):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_simhash(docs, simhash.simhash_groups(frame).collect())
    check_simhash([(r[0], r[1]) for r in AWKWARD], simhash.simhash_groups(awkward).collect())
    assert simhash.simhash_groups(awkward.limit(0)).count() == 0


def test_simhash_large_block_is_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 16)
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))})
    frame = spark.createDataFrame([([x], 1, 0) for x in fps], "fp array<bigint>, k bigint, c bigint")
    links = simhash.near_links(frame, 2).collect()
    assert all((r["a"][0] ^ r["b"][0]).bit_count() <= 64 for r in links) and len(links) < 20 * len(fps)
    root = {r["node"][0]: r["root"][0] for r in components.connected_components(simhash.near_links(frame, 2)).collect()}
    want = groups(fps, 2)
    assert all((root.get(fps[i], fps[i]) == root.get(fps[j], fps[j])) == (want[i] == want[j]) for i in range(len(fps)) for j in range(0, i, 7))


def test_tiles_match_plain_comparison():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = (base[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))).reshape(-1, 1)
    root = simhash.linked(fp, 2)
    want = groups([int(x) for x in fp[:, 0]], 2)
    assert root.tolist() == want


def test_similar_finds_edited_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((2 * i, " ".join(w)))
        w[int(rng.integers(300))] = "edited"
        rows.append((2 * i + 1, " ".join(w)))
    got = {r["id"]: r["component"] for r in simhash.simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_similar_finds_pairs_just_over_the_similarity():
    rng, radius = np.random.default_rng(5), int(64 * 8 * 0.2)
    for _ in range(150):
        w = [f"w{x}" for x in rng.integers(0, 1 << 30, 204)]
        a, b = (simhash.shingle_hashes(" ".join(x), 5) for x in (w, w[:182] + [f"v{x}" for x in rng.integers(0, 1 << 30, 22)]))
        assert 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.81
        x, y = (np.array(simhash.fingerprint(h, 8), np.int64).view(np.uint64) for h in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= radius


def test_similar_finds_copies_with_a_line_repeated_unequally_often(spark):
    rng, rows = np.random.default_rng(11), []
    for i in range(20):
        w, line = ([f"w{x}" for x in rng.integers(0, 1 << 30, n)] for n in (300, 10))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, "\n".join([" ".join(w)] + [" ".join(line)] * 5))]
    got = {r["id"]: r["component"] for r in simhash.simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert least_of_groups(dict(rows)) == {i: i // 2 * 2 for i in range(40)} == got


def test_sharding(spark, awkward, sf):
    out = sharding.shuffle_shards(table(spark, sf, "documents"), 5, bucket_bytes=20_000).collect()
    assert len(out) == table(spark, sf, "documents").count()
    for s in range(5):
        assert sorted(r["_slot"] for r in out if r["_shard"] == s) == list(range(sum(r["_shard"] == s for r in out)))
    assert len({(r["_shard"], r["_bucket"]) for r in out}) > 10
    grown = {r["doc_id"]: r["_shard"] for r in sharding.shuffle_shards(table(spark, sf, "documents"), 6).collect()}
    assert all(grown[r["doc_id"]] in (r["_shard"], 5) for r in out) and any(g == 5 for g in grown.values())
    again = sharding.shuffle_shards(table(spark, sf, "documents").repartition(7), 5, bucket_bytes=20_000).collect()
    assert {(r["doc_id"], r["_slot"]) for r in out} == {(r["doc_id"], r["_slot"]) for r in again}
    got = sharding.shuffle_shards(awkward, 3)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], r[1]) for r in AWKWARD)
    assert sharding.shuffle_shards(awkward.limit(0), 3).count() == 0


def test_sharding_query(spark, sf):
    """Every column of the query against plain code."""
    docs, rows = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}, queries.op3_sharding(spark, sf).collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"key"}
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and 0 < sum(r["grown_shard"] == 40 for r in rows) < len(rows) / 10


def test_one_key_fills_many_buckets(spark):
    frame = spark.createDataFrame([(7, f"text {i} " * 20, {"a": 1}) for i in range(300)] + [(7, "same", None)] * 5, "doc_id long, text string, m map<string,int>")
    out = sharding.shuffle_shards(frame, 3, bucket_bytes=2000).collect()
    assert len({r["_shard"] for r in out}) == 1 and len({r["_bucket"] for r in out}) > 5 and sorted(r["_slot"] for r in out) == list(range(305))


def test_write_shards_round_trip(spark, sf, tmp_path):
    sharding.write_shards(table(spark, sf, "documents"), str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select("doc_id", "text").exceptAll(table(spark, sf, "documents").select("doc_id", "text")).isEmpty() and back.count() == table(spark, sf, "documents").count()


def brute_lines(rows, shortest):
    """By (id, text): what is left, and the runs."""
    keyed = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for r in keyed:
        lines = r[1].split("\n")
        gone = set()
        for p in range(len(lines) - shortest + 1):
            run = tuple(lines[p : p + shortest])
            gone |= set(range(p, p + shortest)) if run in seen else set()
            seen.add(run)
        out[r] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


@pytest.mark.parametrize("shortest", [1, 2, 4])
def test_lines(spark, docs, awkward, shortest):
    rows = [(i, "\n".join("abcdefg"[int(x)] for x in np.random.default_rng(i).integers(0, 3, 3 + i % 30))) for i in range(60)]
    for given, frame in ((rows, spark.createDataFrame(rows, "doc_id long, text string")), ([r[:2] for r in AWKWARD], awkward)):
        want = brute_lines(given, shortest)
        got = line_runs.drop_repeated_lines(frame, shortest=shortest).collect()
        assert len(got) == len(given)
        for r in got:
            if r["text"] is None:
                assert r["_clean"] is None and r["_lines"] == 0
            else:
                assert (r["_clean"], sum(x[1] for x in r["_runs"])) == want[r["doc_id"], r["text"]]
    assert line_runs.drop_repeated_lines(awkward.limit(0)).count() == 0


def test_copies_are_maximal_runs(spark):
    """Each copy holds the lines of its source, which stands earlier, and neither goes on; what goes is what copies cover."""
    rng = np.random.default_rng(15)
    core = [f"line {x}" for x in rng.integers(0, 1000, 60)]
    rows = []
    for i in range(30):
        a, n = int(rng.integers(0, 45)), int(rng.integers(1, 15))
        rows.append((i, "\n".join([f"own {i}", *core[a : a + n], f"end {i}", *(core[:23] if i % 7 == 0 else [])])))
    lines = {i: t.split("\n") for i, t in rows}
    seen = set()
    for r in line_runs.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own, covered = lines[r["doc_id"]], set()
        for c in r["_copies"]:
            other, p, q, n = lines[c["source_id"]], c["line"], c["source_line"], c["lines"]
            assert (c["source_id"], q) < (r["doc_id"], p) and n >= 2 and own[p : p + n] == other[q : q + n]
            assert p + n == len(own) or q + n == len(other) or own[p + n] != other[q + n]
            covered |= set(range(p, p + n))
            seen.add(n)
        assert covered == {x for a, n in r["_runs"] for x in range(a, a + n)}
    assert len(seen) > 5 and seen - {2, 4, 8, 16}


def brute_long_lines(rows, shortest, words):
    """By (id, text): the lines that are left, by runs of ``shortest`` lines and by single lines of over ``words`` words."""
    seen, out = set(), {}
    for r in sorted({r for r in rows if r[1] is not None}):
        lines, gone = r[1].split("\n"), set()
        for n in (1, shortest):
            for p in range(len(lines) - n + 1):
                run = tuple(lines[p : p + n])
                if n == shortest or len(lines[p].split()) > words:
                    gone |= set(range(p, p + n)) if run in seen else set()
                    seen.add(run)
        out[r] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def test_long_lines(spark, sf):
    long, at = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, long), (5, f"{at}\ne"), (6, f"f\n{at}"), (7, "short"), (8, "short"), (9, f"g\n{long}\n{long}\nb\nh")]
    got = {r["doc_id"]: (r["_clean"], r["_runs"]) for r in line_runs.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=50).collect()}
    assert got == {i: (t, []) for i, t in rows} | {2: ("c\nd", [[1, 1]]), 3: ("", [[0, 1]]), 4: ("", [[0, 1]]), 9: ("g\nh", [[1, 3]])}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in queries.op4_line_dedup(spark, sf).collect()}
    for (i, t), (kept, n) in brute_long_lines({tuple(r) for r in docs}, 2, 50).items():
        assert (out[i]["kept_md5"], out[i]["n_removed"]) == (hashlib.md5(kept.encode()).hexdigest(), n)


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("group", [1, byte_repeats.GROUP])
def test_bytes(spark, docs, awkward, group):
    rng = np.random.default_rng(4)
    core = "".join(chr(97 + x) for x in rng.integers(0, 26, 700))
    more = [(1000 + i, "".join(chr(97 + x) for x in rng.integers(0, 26, 60)) + core[int(a) : int(a) + 320] + "zz" * int(a % 90)) for i, a in enumerate(rng.integers(0, 380, 40))]
    given = [(r[0], r[1]) for r in docs[:80]] + more + [(2000, "ab" * 400), (2001, "")]
    want = dict(zip((r[0] for r in given), brute_bytes([r[1] for r in given], 200)))
    got = byte_repeats.drop_repeated_bytes(spark.createDataFrame(given, "doc_id long, text string"), group=group).collect()
    assert len(got) == len(given) and all(bytes(r["_kept"]) == want[r["doc_id"]] for r in got)
    assert all(sum(z - a for a, z in r["_removed"]) == r["_bytes"] - len(r["_kept"]) for r in got)


@pytest.mark.parametrize("length", [200, 130, 7])
def test_refinement_is_exact(length):
    """Places of equal strings in packed contexts, against a plain count; contexts don't run into each other."""
    rng = np.random.default_rng(length)
    core = (rng.integers(97, 99, 300).astype(np.uint8).tobytes()) * 2 + rng.integers(97, 99, 300).astype(np.uint8).tobytes()
    own = [core[int(a) : int(a) + int(n)] for a, n in zip(rng.integers(0, 600, 30), rng.integers(length, 300 + length, 30))] + [b"z" * (length + 5), b"q" * length]
    sizes = np.array([len(x) for x in own])
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([b + np.arange(n - length + 1) for b, n in zip(begin, sizes)])
    left = np.repeat(begin + sizes, sizes) - np.arange(sizes.sum())
    raw = b"".join(own)
    seen = Counter(raw[s : s + length] for s in starts.tolist())
    got = byte_repeats.refine(np.frombuffer(raw, np.uint8), starts, left, length)
    assert got.tolist() == [seen[raw[s : s + length]] > 1 for s in starts.tolist()] and 0 < got.sum() < len(got)


def test_bytes_awkward(awkward):
    rows = [r[:2] for r in AWKWARD]
    short = [(i, t if t is None or len(t) < 1000 else t[:900]) for i, t in rows]
    frame = awkward.withColumn("text", F.substring("text", 1, 900))
    want = Counter(zip((r[0] for r in short), brute_bytes([r[1] for r in short], 200)))
    assert want == Counter((r["doc_id"], bytes(r["_kept"])) for r in byte_repeats.drop_repeated_bytes(frame, group=2).collect())
    assert byte_repeats.drop_repeated_bytes(awkward.limit(0)).count() == 0


def test_quality_rules(docs, awkward):
    import re

    for t in [r[1] for r in docs[:100]] + ["a b c d e f g h " * 5 + "x", "q " * 19, None, "", "ä ß\nä ß\n#|"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = line_crf.assess(t)
        assert got[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert got[5] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert line_crf.quality_rules(awkward).count() == len(AWKWARD) and line_crf.quality_rules(awkward.limit(0)).count() == 0


def test_viterbi_is_best_path():
    from itertools import product

    rng, p = np.random.default_rng(5), line_crf.Potentials()
    for n in range(1, 8):
        x = rng.normal(size=n).tolist()
        value = lambda s: sum(v for v, c in zip(x, s) if c) + sum(p.stay if a == b else p.change for a, b in zip(s, s[1:]))  # noqa: B023, E731
        assert abs(value(line_crf.viterbi(x)) - max(map(value, product([True, False], repeat=n)))) < 1e-12


def test_chain_gradient():
    """The likelihood against the sum over all state sequences, the gradient against differences."""
    from itertools import product

    rng = np.random.default_rng(12)
    bags, content, p = [rng.normal(size=(n, 3)) for n in (1, 4, 6)], np.array([True, False, True]), rng.normal(size=5)

    def value(p):
        total = 0.0
        for x, c in zip(bags, content):
            score = lambda s: sum(v for v, one in zip(x @ p[:3], s) if one) + sum(p[3] if a == b else p[4] for a, b in zip(s, s[1:]))  # noqa: B023, E731
            total += (score([c] * len(x)) - np.log(sum(np.exp(score(s)) for s in product([True, False], repeat=len(x))))) / len(x) / 3
        return total

    got, gradient = line_crf.chain_gradient(bags, content, p)
    assert abs(got - value(p)) < 1e-9
    for i in range(5):
        d = np.eye(5)[i] * 1e-6
        assert abs((value(p + d) - value(p - d)) / 2e-6 - gradient[i]) < 1e-6


def test_potentials_are_fitted(spark, sf):
    fitted = queries.potentials(spark, sf)
    assert fitted.weights != line_crf.Potentials().weights and fitted.stay > fitted.change
    docs = table(spark, sf, "documents")
    assert line_crf.fit_potentials(docs, table(spark, sf, "labels").limit(0), F.lit(True)) == line_crf.Potentials()
    assert line_crf.fit_potentials(docs.limit(0), table(spark, sf, "labels"), F.lit(True)) == line_crf.Potentials()


def test_quality_rules_on_labels(spark, sf):
    out = queries.op7_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    assert not out.filter("quality = 0 and kept").count() and not out.filter("quality = 1 and not kept and not base_failed").count()


def plain_tiling(doc, item, k):
    """Greedy string tiling as it is defined, by comparing tokens one by one."""
    k = min(k, len(item))
    free_d, free_i, marked, tiles = [True] * len(doc), [True] * len(item), 0, 0
    while item:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and free_d[d + n] and free_i[p + n] and doc[d + n] == item[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, p)
        n, d, p = best
        if n < k or not n:
            break
        for x in range(n):
            free_d[d + x] = free_i[p + x] = False
        marked, tiles = marked + n, tiles + 1
    return marked, tiles


def plain_best(text, items, k=5):
    """(coverage, item id, tiles) over (id, text) in order."""
    best = (0.0, None, 0)
    for i, t in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        own = tiling.tokens(t)
        n, tiles = plain_tiling(tiling.tokens(text), own, k)
        if own and n / len(own) > best[0]:
            best = (n / len(own), i, tiles)
    return best


def test_tiles_are_greedy():
    rng = np.random.default_rng(9)
    for k in (1, 2, 5):
        for _ in range(120):
            doc, item = (rng.integers(0, 4, int(n)).tolist() for n in rng.integers(1, 40, 2))
            if len(item) >= k:
                assert tiling.tile(np.array(doc, np.uint64), np.array(item, np.uint64), k) == plain_tiling(doc, item, k)


def test_tiling_of_repeated_words_is_quick():
    import time

    index = tiling.Items([(0, "word " * 1500), (1, "a b " * 700)], 5)
    for text in ("word " * 20_000, "a b " * 10_000, "word a b " * 7000):
        began = time.time()
        got = index.match(text)
        assert time.time() - began < 1 and (got[0] == 1.0) == (text != "word a b " * 7000)


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_tiling(spark, awkward, held):
    item = "one two three four five six seven eight nine ten eleven twelve"
    index = tiling.Items([(0, item), (1, "red two")], 5)
    assert index.match(item.upper().replace(" ", ", ")) == (1.0, 0, 1)
    assert index.match("x seven eight nine ten eleven twelve y one two three four five six z") == (1.0, 0, 2)
    assert index.match("one two three four x five six seven") == (0.0, None, 0)
    assert index.match("one two three four five " * 3) == (5 / 12, 0, 1)
    assert index.match("a red two b") == (1.0, 1, 1)
    rng = np.random.default_rng(10)
    items = [(1, item), (2, "a b c d e f"), (3, None), (4, ""), (7, item), (6, item + " " + item), (None, "x y"), (8, "no id here"), (8, "word1 tail1. word2 tail2 word3"), (9, "zz")]
    texts = [*(r[:2] for r in AWKWARD), *((100 + i, " ".join(item.split()[int(x)] for x in rng.integers(0, 12, 30)) + " " + item[: int(rng.integers(60))]) for i in range(12)), (200, "X, y!"), (201, item)]
    want = {(i, t): plain_best(t and t[:2000], items) for i, t in texts}
    frame = spark.createDataFrame([(i, t and t[:2000]) for i, t in texts], "doc_id long, text string").withColumn("n", F.lit("own"))
    got = tiling.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), held_bytes=held).collect()
    assert Counter((r["doc_id"], r["text"], r["n"], r["_coverage"], r["_item"], r["_tiles"]) for r in got) == Counter((i, t and t[:2000], "own", *want[i, t]) for i, t in texts)
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert tiling.decontaminate(awkward, tests, held_bytes=held).count() == len(AWKWARD)
    assert tiling.decontaminate(awkward.limit(0), tests, held_bytes=held).count() == 0 and tiling.decontaminate(awkward, tests.limit(0), held_bytes=held).count() == len(AWKWARD)


def test_decontamination_finds_every_whole_item(spark, sf):
    items = [tiling.tokens(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    texts = {r["doc_id"]: " ".join(tiling.tokens(r["text"])) for r in table(spark, sf, "documents").collect()}
    want = {i for i, t in texts.items() if any(f" {' '.join(x)} " in f" {t} " for x in items)}
    assert want == {r["doc_id"] for r in queries.op8_decontamination(spark, sf).filter("contaminated").collect()}


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_tiling_of_a_seed_in_every_text_and_test(spark, held):
    """Long texts and many tests that all share a passage: each text's own test is found, by both paths."""
    common = "the same five words everywhere"
    tests = [(i, f"{common} " + " ".join(f"t{i}w{j}" for j in range(20))) for i in range(30)] + [(99, None), (98, "")]
    docs = [(i, " ".join(f"x{i}y{j}" for j in range(9000 if i < 3 else 30)) + f" {common} " + (" ".join(f"t{i}w{j}" for j in range(5, 20)) if i % 2 else "")) for i in range(12)]
    out = tiling.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string"), held_bytes=held).collect()
    assert {r["doc_id"]: (r["_item"], round(r["_coverage"], 6), r["_tiles"]) for r in out} == {i: (i, 0.8, 2) if i % 2 else (0, 0.2, 1) for i in range(12)}


def test_mixing_redistributes_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)]
    leaves = spark.createDataFrame(rows, "d string, s string, tokens long").withColumn("cap", F.col("tokens").cast("double"))
    got = {(r["d"], r["s"]): r["target"] for r in mixing.budgets(leaves, ["d", "s"], 600.0).collect()}
    assert got == {("a", "x"): 10.0, ("a", "y"): 290.0, ("b", "z"): 300.0}
    got = {(r["d"], r["s"]): r["target"] for r in mixing.budgets(leaves, ["d", "s"], 600.0, {("a",): 0.25, ("b",): 0.75, ("a", "x"): 0.04, ("a", "y"): 0.96}).collect()}
    assert got == pytest.approx({("a", "x"): 6.0, ("a", "y"): 144.0, ("b", "z"): 450.0})
    got = {(r["d"], r["s"]): r["target"] for r in mixing.budgets(leaves, ["d", "s"], 2005.0).collect()}
    assert got == {("a", "x"): 10.0, ("a", "y"): 995.0, ("b", "z"): 1000.0}


def plain_budgets(leaves, levels, budget, weights):
    """leaves {path: cap} -> {path: target}: raise one level after another in small steps, nodes that are full drop out."""
    caps = {k: 0.0 if any(weights.get(k[: i + 1], 1.0) <= 0 for i in range(levels)) else v for k, v in leaves.items()}
    out = {(): budget}
    for i in range(levels):
        for up in {k[:i] for k in caps}:
            nodes = {k: sum(v for x, v in caps.items() if x[: i + 1] == k) for k in {x[: i + 1] for x in caps if x[:i] == up}}
            got, left = dict.fromkeys(nodes, 0.0), min(out[up], sum(nodes.values()))
            while left > 1e-9:
                free = {k: weights.get(k, 1.0) for k in nodes if nodes[k] - got[k] > 1e-12 and weights.get(k, 1.0) > 0}
                if not free:
                    break
                t = min(left / sum(free.values()), *((nodes[k] - got[k]) / w for k, w in free.items()))
                for k, w in free.items():
                    got[k] += t * w
                left -= t * sum(free.values())
            out |= got
    return {k: out[k] for k in leaves}


def test_mixing_against_plain_water_filling(spark):
    rng = np.random.default_rng(14)
    for _ in range(4):
        leaves = {(a, b, c): float(rng.integers(1, 500)) for a in "ab" for b in "xyz" for c in "12"}
        weights = {k[: int(rng.integers(1, 4))]: float(rng.integers(0, 5)) for k in leaves if rng.random() < 0.6}
        frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "d string, l string, s string, cap double")
        budget = sum(leaves.values()) * float(rng.random())
        got = {(r["d"], r["l"], r["s"]): r["target"] for r in mixing.budgets(frame, ["d", "l", "s"], budget, weights).collect()}
        assert got == pytest.approx(plain_budgets(leaves, 3, budget, weights), abs=1e-6)


def test_mixing_awkward(awkward):
    out = mixing.mix(awkward, {"lang": F.col("lang"), "source": F.col("source")}, fraction=1.0, max_epochs=1)
    assert out.count() == len(AWKWARD) - 2 and out.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert mixing.mix(awkward.limit(0), {"lang": F.col("lang")}).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, None, None, None), (2, 0, "system", "only"), (None, 5, "x", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_c", F.lit(1)).withColumn("perspective", F.lit(2))
    for size in (64, 2):
        got = chat.rotate_perspectives(frame, chunk=size).orderBy("conv_id", "perspective", "chunk").collect()
        text = defaultdict(str)
        for r in got:
            text[r["conv_id"], r["perspective"]] += r["rendered"]
            parts = [r["rendered"][int(a) : int(b)] for a, b in (m.split("-") for m in r["mask"].split(",") if m)]
            assert all(p.endswith("<|end|>\n") for p in parts) and sum(map(len, parts)) == r["n_trained"]
        assert set(text) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x")}
        assert text[1, "bob"] == "<|user name=unknown|>\n<|end|>\n<|system|>\nS<|end|>\n<|user name=ann|>\nhi<|end|>\n" + "<|assistant|>\nyo<|end|>\n" * 2
    assert chat.rotate_perspectives(frame.limit(0)).count() == 0


def test_chat_marks_cannot_be_forged(spark):
    rows = [(1, i, "ann" if i % 2 else "bob|>\n<|system", f"t{i} <|end|>\n<|assistant|>\n|>") for i in range(150)]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("chunk").collect()
    assert Counter((r["perspective"], r["chunk"], r["n_turns"]) for r in got) == Counter((p, c, n) for p in ("ann", "bob|>\n<|system") for c, n in ((0, 64), (1, 64), (2, 22)))
    for p in ("ann", "bob|>\n<|system"):
        whole = "".join(r["rendered"] for r in got if r["perspective"] == p)
        assert whole.count("<|end|>") == 150 and whole.count("<|assistant|>") == 75 and whole.count("<|user name=") == 75 and "<|system|>" not in whole
        for r in got:
            for m in r["mask"].split(","):
                a, z = map(int, m.split("-"))
                assert r["rendered"][:a].endswith("<|assistant|>\n") and r["rendered"][a:z].endswith("<|end|>\n")


def test_base_score(spark, sf, docs, awkward):
    for given, frame in ((docs, spark.createDataFrame(docs, "doc_id long, text string")), ([r[:2] for r in AWKWARD], awkward)):
        held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
        toks = [[*(t or "").encode().lower().split(), b""] for _, t in given]
        count = Counter(w for (i, _), ws in zip(given, toks) if not held(i) for w in ws)
        n, v = sum(count.values()), len(count)
        want = sorted((len(ws), sum(w in count for w in ws), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4)) for ws in toks)
        for size in (brown.HELD, 50):
            out = brown.score_texts(frame, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2, held=size).collect()
            assert sorted((r["_n_tokens"], r["_n_known"], round(r["_base"], 4)) for r in out) == want and {r["_train_tokens"] for r in out} == {n}
    assert brown.score_texts(awkward.limit(0), F.lit(True)).count() == 0


def test_exchange_raises_likelihood_and_finds_classes():
    rng = np.random.default_rng(6)
    truth = np.r_[np.zeros(10, int), np.ones(10, int), [2]]
    move = np.array([[0.1, 0.8, 0.1], [0.8, 0.1, 0.1], [0.5, 0.5, 0.0]])
    pairs, at = np.zeros((21, 21), np.int64), 20
    for _ in range(20000):
        k = rng.choice(3, p=move[truth[at]])
        new = 20 if k == 2 else int(rng.integers(10) + 10 * k)
        pairs[at, new] += 1
        at = new
    cls = brown.exchange(pairs, 20, 2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10] and cls[20] == 2


def test_settle_finds_the_likeliest_class():
    """Against the likelihood counted anew for each class; the word shares no cell with the class it leaves."""
    rng, total, learned = np.random.default_rng(13), 9, 4
    grid = rng.integers(50, 90, (total, total)).astype(float)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    for _ in range(40):
        own = int(rng.integers(learned, total))
        left, right = (np.where(rng.random(total) < 0.5, rng.integers(1, 9, total), 0) for _ in range(2))
        left[own] = right[own] = 0
        if not left.any() or not right.any():
            continue
        less = grid.copy()
        less[:, own] -= left
        less[own] -= right
        values = {}
        for c in (*range(learned), own):
            now = less.copy()
            now[:, c] += left
            now[c] += right
            values[c] = f(now) - f(now.sum(0)) - f(now.sum(1))
        x = np.r_[brown._LEFT + np.flatnonzero(left), brown._RIGHT + np.flatnonzero(right)]
        got = int(brown.settle(np.array([0]), x, np.r_[left[left > 0], right[right > 0]], np.array([own]), grid, learned)[0])
        assert values[got] > max(values.values()) - 0.05


def plain_score(given, held_out, place, total):
    """The class bigram model counted one token after another, ``place`` (context class, class) of each word."""
    toks = [[*(t or "").encode().lower().split(), b""] for _, t in given]
    count = Counter(w for (i, _), ws in zip(given, toks) if not held_out(i) for w in ws)
    grid, size, types = np.zeros((total, total)), np.zeros(total), np.zeros(total)
    for (i, _), ws in zip(given, toks):
        if not held_out(i):
            for a, b in zip([b"", *ws], ws):
                grid[place(a)[0], place(b)[1]] += 1
    for w, c in count.items():
        size[place(w)[1]] += c
        types[place(w)[1]] += 1
    step = np.log10((grid + 1) / (grid.sum(1, keepdims=True) + total))
    return [sum(step[place(a)[0], place(b)[1]] + np.log10((count[b] + 1) / (size[place(b)[1]] + types[place(b)[1]] + 1)) for a, b in zip([b"", *ws], ws)) for ws in toks]


def test_exchange_runs_until_none_moves():
    """Each word follows its right neighbour, so classes move along a chain of 78 words by one a round."""
    n = 80
    pairs, w = np.zeros((n + 1, n + 1), np.int64), np.arange(2, n - 1)
    pairs[0, 0] = pairs[1, 1] = 10**7
    pairs[w, w + 1] = pairs[w + 1, w] = w
    assert brown.exchange(pairs, n, 2).tolist() == [0] + [1] * (n - 1) + [2]


@pytest.mark.parametrize(("held", "seen"), [(brown.HELD, 1), (40, 1), (0, 1), (brown.HELD, 2), (40, 2)])
def test_score_is_that_of_its_classes(spark, docs, monkeypatch, held, seen):
    """With the classes that training has found each score against a plain count: words seen once join classes by exchange, and words that no task holds act as contexts by theirs; rows of many batches."""
    spied = {}
    for name in ("encode", "settle_rest"):
        monkeypatch.setattr(brown, name, lambda *a, f=getattr(brown, name), n=name, **k: spied.setdefault(n, [*a, f(*a, **k)])[-1])
    given = [(i, t) for i, t in docs[:60]] + [(900, None), (901, "neverseen word2 neverseen"), (902, "x" * 300 + " word2 " + "x" * 300), (903, ""), (904, "x" * 300)]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["doc_id"]: r for r in brown.score_texts(spark.createDataFrame(given, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, core=20, classes=4, held=held, seen=seen).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order, (placed, rare, _) = {w: i for i, w in enumerate(spied["encode"][2])}, spied["settle_rest"][-1]
    learned, rare = spied["settle_rest"][6], {r["h"]: r["class"] for r in rare.collect()}
    assert len(order) >= 20 and (len(order) <= held + 21) and b"" in order

    def place(w):
        h = xxhash.xxh64_intdigest(w, 42)
        return (int(placed[order[w]]) if w in order else rare.get(h - (1 << 64) * (h >> 63), learned + brown.shape(w)),) * 2

    for (i, _), want in zip(given, plain_score(given, out, place, learned + brown.SHAPES)):
        assert abs(got[i]["_score"] - want) < 1e-6 * max(1, abs(want))
    count = Counter(w for i, t in given if not out(i) for w in [*(t or "").encode().lower().split(), b""])
    assert [got[i]["_n_known"] for i, _ in given] == [sum(w in count for w in [*(t or "").encode().lower().split(), b""]) for _, t in given]
    once = sum(place(w)[0] < learned for w in count if count[w] == 1)
    assert (once > 0.5 * sum(c == 1 for c in count.values()) if seen == 1 else once <= 20) and place(b"")[0] == learned


def test_scores_do_not_depend_on_what_is_held(spark, docs):
    """Where a word's count lies changes nothing: equal scores for any ``held``, below the core's size and at 0 too."""
    frame = spark.createDataFrame([(i, t) for i, t in docs[:60]] + [(900, None), (902, "x" * 300 + " word2")], "doc_id long, text string")
    runs = [{r["doc_id"]: (r["_score"], r["_base"], r["_n_known"]) for r in brown.score_texts(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, core=20, classes=4, held=h).collect()} for h in (200_000, 500, 40, 0)]
    for run in runs[1:]:
        assert run.keys() == runs[0].keys() and all(abs(a - b) < 1e-6 * max(1, abs(a)) for i in run for a, b in zip(runs[0][i], run[i]))


def test_words_seen_equally_often_are_held(spark, monkeypatch):
    """A corpus whose words are all seen once: those that fit are held, so exchange has words to move."""
    spied = {}
    for name in ("encode", "exchange"):
        monkeypatch.setattr(brown, name, lambda *a, f=getattr(brown, name), n=name, **k: spied.setdefault(n, [*a, f(*a, **k)])[-1])
    frame = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(20)], "doc_id long, text string")
    out = brown.score_texts(frame, F.lit(True), core=20, classes=4, held=60).collect()
    assert 40 < len(spied["encode"][2]) <= 80 and spied["exchange"][1] == 20
    assert {r["_n_known"] for r in out} == {11} and all(abs(r["_base"] - (10 * np.log10(2 / 422) + np.log10(21 / 422))) < 1e-6 for r in out)


def test_classes_beat_the_base(spark, sf):
    out = queries.op10_lm_scoring(spark, sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_gradients():
    rng = np.random.default_rng(7)
    model = attention_mil.Model()
    x, starts, y = rng.normal(size=(9, attention_mil.FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(model.forward(x, starts)[0]) + (1 - y) * np.log(1 - model.forward(x, starts)[0]))
    p, kept = model.forward(x, starts)
    for k, g in model.gradients(p, y, kept, starts).items():
        at = tuple(int(rng.integers(s)) for s in model.p[k].shape)
        model.p[k][at] += 1e-6
        up = loss()
        model.p[k][at] -= 2e-6
        down = loss()
        model.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_training_takes_whole_documents_within_its_bounds(spark, monkeypatch):
    """Repeated ids and labels add no rows, the word bound drops documents but no passage, and packing loses nothing but half precision."""
    rows = [(i, f"w{i} " * (64 * (1 + i % 40))) for i in range(40)] + [(3, "again"), (None, "x"), (99, None)]
    labels = [(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (99, 1), (98, None)]
    seen = []
    monkeypatch.setattr(attention_mil.Model, "fit", lambda self, bags, y: seen.append((bags, y)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    attention_mil.train(docs, marks, F.lit(True))
    attention_mil.train(docs.repartition(3), marks, F.lit(True), sample_words=64 * 100)
    attention_mil.train(docs, marks, F.lit(True), sample=10)
    full, some, few = seen
    assert len(full[0]) == 41 and len(few[0]) == 10 and sum(len(b) for b in full[0]) >= 780 and full[1].sum() == 21
    assert 0 < sum(len(b) for b in some[0]) <= 101 and all(len(b) == max(1, round(float((b[:, 1] > 0).sum()))) for b in some[0])
    want = attention_mil.encode(rows[5][1])
    assert any(b.shape == want.shape and np.allclose(b, want, atol=2e-3) for b in full[0])


def test_classifier_held_out(spark, sf, awkward):
    big = sf.replace("0.001", "0.01")
    out = queries.op1_quality_classifier(spark, big).join(table(spark, big, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95
    assert attention_mil.score(awkward, attention_mil.Model()).count() == len(AWKWARD)
    assert attention_mil.score(awkward.limit(0), attention_mil.Model()).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def least_of_groups(texts, share=0.8):
    """Every pair compared: the least id of each group under links of at least that Jaccard similarity of five-word shingles."""
    sets, root = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) and root[a] != root[b]:
                keep, gone = sorted((root[a], root[b]))
                root = {i: keep if r == gone else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("part", [simhash.PART, 4])
def test_similar_is_exact(spark, monkeypatch, part):
    """Chains whose ends differ, pairs just under the similarity, copies, short and empty texts, in whole and cut groups."""
    monkeypatch.setattr(simhash, "PART", part)
    rng, texts = np.random.default_rng(8), {}
    for g in range(6):
        w = [f"w{x}" for x in rng.integers(0, 1 << 30, 150)]
        for _ in range(12):
            at, n = int(rng.integers(130)), int(rng.integers(1, 20))
            w = w[:at] + [f"v{x}" for x in rng.integers(0, 1 << 30, n)] + w[at + n :]
            texts[len(texts)] = " ".join(w)
    texts |= {100: texts[7], 101: "", 102: " ", 103: "one two", 104: "One two", 105: "q " * 9, 106: "q q q q q q q q z", 107: None}
    got = simhash.simhash_similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = least_of_groups(texts)
    assert 15 < len(set(want.values())) < 60 and {r["id"]: r["component"] for r in got} == want


def test_drop_similar_keeps_one_row_of_each_group(spark, awkward):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, a), (5, a + " x"), (5, b), (7, b + " y"), (9, "one two three"), (9, "one two three"), (None, a + " z"), (None, "only here"), (None, "only here"), (8, None), (10, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("mine"))
    for given in (frame, frame.repartition(5)):
        out = simhash.drop_similar(given)
        assert out.columns == given.columns
        assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(3, a), (5, b), (9, "one two three"), (None, "only here"), (8, None)])
    assert Counter(r["doc_id"] for r in simhash.drop_similar(awkward).collect()) == Counter([1, 2, None, 4, 6, 7, 8])


def test_similar_awkward(spark, awkward):
    got = simhash.simhash_similar(awkward).collect()
    assert Counter((r["id"], r["component"]) for r in got) == Counter({(1, 1): 2, (2, 2): 1, (3, 2): 1, (9, 2): 1, (None, None): 1, (4, 4): 1, (5, 4): 1, (6, 6): 1, (7, 7): 1, (8, 8): 1})
    assert simhash.simhash_similar(awkward.limit(0)).count() == 0


def test_pipeline(spark, sf):
    """Every stage against its own rule on its own input."""
    docs = table(spark, sf, "documents")
    columns, last = docs.columns, len(corpus_pipeline.STAGES) - 1
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert i == last or out.columns == columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.items() <= before.items()
        if i == 0:
            fitted = queries.potentials(spark, sf)
            assert after.keys() == {k for k, t in before.items() if line_crf.assess(t, fitted)[7]}
        if i == 1:
            assert after.keys() == set(least_of_groups(before).values())
        if i == 2:
            assert before.keys() - after.keys() == {r["doc_id"] for r in queries.op8_decontamination(spark, sf).filter("contaminated").collect()} & before.keys()
        if i == last:
            assert after == before
        docs = spark.createDataFrame(out.select(columns).collect(), docs.schema)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_awkward(spark, awkward, sf):
    """Null ids, texts, languages and sources, repeated rows, empty texts and clashing names, in every stage; and an empty table."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, sf)
        assert set(awkward.columns) <= set(out.columns), name
        assert {tuple(r) for r in out.select(*awkward.columns[4:]).collect()} == {tuple(range(len(awkward.columns) - 4))}, name
        kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert kept <= Counter((r[0], r[1]) for r in AWKWARD), name
        if name in ("sharding", "benchmark decontamination"):
            assert kept == Counter((r[0], r[1]) for r in AWKWARD), name
        assert stage(spark, awkward.limit(0), sf).count() == 0, name


#: Each operator and the columns that it adds; its other input columns come out as they were.
KEPT = {
    "score_texts": (lambda d: brown.score_texts(d, F.lit(True), core=5, classes=2), {"_n_tokens", "_n_known", "_train_tokens", "_base", "_score"}),
    "decontaminate": (lambda d: tiling.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(4)), {"_coverage", "_item", "_tiles"}),
    "decontaminate, joined": (lambda d: tiling.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id in (1, 7, 8)"), held_bytes=0), {"_coverage", "_item", "_tiles"}),
    "shuffle_shards": (sharding.shuffle_shards, {"_shard", "_bucket", "_slot"}),
    "drop_repeated_lines": (line_runs.drop_repeated_lines, {"_lines", "_clean", "_runs", "_copies"}),
    "drop_repeated_bytes": (byte_repeats.drop_repeated_bytes, {"_bytes", "_removed", "_kept"}),
    "drop_similar": (simhash.drop_similar, set()),
    "mix": (lambda d: mixing.mix(d, {"lang": F.col("lang"), "source": F.col("source")}), {"_epoch"}),
    "quality_rules": (line_crf.quality_rules, set(line_crf.COLUMNS.names)),
}


@pytest.mark.parametrize("name", KEPT)
def test_other_columns_survive(spark, awkward, name):
    run, added = KEPT[name]
    own = [c for c in awkward.columns[4:] if c not in added]
    out = run(awkward)
    want = awkward.select(*own).first()
    assert set(own) | added <= set(out.columns) and out.count() and all(tuple(r) == tuple(want) for r in out.select(*own).distinct().collect())


def test_sha_of_nothing(spark, sf):
    out = queries.op5_suffix_dedup(spark, sf).filter("n_removed = n_bytes").collect()
    assert all(r["kept_sha256"] == hashlib.sha256(b"").hexdigest() for r in out)


def test_contexts_handed_on_early_change_nothing(spark, monkeypatch):
    """A task holds few contexts at once, whatever a batch has; equal ones that it hands on apart still count as copies."""
    texts = ["".join(chr(97 + (i * i * k) % 23) for i in range(300)) for k in (1, 2, 3)]
    frame = spark.createDataFrame([(i, texts[i % 3] + str(i)) for i in range(12)], "doc_id long, text string").coalesce(1)
    want = {r["doc_id"]: bytes(r["_kept"]) for r in byte_repeats.drop_repeated_bytes(frame).collect()}
    monkeypatch.setattr(byte_repeats, "DOCUMENTS", 2)
    monkeypatch.setattr(byte_repeats, "CONTEXTS", 3)
    assert want == {r["doc_id"]: bytes(r["_kept"]) for r in byte_repeats.drop_repeated_bytes(frame).collect()}
    assert all(len(k) < 10 for k in want.values())
