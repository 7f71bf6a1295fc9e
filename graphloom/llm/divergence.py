"""Source divergence audit: an inverted index of terms that only emits corrections to a baseline."""

from __future__ import annotations

import string
import sys
from collections import _count_elements

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a text as its terms have them: terms are of letters, a to z for A to Z, and of all bytes of characters that aren't ASCII; all else is between them.
_LOWERED = bytes(c if c >= 128 or chr(c) in string.ascii_lowercase else c + 32 if chr(c) in string.ascii_uppercase else 32 for c in range(256))
#: Counts that a task holds before it hands them on.
FLUSH = 400_000
#: What a share of 1 counts as, and what each count is raised by.
SCALE, PRIOR = 1_000_000_000, 5
#: Sources that one list of postings is meant to hold.
BLOCK = 256


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers."""
    return F.expr(f"1 + (cast({count} + {PRIOR} as decimal(28, 0)) * {SCALE}) div cast({total} + {PRIOR} * {terms} as decimal(28, 0))")


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the rows that hold it.

    Only A to Z are lower-cased. Tasks count by group as they read and hand on what they have counted, so a group or a term with very many rows is a few rows in the shuffle; a task never holds more than about FLUSH counts.
    """
    counted = "lang string, source string, term binary, n bigint, docs bigint"

    def run(batches):
        seen: dict[tuple[str, str], tuple[dict, dict]] = {}
        size = 0

        def out(seen):
            for (own, src), (n, held) in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(n), pa.string()), pa.array([src] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([held[w] for w in n], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for own, src, text in zip(*(c.to_pylist() for c in b.columns)):
                words = text.translate(_LOWERED).split()
                n, held = seen.setdefault((own, src), ({}, {}))
                size -= len(n)
                _count_elements(n, words)
                _count_elements(held, set(words))
                size += len(n)
                if size > FLUSH:
                    yield from out(seen)
                    seen, size = {}, 0
        yield from out(seen)

    given = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text_col))
    own, src, text = given
    each = docs.select(own.alias("lang"), src.alias("source"), text.cast("binary").alias("text")).mapInArrow(run, counted)
    return each.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _one_sided(groups: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, source, other, g): what the source's own terms add to the pair if the other had none of them.

    A term of share p, for baselines b of the source and x of the other, adds |p - x| - |b - x|; p is b at least, so it is p - b up to x = b, b - p from x = p on, and p + b - 2x between. So a pair needs the number and the sum of the source's shares up to x: running sums over its distinct shares and the others' baselines.
    """
    shares = posts.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("n"))
    whole = shares.groupBy("lang", "source").agg(F.sum("n").alias("terms"), F.sum(F.col("n") * F.col("at")).alias("total"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("b").alias("at"))
    asked = groups.select("lang", "source").join(others, "lang").filter("source <> other")
    asked = asked.groupBy("lang", "source", "at").agg(F.lit(0).cast("bigint").alias("n"))
    upto = Window.partitionBy("lang", "source").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    below = shares.unionByName(asked).withColumns({"k": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("at")).over(upto)}).filter("n = 0").select("lang", "source", F.col("at").alias("x"), "k", "s")
    own = groups.select("lang", "source", "b").join(whole, ["lang", "source"])
    met = own.join(below, ["lang", "source"])
    g = F.when(F.col("x") <= F.col("b"), F.col("total") - F.col("terms") * F.col("b")).otherwise(F.col("k") * F.col("b") - F.col("s") + F.col("total") - F.col("s") + (F.col("terms") - F.col("k")) * (F.col("b") - 2 * F.col("x")))
    return met.select("lang", "source", "x", g.alias("g"))


def _both_sided(posts: DataFrame, blocks: int) -> DataFrame:
    """(lang, source, other, g), source before other: corrections of the terms that both have, to what the one-sided sums took them for.

    A term's postings are cut into lists of about ``BLOCK`` sources; pairs of lists of a term are opened next to each other and summed by pair before the shuffle.
    """
    packed = posts.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks))).groupBy("lang", "term", "block").agg(F.collect_list(F.struct("source", "p", "b")).alias("l"))
    left = packed.select("lang", "term", F.col("l").alias("a"))
    right = packed.select("lang", "term", F.col("l").alias("c"))
    each = left.join(right, ["lang", "term"]).select("lang", F.explode("a").alias("a"), "c").select("lang", "a", F.explode("c").alias("c")).filter("a.source < c.source")
    size = lambda x, y: F.abs(F.col(x) - F.col(y))
    g = size("a.p", "c.p") - size("a.p", "c.b") - size("a.b", "c.p") + size("a.b", "c.b")
    return each.select("lang", F.col("a.source").alias("source"), F.col("c.source").alias("other"), g.alias("g")).filter("g <> 0").groupBy("lang", "source", "other").agg(F.sum("g").alias("g"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's use of words is from each other source of its language (part ``pair``), and the words that it uses more than the language does (``term``, the first ``top``).

    A language keeps the V terms in at least ``least_docs`` of its rows. A group (lang, source), or a language, gives each of them the share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)). The value of a pair is the sum of |p - q| over all kept terms. It starts at V times the difference of the shares that a count of zero has on either side, and the index of postings adds corrections for terms that a source has: in closed form where the other may lack them, term by term where both have them. So no row is made for terms that neither has, and none that only one has is paired.
    The value of a term is p - q against the language's share q, where the source has it and p > q. Ranks go from 1 by value descending, then by the item's UTF-8 bytes.

    Null languages, sources and texts read as ''; a group without terms has shares all the same, and pairs of a language that keeps none have the value 0. Repeated rows count each time; no other column is read; an empty table gives none.
    """
    counts = materialize(term_counts(docs, lang, source, text_col))
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    posts = counts.drop("docs").join(kept, ["lang", "term"])
    sums = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_n"])
    groups = materialize(groups.withColumn("b", F.when(F.col("v") > 0, _share("0", "total", "greatest(v, 1)")).otherwise(0)))
    posts = posts.join(groups, ["lang", "source"])
    posts = materialize(posts.withColumns({"p": _share("n", "total", "v"), "q": _share("all_n", "lang_n", "v")}).select("lang", "source", "term", "p", "q", "b"))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0

    one, both = materialize(_one_sided(groups, posts)), _both_sided(posts, max(1, -(-most // BLOCK)))
    other = groups.select("lang", F.col("source").alias("other"), F.col("b").alias("x"))
    pairs = groups.select("lang", "source", "b", "v").join(other, "lang").filter("source < other")
    pairs = pairs.join(one.withColumnRenamed("g", "g1"), ["lang", "source", "x"], "left")
    pairs = pairs.join(one.select("lang", F.col("source").alias("other"), F.col("x").alias("b"), F.col("g").alias("g2")), ["lang", "other", "b"], "left")
    pairs = pairs.join(both, ["lang", "source", "other"], "left").fillna(0, ["g", "g1", "g2"])
    pairs = pairs.select("lang", "source", "other", (F.col("v") * F.abs(F.col("b") - F.col("x")) + F.col("g1") + F.col("g2") + F.col("g")).alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("w")
    pairs = pairs.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    terms = posts.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
