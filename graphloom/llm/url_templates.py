"""URL filters: rules by host suffix, and a tree of path templates judged by smoothed labelled purity, in DataFrame operations alone."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, replaced

#: Segments of a path that the tree looks at; what lies deeper belongs to the template above.
DEPTH = 6
#: A segment keeps a branch of its own with at least so many pages and this share of its parent's; else it is variable.
LEAST_PAGES, LEAST_SHARE = 5, 0.01
#: Labelled pages that the purity of the parent weighs as.
PRIOR = 10.0
#: Squared normal deviate from which the purities of two branches differ (0.05).
DIFFERENT = 3.841459
#: Templates of a purity below this go.
PURE = 0.75
#: Rules that one plan may hold.
MOST_RULES = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to /, ? or #, A to Z lower-cased; then up to ? or #. Both are '' for a null or one without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, as (rule, verdict), or null. A rule "host/path" fits its host and all subdomains where the path starts with its own."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a plan may hold {MOST_RULES}")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules.items(), key=lambda r: (len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shapes(path: Column) -> Column:
    """The path's segments; long hexadecimal ones and runs of digits, which vary from page to page, become wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(F.slice(parts, 1, DEPTH), lambda s: F.when(s.rlike(r"^[0-9a-fA-F-]{16,}\z"), "<hex>").otherwise(F.regexp_replace(s, r"[0-9]+", "<num>")))


def _smooth(good: str, labelled: str, prior: Column) -> Column:
    return (F.col(good).cast("double") + F.lit(PRIOR) * prior) / (F.col(labelled).cast("double") + F.lit(PRIOR))


def _branches(at: DataFrame) -> DataFrame:
    """at (node, purity, segment, pages, good, labelled), a row a path -> (node, segment, child, purity) for the segments that keep a branch, and for '*', all others.

    First what is too rare is joined into '*', so a node has at most 1 / LEAST_SHARE + 2 branches, however many segments it had. Then branches whose smoothed purities don't differ are merged, in order of purity, each with the one before it.
    """
    sums = lambda df, *by: df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("pages", "good", "labelled")))
    each = materialize(sums(at, "node", "purity", "segment"))
    own = each.groupBy("node").agg(F.sum("pages").alias("all_pages"))
    kept = each.join(own, "node").withColumn("kept", (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.lit(LEAST_SHARE) * F.col("all_pages")))
    found = sums(kept.withColumn("segment", F.when(F.col("kept"), F.col("segment")).otherwise("*")), "node", "purity", "segment")
    found = found.withColumns({"p": _smooth("good", "labelled", F.col("purity")), "m": F.col("labelled").cast("double") + F.lit(PRIOR)})
    order = Window.partitionBy("node").orderBy("p", "segment")
    found = found.withColumns({"p0": F.lag("p").over(order), "m0": F.lag("m").over(order)})
    both = (F.col("p") * F.col("m") + F.col("p0") * F.col("m0")) / (F.col("m") + F.col("m0"))
    apart = (F.col("p") - F.col("p0")) * (F.col("p") - F.col("p0")) > F.lit(DIFFERENT) * (both * (F.lit(1.0) - both)) * (F.lit(1.0) / F.col("m") + F.lit(1.0) / F.col("m0"))
    found = found.withColumn("merged", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    group = sums(found, "node", "purity", "merged").join(found.groupBy("node", "merged").agg(F.sort_array(F.collect_list("segment")).alias("names")), ["node", "merged"])
    name = F.when(F.size("names") > 1, F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}"))).otherwise(F.col("names")[0])
    group = group.select("node", "merged", F.concat("node", F.lit("/"), name).alias("child"), _smooth("good", "labelled", F.col("purity")).alias("child_purity"))
    return found.select("node", "merged", "segment").join(group, ["node", "merged"]).drop("merged")


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, shape, pages, good, labelled) -> (host, shape, template, purity).

    A tree for each host, grown level by level: variable segments become '*', branches that don't differ in labelled purity are merged, and a node's purity is that of its labelled pages with its parent's as PRIOR more. The host's parent is the whole table. Only distinct shapes take part, not pages.
    """
    total = paths.agg(F.sum("good").alias("g"), F.sum("labelled").alias("n")).first()
    root = ((total["g"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).select("host", _smooth("good", "labelled", F.lit(root)).alias("purity"))
    at = materialize(paths.join(hosts, "host").withColumn("node", F.col("host")))
    done = []
    for level in range(DEPTH):
        ended = F.size("shape") <= level
        done.append(at.filter(ended).select("host", "shape", F.col("node").alias("template"), "purity"))
        at = at.filter(~ended).withColumn("segment", F.col("shape")[level])
        if at.isEmpty():
            break
        last = (F.size("shape") == level + 1).cast("int")  # a page and a branch of one name are apart
        at = at.withColumn("segment", F.concat("segment", F.when(last == 1, "").otherwise("/")))
        found = materialize(_branches(at.select("node", "purity", "segment", "pages", "good", "labelled")))
        own = found.withColumnsRenamed({"child": "c1", "child_purity": "p1"})
        rest = found.filter("segment = '*'").select("node", F.col("child").alias("c2"), F.col("child_purity").alias("p2"))
        at = at.join(own, ["node", "segment"], "left").join(rest, "node", "left")
        at = materialize(at.withColumns({"node": F.coalesce("c1", "c2"), "purity": F.coalesce("p1", "p2")}).drop("c1", "p1", "c2", "p2", "segment"))
    done.append(at.filter(F.size("shape") >= DEPTH).select("host", "shape", F.col("node").alias("template"), "purity"))
    return reduce(DataFrame.unionByName, done)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", label_key: str = "doc_id", label: str = "quality", pure: float = PURE) -> DataFrame:
    """pages with ``_host``, ``_path``, ``_rule``, ``_verdict``, ``_template`` and ``_purity``: allow or block for each url.

    The longest of the ``rules`` that fits a url decides; where none does, its template: block if the smoothed share of label 1 among its labelled pages is below ``pure``. Labels are of pages, by ``label_key``; a page of several labels counts each, a null label doesn't count.
    Null and empty urls, and those without ://, have the host and path '' and a template of their own; repeated rows count each time and all stay; a path's empty segments don't count. An empty table gives none. Other columns pass through, whatever their names, but for those that this adds.
    """
    added = ["_host", "_path", "_rule", "_verdict", "_template", "_purity"]
    docs = replaced(pages, *added)
    host, path = split_url(F.col(url))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_key).alias("k")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("good"), F.count("*").alias("labelled"))
    slim = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path")).withColumn("shape", shapes(F.col("path")))
    paths = slim.join(known, "k", "left").groupBy("host", "shape").agg(F.count("*").alias("pages"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"))
    found = materialize(templates(materialize(paths)).select(F.struct("host", "shape").alias("place"), F.struct("template", "purity").alias("judged")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    each = docs.select(row, host.alias("host"), path.alias("path"))
    each = each.select("row", "host", "path", F.struct("host", shapes(F.col("path")).alias("shape")).alias("place"), rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    verdict = F.coalesce("rule.verdict", F.when(F.col("judged.purity") < pure, "block").otherwise("allow"))
    return each.join(found, "place").select("row.*", F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("rule.rule").alias("_rule"), verdict.alias("_verdict"), F.col("judged.template").alias("_template"), F.col("judged.purity").alias("_purity"))
