"""Counts and groupings over elements and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repo_stats(elements: DataFrame) -> DataFrame:
    return elements.groupBy("repo_id").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("elements"))


def status_totals(repos: DataFrame) -> DataFrame:
    return repos.agg(F.count("*").alias("repos"), F.coalesce(F.sum("element_count"), F.lit(0)).alias("elements"))


def type_histogram(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by, "element_type").agg(F.count("*").alias("n"))


def file_paths(elements: DataFrame, repo_id: str) -> DataFrame:
    return elements.filter((F.col("repo_id") == repo_id) & F.col("file_path").isNotNull()).select("file_path").distinct().orderBy("file_path")


def file_tree(elements: DataFrame) -> DataFrame:
    """(repo_id, path, depth, is_dir, files): every directory and file, and the files at or below it."""
    files = elements.filter("file_path is not null").select("repo_id", "file_path").distinct().withColumn("_s", F.split("file_path", "/"))
    steps = files.select("repo_id", F.size("_s").alias("_n"), "_s", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("depth"))
    steps = steps.select("repo_id", F.array_join(F.slice("_s", F.lit(1), F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.col("_n")).alias("is_dir"))
    return steps.groupBy("repo_id", "path", "depth", "is_dir").agg(F.count("*").alias("files"))


def config_files(elements: DataFrame, repo_id: str | None = None, limit: int = 200) -> DataFrame:
    """CONFIG_FILE elements and FILE elements in YAML or JSON, each once: of one repository the first ``limit`` by path, else all."""
    own = elements if repo_id is None else elements.filter(F.col("repo_id") == repo_id)
    found = own.filter((F.col("element_type") == "CONFIG_FILE") | ((F.col("element_type") == "FILE") & F.col("language").isin("YAML", "JSON"))).dropDuplicates(["id"]).orderBy("file_path", "id")
    return found if repo_id is None else found.limit(limit)
