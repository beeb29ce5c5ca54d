"""Exact duplicate groups, the keeper of each, and what to do with the others.

Groups are never listed: members are rows, and a group's keeper is a grouped minimum, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.config import Config


def exact_groups(assets: DataFrame, digest: str = "digest") -> DataFrame:
    """Members of groups of two or more, with n."""
    n = assets.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("n")).where("n > 1")
    return assets.join(n, digest)


#: The column that a rule looks at.
NEEDS = {"highest_resolution": "pixels", "oldest_creation_date": "created", "smallest_file_size": "size", "largest_file_size": "size", "preferred_format": "format", "preferred_directory": "path"}


def _term(rule: str, config: Config, columns: dict[str, str]) -> list[Column]:
    """Ascending sort terms; nulls come last."""
    if NEEDS[rule] not in columns:
        raise ValueError(f"{rule} needs a column for {NEEDS[rule]}")
    col = F.col(columns[NEEDS[rule]])
    if rule in ("highest_resolution", "largest_file_size"):
        return [col.isNull(), -col]
    if rule in ("oldest_creation_date", "smallest_file_size"):
        return [col.isNull(), col]
    if rule == "preferred_format":
        if not config.preferred_formats:
            return []
        place = F.array_position(F.array(*map(F.lit, config.preferred_formats)), col)
        return [F.coalesce(place, F.lit(0)) == 0, place]
    hits = F.lit(len(config.preferred_directories))
    for i, d in reversed(list(enumerate(config.preferred_directories))):
        hits = F.when(col.startswith(d.rstrip("/") + "/"), i).otherwise(hits)
    return [hits]


def keepers(assets: DataFrame, path: str, columns: dict[str, str], config: Config | None = None, digest: str = "digest") -> DataFrame:
    """digest, keeper and n for each group of two or more; ties go to the smallest path. columns says where the rules find
    pixels, size, created and format; a rule without its column is an error."""
    config = config or Config()
    terms = [t for r in config.prioritization for t in _term(r, config, columns | {"path": path})]
    key = F.struct(*[t.alias(f"k{i}") for i, t in enumerate(terms)], F.col(path).alias("keeper"))
    return assets.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("best"), F.count("*").alias("n")).where("n > 1").select(digest, F.col("best.keeper").alias("keeper"), "n")


def action_plan(assets: DataFrame, kept: DataFrame, path: str, config: Config | None = None, digest: str = "digest") -> DataFrame:
    """A row for each duplicate that isn't kept. Deleting goes before linking, linking before moving; nothing is carried out."""
    config = config or Config()
    kind = "delete" if config.delete_duplicates else "symlink" if config.create_symlinks else "move"
    name = F.element_at(F.split(F.col(path).cast("string"), "/"), -1)
    target = F.concat(F.lit(config.duplicates_dir + "/"), name) if kind == "move" else F.lit(None).cast("string")
    rows = assets.join(kept.select(digest, "keeper"), digest).where(F.col(path) != F.col("keeper"))
    return rows.select(digest, F.col("keeper").alias("original_path"), F.col(path).alias("duplicate_path"), F.lit(kind).alias("action_type"), target.alias("target_path"), F.lit(config.dry_run).alias("dry_run"))


def action_results(plan: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """action_type, duplicate_path, original_path, success and error: what carrying out the plan would come to, given the
    paths that are there. Of several duplicates with one target the smallest path has it. Nothing is carried out."""
    there = present.select(F.col(path).cast("string").alias("there")).distinct()
    out = plan
    for name in ("original_path", "duplicate_path", "target_path"):
        out = out.join(there.select(F.col("there").cast(plan.schema[name].dataType).alias(name), F.lit(True).alias(f"has_{name}")), name, "left")
    first = plan.where("target_path is not null").groupBy("target_path").agg(F.min("duplicate_path").alias("first"))
    error = F.when(F.col("has_original_path").isNull(), "original not found").when(F.col("has_duplicate_path").isNull(), "duplicate not found")
    error = error.when(F.col("has_target_path") | (F.col("first") != F.col("duplicate_path")), "target exists")
    return out.join(first, "target_path", "left").select("action_type", "duplicate_path", "original_path", error.isNull().alias("success"), error.alias("error"))


def representative_pairs(assets: DataFrame, path: str, digest: str = "digest") -> DataFrame:
    """Each duplicate with its group's smallest path: all links of a group, without all its pairs."""
    first = assets.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(path).alias("first"), F.count("*").alias("n")).where("n > 1")
    return assets.join(first.select(digest, "first"), digest).where(F.col(path) != F.col("first")).select("first", F.col(path).alias("other"))
