"""Paths, directories, routes to references, and the states of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a file.
UNKNOWN, SCHEDULED, COMPRESSED = 0, 1, 2


def path_tokens(paths: DataFrame) -> DataFrame:
    """id, depth, name: the steps of each path."""
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    return paths.select("id", F.posexplode(steps).alias("depth", "name"))


def dir_tree(paths: DataFrame) -> DataFrame:
    """path, parent, name, is_dir: every path and every directory above one, once."""
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.select(steps.alias("s")).withColumn("n", F.size("s")).filter("n > 0")
    nodes = rows.select("s", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "n")
    path = lambda k: F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), k), "/"))
    nodes = nodes.select(path(F.col("k")).alias("path"), path(F.col("k") - 1).alias("parent"), F.get("s", F.col("k") - 1).alias("name"), (F.col("k") < F.col("n")).alias("is_dir"))
    return nodes.groupBy("path", "parent", "name").agg(F.bool_or("is_dir").alias("is_dir"))


def dir_listing(tree: DataFrame) -> DataFrame:
    """parent, n_dirs, n_files: what stands in each directory."""
    return tree.groupBy("parent").agg(F.count_if("is_dir").alias("n_dirs"), F.count_if(~F.col("is_dir")).alias("n_files"))


def children(tree: DataFrame, directory: str) -> DataFrame:
    return tree.filter(F.col("parent") == directory).select("name", "is_dir")


def dir_summary(files: DataFrame) -> DataFrame:
    """dir, n_files, n_bytes of files (path, size), directories above not counted in."""
    return files.groupBy(F.regexp_replace("path", "[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("n_bytes"))


def serialize_listing(tree: DataFrame) -> DataFrame:
    """parent, listing: names in order, directories with a slash, joined by ` , `."""
    name = F.when(F.col("is_dir"), F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    return tree.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list(name)), " , ").alias("listing"))


def parse_listing(listings: DataFrame) -> DataFrame:
    """The inverse: parent, name, is_dir."""
    rows = listings.select("parent", F.explode(F.split("listing", " , ")).alias("x"))
    return rows.select("parent", F.regexp_replace("x", "/$", "").alias("name"), F.col("x").endswith("/").alias("is_dir"))


def route(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """id, path, ref_id: the reference of the deepest configured directory above a path; none: null.

    A prefix fits what is strictly longer. Every directory above a path is looked up by an
    equality join, so that the number of routes does not multiply the rows.
    """
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.select("id", "path", steps.alias("s"))
    above = rows.select("id", "path", F.explode(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)))).alias("k"), "s")
    above = above.select("id", "path", "k", F.concat(F.lit("/"), F.array_join(F.slice("s", F.lit(1), F.col("k")), "/")).alias("prefix"))
    found = above.join(routes.select(F.regexp_replace("prefix", "(.)/$", "$1").alias("prefix"), "ref_id"), "prefix", "left")
    return found.groupBy("id", "path").agg(F.max_by("ref_id", F.when(F.col("ref_id").isNotNull(), F.col("k"))).alias("ref_id"))


def next_state(files: DataFrame, events: DataFrame) -> DataFrame:
    """path, status after events (path, event): created files are scheduled, released ones compressed."""
    last = events.groupBy("path").agg(F.max(F.when(F.col("event") == "release", COMPRESSED).when(F.col("event") == "create", SCHEDULED).otherwise(UNKNOWN)).alias("new"))
    return files.join(last, "path", "full_outer").select("path", F.greatest(F.coalesce("status", F.lit(UNKNOWN)), F.coalesce("new", F.lit(UNKNOWN))).alias("status"))


def rename(files: DataFrame, old: str, new: str, suffix: str) -> DataFrame:
    """path, action for one rename: whether the suffix's coming or going asks to encode or decode."""
    was, will = old.endswith(suffix), new.endswith(suffix)
    action = "encode" if will and not was else "decode" if was and not will else "none"
    hit = F.col("path") == old
    return files.select(F.when(hit, new).otherwise(F.col("path")).alias("path"), F.when(hit, F.lit(action)).otherwise("none").alias("action"))


def rename_all(files: DataFrame, moves: DataFrame, suffix: str) -> DataFrame:
    """path, action for many renames (old, new): the same by a join."""
    rows = files.join(moves, F.col("path") == F.col("old"), "left")
    was, will = F.col("path").endswith(suffix), F.col("new").endswith(suffix)
    action = F.when(will & ~was, "encode").when(was & ~will, "decode").otherwise("none")
    return rows.select(F.coalesce("new", "path").alias("path"), F.coalesce(action, F.lit("none")).alias("action"))


def remove(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone, "path", "left_anti")
