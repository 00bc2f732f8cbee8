"""Crawl registries, frontiers and trees as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import kept


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def breadth_first(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """url and depth of all that start (url) reaches over edges (src, dst) within max_depth steps; first discovery wins."""
    seen = kept(start.select("url").distinct().withColumn("depth", F.lit(0)))
    edge = edges.select("src", "dst").distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(edge, front.url == edge.src).select(F.col("dst").alias("url")).distinct()
        front = kept(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def depth_first(children: dict, roots: list, max_pages: int) -> list:
    """Visit order of a frontier whose last discovery is visited first; a small graph, on the driver."""
    stack, seen, out = list(roots), set(roots), []
    while stack and len(out) < max_pages:
        node = stack.pop()
        out.append(node)
        for c in children.get(node, []):
            if c not in seen:
                seen.add(c)
                stack.append(c)
    return out


def collisions(rows: DataFrame, path: str, slug: str) -> DataFrame:
    """Paths that several rows would share get their URL's last segment instead of the text."""
    n = F.count("*").over(Window.partitionBy("page_id", path))
    return rows.withColumn("n", n).withColumn("path", F.when(F.col("n") > 1, F.concat(F.col("parent"), F.lit("//"), F.col(slug))).otherwise(F.col(path)))


def parents_by_prefix(paths: DataFrame) -> DataFrame:
    """path and the longest other path that is a beginning of it (at a '/'); null if none."""
    own = paths.select("path").distinct()
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split(F.col("path"), "/"), F.lit(1), n), "/"))
    many = own.where(F.contains("path", F.lit("/"))).select("path", F.explode(cut).alias("prefix"))
    found = many.join(own.withColumnRenamed("path", "prefix"), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("parent"))
    return own.join(found, "path", "left")


def parents_by_url(nodes: DataFrame) -> DataFrame:
    """Nodes (url, parent_url, depth, ord) with the first node of their parent's URL one level up."""
    up = nodes.select(F.col("url").alias("p_url"), F.col("depth").alias("p_depth"), F.col("ord").alias("p_ord"))
    met = nodes.join(up, (nodes.parent_url == up.p_url) & (nodes.depth == up.p_depth + 1), "left")
    return met.groupBy("ord", "url", "depth", "parent_url").agg(F.min("p_ord").alias("parent_ord"))


def relabel(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Paths (ord, path) of nodes (ord, parent_ord, label) from roots to leaves.

    Paths double in length every round. Nodes that no root reaches have no row; one deeper than depth, if that is given, raises.
    """
    done = kept(nodes.where("parent_ord is null").select("ord", F.col("label").alias("path")))
    rest = kept(nodes.where("parent_ord is not null").select("ord", F.col("parent_ord").alias("up"), F.col("label").alias("path")))
    length, most = 1, nodes.count() if depth is None else depth
    none = F.lit(None).cast(nodes.schema["ord"].dataType)
    while rest.limit(1).count():
        if length > most:
            if depth is None:  # more nodes than there are: a circle
                break
            raise RuntimeError(f"nodes lie deeper than {depth} levels")
        state = done.select(F.col("ord").alias("at"), none.alias("beyond"), F.col("path").alias("head")).union(rest.select("ord", "up", "path"))
        longer = kept(rest.join(state, rest.up == state["at"]).select("ord", F.col("beyond").alias("up"), F.concat_ws("/", "head", "path").alias("path")))
        done = done.unionByName(longer.where("up is null").select("ord", "path"))
        rest, length = longer.where("up is not null"), 2 * length
    return done


def within_depth(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes beyond the depth stay, unvisited and without content."""
    far = F.col("depth") > most
    return nodes.withColumns({"visited": ~far, "content": F.when(far, F.lit(None)).otherwise(F.col("content")) if "content" in nodes.columns else F.lit(None).cast("string")})


def relations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, heading, content, link, pos): a heading's last content, and all its links in order."""
    links = F.transform(F.sort_array(F.collect_list(F.when(F.col("link").isNotNull(), F.struct("pos", "link")))), lambda x: x["link"])
    return rows.groupBy(*keys, "heading").agg(F.max_by("content", F.when(F.col("content").isNotNull(), F.col("pos"))).alias("content"), links.alias("links"))
