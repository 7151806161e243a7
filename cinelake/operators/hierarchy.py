"""Parent-child links to full hierarchies, by heavy-path decomposition.

Every tree is cut into chains: each node hands its chain on to the child with the largest subtree. A path to the
root then crosses at most log2(n) chains, so paths are a few concatenated chain segments, and the nodes above a
node are a few intervals of chain positions. Subtree sizes, chain heads and chain offsets all come from pointer
doubling, so a tree of depth d takes about log2(d) rounds, each one join or two and a checkpoint.
Nodes whose steps never end are told apart first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinelake.plans.scratch import checkpoint
from cinelake.plans.skew import HOT, salted_join


@dataclass(frozen=True)
class Hierarchy:
    """``nodes``: id, parent, name, size, head, pos, segment; ``chains``: head, top, offset, prefix and the link to
    the chain above (up_head, up_pos); ``loops``: id, root of the nodes that never reach a root."""

    nodes: DataFrame
    chains: DataFrame
    loops: DataFrame

    def flat(self, separator: str = " > ") -> DataFrame:
        """(id, root_id, depth, path, descendants); in loops root_id is the smallest id of the loop, depth and descendants -1, path null."""
        chains = self.chains.select("head", F.col("top").alias("root_id"), "offset", "prefix")
        path = F.array_join(F.concat("prefix", "segment"), separator, "")
        ends = self.nodes.join(chains, "head").select("id", "root_id", (F.col("offset") + F.col("pos")).alias("depth"), path.alias("path"), (F.col("size") - 1).alias("descendants"))
        return ends.unionByName(self.loops.select("id", F.col("root").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(-1).cast("long").alias("descendants")))

    def below(self) -> DataFrame:
        """(id, descendant_id): every pair of a node and a node below it, outside loops.

        A node's ancestors are intervals of positions on the chains it crosses; each interval is met by the nodes at
        its positions in an equi-join, so the work is in proportion to the pairs that come out.
        """
        own = self.nodes.filter("pos > 0").select(F.col("id").alias("descendant_id"), F.col("head").alias("on"), (F.col("pos") - 1).alias("upto"))
        hop = self.chains.filter("up_head is not null").select("head", "up_head", "up_pos")
        above = front = checkpoint(hop)
        parts = [above]
        while not front.isEmpty():
            nxt = hop.select(F.col("head").alias("up_head"), F.col("up_head").alias("h"), F.col("up_pos").alias("p"))
            front = checkpoint(front.join(nxt, "up_head").select("head", F.col("h").alias("up_head"), F.col("p").alias("up_pos")))
            parts.append(front)
        for more in parts[1:]:
            above = above.unionByName(more)
        far = self.nodes.select(F.col("id").alias("descendant_id"), "head").join(above, "head").select("descendant_id", F.col("up_head").alias("on"), F.col("up_pos").alias("upto"))
        cells = own.unionByName(far).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto"))))
        at = self.nodes.select("id", F.col("head").alias("on"), "pos")
        return cells.join(at, ["on", "pos"]).select("id", "descendant_id")


def valid(df: DataFrame, id: str, parent: str, name: str, updated: str | None = None) -> DataFrame:
    """(id, parent, name): of several rows with one id the one with the latest ``updated`` (ties: the larger parent, then name).

    Rows with a null id are left out; names lose outer blanks, a missing name is the empty string.
    """
    at = F.lit(0) if updated is None else F.col(updated)
    row = F.struct(at.alias("t"), F.col(parent).cast("long").alias("parent"), F.coalesce(F.trim(F.col(name)), F.lit("")).alias("name"))
    return df.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.max(row).alias("r")).select("id", "r.parent", "r.name")


def _sizes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes outside loops with their subtree sizes, and (id, root) of the others.

    After k rounds ``up`` is the ancestor 2**k above, ``size`` the number of nodes less than 2**k below, and ``low``
    the smallest id less than 2**k above. While some node outside loops still has an ancestor so far up, the
    number of nodes with one falls; when it stops falling, all that are left lead into loops. Nodes without such an
    ancestor take no part any more; what is still found below them is kept and added in the end.
    """
    one = F.lit(1).cast("long")
    done = [nodes.filter("parent is null").select("id", one.alias("size"))]
    now, hops = nodes.filter("parent is not null").select("id", F.col("parent").alias("up"), one.alias("size"), F.col("id").alias("low")), 1
    active = now.count()
    while active:
        under = now.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        over = now.select(F.col("id").alias("up"), F.lit(True).alias("active"), F.col("up").alias("next"), F.col("low").alias("other"))
        zero = F.lit(0)
        grown = now.join(under, "id", "full").select(  # a node that had stopped comes in with what was found below it
            "id", F.coalesce("up", "id").alias("up"), F.col("up").isNotNull().alias("active"), (F.coalesce("size", zero) + F.coalesce("more", zero)).alias("size"), "low"
        )
        moved = checkpoint(_follow(grown, active, over, ["up", "active"], "left").select("id", F.col("next").alias("up"), "size", F.least("low", "other").alias("low")))
        done.append(moved.filter("up is null").select("id", "size"))
        now = moved.filter("up is not null")
        hops *= 2
        left = now.count()
        if left == active:
            break
        active = left
    loops = now.select("id", "up", "low")
    while hops < active:  # as far as a tail and its loop can be long
        over = loops.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("other"))
        loops = checkpoint(_follow(loops, active, over, ["up"]).select("id", F.col("next").alias("up"), F.least("low", "other").alias("low")))
        hops *= 2
    ring = loops.select(F.col("id").alias("up"), F.col("low").alias("root"))
    sizes = reduce(DataFrame.unionByName, done).groupBy("id").agg(F.sum("size").alias("size"))
    return sizes.join(loops.select("id"), "id", "left_anti"), _follow(loops, active, ring, ["up"]).select("id", "root")


def _follow(rows: DataFrame, many: int, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows``, ``many`` of them, joined with what ``table`` has for ``on``, where very many may have one value."""
    if many < HOT:
        return rows.join(table, on, how)
    return salted_join(rows, table, on, rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), F.col("id"), how)


def _jump(links: DataFrame, to: str, adds: list[tuple[str, Column]]) -> DataFrame:
    """Follows ``to`` until it no longer moves (an id that points to itself), summing or concatenating ``adds`` on the way.

    Rows that point to such an id are done and take no further part, so the ids that most rows end at are joined on once.
    While any row can still get there the number of the others falls; rows that never do (on loops) are left out.
    """
    names, where = [a for a, _ in adds], F.col("id") == F.col(to)
    whole = checkpoint(links)
    ends, rest = whole.filter(where), whole.filter(~where)
    done, before = [ends], rest.count()
    at_end = ends.select(F.col("id").alias(to), F.lit(True).alias("_end"), *(F.col(a).alias(f"_{a}") for a in names))
    now = _follow(rest, before, at_end, [to], "left").withColumns({a: F.when(F.col("_end"), c).otherwise(F.col(a)) for a, c in adds}).drop(*(f"_{a}" for a in names))
    while before:
        now = checkpoint(now)
        done.append(now.filter("_end").drop("_end"))
        now = now.filter("_end is null").drop("_end")
        many = now.count()
        if not many or many == before:
            break
        known = now.select("id", to, *names, F.lit(None).cast("boolean").alias("_end"))
        known = reduce(DataFrame.unionByName, (d.select("id", to, *names, F.lit(True).alias("_end")) for d in done[1:]), known)
        far = known.select(F.col("id").alias(to), F.col(to).alias("_to"), "_end", *(F.col(a).alias(f"_{a}") for a in names))
        now = _follow(now, many, far, [to]).select("id", F.col("_to").alias(to), "_end", *(c.alias(a) for a, c in adds), *(c for c in now.columns if c not in ("id", to, *names)))
        before = many
    return reduce(DataFrame.unionByName, done)


def depths(rows: DataFrame, paths: bool = True) -> DataFrame:
    """(id, root_id, depth, path) of ``rows`` (id, parent_id, name), path an array of names from the root down, by pointer doubling alone.

    Every parent_id must be an id or null; nodes that never reach a root do not come out. For trees cut at a node, where
    chains and subtree sizes are not asked for. ``paths`` False leaves the arrays empty.
    """
    name = F.array("name") if paths else F.array().cast("array<string>")
    links = rows.select("id", F.coalesce("parent_id", "id").alias("root_id"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), name.alias("path"))
    return _jump(links, "root_id", [("depth", F.col("depth") + F.col("_depth")), ("path", F.concat("_path", "path"))])


def build(df: DataFrame, id: str = "id", parent: str = "parent_id", name: str = "name", updated: str | None = None, paths: bool = True) -> Hierarchy:
    """The hierarchy of all ids in ``df``; a parent that does not exist, or is null, makes a root.

    Several rows for one id: see ``valid``. A node that is its own parent is a loop. Depth is not limited. ``paths``
    False leaves the name segments out. An empty table gives an empty hierarchy.
    """
    rows = valid(df, id, parent, name, updated)
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    rows = checkpoint(rows.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"), "name"))
    sizes, loops = _sizes(rows)
    tree = rows.join(sizes, "id")
    heavy = tree.filter("parent is not null").groupBy("parent").agg(F.max_by("id", F.struct("size", -F.col("id"))).alias("heavy"))
    tree = tree.join(heavy, "parent", "left").withColumn("goes_on", F.coalesce(F.col("heavy") == F.col("id"), F.lit(False)))
    segment = F.array("name") if paths else F.array().cast("array<string>")
    links = tree.select("id", F.when(F.col("goes_on"), F.col("parent")).otherwise(F.col("id")).alias("head"), F.when(F.col("goes_on"), 1).otherwise(0).cast("long").alias("pos"), F.when(F.col("goes_on"), segment).otherwise(F.array().cast("array<string>")).alias("segment"), "parent", "name", "size")
    nodes = _jump(links, "head", [("pos", F.col("pos") + F.col("_pos")), ("segment", F.concat("_segment", "segment"))])
    if paths:  # the head's own name comes first
        first = nodes.filter("id = head").select("head", F.col("name").alias("first"))
        nodes = checkpoint(nodes.join(first, "head").withColumn("segment", F.concat(F.array("first"), "segment")).drop("first"))
    at = nodes.select(F.col("id").alias("parent"), F.col("head").alias("up_head"), F.col("pos").alias("up_pos"), F.col("segment").alias("up_segment"))
    heads = nodes.filter("id = head").select("head", "parent").join(at, "parent", "left")
    nothing = F.array().cast("array<string>")
    start = heads.select(F.col("head").alias("id"), F.coalesce("up_head", "head").alias("top"), F.coalesce(F.col("up_pos") + 1, F.lit(0).cast("long")).alias("offset"), F.coalesce("up_segment", nothing).alias("prefix"), "up_head", "up_pos")
    chains = _jump(start, "top", [("offset", F.col("offset") + F.col("_offset")), ("prefix", F.concat("_prefix", "prefix"))]).withColumnRenamed("id", "head")
    return Hierarchy(nodes, chains, loops)
