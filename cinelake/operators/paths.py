"""What a file's path says about its creator, studio, series and tags, and rules on paths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path patterns with their confidence and the numbers of their groups. One more, of platform prefixes, is never
#: valid there because it begins with an inline flag, and is left out.
PATTERNS = [
    ("OnlyFans Creator Folder", r"/(?:onlyfans|OF)/([^/]+)/?", "high", {"creator": 1}),
    ("Fansly Creator Folder", r"/(?:fansly|FS)/([^/]+)/?", "high", {"creator": 1}),
    ("Creator Series Episode", r"/([^/]+)/([^/]+)/(?:[Ee]p?[-_]?(\d+)|(\d+))", "high", {"creator": 1, "series": 2, "episode": (3, 4)}),
    ("Creator Folder", r"/videos/([^/]+)/?", "high", {"creator": 1}),
    ("Studio Creator Folder", r"/([^/]+)/([^/]+)/?", "high", {"studio": 1, "creator": 2}),
    ("Date Pattern", r"(\d{4})[-_](\d{2})[-_](\d{2})", "low", {}),
    ("Resolution Tag", r"(?:^|[_\-\s])(4K|1080p|720p|480p|360p)(?:[_\-\s]|$)", "medium", {}),
]

#: Sizes that resolution names stand for.
SIZES = {"4K": (3840, 2160), "1080P": (1920, 1080), "720P": (1280, 720), "480P": (854, 480), "360P": (640, 360)}


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def parse(path: Column) -> dict[str, Column]:
    """Columns file_name, extension, parent, grandparent, creator, studio, series, episode, pattern, confidence and tags.

    The first pattern of high confidence that matches wins; else the last of medium; else one of low confidence.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "")
    at = lambda k: F.coalesce(F.try_element_at(folders, F.lit(k)), F.lit(""))
    high = [p for p in PATTERNS if p[2] == "high"]
    medium = [p for p in reversed(PATTERNS) if p[2] == "medium"]
    low = [p for p in PATTERNS if p[2] == "low"]
    ranked = high + medium + low
    first = F.coalesce(*(F.when(path.rlike(p), i) for i, (_, p, *_) in enumerate(ranked)))

    def group(field: str) -> Column:
        found = []
        for i, (_, p, _, groups) in enumerate(ranked):
            numbers = groups.get(field, ())
            for n in (numbers,) if isinstance(numbers, int) else numbers:
                found.append(F.when(first == i, _none_if_empty(F.regexp_extract(path, p, n))))
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    tag = F.upper(F.regexp_extract(name, r"(?i)(?:^|[_\-\s])(4K|1080p|720p|480p|360p)(?:[_\-\s]|$)", 1))
    tags = F.array_compact(F.array(_none_if_empty(tag), F.when(name.rlike(r"(?i)[._\-]hdr[._\-]"), "HDR"), F.when(name.rlike(r"(?i)[._\-]vr[._\-]"), "VR")))
    pick = lambda k: F.coalesce(*(F.when(first == i, r[k]) for i, r in enumerate(ranked)))
    return {
        "file_name": name, "extension": F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)), "parent": at(-1), "grandparent": at(-2), "creator": group("creator"), "studio": group("studio"), "series": group("series"),
        "episode": group("episode"), "pattern": pick(0), "confidence": F.coalesce(pick(2), F.lit("low")), "tags": F.array_join(tags, ","),
    }


@dataclass(frozen=True)
class Condition:
    kind: str
    operator: str
    value: str


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    priority: int
    conditions: tuple[Condition, ...]
    actions: tuple[tuple[str, str], ...]
    enabled: bool = True


def java_regex(spark: SparkSession, pattern: str) -> str | None:
    """``pattern`` in Java's dialect, or None where it is not valid in either; a leading inline flag is not."""
    if pattern.startswith("(?i)"):
        return None
    pattern = re.sub(r"\[([^\]\\]*)-\\s", r"[\1\\-\\s", pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return None
    return pattern


def matches(spark: SparkSession, path: Column, c: Condition, named_sizes: bool = False) -> Column:
    """Whether one condition holds; an operator other than its own negates, what is not valid never holds.

    ``named_sizes`` resolves every resolution name; without it only 4K is known.
    """
    if c.kind in ("path_pattern", "file_pattern"):
        regex = java_regex(spark, c.value)
        if regex is None:
            return F.lit(False)
        return path.rlike(regex) if c.operator == "matches" else ~path.rlike(regex)
    if c.kind == "resolution":
        size = SIZES.get(c.value.upper()) if named_sizes or c.value.upper() == "4K" else None
        if size is None:
            return F.lit(False)
        w, h = (F.regexp_extract(path, r"(?i)(\d{3,4})x(\d{3,4})", k).try_cast("int") for k in (1, 2))
        same = (w == size[0]) & (h == size[1])
        return F.coalesce(same if c.operator == "equals" else ~same, F.lit(False))
    if c.kind == "codec":
        has = F.lower(path).contains(c.value.lower())
        return has if c.operator == "contains" else ~has
    return F.lit(False)


def in_order(rules: list[Rule]) -> list[Rule]:
    """Rules by priority, the highest first, then by name."""
    return sorted(rules, key=lambda r: (-r.priority, r.name))


def evaluate(videos: DataFrame, rules: list[Rule], named_sizes: bool = False) -> DataFrame:
    """(video_id, rule_id, matched, action, target) of every action of every enabled rule with any condition that holds.

    Rules are compiled into one projection: a pass over the videos whatever the number of rules.
    """
    spark = videos.sparkSession
    fired = []
    for r in in_order([r for r in rules if r.enabled and r.conditions and r.actions]):
        hits = F.array_compact(F.array(*(F.when(matches(spark, F.col("file_path"), c, named_sizes), f"{c.kind} {c.operator} {c.value}") for c in r.conditions)))
        actions = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(t).alias("target")) for a, t in r.actions))
        fired.append(F.when(F.size(hits) > 0, F.struct(F.lit(r.id).cast("long").alias("rule_id"), F.array_join(hits, "; ").alias("matched"), actions.alias("actions"))))
    if not fired:
        return videos.sparkSession.createDataFrame([], "video_id long, rule_id long, matched string, action string, target string")
    rows = videos.select(F.col("id").alias("video_id"), F.explode(F.array_compact(F.array(*fired))).alias("r"))
    return rows.select("video_id", "r.rule_id", "r.matched", F.explode("r.actions").alias("a")).select("video_id", "rule_id", "matched", "a.action", "a.target")


#: Actions that automatic tagging takes.
ADDITIONS = ("add_tag", "add_creator", "add_studio")


def _fires(spark: SparkSession, path: Column, c: Condition) -> Column:
    """Whether a condition holds for automatic tagging, which does not look at its operator."""
    if c.kind != "resolution":
        return matches(spark, path, Condition(c.kind, {"codec": "contains"}.get(c.kind, "matches"), c.value))
    named = F.array_contains(F.split(parse(path)["tags"], ","), "4K") & F.lit(c.value.upper() == "4K")  # of the names in a path only this one is known
    size = SIZES.get(c.value.upper())
    if size is None:
        return named
    w, h = (F.regexp_extract(path, r"(?i)(\d{3,4})x(\d{3,4})", k).try_cast("int") for k in (1, 2))
    return F.when(w.isNotNull(), (w == size[0]) & (h == size[1])).otherwise(named)


def auto_tags(videos: DataFrame, rules: list[Rule]) -> DataFrame:
    """(video_id, rule_id, action, target) of automatic tagging: as ``evaluate``, but operators are ignored and only additions count.

    A target $name of a creator or studio is the one found in the path, else the part of that name; without one nothing is added.
    """
    spark, found = videos.sparkSession, parse(F.col("file_path"))
    fired = []
    for r in in_order([r for r in rules if r.enabled and r.conditions]):
        hit = reduce(Column.__or__, (_fires(spark, F.col("file_path"), c) for c in r.conditions))
        for action, target in r.actions:
            if action not in ADDITIONS:
                continue
            value = F.lit(target)
            if target.startswith("$"):
                own = {"add_creator": "creator", "add_studio": "studio"}.get(action)
                named = [found[k] for k in (own, target[1:]) if k in found]
                value = F.coalesce(*named) if named else F.lit(None).cast("string")
            fired.append(F.when(hit & value.isNotNull(), F.struct(F.lit(r.id).cast("long").alias("rule_id"), F.lit(action).alias("action"), value.alias("target"))))
    if not fired:
        return spark.createDataFrame([], "video_id long, rule_id long, action string, target string")
    return videos.select(F.col("id").alias("video_id"), F.explode(F.array_compact(F.array(*fired))).alias("r")).select("video_id", "r.rule_id", "r.action", "r.target")


def applied(fired: DataFrame, video_tags: DataFrame) -> DataFrame:
    """(rule_id, matched, applied): videos matched by each rule, and the tag links that applying it adds."""
    tags = fired.filter("action = 'add_tag'").select("video_id", "rule_id", F.col("target").try_cast("long").alias("tag_id"))
    fresh = tags.filter("tag_id is not null").distinct().join(video_tags, ["video_id", "tag_id"], "left_anti").groupBy("rule_id").agg(F.count(F.lit(1)).alias("applied"))
    matched = fired.groupBy("rule_id").agg(F.count_distinct("video_id").alias("matched"))
    return matched.join(fresh, "rule_id", "left").select("rule_id", "matched", F.coalesce("applied", F.lit(0)).alias("applied"))
