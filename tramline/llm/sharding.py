"""K-d tree sharding by bytes (operator 3), in DataFrame operations only.

Each group of equal texts is a point of normalised metadata: logarithm of its size, and hashes of language and source,
which give each value a fixed place (of several in a group the least). A node of the tree that is to become k shards
is split along its widest dimension where the weights, UTF-8 bytes plus OVERHEAD for each row, reach floor(k / 2) / k of
its total; ties go by a hash of the text. A group is never cut, unless it outweighs a shard: then it is dealt into
parts of about 1 / PARTS of a shard, which lie side by side, fewer than NEAR of them. Of the groups near a cut at most two change sides, if that
brings the cut nearer to its goal, so whole groups cost little of the shards' evenness.

Cuts are found for all nodes of a level at once, from histograms: sums of bytes over BINS bins of the widest
dimension, then over the bin that holds the goal, by coordinate and within one coordinate by hash, until that bin holds
at most NEAR groups, which come to the driver. So a level costs a few sums without a shuffle of rows, and the driver
sees at most BINS sums and NEAR groups for each of fewer than `shards` nodes. The tree, fewer cuts than shards, is
broadcast level by level. Rows are narrow (no text) and are shuffled once, to be numbered within their shards; before that, those of
texts whose copies differ in language or source are joined to their group, and those of groups larger than a shard
are numbered. Groups that hold over 1 / HOT of the rows (fewer than HOT) are broadcast, so no key of that join is hot.

Defined results: a null text is empty and weighs OVERHEAD; null language, source or key are values of their own;
repeated rows are separate documents of one group; with fewer groups than shards some shards stay empty; an empty table
gives an empty one; only the named columns are read; a key named like a column of the result is refused (ValueError).
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import HOT, check_keys, shuffle_width
from tramline.store import stage

SHARDS = 40
#: Bytes that a document weighs beside its text.
OVERHEAD = 16
#: Parts that a shard's worth of too large a group is dealt into.
PARTS = 64
#: Bins of a histogram, groups that a bin may hold when the driver takes it, more than parts of a group, and groups around a cut
#: among which it looks for the best.
BINS = 256
NEAR = 4096
AROUND = 128
#: Bytes of metadata input for each range.
RANGE = 64 << 20

DIMENSIONS = ["d_size", "d_lang", "d_source"]
_GROUP = ["text_hash", "text_crc32", "size"]


def _place(value: Column) -> Column:
    """A fixed place in [0, 1] for each value of a category; null has 0."""
    return F.coalesce(F.crc32(value) / F.lit(float((1 << 32) - 1)), F.lit(0.0))


def points(df: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """key, size, text_crc32, text_hash and the coordinates of each row, and a number that tells equal rows apart."""
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("long")
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key).alias("key"), size.alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("text_hash"),
        (F.log2(size.cast("double")) / 40.0).alias("d_size"), _place(F.col(lang)).alias("d_lang"), _place(F.col(source)).alias("d_source"),
        F.monotonically_increasing_id().alias("tie"),
    )


def numbered(df: DataFrame, group: list[str], order: list[str], ranges: int, name: str) -> DataFrame:
    """df with column number: from 0 without gaps within each group, in the given order, over all tasks.

    Rows are dealt and sorted by range, which gives them their place in a task; where each group begins there, at most
    a row for each range and group, gives the rest.
    """
    keys = [*group, *order]
    placed = stage(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    task = F.shiftrightunsigned("_at", 33)
    starts = placed.groupBy(*group, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, "_task", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    found = placed.withColumn("_task", task).join(F.broadcast(starts), [*group, "_task"])
    return found.withColumn("number", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, as one literal: compiled code stays the same whatever it holds."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _along(dimension: Column) -> Column:
    """A group's coordinate along the dimension of that number."""
    return reduce(lambda rest, i: F.when(dimension == i, F.col(DIMENSIONS[i])).otherwise(rest), range(1, len(DIMENSIONS)), F.col(DIMENSIONS[0]))


@dataclass
class _Cut:
    """Of a node that becomes the shards low to high: what lies up to `last` along a dimension goes left, except `moved`."""

    low: int
    high: int
    dimension: int
    last: tuple[float, int, int]
    moved: list[tuple[int, int]]

    @property
    def middle(self) -> int:
        return self.low + (self.high - self.low) // 2

    def row(self) -> dict:
        place, text, part = self.last
        return {"low": self.low, "middle": self.middle, "dimension": self.dimension, "place": place, "text": text, "part": part, "moved": [{"text": h, "part": p} for h, p in self.moved]}


_CUT = "low:int,middle:int,dimension:int,place:double,text:bigint,part:bigint,moved:array<struct<text:bigint,part:bigint>>"


def _below(df: DataFrame, cuts: list[_Cut]) -> DataFrame:
    """df with node, the first shard of the node that a row is in, a level farther down; after all levels it is the shard."""
    table = _rows(df.sparkSession, [c.row() for c in cuts], _CUT).select("low", F.struct("middle", "dimension", "place", "text", "part", "moved").alias("cut"))
    c, at, text, part = F.col("cut"), _along(F.col("cut.dimension")), F.col("text_hash"), F.col("part")
    before = (at < c["place"]) | ((at == c["place"]) & ((text < c["text"]) | ((text == c["text"]) & (part <= c["part"]))))
    left = before != F.exists(c["moved"], lambda m: (m["text"] == text) & (m["part"] == part))
    joined = df.join(F.broadcast(table), F.col("node") == F.col("low"), "left")  # fewer rows than shards
    return joined.withColumn("node", F.when(c.isNull() | left, F.col("node")).otherwise(c["middle"])).drop("low", "cut")


def best_cut(sizes: Sequence[int], goal: float) -> tuple[int, list[int]]:
    """How many of the sizes, from the first, to put left so that they sum to about the goal, and at most two that change sides."""
    held, best, total = 0, (abs(goal), 0, 0), 0
    for i, s in enumerate(sizes, 1):
        total += s
        if abs(goal - total) < best[0]:
            best, held = (abs(goal - total), i, total), i
    short = goal - best[2]
    gains = sorted((-s if i < held else s, i) for i, s in enumerate(sizes))
    values = [g for g, _ in gains]
    found: tuple[float, list[int]] = (abs(short), [])
    for k, (gain, i) in enumerate(gains):
        if abs(short - gain) < found[0]:
            found = (abs(short - gain), [i])
        near = bisect_left(values, short - gain)
        for j in (near - 1, near, near + 1):
            if 0 <= j < len(gains) and j != k and abs(short - gain - values[j]) < found[0]:
                found = (abs(short - gain - values[j]), [i, gains[j][1]])
    return held, found[1]


@dataclass
class _Search:
    """Where the cut of a node is looked for: a range of a coordinate, or of hashes at one place of it."""

    low: int
    high: int
    dimension: int
    goal: float
    bounds: tuple
    place: float | None = None
    before: int = 0
    found: tuple | None = None

    def row(self) -> dict:
        low, high = self.found or self.bounds
        hashes = self.place is not None
        numbers = {"first": low, "last": high, "place": None} if not hashes else {"first_text": low, "last_text": high, "place": self.place}
        return {"of": self.low, "dimension": self.dimension, "begin": float(low), "span": max(float(high) - float(low), 1e-300)} | numbers

    def narrow(self, bins: list[Row]) -> None:
        """Take the bin that holds the goal, with neighbours if it is small; `found` is set once groups are few."""
        bins.sort(key=lambda b: b["bin"])
        upto, at = self.before, len(bins) - 1
        for i, b in enumerate(bins):
            upto += b["bytes"]
            if upto >= self.goal:
                at = i
                break
        else:
            i = at
        first = last = at
        count = bins[at]["items"]
        if count <= NEAR:
            while True:
                more = [j for j in (first - 1, last + 1) if 0 <= j < len(bins) and count + bins[j]["items"] <= AROUND]
                if not more:
                    break
                j = more[-1] if (last - at) <= (at - first) else more[0]
                first, last, count = min(first, j), max(last, j), count + bins[j]["items"]
        self.before += sum(b["bytes"] for b in bins[:first])
        names = ("c", "d") if self.place is None else ("h", "i")
        bounds = (bins[first][names[0]], bins[last][names[1]])
        if count <= NEAR:
            self.found = bounds
        elif self.place is None and bounds[0] == bounds[1]:
            self.place, self.bounds = bounds[0], (bins[at]["h"], bins[at]["i"])
        else:
            self.bounds = bounds


_SEARCH = "of:int,dimension:int,begin:double,span:double,first:double,last:double,first_text:bigint,last_text:bigint,place:double"


def _within(here: DataFrame, nodes: list[_Search]) -> DataFrame:
    """The groups within the nodes' ranges, with the coordinate at, and bin."""
    table = F.broadcast(_rows(here.sparkSession, [n.row() for n in nodes], _SEARCH))  # fewer rows than shards
    at, text, place = F.col("at"), F.col("text_hash"), F.col("place")
    met = here.join(table, F.col("node") == F.col("of")).withColumn("at", _along(F.col("dimension")))
    inside = F.when(place.isNull(), at.between(F.col("first"), F.col("last"))).otherwise((at == place) & text.between(F.col("first_text"), F.col("last_text")))
    value = F.when(place.isNull(), at).otherwise(text.cast("double"))
    return met.where(inside).withColumn("bin", F.least(F.floor((value - F.col("begin")) / F.col("span") * BINS), F.lit(BINS - 1)).cast("int"))


def _grow(items: DataFrame, shards: int) -> list[list[_Cut]]:
    """The cuts of the tree, level by level."""
    levels: list[list[_Cut]] = []
    level = [(0, shards)] if shards > 1 else []
    here = items.withColumn("node", F.lit(0))
    while level:
        if levels:
            here = stage(_below(here, levels[-1]), f"kd-level-{len(levels)}")
        spans = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("least", F.min), ("most", F.max))]
        facts = {r["node"]: r for r in here.groupBy("node").agg(F.sum("bytes").alias("bytes"), *spans).collect()}  # a row for each node
        nodes = []
        for low, high in level:
            if f := facts.get(low):
                wide = max(DIMENSIONS, key=lambda d: f[f"most_{d}"] - f[f"least_{d}"])  # the first of equally wide ones
                nodes.append(_Search(low, high, DIMENSIONS.index(wide), f["bytes"] * ((high - low) // 2) / (high - low), (f[f"least_{wide}"], f[f"most_{wide}"])))
        while todo := [n for n in nodes if n.found is None]:
            sums = _within(here, todo).groupBy("node", "bin").agg(
                F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("items"), F.min("at").alias("c"), F.max("at").alias("d"), F.min("text_hash").alias("h"), F.max("text_hash").alias("i")
            )
            by: dict[int, list[Row]] = {}
            for r in sums.collect():  # at most BINS rows for each node
                by.setdefault(r["node"], []).append(r)
            for n in todo:
                n.narrow(by[n.low])
        if not nodes:
            break
        near: dict[int, list[tuple]] = {}
        for r in _within(here, nodes).select("node", "at", "text_hash", "part", "bytes").collect():  # at most NEAR rows for each node
            near.setdefault(r["node"], []).append((r["at"], r["text_hash"], r["part"], r["bytes"]))
        cuts = []
        for n in nodes:
            rows = sorted(near[n.low])
            held, moved = best_cut([r[3] for r in rows], n.goal - n.before)
            # With none of them on the left, the cut still lies behind what comes before them.
            last = rows[held - 1][:3] if held else (rows[0][0], rows[0][1], rows[0][2] - 1)
            cuts.append(_Cut(n.low, n.high, n.dimension, last, [rows[i][1:3] for i in moved]))
        levels.append(cuts)
        level = [part for cut in cuts for part in ((cut.low, cut.middle), (cut.middle, cut.high)) if part[1] - part[0] > 1]
    return levels


def kd_shards(df: DataFrame, key: str, text: str = "text", lang: str = "lang", source: str = "source", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, shard and slot (gapless from 0 within the shard) of each row."""
    check_keys([key], ["size", "text_crc32", "shard", "slot"])
    if shards * PARTS >= NEAR:
        raise ValueError(f"at most {NEAR // PARTS - 1} shards")
    ranges = min(shuffle_width(df, RANGE), 100_000)
    rows = stage(points(df, key, text, lang, source), "kd-points")
    ends = [f(d).alias(f"{name}{d}") for d in DIMENSIONS for name, f in (("", F.min), ("most_", F.max))]
    groups = rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("rows"), *ends)
    mixed = reduce(or_, [F.col(d) < F.col(f"most_{d}") for d in DIMENSIONS])
    groups = stage(groups.select(*_GROUP, "rows", *DIMENSIONS, mixed.alias("mixed"), (F.col("rows") * F.col("size")).alias("bytes")), "kd-groups")
    n, total, differ = groups.agg(F.sum("rows"), F.sum("bytes"), F.coalesce(F.bool_or("mixed"), F.lit(False))).first()
    target = (total or 0) / shards
    large = F.col("bytes") > target  # fewer groups than shards
    each = F.when(large, F.greatest(F.lit(1), F.floor(F.lit(target / PARTS) / F.col("size")))).otherwise(F.col("rows"))
    groups = groups.withColumns({"large": large, "each": each.cast("long")})
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / F.col("each"))))
    items = groups.select("*", part.alias("part")).withColumn("bytes", F.least("each", F.col("rows") - F.col("part") * F.col("each")) * F.col("size"))
    items = stage(items.select("text_hash", "part", "bytes", *DIMENSIONS), "kd-groups-cut")
    levels = _grow(items, shards)

    few = groups.where(F.col("large") | (F.col("mixed") & (F.col("rows") > (n or 0) / HOT)))
    own = [F.col(d).alias(f"few_{d}") for d in DIMENSIONS]
    known = rows.join(F.broadcast(few.select(*_GROUP, *own, "large", "each")), _GROUP, "left")  # fewer than HOT + shards rows
    if differ:
        other = groups.where(F.col("mixed") & ~F.col("large") & (F.col("rows") <= n / HOT)).select(*[F.col(c).alias(f"g_{c}") for c in (*_GROUP, *DIMENSIONS)])
        # What the broadcast has found is spread by its key; it cannot meet a group of this table, which has none of its sizes.
        found = F.col("few_d_size").isNotNull()
        known = known.withColumn("j_hash", F.when(found, F.xxhash64("key")).otherwise(F.col("text_hash"))).withColumn("j_size", F.when(found, F.lit(-1)).otherwise(F.col("size")))
        on = (F.col("j_hash") == F.col("g_text_hash")) & (F.col("text_crc32") == F.col("g_text_crc32")) & (F.col("j_size") == F.col("g_size"))
        known = known.join(other, on, "left")
    else:
        known = known.withColumns({f"g_{d}": F.lit(None).cast("double") for d in DIMENSIONS})
    at = {d: F.coalesce(f"few_{d}", f"g_{d}", d) for d in DIMENSIONS}
    known = known.select("key", "tie", *_GROUP, *[c.alias(d) for d, c in at.items()], F.coalesce("large", F.lit(False)).alias("large"), "each")
    if target and not few.where("large").isEmpty():
        known = stage(known, "kd-known")
        parts = numbered(known.where("large"), _GROUP, ["key", "tie"], ranges, "kd-large").withColumn("part", F.floor(F.col("number") / F.col("each"))).drop("number")
        known = known.where(~F.col("large")).withColumn("part", F.lit(0).cast("long")).unionByName(parts)
    else:
        known = known.withColumn("part", F.lit(0).cast("long"))
    known = known.withColumn("node", F.lit(0))
    for cuts in levels:
        known = _below(known, cuts)
    sharded = known.select("key", "tie", "size", "text_crc32", "text_hash", F.col("node").alias("shard"))
    placed = numbered(sharded, ["shard"], ["text_hash", "key", "tie"], ranges, "kd-slots")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", F.col("number").alias("slot"))
