"""SimHash near-duplicates by multi-index hashing (operator 9).

A fingerprint has a bit set if more than half of the document's shingle hashes have it (repeats count). Documents
of one fingerprint are one class, so only distinct fingerprints are linked. Each fingerprint is cut into two
segments of 32 bits; if two fingerprints differ in at most two bits, one of the segments differs in at most one.
So every fingerprint looks up the Hamming ball of radius one around each of its segments in that segment's table,
and each match is verified on all 64 bits. Flips go from 0 to 1 only, which finds each pair from one side.

A table key that holds more than HOT fingerprints would be matched pair by pair; lookups that meet such a key are
continued by the full fingerprint instead: the ball that the bits left allow around the other segment is
enumerated too (at most 529 keys for each lookup), so work stays linear in the rows however full a key is.

Links become components by alternating large-star and small-star steps, each written to the shared folder.

Defined results: a null or empty text has fingerprint zero and links like any other; a document with fewer words
than a shingle has one shingle of all its words; repeated rows and exact copies share a fingerprint and so a
component; ties (a bit set in exactly half of the hashes) are 0; a null id stays null and never names a
component unless all ids of it are null; an empty table gives an empty result; other columns are not read; a key named
like a column of the result is refused (ValueError).

similar() links by resemblance instead: texts whose sets of five-word shingles have a Jaccard similarity of LIKE or
more. Such texts differ in 15 % of a fingerprint's bits, beyond the reach of balls, so the same search is made on
fingerprints of BITS bits: bands of a few bits are the keys of as many tables, and within a bucket all fingerprints are
compared on all bits. A pair at just LIKE shares none of the bands with a chance of MISS, more alike ones with a smaller
one (texts of a few shingles, whose bits are tied more often, with some 4 in 100,000). Bands grow with the number of
texts, so that a bucket of unlike texts stays near CELL. Of a bucket only a spanning forest comes out, never its pairs.
Then the sets of each component are brought together once and compared exactly; a component of more than BLOCK
shingles is dealt in blocks, and what is not linked with its main part meets all blocks. No table of pairs is
written. Texts of one set are one class. Null and empty texts are one class; ids are treated as above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import HOT as HOT_ROWS
from tramline.llm.common import check_keys, lookup, map_arrow, settled, slices, utf8
from tramline.operators.graph import components
from tramline.store import Parts, scratch_count, stage

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints that one key of a segment's table may hold before lookups go by the full fingerprint.
HOT = 256

#: Words of a shingle and the Jaccard similarity from which similar() links.
WIDE = 5
LIKE = 0.8
#: Bits of similar()'s fingerprints, and how many standard deviations beyond the mean the bits of a link may differ.
BITS = 512
SURE = 6.7
#: The chance that a link at just LIKE shares no band.
MISS = 1e-6
#: Unlike texts in a bucket, and the least bits of a band.
CELL = 4096
NARROW = 6
#: Bands whose buckets are dealt at a time.
ROUND = 16
#: Shingles that a worker compares at a time.
BLOCK = 1 << 21

_LOW = (1 << 32) - 1
_STEPS = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """The hashes of a text's shingles, with repeats; none of a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    hashes = shingles(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """key and fp long (the 64 bits as a signed number), a row for each row."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [key, "fp"])

    return map_arrow(df.select(key, text), run, schema)


def _half(fp, k: int):
    """Segment k of a fingerprint as a non-negative number."""
    return F.shiftrightunsigned(fp, 32) if k else fp.bitwiseAND(F.lit(_LOW))


def _glue(segment, value, other):
    """The fingerprint of a segment's value and the value of the other segment."""
    return F.when(segment == 0, F.shiftleft(other, 32).bitwiseOR(value)).otherwise(F.shiftleft(value, 32).bitwiseOR(other))


_MASKS1 = [1 << i for i in range(32)]
_MASKS2 = [(1 << i) | (1 << j) for i in range(32) for j in range(i)]


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """a < b: every pair of the distinct fingerprints in column fp that differ in one or two bits, some of them twice."""
    fp = F.col("fp")
    rows = [F.struct(F.lit(k).alias("segment"), _half(fp, k).alias("value"), _half(fp, 1 - k).alias("other")) for k in (0, 1)]
    table = stage(prints.select("fp", F.inline(F.array(*rows))), "simhash-table")
    full = table.groupBy("segment", "value").count().where(F.col("count") > hot).select("segment", "value")
    crowded = stage(table.join(full, ["segment", "value"], "left_semi"), "simhash-crowded")
    keys = crowded.groupBy("segment", "value").agg(F.lit(None).cast("long").alias("b"))
    # In place of the rows of a crowded key, one row marks it.
    index = table.join(keys.select("segment", "value"), ["segment", "value"], "left_anti").select("segment", "value", F.col("fp").alias("b")).unionByName(keys)

    flips = F.filter(F.array(*[F.lit(m).cast("long") for m in _MASKS1]), lambda m: F.col("value").bitwiseAND(m) == 0)
    ball = F.concat(F.array(F.lit(0).cast("long")), flips)
    # The staged table has few files, and each of its rows makes some 17 probes.
    dealt = table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probes = dealt.select("segment", F.col("fp").alias("a"), "other", F.explode(ball).alias("mask"), "value").withColumn("value", F.col("value").bitwiseOR(F.col("mask")))
    met = probes.join(index, ["segment", "value"])
    near = met.where(F.col("b").isNotNull()).where((F.col("mask") != 0) | (F.col("a") < F.col("b")))
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")

    # Lookups that met a crowded key: flips of the other segment, two where this one is equal, else one.
    one = F.array(*[F.lit(m).cast("long") for m in [0, *_MASKS1]])
    two = F.array(*[F.lit(m).cast("long") for m in [0, *_MASKS1, *_MASKS2]])
    over = met.where(F.col("b").isNull()).select("segment", "a", "value", "other", F.explode(F.when(F.col("mask") == 0, two).otherwise(one)).alias("flip"))
    over = over.select("a", _glue(F.col("segment"), F.col("value"), F.col("other").bitwiseXOR(F.col("flip"))).alias("b"))
    exact = over.where(F.col("a") != F.col("b")).join(crowded.select(F.col("fp").alias("b")).distinct(), "b", "left_semi")
    return near.unionByName(exact.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(df: DataFrame, key: str, text: str = "text", width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """key, fp long and component_id (the smallest key reachable over links), a row for each row."""
    check_keys([key], ["fp", "component_id"])
    rows = fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", width)
    prints = stage(rows, "simhash")
    classes = stage(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    labels = _labels(classes, components(links(classes.select("fp"), hot)))
    most = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_ROWS
    return lookup(prints, labels, "fp", classes.where(F.col("n") > most), ["key"]).select(F.col("key").alias(key), "fp", "component_id")


def _labels(classes: DataFrame, found: DataFrame) -> DataFrame:
    """fp, component_id (the least key of a component) of classes (fp, least) whose links have the components found."""
    rooted = classes.select("fp", "least").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "component_id")


def signature(hashes: np.ndarray) -> bytes:
    """The SimHash of BITS bits of a set of shingle hashes; ties are 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] ^ _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _differing(least: float) -> float:
    """The share of bits that differ, at most, between two sets of this Jaccard similarity: their angle over pi."""
    return float(np.arccos(2 * least / (1 + least)) / np.pi)


def _within(bits: int, least: float) -> int:
    """Differing bits, of `bits`, up to which a pair may be a link."""
    p = _differing(least)
    return int(bits * p + SURE * (bits * p * (1 - p)) ** 0.5)


def bands(n: int, least: float) -> list[np.ndarray]:
    """The places of the bits of each band, for n distinct sets."""
    width = max(NARROW, int(np.ceil(np.log2(max(n, 1) / CELL))))
    count = int(np.ceil(np.log(MISS) / np.log1p(-((1 - _differing(least)) ** width))))
    rng, each = np.random.default_rng(SEED), BITS // width
    places = [rng.permutation(BITS)[: each * width].reshape(each, width) for _ in range(-(-count // each))]
    return list(np.concatenate(places)[:count])


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its component) after linking a with b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jump := label[label]):
            label = jump


def joined(prints: np.ndarray, least: float) -> np.ndarray:
    """Of fingerprints (rows of words), the least place in the component over pairs within the radius of `least`."""
    n, radius, first = len(prints), _within(BITS, least), _within(128, least)
    label = np.arange(n)
    # A large group of near copies is found around a few centres; then only what is outside of it meets all.
    for centre in range(0, n, max(1, n // 8)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[centre]).sum(1) <= radius)
        label = _merged(label, np.full(len(near), centre), near)
    main = label == np.bincount(label, minlength=1).argmax()
    order = np.argsort(main, kind="stable")
    rows, rest = prints[order], n - int(main.sum())
    step = max(1, (1 << 20) // max(n, 1))
    for at in range(0, rest, step):
        some, later = rows[at : min(at + step, rest)], rows[at:]
        apart = np.bitwise_count(some[:, 0, None] ^ later[None, :, 0]) + np.bitwise_count(some[:, 1, None] ^ later[None, :, 1])
        i, j = np.nonzero(apart <= first)
        i, j = order[i + at], order[j + at]
        for low in range(0, len(i), 1 << 16):
            x, y = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
            open_ = label[x] != label[y]
            x, y = x[open_], y[open_]
            near = np.bitwise_count(prints[x] ^ prints[y]).sum(1) <= radius
            label = _merged(label, x[near], y[near])
    return label


def _near(classes: DataFrame, places: list[np.ndarray], least: float) -> DataFrame:
    """a < b: of each bucket of these bands a spanning forest of the pairs of classes (fp, bits) within the radius."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), *classes.select("fp", "bits").schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, BITS // 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            for place in places:
                # Two buckets of one name are searched as one.
                value = bits[:, place] @ (1 << np.arange(len(place), dtype=np.int64))
                name = xxhash.xxh64_intdigest(place.astype("<i8").tobytes(), SEED) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(value ^ name, pa.int64()), *batch.columns], schema.names)

    def forest(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp)
        prints = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(fp), -1)[order]
        label = joined(prints, least)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[order][label[at]], "b": fp[order][at]})

    return map_arrow(classes.select("fp", "bits"), deal, schema).groupBy("bucket").applyInArrow(forest, "a long, b long")


def alike(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of non-empty sets of a Jaccard similarity of `least` or more."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(term, kind="stable")]
    starts = np.cumsum(count) - count
    left, found = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root], reached = False, [root]
        while reached and left.any():
            v = reached.pop()
            own = term[ends[v] - sizes[v] : ends[v]]
            own = own[count[own] > 1]
            many = count[own]
            at = np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(holders[at], minlength=n)
            hits = np.flatnonzero(left & (common >= least * (sizes[v] + sizes - common))).tolist()
            left[hits] = False
            found += [(v, u) for u in hits]
            reached += hits
    return found


def _verified(sets: DataFrame, dealt: DataFrame, least: float, block: int) -> DataFrame:
    """a, b: of each group of sets, dealt by rows (fp, size, group), a spanning forest of the pairs of Jaccard similarity `least` or more."""
    own = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(own, -(-dealt.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // max(block, BLOCK)))

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        fp, first = np.unique(rows.column("fp").to_numpy(), return_index=True)
        raw = rows.column("hashes").take(pa.array(first)).to_pylist()
        found = np.array(alike([np.frombuffer(x, "<u8") for x in raw], least), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(group, group[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != group[0]):
                yield links_of(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links_of(pa.Table.from_batches(held))

    rows = sets.join(dealt, "fp").select("group", "fp", "hashes").repartition(width, "group")
    return map_arrow(rows.sortWithinPartitions("group"), run, "a long, b long")


def _sketches(df: DataFrame, key: str, text: str, width: int, whole: bool = False) -> DataFrame:
    """key, fp long (a digest of the set of shingles), its size and its fingerprint, or the whole set as hashes, a row for each row."""
    last = [T.StructField("hashes", T.BinaryType())] if whole else [T.StructField("size", T.LongType()), T.StructField("bits", T.BinaryType())]
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("fp", T.LongType()), *last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sets = [np.unique(shingles(t, width)) for t in utf8(batch.column(1))]
            raw = [s.tobytes() for s in sets]
            fp = np.array([xxhash.xxh64_intdigest(r, SEED) for r in raw], "<u8").view("<i8")
            out = [pa.array(raw, pa.binary())] if whole else [pa.array([len(s) for s in sets], pa.int64()), pa.array(map(signature, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), *out], schema.names)

    return map_arrow(df.select(F.col(key).alias("key"), text), run, schema)


def _blocks(weight, block: int):
    return F.ceil(weight / F.lit(block)).cast("long")


def _block_of(blocks):
    return F.pmod(F.xxhash64("fp", F.lit(SEED)), blocks)


def similar(df: DataFrame, key: str, text: str = "text", width: int = WIDE, least: float = LIKE, block: int = BLOCK) -> DataFrame:
    """key, fp long and component_id (the smallest key reachable over pairs of Jaccard similarity `least`), a row for each row."""
    check_keys([key], ["fp", "component_id"])
    since = scratch_count()
    sketches = stage(_sketches(df, key, text, width), "similar-sketches")
    classes = sketches.groupBy("fp").agg(F.min("key").alias("least"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    classes = stage(classes, "similar-classes")
    some = classes.where("size > 0")
    places = bands(some.count(), least)
    near = Parts(df.sparkSession, "similar-near")
    for at in range(0, len(places), ROUND):
        near.add(_near(some, places[at : at + ROUND], least).distinct())
    # Of each component within the radius all sets, once.
    parts = components(near.all().distinct()).withColumnRenamed("node", "fp")
    parts = parts.join(classes.select("fp", "size", "least"), "fp")
    weights = parts.groupBy("component").agg(_blocks(F.sum("size"), block).alias("blocks"))
    parts = stage(parts.join(weights, "component"), "similar-parts")
    # Sets are larger than texts: they are made again, and only of one row of each class in a component.
    ones = parts.select("least").distinct()
    texts = df.select(key, text).join(ones, F.col(key).eqNullSafe(F.col("least")), "left_semi")
    sets = _sketches(texts, key, text, width, True).join(parts.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))
    dealt = parts.select("fp", "size", F.xxhash64("component", _block_of(F.col("blocks"))).alias("group"))
    found = Parts(df.sparkSession, "similar-links")
    many = parts.where("blocks > 1")
    if many.isEmpty():
        found.add(_verified(sets, dealt, least, block))
    else:
        sets = stage(sets, "similar-sets")
        rooted = stage(components(found.add(_verified(sets, dealt, least, block))).withColumnRenamed("node", "fp").withColumnRenamed("component", "root"), "similar-roots")
        # Two sets of different roots are not both in the main part: one of them is dealt to all blocks.
        rooted = many.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        main = rooted.groupBy("component", "root").agg(F.sum("size").alias("weight")).groupBy("component").agg(F.max_by("root", F.struct("weight", "root")).alias("main"), _blocks(F.sum("weight") - F.max("weight"), block).alias("others"))
        rooted = rooted.join(main.where("others > 0"), "component")
        whole = rooted.select("component", "fp", "size", _block_of(F.col("blocks")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("j"))
        apart = rooted.where("root <> main").select("component", "fp", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), _block_of(F.col("others")).alias("j"))
        dealt = stage(whole.unionByName(apart).select("fp", "size", F.xxhash64("component", "i", "j").alias("group")).distinct(), "similar-dealt")
        found.add(_verified(sets, dealt, least, block))
    labels = _labels(classes, components(found.all()))
    most = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_ROWS
    named = lookup(sketches.select("key", "fp"), labels, "fp", classes.where(F.col("n") > most), ["key"])
    # The sets go before the caller reads the texts once more.
    return settled(named.select(F.col("key").alias(key), "fp", "component_id"), "similar", since)
