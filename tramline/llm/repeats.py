"""Substring dedup by fixed-block anchors (operator 8).

A repeat is a window of `window` words that starts in two places or more, in one document or in several. Blocks
of half the window, laid end to end from each document's first word, form the reference index: every window
contains exactly one or two of them whole. Every rolling block of every document probes that index. A block whose
words occur at a second place anchors its windows; these hits are extended by comparing whole windows, and runs of
repeated windows merge into maximal exact repeats.

Both comparisons are counts by hash, never pairs, so a passage with a million copies costs as much as a million
passages. Rows of the shuffles are not single probes but one packed array for each pair of a map-side chunk and a
bucket; a hash that a chunk holds twice or more is settled within the chunk, and at most two copies of it travel,
so a very common passage does not fill a bucket. Blocks compare by about 40 bits, which only proposes windows;
windows compare by 64 bits within a bucket chosen by other bits of their content, words themselves are not compared.
Two different windows of n are taken for one with a chance of about n^2 / 2^65 / buckets in all: at 100 TB, with 1.6e13
windows and 800,000 buckets, 9 pairs are to be expected; at 1 TB 0.1, at a GB none (1e-7). The buckets grow with the
input, so a bucket does not: it has some 128 MB of text. A chunk has CHUNK words whatever the input; at 100 TB a bucket
gets about two of a chunk's probes, in a row that weighs some four times as much as they do.

Rows are told apart by 96 bits of hashes of their key, which may be of any type, and text; rows that share both are
repeats of each other. Defined results: a null or empty text has no words and loses none; texts shorter than the window,
likewise; an empty table gives an empty one; a null key is kept (its row counts as an occurrence like any other); other
columns are not read; a key named like a column of the result is refused (ValueError). Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import check_keys, map_arrow, shuffle_width, slices, utf8
from tramline.store import stage

WINDOW = 35
#: Words that a map-side chunk gathers before it is packed, and known words that a worker remembers.
CHUNK = 1_500_000
MEMORY = 1 << 20
#: Bytes of input for four buckets, where the session's own number of partitions gives less.
PARTITION = 512 << 20

_SEED = 0x7265
_M1, _M2, _32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)

_ASK = np.dtype([("value", "<u4"), ("id", "<i8"), ("check", "<i4"), ("block", "<u4")])
_BLOCK = np.dtype([("id", "<i8"), ("check", "<i4"), ("block", "<u4")])
_RUN = np.dtype([("id", "<i8"), ("check", "<i4"), ("start", "<u4"), ("length", "<u4")])


class Codes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word, _SEED)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMORY:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _M1 + b
    z ^= z >> _32
    z *= _M2
    return z


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every `width` consecutive codes, built from windows of doubling width."""
    power, size, done, at = codes, 1, None, 0
    while True:
        if width & size:
            if done is None:
                done, at = power, size
            else:
                n = len(codes) - at - size + 1
                done, at = _join(done[:n], power[at : at + n]), at + size
        if at == width:
            return done
        power = _join(power[:-size], power[size:])
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class _Chunk:
    """Documents of a map task, gathered until they have CHUNK words."""

    def __init__(self, most: int):
        self.most, self.words = most, Codes()
        self.clear()

    def clear(self) -> None:
        self.codes, self.ids, self.checks, self.blocks, self.size = [], [], [], [], 0

    def add(self, key: int | None, check: int, words: list[bytes], blocks: list[int] | None = None) -> bool:
        """Whether the chunk is full now."""
        self.codes.append(self.words.of(words))
        self.ids.append(key or 0)
        self.checks.append(check)
        self.blocks.append(blocks)
        self.size += len(words)
        return self.size >= self.most

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Codes, and by word the number of its document, its place there, and the words from it to the end."""
        sizes = np.array([len(c) for c in self.codes])
        document = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(document)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.concatenate(self.codes), document, place, sizes[document] - place

    def named(self, kind: np.dtype, document: np.ndarray, **fields: np.ndarray) -> np.ndarray:
        out = np.empty(len(document), kind)
        out["id"], out["check"] = np.array(self.ids, np.int64)[document], np.array(self.checks, np.int32)[document]
        for name, values in fields.items():
            out[name] = values
        return out


def _shares(total: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * total // parts


def _probe(chunk: _Chunk, width: int, buckets: int) -> list[tuple[bytes, bytes, bytes]]:
    """By bucket: probes of all rolling blocks, blocks that ask whether they are repeated, blocks known to be."""
    codes, document, place, left = chunk.arrays()
    hashes = rolling(codes, width)
    n = len(hashes)
    whole = np.flatnonzero(left[:n] >= width)
    keys = (((hashes >> _32) % np.uint64(buckets)) << _32) | (hashes & _LOW)
    probes = np.sort(keys[whole])
    second = np.zeros(len(probes), bool)
    second[1:] = probes[1:] == probes[:-1]
    third = np.zeros(len(probes), bool)
    third[2:] = probes[2:] == probes[:-2]
    twice = probes[second & ~third]
    probes = probes[~third]
    at = whole[place[whole] % width == 0]
    mine = keys[at]
    known = np.isin(mine, twice)
    ask, own = at[~known], mine[~known]
    order = np.argsort(own, kind="stable")
    ask, own = ask[order], own[order]
    asks = chunk.named(_ASK, document[ask], value=(own & _LOW).astype(np.uint32), block=place[ask] // width)
    told = chunk.named(_BLOCK, document[at[known]], block=place[at[known]] // width)
    bounds = np.arange(buckets + 1, dtype=np.uint64) << _32
    p, a, t = np.searchsorted(probes, bounds), np.searchsorted(own, bounds), _shares(len(told), buckets)
    values = (probes & _LOW).astype("<u4")
    return [(values[p[i] : p[i + 1]].tobytes(), asks[a[i] : a[i + 1]].tobytes(), told[t[i] : t[i + 1]].tobytes()) for i in range(buckets)]


def _extend(chunk: _Chunk, window: int, width: int, buckets: int) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """By bucket: repeated values, values of runs of windows that ask, those runs, runs known to be repeated."""
    codes, document, place, left = chunk.arrays()
    if len(codes) < window:
        return []
    starts = np.concatenate(([0], np.cumsum([len(c) for c in chunk.codes])[:-1]))
    anchored = np.zeros(len(codes) + 1, np.int64)  # +1 and -1 where the windows of a block begin and end
    for start, size, blocks in zip(starts, map(len, chunk.codes), chunk.blocks, strict=True):
        at = np.asarray(blocks, np.int64) * width
        np.add.at(anchored, start + np.maximum(at + width - window, 0), 1)
        np.add.at(anchored, start + np.minimum(at + 1, size), -1)
    n = len(codes) - window + 1
    at = np.flatnonzero((np.cumsum(anchored)[:n] > 0) & (left[:n] >= window))
    value = rolling(codes, window)[at]
    # The bucket comes from the least block hash within the window, so neighbouring windows mostly share it.
    bucket = (sliding_min(rolling(codes, width), window - width + 1)[at] >> np.uint64(7)) % np.uint64(buckets)
    _, back, counts = np.unique(value, return_inverse=True, return_counts=True)
    known = counts[back] > 1
    document, place = document[at], place[at]

    def runs(pick: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of consecutive windows, and where each begins within pick."""
        new = np.ones(len(pick), bool)
        new[1:] = (np.diff(document[pick]) != 0) | (np.diff(place[pick]) != 1) | (np.diff(by[pick].astype(np.int64)) != 0)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(pick)))
        return chunk.named(_RUN, document[pick[first]], start=place[pick[first]], length=length), first

    told, _ = runs(np.flatnonzero(known), np.zeros(len(at)))
    pick = np.flatnonzero(~known)
    asks, first = runs(pick, bucket)
    order = np.argsort(bucket[pick[first]], kind="stable")
    lengths = asks["length"][order].astype(np.int64)
    ends = np.cumsum(lengths)
    spread = np.repeat(first[order] - (ends - lengths), lengths) + np.arange(len(pick))
    values, asks = value[pick][spread], asks[order]
    repeated = np.unique(np.stack([bucket[known], value[known]]), axis=1) if known.any() else np.empty((2, 0), np.uint64)
    span = np.arange(buckets + 1, dtype=np.uint64)
    r, a, t = np.searchsorted(repeated[0], span), np.searchsorted(bucket[pick[first]][order], span), _shares(len(told), buckets)
    v = np.concatenate(([0], ends))[a]
    return [(repeated[1][r[i] : r[i + 1]].tobytes(), values[v[i] : v[i + 1]].tobytes(), asks[a[i] : a[i + 1]].tobytes(), told[t[i] : t[i + 1]].tobytes()) for i in range(buckets)]


def _filled(parts: list[tuple[bytes, ...]], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket that has anything: its number and its arrays."""
    rows = [(i, *p) for i, p in enumerate(parts) if any(p)]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)], names)


def _gather(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _more_than_once(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def _rows(out: np.ndarray) -> pa.Table:
    return pa.table({name: pa.array(np.ascontiguousarray(out[name]).astype(np.int64)) for name in out.dtype.names})


def _answer_blocks(table: pa.Table) -> pa.Table:
    asks = _gather(table, "asks", _ASK)
    asks = asks[_among(asks["value"], _more_than_once(_gather(table, "probes", "<u4")))]
    told = _gather(table, "told", _BLOCK)
    return _rows(np.concatenate([asks[["id", "check", "block"]].astype(_BLOCK), told]))


def _answer_windows(table: pa.Table) -> pa.Table:
    values, asks, repeated = _gather(table, "values", "<u8"), _gather(table, "asks", _RUN), _gather(table, "repeated", "<u8")
    hit = _among(values, _more_than_once(np.concatenate([values, repeated, repeated])))
    lengths = asks["length"].astype(np.int64)
    run = np.repeat(np.arange(len(asks)), lengths)
    place = asks["start"].astype(np.int64)[run] + np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    run, place = run[hit], place[hit]
    new = np.ones(len(run), bool)
    new[1:] = (np.diff(run) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(new)
    found = asks[run[first]]
    found["start"], found["length"] = place[first], np.diff(np.append(first, len(run)))
    return _rows(np.concatenate([found, _gather(table, "told", _RUN)]))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, id and check (64 and 32 bits that tell rows apart) and text. Copies share the check, so the key is in the id."""
    return df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("id"), F.hash(text).alias("check"), F.col(text).alias("text"))


def repeat_spans(df: DataFrame, key: str, text: str = "text", window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """id and check (as _keyed() has them) and spans array<struct<start, end>>: the maximal exact repeats of each row.

    Starts and ends (exclusive) count words. Rows without a repeat are left out.
    """
    width = (window + 1) // 2
    buckets = 4 * shuffle_width(df, PARTITION)
    rows = _keyed(df, key, text).where(F.length("text") >= 2 * window - 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Chunk(chunk)

        def packed() -> pa.RecordBatch:
            out = _filled(_probe(held, width, buckets), ["bucket", "probes", "asks", "told"])
            held.clear()
            return out

        for batch in slices(batches):
            for row, check, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(bytes.split, utf8(batch.column(2))), strict=True):
                if len(words) >= window and held.add(row, check, words):
                    yield packed()
        if held.size:
            yield packed()

    packed = map_arrow(rows.select("id", "check", "text"), probe, "bucket int, probes binary, asks binary, told binary")
    anchors = stage(packed.groupBy("bucket").applyInArrow(_answer_blocks, "id long, check long, block long"), "repeat-anchors")

    blocks = anchors.groupBy("id", F.col("check").cast("int").alias("check")).agg(F.collect_set("block").alias("blocks"))
    anchored = rows.join(blocks.hint("shuffle_hash"), ["id", "check"]).select("id", "check", "text", "blocks")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Chunk(chunk)
        names = ["bucket", "repeated", "values", "asks", "told"]

        def packed() -> Iterator[pa.RecordBatch]:
            if parts := _extend(held, window, width, buckets):
                yield _filled(parts, names)
            held.clear()

        for batch in slices(batches):
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for row, check, found, words in zip(*columns, map(bytes.split, utf8(batch.column(2))), strict=True):
                if held.add(row, check, words, found):
                    yield from packed()
        if held.size:
            yield from packed()

    packed = map_arrow(anchored, extend, "bucket int, repeated binary, values binary, asks binary, told binary")
    found = stage(packed.groupBy("bucket").applyInArrow(_answer_windows, "id long, check long, start long, length long"), "repeat-windows")
    last = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length") + (window - 1)).alias("end"))))
    return found.groupBy("id", F.col("check").cast("int").alias("check")).agg(last.alias("spans"))


def _cut(words: list[bytes], spans: list[dict] | None) -> tuple[int, bytes]:
    """How many words the spans cover, and the others joined by a space."""
    if not spans:
        return 0, b" ".join(words)
    kept, at = [], 0
    for s in spans:  # sorted by start; they may overlap or touch
        if s["end"] > at:
            kept += words[at : max(at, s["start"])]
            at = s["end"]
    kept += words[at:]
    return len(words) - len(kept), b" ".join(kept)


def remove_repeats(df: DataFrame, key: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed and kept (the words outside all repeats, joined by a space), a row for each row."""
    check_keys([key], ["n_words", "n_removed", "kept"])
    spans = repeat_spans(df, key, text, window)
    schema = T.StructType([df.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [t.split() for t in utf8(batch.column(1))]
            cut = [_cut(w, s) for w, s in zip(words, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([n for n, _ in cut], pa.int64()), pa.array([k for _, k in cut], pa.binary()).cast(pa.string())],
                schema.names,
            )

    joined = _keyed(df, key, text).join(spans.hint("shuffle_hash"), ["id", "check"], "left")
    return map_arrow(joined.select(F.col("key").alias(key), F.col("text").alias("_text"), F.col("spans").alias("_spans")), run, schema)
