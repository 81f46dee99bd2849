"""Benchmark decontamination by latent semantic retrieval (operator 10).

Texts are cut into passages of PASSAGE words, benchmark items into pieces of at most as many. Terms are all words of
all texts, hashed into TERMS places; document frequencies are counted over all passages of all documents. A
randomised singular value decomposition of the TF-IDF rows of all passages, with the pieces' rows raised to the same
total weight, gives a latent space of RANK dimensions: one distributed pass forms the product of the Gram matrix with
a random matrix, whose slices are summed over two levels, and the driver factors the small rest (Nystrom's method).
Another pass projects overlapping passages, compares each with all pieces, and checks the pairs whose cosine reaches
COSINE and that share SHARE of the piece's weight. Around the passage, within a stretch little longer than the item, the longest common subsequence with the
item must cover LCS of its words by weight (their inverse document frequency, so that common words, which any two
texts share in order, count for little) and ANSWER of the weight of its last sentence, or SURE of all its weight.

Texts are read once and written to the shared folder as 32-bit hashes of their words, which is all that counting,
factoring, searching and checking need; by them two different words count as one with a chance of 2^-32. What a
worker holds beside a slice of texts is the matrix of TERMS by RANK, whatever the size of corpus and benchmark, and
the items and pieces of a block; passages meet pieces in bounded chunks. Blocks of at most BLOCK items are searched
for one after the other, in the same space and the same hashes. Only a block's items, the frequencies and the matrix
reach the driver.

Defined results: null or empty texts match nothing; null ids are carried through; an item without words matches
nothing; repeated rows and repeated items each give their own rows; of several places of one item in a document
the one that covers the most is reported, the first of ties; an empty table on either side gives an empty result;
other columns are not read; texts of any length are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import map_arrow, slices, utf8
from tramline.store import stage

PASSAGE = 32
#: Places that terms are hashed into.
TERMS = 1 << 15
RANK = 64
OVERSAMPLE = 8
COSINE = 0.6
#: Of a piece's weight, what its words that a passage has must weigh for a closer look. Of a copy of LCS of an item some
#: passage has three quarters at least, wherever the passages begin; unrelated ones have the common words alone.
SHARE = 0.2
#: No text without a leak reached 0.35 of an item's weight in the driver's tables.
LCS = 0.35
ANSWER = 0.1
SURE = 0.4
#: Items, and bytes of their texts, that are searched for at a time.
BLOCK = 20_000
BLOCK_BYTES = 32 << 20
#: Cosines that a worker computes at a time.
CELLS = 1 << 21
SEED = 20

_HALF = PASSAGE // 2
_ROWS = 256  # terms in a slice of the product matrix
_RUN = 8  # rows that are summed at a time
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_ENDS = (b".", b"!", b"?")
_PIECE = 1 << 18  # bytes that are hashed at a time
_DRAW = np.random.default_rng(SEED).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(text: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of a text (runs of letters, digits and non-ASCII bytes, in lower case) 32-bit hashes, and where they begin.

    A word's hash is a polynomial in its bytes, taken from sums over the whole text, so there is no loop over words.
    """
    raw = _TABLE[np.frombuffer(text, np.uint8)]
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        if end < len(raw):  # back to the last gap, or on to the next one behind a longer word
            gaps = np.flatnonzero(raw[at:end] == 32)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(raw) and raw[end] != 32:
                    end += 1
        part = raw[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = part != 32
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(1 << max(18, (len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_DRAW[part] * power[: len(part)], out=sums[1:])
        value = (sums[last] - sums[first]) * inverse[first]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        hashes.append((value >> np.uint64(32)).astype(np.uint32))
        places.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, one text after the other, and how many each has."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    found, place = word_hashes(b" ".join(texts))
    ends = np.cumsum(lengths)
    upto = np.searchsorted(place, ends)
    return found, np.diff(np.append(0, upto)) if len(texts) else upto


def answer_words(text: bytes) -> int:
    """How many of an item's words its last sentence has; of an item of one sentence, its last third."""
    body = text.rstrip(b" \t\r\n.!?")
    cut = max(body.rfind(e) for e in _ENDS)
    total = len(word_hashes(text)[0])
    last = len(word_hashes(body[cut + 1 :])[0]) if cut >= 0 else total
    return last if 0 < last < total else -(-total // 3)


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of texts that were written as hashes."""
    parts = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)


def cells_of(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `width` terms, texts cut from their beginnings (TERMS fills the last row of each), and the text of each row."""
    rows = -(-sizes // width)
    out = np.full(int(rows.sum()) * width, TERMS, np.uint16)
    shift = (np.cumsum(rows) - rows) * width - (np.cumsum(sizes) - sizes)
    out[np.arange(len(words)) + np.repeat(shift, sizes)] = words & np.uint32(TERMS - 1)
    return out.reshape(-1, width), np.repeat(np.arange(len(sizes)), rows)


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the distinct terms of each row."""
    ordered = np.sort(cells, axis=1)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.flatnonzero(new)
    count, term = np.diff(np.append(first, ordered.size)), ordered.ravel()[first]
    real = term < TERMS
    return first[real] // cells.shape[1], term[real], count[real]


def _gathered(matrix: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sums of the matrix's rows (its last one is zero) over the terms of each cell, column by column of the cells."""
    out = np.empty((len(cells), matrix.shape[1]), np.float32)
    for at in range(0, len(cells), 512):
        columns = np.ascontiguousarray(cells[at : at + 512].T).astype(np.intp)
        part, more = out[at : at + 512], np.empty((columns.shape[1], matrix.shape[1]), np.float32)
        matrix.take(columns[0], axis=0, out=part, mode="clip")
        for column in columns[1:]:
            part += matrix.take(column, axis=0, out=more, mode="clip")
    return out


def _summed(matrix: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the matrix's rows (its last one is zero) over runs of `rows` that begin at `first`.

    Runs are cut into pieces of _RUN, and sums of pieces are summed again; numpy's reduceat takes five times as long.
    """
    out, counts = np.empty((len(first), matrix.shape[1]), np.float32), np.diff(np.append(first, len(rows)))
    alone = counts == 1
    out[alone] = matrix.take(rows[first[alone]], axis=0)
    if not alone.all():
        counts, first = counts[~alone], first[~alone]
        pieces = -(-counts // _RUN)
        begin = np.cumsum(pieces) - pieces
        cells = np.full(int(pieces.sum()) * _RUN, len(matrix) - 1, np.intp)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        cells[np.repeat(begin * _RUN, counts) + within] = rows[np.repeat(first, counts) + within]
        sums = _gathered(matrix, cells.reshape(-1, _RUN))
        out[~alone] = _summed(_with_zero(sums), np.arange(len(sums)), begin)
    return out


def _with_zero(matrix: np.ndarray) -> np.ndarray:
    return np.vstack([matrix, np.zeros((1, matrix.shape[1]), matrix.dtype)]).astype(np.float32, copy=False)


def gram_product(cells: np.ndarray, idf: np.ndarray, omega: np.ndarray, total: np.ndarray) -> int:
    """Add A'A omega to total, for the TF-IDF rows A, of unit length, of some passages; how many of them are not zero.

    omega has its rows multiplied by idf already, and a last row of zeros; what is added is not multiplied by idf yet.
    """
    row, term, count = _distinct(cells)
    norm = np.bincount(row, (count * idf[term]) ** 2, len(cells))
    used = norm > 0
    dense = _gathered(omega, cells) / np.where(used, norm, 1).astype(np.float32)[:, None]
    flat = cells.ravel()
    order = np.argsort(flat, kind="stable")[: int((flat < TERMS).sum())]
    if len(order):
        by = flat[order]
        first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        total[by[first]] += _summed(_with_zero(dense), order // cells.shape[1], first)
    return int(used.sum())


def nystrom(product: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors, as columns, of a positive matrix G known by its product G omega."""
    shift = 1e-6 * np.linalg.norm(product) + 1e-30
    product = product + shift * omega
    core = omega.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-7
    left, _, _ = np.linalg.svd(product @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank]


def lcs(words: list[int], masks: dict[int, int], size: int) -> int:
    """The length of the longest common subsequence with the item of these position masks, bit-parallel."""
    full = (1 << size) - 1
    state = full
    for w in words:
        if m := masks.get(w):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return size - state.bit_count()


def weighted_lcs(item: np.ndarray, weight: np.ndarray, words: np.ndarray) -> float:
    """The greatest weight of a common subsequence of an item, whose words have weights, and some words."""
    best = np.zeros(len(words) + 1)
    for h, w in zip(item, weight, strict=True):
        hit = np.flatnonzero(words == h)
        if len(hit):
            here = best.copy()
            here[hit + 1] = np.maximum(here[hit + 1], best[hit] + w)
            best = np.maximum.accumulate(here)
    return float(best[-1])


class Item:
    """A benchmark item, prepared for checks."""

    def __init__(self, text: bytes, idf: np.ndarray):
        self.words = word_hashes(text)[0]
        tail = answer_words(text)
        weight = idf[self.words & np.uint32(TERMS - 1)]
        self.weight = weight / weight.sum()
        self.last, self.last_weight = self.words[-tail:], self.weight[-tail:] / self.weight[-tail:].sum()
        self.masks: dict[int, int] = {}
        self.bag: dict[int, float] = {}
        for i, (w, x) in enumerate(zip(self.words.tolist(), self.weight.tolist(), strict=True)):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
            self.bag[w] = self.bag.get(w, 0.0) + x

    def measure(self, words: np.ndarray, start: int, end: int) -> tuple[float, float, int, int, int] | None:
        """Of the stretch around words[start:end] that covers most words of the item: the weights of the longest common
        subsequences with the item and with its last sentence, how many words that is, and the stretch; None below LCS."""
        n = len(self.words)
        low, high = max(0, start - n), min(len(words), end + n)
        near = words[low:high]
        values = near.tolist()
        # No subsequence weighs more than all words that are there.
        if sum(self.bag[w] for w in self.bag.keys() & set(values)) < LCS:
            return None
        span, step, best = n + n // 3 + 1, max(1, n // 8), (0, 0, 0)
        for at in range(0, max(1, len(values) - span + step), step):
            common = lcs(values[at : at + span], self.masks, n)
            if common > best[0]:
                best = (common, at, min(at + span, len(values)))
        common, a, b = best
        total = weighted_lcs(self.words, self.weight, near[a:b])
        if total < LCS:
            return None
        return total, weighted_lcs(self.last, self.last_weight, near[a:b]), common, low + a, low + b


def accepted(total: float, answer: float) -> bool:
    return total >= SURE or (total >= LCS and answer >= ANSWER)


def pieces_of(texts: list[bytes], most: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """The items' words in even pieces of `most` at most, as cells, and the item of each."""
    words, sizes = hashed(texts)
    parts = -(-sizes // most)
    cuts = [(k + 1) * n // p - k * n // p for n, p in zip(sizes.tolist(), parts.tolist(), strict=True) for k in range(p)]
    return cells_of(words, np.array(cuts, np.int64), most)[0], np.repeat(np.arange(len(sizes)), parts)


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """key and terms binary: the texts as hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            words, sizes = hashed(utf8(batch.column(1)))
            raw, ends = words.astype("<u4", copy=False).tobytes(), (np.cumsum(sizes) * 4).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())], [key, "terms"])

    return map_arrow(docs, run, T.StructType([docs.schema[key], T.StructField("terms", T.BinaryType())]))


def _add(kind: str):
    def run(table: pa.Table) -> pa.Table:
        total = functools.reduce(np.add, (np.frombuffer(x.as_py(), kind).astype(np.float64) for x in table.column("matrix")))
        return pa.table({"slice": table.column("slice").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())]), "matrix": pa.array([total.astype(kind).tobytes()], pa.binary())})

    return run


def _sum_over(terms: DataFrame, shape: tuple[int, ...], kind: str, begin, work) -> tuple[np.ndarray, int]:
    """The sum over all tasks of an array that work(cells, array, begin()) adds to, and of the numbers that it returns.

    Slices of the arrays are summed over two levels, so a group has no more than the root of the number of tasks.
    """
    fan = max(1, int(terms.rdd.getNumPartitions() ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, state = np.zeros(shape, kind), 0, begin()
        for batch in slices(batches, 512):
            n += work(cells_of(*_packed(batch.column(0)), PASSAGE)[0], total, state)
        parts = [total[i : i + _ROWS].tobytes() for i in range(0, len(total), _ROWS)]
        context = TaskContext.get()
        part = [context.partitionId() % fan if context else 0] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(part, pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["slice", "part", "n", "matrix"])

    parts = map_arrow(terms, run, "slice int, part int, n long, matrix binary")
    parts = parts.groupBy("slice", "part").applyInArrow(_add(kind), "slice int, n long, matrix binary")
    parts = parts.groupBy("slice").applyInArrow(_add(kind), "slice int, n long, matrix binary")
    found = sorted(parts.collect())  # TERMS rows in all, whatever the input
    if not found:
        return np.zeros(shape), 0
    return np.concatenate([np.frombuffer(r["matrix"], kind) for r in found]).reshape(shape).astype(np.float64), found[0]["n"]


def _frequencies(terms: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each term is found, and how many passages there are."""

    def work(cells: np.ndarray, total: np.ndarray, _) -> int:
        total += np.bincount(_distinct(cells)[1], minlength=TERMS)
        return len(cells)

    return _sum_over(terms, (TERMS,), "<i8", lambda: None, work)


def _latent(terms: DataFrame, blocks: Iterator[list[bytes]], idf: np.ndarray, rank: int) -> np.ndarray:
    """TERMS + 1 x rank: the latent space of all passages and pieces, times each term's weight, and a row of zeros."""
    width = rank + OVERSAMPLE

    def draw() -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((TERMS, width))

    def omega() -> np.ndarray:
        return _with_zero(draw() * idf[:, None])

    def work(cells: np.ndarray, total: np.ndarray, plane: np.ndarray) -> int:
        return gram_product(cells, idf, plane, total)

    product, rows = _sum_over(terms, (TERMS, width), "<f4", omega, work)
    own, n, plane = np.zeros((TERMS, width), np.float32), 0, omega()
    for texts in blocks:
        n += gram_product(pieces_of(texts)[0], idf, plane, own)
    product += own * (max(rows, 1) / max(n, 1))
    return _with_zero(nystrom(product * idf[:, None], draw(), rank) * idf[:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def passages_of(words: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping passages of some texts, half a passage apart: terms, unit vectors, text, and first word there."""
    cells, text = cells_of(words, sizes, _HALF)
    sums = _gathered(matrix, cells)
    joined = np.append(text[1:] == text[:-1], False)
    first = np.append(True, ~joined[:-1])
    # A passage is two cells that follow one another, or the only cell of a text.
    at = np.flatnonzero(joined | first)
    pair = joined[at]
    terms = np.full((len(at), PASSAGE), TERMS, np.uint16)
    terms[:, :_HALF] = cells[at]
    terms[pair, _HALF:] = cells[at[pair] + 1]
    rows = sums[at]
    rows[pair] += sums[at[pair] + 1]
    starts = np.flatnonzero(first)
    number = np.arange(len(cells)) - np.repeat(starts, np.diff(np.append(starts, len(cells))))
    return terms, _unit(rows), text[at], number[at] * _HALF


def candidates(terms: np.ndarray, rows: np.ndarray, pieces: np.ndarray, weights: np.ndarray, targets: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Passage, piece and cosine of the pairs that reach COSINE and SHARE, in chunks of CELLS cosines."""
    step = max(1, CELLS // max(1, len(pieces)))
    for at in range(0, len(rows), step):
        alike = rows[at : at + step] @ targets.T
        flat = np.flatnonzero(alike >= COSINE)
        for low in range(0, len(flat), 2048):
            row, piece = np.divmod(flat[low : low + 2048], len(pieces))
            there = (terms[at + row][:, :, None] == pieces[piece][:, None, :]).any(1)
            near = np.flatnonzero((there * weights[piece]).sum(1) >= SHARE)
            yield from zip((at + row[near]).tolist(), piece[near].tolist(), alike.ravel()[flat[low + near]].tolist(), strict=True)


def _search(numbered: DataFrame, key: str, item_type: T.DataType, items: list[tuple], idf: np.ndarray, matrix: np.ndarray) -> DataFrame:
    schema = _schema(numbered, key, item_type)
    texts = [t for _, t in items]
    pieces, owner = pieces_of(texts)
    targets = _unit(_gathered(matrix, pieces))
    weights = np.append(idf, 0)[pieces]
    weights = (weights / np.maximum(weights.sum(1, keepdims=True), 1e-12)).astype(np.float32)
    # What fills a piece up is another term than what fills a passage up.
    pieces = np.where(pieces == TERMS, TERMS + 1, pieces).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Item] = {}
        for batch in slices(batches, 512):
            words, sizes = _packed(batch.column(1))
            if not len(words):
                continue
            begin = np.cumsum(sizes) - sizes
            terms, rows, text, start = passages_of(words, sizes, matrix)
            best: dict[tuple[int, int], tuple] = {}
            for r, p, cosine in candidates(terms, rows, pieces, weights, targets):
                doc, i = int(text[r]), int(owner[p])
                if i not in ready:
                    ready[i] = Item(texts[i], idf)
                found = ready[i].measure(words[begin[doc] : begin[doc] + sizes[doc]], int(start[r]), int(start[r]) + PASSAGE)
                if found and accepted(*found[:2]) and ((doc, i) not in best or found[0] > best[doc, i][1]):
                    best[doc, i] = (cosine, *found)
            if best:
                ids = batch.column(0)
                at = pa.array([d for d, _ in best], pa.int64())
                out = list(best.values())
                numbers = [[len(ready[i].words) for _, i in best], *([b[k] for b in out] for k in (4, 5))]
                floats = [[b[k] for b in out] for k in (0, 1, 2)]
                columns = [ids.take(at), pa.array([items[i][0] for _, i in best], _arrow(item_type)), *(pa.array(f, pa.float64()) for f in floats), pa.array([b[3] for b in out], pa.int64()), *(pa.array(n, pa.int64()) for n in numbers)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(numbered, run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def _schema(documents: DataFrame, key: str, item_type: T.DataType) -> T.StructType:
    floats = [T.StructField(n, T.DoubleType()) for n in ("cosine", "share", "answer")]
    longs = [T.StructField(n, T.LongType()) for n in ("lcs", "item_words", "start", "end")]
    return T.StructType([documents.schema[key], T.StructField("item_id", item_type), *floats, *longs])


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str, item: str = "item_id", text: str = "text", rank: int = RANK, block: int = BLOCK) -> DataFrame:
    """key, item_id, cosine, share and answer (weights covered of the item and of its last sentence), lcs (words), item_words,
    start and end (words of the document): a row for each item found in a row.

    Item ids are longs, ints or strings; rows' keys are of any type.
    """
    spark, item_type = documents.sparkSession, benchmark.schema[item].dataType
    filled = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.length(F.coalesce(text, F.lit(""))) > 0)
    n, size = filled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-size // BLOCK_BYTES))

    def items(b: int) -> list[tuple]:
        own = filled if blocks == 1 else filled.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = [(k, t.encode()) for k, t in own.orderBy("item", "text").collect()]
        return [(k, t) for k, t in rows if len(word_hashes(t)[0])]

    numbered = stage(_numbered(documents.select(key, text), key), "leak-terms")
    terms = numbered.select("terms")
    df, passages = _frequencies(terms)
    idf = np.log1p(passages / (df + 1))
    parts: list[DataFrame] = []
    if passages:
        matrix = _latent(terms, ([t for _, t in items(b)] for b in range(blocks)), idf, rank)
        for b in range(blocks):
            if own := items(b):
                parts.append(stage(_search(numbered, key, item_type, own, idf, matrix), "leaks"))
    if not parts:
        return spark.createDataFrame([], _schema(documents, key, item_type))
    return functools.reduce(DataFrame.unionByName, parts)
