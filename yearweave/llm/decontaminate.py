"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Text and items are lower-cased, and every run of characters that are neither letters nor digits is
one blank. An item of m characters may occur with up to e = EDIT_RATE * m edits. Such an occurrence
shares at least m - q + 1 - q * e of the item's q-grams, and their diagonals (place in the text less
place in the item) spread over at most e. So shared q-grams are counted in bins of e + 1 diagonals,
two neighbouring bins form a band (bands overlap by half), and a band is retained when its count
meets the bound. Retained bands are aligned: the item against their stretch of text, free at both
ends, edits counted in a band around the diagonals. No occurrence within the budget is lost.

Benchmark items are the query set, documents are scanned by blocks of items: a block has about
BLOCK_CHARS characters, so what is sent to every task is bounded at any benchmark size, and larger
benchmarks take more scans. Each text is scanned whole, PIECE characters at a time with overlaps.

Results for odd input: null or empty texts and null items match nothing; items with fewer than q
characters never match (they say nothing about a leak); where m is small the budget is the largest
one that still needs a shared q-gram. Repeated items and rows are each reported; a null doc_id or
item_id is kept as it is. Of equally good places the first is reported.
"""

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q = 8
EDIT_RATE = 0.1
BLOCK_CHARS = 1 << 20
PIECE = 1 << 19
_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_GAPS = re.compile(r"[\W_]+")
#: Short q-grams that test a retained band before it is aligned.
FINE = 4


def plain(text: str | None) -> str:
    return _GAPS.sub(" ", (text or "").lower()).strip()


def _fold(codes: np.ndarray) -> np.ndarray:
    return (codes ^ codes >> np.uint32(8) ^ codes >> np.uint32(16)).astype(np.uint8)


@functools.cache
def _table() -> np.ndarray:
    """Of every code point the byte it is scanned as: 0 for what is a blank in plain text."""
    codes = np.arange(0x110000, dtype=np.uint32)
    known = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)
    return np.where(known, _fold(codes) | (_fold(codes) == 0), 0).astype(np.uint8)


def folded(text: str) -> np.ndarray:
    """The plain text as one byte per character, made without the plain text itself.

    Equal characters stay equal, so shared q-grams only grow.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table()[codes]
    keep = out > 0
    keep[1:] |= keep[:-1]  # of a run of gaps only the first
    out = out[keep]
    return out[:-1] if len(out) and not out[-1] else out


def grams(codes: np.ndarray) -> np.ndarray:
    """Every run of Q = 8 bytes as one integer."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw, out = codes.tobytes(), np.empty(n, np.uint64)
    for k in range(min(Q, n)):
        out[k::Q] = np.frombuffer(raw, "<u8", len(range(k, n, Q)), k)
    return out


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed in an item of m characters: one shared q-gram must remain certain."""
    return max(0, min(int(rate * m), (m - Q) // Q))


class Index:
    """The q-grams of a block of items with their places, and what each item allows."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = EDIT_RATE):
        kept = [(i, t) for i, t in ((i, plain(t)) for i, t in items) if len(t) >= Q]
        self.ids = [i for i, _ in kept]
        self.codes = [_codes(t) for _, t in kept]
        self.sizes = np.array([len(t) for t in self.codes], np.int64)
        self.edits = np.array([budget(m, rate) for m in self.sizes], np.int64)
        self.needed = self.sizes - Q + 1 - Q * self.edits
        if not kept:
            return
        per_item = [grams(folded(t)) for _, t in kept]
        counts = [len(g) for g in per_item]
        item = np.repeat(np.arange(len(kept), dtype=np.int32), counts)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        every = np.concatenate(per_item)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(every[order], return_index=True)
        self.many = np.diff(self.first, append=len(every))
        slot = self.slots(self.keys)
        self.by_slot = np.argsort(slot, kind="stable")
        self.in_slot = np.bincount(slot, minlength=1 << _BITS)
        self.slot_first = np.cumsum(self.in_slot) - self.in_slot
        self.in_slot = self.in_slot.astype(np.int8 if self.in_slot.max() < 128 else np.int32)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return (keys * _SPREAD >> np.uint64(64 - _BITS)).astype(np.int32)

    def rows(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among `found` of the known q-grams, and their rows."""
        slot = self.slots(found)
        at = np.flatnonzero(self.in_slot[slot])
        slot, keys = slot[at], found[at]
        first, depth = self.slot_first[slot], self.in_slot[slot]
        row = np.full(len(at), -1)
        for k in range(int(depth.max(initial=0))):
            here = np.flatnonzero(depth > k)
            guess = self.by_slot[first[here] + k]
            hit = self.keys[guess] == keys[here]
            row[here[hit]] = guess[hit]
        known = row >= 0
        return at[known], row[known]

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, lowest diagonal) of the retained bands of a piece of folded text."""
        at, row = self.rows(grams(codes))
        if not len(at):
            return
        many = self.many[row]
        upto = np.cumsum(many)
        posting = np.repeat(self.first[row] - upto + many, many) + np.arange(upto[-1])
        item = self.item[posting]
        # an item that has too few hits in all of the piece has none in a band
        total = np.bincount(item, minlength=len(self.ids))
        enough = np.flatnonzero((total >= self.needed)[item])
        if not len(enough):
            return
        item, posting, at = item[enough].astype(np.int64), posting[enough], np.repeat(at, many)[enough]
        # diagonals start at minus the item's size
        diagonal = at - self.place[posting] + self.sizes[item]
        width = self.edits[item] + 1
        bins = diagonal // width
        span = int(bins.max()) + 2
        hits = item * span + bins
        key, count = np.unique(hits, return_counts=True)
        owner, bins = key // span, key % span
        # the bin before and this one, or this one alone: both are bands of two bins
        follows = np.zeros(len(key), np.int64)
        follows[1:] = np.where(key[1:] == key[:-1] + 1, count[:-1], 0)
        meets = count + follows >= self.needed[owner]
        start = np.where(follows > 0, bins - 1, bins)
        if not meets.any():
            return
        # the lemma counts the item's q-grams: one that hits twice in a band counts once
        places = self.place[posting]
        for i, b in zip(owner[meets].tolist(), start[meets].tolist(), strict=True):
            mine = places[(hits >= i * span + b) & (hits <= i * span + b + 1)]
            if len(np.unique(mine)) >= self.needed[i]:
                yield i, b * int(self.edits[i] + 1) - int(self.sizes[i])


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best place of `item` in `text`, diagonals low..high only.

    Rows are the item's characters, columns the diagonals; the text is free before and after.
    """
    wide = high - low + 1
    far = len(item) + wide
    steps = np.arange(wide)
    column = low + steps
    valid = (column >= 0) & (column <= len(text))
    cost = np.where(valid, 0, far)
    begin = np.where(valid, column, -1)
    padded = np.full(len(text) + 2 * far + len(item) + abs(low) + 2, -1, np.int64)
    shift = far + abs(low) + 1
    padded[shift : shift + len(text)] = text
    for i, x in enumerate(item.tolist()):
        here = column + i + 1  # text consumed after this row, by diagonal
        same = padded[shift + here - 1] == x
        take = cost + ~same  # match or replace: same diagonal
        drop = np.append(cost[1:] + 1, far)  # leave out the item's character: diagonal above
        down = np.append(begin[1:], -1)
        best = np.minimum(take, drop)
        start = np.where(take <= drop, begin, down)
        best = np.where((here >= 0) & (here <= len(text)), best, far)
        # extra characters of the text: any number of steps from a lower diagonal
        level = best - steps
        run = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == run, steps, 0))
        cost, begin = run + steps, start[source]
    end = column + len(item)
    cost = np.where((end >= 0) & (end <= len(text)), cost, far)
    at = int(np.argmin(cost))
    return int(cost[at]), int(begin[at]), int(end[at])


def _dense_enough(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> bool:
    """The lemma again, for short q-grams of the item: how many occur on the band's diagonals."""
    if len(text) < FINE:
        return False
    ours = np.lib.stride_tricks.sliding_window_view(item, FINE) @ _FINE_BASE
    theirs = np.lib.stride_tricks.sliding_window_view(text, FINE) @ _FINE_BASE
    diagonal = np.arange(len(theirs))[:, None] - np.arange(len(ours))
    shared = (theirs[:, None] == ours) & (diagonal >= low) & (diagonal <= high)
    return shared.any(0).sum() >= len(ours) - FINE * edits


_FINE_BASE = (np.int64(0x110000) ** np.arange(3)).tolist()
_FINE_BASE = np.array([*_FINE_BASE, 0x9E3779B97F4A7C1], np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def leaks(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each item that occurs in a text, at its best place.

    start and end count characters of the plain text.
    """
    best: dict[int, tuple[int, int, int]] = {}
    if not index.ids or not text:
        return []
    whole = folded(text)
    reach = int((index.sizes + 2 * index.edits).max()) + 2
    exact = None
    for lo in range(0, max(1, len(whole)), PIECE):
        piece = whole[lo : lo + PIECE + reach]
        for i, low in index.bands(piece):
            m, e = int(index.sizes[i]), int(index.edits[i])
            high = low + 2 * e + 1
            # e more diagonals on either side: the band holds the hits, the path may leave it by e
            a, b = max(0, low - e), min(len(piece), high + e + m)
            if exact is None:
                exact = _codes(plain(text))
            item, stretch = index.codes[i], exact[lo + a : lo + b]
            if not _dense_enough(item, stretch, low - e - a, high + e - a, e):
                continue
            edits, start, end = align(item, stretch, low - e - a, high + e - a)
            if edits <= e:
                new = (edits, lo + a + start, lo + a + end)
                best[i] = min(best.get(i, new), new)
    return [(i, start, end, edits) for i, (edits, start, end) in sorted(best.items())]


_FOUND = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int, similarity double"


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                for i, start, end, edits in leaks(text.as_py(), index):
                    share = 1.0 - edits / int(index.sizes[i])
                    rows.append((doc, index.ids[i], start, end, edits, share))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            names = ("doc_id", "item_id", "start", "end", "edits", "similarity")
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _blocks(items: DataFrame, rate: float) -> Iterator[Index]:
    """The items as indexes of about BLOCK_CHARS characters, fetched one by one."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        some = items.where(block == k).orderBy("item_id", "text").collect()
        yield Index([(r["item_id"], r["text"]) for r in some], rate)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits, similarity) per document and item that it holds.

    start and end count characters of the plain text. `docs` needs doc_id and text, `items`
    item_id and text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _blocks(items, rate):
        found = docs.mapInArrow(_scan(index), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _without(index: Index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not leaks(text.as_py(), index) for text in batch[at]]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def clean(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """The documents that hold no item. A filter per block of items, without a shuffle."""
    at = docs.columns.index("text")
    for index in _blocks(items, rate):
        docs = docs.mapInArrow(_without(index, at), docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
