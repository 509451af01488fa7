"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids end with an end mark; longer ones are cut into full pieces, of which the first may
be shorter. Full pieces are sequences of their own. The rest is packed best-fit decreasing and then
improved by local search over underfull bins: moving a piece, exchanging one piece for another, or
two for one, whenever the sum of squared fills grows, until small bins run empty.

Pieces are dealt to shards of about SHARD pieces, each packed on its own. What lies in underfull bins
is then dealt anew to fewer shards and packed again, round after round, until one shard holds it or a
round saves nothing. So no task ever holds more than a shard, whatever the corpus, and what shards
lose at their edges is won back. Packing moves only (key, length): the ids are written once when
tokenising, and what is packed gets them back by a join on the unique key of its piece.

Ids: byte-level BPE of a public vocabulary. `tokenizers` is the reference for the ids; the same
vocabulary in `tiktoken` gives the same ids at four times the speed and is what runs. The text of the
end-of-text token is one id in both.

Results for odd input: a null or empty text is the end mark alone; null ids and repeated rows are
packed like any other row; an empty table gives an empty result.
"""

import functools
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.session import stage

LENGTH = 1024
END_ID = 2
SHARD = 20_000
VOCABULARY = "byte_bpe_50k.tiktoken"
_END_OF_TEXT = "<|endoftext|>"
_SPECIAL_ID = 50256
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids array<int>"
_SEQUENCES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint, ids array<int>"
)
#: Ids in a batch of pieces, so that no batch outgrows memory.
_BATCH = 1 << 21


@functools.cache
def encoder(vocabulary: str):
    """The vocabulary (a name among the public ones, or a path), loaded once per worker."""
    import base64
    from pathlib import Path

    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        vocabulary,
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens={_END_OF_TEXT: _SPECIAL_ID},
    )


def token_ids(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The document's ids, unsigned 32-bit, with the end mark."""
    ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END_ID))


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter, all others are full."""
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def _rows(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays(columns, names=("doc_id", "piece", "start", "length", "ids"))


def _tokenise(vocabulary: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, held = [], [], 0
            for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = token_ids(text.as_py(), vocabulary)
                for k, (at, n) in enumerate(cuts(len(ids), length)):
                    rows.append((doc, k, at, n))
                    parts.append(ids[at : at + n])
                    held += n
                    if held >= _BATCH:
                        yield _rows(rows, parts)
                        rows, parts, held = [], [], 0
            if rows:
                yield _rows(rows, parts)

    return run


def _with_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ids_crc32, from the ids themselves as unsigned 32-bit numbers, low byte first."""
    names = [part.split()[0] for part in _SEQUENCES.split(", ")]
    for batch in batches:
        ids = batch["ids"]
        values, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = [pa.array(sums, pa.int64()) if n == "ids_crc32" else batch[n] for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)


class Bins:
    """Bins of one shard: items by number, sizes, and the underfull bins ordered by fill."""

    def __init__(self, sizes: list[int], length: int):
        self.sizes, self.length = sizes, length
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.by_fill: list[list[int]] = [[] for _ in range(length + 1)]
        self.levels: list[int] = []  # fills that some bin has, sorted

    def _enter(self, b: int) -> None:
        level = self.by_fill[self.fill[b]]
        if not level:
            insort(self.levels, self.fill[b])
        level.append(b)

    def _leave(self, b: int) -> None:
        level = self.by_fill[self.fill[b]]
        level.remove(b)
        if not level:
            self.levels.pop(bisect_right(self.levels, self.fill[b]) - 1)

    def change(self, b: int, out: list[int], new: list[int]) -> None:
        self._leave(b)
        for x in out:
            self.items[b].remove(x)
        self.items[b] += new
        self.fill[b] += sum(self.sizes[x] for x in new) - sum(self.sizes[x] for x in out)
        self._enter(b)

    def best_fit(self, x: int) -> None:
        """Into the fullest bin that has room, or a new one."""
        at = bisect_right(self.levels, self.length - self.sizes[x])
        if at and self.levels[at - 1] > 0:
            b = self.by_fill[self.levels[at - 1]][-1]
            self.change(b, [], [x])
        else:
            self.items.append([x])
            self.fill.append(self.sizes[x])
            self._enter(len(self.items) - 1)

    def underfull(self) -> list[int]:
        return [b for level in self.levels if 0 < level < self.length for b in self.by_fill[level]]

    def _improve(self, b: int, c: int) -> bool:
        """One change between underfull bins b and c (c at least as full) that makes c fuller.

        Any growth of c at the cost of b raises the sum of squares. The largest growth that fits is
        taken: a piece of b moves, or one or two of b go for one of c.
        """
        room = self.length - self.fill[c]
        sizes = self.sizes
        ours = sorted(((sizes[x], x) for x in self.items[b]), reverse=True)
        best: tuple[int, list[int], list[int]] = (0, [], [])
        for size, x in ours:
            if best[0] < size <= room:
                best = (size, [x], [])
        theirs = [(sizes[y], y) for y in self.items[c]]
        singles = ours[:_PAIRS]
        for size_y, y in theirs:
            for i, (size, x) in enumerate(singles):
                gain = size - size_y
                if best[0] < gain <= room:
                    best = (gain, [x], [y])
                for size_2, x_2 in singles[i + 1 :]:
                    if best[0] < gain + size_2 <= room:
                        best = (gain + size_2, [x, x_2], [y])
            if best[0] == room:
                break
        if not best[0]:
            return False
        self.change(b, best[1], best[2])
        self.change(c, best[2], best[1])
        return True

    def search(self) -> None:
        """Local search: the emptiest bin against the others, roomiest first, until bins run empty.

        Over when the bins are as few as their contents allow, or when the PATIENCE emptiest bins
        can give nothing to any other.
        """
        total = sum(self.fill)
        count = sum(f > 0 for f in self.fill)
        stuck: set[int] = set()
        while count > -(-total // self.length) and len(stuck) < PATIENCE:
            others = self.underfull()
            low = next((b for b in others if b not in stuck), None)
            if low is None:
                return
            gained = False
            for c in others:
                if c != low and self.length > self.fill[c] >= self.fill[low] and self._improve(low, c):
                    gained = True
                    stuck.discard(c)
                    if not self.fill[low]:
                        count -= 1
                        break
            if not gained:
                stuck.add(low)


PATIENCE = 4
#: Pieces of a bin that are tried in pairs; bins hold few, but a bin of tiny pieces may hold hundreds.
_PAIRS = 24


def pack(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Item numbers by bin."""
    bins = Bins(sizes, length)
    for x in sorted(range(len(sizes)), key=lambda x: -sizes[x]):
        bins.best_fit(x)
    bins.search()
    return [items for items in bins.items if items]


def _pack_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_pylist()
        number = np.zeros(len(sizes), np.int64)
        offset = np.zeros(len(sizes), np.int64)
        full = np.zeros(len(sizes), bool)
        for b, items in enumerate(pack(sizes, length)):
            at = 0
            for x in items:
                number[x], offset[x] = b, at
                at += sizes[x]
            full[items] = at == length
        out = table
        for name, values in (("bin", number), ("offset", offset), ("full", full)):
            out = out.append_column(name, pa.array(values))
        return out

    return run


_PACKED = "key bigint, length bigint, shard bigint, bin bigint, offset bigint, full boolean"


def _deal(pieces: DataFrame, count: int, shard: int) -> tuple[DataFrame, int]:
    """Random shards of about `shard` rows by the rows' places in the written table."""
    shards = max(1, -(-count // shard))
    place = F.xxhash64(F.monotonically_increasing_id())
    return pieces.withColumn("shard", F.pmod(place, F.lit(shards))), shards


def sequences(
    docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, shard: int = SHARD
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids), a row per piece.

    `docs` needs doc_id and text. sequence_id is unique per sequence, offsets are gapless from 0, so a
    sequence is the ids of its rows in the order of their offsets. ids_crc32 is a checksum of the ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = docs.mapInArrow(_tokenise(vocabulary, length), _PIECES)
    # the key is written with the row, so it stays the piece's own whoever reads it
    pieces = stage(pieces.withColumn("key", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == length)
    whole = whole.withColumn("round", F.lit(0)).withColumn("shard", F.lit(0).cast("long"))
    whole = whole.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    done = None
    rest = pieces.where(F.col("length") < length).select("key", "length")
    count, bins, k = rest.count(), None, 0
    while True:
        k += 1
        dealt, shards = _deal(rest, count, shard)
        packed = stage(dealt.groupBy("shard").applyInArrow(_pack_shard(length), _PACKED))
        left = packed.where("not full")
        after = left.agg(
            F.count("*").alias("rows"), F.countDistinct("shard", "bin").alias("bins")
        ).first()
        # over when one shard held all, or when dealing anew saved too little to go on
        last = shards == 1 or (bins is not None and after["bins"] > 0.999 * bins)
        part = (packed if last else packed.where("full")).drop("full", "length")
        part = part.withColumn("round", F.lit(k))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        rest, count, bins = left.select("key", "length"), after["rows"], after["bins"]
    out = whole.unionByName(pieces.where(F.col("length") < length).join(done, "key"))
    out = out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        # round, shard and bin name a sequence: bins of a shard are fewer than 2^20
        (F.col("round").cast("long") * F.lit(1 << 57) + F.col("shard") * F.lit(1 << 20) + F.col("bin")).alias(
            "sequence_id"
        ),
        "offset",
        "ids",
    )
    return out.mapInArrow(_with_checksums, _SEQUENCES)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
