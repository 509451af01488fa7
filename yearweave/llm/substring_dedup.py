"""Exact repeats of WINDOW words across documents, found by fixed-block anchors.

Reference blocks are each document's non-overlapping runs of BLOCK = 25 words; a run of 50 words
holds a whole one, wherever it starts. Every rolling window of 25 words probes the blocks. Around each
hit, on the block's side and the probe's, the 50-word windows that hold the anchor are compared by a
second, 80-bit hash; windows whose words also start in a document with a smaller doc_id are removed.
Neighbouring windows join into maximal exact repeats, and all their words go.

The work moves as packed columns of sorted hashes, not as a row per window:

1. documents are dealt to chunks of about CHUNK bytes of text;
2. a chunk sends its distinct probe hashes, with a bit for "also a block", to buckets by hash;
3. a bucket answers each chunk with the hashes that are a block somewhere and occur elsewhere too;
4. a chunk sends the distinct 50-word windows around its anchors, with their smallest and largest
   document, to buckets by hash;
5. a bucket answers with the smallest document of each window that some later document repeats;
6. a chunk removes the covered words.

A passage that a third of all documents share is one hash per chunk, so no bucket grows with the
copies. Sizes of chunks and buckets are parameters of memory, not of results. Anchors are only
candidates, so a false one (a 48-bit collision) costs a little work; windows are equal by 80 bits.

Words are runs of characters other than space and \\t \\n \\v \\f \\r, unchanged. Results for odd
input: a null text has no words; rows with a null doc_id, and repeats within one document, are
neither removed nor a reason to remove; repeated rows have the same doc_id, hence the same result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.llm.words import U64, WHITE, Words, groups, rolling

WINDOW = 50
BLOCK = 25
CHUNK = 16 << 20
#: Bytes that a row counts for besides its text, so that empty texts are dealt out too.
ROW_WEIGHT = 100
_ANCHOR_BITS = 48
_RESULT = "doc_id bigint, n_words bigint, text string, removed array<struct<start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ROWS = "bucket bigint, chunk bigint, hashes binary, flags binary"
_HITS = "chunk bigint, hashes binary"
_WINDOWS = "bucket bigint, chunk bigint, high binary, low binary, least binary, most binary"
_OWNERS = "chunk bigint, high binary, low binary, owner binary"


class Texts:
    """The documents of a chunk, hashed a group at a time."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        self.ids = table["doc_id"].to_pylist()
        self.column = table["text"]

    def groups(self) -> Iterator[tuple[list, list[bytes]]]:
        texts = (x.as_py().encode() if x.is_valid else b"" for x in self.column)
        for first, some in groups(texts):
            yield self.ids[first : first + len(some)], some


def _starts(words: Words, width: int) -> np.ndarray:
    """Whether a window of `width` words in one text starts at each of rolling()'s places."""
    total = int(words.counts.sum())
    ends = np.repeat(np.cumsum(words.counts), words.counts)
    return (np.arange(total) + width <= ends)[: max(0, total - width + 1)]


def _probes(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes of all places (48 bits), and the places that start a window."""
    return rolling(hashes, BLOCK) >> U64(64 - _ANCHOR_BITS), np.flatnonzero(_starts(words, BLOCK))


def _batches(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), slice(a, b)


def _index(buckets: int):
    """Step 2: a chunk's distinct probes, flagged where they are a block, by bucket."""

    def run(table: pa.Table) -> pa.Table:
        parts: list[np.ndarray] = []
        for _, texts in Texts(table).groups():
            words = Words(texts, WHITE)
            probes, at = _probes(words, words.hashes())
            first = np.repeat(words.first, words.counts)[at]
            block = ((at - first) % BLOCK == 0).astype(U64)
            # one number: hash, "is a block", so that a sort brings equal hashes together
            parts.append(np.unique(probes[at] << U64(1) | block))
        every = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)
        hashes, index = np.unique(every >> U64(1), return_index=True)
        flagged = np.bitwise_or.reduceat(every & U64(1), index) if len(index) else every
        # the top bits choose the bucket, so each bucket's hashes are one sorted run
        bucket = (hashes >> U64(_ANCHOR_BITS - 32)) * U64(buckets) >> U64(32)
        chunk = table["chunk"][0].as_py()
        rows = []
        for b, part in _pieces(bucket.astype(np.int64)):
            gaps = np.diff(hashes[part], prepend=U64(0))
            kind = np.uint32 if len(gaps) < 2 or gaps[1:].max() < 1 << 32 else U64
            head = hashes[part.start : part.start + 1].tobytes()
            packed = bytes([np.dtype(kind).itemsize]) + head + gaps[1:].astype(kind).tobytes()
            flags = np.packbits(flagged[part].astype(bool)).tobytes()
            rows.append({"bucket": b, "chunk": chunk, "hashes": packed, "flags": flags})
        return _batches(rows, _schema(_ROWS))

    return run


def _unpack(packed: bytes) -> np.ndarray:
    kind = np.uint32 if packed[0] == 4 else U64
    head = np.frombuffer(packed, U64, 1, 1)
    gaps = np.frombuffer(packed, kind, -1, 9).astype(U64)
    return np.cumsum(np.concatenate([head, gaps]), dtype=U64)


def _match(table: pa.Table) -> pa.Table:
    """Step 3: hashes that are a block in some chunk and occur in two chunks.

    A repeat inside one chunk is the chunk's own affair: it keeps all its block hashes anyway.
    """
    hashes, flags, sizes = [], [], []
    for packed, bits in zip(table["hashes"], table["flags"], strict=True):
        some = _unpack(packed.as_py())
        hashes.append(some)
        flags.append(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(some)))
        sizes.append(len(some))
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    good = np.logical_or.reduceat(np.concatenate(flags)[order] > 0, first)
    good &= np.diff(first, append=len(ranked)) > 1
    hit = np.zeros(len(every), bool)
    hit[order] = good[np.cumsum(new) - 1]
    rows, at = [], 0
    for chunk, some, n in zip(table["chunk"].to_pylist(), hashes, sizes, strict=True):
        found = some[hit[at : at + n]]
        at += n
        if len(found):
            rows.append({"chunk": chunk, "hashes": found.tobytes()})
    return _batches(rows, _schema(_HITS))


def _own_anchors(texts: Texts) -> np.ndarray:
    """Block hashes that occur twice or more among the chunk's own probes."""
    parts = []
    for _, some in texts.groups():
        words = Words(some, WHITE)
        probes, at = _probes(words, words.hashes())
        block = (at - np.repeat(words.first, words.counts)[at]) % BLOCK == 0
        parts.append(probes[at] << U64(1) | block.astype(U64))
    every = np.concatenate(parts) if parts else np.zeros(0, U64)
    every.sort()
    hashes = every >> U64(1)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return hashes
    good = np.bitwise_or.reduceat(every & U64(1), first) > 0
    return hashes[first[good & (np.diff(first, append=len(hashes)) > 1)]]


def _member(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ranked):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ranked, values)
    at[at == len(ranked)] = 0
    return ranked[at] == values


def _window_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """80 bits of every 50-word window, from two independent hashes: 64 and 16."""
    high = rolling(words.hashes(2), WINDOW)
    low = rolling(words.hashes(3), WINDOW) >> U64(48)
    return high, low


def _first_of(keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A sort by key, and the places in it at which a new key starts."""
    high, low = keys
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order, np.flatnonzero(new)


def _extend(buckets: int):
    """Step 4: the distinct windows that hold an anchor, with their smallest and largest document."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _batches([], _schema(_WINDOWS))
        texts = Texts(table)
        parts = [np.frombuffer(x.as_py(), U64) for x in answers["hashes"]]
        anchors = np.unique(np.concatenate([*parts, _own_anchors(texts)]))
        found: list[tuple] = []
        for ids, some in texts.groups():
            words = Words(some, WHITE)
            probes, at = _probes(words, words.hashes())
            hits = at[_member(probes[at], anchors)]
            total = int(words.counts.sum())
            if not len(hits) or total < WINDOW:
                continue
            # a window that starts 0 to 25 words before an anchor holds it
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, np.maximum(hits - (WINDOW - BLOCK), 0), 1)
            np.add.at(cover, hits + 1, -1)
            wanted = (np.cumsum(cover)[: total - WINDOW + 1] > 0) & _starts(words, WINDOW)
            named = np.array([i is not None for i in ids], bool)
            owner = np.repeat(np.arange(len(ids)), words.counts)
            place = np.flatnonzero(wanted)
            place = place[named[owner[place]]]
            if len(place):
                high, low = _window_hashes(words)
                number = np.array([i or 0 for i in ids], np.int64)[owner[place]]
                found.append((high[place], low[place].astype(np.uint16), number))
        if not found:
            return _batches([], _schema(_WINDOWS))
        high, low, docs = (np.concatenate(x) for x in zip(*found, strict=True))
        order, first = _first_of((high, low))
        least = np.minimum.reduceat(docs[order], first)
        most = np.maximum.reduceat(docs[order], first)
        high, low = high[order][first], low[order][first]
        bucket = ((high >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        chunk = table["chunk"][0].as_py()
        rows = []
        for b, part in _pieces(bucket):
            span = (most - least)[part]
            several = np.flatnonzero(span).astype(np.uint32)
            extra = several.tobytes() + most[part][several].tobytes()
            rows.append(
                {
                    "bucket": b,
                    "chunk": chunk,
                    "high": high[part].tobytes(),
                    "low": low[part].tobytes(),
                    "least": least[part].tobytes(),
                    "most": len(several).to_bytes(4, "little") + extra,
                }
            )
        return _batches(rows, _schema(_WINDOWS))

    return run


def _own(table: pa.Table) -> pa.Table:
    """Step 5: to each chunk, the windows that one of its documents repeats from a smaller one."""
    parts, chunks = [], table["chunk"].to_pylist()
    for high, low, least, most in zip(*(table[n] for n in ("high", "low", "least", "most")), strict=True):
        smallest = np.frombuffer(least.as_py(), np.int64)
        raw = most.as_py()
        n = int.from_bytes(raw[:4], "little")
        largest = smallest.copy()
        largest[np.frombuffer(raw, np.uint32, n, 4)] = np.frombuffer(raw, np.int64, n, 4 + 4 * n)
        parts.append(
            (np.frombuffer(high.as_py(), U64), np.frombuffer(low.as_py(), np.uint16), smallest, largest)
        )
    high, low, smallest, largest = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, first = _first_of((high, low))
    owner = np.empty(len(order), np.int64)
    counts = np.diff(first, append=len(order))
    owner[order] = np.repeat(np.minimum.reduceat(smallest[order], first), counts)
    rows, at = [], 0
    for chunk, part in zip(chunks, parts, strict=True):
        here = slice(at, at + len(part[0]))
        at = here.stop
        tell = owner[here] < largest[here]
        if tell.any():
            rows.append(
                {
                    "chunk": chunk,
                    "high": high[here][tell].tobytes(),
                    "low": low[here][tell].tobytes(),
                    "owner": owner[here][tell].tobytes(),
                }
            )
    return _batches(rows, _schema(_OWNERS))


def _remove(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Step 6: words covered by a window that a smaller document owns."""
    high, low, owner = (
        np.concatenate([np.zeros(0, k), *(np.frombuffer(x.as_py(), k) for x in answers[n])])
        for n, k in (("high", U64), ("low", np.uint16), ("owner", np.int64))
    )
    order = np.argsort(high, kind="stable")
    high, low, owner = high[order], low[order], owner[order]
    docs_out, counts, texts, spans = [], [], [], []
    for ids, some in Texts(table).groups():
        words = Words(some, WHITE)
        total = int(words.counts.sum())
        gone = np.zeros(total + 1, np.int64)
        if len(high) and total >= WINDOW:
            ours, more = _window_hashes(words)
            docs = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            docs = np.repeat(docs, words.counts)
            at = np.flatnonzero(_starts(words, WINDOW) & _member(ours, high))
            left = np.searchsorted(high, ours[at])
            # equal 64 bits with other 16 are next to each other: step through them
            open_ = np.arange(len(at))
            while len(open_):
                same = (left[open_] < len(high)) & (
                    high[np.minimum(left[open_], len(high) - 1)] == ours[at[open_]]
                )
                open_ = open_[same]
                row = left[open_]
                hit = (low[row] == more[at[open_]]) & (owner[row] < docs[at[open_]])
                np.add.at(gone, at[open_[hit]], 1)
                np.add.at(gone, at[open_[hit]] + WINDOW, -1)
                left[open_] += 1
                open_ = open_[~hit]
        removed = np.cumsum(gone)[:total] > 0
        for doc, text, at, n in zip(ids, some, words.first, words.counts, strict=True):
            kept = text.split()
            out = removed[at : at + n]
            if out.any():
                kept = [kept[i] for i in np.flatnonzero(~out)]
            docs_out.append(doc)
            counts.append(int(n))
            texts.append(b" ".join(kept))
            edges = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
    columns = {
        "doc_id": pa.array(docs_out, pa.int64()),
        "n_words": pa.array(counts, pa.int64()),
        "text": pa.array(texts, pa.binary()).cast(pa.string()),
        "removed": pa.array(spans, _SPANS),
    }
    return pa.table(columns)


def deduplicated(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, text, removed), a row per row of `docs` (doc_id and text).

    `text` is the words that stay, joined by blanks; `removed` are the spans of words that went, as
    sorted [start, end) among the n_words of the old text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_WEIGHT
    size = docs.agg(F.sum(weight).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // chunk))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))
    dealt = docs.withColumn("chunk", place).repartition(chunks, "chunk")
    probes = dealt.groupBy("chunk").applyInArrow(_index(chunks), _ROWS)
    hits = probes.groupBy("bucket").applyInArrow(_match, _HITS)
    by_chunk = dealt.groupBy("chunk")
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(chunks), _WINDOWS)
    owners = windows.groupBy("bucket").applyInArrow(_own, _OWNERS)
    return by_chunk.cogroup(owners.groupBy("chunk")).applyInArrow(_remove, _RESULT)


def repeats_removed(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), derived from the texts and spans of deduplicated()."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.sha2(F.col("text").cast("binary"), 256)
    return deduplicated(docs, chunk).select(
        "doc_id", "n_words", gone.alias("n_removed"), kept.alias("kept_sha256")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
