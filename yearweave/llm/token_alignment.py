"""Alignment of two tokenisers' tokens, on each distinct text once.

    A  byte-level BPE, on a blank and the text
    B  BPE with byte fallback, on the text; it adds the blank itself

Both sides' tokens are runs of the same bytes. Where a token of A and one of B end at the same byte, they
are linked, and these places cut the tokens into groups. A pair of ids counts how many links of the whole
table hold it; a link is best if no other A id has a higher count with its B id.

Rows are shuffled by their full text, copies counted on the way, and each distinct text is tokenised and
aligned once; its copies only weigh its links. Distinct texts are written in chunks of about CHUNK bytes,
each with its distinct pairs and their weighted counts. Counts are sums over chunks' pairs, and each
chunk gets back the counts of its pairs only, so what is shuffled is pairs per chunk, never links.
Measures return to the documents by the text's SHA-256, whose hot keys are split.

A's ids: `tokenizers` is the reference for the vocabulary; the same vocabulary in `tiktoken` gives
the same ids at several times the speed and is what runs. Names of special tokens are plain text.

Results for odd input: texts that are null or empty, or that a tokeniser does not keep byte for byte (a text
that holds U+2581, which B reads as a blank), have no tokens: zeros, and an empty digest. Null ids and
repeated rows get their text's measures like any other row; an empty table gives an empty result.
Only doc_id and text are read, so other columns may have any name.
"""

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.llm.packing import encoder
from yearweave.operators.skew import split_join
from yearweave.session import stage

A_VOCABULARY = "byte_bpe_50k.tiktoken"
B_VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text in a chunk.
CHUNK = 1 << 23
#: A pair is the number a * WIDE + b.
WIDE = 1 << 20
_BYTE = "<0x{:02X}>"


class Tokens:
    """A vocabulary: ids of a text, the bytes of each id, and its decimal name before each separator."""

    def __init__(self, encode, pieces: list[bytes], inner: bytes, last: bytes):
        self.encode = encode
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        names = [b"%d" % i for i in range(len(pieces))]
        self.names = [n + inner for n in names] + [n + last for n in names]


@functools.cache
def a_tokens(vocabulary: str = A_VOCABULARY) -> Tokens:
    model = encoder(vocabulary)
    pieces = [model.decode_single_token_bytes(i) for i in range(model.n_vocab)]
    return Tokens(lambda text: model.encode_ordinary(" " + text), pieces, b",", b"|")


@functools.cache
def b_tokens(vocabulary: str = B_VOCABULARY) -> Tokens:
    import public_tokenizers
    import sentencepiece

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    single = {_BYTE.format(b): bytes([b]) for b in range(256)}
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        is_byte = model.is_byte(i)
        pieces.append(single[piece] if is_byte else piece.replace("▁", " ").encode())
    return Tokens(model.encode, pieces, b",", b";")


def _ids(tokens: Tokens, text: str, want: bytes) -> np.ndarray | None:
    """The text's ids, or nothing if their bytes are not those of the text."""
    ids = tokens.encode(text)
    if b"".join([tokens.pieces[i] for i in ids]) != want:
        return None
    return np.array(ids, np.int64)


class Alignment(NamedTuple):
    """What two tokenisers made of one text: sizes, the digest of the groups, links as pairs of ids."""

    n_a: int
    n_b: int
    n_groups: int
    groups_sha256: str
    pairs: np.ndarray


NOTHING = Alignment(0, 0, 0, "", np.zeros(0, np.int64))


class Aligner:
    """Two vocabularies side by side."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.names = a.names + b.names

    def align(self, text: str | None) -> Alignment:
        if not text:
            return NOTHING
        a, b = self.a, self.b
        want = b" " + text.encode()
        ids_a = _ids(a, text, want)
        ids_b = _ids(b, text, want) if ids_a is not None else None
        if ids_b is None:
            return NOTHING
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        # every token has a byte at least, so a place ends one token of a side at most
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        digest = hashlib.sha256(self._groups(ids_a, ids_b, at_a, at_b)).hexdigest()
        return Alignment(len(ids_a), len(ids_b), len(at_a), digest, ids_a[at_a] * WIDE + ids_b[at_b])

    def _groups(self, ids_a, ids_b, at_a, at_b) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: ids by group, each name with the separator that follows it."""
        n_a, n_b = len(ids_a), len(ids_b)
        group_a = np.searchsorted(at_a, np.arange(n_a))
        group_b = np.searchsorted(at_b, np.arange(n_b))
        ended_b = np.concatenate([[0], at_b + 1])  # tokens of B in the groups before
        code_a, code_b = ids_a.copy(), ids_b.copy()
        code_a[at_a] += len(self.a.pieces)
        code_b[at_b] += len(self.b.pieces)
        merged = np.empty(n_a + n_b, np.int64)
        merged[np.arange(n_a) + ended_b[group_a]] = code_a
        merged[np.arange(n_b) + at_a[group_b] + 1] = code_b + len(self.a.names)
        names = self.names
        return b"".join([names[i] for i in merged.tolist()])[:-1]


@functools.cache
def _aligner(a_vocabulary: str, b_vocabulary: str) -> Aligner:
    return Aligner(a_tokens(a_vocabulary), b_tokens(b_vocabulary))


_ALIGNED = (
    "chunk bigint, digest string, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
    "links array<bigint>, pairs array<bigint>, counts array<bigint>"
)
_NAMES = [part.split()[0] for part in _ALIGNED.split(", ")]


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    empty = np.zeros(0, np.int64)
    flat = np.concatenate([empty, *(v for v in values if v is not None)])
    sizes = [None if v is None else len(v) for v in values]
    ends = np.cumsum([0, *(n or 0 for n in sizes)]).astype(np.int32)
    mask = pa.array([n is None for n in sizes], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()), mask=mask)


def _align(a_vocabulary: str, b_vocabulary: str, size: int):
    """Rows of distinct texts (digest, copies, text) to rows of aligned texts and, per chunk, of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_vocabulary, b_vocabulary)
        chunk = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        weights: list[int] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            links = [row[6] for row in rows]
            flat = np.concatenate(links)
            pairs, where = np.unique(flat, return_inverse=True)
            copies = np.repeat(np.array(weights, np.int64), [len(x) for x in links])
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, where, copies)
            every = [(*row, None, None) for row in rows]
            every.append((chunk, None, None, None, None, None, None, pairs, counts))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[k] for r in every], t) for k, t in enumerate(kinds)]
            columns += [_lists([r[k] for r in every]) for k in (6, 7, 8)]
            return pa.RecordBatch.from_arrays(columns, names=_NAMES)

        for batch in batches:
            for digest, copies, text in zip(batch["digest"], batch["copies"], batch["text"], strict=True):
                text = text.as_py()
                rows.append((chunk, digest.as_py(), *aligner.align(text)))
                weights.append(copies.as_py())
                held += len(text)
                if held >= size:
                    yield batch_of()
                    rows, weights, held = [], [], 0
                    chunk += 1
        if rows:
            yield batch_of()

    return run


_MEASURED = "digest string, n_best bigint, count_sum bigint"


def _measure(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Sums over the links of a chunk's texts, from the counts of the chunk's pairs."""
    found = found.sort_by("pair")
    pairs, counts, best = (found[c].to_numpy() for c in ("pair", "count", "best"))
    links = texts["links"].combine_chunks()
    sizes = links.value_lengths().to_numpy(zero_copy_only=False)
    where = np.searchsorted(pairs, links.flatten().to_numpy())
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[where].astype(np.int64))])
        return total[ends[1:]] - total[ends[:-1]]

    columns = {"digest": texts["digest"], "n_best": pa.array(sums(best)), "count_sum": pa.array(sums(counts))}
    return pa.table(columns)


def alignments(
    docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_vocabulary: str = B_VOCABULARY, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, pairs, measures), tables of the distinct texts and of the id pairs.

    texts: chunk, digest (SHA-256 of the text), n_a, n_b, n_groups, groups_sha256 and links, a number
    a * WIDE + b for each link in the text's order. pairs: pair, a_id, b_id, count and best (no A id has a
    higher count with this B id). measures: digest, n_best and count_sum, for texts with links.
    """
    text = docs.where("text is not null and text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    distinct = text.select(F.sha2("text", 256).alias("digest"), "copies", "text")
    aligned = stage(distinct.mapInArrow(_align(a_vocabulary, b_vocabulary, chunk), _ALIGNED))
    texts = aligned.where("digest is not null").drop("pairs", "counts")
    both = F.explode(F.arrays_zip("pairs", "counts")).alias("e")
    listed = aligned.where("digest is null").select("chunk", both)
    listed = listed.select("chunk", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    counts = listed.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.select(
        "pair",
        F.expr(f"pair div {WIDE}").cast("int").alias("a_id"),
        F.pmod("pair", F.lit(WIDE)).cast("int").alias("b_id"),
        "count",
    )
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))
    pairs = counts.join(highest, "b_id").withColumn("best", F.col("count") == F.col("highest")).drop("highest")
    pairs = stage(pairs)
    found = listed.select(F.col("chunk").alias("home"), "pair").join(pairs.select("pair", "count", "best"), "pair")
    linked = texts.where("n_groups > 0").select("chunk", "digest", "links")
    measures = linked.groupBy("chunk").cogroup(found.groupBy("home")).applyInArrow(_measure, _MEASURED)
    return texts, pairs, measures


def document_measures(docs: DataFrame, **settings) -> DataFrame:
    """A row per row of `docs` (doc_id and text) with the measures of its text's alignment."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts, _, measures = alignments(docs, **settings)
    texts = texts.drop("chunk", "links").join(measures, "digest", "left")
    rows = docs.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("digest"))
    out = split_join(rows, texts, ["digest"], "left", ["doc_id"])
    zero = {"n_a": "n_a", "n_b": "n_b", "n_groups": "n_groups", "n_links": "n_groups", "n_best": "n_best"}
    zero["count_sum"] = "count_sum"
    return out.select(
        "doc_id",
        *(F.coalesce(source, F.lit(0)).cast("long").alias(name) for name, source in zero.items()),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
