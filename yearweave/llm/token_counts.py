"""Token counts of whole texts, in batches of equal bytes inside Arrow functions.

Only doc_id, byte count and text enter the function, and only a length per text leaves it. A long text is
split at boundaries that no token can cross, so the parts' lengths add up to the text's: the
vocabulary's pieces are scanned once per worker for neighbouring characters, and a boundary between two characters
that are neighbours in no piece is safe, because whatever is merged over it would hold both. In this
vocabulary every blank after another character is such a boundary, so parts of about PART characters end
at words. Where a text has no safe boundary, it is one part.

Parts are sent to the library in batches of about BATCH bytes, whatever the lengths of the texts, so a
long text neither delays a batch of short ones nor decides memory.

Results for odd input: a null or empty text has 0 bytes and 0 tokens; null ids, repeated rows and an
empty table are counted like any other. The names of special tokens inside a text are plain text.
Only doc_id and text are read, so other columns may have any name.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a part of a long text, and bytes of a batch.
PART = 1 << 14
BATCH = 1 << 18
_BLANK = "▁"


class Counter:
    """The vocabulary with what is known of its boundaries."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import sentencepiece

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.neighbours = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # a mark that no piece holds beside another character, and the tokens it has by itself
        self.guard = "\n"
        if any(self.guard in pair for pair in self.neighbours):
            raise ValueError(f"{vocabulary} has pieces with line breaks")
        self.guard_tokens = len(self.model.encode(self.guard))

    def cuts(self, text: str, size: int) -> list[int]:
        """Safe boundaries, each the first at `size` characters or more after the one before."""
        out, at = [], size
        while at < len(text):
            pair = text[at - 1 : at + 1].replace(" ", _BLANK)
            if pair in self.neighbours:
                at += 1
            else:
                out.append(at)
                at += size
        return out

    def parts(self, text: str, size: int) -> list[str]:
        """The text in parts; all but the first begin with the guard, which keeps their start apart."""
        if len(text) <= size:
            return [text]
        bounds = [0, *self.cuts(text, size), len(text)]
        some = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [some[0], *(self.guard + part for part in some[1:])]

    def lengths(self, texts: Iterator[str], size: int = PART, batch: int = BATCH) -> np.ndarray:
        """Token counts of the texts."""
        counts: list[int] = []
        held: list[str] = []
        owners: list[int] = []
        weight = 0

        def encode() -> None:
            for owner, ids in zip(owners, self.model.encode(held, num_threads=1), strict=True):
                counts[owner] += len(ids)
            held.clear()
            owners.clear()

        for text in texts:
            parts = self.parts(text, size)
            counts.append(-self.guard_tokens * (len(parts) - 1))
            for part in parts:
                held.append(part)
                owners.append(len(counts) - 1)
                weight += len(part.encode())
                if weight >= batch:
                    encode()
                    weight = 0
        if held:
            encode()
        return np.array(counts, np.int64)


@functools.cache
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def _count(vocabulary: str, part: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or "" for x in batch["text"])
            n = pa.array(counter(vocabulary).lengths(texts, part, size), pa.int64())
            columns = {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def token_counts(
    docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, part: int = PART, batch: int = BATCH
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of `docs` (doc_id and text).

    n_bytes counts the text's UTF-8 bytes, n_tokens its tokens without begin or end marks;
    over_limit says that these are more than `limit`.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), "text")
    counted = rows.mapInArrow(_count(vocabulary, part, batch), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
