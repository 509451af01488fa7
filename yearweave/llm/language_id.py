"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector (seeded by its code point). A trigram's vector binds, by
elementwise product, its letters' vectors, each permuted by its place. A text's vector is the bundle
(sum) over its trigrams, a language's prototype the bundle over its labelled texts, and a text takes
the language whose prototype has the largest cosine with it.

Training is one pass: each task sums its texts' vectors per language, Spark adds the sums. The model
is languages x dimensions numbers; more than `max_languages` languages is an error, never a cut.

Texts are lower-cased; runs of non-letters count as one boundary symbol. Results for odd input: a
null text or one without a letter is `und` with score 0; rows with null lang or without a letter
teach nothing; if nothing was learned every text is `und`. Equal cosines go to the language that
sorts first. Rows are judged alone, so repeated rows and a null doc_id change nothing.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from yearweave.errors import ParameterFailure

DIMENSIONS = 1024
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
#: Short clean texts score from about 0.07 upwards; below this nothing of a language is left.
MIN_SCORE = 0.03
_SEED = 20177
#: Trigrams bound at a time; trigrams and texts judged at a time. They bound memory, not results.
_SLICE, _TOGETHER, _TEXTS = 4096, 1 << 20, 256
#: Up to this many possible trigrams a table finds the distinct ones, beyond it a sort; same result.
_DENSE = 1 << 22


@dataclass(frozen=True)
class Model:
    """Learned languages, sorted, and their unit prototypes (languages x dimensions)."""

    languages: tuple[str, ...]
    prototypes: np.ndarray


class Letters:
    """Letter vectors, made when a letter is first seen; symbol 0 is the boundary."""

    def __init__(self, dimensions: int):
        self.d = dimensions
        self.number = np.full(0x110000, -1, np.int32)  # -1: not looked at, 0: no letter
        self.rows = np.empty((64, 3, dimensions), np.int8)
        self.size = 0
        self._add(0x110000)

    def _add(self, code: int) -> int:
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        draw = np.random.Generator(np.random.Philox(key=[_SEED, code])).integers(0, 2, self.d)
        vector = (draw * 2 - 1).astype(np.int8)
        self.rows[self.size] = [np.roll(vector, 2), np.roll(vector, 1), vector]
        self.size += 1
        return self.size - 1

    def symbols(self, text: str) -> np.ndarray:
        """Letter numbers of a text with boundaries at both ends; empty if it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        numbers = self.number[codes]
        if numbers.size and numbers.min() < 0:
            for code in np.unique(codes[numbers < 0]).tolist():
                self.number[code] = self._add(code) if chr(code).isalpha() else 0
            numbers = self.number[codes]
        keep = numbers > 0
        keep[1:] |= keep[:-1]  # of a run of non-letters only the first
        out = numbers[keep]
        if not out.any():
            return out[:0]
        return np.pad(out, (1, int(out[-1] != 0))).astype(np.int64)  # it starts with a letter

    def trigrams(self, text: str) -> np.ndarray:
        s = self.symbols(text)
        return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]

    def distinct(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams in order, and the place of each given one among them."""
        k, low = self.size, (1 << 21) - 1
        if k**3 > _DENSE:
            return np.unique(grams, return_inverse=True)
        dense = ((grams >> 42) * k + ((grams >> 21) & low)) * k + (grams & low)
        seen = np.zeros(k**3, bool)
        seen[dense] = True
        found = np.flatnonzero(seen)
        place = np.empty(k**3, np.int32)
        place[found] = np.arange(len(found), dtype=np.int32)
        return (found // (k * k) << 42) | (found // k % k << 21) | found % k, place[dense]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """counts (texts x distinct trigrams) times the bound trigram vectors, a slice at a time."""
        out, low = np.zeros((len(counts), self.d)), (1 << 21) - 1
        for i in range(0, len(grams), _SLICE):
            g = grams[i : i + _SLICE]
            bound = self.rows[g >> 42, 0] * self.rows[(g >> 21) & low, 1]
            bound *= self.rows[g & low, 2]
            out += counts[:, i : i + _SLICE].astype(np.float32) @ bound.astype(np.float32)
        return out

    def bundle_each(self, trigrams: list[np.ndarray]) -> np.ndarray:
        """One vector per list of trigrams."""
        grams, place = self.distinct(np.concatenate(trigrams))
        owner = np.repeat(np.arange(len(trigrams)), [len(t) for t in trigrams])
        shape = (len(trigrams), len(grams))
        counts = np.bincount(owner * shape[1] + place, minlength=shape[0] * shape[1])
        return self.bundle(grams, counts.reshape(shape))


_letters: dict[int, Letters] = {}


def letters(dimensions: int) -> Letters:
    """One table per worker process."""
    return _letters.setdefault(dimensions, Letters(dimensions))


def _bundles(dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters(dimensions)
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def flush() -> None:
            for lang, parts in waiting.items():
                sums[lang] = sums.get(lang, 0) + table.bundle_each([np.concatenate(parts)])[0]
            waiting.clear()

        held = 0
        for batch in batches:
            for text, lang in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                grams = table.trigrams(text)
                if len(grams):
                    waiting.setdefault(lang, []).append(grams)
                    held += len(grams)
                    if held > 1 << 22:
                        flush()
                        held = 0
        flush()
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "v": [vector.round().astype(np.int64)]})

    return run


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Prototypes from a (text, lang) table; all its rows with both are used."""
    rows = labelled.select(F.col("text").alias("t"), F.col("lang").alias("l")).dropna()
    sums = (
        rows.mapInArrow(_bundles(dimensions), "lang string, v array<bigint>")
        .select("lang", F.posexplode("v").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )
    found = sums.take(max_languages * dimensions + 1)
    if len(found) > max_languages * dimensions:
        raise ParameterFailure(f"more than {max_languages} languages")
    names = sorted({r["lang"] for r in found})
    place = {name: i for i, name in enumerate(names)}
    prototypes = np.zeros((len(names), dimensions))
    for r in found:
        prototypes[place[r["lang"]], r["place"]] = r["value"]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(tuple(names), prototypes / np.where(norms > 0, norms, 1))


def _judge(some: list[np.ndarray], model: Model, table: Letters) -> tuple[list[str], list[float]]:
    """Languages and scores of a few texts, given as trigrams."""
    names, scores = [UNDETERMINED] * len(some), [0.0] * len(some)
    known = [i for i, grams in enumerate(some) if len(grams)]
    if known and model.languages:
        vectors = table.bundle_each([some[i] for i in known])
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ model.prototypes.T / np.where(norms > 0, norms, 1)[:, None]
        for i, best, norm, row in zip(known, cosines.argmax(1), norms, cosines, strict=True):
            if norm:
                names[i] = model.languages[best]
                scores[i] = float(min(max(row[best], 0.0), 1.0))
    return names, scores


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` and `lang_pred`, `lang_score` (cosine with the best prototype, 0 to 1).

    Columns that already have these two names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    dimensions = model.prototypes.shape[1]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters(dimensions)
        for batch in batches:
            found, scores, some, held = [], [], [], 0
            for x in [*batch[at], None]:  # one text at a time: a whole batch of them is large
                grams = table.trigrams(x.as_py() or "") if x is not None else np.zeros(0, np.int64)
                if x is None or held + len(grams) > _TOGETHER or len(some) == _TEXTS:
                    for out, new in zip((found, scores), _judge(some, model, table), strict=True):
                        out += new
                    some, held = [], 0
                some.append(grams)
                held += len(grams)
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    new = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]
    schema = StructType([*docs.schema.fields, *new])
    names = schema.names
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on_rest(docs: DataFrame) -> Model:
    """The model of all labelled rows that are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return train(known.select("text", "lang"))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents in a learned language; `und` and scores below `min_score` go.

    Learned from the given rows that are not held out. All columns are carried, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = predict(docs.select(row, "text"), train_on_rest(docs))
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= min_score)
    return judged.where(known).select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = predict(docs.select("doc_id", "text"), train_on_rest(docs))
    return judged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
