"""Document quality from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Their accuracies are estimated
without any true label: expectation-maximisation over the counts of vote patterns (at most
3^labellers rows, whatever the corpus), starting from "better than chance". The posterior of a
document's pattern is its soft label. A hashed linear scorer (words, word shapes and binned
statistics, logistic loss) is fitted to the soft labels of a sample of about SAMPLE documents drawn
by a hash, and scores every document; those of THRESHOLD or more are kept.

Pattern counts cover all documents; only the fit of the scorer is on the sample. The model is SLOTS
numbers. Whole texts are read.

Results for odd input: null texts and texts without a word have posterior and score 0, so they are
not kept. An empty table gives an empty result. Rows are judged
alone but for the model, so repeated rows and null ids change nothing else. With one kind of document
only, the accuracies cannot be told apart and stay near their start, so nearly all are kept or
rejected by the majority of votes.
"""

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.llm.words import FOLDED, U64, WHITE, Words, groups, mix

SAMPLE = 8192
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
THRESHOLD = 0.5
ROUNDS = 200
STEPS = 150

# Hand-written: frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that it for was on as with be by at from or are this "
    "le la les de des un une et est que qui dans en du sur pour au aux "
    "der die das und ist von zu den mit im ein eine auf für nicht sich "
    "el los las y que se del por con una su para es lo".split()
)
_CLASS = np.array(
    [
        0 if b in b" \t\n\r\x0b\x0c" else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128
        else 3 if 48 <= b <= 57 else 4
        for b in range(256)
    ],
    np.uint8,
)
#: Bytes to shapes: A, a, 0, white space to a blank, everything else unchanged.
_SHAPE = bytes(
    32 if c == 0 else 65 if c == 1 else 97 if c == 2 else 48 if c == 3 else b
    for b, c in enumerate(_CLASS.tolist())
)
#: Symbols that sentences use, and what ends a word in one.
_SENTENCE = b".,;:!?'\"()-"
_RUN = re.compile(rb"([^0-9A-Za-z\s\x80-\xff])\1")
_STOP = re.compile(rb"[.!?\n]+")
STATISTICS = (
    "words", "top_share", "pair_variety", "symbol_share", "symbol_runs", "upper_share", "odd_tails",
    "bare_symbols", "odd_symbols", "repeated_sentences", "function_share", "stutter",
)


def statistics(raw: bytes) -> tuple[float, ...]:
    """The STATISTICS of a text in UTF-8. All but the number of words are shares."""
    words = raw.translate(FOLDED).split()
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=5)
    letters, symbols = kinds[1] + kinds[2], kinds[4]
    visible = kinds[1:].sum()
    sentences = [x for x in map(bytes.strip, _STOP.split(raw)) if x]
    size = sum(map(len, sentences))
    tokens = raw.split()
    m = max(len(tokens), 1)
    tails = bytes(t[-1] for t in tokens)
    counts = Counter(words)
    plain = symbols - len(raw.translate(None, _NOT_SENTENCE))
    return (
        float(n),
        max(counts.values()) / n if n else 1.0,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        symbols / visible if visible else 1.0,
        sum(1 for t in tokens if _RUN.search(t)) / m,
        kinds[1] / letters if letters else 0.0,
        len(tails.translate(None, _GOOD_TAIL)) / m,
        sum(1 for t in tokens if not t.translate(FOLDED).strip()) / m,
        plain / symbols if symbols else 0.0,
        1 - sum(map(len, set(sentences))) / size if size else 0.0,
        sum(counts[w] for w in _FUNCTION_BYTES if w in counts) / n if n else 0.0,
        sum(map(operator.eq, words, words[1:])) / n if n else 0.0,
    )


_FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)
_GOOD_TAIL = bytes(b for b in range(256) if _CLASS[b] in (1, 2, 3)) + _SENTENCE
_NOT_SENTENCE = bytes(b for b in range(256) if b not in _SENTENCE)
ABSTAIN, BAD, GOOD = 0, 1, 2


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(s: tuple[float, ...]) -> tuple[int, ...]:
    """One vote per labeller; labellers overlap, and abstain where they cannot tell."""
    n, top, variety, symbols, runs, upper, tails, bare, odd, repeated, function, stutter = s
    some, many = n >= 10, n >= 20
    return (
        _vote(n < 1, n >= 30),
        _vote(many and top > 0.2, many and top < 0.12),
        _vote(many and variety < 0.6, many and variety > 0.8),
        _vote(some and symbols > 0.1, some and symbols < 0.06),
        _vote(some and runs > 0.15, some and runs < 0.03),
        _vote(some and upper > 0.3, some and upper < 0.15),
        _vote(some and tails > 0.15, some and tails < 0.03),
        _vote(some and bare > 0.1, some and bare < 0.03),
        _vote(some and symbols > 0.03 and odd > 0.4, some and odd < 0.2),
        _vote(many and repeated > 0.25, many and repeated < 0.1),
        _vote(many and function < 0.02, many and function > 0.06),
        _vote(some and stutter > 0.1, some and stutter < 0.03),
    )


LABELLERS = len(votes((0.0,) * len(STATISTICS)))


def pattern(v: tuple[int, ...]) -> int:
    return sum(x * 3**j for j, x in enumerate(v))


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """P(good) by pattern, from how often each pattern occurs.

    Labellers are taken as independent given the class. Each has an accuracy per class, since a
    labeller that knows one kind of bad text calls the other kinds good; abstaining says nothing.
    Estimates are drawn gently to the start, so rare voters stay sane.
    """
    if not counts:
        return {}
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    cast = np.array([[c // 3**j % 3 for j in range(LABELLERS)] for c in codes])
    good, bad = cast == GOOD, cast == BAD
    start = np.array([0.25, 0.97])  # [class: bad, good]: share of its votes that are right
    right = np.repeat(start[:, None], LABELLERS, axis=1)
    prior = 0.7
    for _ in range(ROUNDS):
        log = np.log(prior) + good @ np.log(right[1]) + bad @ np.log(1 - right[1])
        other = np.log(1 - prior) + bad @ np.log(right[0]) + good @ np.log(1 - right[0])
        q = 1 / (1 + np.exp(np.clip(other - log, -60, 60)))
        pull = 0.001 * weight.sum() + 1
        for j in range(LABELLERS):
            cast_j = good[:, j] | bad[:, j]
            for k, share, hits in ((1, q, good), (0, 1 - q, bad)):
                mass = (weight * share * cast_j).sum()
                hit = (weight * share * hits[:, j]).sum()
                right[k, j] = np.clip((hit + start[k] * pull) / (mass + pull), 0.05, 0.999)
        prior = float(np.clip((weight * q).sum() / weight.sum(), 0.05, 0.99))
    return dict(zip(codes, q.tolist(), strict=True))


def _bins(s: tuple[float, ...]) -> np.ndarray:
    """Slots of the binned statistics."""
    n, *shares = s
    levels = [int(np.log2(n + 1))]
    levels += [int(min(x, 1.0) * 20) for x in shares]
    codes = np.array([1 + j * 1000 + x for j, x in enumerate(levels)], U64)
    return (mix(codes) >> U64(64 - SLOT_BITS)).astype(np.int64)


def _slots(texts: list[bytes], table: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words of a group of texts, and how many each text has."""
    words = Words(texts, table)
    return (words.hashes(seed) >> U64(64 - SLOT_BITS)).astype(np.int64), words.counts


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text: mean of its words, mean of its shapes, its binned statistics."""
    sides = [_slots(texts, WHITE, 11), _slots(texts, _SHAPE, 12)]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = [0, 0]
    for i, text in enumerate(texts):
        slots, values = [_bins(statistics(text))], [np.ones(len(STATISTICS))]
        for k, (every, counts) in enumerate(sides):
            n = int(counts[i])
            found, times = np.unique(every[at[k] : at[k] + n], return_counts=True)
            at[k] += n
            slots.append(found)
            values.append(times / max(n, 1))
        out.append((np.concatenate(slots), np.concatenate(values)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias: logistic loss on soft labels, adaptive full-batch steps."""
    weights, squares = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-8)
    if not rows:
        return weights
    slot = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    used, place = np.unique(slot, return_inverse=True)
    w, b, s = np.zeros(len(used)), 0.0, np.full(len(used) + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(owner, value * w[place], len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / len(rows)
        slope = np.append(np.bincount(place, value * error[owner], len(used)) + 1e-6 * w, error.sum())
        s += slope * slope
        step = 0.3 * slope / np.sqrt(s)
        w -= step[:-1]
        b -= step[-1]
    weights[used], weights[-1] = w, b
    return weights


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    column = batch.column("text").cast(pa.binary())
    yield from groups(x.as_py() or b"" for x in column)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [pattern(votes(statistics(x))) for _, some in _texts(batch) for x in some]
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(found, pa.int32())})


def _fit(soft: dict[int, float]):
    def run(table: pa.Table) -> pa.Table:
        rows, labels = [], []
        # in a fixed order, so that sums do not depend on how the sample arrived
        for batch in table.sort_by([("h", "ascending")]).to_batches():
            for _, some in _texts(batch):
                rows += features(some)
                labels += [soft[pattern(votes(statistics(x)))] for x in some]
        weights = fit(rows, np.array(labels)).astype(np.float32)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})

    return run


def _score(weights: np.ndarray, soft: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, posterior = [], []
            for _, some in _texts(batch):
                z = np.full(len(some), float(weights[-1]))
                for table, seed in ((WHITE, 11), (_SHAPE, 12)):
                    slots, counts = _slots(some, table, seed)
                    owner = np.repeat(np.arange(len(some)), counts)
                    z += np.bincount(owner, weights[slots], len(some)) / np.maximum(counts, 1)
                for i, text in enumerate(some):
                    s = statistics(text)
                    z[i] += weights[_bins(s)].sum() if s[0] else -np.inf
                    posterior.append(soft.get(pattern(votes(s)), 0.5) if s[0] else 0.0)
                score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                scores += np.where(np.isneginf(z), 0.0, score).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(posterior, pa.float64()),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "posterior", "score"],
            )

    return run


def scored(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, posterior, score, kept), a row per row of `docs` (doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(_patterns, "pattern int").groupBy("pattern").count().collect()
    counts = {r["pattern"]: r["count"] for r in rows}
    soft = posteriors(counts)
    h = F.xxhash64("doc_id", "text")
    share = min(1.0, sample / max(1, sum(counts.values())))
    drawn = docs.withColumn("h", h).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    one = drawn.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fit(soft), "weights binary").first()
    weights = np.frombuffer(one["weights"], np.float32) if one else np.zeros(SLOTS + 1, np.float32)
    out = docs.mapInArrow(_score(weights, soft), "doc_id bigint, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
