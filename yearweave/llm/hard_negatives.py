"""Hard negatives: rows of another label whose score lies just below that of a positive.

An anchor's positives are its best rows of the same label. A positive of score p opens the window of
scores from low to high per cent of p, and the negatives are the best rows of other labels inside it.
Both are threshold joins on quantised vectors with exact integer scores.

Rows are dealt to cells of bounded size: for positives by label, hot labels in many parts; for negatives by
hash. A cell meets a block of anchors and searches by falling thresholds (Index.above):

* An inverted index over the cell's dimensions, heaviest last. A row leaves out its leading
  dimensions as long as their norm stays below the threshold per unit of anchor length: what they could add
  alone cannot reach it. Rows left out altogether are not looked at.
* Lists are read from the last dimension down, partial scores accumulate, and a pair is dropped once partial
  score + norm of the anchor's rest * norm of the row's rest is below the anchor's threshold.
* Whatever survives is scored exactly. Anchors whose windows are not full go on with a lower threshold,
  down to the window's lower end.

The first cell of each block is searched alone; its results are lower bounds for all other cells,
where the thresholds therefore end early. Each cell returns at most as many rows per anchor and window
as are wanted, so a group of copies of any size costs a cell its size and no more.

Results for odd input: rows with a null label, a null vector, or a null or non-finite component take no
part, nor do vectors whose quantised squared length reaches 2^62, as their scores need not fit a long.
Vectors of different lengths have no score and do not meet; empty ones score 0. Every row is its own
row, repeated ones included: a copy of an anchor is one of its positives, and an id that occurs twice
among the anchors is an anchor twice. Null ids come last among ties and are anchors only if `anchor` says
so. An empty table gives an empty result. Only vec_id, label and embedding are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yearweave.operators.skew import split_join
from yearweave.session import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
#: Vector components in a cell and in a block of anchors.
CELL = 1 << 20
BLOCK = 1 << 18
#: Partial scores that are held at a time, and pairs that are scored at a time.
SCORES = 1 << 21
PAIRS = 1 << 16
#: Dimensions that are accumulated between two prunings.
STEP = 8
#: A threshold is this share of the one before; below LEAST of the highest score there is none.
FALL = 0.75
LEAST = 0.1
#: Room for rounding in bounds, as a share of the product of the lengths.
SLACK = 1e-9
#: No lower end, no upper end.
BOTTOM, TOP = -(1 << 63), (1 << 63) - 1
_LONGEST = float(1 << 62)
#: Integers below this are exact in double precision.
_EXACT = float(1 << 52)


class Rows:
    """Vectors of whole numbers in the order of (null id last, vec_id, row)."""

    def __init__(self, table: pa.Table):
        known = pa.compute.is_null(table["vec_id"])
        table = table.append_column("_null", known)
        table = table.sort_by([("_null", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
        self.table = table
        self.row = table["row"].to_numpy()
        self.label = table["label"].to_numpy()
        blobs = table["q"].to_pylist()
        n = len(blobs)
        width = table["width"][0].as_py() if n else 0
        ints = np.zeros((n, width), np.int64)
        if width:
            short = np.array([len(b) == 2 * width for b in blobs])
            for kind, mine in ((np.int16, short), (np.int64, ~short)):
                if mine.any():
                    some = b"".join(b for b, m in zip(blobs, mine, strict=True) if m)
                    ints[mine] = np.frombuffer(some, kind).reshape(-1, width)
        self.ints = ints
        self.values = ints.astype(np.float64)

    def order_dimensions(self, order: np.ndarray) -> None:
        self.ints = np.ascontiguousarray(self.ints[:, order])
        self.values = np.ascontiguousarray(self.values[:, order])
        squares = np.cumsum(self.values**2, axis=1)
        self.norms = np.sqrt(np.concatenate([np.zeros((len(squares), 1)), squares], axis=1))
        self.length = self.norms[:, -1]

    def __len__(self) -> int:
        return len(self.row)


class Index:
    """Inverted lists of a cell's rows for thresholds of at least `theta` per unit of anchor length.

    A row is in the lists of dimensions `cut` and up; rows are held by rising cut, so the list of a
    dimension is a leading range of them. Components before a row's cut are zero here.
    """

    def __init__(self, rows: Rows, theta: float):
        self.rows = rows
        # dimensions whose norm together stays below theta; room for rounding, so none too many
        cut = (rows.norms[:, 1:] * (1 + SLACK) < theta).sum(1)
        kept = np.flatnonzero(rows.length * (1 + SLACK) >= theta)
        self.at = kept[np.argsort(cut[kept], kind="stable")]
        self.cut = cut[self.at]
        width = rows.values.shape[1]
        self.values = np.where(np.arange(width) >= self.cut[:, None], rows.values[self.at], 0)

    def above(
        self, anchors: Rows, some: np.ndarray, thresholds: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, exact score) of all pairs of `some` anchors that reach their threshold."""
        q, norms = anchors.values[some], anchors.norms[some]
        rows, width = self.rows, q.shape[1]
        if not len(self.at):
            return (np.zeros(0, np.int64),) * 3
        room = SLACK * norms[:, -1:] * rows.length[self.at] + SLACK
        least = thresholds[:, None] - room
        part = np.zeros((len(some), len(self.at)))
        a = x = None
        for top in range(width, 0, -STEP):
            low = max(0, top - STEP)
            listed = int(np.searchsorted(self.cut, top - 1, "right"))
            if not listed:
                break
            part[:, :listed] += q[:, low:top] @ self.values[:listed, low:top].T
            rest = np.maximum(low, self.cut)
            bound = part + norms[:, rest] * rows.norms[self.at, rest]
            alive = bound >= least
            if np.count_nonzero(alive) * 2 * width < alive.size:
                a, x = np.nonzero(alive)
                break
        if a is None:
            rest = self.cut
            a, x = np.nonzero(part + norms[:, rest] * rows.norms[self.at, rest] >= least)
        x = self.at[x]
        score = self._scores(anchors, some, a, x)
        # ends that are whole numbers are compared as such, exactly
        good = score >= np.where(np.isneginf(thresholds), BOTTOM, thresholds)[a]
        return some[a[good]], x[good], score[good]

    def _scores(self, anchors: Rows, some: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        rows = self.rows
        longest = anchors.length[some].max(initial=0) * rows.length.max(initial=0)
        if longest >= _EXACT:
            left, right, out = anchors.ints, rows.ints, np.zeros(len(a), np.int64)
        else:
            left, right, out = anchors.values, rows.values, np.zeros(len(a))
            if len(a) * 8 > len(some) * len(rows):
                return (left[some] @ right.T)[a, x].astype(np.int64)
        for i in range(0, len(a), PAIRS):
            part = slice(i, i + PAIRS)
            out[part] = np.einsum("ij,ij->i", left[some[a[part]]], right[x[part]])
        return out.astype(np.int64)


class Windows:
    """The windows of a block's anchors that are not yet full."""

    def __init__(self, anchors: Rows):
        lists = [anchors.table[c].combine_chunks() for c in ("ranks", "lows", "highs")]
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False)
        self.anchor = np.repeat(np.arange(len(anchors)), sizes)
        self.rank, self.low, self.high = (x.flatten().to_numpy() for x in lists)

    def keep(self, some: np.ndarray) -> None:
        self.anchor, self.rank, self.low, self.high = (
            x[some] for x in (self.anchor, self.rank, self.low, self.high)
        )


_FOUND = "anchor bigint, rank int, other bigint, vec_id bigint, score bigint"


def search(anchors: Rows, rows: Rows, take: int, same: bool) -> pa.Table:
    """The best `take` rows in each window of the anchors, by falling thresholds.

    `same` wants rows of the anchor's label, itself excepted, otherwise rows of other labels.
    """
    order = np.argsort((rows.values**2).sum(0), kind="stable")
    rows.order_dimensions(order)
    anchors.order_dimensions(order)
    longest = rows.length.max(initial=0)
    highest = anchors.length * longest
    windows = Windows(anchors)
    # no score is above the product of the lengths
    end = np.minimum(windows.high.astype(np.float64), highest[windows.anchor])
    start = np.full(len(anchors), -np.inf)
    np.maximum.at(start, windows.anchor, end)
    threshold = start.copy()
    found: list[tuple[np.ndarray, ...]] = []
    while len(windows.anchor):
        active = np.unique(windows.anchor)
        threshold[active] *= FALL
        none_left = threshold[active] <= LEAST * highest[active]
        threshold[active[none_left]] = -np.inf
        lowest = np.full(len(anchors), np.inf)
        np.minimum.at(lowest, windows.anchor, np.where(windows.low == BOTTOM, -np.inf, windows.low))
        threshold[active] = np.maximum(threshold[active], lowest[active])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(anchors.length[active] > 0, threshold[active] / anchors.length[active], -np.inf)
        index = Index(rows, ratio.min())
        done = np.zeros(len(windows.anchor), bool)
        strip = max(1, SCORES // max(1, len(rows)))
        for i in range(0, len(active), strip):
            some = active[i : i + strip]
            a, x, score = index.above(anchors, some, threshold[some])
            if same:
                fits = rows.row[x] != anchors.row[a]
            else:
                fits = rows.label[x] != anchors.label[a]
            a, x, score = a[fits], x[fits], score[fits]
            by = np.lexsort((x, -score, a))
            a, x, score = a[by], x[by], score[by]
            mine = np.flatnonzero((windows.anchor >= some[0]) & (windows.anchor <= some[-1]))
            begins = np.searchsorted(a, windows.anchor[mine])
            ends = np.searchsorted(a, windows.anchor[mine], "right")
            for w, begin, stop in zip(mine.tolist(), begins.tolist(), ends.tolist(), strict=True):
                first = begin + int(np.searchsorted(-score[begin:stop], -windows.high[w]))
                chosen = slice(first, min(first + take, stop))
                inside = score[chosen] >= windows.low[w]
                full = int(inside.sum()) == take
                if full or threshold[windows.anchor[w]] <= windows.low[w]:
                    done[w] = True
                    n = int(inside.sum())
                    best = x[chosen][:n]
                    at = np.full(n, windows.anchor[w])
                    found.append((at, np.full(n, windows.rank[w]), best, score[chosen][:n]))
        windows.keep(~done)
    empty = (np.zeros(0, np.int64),) * 4
    at, rank, best, score = (np.concatenate(c) for c in zip(empty, *found, strict=True))
    return pa.table(
        {
            "anchor": pa.array(anchors.row[at], pa.int64()),
            "rank": pa.array(rank, pa.int32()),
            "other": pa.array(rows.row[best], pa.int64()),
            "vec_id": rows.table["vec_id"].take(pa.array(best)).combine_chunks(),
            "score": pa.array(score, pa.int64()),
        }
    )


def _cell(take: int, same: bool):
    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401  (pa.compute)

        is_anchor = pa.compute.is_valid(table["ranks"])
        anchors = Rows(table.filter(is_anchor))
        rows = Rows(table.filter(pa.compute.invert(is_anchor)))
        if not len(anchors) or not len(rows):
            return _nothing()
        return search(anchors, rows, take, same)

    return run


def _nothing() -> pa.Table:
    kinds = {"anchor": pa.int64(), "rank": pa.int32(), "other": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    return pa.schema(kinds).empty_table()


_QUANTISED = "row bigint, vec_id bigint, label bigint, is_anchor boolean, width int, q binary"


def _quantise(scale: float):
    """floor(scale * component) of each vector, in two bytes a component where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, widths, blobs = [], [], []
            for i, vector in enumerate(batch["embedding"]):
                values = np.floor(np.array(vector.as_py(), np.float64) * scale)
                with np.errstate(over="ignore"):
                    if not (values * values).sum() < _LONGEST:
                        continue
                kind = np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int64
                kept.append(i)
                widths.append(len(values))
                blobs.append(values.astype(kind).tobytes())
            columns = {c: batch[c].take(pa.array(kept, pa.int64())) for c in ("row", "vec_id", "label", "is_anchor")}
            columns |= {"width": pa.array(widths, pa.int32()), "q": pa.array(blobs, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


_SENT = ["row", "vec_id", "label", "width", "q"]
_LISTS = ["ranks", "lows", "highs"]


def _search_all(
    rows: DataFrame, anchors: DataFrame, keys: list[str], take: int, same: bool, cell: int, block: int
) -> DataFrame:
    """(anchor, rank, other, vec_id, score): the best `take` rows of each anchor and window.

    `anchors` are rows with their windows (ranks, lows, highs). Rows and anchors with equal `keys` meet.
    """
    components = F.greatest("width", F.lit(1))
    parts = F.ceil(F.count("*") * F.max(components) / cell).cast("int")
    blocks = F.ceil(F.count("*") * F.max(components) / block).cast("int")
    shape = rows.groupBy(*keys).agg(parts.alias("parts"))
    shape = shape.join(anchors.groupBy(*keys).agg(blocks.alias("blocks")), keys)
    place = F.xxhash64("row")
    left = split_join(rows.select(*_SENT), shape, keys, spread=["row"])
    left = left.withColumns({name: F.lit(None).cast("array<bigint>") for name in _LISTS})
    left = left.withColumn("part", F.pmod(place, F.col("parts")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = split_join(anchors, shape, keys, spread=["row"])
    right = right.withColumn("block", F.pmod(place, F.col("blocks")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = [*_SENT, *_LISTS, "part", "block"]
    cells = dict.fromkeys([*keys, "part", "block"])

    def run(some_rows: DataFrame, some_anchors: DataFrame) -> DataFrame:
        both = some_rows.select(*columns).unionByName(some_anchors.select(*columns))
        return stage(both.groupBy(*cells).applyInArrow(_cell(take, same), _FOUND))

    first = run(left.where("part = 0"), right.where("part = 0"))
    # the last of a full window is a lower bound for all other cells
    last = first.groupBy(F.col("anchor").alias("row"), "rank").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    last = last.where(F.col("n") == take).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("rank", "last"))).alias("known"))
    right = right.where("part > 0").join(last, "row", "left")
    raised = F.transform(
        F.arrays_zip("ranks", "lows"),
        lambda w: F.greatest(w["lows"], F.element_at("known", w["ranks"].cast("int"))),
    )
    rest = run(left.where("part > 0"), right.withColumn("lows", raised))
    best = Window.partitionBy("anchor", "rank").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    ranked = first.unionByName(rest).withColumn("place", F.row_number().over(best))
    return ranked.where(F.col("place") <= take)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` needs vec_id, label and embedding; `anchor` tells which rows are anchors, from these columns
    (all rows unless given). Scores are inner products of floor(scale * component). For each anchor and each of
    its first `positives` rows of the same label, the first `negatives` rows of other labels whose score
    is from `low` to `high` per cent of the positive's; rank counts them from 1. Higher scores come
    first, ties by smaller vec_id.
    """
    vector = F.col("embedding")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    chosen = F.coalesce(F.lit(True) if anchor is None else anchor, F.lit(False))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        chosen.alias("is_anchor"),
        "embedding",
    ).where(F.col("label").isNotNull() & vector.isNotNull() & ~F.coalesce(odd, F.lit(True)))
    # written with their row numbers, so a row keeps its own whoever reads it
    rows = stage(rows.mapInArrow(_quantise(scale), _QUANTISED))
    anchors = rows.where("is_anchor").select(*_SENT)
    whole = {"ranks": 0, "lows": BOTTOM, "highs": TOP}
    searched = anchors.withColumns({c: F.array(F.lit(v).cast("long")) for c, v in whole.items()})
    best = _search_all(rows, searched, ["width", "label"], positives, True, cell, block)
    best = stage(best.select("anchor", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    share = "cast({0}(cast(positive_score as decimal(20,0)) * {1} / 100) as bigint)"
    ends = best.select(
        F.col("anchor").alias("row"),
        F.col("positive").cast("long").alias("rank"),
        F.expr(share.format("ceil", low)).alias("low"),
        F.expr(share.format("floor", high)).alias("high"),
    ).where("low <= high")
    window = F.sort_array(F.collect_list(F.struct("rank", "low", "high")))
    wanted = ends.groupBy("row").agg(window.alias("w"))
    wanted = wanted.select("row", F.col("w.rank").alias("ranks"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    searched = anchors.join(wanted, "row")
    worst = _search_all(rows, searched, ["width"], negatives, False, cell, block)
    worst = worst.select("anchor", F.col("rank").alias("positive"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        worst.join(best, ["anchor", "positive"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(vectors, anchor=F.col("vec_id") % 100 == 0)


ORACLE = """
WITH vectors AS (
  SELECT row_number() OVER () AS n, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (SELECT n, vec_id, label, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM vectors),
scores AS (
  SELECT a.n AS anchor, b.n AS other, a.vec_id AS anchor_id, b.vec_id AS other_id,
    a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.d = b.d AND a.n <> b.n
  WHERE a.vec_id % 100 = 0
  GROUP BY ALL
),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other_id, s.other) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same
  AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
