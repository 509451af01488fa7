"""Near-duplicate embeddings: cosine links by int8 tile products with rigorous error bounds.

Vectors are scaled to length one in double precision and quantised to int8: u = s * q + e. The
length of the rest e is known exactly, so |u.v - s_u s_v q_u.q_v| <= |u||e_v| + |e_u||v| + |e_u||e_v|
is a rigorous bound for each pair. A tile product of the quantised vectors leaves only the pairs that may
reach the threshold; of these, pairs that may also miss it are computed again in double precision. So
no link is lost and none is wrong. The product is exact at any width: it is summed in single precision over
EXACT components at a time, where all sums are below 2^24, and these sums are added in double precision.

Equal vectors are one node with a weight. Nodes are dealt to cells around up to PIVOTS vectors, cells are
cut into tiles of about TILE nodes, and a pair of tiles is multiplied unless the angles prove that it
cannot hold a link: angle(pivots) - radius - radius > the threshold's angle. Clustered embeddings
skip nearly all tile pairs; for vectors without any structure all pairs of tiles remain, which is the
method's price. A tile pair returns link counts and a spanning forest of its links, never the links,
so a group of copies costs its size in rows.

Results for odd input: vectors that are null, zero, empty, or hold null or non-finite components link
with nothing, and vectors of different lengths do not link. A null vec_id is counted as a neighbour
but names no component: it gets its component's smallest id (null if it has none). Repeated rows and
ids are each a vector. Only vec_id and embedding are read, so other columns may have any name.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.llm.graph import components
from yearweave.session import stage

THRESHOLD = 0.95
TILE = 4096
PIVOTS = 256
#: Components whose products of int8 values sum to less than 2^24: 127 * 127 * EXACT.
EXACT = 1024
#: Rows of a tile multiplied at a time; bounds memory only.
STRIP = 512
#: Room for rounding in sums of a few thousand doubles; pairs this close are computed again.
SLACK = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Tile:
    """Unit vectors of a tile, quantised, with what bounds the error of their products."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray):
        self.ids, self.weights, self.units = ids, weights, units
        self.scale = np.abs(units).max(axis=1) / 127
        self.q = np.rint(units / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.size = np.linalg.norm(near, axis=1)
        self.rest = np.linalg.norm(units - near, axis=1)

    def links(self, other: "Tile", threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, matrix of links) for strips of this tile against all of the other."""
        theirs = other.q.astype(np.float32).T
        width = len(theirs)
        for at in range(0, len(self.ids), STRIP):
            part = slice(at, at + STRIP)
            ours = self.q[part].astype(np.float32)
            product = np.zeros((len(ours), len(other.ids)))
            for c in range(0, width, EXACT):
                product += ours[:, c : c + EXACT] @ theirs[c : c + EXACT]
            about = product * self.scale[part, None] * other.scale
            size, rest = self.size[part, None], self.rest[part, None]
            bound = size * other.rest + rest * other.size + rest * other.rest + SLACK
            maybe = about + bound >= threshold
            sure = about - bound >= threshold
            a, b = np.nonzero(maybe & ~sure)
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                cosine = np.einsum("ij,ij->i", self.units[at + x], other.units[y])
                sure[x, y] = cosine >= threshold
            yield at, sure


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite link matrix, by breadth-first search over whole rows."""
    rows = np.flatnonzero(links.any(1))
    new_row = np.zeros(links.shape[0], bool)
    new_row[rows] = True
    new_column = links.any(0)
    out = []
    for root in rows.tolist():
        if not new_row[root]:
            continue
        new_row[root] = False
        queue = [(root, True)]
        while queue:
            x, is_row = queue.pop()
            if is_row:
                found = np.flatnonzero(links[x] & new_column)
                new_column[found] = False
                out += [(x, y) for y in found.tolist()]
            else:
                found = np.flatnonzero(links[:, x] & new_row)
                new_row[found] = False
                out += [(y, x) for y in found.tolist()]
            queue += [(y, not is_row) for y in found.tolist()]
    return out


_COUNTED = "node bigint, links bigint, other bigint"


def _tile(table: pa.Table, side: str) -> Tile | None:
    part = table.filter(pa.compute.equal(table["side"], side))
    if not part.num_rows:
        return None
    part = part.sort_by("node")
    units = np.frombuffer(b"".join(part["unit"].to_pylist()), np.float64).reshape(part.num_rows, -1)
    return Tile(part["node"].to_numpy(), part["weight"].to_numpy(), units)


def _multiply(threshold: float):
    """A pair of tiles (or one with itself): rows (node, links, null) and (node, 0, other)."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401  (pa.compute)

        left = _tile(table, "a")
        right = _tile(table, "b")
        alone = right is None
        other = left if alone else right
        counts = np.zeros(len(left.ids), np.int64)
        theirs = np.zeros(len(other.ids), np.int64)
        edges: list[tuple[int, int]] = []
        for at, links in left.links(other, threshold):
            if not links.any():
                continue
            if alone:
                inside = np.arange(len(links))
                links[inside, at + inside] = False
            counts[at : at + len(links)] += links @ other.weights
            if not alone:
                theirs += left.weights[at : at + len(links)] @ links
            edges += [(at + x, y) for x, y in _forest(links)]
        rows = [(left.ids[counts > 0], counts[counts > 0])]
        if not alone:
            rows.append((other.ids[theirs > 0], theirs[theirs > 0]))
        nodes = np.concatenate([r[0] for r in rows])
        links = np.concatenate([r[1] for r in rows])
        x = left.ids[[e[0] for e in edges]] if edges else nodes[:0]
        y = other.ids[[e[1] for e in edges]] if edges else nodes[:0]
        none = pa.nulls(len(nodes), pa.int64())
        return pa.table(
            {
                "node": pa.array(np.concatenate([nodes, x]), pa.int64()),
                "links": pa.array(np.concatenate([links, np.zeros(len(x), np.int64)]), pa.int64()),
                "other": pa.concat_arrays([none, pa.array(y, pa.int64())]),
            }
        )

    return run


def _cells(pivots: np.ndarray):
    """Unit vectors as bytes, the nearest pivot and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch["embedding"][0])
            flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            units = _unit(flat.reshape(-1, width))
            cosines = units @ pivots.T
            cell = cosines.argmax(1)
            angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
            columns = {
                "node": batch["node"],
                "weight": batch["weight"],
                "unit": pa.array([u.tobytes() for u in units], pa.binary()),
                "cell": pa.array(cell, pa.int32()),
                "angle": pa.array(angle, pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _usable(vector: Column) -> Column:
    """All components are finite numbers and one is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.exists(vector, lambda x: x != 0)
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(good, F.lit(False))


def _pairs(cells: DataFrame, centres: np.ndarray, threshold: float, tile: int) -> DataFrame:
    """(a_cell, a_part, b_cell, b_part): the tile pairs that the angles cannot rule out.

    At most PIVOTS rows are fetched and PIVOTS^2 / 2 pairs of cells compared on the driver; the
    tiles of a pair of cells are listed by Spark.
    """
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"))
    found = sorted(sizes.collect(), key=lambda r: r["cell"])
    limit = np.arccos(threshold) + 1e-6
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    rows = [
        (x["cell"], -(-x["n"] // tile), y["cell"], -(-y["n"] // tile))
        for i, x in enumerate(found)
        for y in found[i:]
        if x["cell"] == y["cell"] or between[x["cell"], y["cell"]] - x["r"] - y["r"] <= limit
    ]
    schema = "a_cell int, a_parts int, b_cell int, b_parts int"
    pairs = cells.sparkSession.createDataFrame(rows, schema)
    pairs = pairs.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1)))
    low = F.when(F.col("a_cell") == F.col("b_cell"), F.col("a_part")).otherwise(0)
    return pairs.withColumn("b_part", F.explode(F.sequence(low, F.col("b_parts") - 1))).withColumn(
        "parts", F.col("a_parts")
    )


def _one_width(nodes: DataFrame, width: int, threshold: float, tile: int, pivots: int) -> DataFrame:
    """(node, links, other) of the nodes whose vectors have `width` components."""
    cells_wanted = min(pivots, -(-nodes.count() // tile))  # more would leave tiles unfilled
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(cells_wanted).collect()
    centres = _unit(np.array([r["embedding"] for r in chosen], np.float64).reshape(-1, width))
    cells = stage(
        nodes.mapInArrow(
            _cells(centres), "node bigint, weight bigint, unit binary, cell int, angle double"
        )
    )
    pairs = _pairs(cells, centres, threshold, tile)
    key = ["a_cell", "a_part", "b_cell", "b_part"]
    itself = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_part") == F.col("b_part"))
    sent = [
        some.select(*key, F.col(f"{side}_cell").alias("cell"), F.col(f"{side}_part").alias("part"), F.lit(side).alias("side"))
        for side, some in (("a", pairs), ("b", pairs.where(~itself)))
    ]
    parts = F.col("parts")
    shape = pairs.select(F.col("a_cell").alias("cell"), "parts").distinct()
    placed = cells.join(shape, "cell").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = placed.select("node", "weight", "unit", "cell", "part")
    dealt = dealt.join(sent[0].unionByName(sent[1]), ["cell", "part"]).drop("cell", "part")
    return stage(dealt.groupBy(*key).applyInArrow(_multiply(threshold), _COUNTED))


def linked(
    vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of `vectors` (vec_id and embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = _usable(F.col("embedding"))
    groups = rows.where(usable).groupBy("embedding").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("smallest"), F.size("embedding").alias("width")
    )
    nodes = stage(groups.withColumn("node", F.monotonically_increasing_id()))
    widths = [r["width"] for r in nodes.select("width").distinct().collect()]
    found = None
    for width in sorted(widths):
        some = nodes.where(F.col("width") == width).select("node", "weight", "embedding")
        part = _one_width(some, width, threshold, tile, pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], _COUNTED)
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null"), "node", "other")
    named = (
        nodes.join(joined, "node", "left")
        .join(counts, "node", "left")
        .select("embedding", "weight", "smallest", "links", F.coalesce("component", "node").alias("c"))
    )
    smallest = named.groupBy("c").agg(F.min("smallest").alias("component_id"))
    named = named.join(smallest, "c").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        "component_id",
    )
    out = rows.join(named, rows["embedding"] == named["embedding"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
