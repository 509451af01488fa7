"""Near-duplicate documents by Order MinHash.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a shingle is five
consecutive words (all words of a shorter text). Shingles are labelled with their occurrence number,
so each is unique in its text. A sketch takes, for each of SKETCHES hash orders, the TAKEN smallest
shingles and keeps them in text order: texts collide where the same shingles come in the same order,
so collisions follow edit similarity. Candidates are verified by a banded alignment of their words:
similarity is the share of the longer text's words that are aligned in order, and 0.8 or more links.
Every pair whose common shingles stand in the same order and reach a Jaccard similarity of 0.8 is
above that.

Equal word sequences are one node from the start, so copies cost one row each. Nodes that share a
sketch are in one family (connected components over "node - smallest node of its sketch", so no
bucket is gathered and no pair is listed). Families are then compared in tiles of bounded rows and
words: a large family is cut into parts, each pair of parts is one tile, small families share one.
In a tile a matrix product of hashed word counts bounds what any pair can have in common from above; only pairs that can reach the threshold and are not yet connected in the tile are aligned. A
tile returns the classes of its families, or, for parts of a large family, a spanning forest of its
links, so a group of copies costs its size in rows, not its square, and no link between two colliding
texts is lost.

A pair is missed if all SKETCHES differ. A sketch is equal with a chance of about J^3, J the Jaccard
similarity of the labelled shingles. At J = 0.8 no pair in a billion is missed. Scattered edits break
five shingles each: with 3 % of the words replaced (J 0.74) one pair in ten million is missed, with
5 % (J 0.6) one in 2,000, with 10 % (J 0.42) one in ten, and pairs at the threshold itself whose edits
are spread evenly are mostly missed.

Results for odd input: texts without a word (null, empty) are linked with nothing. A null doc_id is
judged as a text, but cannot name a class: the class is the smallest id among its other members, or
null. Repeated rows get the same class. Different texts that share an id are judged as what they are:
nodes are texts, not ids, so their classes stay apart even where both bear the name of that id. `kept`
is true for one text of each class, that of the smallest id (of several with this id, the one of the
smallest digest), on each row that repeats it under this id; and for rows without a class.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yearweave.llm.graph import components
from yearweave.llm.words import FOLDED, U64, Words, as_bytes, groups, mix, rolling
from yearweave.session import stage

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 32
TAKEN = 3
#: Rows and words of a tile. They bound the memory of a task, not results.
TILE_ROWS = 4096
TILE_WORDS = 1 << 21
_AT_ONCE = 1 << 20
_STRIP, _SLICE = 512, 2048


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of five words each; one for all the words of a shorter text."""
    if 0 < len(words) < WORDS:
        return rolling(words, len(words)) + U64(len(words))
    return rolling(words, WORDS)


def labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... occurrence of a value apart."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return grams
    at = np.arange(len(grams))
    times = np.empty(len(grams), np.int64)
    times[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(times > 0, mix(grams + times.astype(U64) * U64(0xA24BAED4963EE407)), grams)


def sketches(grams: np.ndarray, count: int = SKETCHES) -> np.ndarray:
    """One key per hash order: the smallest labelled shingles, in text order."""
    unique, taken = labelled(grams), min(TAKEN, len(grams))
    seeds = mix(np.arange(1, count + 1, dtype=U64))
    keys = np.empty(count, U64)
    step = max(1, _AT_ONCE // len(unique))
    for i in range(0, count, step):
        some = seeds[i : i + step, None]
        ranks = (unique[None, :] ^ some) * U64(0xBF58476D1CE4E5B9)
        ranks ^= ranks >> U64(32)
        ranks *= U64(0x94D049BB133111EB)
        low = np.argpartition(ranks, taken - 1, axis=1)[:, :taken]
        low.sort(axis=1)
        key = some[:, 0]
        for j in range(taken):
            key = mix(key * U64(0xD6E8FEB86659FD93) + unique[low[:, j]])
        keys[i : i + step] = key
    return keys


def _digest(text: bytes) -> bytes | None:
    """Of the words; None without any."""
    words = text.translate(FOLDED).split()
    return blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch[0].to_pylist()
        for first, texts in groups(as_bytes(batch[1])):
            words = Words(texts, FOLDED)
            hashes = words.hashes()
            out: dict[str, list] = {"doc_id": [], "digest": [], "n": [], "keys": []}
            for i, text in enumerate(texts):
                n = int(words.counts[i])
                out["doc_id"].append(ids[first + i])
                if not n:
                    for name in ("digest", "n", "keys"):
                        out[name].append(None)
                    continue
                grams = shingles(hashes[words.first[i] : words.first[i] + n])
                out["digest"].append(_digest(text))
                out["n"].append(len(grams))
                out["keys"].append(sketches(grams).view(np.int64))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=list(out))


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in groups(as_bytes(batch[1])):
            words = Words(texts, FOLDED)
            hashes = words.hashes().astype(np.uint32)
            each = [hashes[at : at + n].tobytes() for at, n in zip(words.first, words.counts, strict=True)]
            columns = [pa.array([_digest(x) for x in texts], pa.binary()), pa.array(each, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "words"])


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Most values of `a` and `b` that can be matched in order, at places at most `band` apart.

    One bit per place of `a` inside the band, one step per value of `b` (the bit-parallel form of
    the alignment recurrence). Equal beginnings and ends are matched first.
    """
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    if not short:
        return head
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, list[int]] = {}
    wanted = set(b.tolist())
    for i, x in enumerate(a.tolist()):
        if x in wanted:
            places.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in at) for x, at in places.items() if len(at) > 8}
    width = 2 * band + 1
    full = (1 << width) - 1
    row, low, done = full, 0, 0
    for j, y in enumerate(b.tolist()):
        if j > band:
            done += not row & 1
            row = row >> 1 | 1 << width - 1
            low += 1
        if y in masks:
            hit = masks[y] >> low & full
        else:
            hit = 0
            for i in places.get(y, ()):
                if low <= i < low + width:
                    hit |= 1 << i - low
        if hit:
            both = row & hit
            row = (row + both | row - both) & full
    return head + tail + done + width - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> bool:
    """Words aligned in order reach the share of the longer text's words."""
    longer = max(len(a), len(b))
    needed = int(np.ceil(threshold * longer - 1e-9))
    if min(len(a), len(b)) < needed:
        return False
    return aligned(a, b, len(a) + len(b) - 2 * needed) >= needed


def _counts(labels: list[np.ndarray], bins: int, first: int, many: int) -> np.ndarray:
    """How many of each row's values fall into the bins first .. first + many."""
    sizes = [len(x) for x in labels]
    values = np.concatenate(labels) & np.uint32(bins - 1)
    owner = np.repeat(np.arange(len(labels)), sizes)
    keep = (values >= first) & (values < first + many)
    place = owner[keep] * many + (values[keep].astype(np.int64) - first)
    return np.bincount(place, minlength=len(labels) * many).reshape(-1, many).astype(np.float32)


def forest(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect the same rows as all links do: of one list, or between two.

    Rows are word sequences; results are (row of the first, row of the second list).
    """
    other = left if right is None else right
    # labelled words are unique, so a product of bin counts is never below the common number
    ours = [labelled(x.astype(U64)).astype(np.uint32) for x in left]
    theirs = ours if right is None else [labelled(x.astype(U64)).astype(np.uint32) for x in other]
    na, nb = (np.array([len(x) for x in rows], np.int64) for rows in (left, other))
    bins = 1 << max(10, int(8 * max(na.mean(), nb.mean())).bit_length())
    shift = 0 if right is None else len(left)
    group = np.arange(shift + len(other))
    out = []
    for at in range(0, len(left), _STRIP):
        strip = ours[at : at + _STRIP]
        common = np.zeros((len(strip), len(other)), np.float32)
        for first in range(0, bins, _SLICE):
            many = min(_SLICE, bins - first)
            common += _counts(strip, bins, first, many) @ _counts(theirs, bins, first, many).T
        longer = np.maximum(na[at : at + len(strip), None], nb)
        common = np.minimum(common, np.minimum(na[at : at + len(strip), None], nb))
        maybe = common >= SIMILARITY * longer - 1e-3
        for k in range(len(strip)):
            x = at + k
            if right is None:
                maybe[k, : x + 1] = False
            places = np.flatnonzero(maybe[k] & (group[shift:] != group[x]))
            # likeliest first; what gets connected on the way needs no alignment
            for y in places[np.argsort(-common[k, places] / longer[k, places], kind="stable")].tolist():
                if group[shift + y] != group[x] and similar(left[x], other[y]):
                    out.append((x, y))
                    group[group == group[shift + y]] = group[x]
    return out


def _roots(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(row, smallest row it is connected to) of all linked rows."""
    parent = {x: x for link in links for x in link}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in links:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    return [(x, find(x)) for x in parent]


def _link(table: pa.Table) -> pa.Table:
    """(a, b, whole): of each family that is in one tile the members and their classes, of two parts
    of one the links."""
    table = table.sort_by([("family", "ascending"), ("node", "ascending")])
    family = table["family"].to_numpy()
    node = table["node"].to_numpy()
    second = table["second"].to_numpy().astype(bool)
    words = [np.frombuffer(x.as_py(), np.uint32) for x in table["words"]]
    whole = not table["alone"][0].is_valid
    found: list[tuple[int, int]] = []
    edges = np.flatnonzero(np.diff(family)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(family)], strict=True):
        rows = np.arange(lo, hi)
        one, two = rows[~second[lo:hi]], rows[second[lo:hi]]
        links = forest([words[i] for i in one], [words[i] for i in two] if len(two) else None)
        two = two if len(two) else one
        # rows are in the order of their nodes, so the smallest row is the smallest node
        links = [(int(one[x]), int(two[y])) for x, y in links]
        found += [(int(node[x]), int(node[y])) for x, y in (_roots(links) if whole else links)]
    columns = [pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)]
    return pa.table({"a": columns[0], "b": columns[1], "whole": pa.array([whole] * len(found), pa.bool_())})


def _found(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes. Only texts of members are read again."""
    # a sort-merge join at every size: no list of ids is ever sent to all tasks
    wanted = members.select(F.col("doc_id").alias("member")).distinct().hint("merge")
    texts = docs.join(wanted, F.col("doc_id") == F.col("member"), "left_semi").select("doc_id", "text")
    # the id of a text may be that of other texts too, and of more rows with the same text
    words = texts.mapInArrow(_word_batches, "digest binary, words binary").dropDuplicates(["digest"])
    rows = words.join(members.hint("merge"), "digest").select(
        "node", F.col("component").alias("family"), "words", (F.octet_length("words") / 4).alias("n")
    )
    rows = stage(rows)
    size = F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_WORDS)
    sizes = rows.groupBy("family").agg(F.ceil(size).cast("int").alias("parts"))
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = int(total // TILE_WORDS) + 1
    whole = F.col("parts") <= 1
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = rows.join(sizes, "family").withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1))
    rows = rows.withColumn("other", other)
    tiles = rows.select(
        F.when(~whole, F.col("family")).alias("alone"),
        F.when(whole, F.pmod(F.xxhash64("family"), F.lit(shards))).alias("shard"),
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).alias("second"),
        "family",
        "node",
        "words",
    )
    links = tiles.groupBy("alone", "shard", "i", "j").applyInArrow(_link, "a bigint, b bigint, whole boolean")
    links = stage(links)
    classes_of = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("component"))
    return classes_of.unionByName(components(links.where("not whole"), "a", "b"))


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, class_id, kept), a row per row of `docs` (needs doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stage(
        docs.mapInArrow(_sketch_batches, "doc_id bigint, digest binary, n int, keys array<bigint>")
    )
    named = rows.where("digest is not null and doc_id is not null").groupBy("digest")
    texts = named.agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    # numbers are told once and read from the written table from then on
    nodes = stage(texts.withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select("node", F.explode("keys").alias("key"))
    shared = places.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("size"))
    # exploded keys and well-packed columns are more rows than the optimizer takes them for, so no join
    # of nodes is left to it: none is broadcast
    met = places.join(shared.where("size > 1").hint("merge"), "key")
    members = components(met, "node", "low").hint("merge")
    members = members.join(nodes.select("node", "digest", "doc_id"), "node")
    found = _found(members, docs)
    group = F.coalesce("component", "node")
    grouped = nodes.join(found.hint("merge"), "node", "left").select("digest", "doc_id", group.alias("group"))
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    owner = grouped.join(grouped.groupBy("group").agg(first).hint("merge"), "group").select("digest", "first")
    out = rows.select("doc_id", "digest").join(owner.hint("merge"), "digest", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    return out.select(
        "doc_id",
        "digest",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (F.col("first").isNull() | is_first).alias("kept"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept), a row per row of `docs` (needs doc_id and text)."""
    return _classes(docs).drop("digest")


@F.arrow_udf(T.BinaryType())
def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([_digest(x) for x in as_bytes(texts)], pa.binary())


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, and one for each id of a text without a word. Rows without a doc_id
    stay, since no class can name them."""
    kept = _classes(docs).where("kept and doc_id is not null")
    # no digest is empty, so an empty one can stand for none: with plain keys the texts move once, as the
    # partitions of the join are those of the repeated rows too
    none = F.lit(b"")
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.coalesce("digest", none).alias("_kept_digest"))
    kept = kept.distinct().hint("merge")
    ours = docs.where("doc_id is not null").withColumn("_digest", F.coalesce(_digests("text"), none))
    same = (F.col("doc_id").cast("long") == F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest"))
    ours = ours.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_digest"]).drop("_digest")
    return ours.unionByName(docs.where("doc_id is null"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
