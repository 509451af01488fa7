"""Signature rows: two labels that can score 90 or more share at least one signature key.

Both sides of the join turn each label into rows with a 64-bit `key`; candidates are an equi-join
on it. Families (`kind`), by the way two labels can reach 90 (`v` is 10 or 19, the share of edits
allowed):

    r, t   at most d = (n + m) / v inserts and deletes between the raw labels (r, v = 10) or
           between their sorted tokens (t, v = 19). One side is cut in d + 1 segments; one of
           them must be intact in the other (Pass-Join; Li, Deng, Wang, Feng, VLDB 2011).
    q, u   the same two for an x label longer than LONG: fixed-size chunks at a coarse position.
    s      a shared token (token sets). Tokens are taken rare ones first, by their
           frequencies on both sides, so a token that nearly all labels have is followed by few others.
    a, b   the shorter label (a: the probing one, b: the x one) begins with a text of a
           power-of-two length that the longer label contains.

Segments. Follow the edits of a best alignment from left to right and subtract the number of
segments passed: that starts at 0 or above, ends at -1 or below, and falls by one only across a
segment without edits. So some segment i is intact with exactly i edits left of it and at most
d - i right of it. Its shift then has the parity of i and at most i steps, and both remainders
are again pairs of texts with a known edit bound: the `parts` of a row.

Rows are made only for partner lengths that the other side has, so labels that nothing is near in
length cost few rows.

A key that too many labels of both sides share is refined: its rows are replaced by rows with
longer keys, each again necessary for the pair.

    r, t, d   the shift, every part without edits, and an intact segment of one more part; a row
              whose parts are too short for that becomes family Z
    s         one more shared token, a more frequent one, or none: then either side is (nearly) used
              up (families X and L), or the remaining tokens are within the edit bound (family d)
    q, u      the full r, t keys, as long as these cost less than the pairs
    a, b      the whole shorter label (families A, B)
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yearweave.functions.similarity import sorted_tokens
from yearweave.session import cut_lineage

RAW, TOKENS = 10, 19
LONG = 72
CLASS_STEP = 1.25
#: Tokens whose frequency decides the order of tokens; a list that is fetched, so it is bounded.
FREQUENT = 256
STATE = ["key", "kind", "label", "ord", "parts", "delta", "toks", "used", "at", "id"]
#: Text lengths that are told apart; a list that is fetched, so it is bounded.
MOST = 256
#: Families whose rows name their label by `id`, a hash of it: long labels have many rows.
BY_ID = ("q", "u")
SEGMENT_KINDS = ("r", "t", "d")
FINAL_KINDS = ("X", "L", "A", "B", "Z")
# A text pair still to be aligned: at most `b` edits (exactly `b` if `e`), the probing side longer
# by `g` (null while the shift is open).
PARTS = "array<struct<t: string, b: int, e: boolean, g: int>>"


def rows(df: DataFrame, **columns: Column) -> DataFrame:
    """The fixed row layout; columns that are not named are null."""
    empty = {
        "ord": "long",
        "parts": PARTS,
        "delta": "int",
        "toks": "array<string>",
        "used": "array<string>",
        "at": "int",
        "id": "long",
    }
    out = []
    for c in STATE:
        if c in columns:
            out.append(columns[c].alias(c))
        elif c in ("label", "ord") and c in df.columns:
            out.append(F.col(c))
        else:
            out.append(F.lit(None).cast(empty[c]).alias(c))
    return df.select(*out)


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


class Lengths(NamedTuple):
    """Text lengths that occur on one side; MOST stands for itself and all above it."""

    raw: list[int]
    tokens: list[int]


def text_lengths(labels: DataFrame, x: DataFrame) -> tuple[Lengths, Lengths]:
    """The lengths of both sides' raw labels and sorted tokens: at most MOST + 1 each, whatever the data."""

    def of(df: DataFrame, probe: bool) -> DataFrame:
        n = F.least(F.length("text"), F.lit(MOST)).alias("n")
        return texts(df).select(F.lit(probe).alias("probe"), "kind", n)

    found = of(labels, True).unionAll(of(x, False)).distinct().collect()

    def side(probe: bool) -> Lengths:
        return Lengths(*(sorted(r.n for r in found if (r.probe, r.kind) == (probe, k)) for k in "rt"))

    return side(True), side(False)


def has(lengths: list[int], n: Column) -> Column:
    return F.least(n, F.lit(MOST)).isin(lengths)


def has_between(lengths: list[int], low: Column, high: Column) -> Column:
    low, high = F.least(low, F.lit(MOST)), F.least(high, F.lit(MOST))
    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    return F.exists(known, lambda n: (n >= low) & (n <= high))


def steps(low: Column, high: Column, by: int = 1) -> Column:
    """low..high as rows; no row when the range is empty."""
    low, high = low.cast("int"), high.cast("int")
    return F.explode(F.when(low <= high, F.sequence(low, high, F.lit(by))))


def with_partner_lengths(df: DataFrame, full: Column, probe: bool, partners: Lengths) -> DataFrame:
    """One row per partner length within the edit bound that the other side has, with `bound` (of the
    right parity) and `delta`, by how much the probing side is longer.

    `full` is the length the bound is taken on; the column `v` holds the bound's divisor. The
    partner length runs over all values with |full - other| <= (full + other) / v.
    """
    v = F.col("v")
    df = df.withColumn("_full", full)
    low = F.ceil(F.col("_full") * (v - 1) / (v + 1))
    high = F.floor(F.col("_full") * (v + 1) / (v - 1))
    df = df.withColumn("_other", steps(low, high))
    raw, tokens = (has(lengths, F.col("_other")) for lengths in partners)
    df = df.where(F.when(F.col("kind") == "r", raw).otherwise(tokens))
    both = F.col("_full") + F.col("_other")
    bound = F.floor(both / v).cast("int")
    delta = F.col("_full") - F.col("_other") if probe else F.col("_other") - F.col("_full")
    added = {
        "bound": (bound - F.pmod(both - bound, F.lit(2))).cast("int"),
        "delta": delta.cast("int"),
    }
    return df.withColumns(added).drop("_full", "_other", "v")


def part(t: Column, b: Column, e: Column, g: Column) -> Column:
    return F.struct(
        t.alias("t"), b.cast("int").alias("b"), e.alias("e"), g.cast("int").alias("g")
    )


def shifts(left: Column, right: Column, delta: Column) -> tuple[Column, Column]:
    """First and last shift (in steps of 2) with `left` and `right` edits on either side."""
    low = F.greatest(-left, delta - right)
    high = F.least(left, delta + right)
    return low + F.pmod(left - low, F.lit(2)), high


def segment_rows(df: DataFrame, probe: bool) -> DataFrame:
    """Segment keys of `text`; needs label, ord, kind, parent, parts, text, bound, exact, delta."""
    n = F.length("text") - (F.col("delta") if probe else F.lit(0))
    df = df.withColumn("_n", n).where(F.col("_n") > 0).withColumn("_i", steps(F.lit(0), F.col("bound")))
    i, size = F.col("_i"), F.col("bound") + 1
    begin = F.floor(i * F.col("_n") / size).cast("int")
    end = F.floor((i + 1) * F.col("_n") / size).cast("int")
    df = df.withColumns({"_begin": begin, "_size": end - begin})
    shift = F.lit(None)
    if probe:
        low, high = shifts(i, F.col("bound") - i, F.col("delta"))
        df = df.withColumn("_shift", F.explode(F.when(low <= high, F.sequence(low, high, F.lit(2)))))
        shift = F.col("_shift")
        df = df.withColumn("_begin", F.col("_begin") + shift)
        fits = F.col("_begin") + F.col("_size") <= F.length("text")
        df = df.where((F.col("_begin") >= 0) & fits)
    segment = F.substring("text", F.col("_begin") + 1, F.col("_size"))
    left = F.substring("text", F.lit(1), F.col("_begin"))
    right = F.substring("text", F.col("_begin") + F.col("_size") + 1, F.length("text"))
    sides = F.array(
        part(left, i, F.lit(True), shift),
        part(right, F.col("bound") - i, F.col("exact"), F.col("delta") - shift),
    )
    return rows(
        df,
        key=F.xxhash64("parent", "kind", "_n", "delta", "_i", segment),
        kind=F.col("kind"),
        parts=F.concat("parts", sides).cast(PARTS),
        delta=F.col("delta"),
    )


def unsplit(df: DataFrame, parent: Column) -> DataFrame:
    """The columns of a text that has no matched segment yet."""
    none = F.array().cast(PARTS)
    return df.withColumns({"parent": parent, "parts": none, "exact": F.lit(False)})


def texts(df: DataFrame) -> DataFrame:
    """Every label as the texts that are compared: raw, sorted tokens, sorted distinct tokens.

    `v` is the divisor of the edit bound that goes with the text.
    """
    variants = F.array_distinct(F.array(joined("toks"), joined(F.array_distinct("toks"))))

    def variant(kind: str, v: int, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("v"), text.alias("text"))

    sorted_texts = F.transform(variants, lambda t: variant("t", TOKENS, t))
    raw = F.array(variant("r", RAW, F.col("label")))
    toks = sorted_tokens(F.col("label"))
    each = df.withColumn("toks", toks).select(
        "label", "ord", F.explode(F.concat(raw, sorted_texts)).alias("_t")
    )
    return each.select("label", "ord", "_t.*")


def text_rows(df: DataFrame, probe: bool, max_x: int | None, partners: Lengths) -> DataFrame:
    """Families r and t for x texts of at most `max_x` characters (None: of any length)."""
    out = with_partner_lengths(texts(df), F.length("text"), probe, partners)
    if max_x is not None:
        n = F.length("text") - (F.col("delta") if probe else F.lit(0))
        out = out.where(n <= max_x)
    out = out.where((F.col("kind") == "t") | (F.col("bound") > 0))
    return segment_rows(unsplit(out, F.lit(0).cast("long")), probe)


def long_rows(df: DataFrame, probe: bool) -> DataFrame:
    """Families q and u: chunks of long x texts, at a position known to one edit bound."""
    v, n = F.col("v"), F.col("_n")
    raw = F.col("kind") == "r"
    out = texts(df).withColumn("_n", F.length("text"))
    out = out.withColumn("_size", F.when(raw, 4).otherwise(8))
    if probe:
        low = F.greatest(F.lit(LONG + 1), F.ceil(n * (v - 1) / (v + 1)))
        high = F.floor(n * (v + 1) / (v - 1))
        out = out.where(high >= low)
        out = out.withColumn("_class", steps(length_class(low), length_class(high)))
        out = out.withColumn("at", steps(F.lit(0), n - F.col("_size")))
    else:
        out = out.where(n > LONG).withColumn("_class", length_class(n))
        out = out.withColumn("_chunk", steps(F.lit(0), F.floor(n * 2 / (v - 1))))
        out = out.withColumn("at", F.col("_chunk") * F.col("_size"))
    top = F.lit(LONG) * F.pow(F.lit(CLASS_STEP), F.col("_class") + 1)
    width = F.ceil(top * 2 / (v - 1)).cast("int") + 1
    slot = F.floor(F.col("at") / width).cast("int")
    near = F.explode(F.array(slot - 1, slot, slot + 1)) if probe else slot
    out = out.withColumn("_slot", near).withColumn("kind", F.when(raw, "q").otherwise("u"))
    chunk = F.substring("text", F.col("at") + 1, F.col("_size"))
    return rows(
        out,
        key=F.xxhash64("kind", "_class", "_slot", chunk),
        kind=F.col("kind"),
        label=F.lit(None).cast("string"),
        ord=F.lit(None).cast("long"),
        at=n,
        id=F.xxhash64("label"),
    )


def length_class(n: Column) -> Column:
    return F.floor(F.log(CLASS_STEP, n / F.lit(float(LONG)))).cast("int")


def token_lists(df: DataFrame) -> DataFrame:
    distinct = F.array_distinct(sorted_tokens(F.col("label")))
    return df.select("label", "ord", F.explode(distinct).alias("token"))


def frequent_tokens(labels: DataFrame, x: DataFrame) -> list[tuple[str, int]]:
    """(token, frequency) of the FREQUENT most frequent tokens over the labels of both sides. Any other
    token is in fewer than 1 / FREQUENT of the labels' tokens, so its order does not matter."""
    both = token_lists(labels).unionAll(token_lists(x))
    counts = both.groupBy("token").agg(F.count("*").alias("frequency")).where("frequency > 1")
    found = counts.orderBy(F.desc("frequency"), "token").limit(FREQUENT).collect()
    return [(r.token, r.frequency) for r in found]


def rare_first(df: DataFrame, frequent: list[tuple[str, int]]) -> DataFrame:
    """(label, ord, toks): distinct tokens, those that are not frequent first, then by frequency."""
    toks = F.array_distinct(sorted_tokens(F.col("label")))
    if frequent:
        known = F.map_from_arrays(*(F.array(*[F.lit(v) for v in c]) for c in zip(*frequent)))
        placed = F.transform(toks, lambda t: F.struct(F.coalesce(known[t], F.lit(0)).alias("frequency"), t.alias("token")))
        toks = F.transform(F.sort_array(placed), lambda p: p["token"])
    return df.select("label", "ord", toks.alias("toks"))


def token_rows(df: DataFrame) -> DataFrame:
    each = df.withColumn("_t", F.explode("toks"))
    return rows(
        each,
        key=F.xxhash64(F.lit("s"), "_t"),
        kind=F.lit("s"),
        toks=F.col("toks"),
        used=F.array("_t"),
    )


def prefix_size(n: Column) -> Column:
    """Largest power of two up to n."""
    return F.pow(F.lit(2), F.length(F.bin(n)) - 1).cast("int")


def window_rows(df: DataFrame, probe: bool, partners: Lengths) -> DataFrame:
    """Families a and b. The probing side is the shorter one in a, the x side in b."""
    m = F.length("label")
    shorter, longer = ("a", "b") if probe else ("b", "a")
    size = prefix_size(m)
    as_shorter = rows(
        df.where((m > 0) & has_between(partners.raw, F.ceil(m * 1.5), m * 8)),
        key=F.xxhash64(F.lit(shorter), F.substring("label", F.lit(1), size)),
        kind=F.lit(shorter),
        at=F.lit(-1),
    )
    low, high = F.ceil(m / 8), F.floor(m / 1.5)
    first, last = F.length(F.bin(low)) - 1, F.length(F.bin(high)) - 1
    longer_side = df.where(high >= F.greatest(low, F.lit(1)))
    longer_side = longer_side.withColumn("_power", steps(first, last))
    longer_side = longer_side.withColumn("_size", F.pow(F.lit(2), F.col("_power")).cast("int"))
    least, most = F.greatest(low, F.col("_size")), F.least(high, F.col("_size") * 2 - 1)
    longer_side = longer_side.where(has_between(partners.raw, least, most))
    longer_side = longer_side.withColumn("at", steps(F.lit(0), m - F.col("_size")))
    text = F.substring("label", F.col("at") + 1, F.col("_size"))
    as_longer = rows(
        longer_side,
        key=F.xxhash64(F.lit(longer), text),
        kind=F.lit(longer),
        delta=F.col("_size"),
        at=F.col("at"),
    )
    return as_shorter.unionAll(as_longer)


def first_rows(df: DataFrame, probe: bool, partners: Lengths) -> DataFrame:
    """All signature rows of (label, ord, toks); `partners` are the lengths of the other side."""
    out = text_rows(df, probe, LONG, partners)
    for more in (token_rows(df), window_rows(df, probe, partners), long_rows(df, probe)):
        out = out.unionAll(more)
    return out


def row_weight() -> Column:
    """About how many rows a row becomes when its key is refined."""
    edits = F.array_max(F.transform("parts", lambda p: p.b))
    return (
        F.when(F.col("kind").isin(*SEGMENT_KINDS), F.pow(edits + 2, F.lit(2)) / 2)
        .when(F.col("kind").isin("q", "u"), F.pow(F.col("at") * 2 / (RAW - 1), F.lit(3)) / 2)
        .when(F.col("kind").isin("s", "a", "b"), F.lit(8.0))
        .otherwise(F.lit(1.0))
    )


def refine(df: DataFrame, probe: bool, labels: DataFrame, partners: Lengths) -> DataFrame:
    """Replace rows of over-full keys (none of a final family) by rows with longer keys. `labels` is
    the side's (label, ord), `partners` are the lengths of the other side."""
    out = refine_parts(df.where(F.col("kind").isin(*SEGMENT_KINDS)), probe)
    chunks = df.where(F.col("kind").isin(*BY_ID)).select("id").distinct()
    chunks = labels.withColumn("id", F.xxhash64("label")).join(chunks.hint("merge"), "id").select("label", "ord")
    out = out.unionAll(text_rows(chunks, probe, None, partners))
    out = out.unionAll(refine_tokens(df.where(F.col("kind") == "s"), probe, partners))
    return out.unionAll(refine_windows(df.where(F.col("kind").isin("a", "b")), probe))


def refine_parts(df: DataFrame, probe: bool) -> DataFrame:
    if not probe:
        df = with_shift(df)
    equal = F.filter("parts", lambda p: p.b == 0)
    settled = F.array_join(F.transform(equal, lambda p: p.t), "\x00")
    gaps = F.array_join(F.transform("parts", lambda p: p.g.cast("string")), ",")
    df = df.withColumn("key", F.xxhash64("key", gaps, settled))
    df = df.withColumn("parts", F.filter("parts", lambda p: p.b > 0))

    def room(p: Column, at: Column) -> Column:
        """Length of the x text per segment, if every segment would have a character."""
        n = F.length(p.t) - (p.g if probe else F.lit(0))
        return F.when(n > p.b, F.struct((n / (p.b + 1)).alias("room"), (-at).alias("at")))

    best = F.array_max(F.transform("parts", room))
    # Kept apart from the next step: one plan with both repeats these expressions many times.
    df = cut_lineage(df.withColumn("_next", -best["at"]))
    ended = df.where(F.col("_next").isNull())
    ended = rows(ended, key=F.col("key"), kind=F.lit("Z"), parts=F.col("parts"))
    chosen = F.get("parts", F.col("_next"))
    more = df.where(F.col("_next").isNotNull()).withColumn("_p", chosen)
    more = more.select(
        "label",
        "ord",
        "kind",
        F.xxhash64("key", "_next").alias("parent"),
        F.filter("parts", lambda p, at: at != F.col("_next")).alias("parts"),
        F.col("_p.t").alias("text"),
        F.col("_p.b").alias("bound"),
        F.col("_p.e").alias("exact"),
        F.col("_p.g").alias("delta"),
    )
    return segment_rows(more, probe).unionAll(ended)


def with_shift(df: DataFrame) -> DataFrame:
    """x rows once per possible shift of their last segment, so that its two sides have gaps."""
    left, right = F.element_at("parts", -2), F.element_at("parts", -1)
    low, high = shifts(left["b"], right["b"], F.col("delta"))
    shift = F.explode(F.when(low <= high, F.sequence(low, high, F.lit(2))))
    df = df.withColumn("_shift", shift)
    sides = F.array(
        part(left["t"], left["b"], left["e"], F.col("_shift")),
        part(right["t"], right["b"], right["e"], F.col("delta") - F.col("_shift")),
    )
    closed = F.slice("parts", F.lit(1), F.size("parts") - 2)
    return df.withColumn("parts", F.concat(closed, sides).cast(PARTS))


def refine_tokens(df: DataFrame, probe: bool, partners: Lengths) -> DataFrame:
    place = F.array_position("toks", F.element_at("used", -1)).cast("int")
    more = df.withColumn("_t", F.explode(F.slice("toks", place + 1, F.size("toks"))))
    more = rows(
        more,
        key=F.xxhash64("key", F.lit("s"), "_t"),
        kind=F.lit("s"),
        toks=F.col("toks"),
        used=F.concat("used", F.array("_t")),
    )
    df = df.withColumn("text", joined(F.sort_array(F.array_except("toks", "used"))))
    shared, left = F.length(joined("used")), F.length("text")
    done = (left == 0) | (shared >= 9 * (1 + left))
    own, other = ("L", "X") if probe else ("X", "L")
    ends = []
    for kind, rest in ((own, df.where(done)), (other, df)):
        ends.append(
            rows(
                rest,
                key=F.xxhash64("key", F.lit(kind)),
                kind=F.lit(kind),
                toks=F.col("toks"),
                used=F.col("used"),
            )
        )
    apart = df.where(left > 0).select(
        "label", "ord", "text", "toks", F.lit("d").alias("kind"), F.col("key").alias("_parent")
    )
    apart = apart.withColumn("v", F.lit(TOKENS))
    apart = with_partner_lengths(apart, F.length(joined("toks")), probe, partners)
    apart = unsplit(apart.where(F.col("bound") > 0), F.col("_parent"))
    return more.unionAll(ends[0]).unionAll(ends[1]).unionAll(segment_rows(apart, probe))


def refine_windows(df: DataFrame, probe: bool) -> DataFrame:
    """Whole shorter label: the shorter side hashes itself, the longer side every text of a
    fitting length that starts where the window did."""
    m = F.length("label")
    short = df.where(F.col("at") < 0)
    short = rows(
        short,
        key=F.xxhash64("key", F.col("label")),
        kind=F.upper("kind"),
    )
    longer = df.where(F.col("at") >= 0)
    low = F.greatest(F.col("delta"), F.ceil(m / 8))
    high = F.least(F.col("delta") * 2 - 1, F.floor(m / 1.5), m - F.col("at"))
    longer = longer.withColumn("_size", steps(low, high))
    text = F.substring("label", F.col("at") + 1, F.col("_size"))
    longer = rows(longer, key=F.xxhash64("key", text), kind=F.upper("kind"))
    return short.unionAll(longer)
