"""Secrets in texts, with DataFrame functions only.

Base kinds are patterns: `assign` (a named value), `access` (an access key id) and `hex` (a long run
of hexadecimal digits); each finds its leftmost, non-overlapping matches.

The kind `random` comes from a battery of randomness tests on every run of MIN_RUN or more key
characters: the maximal runs of letters and digits, of these with `+/`, and of these with `-_`, so a
value is tested by itself whatever name, key or path it is glued to. `=` belongs to a run only as
padding at its end. A run's encoding is inferred from the characters used (hexadecimal, base32, base36,
base62, base64, ...). Under the hypothesis "drawn evenly from the encoding's alphabet" three two-sided tests
are made: chi-squared evenness of the alphabet, runs above and below its middle, and serial
correlation of neighbours; the smallest of the three p-values, times three, is the run's p.

False discovery is controlled per length band (powers of two). Benjamini-Hochberg over all runs of
the band gives the p-value t below which a run is ordinary text, with a rate RATE of random runs
among these. A run is a secret when its p is above t and it is long enough for its encoding: ordinary
text of that length would fall below t with a chance of 99 %. p-values are counted in STEPS bins per
power of ten, so the control needs a small aggregate, not a sort of all runs. Decimal numbers and
runs of one case of letters that are too short for that never qualify.

Spans are [start, end) in code points. `random` spans that touch a base span are left out, and so are
those inside a longer `random` span; runs of different alphabets may overlap in part. Null texts
count as empty. Rows are judged alone but for the thresholds, so repeated rows and null ids change
nothing else; tables without runs have no thresholds and no `random` spans. Columns of any name are
carried along.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.session import stage

# The patterns of the base kinds. A value of `assign` has 8 characters, an access key
# 16, a hexadecimal run 32 at least; the latter two are runs of one class, so their patterns say it.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
LEAST_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
#: Up to six `=` that no key character follows.
_PADDING = r"(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
RUNS = tuple(rf"[A-Za-z0-9{more}]{{{MIN_RUN},}}{_PADDING}" for more in ("", "+/", "_-"))
RATE = 0.01
STEPS = 20
#: A normal variable exceeds this with a chance of 1 %.
POWER = 2.33

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order they are tried: pattern, alphabet, and how often two characters of ordinary
#: text in that alphabet are equal (0: never told apart from text).
ENCODINGS = [
    (r"^[0-9]+$", _DIGITS, 0.0),
    (r"^[a-z]+$", _LOWER, 0.065),
    (r"^[A-Z]+$", _UPPER, 0.065),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.15),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.15),
    (r"^[A-Z2-7]+=*$", _UPPER + "234567", 0.07),
    (r"^[0-9a-z]+$", _DIGITS + _LOWER, 0.075),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER, 0.075),
    (r"^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, 0.065),
    (r"^[0-9A-Za-z+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/", 0.065),
    (r"^[0-9A-Za-z_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_", 0.065),
]
_BLOCK = 512
_TINY = 1e-300
REDACTED = "[SECRET]"


def running_sums(steps: Column) -> Column:
    """Running sums of an array of integers. Works in blocks, so the cost is linear in its length."""

    def sums(values: Column, base: Column) -> Column:
        grown = F.aggregate(
            values, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return grown

    zero = F.lit(0).cast("long")
    firsts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(_BLOCK)))
    firsts = F.coalesce(firsts, F.array().cast("array<int>"))
    totals = F.transform(
        firsts, lambda i: F.aggregate(F.slice(steps, i, _BLOCK), zero, lambda a, x: a + x)
    )
    bases = sums(totals, zero)
    parts = F.transform(
        firsts,
        lambda i, j: F.slice(sums(F.slice(steps, i, _BLOCK), F.get(bases, j)), 2, _BLOCK),
    )
    return F.flatten(parts)


def _places(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds `name`: array<struct<start, end, hit>> of all matches of the pattern in column t.

    Texts without a match, nearly all, cost one search.
    """
    hits, gaps, ends, values = (f"{name}_{x}" for x in ("hits", "gaps", "ends", "values"))
    any_hit = F.col("t").rlike(pattern)
    none = F.array().cast("array<string>")
    pat = F.lit(pattern)
    df = df.withColumn(hits, F.when(any_hit, F.regexp_extract_all("t", pat, 0)).otherwise(none))
    found = F.size(hits) > 0
    df = df.withColumn(gaps, F.when(found, F.split("t", pattern, -1)).otherwise(none))
    if group:
        df = df.withColumn(
            values, F.when(found, F.regexp_extract_all("t", pat, F.lit(group))).otherwise(none)
        )
    steps = F.transform(hits, lambda h, i: (F.length(h) + F.length(F.get(gaps, i))).cast("long"))
    df = df.withColumn(ends, running_sums(steps))
    value = F.col(values) if group else F.col(hits)
    spans = F.transform(
        hits,
        lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"),
            F.get(ends, i).alias("end"),
            F.get(value, i).alias("hit"),
        ),
    )
    return df.withColumn(name, spans).drop(hits, gaps, ends, values)


def _tail(z: Column) -> Column:
    """Two-sided normal p-value of |z|, by the cubic logistic approximation."""
    a = F.abs(z)
    a = F.least(a, F.lit(60.0))
    p = F.lit(2.0) / (F.lit(1.0) + F.exp(a * 1.5976 + a * a * a * 0.07056))
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(_TINY))


def _encoding(run: Column) -> Column:
    """Number of the first encoding that fits, from 1; null if none does."""
    out = None
    for i, (pattern, _, _) in enumerate(ENCODINGS, 1):
        here = run.rlike(pattern)
        out = F.when(here, F.lit(i)) if out is None else out.when(here, F.lit(i))
    return out


def _battery(runs: Column) -> Column:
    """array<struct<start, end, band, p, text_p>>: p of the battery, and what text would get."""
    alphabets = F.array(*[F.lit(a) for _, a, _ in ENCODINGS])
    repeats = F.array(*[F.lit(float(r)) for _, _, r in ENCODINGS])
    named = F.transform(
        runs, lambda r: F.struct(r["start"], r["end"], r["hit"].alias("run"), _encoding(r["hit"]).alias("e"))
    )
    named = F.filter(named, lambda r: r["e"].isNotNull() & (F.element_at(repeats, r["e"]) > 0))
    bare = F.transform(
        named,
        lambda r: F.struct(
            r["start"],
            r["end"],
            F.rtrim(r["run"], F.lit("=")).alias("run"),
            F.element_at(alphabets, r["e"]).alias("alphabet"),
            F.element_at(repeats, r["e"]).alias("repeat"),
        ),
    )

    def counts(r: Column) -> Column:
        squares = F.aggregate(
            F.split(r["alphabet"], ""),
            F.lit(0.0),
            lambda a, c: a + F.pow(F.length(r["run"]) - F.length(F.replace(r["run"], c, F.lit(""))), F.lit(2)),
        )
        codes = F.transform(
            F.split(r["run"], ""), lambda c: (F.position(c, r["alphabet"]) - 1).cast("double")
        )
        half = F.length(r["alphabet"]) / 2
        zero = F.lit(0.0)
        start = F.struct(
            F.lit(-1.0).alias("last"),
            zero.alias("high"),
            zero.alias("runs"),
            zero.alias("s"),
            zero.alias("ss"),
            zero.alias("lag"),
        )
        passed = F.aggregate(
            codes,
            start,
            lambda a, c: F.struct(
                c.alias("last"),
                (a["high"] + (c >= half).cast("double")).alias("high"),
                (
                    a["runs"] + ((a["last"] < 0) | ((c >= half) != (a["last"] >= half))).cast("double")
                ).alias("runs"),
                (a["s"] + c).alias("s"),
                (a["ss"] + c * c).alias("ss"),
                (a["lag"] + F.greatest(a["last"], zero) * c).alias("lag"),
            ),
        )
        first = (F.position(F.substring(r["run"], 1, 1), r["alphabet"]) - 1).cast("double")
        return F.struct(
            r["start"],
            r["end"],
            F.length(r["run"]).cast("double").alias("n"),
            F.length(r["alphabet"]).cast("double").alias("k"),
            r["repeat"],
            squares.alias("squares"),
            first.alias("first"),
            passed.alias("c"),
        )

    def tests(r: Column) -> Column:
        n, k, c = r["n"], r["k"], r["c"]
        chi = r["squares"] * k / n - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        expected = 2 * c["high"] * (n - c["high"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(spread > 0, (c["runs"] - expected) / F.sqrt(F.greatest(spread, F.lit(_TINY))))
        mean = c["s"] / n
        variance = c["ss"] - n * mean * mean
        # sum of (x_i - mean)(x_{i+1} - mean) over neighbours
        lag = c["lag"] - mean * (2 * c["s"] - r["first"] - c["last"]) + (n - 1) * mean * mean
        z_lag = F.when(variance > 1e-9, (lag / F.greatest(variance, F.lit(1e-9)) + 1 / n) * F.sqrt(n))
        # a run without spread is as far from random as can be
        far = F.lit(60.0)
        p = F.least(
            _tail(z_chi), _tail(F.coalesce(z_runs, far)), _tail(F.coalesce(z_lag, far))
        )
        text_z = n * (k * r["repeat"] - 1) / F.sqrt(2 * (k - 1))
        return F.struct(
            r["start"],
            r["end"],
            F.floor(F.log2(n)).cast("int").alias("band"),
            F.least(p * 3, F.lit(1.0)).alias("p"),
            _tail(F.greatest(text_z - POWER, F.lit(0.0))).alias("text_p"),
        )

    enough = F.filter(bare, lambda r: F.length(r["run"]) >= MIN_RUN)
    return F.transform(F.transform(enough, counts), tests)


def _thresholds(tested: DataFrame, rate: float) -> dict[int, float]:
    """Per length band the p-value below which a run is ordinary (Benjamini-Hochberg, in bins).

    At most 32 bands, so at most 32 rows come back.
    """
    p = F.explode("tested").alias("r")
    bins = tested.select(p).select("r.band", F.floor(-F.log10("r.p") * STEPS).alias("bin"))
    counts = bins.groupBy("band", "bin").count()
    sums = counts.groupBy("band").agg(
        F.sum("count").alias("m"), F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("bins")
    )
    out = {}
    for row in sums.collect():
        below, t = 0, rate / row["m"]
        for b in reversed(row["bins"]):
            below += b["count"]
            edge = 10.0 ** (-b["bin"] / STEPS)
            if edge <= rate * below / row["m"]:
                t = max(t, edge)
        out[row["band"]] = t
    return out


def _outermost(spans: Column) -> Column:
    """array<struct<start, end>>, sorted: the spans that no other one holds."""
    ordered = F.array_sort(F.transform(spans, lambda r: F.struct(r["start"], (-r["end"]).alias("back"))))
    ordered = F.transform(ordered, lambda r: F.struct(r["start"], (-r["back"]).alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    start = F.struct(F.lit(-1).cast("long").alias("at"), none.alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        kept = F.when(r["end"] > acc["at"], F.concat(acc["kept"], F.array(r))).otherwise(acc["kept"])
        return F.struct(F.greatest(acc["at"], r["end"]).alias("at"), kept.alias("kept"))

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, keep: list[str], rate: float = RATE) -> DataFrame:
    """(row, base, random): a struct of the columns to keep, and the spans found in column text.

    Spans are array<struct<start, kind_no, end>>, sorted; kind_no is the place in KINDS.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    df = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    df = _places(df, "assign", ASSIGN, 2)
    df = _places(df, "access", ACCESS)
    df = _places(df, "hex", HEX)
    for i, pattern in enumerate(RUNS):
        df = _places(df, f"runs_{i}", pattern)
    # a run that is maximal in several alphabets is one run
    runs = F.array_distinct(F.concat(*[F.col(f"runs_{i}") for i in range(len(RUNS))]))

    def tagged(name: str) -> Column:
        spans = F.col(name)
        if name == "assign":
            spans = F.filter(spans, lambda s: F.length(s["hit"]) >= LEAST_VALUE)
        number = F.lit(KINDS.index(name))
        return F.transform(spans, lambda s: F.struct(s["start"], number.alias("kind_no"), s["end"]))

    base = F.array_sort(F.concat(*[tagged(name) for name in KINDS[:3]]))
    df = stage(df.select("row", base.alias("base"), _battery(runs).alias("tested")))
    limits = _thresholds(df, rate)

    def limit(r: Column) -> Column:
        out = F.lit(None).cast("double")
        for band, value in limits.items():
            out = F.when(r["band"] == band, F.lit(value)).otherwise(out)
        return out

    def free(r: Column) -> Column:
        return ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))

    chosen = F.filter("tested", lambda r: (r["p"] > limit(r)) & (r["text_p"] <= limit(r)) & free(r))
    number = F.lit(KINDS.index("random"))
    chosen = _outermost(chosen)
    chosen = F.transform(chosen, lambda r: F.struct(r["start"], number.alias("kind_no"), r["end"]))
    return df.select("row", "base", chosen.alias("random"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """`docs` with every secret in text replaced by a mark; n_chars follows where it exists."""
    found = scan(docs, docs.columns, rate)
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    spans = F.array_sort(F.concat("base", "random"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        grown = F.concat(acc["parts"], F.array(piece, F.lit(REDACTED)))
        parts = F.when(s["start"] >= acc["at"], grown).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def joined(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, start, cut, joined)).otherwise(F.col("row")["text"])
    found = found.select("row", clean.alias("clean"), (F.size(spans) > 0).alias("hit"))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            columns.append(F.col("clean").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            columns.append(F.when(F.col("hit"), F.length("clean").cast(kind)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return found.select(*columns)


def _with_kind(kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter("base", lambda s: s["kind_no"] == number)).cast("long")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, ["doc_id"])
    spans = F.array_sort(F.concat("base", "random"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[_with_kind(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        as_text(spans).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
