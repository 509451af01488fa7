"""URL filters: host-suffix and path-prefix rules, matched through short hash prefixes.

Each distinct (host, path) is expanded into expressions host suffix + path prefix, as long as a rule's
parts can be. Expressions and rules meet by an equi-join on the first PREFIX hexadecimal digits of
their SHA-256, the full digest confirms, and the longest rule that fits decides. The verdict is then
joined back to the urls, so a url or host that holds a third of all pages is expanded once.

Hot expressions ("com/") are salted by the url; rules are repeated per salt. Whether the rules are
broadcast is left to the optimizer and its size limit. Which lengths rules have is read first: at most
MAX_RULE distinct numbers each, and longer rules are an error.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?",
"#" or the end. Null urls and urls without "://" have both empty and meet no rule. A rule is
host + path, cut at its first "/"; it fits its host and all subdomains when the path starts with the
rule's path, so a rule "org/" does not fit an empty path. The longest rule string wins; of equally
long ones the longest host, then "block". Where no rule fits, the rule is null and the verdict is
`default`. Rules with a null or without a "/" are ignored, repeated rules count once. Extra columns of
pages are not read; repeated rows and null ids are judged like others.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yearweave.errors import ParameterFailure

PREFIX = 8
SALTS = 8
MAX_RULE = 4096
DEFAULT = "allow"

# The rules of the registered query.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
_AFTER = r"^[^/?#]*"
_PATH = r"^[^/?#]*([^?#]*)"


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower(F.regexp_extract(rest, _AFTER, 0)), F.regexp_extract(rest, _PATH, 1)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _lengths(rules: DataFrame, column: str) -> Column:
    rows = rules.select(F.length(column).alias("n")).distinct().limit(MAX_RULE + 1).collect()
    numbers = sorted(r["n"] for r in rows)
    if numbers and numbers[-1] > MAX_RULE:
        raise ParameterFailure(f"a rule has more than {MAX_RULE} characters in its {column}")
    return F.array(*[F.lit(n) for n in numbers]) if numbers else F.array().cast("array<int>")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, salts: int = SALTS) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row per row of `pages` (page_id and url).

    `rules` has columns rule and verdict ("allow" or "block").
    """
    rules = rules.select("rule", "verdict").where("instr(rule, '/') > 0 and verdict is not null")
    cut = F.locate("/", F.col("rule"))
    rules = rules.select(
        "rule",
        "verdict",
        lower(F.substr("rule", F.lit(1), cut - 1)).alias("rule_host"),
        F.substr("rule", cut).alias("rule_path"),
    )
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))

    hosts, paths = _lengths(rules, "rule_host"), _lengths(rules, "rule_path")
    n = F.length("host")
    # a suffix is the whole host, or what follows a dot
    suffixes = F.filter(
        hosts, lambda k: (k == n) | ((k < n) & (F.substr("host", n - k, F.lit(1)) == "."))
    )
    prefixes = F.filter(paths, lambda k: k <= F.length("path"))
    expanded = (
        urls.select("host", "path")
        .where("host != ''")
        .distinct()
        .withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)))
        .withColumn("suffix", F.explode(F.transform(suffixes, lambda k: F.substr("host", n - k + 1))))
        .withColumn("cut", F.explode(prefixes))
    )
    digest = _digest(F.concat("suffix", F.substr("path", F.lit(1), F.col("cut"))))
    expanded = expanded.select("host", "path", "salt", digest.alias("digest"))
    expanded = expanded.withColumn("short", F.substring("digest", 1, PREFIX))

    order = F.struct(F.length("rule"), F.length("rule_host"), "verdict")
    known = (
        rules.select(_digest(F.concat("rule_host", "rule_path")).alias("rule_digest"), "rule", "verdict", order.alias("rank"))
        .groupBy("rule_digest")
        .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
        .withColumn("short", F.substring("rule_digest", 1, PREFIX))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    )
    fits = expanded.join(known, ["salt", "short"]).where("digest = rule_digest")
    verdicts = fits.groupBy("host", "path").agg(F.max("best").alias("best"))
    return urls.join(verdicts, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, spark.createDataFrame(RULES, "rule string, verdict string"))


_FIT = "(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


def _oracle() -> str:
    ranked = sorted(RULES, key=lambda r: -len(r[0]))
    split = [(r, v, _FIT.format(host=r[: r.index("/")], path=r[r.index("/") :])) for r, v in ranked]
    rule = " ".join(f"when {fit} then '{r}'" for r, _, fit in split)
    verdict = " ".join(f"when {fit} then '{v}'" for _, v, fit in split)
    return f"""
with cut as (
    select page_id, case when position('://' in url) > 0
        then substr(url, position('://' in url) + 3) else '' end as rest
    from pages
), named as (
    select page_id,
        translate(regexp_extract(rest, '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from cut
)
select page_id, host, path, case {rule} end as rule, case {verdict} else '{DEFAULT}' end as verdict
from named
"""


ORACLE = _oracle()
