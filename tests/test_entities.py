import random

import pytest

from yearweave.functions.similarity import label_score, ratio, ratios, score_pairs
from yearweave.operators.contract import build_matches, contract_columns, matched_rows, unmatched_rows
from yearweave.operators import signatures
from yearweave.operators import similarity_join as join
from yearweave.operators.similarity_join import similarity_join

SCORES = [
    ("Congo, Dem. Rep.", "Congo", 90.0),
    ("Korea, South", "South Korea", 90.8696),
    ("ring small", "small ring", 95.0),
    ("NATION_10", "NATION_1", 94.1176),
    ("NATION_2", "NATION_1", 0.0),
    ("Nigeria", "Niger", 0.0),
    ("a", "a", 100.0),
    ("", "", 0.0),
    ("", "a", 0.0),
    (" ", "\t", 95.0),
    ("ab", "xab" + "x" * 13, 90.0),
    ("ab", "xab" + "x" * 14, 0.0),
    ("rep of the congo", "the rep of congo the", 95.0),
]


@pytest.mark.parametrize("a,b,score", SCORES)
def test_scores(a, b, score):
    assert label_score(a, b) == pytest.approx(score, abs=1e-4)
    assert label_score(b, a) == pytest.approx(score, abs=1e-4)


def test_many_ratios_equal_single_ones():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abé😀") for _ in range(rnd.randint(1, 63))) for _ in range(400)]
    a, b = texts[:200], texts[200:]
    got = ratios(a, b)
    assert got.tolist() == [ratio(x, y) for x, y in zip(a, b)]


def side(spark, labels):
    return spark.createDataFrame([(t, i) for i, t in enumerate(labels)], "label string, ord long")


def brute_force(labels, x):
    out = {}
    for t in labels:
        best, score = None, 0.0
        for c in x:
            s = label_score(t, c)
            if s > score:
                best, score = c, s
        out[t] = (best, score) if score >= 90 else (None, None)
    return out


WORDS = (
    "republic of the congo dem korea south north a bb saint island islands united emirates arab "
    "state states ab ba aab x1 x2 é zz"
).split()


def random_label(rnd):
    kind = rnd.random()
    if kind < 0.15:
        return f"Customer#{rnd.randint(0, 300):09d}"
    n = rnd.randint(12, 26) if kind < 0.2 else rnd.randint(1, 6)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def varied(rnd, s):
    for _ in range(rnd.randint(0, 4)):
        how = rnd.random()
        i = rnd.randint(0, len(s))
        if how < 0.3:
            s = s[:i] + s[i + 1 :]
        elif how < 0.6:
            s = s[:i] + rnd.choice("abc xé") + s[i:]
        elif how < 0.75:
            words = s.split(" ")
            rnd.shuffle(words)
            s = " ".join(words)
        elif how < 0.85:
            s = s + " " + rnd.choice(WORDS)
        else:
            s = s[:i]
    return s


@pytest.mark.parametrize("seed,n,fanout", [(1, 200, 128), (2, 90, 2)])
def test_blocked_join_equals_all_pairs(spark, monkeypatch, seed, n, fanout):
    """The small fan-out makes nearly every shared key over-full, so rows go through refinement to its
    end; keys that stay busy are joined in small cells."""
    monkeypatch.setattr(join, "CELL", 8 if fanout < 10 else join.CELL)
    rnd = random.Random(seed)
    x = list(dict.fromkeys(random_label(rnd) for _ in range(n)))
    labels = list(dict.fromkeys(varied(rnd, rnd.choice(x)) for _ in range(n)))
    got = similarity_join(side(spark, labels), side(spark, x), fanout).collect()
    assert len(got) == len(labels)
    assert {r.label: (r.x_label, r.score) for r in got} == brute_force(labels, x)


@pytest.mark.parametrize("fanout", [1, 8])
def test_one_token_in_all_labels(spark, fanout):
    """The token is the last that is keyed on: what follows it is nothing, so it makes no level of its own."""
    rnd = random.Random(9)
    rare = [f"w{i}" for i in range(40)]
    x = list(dict.fromkeys("the " + " ".join(rnd.sample(rare, rnd.randint(1, 4))) for _ in range(60))) + ["the"]
    labels = list(dict.fromkeys(varied(rnd, rnd.choice(x)) for _ in range(60))) + ["the the", "THE"]
    labels = [t for t in dict.fromkeys(labels) if t]
    got = similarity_join(side(spark, labels), side(spark, x), fanout).collect()
    assert {r.label: (r.x_label, r.score) for r in got} == brute_force(labels, x)


def test_tokens_are_ordered_by_frequency(spark):
    labels = side(spark, ["the big congo", "the big chad", "the peru the", " "])
    counts = join.frequent_tokens(labels, labels)
    got = {r.label: r.toks for r in join.rare_first(labels, counts).collect()}
    assert got == {
        "the big congo": ["congo", "big", "the"],
        "the big chad": ["chad", "big", "the"],
        "the peru the": ["peru", "the"],
        " ": [],
    }


def test_a_very_long_label_changes_nothing_else(spark):
    rnd = random.Random(10)
    x = list(dict.fromkeys(random_label(rnd) for _ in range(60)))
    labels = list(dict.fromkeys(varied(rnd, rnd.choice(x)) for _ in range(60)))
    long_label = " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 999)) for _ in range(1500))[:10_000]
    near = long_label[:4000] + "#" + long_label[4003:9000] + "xy" + long_label[9000:]
    before = similarity_join(side(spark, labels), side(spark, x)).collect()
    after = similarity_join(side(spark, [*labels, near]), side(spark, [*x, long_label])).collect()
    found = {r.label: (r.x_label, r.score) for r in after}
    assert found.pop(near)[0] == long_label
    assert found == {r.label: (r.x_label, r.score) for r in before}


def test_hot_prefix_is_refined(spark):
    """All labels share a long prefix and suffix; only three characters tell them apart."""
    x = [f"Republic of {a}{b}{c} Island" for a in "abcde" for b in "fghij" for c in "klmno"]
    labels = [t.replace("Island", "Islnd") for t in x[::3]] + [t[:-1] for t in x[1::3]] + ["Repu"]
    got = similarity_join(side(spark, labels), side(spark, x), fanout=3).collect()
    assert {r.label: (r.x_label, r.score) for r in got} == brute_force(labels, x)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_conflict_last_and_best(spark):
    x, y = side(spark, ["Congo", "Chad"]), side(spark, ["Congo", "Congo, Dem. Rep.", "Peru"])
    last = build_matches(x, {"data_y": y}, "last")
    assert last.contract.columns == contract_columns("data_x", ["data_y"])
    assert rows(matched_rows(last.contract)) == [
        ("Chad", None, None, None),
        ("Congo", "Congo, Dem. Rep.", "fuzzy", 0.9),
    ]
    assert rows(unmatched_rows(last.contract)) == [(None, "Peru", "unmatched", 0.0)]
    assert rows(last.conflicts) == [
        ("data_y", "Congo", "Congo", "exact", 1.0, "Congo, Dem. Rep."),
    ]
    best = build_matches(x, {"data_y": y}, "best")
    assert ("Congo", "Congo", "exact", 1.0) in rows(best.contract)
    with pytest.raises(ValueError):
        build_matches(x, {"data_y": y}, "first")


def test_dead_source_is_a_typed_null(spark):
    x = side(spark, ["Congo"])
    out = build_matches(x, {"data_y": None, "extra_data_x": x})
    assert out.contract.dtypes[1:4] == [
        ("data_y", "string"),
        ("data_y_match_type", "string"),
        ("data_y_confidence", "double"),
    ]
    assert rows(out.contract) == [("Congo", None, None, None, "Congo", "exact", 1.0)]
    assert rows(build_matches(x, {"data_y": None}).conflicts) == []


def test_close_pairs_are_those_within_one_character_left_out_of_each(spark):
    rnd = random.Random(6)
    labels = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)})
    x = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(60)})

    def near(a):
        return {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))}

    got = {(r.label, r.x_label) for r in join.close_pairs(side(spark, labels), side(spark, x)).collect()}
    assert got == {(a, b) for a in labels for b in x if near(a) & near(b)}


def test_batch_scores_are_those_of_single_pairs():
    rnd = random.Random(8)
    parts = ["rep", "of", "the", "congo", "korea", "south", "a", "ab", "é", "x" * 40, "\x00", "1"]

    def label():
        return rnd.choice([" ", "  ", "\t"]).join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))

    pairs = [(label(), label()) for _ in range(3000)]
    for text, _ in pairs[:500]:
        words = text.split()
        rnd.shuffle(words)
        pairs += [(text, " ".join(words)), (text, text + rnd.choice(["", "s", " x"])), (text, text[1:])]
    got = score_pairs([x for x, _ in pairs], [y for _, y in pairs])
    assert got.tolist() == [label_score(x, y) for x, y in pairs]
    assert sum(got > 0) > 500 and len(score_pairs([], [])) == 0


def stored(spark, tmp_path, name, labels):
    """A side as a file, whose size the planner knows."""
    path = str(tmp_path / name)
    side(spark, labels).write.parquet(path)
    return spark.read.parquet(path)


def test_no_side_is_broadcast(spark, tmp_path):
    """A file of names is small, the rows made from it are not; what the driver holds must not grow with them."""
    x = stored(spark, tmp_path, "x", [f"Customer#{i:09d}" for i in range(200)])
    labels = stored(spark, tmp_path, "y", [f"Customer#{i:08d}" for i in range(200)])
    equal, rest = join.equal_labels(labels, x)
    for df in (equal, rest, join.close_pairs(labels, x), similarity_join(labels, x)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MergeJoin" in plan and "Broadcast" not in plan


def test_x_labels_may_repeat(spark):
    x = spark.createDataFrame(
        [("Congo", 4), ("Chad", 2), ("Congo", 1), ("Chda", 3), ("Congo", 7)], "label string, ord long"
    )
    got = similarity_join(side(spark, ["Congo", "Congoo", "Peru"]), x).select("label", "x_label", "score")
    found = sorted((r.label, r.x_label, r.score and round(r.score, 2)) for r in got.collect())
    assert found == [("Congo", "Congo", 100.0), ("Congoo", "Congo", 90.91), ("Peru", None, None)]


def test_no_rows_for_lengths_the_other_side_does_not_have(spark):
    """Digits alone: only the windows of eight characters can hold one. The longer label: one partner length."""
    x = side(spark, [f"Customer#{i:09d}" for i in range(20)])
    labels = side(spark, [f"{i:09d}" for i in range(10)] + [f"Mr customer#{i:09d}" for i in range(10)])
    lengths, x_lengths = signatures.text_lengths(labels, x)
    assert (lengths, x_lengths) == (([9, 21], [9, 21]), ([18], [18]))
    made = signatures.first_rows(join.rare_first(x, []), False, lengths).groupBy("kind").count()
    assert {r.kind: r["count"] / 20 for r in made.collect()} == {"r": 4, "s": 1, "a": 11}
    got = similarity_join(labels, x).collect()
    names = [r.label for r in x.collect()]
    assert {r.label: (r.x_label, r.score) for r in got} == brute_force([r.label for r in labels.collect()], names)


def test_lengths_beyond_those_told_apart(spark, monkeypatch):
    monkeypatch.setattr(signatures, "MOST", 9)
    rnd = random.Random(12)
    x = list(dict.fromkeys(random_label(rnd) for _ in range(100)))
    labels = list(dict.fromkeys(varied(rnd, rnd.choice(x)) for _ in range(100)))
    got = similarity_join(side(spark, labels), side(spark, x)).collect()
    assert {r.label: (r.x_label, r.score) for r in got} == brute_force(labels, x)
