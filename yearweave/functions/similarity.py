"""Label similarity: tokens as Spark expressions, and the score of one pair of labels.

The score is on a 0..100 scale and only exact from 90 upwards, which is all that can match;
anything lower comes back as 0. `r` is the longer length over the shorter, `ratio` is
100 * (1 - indel / (n + m)) with `indel` the insert/delete distance.

    equal, not empty                                 100
    r < 1.5         max(ratio, 0.95 * token score)   if at least 90
    1.5 <= r <= 8   90                               if the shorter is a substring
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Score weights and limits, and the white space that separates tokens.
THRESHOLD = 90.0
TOKEN_WEIGHT = 0.95
SUBSTRING_SCORE = 90.0
NEAR_RATIO = 1.5
FAR_RATIO = 8.0
SPACE = (
    r"[\x09-\x0D\x1C-\x20\x85\xA0"
    r"\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
)


def sorted_tokens(label: Column) -> Column:
    return F.sort_array(F.array_remove(F.split(label, SPACE), ""))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of `a`."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def share(distance: int, total: int) -> float:
    return 100.0 - 100.0 * distance / total if total else 100.0


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return (1.0 - (total - 2 * common_length(a, b)) / total) * 100.0 if total else 100.0


def token_score(a: str, b: str) -> float:
    """Best of: all tokens sorted, and the shared tokens with and without each remainder."""
    ta, tb = sorted(a.split()), sorted(b.split())
    best = ratio(" ".join(ta), " ".join(tb))
    sa, sb = set(ta), set(tb)
    if not sa or not sb:
        return best
    both = " ".join(sorted(sa & sb))
    if both and (sa <= sb or sb <= sa):
        return 100.0
    only_a, only_b = " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    gap = 1 if both else 0
    n, m = len(both) + gap + len(only_a), len(both) + gap + len(only_b)
    distance = len(only_a) + len(only_b) - 2 * common_length(only_a, only_b)
    best = max(best, share(distance, n + m))
    if both:
        best = max(best, *(share(k - len(both), k + len(both)) for k in (n, m)))
    return best


def label_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    low, high = sorted((len(a), len(b)))
    if high < NEAR_RATIO * low:
        score = ratio(a, b)
        if score < TOKEN_WEIGHT * 100.0 and (a.split() != [a] or b.split() != [b]):
            score = max(score, TOKEN_WEIGHT * token_score(a, b))
        return score if score >= THRESHOLD else 0.0
    if high <= FAR_RATIO * low and (a in b or b in a):
        return SUBSTRING_SCORE
    return 0.0


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """`common_length` of many pairs at once. The batch form works on 64-bit words, so texts of 64 or
    more characters (and texts with NUL, which arrays of text cut) go one by one; same result."""
    out = np.zeros(len(a), np.int64)
    whole = [max(len(x), len(y)) < 64 and "\x00" not in x and "\x00" not in y for x, y in zip(a, b)]
    batch = np.flatnonzero(whole)
    if len(batch):
        out[batch] = _short_common_lengths(np.array([a[i] for i in batch]), np.array([b[i] for i in batch]))
    for i in np.flatnonzero(~np.array(whole, bool)):
        out[i] = common_length(a[i], b[i])
    return out


def _short_common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows of `common_length` side by side."""
    n, m = np.char.str_len(a), np.char.str_len(b)
    wide = max(int(n.max()), 1)
    left = a.astype(f"U{wide}").view(np.uint32).reshape(len(a), wide)
    right = b.astype(f"U{max(int(m.max()), 1)}").view(np.uint32).reshape(len(b), -1)
    bits = np.left_shift(np.uint64(1), np.arange(wide, dtype=np.uint64))
    full = np.left_shift(np.uint64(1), n.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for ch in right.T:
        hit = ((left == ch[:, None]) * bits).sum(axis=1, dtype=np.uint64) & row
        row = np.where(ch == 0, row, (row + hit | row - hit) & full)
    return n - np.bitwise_count(row)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """`ratio` of many pairs."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    some = np.maximum(total, 1)
    return np.where(total > 0, (1.0 - (some - 2 * common_lengths(a, b)) / some) * 100.0, 0.0)


def token_scores(a: list[str], b: list[str]) -> np.ndarray:
    """`token_score` of many pairs: three alignments per pair, all of them in batches."""
    ta, tb = [sorted(x.split()) for x in a], [sorted(x.split()) for x in b]
    best = ratios([" ".join(t) for t in ta], [" ".join(t) for t in tb])
    sets = [(set(x), set(y)) for x, y in zip(ta, tb)]
    both = [" ".join(sorted(x & y)) for x, y in sets]
    only_a = [" ".join(sorted(x - y)) for x, y in sets]
    only_b = [" ".join(sorted(y - x)) for x, y in sets]
    common = common_lengths(only_a, only_b)
    for i, (x, y) in enumerate(sets):
        if not x or not y:
            continue
        if both[i] and (x <= y or y <= x):
            best[i] = 100.0
            continue
        gap, k = (1 if both[i] else 0), len(both[i])
        n, m = k + gap + len(only_a[i]), k + gap + len(only_b[i])
        found = [share(len(only_a[i]) + len(only_b[i]) - 2 * int(common[i]), n + m)]
        if both[i]:
            found += [share(z - k, z + k) for z in (n, m)]
        best[i] = max(best[i], *found)
    return best


@F.pandas_udf(T.DoubleType())
def label_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(score_pairs(a.tolist(), b.tolist()))


def score_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """`label_score` of many pairs, aligned in batches."""
    out = np.zeros(len(a))
    near = []
    for i, (x, y) in enumerate(zip(a, b)):
        low, high = sorted((len(x), len(y)))
        if low and x != y and high < NEAR_RATIO * low:
            near.append(i)
        else:
            out[i] = label_score(x, y)  # equal, empty or a matter of containment
    if near:
        left, right = [a[i] for i in near], [b[i] for i in near]
        scores = ratios(left, right)
        several = [x.split() != [x] or y.split() != [y] for x, y in zip(left, right)]
        tokens = np.flatnonzero((scores < TOKEN_WEIGHT * 100.0) & np.array(several))
        if len(tokens):
            found = token_scores([left[i] for i in tokens], [right[i] for i in tokens])
            scores[tokens] = np.maximum(scores[tokens], TOKEN_WEIGHT * found)
        out[near] = np.where(scores >= THRESHOLD, scores, 0.0)
    return out
