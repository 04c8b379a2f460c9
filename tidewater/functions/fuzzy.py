"""String similarity on a scale of 0 to 100, by longest common subsequence.

Functions of single values define the measures. Their batched forms give the same numbers for whole Arrow batches: strings become
matrices of code points, and one numpy step moves all pairs of a batch by one character, the rows of the tables being bits of
64-bit words. The pandas UDFs use these. lcs_expr is the same measure as a Catalyst expression, for short strings and where
Python isn't wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        m = where.get(ch, 0)
        row = (row + (row & m) | row & ~m) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """200 * LCS / (both lengths); two empty strings are alike."""
    if a is None or b is None:
        return 0.0
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str | None, b: str | None) -> float:
    if a is None or b is None:
        return 0.0
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """The best ratio of the common words, and the common words with either's own; 100 if one's words hold the other's."""
    if a is None or b is None:
        return 0.0
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not only_a or not only_b):
        return 100.0
    full_a, full_b = f"{common} {only_a}".strip(), f"{common} {only_b}".strip()
    best = ratio(full_a, full_b)
    return max(best, ratio(common, full_a), ratio(common, full_b)) if common else best


def partial_ratio(a: str | None, b: str | None) -> float:
    """The best ratio of the shorter string with a piece of the longer of at most its length."""
    if a is None or b is None:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    pieces = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, x) for x in pieces)


def name_similarity(a: str | None, b: str | None) -> float:
    """Half word order, three tenths word set, two tenths best piece."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    return 0.5 * token_sort_ratio(a, b) + 0.3 * token_set_ratio(a, b) + 0.2 * partial_ratio(a, b)


#: Words of match tables held at a time, and the longest shorter string that goes through numpy.
TABLE, LONGEST = 2**19, 1_024


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Matrices of the characters of a and of b as numbers below k, padded by k; and k, how many different ones a has and one
    more, which stands for those that a lacks."""
    flat_a, flat_b = (np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    known = np.zeros(int(max(flat_a.max(initial=0), flat_b.max(initial=0))) + 1, bool)
    known[flat_a] = True
    k = int(known.sum()) + 1
    number = np.where(known, np.cumsum(known) - 1, k - 1)
    out = []
    for strings, flat in ((a, flat_a), (b, flat_b)):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        m = np.full((len(strings), int(sizes.max(initial=0))), k, np.int32)
        m[np.arange(m.shape[1]) < sizes[:, None]] = number[flat]
        out.append(m)
    return out[0], out[1], k


def _table(x: np.ndarray, k: int) -> np.ndarray:
    """table[i, c, w]: word w of the places of character c in string i. Padding matches nothing."""
    n, words = len(x), max(1, -(-x.shape[1] // 64))
    table, rows = np.zeros((n, k + 1, words), np.uint64), np.arange(n)
    for j in range(x.shape[1]):
        table[rows, x[:, j], j // 64] |= np.uint64(1 << j % 64)
    table[:, k] = 0
    return table


def _moved(row: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The next row of the tables of LCS lengths: bit i is unset where a table grows at i. Words are the last axis; sums carry
    from word to word."""
    out, carry = np.empty_like(row), None
    for w in range(row.shape[-1]):
        both = row[..., w] & hit[..., w]
        total = row[..., w] + both
        if row.shape[-1] > 1:
            over = total < both
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64)
        out[..., w] = total | (row[..., w] & ~hit[..., w])
    return out


def _lcs_block(a: list[str], b: list[str]) -> np.ndarray:
    x, y, k = _codes(a, b)
    table, rows = _table(x, k), np.arange(len(a))
    row = np.full((len(a), table.shape[2]), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(y.shape[1]):
        row = _moved(row, table[rows, y[:, j]])
    return 64 * table.shape[2] - np.bitwise_count(row).sum(1, dtype=np.int64)


def _sizes(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(len, strings), np.int64, len(strings))


def _blocks(short: np.ndarray, long: np.ndarray, todo: np.ndarray):
    """Runs of todo whose pairs, of these sizes, are alike in size, and small enough for a table."""
    words = -(-short[todo] // 64)
    order = np.lexsort((long[todo], words))
    todo, words, long = todo[order], words[order], long[todo][order]
    at = 0
    while at < len(todo):
        same = int(np.searchsorted(words, words[at], "right"))
        near = at + int(np.searchsorted(long[at:same], 1.3 * long[at] + 8, "right"))
        end = min(near, at + max(64, TABLE // (int(words[at]) * 64)))
        yield todo[at:end]
        at = end


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of each pair."""
    n, m = _sizes(a), _sizes(b)
    turn, short, long = n > m, np.minimum(n, m), np.maximum(n, m)
    out = np.zeros(len(a), np.int64)
    for block in _blocks(short, long, np.flatnonzero(short)):
        each = list(zip(block.tolist(), turn[block].tolist(), strict=True))
        left, right = [b[i] if t else a[i] for i, t in each], [a[i] if t else b[i] for i, t in each]
        out[block] = _lcs_block(left, right) if int(short[block].max()) <= LONGEST else list(map(lcs_length, left, right))
    return out


def _text(values) -> tuple[list[str], np.ndarray]:
    """(strings, which are there)."""
    values = list(values)
    there = np.array([type(x) is str for x in values], bool)
    return values if there.all() else [x if t else "" for x, t in zip(values, there.tolist(), strict=True)], there


def ratios(a, b) -> np.ndarray:
    (x, there), (y, also) = _text(a), _text(b)
    total = (_sizes(x) + _sizes(y)).astype(np.float64)
    out = np.where(total > 0, 200.0 * lcs_lengths(x, y) / np.maximum(total, 1), 100.0)
    return np.where(there & also, out, 0.0)


def _sorted_words(values) -> list[str | None]:
    known = {x: " ".join(sorted(x.split())) if type(x) is str else None for x in set(values)}
    return [known[x] for x in values]


def token_sort_ratios(a, b) -> np.ndarray:
    return ratios(_sorted_words(a), _sorted_words(b))


def token_set_ratios(a, b) -> np.ndarray:
    out, asked, left, right = np.zeros(len(a)), [], [], []
    words = {x: frozenset(x.split()) if type(x) is str else frozenset() for x in {*a, *b}}
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = words[p], words[q]
        if not x or not y:
            continue
        both = x & y
        if not both:
            asked.append(i)
            left.append(" ".join(sorted(x)))
            right.append(" ".join(sorted(y)))
        elif len(both) == len(x) or len(both) == len(y):
            out[i] = 100.0
        else:
            common = " ".join(sorted(both))
            full_a, full_b = f"{common} {' '.join(sorted(x - y))}", f"{common} {' '.join(sorted(y - x))}"
            # the common words begin both, so their ratio with either needs no table
            out[i] = 200.0 * len(common) / (len(common) + min(len(full_a), len(full_b)))
            asked.append(i)
            left.append(full_a)
            right.append(full_b)
    if asked:
        np.maximum.at(out, asked, ratios(left, right))
    return out


def _partial_block(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratios of short strings (64 characters at most) with all pieces of the long ones, all pieces moving at once."""
    x, y, k = _codes(short, long)
    n, m = np.array([len(s) for s in short]), np.array([len(s) for s in long])
    table, width = _table(x, k), x.shape[1]
    rows = np.arange(len(short))[:, None]
    pad = np.full((len(short), width), k, np.int32)
    y = np.hstack([pad, y, pad])
    first = np.arange(1 - width, int(m.max()))[None, :]  # where a piece begins; those of a shorter string begin later
    start, end = np.maximum(first, 0), np.minimum(first + n[:, None], m[:, None])
    size = end - start
    row = np.full((*size.shape, 1), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(width):
        code = np.where(j < n[:, None], y[rows, first + j + width], k)
        row = _moved(row, table[rows, code])
    lcs = 64 - np.bitwise_count(row[..., 0]).astype(np.int64)
    return np.where(size > 0, 200.0 * lcs / np.maximum(n[:, None] + size, 1), 0.0).max(1)


def partial_ratios(a, b) -> np.ndarray:
    (x, there), (y, also) = _text(a), _text(b)
    pairs = [(p, q) if len(p) <= len(q) else (q, p) for p, q in zip(x, y, strict=True)]
    out, todo = np.zeros(len(pairs)), []
    for i in np.flatnonzero(there & also).tolist():
        short, long = pairs[i]
        if not short or short in long:
            out[i] = 100.0 if short or not long else 0.0
        elif len(short) > 64:
            out[i] = partial_ratio(short, long)
        else:
            todo.append(i)
    for block in _blocks(_sizes([p for p, _ in pairs]), _sizes([q for _, q in pairs]), np.array(todo, np.int64)):
        step = max(1, TABLE // (64 + 2 * len(pairs[block[-1]][1])))
        for at in range(0, len(block), step):
            part = block[at : at + step]
            out[part] = _partial_block([pairs[i][0] for i in part.tolist()], [pairs[i][1] for i in part.tolist()])
    return out


def name_similarities(a, b) -> np.ndarray:
    """name_similarity of each pair; a pair that a batch repeats is compared once."""
    keys = [(p, q) if isinstance(p, str) and isinstance(q, str) and p and q else None for p, q in zip(a, b, strict=True)]
    todo = [k for k in dict.fromkeys(keys) if k and k[0] != k[1]]
    x, y = [k[0] for k in todo], [k[1] for k in todo]
    score = 0.5 * token_sort_ratios(x, y) + 0.3 * token_set_ratios(x, y) + 0.2 * partial_ratios(x, y)
    found = dict(zip(todo, score.tolist(), strict=True))
    return np.array([0.0 if k is None else found.get(k, 100.0) for k in keys], np.float64)


def _udf(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(a.tolist(), b.tolist()), dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


ratio_udf, token_sort_udf, token_set_udf, partial_udf, name_udf = map(_udf, (ratios, token_sort_ratios, token_set_ratios, partial_ratios, name_similarities))


@F.pandas_udf(T.StringType())
def sorted_words_udf(a: pd.Series) -> pd.Series:
    return pd.Series(_sorted_words(a.tolist()), dtype=object)


def lcs_expr(a: Column, b: Column) -> Column:
    """LCS length as nested aggregates: for each character of a, the next row of the table over the characters of b."""
    letters = F.split(b, "")
    zeros = F.transform(letters, lambda _: F.lit(0))
    nothing = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("corner"))

    def next_row(row: Column, ch: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            value = F.when(x["l"] == ch, s["corner"] + 1).otherwise(F.greatest(x["up"], s["left"]))
            return F.struct(F.array_append(s["row"], value).alias("row"), value.alias("left"), x["up"].alias("corner"))

        return F.aggregate(F.arrays_zip(row.alias("up"), letters.alias("l")), nothing, step, lambda s: s["row"])

    last = F.aggregate(F.split(a, ""), zeros, next_row)
    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(last, -1))


def ratio_expr(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_expr(a, b) / total)


def token_sort_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_remove(F.split(c, r"\s+"), "")), " ")
