"""Name functions: normal form, Jaro-Winkler, token-sort ratio and a lossless bound on both, over Arrow batches or the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    return s.map(plain, na_action="ignore")


def normalize_name(c: Column) -> Column:
    """Accents off, lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(strip_marks(c)), r"\s+", " "))


def jaro_winkler(a: str, b: str) -> float:
    m, n = len(a), len(b)
    if not m or not n:
        return 1.0 if m == n else 0.0
    reach, taken, hits = max(max(m, n) // 2 - 1, 0), [False] * n, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    k, half = len(hits), sum(x != y for x, y in zip(hits, (b[j] for j in range(n) if taken[j]), strict=True)) // 2
    jaro = (k / m + k / n + (k - half) / k) / 3
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, m, n))
    return jaro + 0.1 * start * (1 - jaro) if jaro > 0.7 else jaro


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, one row at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], (left + 1 if x == y else max(row[j], row[j + 1]))
    return row[-1]


def token_sort_ratio(a: str, b: str) -> float:
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all names, padded with -1 to one width, and the names' lengths."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    out = np.full((len(names), max(1, int(size.max(initial=0)))), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<i4")
    return out, size


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler of many pairs, a place of the first names at a time."""
    (x, m), (y, n) = codes(a), codes(b)
    p, rows = len(a), np.arange(len(a))
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)[:, None]
    at = np.arange(y.shape[1])
    taken, used = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        may = (y == x[:, i, None]) & ~taken & (np.abs(at - i) <= reach) & (i < m)[:, None] & (at < n[:, None])
        j = may.argmax(1)
        hit = may[rows, j]
        taken[rows[hit], j[hit]] = used[hit, i] = True
    k = used.sum(1)
    wide = int(k.max(initial=0))
    first = lambda z, on: np.take_along_axis(z, np.argsort(~on, axis=1, kind="stable")[:, :wide], 1)
    apart = ((first(x, used) != first(y, taken)) & (np.arange(wide) < k[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(k > 0, (k / m + k / n + (k - apart) / k) / 3, 0.0)
    w = min(4, x.shape[1], y.shape[1])
    same = (x[:, :w] == y[:, :w]) & (np.arange(w) < np.minimum(m, n)[:, None])
    start = np.logical_and.accumulate(same, axis=1).sum(1) if w else np.zeros(p, int)
    out = np.where(jaro > 0.7, jaro + 0.1 * start * (1 - jaro), jaro)
    return np.where((m == 0) & (n == 0), 1.0, out)


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequences of many pairs: bit-parallel, a place of the second names at a time; long names one by one."""
    out = np.zeros(len(a), np.int64)
    size = np.fromiter(map(len, a), np.int64, len(a))
    for i in np.flatnonzero(size > 63):
        out[i] = common_length(a[i], b[i])
    at = np.flatnonzero(size <= 63)
    if not len(at):
        return out
    (x, m), (y, n) = codes([a[i] for i in at]), codes([b[i] for i in at])
    bit = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
    v = np.full(len(at), ~np.uint64(0))
    for j in range(y.shape[1]):
        mask = ((x == y[:, j, None]) * bit).sum(1, dtype=np.uint64)
        mask[j >= n] = 0
        u = v & mask
        v = (v + u) | (v - u)
    low = (np.uint64(1) << m.astype(np.uint64)) - np.uint64(1)
    out[at] = np.bitwise_count(~v & low)
    return out


def token_sort_pairs(a: list[str], b: list[str]) -> np.ndarray:
    a, b = ([" ".join(sorted(x.split())) for x in xs] for xs in (a, b))
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(total > 0, 2 * common_lengths(a, b) / np.maximum(total, 1), 1.0)


def _pairs(f: Callable[[list[str], list[str]], np.ndarray]):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        at = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        for k in range(0, len(at), 4096):
            own = at[k : k + 4096]
            out[own] = f(a.iloc[own].tolist(), b.iloc[own].tolist())
        return pd.Series(out).where(~np.isnan(out), None).astype("float64")

    return run


jaro_winkler_udf, token_sort_udf = _pairs(jaro_winkler_pairs), _pairs(token_sort_pairs)


def best_of_both(a: list[str], b: list[str]) -> np.ndarray:
    return np.maximum(jaro_winkler_pairs(a, b), token_sort_pairs(a, b))


score_udf = _pairs(best_of_both)


def score_names(a: Column, b: Column) -> Column:
    """The better of both scores of two raw names, in normal form."""
    return score_udf(normalize_name(a), normalize_name(b))


def letter_counts(names: list[str], alphabet: dict[int, int]) -> np.ndarray:
    """How often each letter of the alphabet stands in each name; letters outside it count in the last column."""
    x, size = codes(names)
    width = len(alphabet) + 1
    known = np.array(sorted(alphabet), np.int64)
    place = np.array([alphabet[c] for c in known.tolist()] + [width - 1], np.int64)
    flat = x[np.arange(x.shape[1]) < size[:, None]]
    at = np.searchsorted(known, flat)
    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != flat if len(known) else True)] = len(known)
    row = np.repeat(np.arange(len(names)), size)
    return np.bincount(row * width + place[at], minlength=len(names) * width).reshape(len(names), width).astype(np.float32)


def _bound(shared: np.ndarray, m: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    jaro = np.where(shared > 0, (shared / m + shared / n + 1) / 3, 0)
    jaro = jaro + np.where(jaro > 0.6999, np.float32(0.1) * start * (1 - jaro), 0)
    return np.maximum(jaro, 2 * shared / (m + n)) + np.float32(1e-5)


def _start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common first letters, 4 at most, of padded codes; the pads of both sides differ."""
    return np.logical_and.accumulate(x == y, axis=-1).sum(-1)


def starts(names: list[str], pad: int) -> np.ndarray:
    x = codes(names)[0][:, :4]
    x = np.pad(x, ((0, 0), (0, 4 - x.shape[1])), constant_values=-1)
    return np.where(x < 0, pad, x)


def score_bounds(a: np.ndarray, m: np.ndarray, p: np.ndarray, b: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For all pairs of two blocks of names (letter_counts, lengths, starts): no less than either score. It rules out, and never wrongly."""
    shared = np.zeros((len(a), len(b)), np.float32)
    for c in range(a.shape[1]):
        if a[:, c].any() and b[:, c].any():
            shared += np.minimum(a[:, c, None], b[None, :, c])
    same, start = np.ones(shared.shape, bool), np.zeros(shared.shape, np.float32)
    for k in range(4):
        same &= p[:, k, None] == q[None, :, k]
        start += same
    return _bound(shared, m[:, None].astype(np.float32), n[None, :].astype(np.float32), start)


def pair_bounds(a: list[str], b: list[str]) -> np.ndarray:
    """As score_bounds, for the pairs at equal places."""
    alphabet = {c: i for i, c in enumerate(sorted({ord(c) for x in a for c in set(x)}))}
    shared = np.minimum(letter_counts(a, alphabet), letter_counts(b, alphabet)).sum(1)
    size = lambda xs: np.fromiter(map(len, xs), np.float32, len(xs))
    return _bound(shared, size(a), size(b), _start(starts(a, -1), starts(b, -2)).astype(np.float32))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(c, " "), -1)


def reversed_tokens(c: Column) -> Column:
    return F.array_join(F.reverse(F.split(c, " ")), " ")


def swap_adjacent(c: Column, at: int) -> Column:
    """The characters at `at` and the next one (from 1) change places."""
    return F.when(F.length(c) > at, F.concat(F.substring(c, 1, at - 1), F.substring(c, at + 1, 1), F.substring(c, at, 1), F.substr(c, F.lit(at + 2)))).otherwise(c)


def replace_first(c: Column, what: str, by: str) -> Column:
    at = F.instr(c, what)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(by), F.substr(c, at + len(what)))).otherwise(c)


def replace_at(c: Column, at: Column, by: Column) -> Column:
    """The character at `at` (from 1) replaced."""
    return F.concat(F.substr(c, F.lit(1), at - 1), by, F.substr(c, at + 1))


def title_case(c: Column) -> Column:
    """First letter of each run of letters in upper case: also after digits and apostrophes."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")
