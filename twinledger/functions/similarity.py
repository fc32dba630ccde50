"""Similarity of two texts: Jaro-Winkler on characters and BM25 cosine on the two documents themselves."""

from __future__ import annotations

import bisect
import math

import numpy as np

# Fixed values of the two measures.
BOOST_ABOVE, PREFIX_MOST, PREFIX_WEIGHT = 0.7, 4, 0.1
K1, B = 1.2, 0.75
IDF_ONCE, IDF_SHARED = math.log(2.0), math.log(1.2)


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two texts on code points; the common prefix counts only above BOOST_ABOVE. Two empty texts are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, t in zip(b, taken) if t]
    m, swapped = len(matched), sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= BOOST_ABOVE:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a, b)) if i == PREFIX_MOST or x != y), min(PREFIX_MOST, len(a), len(b)))
    return jaro + PREFIX_WEIGHT * min(prefix, PREFIX_MOST) * (1 - jaro)


#: texts up to this length are scored together, longer ones one by one
TOGETHER = 128


def jaro_winkler_many(a: list[str], b: list[str], cells: int = 4_000_000) -> np.ndarray:
    """jaro_winkler of many pairs: those of about one length at once, one step for each character instead of each pair."""
    out = np.zeros(len(a))
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    for i in np.flatnonzero(longest > TOGETHER):
        out[i] = jaro_winkler(a[i], b[i])
    order = np.argsort(longest, kind="stable")
    order = order[longest[order] <= TOGETHER]
    while len(order):
        width = max(1, int(longest[order[0]]))
        n = max(1, cells // (max(8, 2 * width)) ** 2)
        part = order[:n]
        part = part[longest[part] <= max(8, 2 * width)]
        order = order[len(part) :]
        out[part] = _together([a[i] for i in part], [b[i] for i in part])
    return out


def _codes(texts: list[str], width: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one row for each text, filled up with ``none``; and lengths."""
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width).astype(np.int64)
    length = np.array([len(t) for t in texts])
    return np.where(np.arange(width) < length[:, None], flat, none), length


def _together(a: list[str], b: list[str]) -> np.ndarray:
    width = max(1, *(len(t) for t in (*a, *b)))
    (x, la), (y, lb) = _codes(a, width, -1), _codes(b, width, -2)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    taken, matched = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    at, rows = np.arange(width), np.arange(len(a))
    for i in range(width):
        free = (y == x[:, i : i + 1]) & ~taken & (np.abs(at - i) <= reach[:, None])
        first = free.argmax(axis=1)
        hit = free[rows, first]
        taken[rows[hit], first[hit]] = True
        matched[hit, i] = True
    m = matched.sum(axis=1)
    # the matched characters of either side, moved to the front in their order
    p = np.take_along_axis(x, np.argsort(~matched, axis=1, kind="stable"), axis=1)
    q = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable"), axis=1)
    swapped = ((p != q) & (at < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swapped) / m) / 3, 0.0)
    prefix = np.cumprod(x[:, :PREFIX_MOST] == y[:, :PREFIX_MOST], axis=1).sum(axis=1)
    score = np.where(jaro > BOOST_ABOVE, jaro + PREFIX_WEIGHT * prefix * (1 - jaro), jaro)
    return np.where([s == t for s, t in zip(a, b)], 1.0, score)


def best_jaro_winkler(common: int, la: int, lb: int, prefix: int = PREFIX_MOST) -> float:
    """The highest similarity that texts of these lengths can have with so many characters in common, of which so many at most begin both."""
    if not common or not la or not lb:
        return float(la == lb == 0)
    jaro = (common / la + common / lb + 1) / 3
    return min(1.0, jaro + PREFIX_WEIGHT * min(prefix, la, lb, common) * (1 - jaro) if jaro > BOOST_ABOVE else jaro)


def least_common(la: int, lb: int, threshold: float, prefix: int = PREFIX_MOST) -> int:
    """The fewest common characters with which texts of these lengths, of which so many at most begin both, can reach the threshold; more than either
    has if they can't."""
    return bisect.bisect_left(range(min(la, lb) + 1), True, key=lambda o: best_jaro_winkler(o, la, lb, prefix) >= threshold - 1e-12)  # more in common never lowers it


def bm25_weight(tf: float, length: float, mean: float, idf: float) -> float:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25_cosine(a: dict[str, int], b: dict[str, int]) -> float:
    """Cosine of the BM25 weights of two term counts whose collection is the two documents; 0 if they share no term."""
    la, lb = sum(a.values()), sum(b.values())
    mean = max(1.0, (la + lb) / 2)

    def weights(own, length, other):
        return {t: bm25_weight(n, length, mean, IDF_SHARED if t in other else IDF_ONCE) for t, n in own.items()}

    wa, wb = weights(a, la, b), weights(b, lb, a)
    dot = sum(w * wb[t] for t, w in wa.items() if t in wb)
    return dot / math.sqrt(sum(w * w for w in wa.values()) * sum(w * w for w in wb.values())) if dot else 0.0
