"""Arrow kernels for what Catalyst has no expression for. Plain functions, wrapped as vectorised UDFs."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

#: Pairs that a task holds at once.
AT_ONCE = 1 << 17


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / (len(a) + len(b)), by the longest common subsequence in bit vectors."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = where.get(c, 0)
        u = s & m
        s = ((s + u) | (s - u)) & full
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """The largest indel ratio among the shared words and the shared words with either side's others; one side's words
    within the other's give 1; a side without words gives 0."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
    best = indel_ratio(left, right)
    return max(best, indel_ratio(both, left), indel_ratio(both, right)) if both else best


class Texts:
    """Token sets of texts over one vocabulary, of words in order, as bits; words that all texts share are left out and only measured."""

    def __init__(self, sets: list[set[str]], words: list[str], shared: set[str]):
        place = {w: k for k, w in enumerate(words)}
        self.held = np.zeros((len(sets), 64 * max(1, -(-len(words) // 64))), np.uint8)
        for k, own in enumerate(sets):
            self.held[k, [place[w] for w in own - shared]] = 1
        self.bits = np.packbits(self.held, axis=1, bitorder="little").view("<u8")
        self.letters = np.asarray([sum(map(len, own)) for own in sets], np.int64)
        self.count = np.asarray([len(own) for own in sets], np.int64)


def lcs_of(a: list[str], i: np.ndarray, b: list[str], j: np.ndarray) -> np.ndarray:
    """Longest common subsequences of a[i] and b[j], pair by pair, in bit vectors of all pairs at once; of two texts the one in bits has 64
    letters at most, and pairs of longer ones go one by one."""
    out = np.zeros(len(i), np.int64)
    la, lb = (np.asarray([len(t) for t in x], np.int64) for x in (a, b))
    first = la[i] <= 64
    second = ~first & (lb[j] <= 64)
    for live, x, p, y, q, size in ((first, a, i, b, j, la), (second, b, j, a, i, lb)):
        if not live.any():
            continue
        p, q = p[live], q[live]
        letters = {c: k + 1 for k, c in enumerate(sorted(set("".join(y))))}  # 0 follows the end of a text and is in none
        mask = np.zeros((len(x), len(letters) + 1), np.uint64)
        for k, text in enumerate(x):
            for n, c in enumerate(text[:64]):
                if c in letters:
                    mask[k, letters[c]] |= np.uint64(1 << n)
        columns_end = np.asarray([len(t) for t in y])
        columns = np.zeros((columns_end.max(), len(y)), np.int64)
        for k, text in enumerate(y):
            columns[: len(text), k] = [letters[c] for c in text]
        if len(x) * len(y) <= 4 * len(p):  # pairs repeat, or are nearly all that there can be: every two texts once, row by row
            s = np.full((len(y), len(x)), ~np.uint64(0))
            table = np.ascontiguousarray(mask.T)
            for at in range(0, len(y), 64):
                few, end = s[at : at + 64], int(columns_end[at : at + 64].max())
                for column in columns[:end, at : at + 64]:
                    u = few & table[column]
                    few[:] = (few + u) | (few - u)
            s = s[q, p]
        else:
            flat, start, s = mask.ravel(), p * mask.shape[1], np.full(len(p), ~np.uint64(0))
            for column in columns:
                u = s & flat[start + column[q]]
                s = (s + u) | (s - u)
        n = size[p].astype(np.uint64)
        full = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))
        out[live] = np.bitwise_count(~s & full)
    for k in np.flatnonzero(~first & ~second):
        x, y = a[i[k]], b[j[k]]
        out[k] = round(indel_ratio(x, y) * (len(x) + len(y)) / 2)
    return out


def token_set_ratios(x: list[str | None], y: list[str | None], half: bool = False) -> Iterator[np.ndarray]:
    """token_set_ratio of each text of x with all of y, a few rows of the matrix at a time; half (x is y): with those from the first of
    these rows on. What two texts have beyond their shared words comes again and again among texts of one key, so each such rest is spelled once."""
    sets = [set((t or "").split()) for t in (*x, *y)]
    shared = set.intersection(*sets) if sets else set()
    words = sorted(set().union(*sets) - shared)
    left, right = Texts(sets[: len(x)], words, shared), Texts(sets[len(x) :], words, shared)
    weight = np.asarray([len(w) for w in words] + [0] * (left.held.shape[1] - len(words)), np.float64)
    theirs, their_letters = right.held.T.astype(np.float64), (right.held * weight).T
    extra = sum(map(len, shared))
    lo = 0
    while lo < len(x):
        skip = lo if half else 0
        wide = len(y) - skip
        hi = min(len(x), lo + max(1, AT_ONCE // max(1, wide)))
        held = left.held[lo:hi].astype(np.float64)
        common = (held @ theirs[:, skip:]).astype(np.int64).ravel() + len(shared)
        letters = (held @ their_letters[:, skip:]).astype(np.int64).ravel() + extra
        rests = []
        for mine, other in ((left.bits[lo:hi, None, :], right.bits[None, skip:, :]), (right.bits[None, skip:, :], left.bits[lo:hi, None, :])):
            code = np.zeros(common.size, np.int64)
            for k in range(mine.shape[2]):
                part, found = pd.factorize((mine[:, :, k] & ~other[:, :, k]).ravel())
                code = part if k == 0 else pd.factorize(code * len(found) + part)[0]
            kinds = np.zeros(code.max(initial=-1) + 1, np.int64)
            kinds[code] = np.arange(len(code))  # a pair of each kind
            i, j = np.divmod(kinds, max(1, wide))
            bits = left.held[lo + i] & ~right.held[skip + j] if not rests else right.held[skip + j] & ~left.held[lo + i]
            rests.append((code, [" ".join(words[w] for w in np.flatnonzero(row)) for row in bits]))
        (i, a), (j, b) = rests
        both = letters + np.maximum(common - 1, 0)
        mine, other = np.repeat(left.count[lo:hi], wide), np.tile(right.count[skip:], hi - lo)
        one = np.repeat(left.letters[lo:hi] + left.count[lo:hi] - 1, wide)
        two = np.tile(right.letters[skip:] + right.count[skip:] - 1, hi - lo)
        out = np.zeros(len(i))
        inside = (common > 0) & ((common == mine) | (common == other))
        out[inside] = 1.0
        apart = np.flatnonzero(~inside & (mine > 0) & (other > 0))
        one, two, both, joint = one[apart], two[apart], both[apart], common[apart] > 0
        best = 2 * (np.where(joint, both + 1, 0) + lcs_of(a, i[apart], b, j[apart])) / (one + two)
        out[apart] = np.where(joint, np.maximum(best, 2 * both / (both + np.minimum(one, two))), best)  # less joins the shorter one
        yield out.reshape(hi - lo, wide)
        lo = hi


def told_apart(rows: pa.StructArray, column: str) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct values, ids, which value each id has) of a block of row groups."""
    ids, values = rows.field("ids"), rows.field(column).dictionary_encode()
    codes = values.indices.to_numpy(zero_copy_only=False) if not values.null_count else values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False)
    return [*values.dictionary.to_pylist(), *([None] if values.null_count else [])], ids.flatten().to_numpy(), np.repeat(codes.astype(np.int64), ids.value_lengths().to_numpy())


def token_jaccards(x: list[str], y: list[str], half: bool = False) -> Iterator[np.ndarray]:
    """Shared over all words, between single spaces, of each text of x with all of y, in the way of token_set_ratios. Texts are not null."""
    sets = [set(t.split(" ")) for t in (*x, *y)]
    words = sorted(set().union(*sets))
    left, right = Texts(sets[: len(x)], words, set()), Texts(sets[len(x) :], words, set())
    theirs, lo = right.held.T.astype(np.float32), 0
    while lo < len(x):
        skip = lo if half else 0
        hi = min(len(x), lo + max(1, AT_ONCE // max(1, len(y) - skip)))
        common = (left.held[lo:hi].astype(np.float32) @ theirs[:, skip:]).astype(np.float64)
        yield common / (left.count[lo:hi, None] + right.count[None, skip:] - common)
        lo = hi


def similar_blocks(name: str, likeness: Callable[[list, list, bool], Iterator[np.ndarray]]):
    """For mapInArrow over (alike, rows_a, rows_b) of blocking.met_blocks with a text: (item_a, item_b, likeness) of every pair, the smaller id
    first. likeness: token_set_ratios or another function of its kind, the same both ways round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                alike = batch.column("alike")[k].as_py()
                x, ids, own = in_order(batch.column("rows_a")[k].values)
                y, others, their = (x, ids, own) if alike else in_order(batch.column("rows_b")[k].values)
                lo = 0
                for ratios in likeness(x, y, alike):
                    start, end = np.searchsorted(own, (lo, lo + len(ratios)))
                    skip, first = (lo, start) if alike else (0, 0)
                    step = max(1, AT_ONCE // max(1, len(others) - first))
                    for at in range(start, end, step):
                        mine, few = own[at : min(end, at + step), None], ids[at : min(end, at + step), None]
                        s = ratios[mine - lo, their[None, first:] - skip]
                        a, b = np.minimum(few, others[None, first:]), np.maximum(few, others[None, first:])
                        if alike:  # of one text each pair once, of two the one way round that is here
                            live = (mine < their[None, first:]) | ((mine == their[None, first:]) & (few < others[None, first:]))
                            a, b, s = a[live], b[live], s[live]
                        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(s.ravel())], names=["item_a", "item_b", name])
                    lo += len(ratios)

    def in_order(rows: pa.StructArray) -> tuple[list, np.ndarray, np.ndarray]:
        values, ids, own = told_apart(rows, "text")
        order = np.argsort(own, kind="stable")
        return values, ids[order], own[order]

    return run


def transliterate(text: str | None) -> str:
    """Compatibility form with Latin accents off; marks of other scripts, which are letters there, stay."""
    out = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text or ""))
    return unicodedata.normalize("NFC", "".join(c for c in out if not "\u0300" <= c <= "\u036f"))


def partial_ratio(a: str, b: str) -> float:
    """The largest indel ratio of the shorter text with any window of its length in the longer, windows cut by its ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    return max(indel_ratio(a, b[max(0, k) : k + len(a)]) for k in range(1 - len(a), len(b)))


def best_match(word: str, choices: list[str], least: float = 0.0) -> tuple[str, float] | None:
    """The choice of highest ratio, of equals the first; None below ``least``."""
    scored = [(indel_ratio(word, c), -k) for k, c in enumerate(choices)]
    best = max(scored, default=(0.0, 0))
    return (choices[-best[1]], best[0]) if choices and best[0] >= least else None


def jaro(a: str, b: str) -> float:
    """Shared letters within half the longer length, less half of those out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    turned = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - turned) / m) / 3


def jaro_winkler(a: str | None, b: str | None, weight: float = 0.1) -> float:
    """jaro(), raised by up to four shared first letters where it exceeds 0.7."""
    a, b = a or "", b or ""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + same * weight * (1 - s)


def bloom_positions(features: list[str], key: bytes, bits: int = 512, hashes: int = 30) -> list[int]:
    """Set bit numbers of a keyed Bloom filter by double hashing: place k is start + k * step, both from one HMAC-SHA256. Two
    parties' filters can be compared only if every bit agrees, so halves, byte order and the odd step are fixed values."""
    found: set[int] = set()
    for f in features:
        d = hmac.new(key, f.encode(), hashlib.sha256).digest()
        h, step = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:16], "big") | 1
        found.update((h + i * step) % bits for i in range(hashes))
    return sorted(found)


def similarity(a, b):
    """token_set_ratio, which is the same both ways round. Texts of one key meet in one task, where the same two come again and again."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        seen = lru_cache(1 << 16)(token_set_ratio)
        for x, y in parts:
            yield pd.Series([seen(u, v) if (u or "") <= (v or "") else seen(v, u) for u, v in zip(x, y, strict=True)])

    return run(a, b)


def jaro_winkler_of(a, b):
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([jaro_winkler(u, v) for u, v in zip(x, y, strict=True)])

    return run(a, b)


def pseudonym(value, key: bytes):
    """The first 16 hex digits of an HMAC-SHA256; null stays null."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:16])

    return run(value)


def dice(a, b):
    """Dice of two arrays of set bits: twice the shared over all; 0 where both are empty."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def filter_bytes(features, key: bytes, bits: int = 512, hashes: int = 30):
    """The filters of an array<string> column as bits / 8 bytes; null as empty."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = lru_cache(1 << 16)(lambda f: bloom_positions([f], key, bits, hashes))  # words come again
        for x in parts:
            held = np.zeros((len(x), bits), bool)
            for k, own in enumerate(x):
                for f in own if own is not None else []:
                    held[k, seen(f)] = True
            yield pd.Series([row.tobytes() for row in np.packbits(held, axis=1)], dtype=object)

    return run(features)


def overlaps(x: list[bytes], y: list[bytes], tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, Dice) of filters of one width whose Dice is 0.75 or more, all of x against all of y: matrix products, a tile at a time."""

    def unpacked(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(np.frombuffer(b"".join(filters), np.uint8).reshape(len(filters), -1), axis=1).astype(np.float32)
        return bits, bits.sum(1)  # whole numbers, and eighths of them, are exact

    for at in range(0, len(y), tile):
        b, nb = unpacked(y[at : at + tile])
        for lo in range(0, len(x), tile):
            a, na = unpacked(x[lo : lo + tile])
            shared = a @ b.T
            i, j = np.divmod(np.flatnonzero(shared - 0.375 * nb[None, :] >= 0.375 * na[:, None]), len(b))
            live = shared[i, j] > 0
            i, j = i[live], j[live]
            if len(i):
                yield lo + i, at + j, 2 * shared[i, j].astype(np.float64) / (na[i] + nb[j])


def alike_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (rows_a, rows_b) of blocking.met_blocks with filters (bits): (item_a, item_b, dice) of every pair of 0.75 or more."""
    for batch in batches:
        for k in range(len(batch)):
            x, ids, own = told_apart(batch.column("rows_a")[k].values, "bits")
            y, others, their = told_apart(batch.column("rows_b")[k].values, "bits")
            (of_a, start_a, n_a), (of_b, start_b, n_b) = (members(i, c, len(v)) for i, c, v in ((ids, own, x), (others, their, y)))
            for i, j, dice in overlaps(x, y):
                sizes = n_a[i] * n_b[j]
                ends = np.cumsum(sizes)
                for cut in np.split(np.arange(len(i)), np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE))):
                    if len(cut):
                        pair = np.repeat(cut, sizes[cut])
                        place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes[cut]) - sizes[cut], sizes[cut])
                        p, q = np.divmod(place, n_b[j[pair]])
                        yield pa.RecordBatch.from_arrays([pa.array(of_a[start_a[i[pair]] + p]), pa.array(of_b[start_b[j[pair]] + q]), pa.array(dice[pair])], names=["item_a", "item_b", "dice"])


def members(ids: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids by code, where each code starts, how many it has)."""
    count = np.bincount(codes, minlength=n)
    return ids[np.argsort(codes, kind="stable")], np.cumsum(count) - count, count


def bloom(features, key: bytes, bits: int = 512, hashes: int = 30):
    """Sorted positions of the set bits of an array<string> column; null as empty."""

    @F.pandas_udf("array<int>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda f: bloom_positions(list(f) if f is not None else [], key, bits, hashes))

    return run(features)
