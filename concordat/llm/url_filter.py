"""URL rules as one bit-parallel wildcard automaton.

Each (host, path) rule is a glob over the symbols of "." + host + SEP + path: ``*.host SEP path *``, where the first star stays
in the host. All globs lie one after another in multiword masks. Shift-And over the symbols moves every glob's state at once:
a star is a state that keeps itself on the symbols it may eat. URLs of a batch step together, column by column, in numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, map_text, structs

SEP = 256
KIND = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a URL; null or without ``://``: two empty strings."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.partition(c)[0]
    return rest[:cut].translate(ASCII_LOWER), path


class Automaton:
    """rules: (verdict, host, path). ``match`` gives for each URL the index of its longest fitting rule, or -1."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.rules = list(rules)
        self.order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
        globs = [[None, *b"." + h.encode(), SEP, *p.encode()] for _, h, p in rules]  # None: the host's star
        total = sum(len(g) for g in globs)
        self.words = max(1, -(-total // 64))
        step = np.zeros((257, self.words), np.uint64)
        keep = np.zeros((257, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for g in globs:
            for k, symbol in enumerate(g):
                word, bit = at // 64, np.uint64(1 << (at % 64))
                if symbol is None:  # active from the start, kept on every symbol but the separator
                    self.start[word] |= bit
                    keep[:SEP, word] |= bit
                else:
                    step[symbol, word] |= bit
                if k == len(g) - 1:  # the star at the end eats anything
                    keep[:, word] |= bit
                    self.last.append((word, bit))
                at += 1
        self.step, self.keep = step, keep

    def match(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        symbols = [np.concatenate([np.frombuffer(b"." + h.encode("utf-8", "replace"), np.uint8).astype(np.int16), [SEP], np.frombuffer(p.encode("utf-8", "replace"), np.uint8).astype(np.int16)]) for h, p in pairs]
        size = np.asarray([len(s) for s in symbols], np.int64)
        rank = np.argsort(-size, kind="stable")
        flat = np.concatenate([*symbols, np.zeros(0, np.int16)])
        first = (np.cumsum(size) - size)[rank]
        size = size[rank]
        state = np.tile(self.start, (len(pairs), 1))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # URLs longer than t
            c = flat[first[:n] + t]
            s = state[:n]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (s & self.keep[c])
        out = np.full(len(pairs), -1, np.int64)
        for i in reversed(self.order):  # the longest rule writes last
            word, bit = self.last[i]
            out[(state[:, word] & bit) != 0] = i
        back = np.empty_like(out)
        back[rank] = out
        return back


def judge(url: Column, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> Column:
    """struct<host, path, rule, verdict>. A URL that no rule fits has a null rule and the default verdict."""
    machine, names = Automaton(rules), [h + p for _, h, p in rules]

    def run(urls: list):
        pairs = [split_url(u) for u in urls]
        hit = machine.match(pairs).tolist()
        return structs(KIND, host=[h for h, _ in pairs], path=[p for _, p in pairs], rule=[names[i] if i >= 0 else None for i in hit], verdict=[machine.rules[i][0] if i >= 0 else default for i in hit])

    return map_text(run, KIND, url)


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict. Map-only. Null or malformed URLs have empty host and path and get the
    default verdict; ties in rule length go to the rule listed first; repeated rows stay; extra columns are dropped."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col(id_col), judge(F.col(url_col), rules, default).alias("_r")).select(id_col, "_r.*")
