"""Language identification with hyperdimensional profiles.

Every letter (and the word gap) has a random vector of +1 and -1, fixed by its code point and a seed. An n-gram's vector binds
its letters: the vector of the k-th letter is rotated n-1-k places and all are multiplied. A text's vector bundles (adds) its
n-grams' vectors; a language's prototype bundles the texts that carry its label. A text goes to the prototype of the largest
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, kept_state, map_text, structs, table_batch, tidy

DIMS, GRAM, SEED = 1024, 3, 4
#: n-gram vectors that a worker remembers (1 KB each); others are made again each time.
REMEMBERED = 60_000
UNKNOWN = "und"
#: Labels that a model may have; each is 8 KB in every task.
LABELS = 4096
KIND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to 0, the word gap."""
    return np.asarray([i if not 0xD800 <= i < 0xE000 and chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams of a text, packed 21 bits a letter, and their counts; None without letters. Works by slices."""
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    tail = np.zeros(1, np.int64)
    any_letter = False
    size = 1 << 20
    for k in range(0, max(len(text), 1), size):
        part = text[k : k + size].lower().encode("utf-32-le", "surrogatepass")
        s = letters()[np.frombuffer(part, "<u4")]
        any_letter = any_letter or bool(s.any())
        s = np.concatenate([tail, s, np.zeros(1 if k + size >= len(text) else 0, np.int64)])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one gap between words
        code = np.zeros(max(0, len(s) - GRAM + 1), np.int64)
        for j in range(GRAM):
            code = code << 21 | s[j : len(s) - GRAM + 1 + j]
        tail = s[-(GRAM - 1) :]
        u, c = np.unique(code, return_counts=True)
        found.append(u)
        counts.append(c)
    if not any_letter:
        return None
    if len(found) == 1:
        return found[0], counts[0]
    u, back = np.unique(np.concatenate(found), return_inverse=True)
    return u, np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)


class GramVectors:
    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims, self.seed = dims, seed
        self.letter: dict[int, np.ndarray] = {}
        self.codes = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.table = np.zeros((1024, dims), np.int8)
        self.held = 0

    def make(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.dims), np.int8)
        for j in range(GRAM):
            cp = (codes >> (21 * (GRAM - 1 - j))) & 0x1FFFFF
            own, back = np.unique(cp, return_inverse=True)
            for c in own.tolist():
                if c not in self.letter:
                    self.letter[c] = np.random.default_rng([self.seed, c]).integers(0, 2, self.dims, np.int8) * np.int8(2) - np.int8(1)
            out *= np.stack([np.roll(self.letter[c], GRAM - 1 - j) for c in own.tolist()])[back]
        return out

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct codes."""
        if not len(codes):
            return np.zeros((0, self.dims), np.int8)
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        if not known.all():
            new = codes[~known]
            if self.held + len(new) > REMEMBERED:
                out = np.empty((len(codes), self.dims), np.int8)
                out[known] = self.table[self.place[at[known]]]
                out[~known] = self.make(new)
                return out
            while self.held + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.held : self.held + len(new)] = self.make(new)
            place = np.concatenate([self.place, np.arange(self.held, self.held + len(new))])
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.codes, self.place, self.held = every[order], place[order], self.held + len(new)
            at = np.searchsorted(self.codes, codes)
        return self.table[self.place[at]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dims, np.float64)
        for k in range(0, len(codes), 4096):
            total += counts[k : k + 4096].astype(np.float32) @ self.rows(codes[k : k + 4096]).astype(np.float32)
        return total


def vectors(dims: int = DIMS, seed: int = SEED) -> GramVectors:
    return kept_state(GramVectors, dims, seed)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from all rows with a text and a label. Each task sends one vector per language; Spark adds them up."""
    bounded_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bundle", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        sums: dict[str, np.ndarray] = {}

        def add(lang: str) -> None:
            pairs = seen.pop(lang)
            u, back = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
            c = np.bincount(back, np.concatenate([p[1] for p in pairs]), len(u))
            total = np.zeros(DIMS, np.int64)
            for k in range(0, len(u), 1024):
                total += c[k : k + 1024].astype(np.int64) @ vectors().rows(u[k : k + 1024]).astype(np.int64)
            sums[lang] = sums.get(lang, 0) + total

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (g := grams(text)) is not None:
                    seen.setdefault(lang, []).append(g)
            for lang in list(seen):
                add(lang)
        if sums:
            yield table_batch(kind, lang=list(sums), bundle=[v.tolist() for v in sums.values()])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).alias("lang"))
    parts = rows.mapInArrow(tidy(run), kind).select("lang", F.posexplode("bundle").alias("k", "v"))
    total = parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("b"))
    if len(total.select("lang").limit(LABELS + 1).collect()) > LABELS:
        raise ValueError(f"more than {LABELS} labels: {lang_col} is no column of languages")
    return {r["lang"]: np.asarray([x["v"] for x in r["b"]], np.float64) for r in total.collect()}


def identify(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct<lang_pred, score>: the nearest prototype and its cosine, cut to 0..1. Texts that are null or hold no letter give
    ``und`` and 0; so does every text if nothing was learned. Ties go to the label that sorts first."""
    names = sorted(prototypes)
    unit = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]) if names else None

    def run(texts: list):
        lang, score = [], []
        for t in texts:
            g = grams(t) if t and names else None
            if g is None:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            v = vectors().bundle(*g)
            cos = unit @ v / max(np.linalg.norm(v), 1e-12)
            k = int(np.argmax(cos))
            lang.append(names[k])
            score.append(float(min(1.0, max(0.0, cos[k]))))
        return structs(KIND, lang_pred=lang, score=score)

    return map_text(run, KIND, text)


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, then predict all: id, held_out, lang_pred, score. Repeated rows stay, extra
    columns are dropped, an empty table gives an empty one."""
    protos = learn_prototypes(docs.where(~held_out(id_col)), text_col, lang_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), identify(F.col(text_col), protos).alias("_r")).select(id_col, "held_out", "_r.*")


def noise_level(dims: int = DIMS) -> float:
    """Three standard deviations of a random vector's cosine."""
    return 3 / dims**0.5


def keep_identified(docs: DataFrame, least: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text resembles a learned language: not ``und``, cosine at least ``least`` (the noise level by default).

    Columns stay as they are, whatever their names. Null texts and texts without letters go. If no language could be learned
    (no labelled row outside the held-out third), all texts with letters stay. Repeated rows are judged alike and stay; an
    empty table gives an empty one.
    """
    protos = learn_prototypes(docs.where(~held_out(id_col)), text_col, lang_col)
    if not protos:
        return docs.where(has_letter(F.col(text_col)))
    judged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_d"), identify(F.col(text_col), protos).alias("_r"))
    return judged.where((F.col("_r.lang_pred") != UNKNOWN) & (F.col("_r.score") >= (noise_level() if least is None else least))).select("_d.*")


def has_letter(text: Column) -> Column:
    return map_text(lambda texts: pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()), T.BooleanType(), text)
