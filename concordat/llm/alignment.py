"""Alignment of two tokenizers by a dangling-suffix transducer.

Two token sequences over the same bytes are read in turns. The state is which side is ahead and the bytes by which it is ahead, the
residual; the side behind gives the next token. A transition depends on the residual and that token alone, so it is worked out once and
remembered by their numbers. When the residual is empty both sides end together, and a group of tokens of both sides closes; the last
tokens of a group, whose ranges end together, are linked.

Texts are cut where neither tokenizer's tokens ever span, before a space or line feed that follows anything but white space; the groups
of each such chunk are remembered by workers. Documents keep their links as numbers of pairs with multiplicities. How often a pair is
linked in the whole corpus is summed over them, and comes back to the documents by a second pass over these numbers: texts are read once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import byte_of_symbol
from .common import bounded_batches, give_back, kept_state, release_idle, shared_folder, written

SPACE = "▁"
#: White space, as both tokenizers understand it; chunks end where it begins with a space or line feed.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(rf"(?<=[^{WHITE}])(?=[ \n])")
#: Fixed value: the pattern of byte-level vocabularies with "use_regex".
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers, twice; characters that are cut, and that are encoded, at once; transitions remembered.
CHUNKS, STRETCH, PART, TRANSITIONS = 400_000, 1 << 20, 1 << 18, 2_000_000
#: Pairs up to which counts are held by every task; beyond, they are joined.
HELD_PAIRS = 4_000_000


class Transducer:
    """States are numbered; state 0 is the empty residual. side: 0 if A is ahead, 1 if B is."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.tokens = bytes_a, bytes_b
        self.clear()

    def clear(self) -> None:
        self.number = {(0, b""): 0}
        self.state: list[tuple[int, bytes]] = [(0, b"")]
        self.known: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the token of the side that is behind; -1 if its bytes differ from the residual."""
        side, residual = self.state[state]
        if not state:
            after = (0, self.tokens[0][token])
        else:
            new = self.tokens[1 - side][token]
            if residual.startswith(new):
                after = (side, residual[len(new) :])
            elif new.startswith(residual):
                after = (1 - side, new[len(residual) :])
            else:
                return -1
        if not after[1]:
            return 0
        found = self.number.setdefault(after, len(self.state))
        if found == len(self.state):
            self.state.append(after)
        return found

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """Groups of both sides' tokens; None if the bytes differ."""
        if len(self.known) > TRANSITIONS:
            self.clear()
        known, states, out = self.known, self.state, []
        i = j = first_a = first_b = state = 0
        na, nb = len(a), len(b)
        while True:
            behind = 1 - states[state][0] if state else 0
            if behind:
                if j == nb:
                    return None
                token = b[j]
                j += 1
            else:
                if i == na:
                    return out if not state and j == nb else None
                token = a[i]
                i += 1
            key = state << 20 | token
            after = known.get(key)
            if after is None:
                after = known[key] = self.step(state, token)
            if after <= 0:
                if after < 0:
                    return None
                out.append((a[first_a:i], b[first_b:j]))
                first_a, first_b = i, j
            state = after


def entry_bytes(path: str) -> list[bytes]:
    """Bytes of a byte-level vocabulary's entries, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    as_byte = byte_of_symbol()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = {i: bytes(as_byte[c] for c in s) for s, i in spec["model"]["vocab"].items() if s not in special}
    table |= {i: s.encode() for s, i in special.items()}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of a piece model's pieces, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    for p, one in names:
        if not one and len(p) > 1 and ("\n" in p or any(y == SPACE != x for x, y in zip(p, p[1:], strict=False))):
            raise ValueError(f"a piece spans words, so texts can't be cut there: {p!r}")
    return [bytes([int(p[3:5], 16)]) if one else p.replace(SPACE, " ").encode() for p, one in names]


def compatible_pairs(bytes_a: list[bytes], bytes_b: list[bytes]) -> int:
    """How many pairs can be linked at all: ranges that end together hold bytes of which one are a suffix of the other."""
    a, b = Counter(bytes_a), Counter(bytes_b)
    longer_b = sum(n * a.get(x[k:], 0) for x, n in b.items() for k in range(len(x)))
    longer_a = sum(n * b.get(x[k:], 0) for x, n in a.items() for k in range(1, len(x)))
    return longer_a + longer_b


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.bytes_a, self.bytes_b = entry_bytes(path_a), piece_bytes(path_b)
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.encode_a = byte_encoder(path_a, self.bytes_a)
        self.encode_b = sentencepiece.SentencePieceProcessor(model_file=path_b).encode
        self.transducer = Transducer(self.bytes_a, self.bytes_b)
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def cut_at(self, ids: list[int], size: np.ndarray, ends: np.ndarray) -> list[int] | None:
        """How many tokens end at or before each place; None if a place is inside a token."""
        at = np.cumsum(size[np.asarray(ids, np.int64)])
        n = np.searchsorted(at, ends)
        return (n + 1).tolist() if len(at) and n.max() < len(at) and np.array_equal(at[n], ends) else None

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks one after another as one text, cut the ids at their ends, and align each."""
        own = [c for c in chunks if SPACE not in c]
        size = list(accumulate(map(len, own)))
        start = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or size[k - 1] - (size[start - 1] if start else 0) >= PART:
                self.align_all(own[start:k])
                start = k
        self.new.update((c, None) for c in chunks if SPACE in c)

    def align_all(self, own: list[str]) -> None:
        ends = np.fromiter(accumulate(len(c.encode()) for c in own), np.int64, len(own)) + 2  # " x" stands before them
        text = " x" + "".join(own)
        a, b = self.encode_a(text), self.encode_b(text[1:])
        cut_a, cut_b = self.cut_at(a, self.size_a, np.append(2, ends)), self.cut_at(b, self.size_b, np.append(2, ends))
        if cut_a is None or cut_b is None:
            if len(own) > 1:  # one of them is not told byte by byte; find out which
                for c in own:
                    self.align_all([c])
                return
            self.new[own[0]] = None
            return
        for k, c in enumerate(own):
            self.new[c] = self.told(a[cut_a[k] : cut_a[k + 1]], b[cut_b[k] : cut_b[k + 1]])

    def told(self, a: list[int], b: list[int]) -> tuple | None:
        """(groups as text, pair numbers as bytes, tokens of A, of B, groups)."""
        groups = self.transducer.groups(a, b)
        if groups is None:
            return None
        n = len(self.bytes_b)
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        return text.encode(), np.fromiter((x[-1] * n + y[-1] for x, y in groups), np.int64, len(groups)).tobytes(), len(a), len(b), len(groups)

    def entries(self, chunks: list[str]) -> list:
        """What told() says of each chunk."""
        new, old = self.new, self.old
        missing: dict[str, None] = {}
        for c in set(chunks):
            if c not in new:
                if c in old:
                    new[c] = old[c]
                else:
                    missing[c] = None
        if missing:
            self.learn(list(missing))
        found = [new[c] for c in chunks]
        if len(new) > CHUNKS:
            self.old, self.new = new, {}
        return found

    def aligned(self, texts: list) -> list[tuple]:
        """(n_a, n_b, n_groups, sha256 of the groups' text, numbers of the linked pairs, their multiplicities) of each text."""
        out, held, size = [], [], 0

        def add() -> None:
            parts = [CUT.split(" " + t) for t in held]
            found = self.entries([c for p in parts for c in p])
            at = 0
            for p in parts:
                out.append(summed([found[at : at + len(p)]]))
                at += len(p)

        for t in texts:
            if not t or SPACE in t or len(t) > STRETCH:
                if held:
                    add()
                    held, size = [], 0
                out.append(NOTHING if not t or SPACE in t else summed(self.entries(p) for p in long_parts(" " + t)))
                continue
            held.append(t)
            size += len(t)
            if size > STRETCH:
                add()
                held, size = [], 0
        if held:
            add()
        return out


NOTHING = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def long_parts(text: str) -> Iterator[list[str]]:
    """The chunks of a very long text, some at a time."""
    start, at = 0, STRETCH
    while at < len(text):
        m = CUT.search(text, at)
        if m is None:
            break
        yield CUT.split(text[start : m.start()])
        start, at = m.start(), m.start() + STRETCH
    yield CUT.split(text[start:])


def summed(parts) -> tuple:
    digest, sums, numbers, times = hashlib.sha256(), [0, 0, 0], [], []
    for part in parts:
        if None in part:
            return NOTHING
        digest.update((b";" if numbers else b"") + b";".join([e[0] for e in part]))
        own, n = np.unique(np.frombuffer(b"".join([e[1] for e in part]), np.int64), return_counts=True)
        numbers.append(own)
        times.append(n)
        for k in range(3):
            sums[k] += sum([e[2 + k] for e in part])
    own, n = (numbers[0], times[0]) if len(numbers) == 1 else gathered(numbers, times)
    return (*sums, digest.hexdigest(), own, n)


def gathered(numbers: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(np.concatenate(numbers), return_inverse=True)
    return own, np.bincount(place, np.concatenate(times), len(own)).astype(np.int64)


def byte_encoder(path: str, entries: list[bytes]):
    """text -> ids of a byte-level BPE file without its special tokens. Where merges are numbered as the tokens they make, ids are
    ranks, and the faster of two public libraries takes them; otherwise the tokenizers library itself encodes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    level = spec["pre_tokenizer"]
    if all(x < y for x, y in zip(made, made[1:], strict=False)) and spec["normalizer"] is None and level == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": level.get("trim_offsets"), "use_regex": True}:
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={entries[i]: i for s, i in vocab.items() if s not in special}, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def aligner(path_a: str, path_b: str) -> Aligner:
    return kept_state(Aligner, path_a, path_b)


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each text aligned; pairs are numbered id of A times B's number of
    pieces plus id of B, each once, with how often it is linked."""
    bounded_batches(docs.sparkSession)
    wide = len(entry_bytes(path_a)) * len(piece_bytes(path_b)) >= 1 << 31
    one = T.LongType() if wide else T.IntegerType()
    kind = docs.select(F.col(id_col).alias("id")).schema.add("n_a", "long").add("n_b", "long").add("n_groups", "long").add("groups_sha256", "string").add("pairs", T.ArrayType(one)).add("times", T.ArrayType(T.IntegerType()))
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_idle()
        for batch in batches:
            found = aligner(path_a, path_b).aligned(batch.column(1).to_pylist())
            lists = []
            for k, t in ((4, np.int64 if wide else np.int32), (5, np.int32)):
                off = np.fromiter(accumulate((len(f[k]) for f in found), initial=0), np.int32, len(found) + 1)
                lists.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([f[k] for f in found]).astype(t))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], arrow.field(k + 1).type) for k in range(4)), *(x.cast(arrow.field(5 + k).type) for k, x in enumerate(lists))], schema=arrow)
        give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """(pair, count, best): how often each pair is linked in all of aligned_texts(), and whether no pair of its id of B is linked more
    often. Tasks add up what they hold before the shuffle."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, times, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for b in batches:
            pairs, n = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            waiting.append((pairs, n))
            size += len(pairs)
            if size > max(1 << 20, len(own)):
                own, times = gathered([own, *(w[0] for w in waiting)], [times, *(w[1] for w in waiting)])
                waiting, size = [], 0
        own, times = gathered([own, *(w[0] for w in waiting)], [times, *(w[1] for w in waiting)])
        for k in range(0, len(own), 100_000):
            yield pa.RecordBatch.from_pydict({"pair": own[k : k + 100_000], "count": times[k : k + 100_000]})

    counts = links.select("pairs", "times").mapInArrow(add, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counts = counts.withColumn("b", F.col("pair") % pieces)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(links: DataFrame, counts: DataFrame, most_pairs: int) -> DataFrame:
    """links with n_best and count_sum. most_pairs: as many pairs as can occur; few enough go to all tasks, others are joined."""
    if most_pairs > HELD_PAIRS:
        rows = links.withColumn("_row", F.monotonically_increasing_id())
        rows = written(rows, shared_folder(links.sparkSession, "numbered_links"))
        each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", F.col("l.pairs").cast("long").alias("pair"), F.col("l.times").cast("long").alias("times"))
        sums = each.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return rows.join(sums, "_row", "left").select(*(c for c in links.columns), none("n_best"), none("count_sum"))
    table = counts.toArrow().sort_by("pair")  # most_pairs rows at most
    held = links.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "count", "best")))
    kind = links.drop("pairs", "times").schema.add("n_best", "long").add("count_sum", "long")
    arrow = to_arrow_schema(kind)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = held.value
        for b in batches:
            lists, n = b.column("pairs"), b.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            sums = np.zeros((2, b.num_rows), np.int64)
            np.add.at(sums[0], row, n * best[at])
            np.add.at(sums[1], row, n * count[at])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in arrow if f.name in b.schema.names), *map(pa.array, sums)], schema=arrow)

    return links.mapInArrow(look, kind)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the module's and the functions' words).

    Null and empty texts, and texts whose bytes one of the tokenizers changes (such as those that hold the word mark of pieces),
    have no tokens: noughts and an empty digest. Repeated rows are documents of their own and count each; other columns are
    dropped; an empty table gives an empty one.
    """
    links = written(aligned_texts(docs, path_a, path_b, id_col, text_col), shared_folder(docs.sparkSession, "alignment"))
    bytes_a, bytes_b = entry_bytes(path_a), piece_bytes(path_b)
    found = scored(links, pair_counts(links, len(bytes_b)), compatible_pairs(bytes_a, bytes_b))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
