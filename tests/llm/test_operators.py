"""Every operator against a brute-force version of its contract, on a small table and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import ann, bpe, language_id, media, ngram_join, packing, quality, token_counts, token_files, url_filter
from concordat.llm.queries import RULES, queries, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts() -> list:
    base = "the quick brown fox jumps over the lazy dog and runs away from a very slow turtle in spring"
    words = base.split()
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    return [
        None, "", " ", "\n\t", "a", "A b", "one two three four", "ONE two three four", "one two three four five", base, base, base.upper(),
        base + " x", "y " + base, " ".join(words[:-1]), " ".join([*words[:9], "cat", *words[10:]]), long, long + " tail", "<|endoftext|> <|startoftext|> </s>",
        "ß é ñ 中文 текст 😀 ﬁ ½ ①", "   spaces   here   ", "12345 67890 !!! ###", "'s 'LL don't I'VE", "e\u0301 \u212b \u03a3\u03a3 İ", "\x00\x1c\x85 control", "x" * 5000, "same\n" * 300, "tie", "tie",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with those the operators make."""
    rows = [(i, t, None if i % 7 == 3 else ("en" if i % 2 else "fr"), f"s{i % 3}", i, "clash", 1) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts_of(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def rows_of(df, key="doc_id") -> dict:
    out = {r[key]: r for r in df.collect()}
    return out


def both(odd, documents):
    return [odd, documents]


def test_token_counts(odd, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for df in both(odd, documents):
        texts, got = texts_of(df), rows_of(token_counts.count_documents(df, tokenizer_path("piece_bpe_32k.model")))
        assert got.keys() == texts.keys()
        for d, t in texts.items():
            n = len(model.encode(t or ""))
            assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((t or "").encode()), n, n > 4096), t


def word_ids(texts: dict, end: int) -> dict:
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {d: np.asarray([*e.ids, end], "<u4") for d, e in zip(texts, lib.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}


def test_packing(odd, documents):
    for df in both(odd, documents):
        ids = word_ids(texts_of(df), 2)
        rows = packing.pack_documents(df, tokenizer_path("word_bpe_49k.json")).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append(r)
        assert by_doc.keys() == ids.keys()
        for d, parts in by_doc.items():
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids[d])
                assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids[d])
        for parts in by_seq.values():
            at = 0
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096
        total = sum(map(len, ids.values()))
        assert len(by_seq) <= -(-total // 4096) * 1.05 + 1  # little padding


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 101, 700).tolist(), reverse=True)
    tree, bins = packing.RoomTree(100, 4), []
    for s in sizes:
        k = next((i for i, b in enumerate(bins) if sum(b) + s <= 100), len(bins))
        if k == len(bins):
            bins.append([])
        assert tree.place(s) == (k, sum(bins[k]))
        bins[k].append(s)


def test_equal_rows_are_packed_apart(spark):
    """Many copies of one row: none is lost, and they go to many groups; a document's pieces stay in one."""
    rows = [(1, "word " * 20)] * 500 + [(2, "many words " * 6000), (None, None), (None, "x")]
    parts = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json"))
    got = packing.pack(parts, 8).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 500 and len({r["sequence_id"] >> 32 for r in got if r["doc_id"] == 1}) == 8
    assert len({r["sequence_id"] >> 32 for r in got if r["doc_id"] == 2}) == 1 and sum(r["doc_id"] is None for r in got) == 2
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in used.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()] and sum(n for _, n in p) <= 4096


def brute_components(texts: dict) -> dict:
    sets = {}
    for d, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            index[g].add(d)
    seen = set()
    for ds in index.values():
        ds = sorted(ds)
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    o = len(sets[a] & sets[b])
                    if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_join(odd, documents):
    for df in both(odd, documents):
        want = brute_components(texts_of(df))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
        assert got == want


def test_ngram_join_families(spark):
    """Families of near copies, chains and shared passages; frequent shingles and long lists."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = " ".join(rng.choice(words, 30))
    for _ in range(12):
        base = rng.choice(words, 60).tolist()
        for _ in range(int(rng.integers(1, 25))):
            copy = list(base)
            for k in rng.integers(0, 60, int(rng.integers(0, 5))):
                copy[k] = str(rng.choice(words))
            rows.append((n, " ".join(copy) + (" " + passage if rng.random() < 0.4 else "")))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(dict(rows))


def test_ngram_join_groups_of_unlike_sets(spark, monkeypatch):
    """Two sets of one size and prefix that share little: what links with one only must not be judged by the other."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)  # shingles in the order of their hashes
    rows, k = [], 0
    while len(rows) < 60:
        k += 1
        base = " ".join(f"u{k}x{i}" for i in range(5))
        head, other, larger = f"{base} p{k} q{k}", f"{base} r{k} s{k}", f"{base} r{k} s{k} t{k}"
        a, b, c = (ngram_join.shingles(t) for t in (head, other, larger))
        if a[0] == b[0] and a[0] in c[:2]:
            rows += [(len(rows), head), (len(rows) + 1, other), (len(rows) + 2, larger)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(dict(rows)) and got[2][1] == 1


def test_shared_keys_over_batches(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    k = np.sort(rng.integers(0, 300, 500))
    m = rng.integers(0, 4, 500)
    o = np.lexsort((m, k))
    k, m = k[o], m[o]
    monkeypatch.setattr(ngram_join, "GATHER", 7)
    parts = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 3]), pa.array(m[i : i + 3])], names=["k", "m"]) for i in range(0, 500, 3)]
    rows = [tuple(r) for x in ngram_join.gathered(iter(parts)) for r in x.tolist()]
    assert rows == sorted(set(zip(k.tolist(), m.tolist(), strict=True)))


def test_words_longer_than_a_slice(monkeypatch):
    data = b"  aB c" + b"x" * 100 + b" d\tE\n" + b"y" * 3700 + b" f" * 50
    want = ngram_join.word_hashes(data)
    monkeypatch.setattr(ngram_join, "SLICE", 16)
    got = ngram_join.word_hashes(data)
    assert want.shape == (2, 55) and np.array_equal(got, want)
    of = lambda t: ngram_join.word_hashes(t).T.tolist()
    assert of(b"AB ")[0] == of(b"x ab")[1] != of(b"ba")[0]


def test_word_hashes_tell_words_apart():
    """Among them words that every power sum modulo 2^64 takes for equal, and words that differ by zero bytes or length."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    words = [a, b, "x", "x\0", "x" * 8, "x" * 9, "x" * 8 + "\0", *(f"w{i}" for i in range(500)), "\0", "\0\0"]
    got = ngram_join.word_hashes(" ".join(words).encode())
    assert len(np.unique(got[0])) == len(np.unique(got[1])) == len(words)


def test_links_are_of_words():
    """The compared sets against sets of word tuples, for few and for many distinct words and for short texts."""
    rng = np.random.default_rng(4)
    for vocabulary in (3, 40, 9000):
        for _ in range(60):
            base = [f"w{i}" for i in rng.integers(0, vocabulary, int(rng.integers(0, 5 if vocabulary < 9000 else 7000)))]
            other = [w if rng.random() > 0.03 else "z" for w in base][: len(base) - int(rng.integers(0, 2))]
            sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for x in (base, other)]
            got = ngram_join.coded([base, other])
            assert [len(x) for x in got] == [len(x) for x in sets] and len(np.intersect1d(*got)) == len(sets[0] & sets[1])
            assert ngram_join.words_link(base, other) == (100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1]) > 0)


def test_ngram_join_families_of_one_group(spark):
    """Two texts of equal prefix and size whose last word differs, a copy near the first only and one near the second only."""
    rows = []
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(14)]
        first, second = [*base[:11], f"f{f}a", "x", f"f{f}b"], [*base[:11], f"f{f}c", "y", f"f{f}d"]
        rows += [" ".join(x) for x in (first, second, [*first, f"f{f}e"], [*second, f"f{f}g"])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(dict(enumerate(rows)))


def test_one_group_of_many_unlike_sets(spark, monkeypatch):
    """Short texts with one shingle in common, whose group is cut into blocks."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    monkeypatch.setattr(ngram_join, "LIST", 4)
    texts = [f"one two three four five {w} {v}" for w in "abcdefgh" for v in ("p", "q")] + [f"one two three four five {w} p tail" for w in "abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_ngram_join_repeated_ids(spark):
    """An id whose rows hold different texts is one document that all their links reach."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (9, b + " end"), (11, "alone"), (None, a), (12, None), (12, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(5, 26, 5), (5, 26, 5), (5, 26, 5), (7, 27, 5), (9, 27, 5), (11, 1, 11), (12, 0, 12), (12, 0, 12)]
    clash = df.withColumn("keep", F.lit(1)).withColumn("_keep", F.lit(2)).withColumn("component_id", F.lit(3))
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted([(-1, a), (5, a), (5, b), (11, "alone"), (12, ""), (12, "  ")])


def test_language_id(odd, documents):
    protos = language_id.learn_prototypes(documents)
    got = {r["doc_id"]: r["_r"] for r in odd.select("doc_id", language_id.identify(F.col("text"), protos).alias("_r")).collect()}
    for d, t in texts_of(odd).items():
        assert 0 <= got[d]["score"] <= 1
        assert (got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
    rows = language_id.identify_documents(documents).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97


def test_language_vectors_are_bound_and_bundled():
    v = language_id.GramVectors(64)
    codes, counts = language_id.grams("abab")
    v.rows(codes)
    a, b, gap = (v.letter[c] for c in (97, 98, 0))
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    want = bind(gap, a, b) + 1.0 * bind(a, b, a) + bind(b, a, b) + bind(a, b, gap)
    assert counts.sum() == 4 and np.array_equal(v.bundle(codes, counts), want)


def test_bpe(odd, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for df in both(odd, documents):
        got = rows_of(bpe.round_trip_documents(df, tokenizer_path("byte_bpe_50k.json")))
        for d, t in texts_of(df).items():
            ids = lib.encode(t or "", add_special_tokens=False).ids
            assert got[d]["n_tokens"] == len(ids)
            assert got[d]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
            assert got[d]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_pairs_against_merging():
    """The pair table agrees with merging the two tokens' bytes by rank."""
    b = bpe.codec(tokenizer_path("byte_bpe_50k.json"))
    one = {v[0]: i for i, v in b.bytes_of.items() if len(v) == 1}
    rng = np.random.default_rng(5)
    for x, y in rng.integers(0, 3000, (4000, 2)).tolist():
        s = [one[c] for c in b.bytes_of[x] + b.bytes_of[y]]
        while True:
            best = min(((b.rank[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in b.rank), default=None)
            if best is None:
                break
            i = best[1]
            s[i : i + 2] = [b.rank[s[i], s[i + 1]][1]]
        assert b.compatible(x, y) == (s == [x, y]), (x, y)


def test_nearest(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, x = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows], np.float64)
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))][:20].tolist())
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        hits, total = hits + len(want & {f[1] for f in found}), total + 20
        for _, v, score in found:
            assert score == pytest.approx(float(s[ids == v][0]), abs=1e-12)
    assert hits / total >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (2, [1.0, 0.0]), (None, [1.0, 1.0]), (8, []), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 2), (0, 2, 20), (0, 3, 1), (20, 1, 0), (20, 2, 2), (20, 3, 1)]
    assert ann.nearest(df.where("false")).count() == 0


@pytest.mark.parametrize("odd_width", [1, 3, 16])
def test_nearest_of_other_widths(spark, odd_width):
    """A vector of another width loses no row of the rest; vectors of one width meet each other."""
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(200, 8)).tolist())] + [(1000 + i, [1.0 + i] * odd_width) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert {q: len(f) for q, f in got.items()} == {**dict.fromkeys(range(0, 200, 20), 20), 1000: 2}
    assert sorted(got[1000]) == [(1, 1002), (2, 1001)]
    alone = spark.createDataFrame([*rows[:200], (2000, [1.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(alone).count() == 200


def test_nearest_trials(spark, monkeypatch):
    """TRIALS queries calibrate the walk, or all of them if there are fewer; few queries get their neighbours too."""
    rng, seen, exact = np.random.default_rng(4), [], ann.exact
    monkeypatch.setattr(ann, "exact", lambda base, qids, qs, k: (seen.append(len(qids)), exact(base, qids, qs, k))[1])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(4000, 4)).tolist())], "vec_id long, embedding array<double>")
    assert {r["query_id"] for r in ann.nearest(df, every=1000).collect()} == {0, 1000, 2000, 3000}
    assert len({r["query_id"] for r in ann.nearest(df).collect()}) == 200
    assert seen == [4, ann.TRIALS]


def test_token_files(odd, documents):
    for df in both(odd, documents):
        ids, at = word_ids(texts_of(df), 1), 0
        got = rows_of(token_files.token_file_rows(df, tokenizer_path("word_bpe_49k.json")))
        assert got.keys() == ids.keys()
        for d in sorted(ids):
            assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
            at += len(ids[d])


def test_token_files_of_repeated_ids(spark):
    """Rows of one id, and of none, stand together and without gaps; every row is there."""
    rows = [(7, f"text {i % 9}") for i in range(60)] + [(None, "a"), (None, None), (3, "x"), (9, "y")]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.token_file_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer_path("word_bpe_49k.json")).collect())
    assert [d for _, d, _ in got] == [None, None, 3, *[7] * 60, 9]
    assert [s for s, _, _ in got] == [0, *np.cumsum([n for _, _, n in got])[:-1].tolist()]


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 24, 31, 32])
def test_bit_packing(bits):
    import io

    x = np.random.default_rng(bits).integers(0, 1 << bits, 1000, np.uint64).astype(np.uint32)
    for n in (0, 1, 63, 64, 65, 1000):
        assert np.array_equal(token_files.unpack_bits(token_files.pack_bits(x[:n], bits), bits, n), x[:n])
    s = token_files.Shard(io.BytesIO(token_files.shard_bytes([1, None, 3], [10, 0, 990], x, bits)))
    assert np.array_equal(s.document(0), x[:10]) and not len(s.document(1)) and np.array_equal(s.ids(500, 77), x[500:577])


def test_media(odd, documents):
    import zstandard

    for df in both(odd, documents):
        got, seen = rows_of(media.media_rows(df)), {}
        for d, t in texts_of(df).items():
            raw = (t or "").encode()
            data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            r = got[d]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
            ends = media.cuts(data)
            chunks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            frames = [zstandard.ZstdCompressor(level=media.LEVEL).compress(c) for c in chunks]
            form = media.stored_form(len(data), [hashlib.sha256(c).digest() for c in chunks], [len(c) for c in chunks], frames)
            assert (r["media_bytes"], r["media_sha256"], r["n_chunks"]) == (len(form), hashlib.sha256(form).hexdigest(), len(chunks))
            assert media.parse_form(form) == data and r["feature"] == media.features(data, len(chunks))
            mean, power = sum(data) * 1000 // len(data), sum(c * c for c in data) * 1000 // len(data)
            assert r["feature"].startswith(f"chunks={len(chunks)};mean_milli={mean};power_milli={power};")
            assert seen.setdefault(t or "", r[5:]) == r[5:]
        assert len(got) == len(texts_of(df))


@pytest.mark.parametrize("sparse", [0.0, 0.5, 1.1])
def test_packs_are_written_anew_or_stay(spark, monkeypatch, sparse):
    """Texts that several tasks share, whichever packs go: every payload is read back, shared chunks lie in one place."""
    monkeypatch.setattr(media, "SPARSE", sparse)
    rows = [(i, "shared text " * 900 if i % 3 else f"own text {i} " * 40) for i in range(60)]
    folder = media.shared_folder(spark, "media")
    listed = media.list_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), folder)
    stored = media.store_chunks(listed, folder)
    assert stored.count() == stored.select("digest").distinct().count() == listed.select("digest").distinct().count()
    got = {r["doc_id"]: r["payload_sha256"] for r in media.read_media(listed, stored).collect()}
    assert got == {i: hashlib.sha256(media.payload_of(t)[0]).hexdigest() for i, t in rows}
    left = {r["pack"].rsplit("/", 2)[1] for r in stored.select("pack").distinct().collect()}
    assert left == ({"raw"} if sparse == 0 else {"packs"} if sparse > 1 else left)


def test_chunks_follow_content():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 200_000, np.uint8).tobytes()
    for shift in (1, 100, 5000):
        a, b = media.cuts(data), media.cuts(b"z" * shift + data)
        x = {data[i:j] for i, j in zip([0, *a], a, strict=False)}
        y = {(b"z" * shift + data)[i:j] for i, j in zip([0, *b], b, strict=False)}
        assert len(x & y) > 0.8 * len(x)
    big = data * 8  # longer than a hashing slice: as if hashed whole
    ends = media.cuts(big)
    for start, end in zip([0, *ends], ends, strict=False):
        h = 0
        for c in big[end - media.WINDOW : end]:
            h = ((h << 1) + int(media.GEAR[c])) & 0xFFFFFFFF
        assert end == len(big) or end - start == media.MOST or (h & int(media.MASK) == 0 and end - start >= media.LEAST)
    assert media.cuts(b"a" * 50_000) == media.cuts(b"a" * 50_000) and media.cuts(b"") == []


def plain_rule(url):
    host, path = url_filter.split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")


def test_url_filter(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    extra = [None, "", "abc", "x://", "http://COM/en/", "http://a.com/en", "http://example.com/en/7", "http://sub.example.com/en/71?q", "http://badexample.com/en/7", "http://h/x.com/en/", "http://a.net/de/8", "http://example.net/de/8#f", "http://.net/de/", "http://é.org/es/ü", "http://org?/es/", "http://" + "a." * 3000 + "org/es/" + "b" * 9000, "a://b://c.com/en/"]
    odd = spark.createDataFrame([(10**6 + i, u, "h", "r") for i, u in enumerate(extra)], "page_id long, url string, host string, rule string")
    for df in (pages, odd):
        got = rows_of(url_filter.judge_pages(df, RULES), "page_id")
        for r in df.collect():
            g = got[r["page_id"]]
            assert (g["host"], g["path"], g["rule"], g["verdict"]) == plain_rule(r["url"]), r["url"]


def test_automaton_over_many_words():
    rules = [("block", f"h{i}.example", f"/p{i}/") for i in range(40)] + [("allow", "example", "")]
    m = url_filter.Automaton(rules)
    assert m.words > 8
    urls = [("h7.example", "/p7/x"), ("a.h39.example", "/p39/"), ("h7.example", "/p8/"), ("other", "/p7/")]
    assert m.match(urls).tolist() == [7, 39, 40, -1]


def test_quality(spark, odd, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.score_documents(documents, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    model = quality.learn(documents, labels)
    got = odd.select("doc_id", quality.quality(F.col("text"), model).alias("r")).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r["r"]["score"] <= 1 for r in got)
    assert quality.learn(documents, labels.where("quality = 1")) is None


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(4)
    xs = {0: rng.normal(0, 1, (500, 3)), 1: rng.normal(1, 2, (700, 3))}
    m = quality.fit({c: (len(x), x.sum(0), x.T @ x) for c, x in xs.items()}, 3)
    z = (xs[1] - m.center) / m.scale
    logs = []
    for c in (0, 1):
        f = np.linalg.inv(m.factors[c])
        cov = f @ f.T
        d = z - m.means[c]
        logs.append(np.log(len(xs[c]) / 1200) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.score(xs[1]), 1 / (1 + np.exp(logs[0] - logs[1])))


def all_operators(labels) -> dict:
    word, piece, byte = (tokenizer_path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))
    return {
        "counts": lambda d: token_counts.count_documents(d, piece), "packing": lambda d: packing.pack_documents(d, word), "near": ngram_join.near_duplicates,
        "language": language_id.identify_documents, "bpe": lambda d: bpe.round_trip_documents(d, byte), "files": lambda d: token_files.token_file_rows(d, word),
        "media": media.media_rows, "quality": lambda d: quality.score_documents(d, labels),
    }


def test_empty_tables(spark, odd):
    none = odd.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, run in all_operators(labels).items():
        assert run(none).count() == 0, name
    assert url_filter.judge_pages(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    for stage in (language_id.keep_identified, lambda d: quality.keep_good(d, labels), ngram_join.keep_one):
        assert stage(none).count() == 0 and stage(none).columns == none.columns


def test_repeated_rows_and_clashing_columns(spark):
    """Each row that is there twice gives its result twice; columns with the operators' own names change nothing."""
    rows = [(i, t) for i, t in enumerate(odd_texts()) if t is None or len(t) < 6000] + [(None, "no id"), (None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("score", "predicted", "lang_pred", "held_out", "component_id", "n_shingles", "keep", "_keep", "_d", "_r", "_group", "_copy", "n", "set_id", "gid", "id", "t", "a", "b", "start", "length", "n_tokens", "digest", "pack", "home", "row", "part")
    clash = plain.withColumn("lang", F.lit("en"))
    for c in names:
        clash = clash.withColumn(c, F.lit(7))
    twice = clash.unionByName(clash).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").withColumn("score", F.lit(1)).withColumn("_id", F.lit(1))
    with_lang = plain.withColumn("lang", F.lit("en"))
    for name, run in all_operators(labels).items():
        drop = {"packing": ["sequence_id", "offset"], "files": ["start"]}.get(name, [])
        flat = lambda df: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.drop(*drop).collect())  # noqa: E731, B023
        assert flat(run(twice)) == sorted(2 * flat(run(with_lang))), name
    pages = spark.createDataFrame([(1, "http://example.com/en/7"), (1, "http://example.com/en/7"), (2, None), (None, "x")], "page_id long, url string").withColumn("host", F.lit("c")).withColumn("_r", F.lit(1))
    assert sorted(map(repr, url_filter.judge_pages(pages, RULES).collect())) == sorted(map(repr, [*2 * url_filter.judge_pages(pages.where("page_id = 1").limit(1), RULES).collect(), *url_filter.judge_pages(pages.where("page_id is null or page_id = 2"), RULES).collect()]))


def test_stages_on_odd_rows(spark):
    """The pipeline's stages on nulls, repeated rows and columns with names of their own; every clean row of them stays."""
    rows = [(1, "some words that people write every day in the town", "en"), (1, "some words that people write every day in the town", "en"), (2, None, None), (3, "", "en"), (4, "12 34 --", "en"), (None, "other words that nobody ever wrote before this morning", None), (5, "the same town and the same people as on every other day", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("score", "_d", "_r", "keep", "_keep", "component_id", "lang_pred"):
        df = df.withColumn(c, F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = lambda d: sorted((r["doc_id"] or -1, r["text"] or "") for r in d.collect())
    every = kept(df)
    lang = language_id.keep_identified(df)
    assert lang.columns == df.columns and kept(lang) == [x for x in every if any(map(str.isalpha, x[1]))]
    nothing_learned = language_id.keep_identified(df.withColumn("lang", F.lit(None).cast("string")))
    assert kept(nothing_learned) == kept(lang)
    good = quality.keep_good(df, labels)
    assert good.columns == df.columns and kept(good) == every  # nothing learned: nothing goes
    one = ngram_join.keep_one(df)
    assert one.columns == df.columns and kept(one) == sorted(set(every))


def test_statistics_do_not_depend_on_slices(monkeypatch):
    text = "".join(odd_texts()[k] or "" for k in (9, 16, 19, 22, 26)) + "\n\nLast line and a word" + "y" * 50
    want = quality.statistics(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(quality, "SLICE", size)
        assert quality.statistics(text[:20_000]) == (want if len(text) <= 20_000 else quality_of(text[:20_000], monkeypatch, size))


def quality_of(text, monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", 1 << 20)
    out = quality.statistics(text)
    monkeypatch.setattr(quality, "SLICE", size)
    return out


def test_pipeline_stages(spark, small, documents):
    import corpus_pipeline

    docs, seen = documents, [documents]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        seen.append(docs)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3]
    comps = brute_components({d: t for d, t in texts_of(documents).items() if d in ids[2]})
    assert ids[3] == {c for _, c in comps.values()}
    packed = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids[3]
    assert set(queries()) >= {"pipeline", "op1_token_counts", "op10_quality"}


def test_cut_finds_what_the_pattern_finds():
    import random
    import re

    from concordat.llm.common import END, cut

    pattern, rng = re.compile(r" ?\S+|\s+(?!\S)|\s+"), random.Random(5)
    for _ in range(2000):
        texts = ["".join(rng.choice(" \n\té\tab  ") for _ in range(rng.randrange(9))) for _ in range(4)]
        chunks, ends = cut(texts)
        at, found = 0, []
        for e in ends:
            assert chunks[int(e)].as_py() == END
            found.append(chunks[at : int(e)].to_pylist())
            at = int(e) + 1
        assert found == [pattern.findall(t) for t in texts]
