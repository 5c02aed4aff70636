"""Alignment against a version that encodes whole texts by the libraries and intersects the ends of tokens."""

import hashlib
from collections import Counter

import pytest

from concordat.llm import alignment
from concordat.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), alignment.entry_bytes(A), alignment.piece_bytes(B)


def texts():
    words = "The quick  brown fox's jumps\tover\r\nthe lazy dog, isn't it? naïve café 中文字 текст 😀👍 12345 x=1;\n\n  y"
    odd = [None, "", " ", "\n", "\n\n\n", "a", " lead", "trail ", "tab\tend\t", "win\r\nline\r\n", "a\x1cb \x1d c", "no\xa0break　space   x", "<|endoftext|> </s> <s> <0x0A> <unk>", "has ▁ mark", "▁", "x" * 3000, "\x00 nul", words, words, words * 30, "é Å ﬁ ½", "!!!\x1c!!! ???", "()\r x", "{\r\n}\r\n", "  \t \n word", "'s 'LL don't"]
    return odd + [f"line {i}\n" + "  ".join(words.split()[: i % 9]) for i in range(30)]


def brute(rows, libraries):
    t, sp, bytes_a, bytes_b = libraries
    seen = []
    for i, text in rows:
        groups, links = [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ja, jb = b"".join(bytes_a[x] for x in a), b"".join(bytes_b[x] for x in b)
            if ja == jb == (" " + text).encode():
                ends = []
                for ids, size in ((a, bytes_a), (b, bytes_b)):
                    at, own = 0, {}
                    for k, x in enumerate(ids):
                        at += len(size[x])
                        own[at] = k + 1
                    ends.append(own)
                pa = pb = 0
                for e in sorted(ends[0].keys() & ends[1].keys()):
                    ka, kb = ends[0][e], ends[1][e]
                    groups.append((a[pa:ka], b[pb:kb]))
                    links.append((a[ka - 1], b[kb - 1]))
                    pa, pb = ka, kb
        seen.append((i, groups, links))
    counts = Counter(x for _, _, links in seen for x in links)
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, groups, links in seen:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, `a.b` string")


def test_odd_texts(spark, libraries):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "again"), (3, "again")]
    assert found(alignment.align_documents(table(spark, rows), A, B)) == brute(rows, libraries)


def test_joined_counts(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 0)
    rows = list(enumerate(texts()))
    assert found(alignment.align_documents(table(spark, rows), A, B)) == brute(rows, libraries)


def test_documents(spark, small, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(alignment.align_documents(docs, A, B)) == brute(rows, libraries)


def test_small_stretches(libraries, monkeypatch):
    for name, n in (("STRETCH", 40), ("PART", 7), ("CHUNKS", 3), ("TRANSITIONS", 5)):
        monkeypatch.setattr(alignment, name, n)
    a = alignment.Aligner(A, B)
    got = a.aligned(texts())
    want = {r[0]: r for r in brute(list(enumerate(texts())), libraries)}
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(*want[i][1:4], want[i][7]) for i in range(len(got))]


def test_other_encoder(libraries, monkeypatch):
    """Without ranks in the order of merges the tokenizers library encodes."""
    read = alignment.json.load
    monkeypatch.setattr(alignment.json, "load", lambda f: read(f) | {"normalizer": {}})
    own, t = alignment.byte_encoder(A, libraries[2]), libraries[0]
    assert all(own(x) == t.encode(x, add_special_tokens=False).ids for x in texts() if x)


def test_transducer():
    t = alignment.Transducer([b"ab", b"c", b"a", b"bc"], [b"a", b"b", b"abc", b"c", b"x"])
    assert t.groups([0, 1], [2]) == [([0, 1], [2])]
    assert t.groups([2, 3], [0, 1, 3]) == [([2], [0]), ([3], [1, 3])]
    assert t.groups([0, 1], [0, 1, 3]) == [([0], [0, 1]), ([1], [3])]
    assert t.groups([], []) == [] and t.groups([0], [0]) is None and t.groups([0], [4]) is None and t.groups([2], [0, 1]) is None
    assert alignment.compatible_pairs([b"ab", b"b"], [b"b", b"cab", b"b"]) == 6


def test_empty(spark):
    assert found(alignment.align_documents(table(spark, []), A, B)) == []
