"""Alignment of two tokenizers against the tokenizers themselves and plain loops."""

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusctx.llm import alignment, bpe, encoders

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    tokenizer = Tokenizer.from_file(PATH_A)
    tokenizer.encode_special_tokens = True
    with open(PATH_B, "rb") as file:
        model = file.read()
    return tokenizer, sentencepiece.SentencePieceProcessor(model_proto=model), bpe.Vocabulary(PATH_A).tokens, alignment.piece_bytes(model)


def brute_force(texts, sides):
    tokenizer, pieces, bytes_a, bytes_b = sides
    found, count = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            whole = (" " + text).encode()
            if b"".join(bytes_a[i] for i in a) == whole == b"".join(bytes_b[i] for i in b):
                ends = [list(np.cumsum([len(t[i]) for i in ids])) for t, ids in ((bytes_a, a), (bytes_b, b))]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append((a[i:x], b[j:y]))
                    links.append((a[x - 1], b[y - 1]))
                    i, j = x, y
        found.append((groups, links))
        count.update(links)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    rows = []
    for groups, links in found:
        digest = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), sha256(digest.encode()).hexdigest() if groups else "",
        ))
    return rows


ODD = [
    None, "", " ", "  ", "a", "a  b ", " lead", "trail  ", "x▁y", "▁", "<s> hi </s><unk>", "<|endoftext|> plain", "tab\tand\nlines\r\n\x00", "é é 漢字 🙂🙂 ",
    "don't we'll", "a" * 3000, " " * 5000 + "x", "y" + "\n" * 4000, "two two", "two two", "　wide blank", "12345 67,89",
]
SCHEMA = "doc_id long, text string"


def test_against_brute_force(spark, sides):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + docs
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({c: F.lit("x") for c in ("links", "pair", "n", "n_a")})
    got = sorted(tuple(r) for r in alignment.align(df.repartition(3), PATH_A, PATH_B).collect())
    assert got == [(k, *row) for k, row in enumerate(brute_force(texts, sides))]
    assert alignment.align(df.limit(0), PATH_A, PATH_B).count() == 0


def test_long_texts_go_by_in_parts(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 400)
    monkeypatch.setattr(alignment, "WORK", 7)
    texts = ["word after word, and some more; " * 40, "bad ▁ in the middle " * 30, *ODD, "unbroken" * 100 + " end", "fine text " * 50 + "▁"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "word after word")], SCHEMA)
    got = sorted((tuple(r) for r in alignment.align(df, PATH_A, PATH_B).collect()), key=lambda r: (r[0] is None, r[0]))
    expected = brute_force([*texts, "word after word"], sides)
    assert got == [(k if k < len(texts) else None, *row) for k, row in enumerate(expected)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 9))
def test_merge_path_pieces(a, b, work):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = alignment.diagonals(a, b, work)
    steps = np.diff(i) + np.diff(j)
    assert i[-1] == len(a) and j[-1] == len(b) and (steps[:-1] == work).all() and (steps <= work).all()
    for x, y in zip(i.tolist(), j.tolist()):  # what lies before a border is no larger than what follows
        assert not (x and y < len(b)) or a[x - 1] <= b[y]
        assert not (y and x < len(a)) or b[y - 1] < a[x]
    left, right = alignment.shared_ends(a, b, work)
    assert a[left].tolist() == b[right].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_pairs_are_bounded(spark, sides):
    bound = alignment.pair_bound(sides[2], sides[3])
    assert alignment.pair_bound([b"a", b"ba", b""], [b"a", b"cba", None]) == 4
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    aligned, kind = alignment.align_texts(docs, PATH_A, PATH_B)
    assert 0 < alignment.pair_counts(aligned, kind).count() <= bound < 1 << 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "é", "'s", "9", "!", "<|endoftext|>", "漢", " " * 2100, "\t" * 2050]), max_size=12).map("".join))
def test_byte_encoder_equals_the_tokenizer(text):
    tokenizer, vocabulary = Tokenizer.from_file(PATH_A), bpe.Vocabulary(PATH_A)
    if not hasattr(test_byte_encoder_equals_the_tokenizer, "both"):
        test_byte_encoder_equals_the_tokenizer.both = encoders.ByteEncoder(vocabulary.tokens, vocabulary.special)
    assert test_byte_encoder_equals_the_tokenizer.both.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
