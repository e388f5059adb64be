"""Each operator against brute force, an exact round trip or held-out accuracy, with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusctx.llm import ann, bpe, langid, licenses, merkle, neardup, packing, pii, sharding, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 30_000
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "one two", None, None), (5, "one two", "de", "a"), (5, "one two", "de", "a"), (6, " \n\t", "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with the operators' own."""
    extra = ["score", "ids", "base", "terms", "hub", "label", "bucket", "queue", "tree", "licenses", "lang_pred", "n"]
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_is_even_and_whole(spark, odd, empty):
    rows = sharding.shuffle_into_shards(odd.drop("label").repartition(3), 4, seed=3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in ODD)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 4
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shuffle_into_shards(empty, 4).count() == 0
    few = sharding.shuffle_into_shards(spark.range(2), 5).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0)]


def test_sharding_is_uniform(spark):
    rows = sharding.shuffle_into_shards(spark.range(4000).repartition(4), 8, seed=5).collect()
    for block in range(4):  # rows that are neighbours in the input spread evenly
        counts = Counter(r.shard for r in rows if r.id // 1000 == block)
        assert all(abs(counts[s] - 125) < 6 * math.sqrt(125) for s in range(8))


def test_hypergeometric_draw(spark):
    total, good, draws = (F.lit(n).cast("bigint") for n in (50, 20, 10))
    drawn = spark.range(100_000).select(sharding.hypergeometric(total, good, draws, sharding._uniform("id")).alias("k"))
    for r in drawn.groupBy("k").count().collect():
        p = math.comb(20, r["k"]) * math.comb(30, 10 - r["k"]) / math.comb(50, 10)
        assert abs(r["count"] - 1e5 * p) < 6 * math.sqrt(1e5 * p) + 3


def test_matrix_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_OUT", 3)
    sizes = spark.range(10).select(F.col("id").alias("block"), (F.col("id") * 7).alias("n"))
    rows = sharding.communication_matrix(sizes, [105, 105, 105], 10, 1).collect()
    assert {r.block: sum(r.counts) for r in rows} == {b: 7 * b for b in range(10)}
    assert [sum(r.counts[s] for r in rows) for s in range(3)] == [105] * 3


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2004, [None] * 16), (2005, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    exact = np.array([v for _, v in rows])
    hits = 0
    for q in range(0, 1500, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21)) and all(abs(s - exact[i] @ exact[q]) < 1e-9 for _, i, s in own)
        scores = exact @ exact[q]
        scores[q] = -np.inf
        hits += len({i for _, i, _ in own} & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (75 * 20) >= 0.9 and len(got) == 75 * 20
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert {r.vec_id for r in few} == {1, 2}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_langid_marginals_are_exact():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 65, 200):
        scores, moves = rng.standard_normal((n, 3)), rng.standard_normal((3, 3))
        start = np.full(3, 1 / 3) @ np.exp(moves)
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            alpha[t] = (start if t == 0 else alpha[t - 1] @ np.exp(moves)) * np.exp(scores[t])
            alpha[t] /= alpha[t].sum()
        for t in range(n - 2, -1, -1):
            beta[t] = np.exp(moves) @ (np.exp(scores[t + 1]) * beta[t + 1])
            beta[t] /= beta[t].sum()
        expected = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
        assert np.allclose(langid.marginals(scores, np.array([n]), moves), expected)


def test_langid(spark, docs, odd, empty):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = langid.fit(docs.where(fold != 2))
    held = langid.predict(docs.where(fold == 2), model).select("lang", "lang_pred", "lang_score").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.lang_score <= 1 for r in held)
    found = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert [found[i] for i in (1, 2, 6)] == ["und"] * 3 and found[3] in model.languages
    # Code-switched text: the words of each half go to its own language.
    english, german = (docs.where(F.col("lang") == x).first().text[:400] for x in ("en", "de"))
    data = np.frombuffer(f"{english} {german}".encode(), np.uint8)
    starts, ends, _ = langid.word_bounds(data, np.array([0, len(data)]))
    best = langid.marginals(model.emissions(langid.Words(), data, starts, ends), np.array([len(starts)]), model.transitions).argmax(axis=1)
    cut = int((starts < len(english.encode())).sum())
    assert (best[:cut] == model.languages.index("en")).mean() > 0.9 and (best[cut:] == model.languages.index("de")).mean() > 0.9
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred != 'und'").isEmpty()
    assert langid.predict(empty, model).count() == 0


def test_merkle_against_plain_python(spark, docs, odd, empty):
    rows = {r.doc_id: r for r in merkle.compare_with_edits(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts, reverse=True)

    def tree(text):
        paragraphs = []
        for p in text.split("\n"):
            paragraphs.append([sha256(s.encode()).hexdigest() for s in re.split(r"(?<=[.!?])(?=[\x20\t])", p)])
        hashes = [sha256("".join(p).encode()).hexdigest() for p in paragraphs]
        sections, at = [], 0
        for k, h in enumerate(hashes):
            if int(h[:4], 16) % merkle.SECTION == 0 or k == len(hashes) - 1:
                sections.append(sha256("".join(hashes[at : k + 1]).encode()).hexdigest())
                at = k + 1
        return sha256("".join(sections).encode()).hexdigest(), {s for p in paragraphs for s in p}

    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, n = texts[i], len(texts[i])
        edited = text[: n - n // 2] + texts[following][: n // 2]
        (root, a), (edited_root, b), (_, c) = tree(text), tree(edited), tree(texts[following])
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha256(edited.encode()).hexdigest(), root, edited_root)
        assert r.near_edited == pytest.approx(1 if root == edited_root else len(a & b) / len(a | b))
        assert r.near_next == pytest.approx(1 if text == texts[following] else len(a & c) / len(a | c))
    found = merkle.compare_with_edits(odd).collect()
    assert len(found) == len(ODD) and len({r.fingerprint for r in found if r.doc_id in (1, 2)}) == 1
    assert len({r.fingerprint for r in found if r.doc_id in (4, 5)}) == 1
    assert merkle.compare_with_edits(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "doc_id long, text string")
    assert merkle.compare_with_edits(nulls).count() == 3


def test_merkle_locates_edits(spark):
    df = spark.createDataFrame([("a\nb. c\nd", "a\nb. x\nd")], "old string, new string")
    df = merkle.trees(merkle.trees(df, "old", "o"), "new", "n")
    assert df.select(merkle.edited_paragraphs(F.col("o"), F.col("n"))).first()[0] == [1]


def test_licenses_against_brute_force(spark, docs, odd, empty):
    def brute(text):
        best = {}
        sequence = licenses.words(text)
        for name, body in licenses.TEMPLATES.items():
            wanted = licenses.words(body)
            spans = [licenses.words(line) for line in text.split("\n")]
            spans += [sequence[k : k + len(wanted)] for k in range(len(sequence) - len(wanted) + 1)]
            scores = [licenses.dice(licenses.bigrams(s), licenses.bigrams(wanted)) for s in spans if s]
            if scores and max(scores) >= licenses.THRESHOLD:
                best[name] = max(scores)
        return best

    marked = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nReleased under\nthe MIT License."))).otherwise(F.col("text")).alias("text"))
    for r in licenses.scan(marked).collect():
        assert {m.license: pytest.approx(m.dice) for m in r.licenses} == brute(r.text)
    assert all(not r.licenses for r in licenses.scan(odd).collect()) and licenses.scan(empty).count() == 0


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(600):
        body, toxic = [rng.choice(words) for _ in range(40)], i % 5 == 0
        if toxic:
            body.insert(rng.randrange(40), rng.choice(["zzwort", "qqbad"]))
        rows.append((i, " ".join(body)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 4 != 2"), labels)
    held = toxicity.score(docs.where("doc_id % 4 = 2"), model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in held)
    found = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert found[1] == found[2] and all(0 <= s <= 1 for s in found.values())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("predicted = 1").isEmpty()


def _brute_components(rows, size):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_neardup_against_brute_force(spark, docs, odd, empty):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(150)]
    copies = []
    for i in range(300):  # a large group of near copies, many of which are near the first alone
        body = list(base)
        for _ in range(rng.randrange(8)):
            body[rng.randrange(len(body))] = f"x{rng.randrange(10**6)}"
        copies.append((10_000 + i, " ".join(body)))
    copies += [(20_000 + i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(30)])) for i in range(80)]  # a shared passage
    rows = [(r.doc_id, r.text) for r in docs.collect()] + copies + [(7000, None), (7001, ""), (7002, "A b"), (7003, "a  B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 4).collect()}
    assert got == _brute_components(rows, 4)
    found = neardup.near_duplicates(odd.union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), 4).collect()
    assert len(found) == len(ODD) + 1
    assert {(r.doc_id, r.component_id, r.kept) for r in found if r.doc_id in (4, 5)} == {(4, 4, True), (5, 4, False)}
    assert neardup.near_duplicates(empty, 4).count() == 0


def test_setsketch_estimates(spark):
    from corpusctx.llm import setsketch

    rng = np.random.default_rng(6)
    for share in (0.3, 0.6, 0.8, 0.95):
        common = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        own = int(1000 * (1 - share) / share / 2)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]) for _ in range(2))
        a, b = a * np.uint64(2654435769), b * np.uint64(2654435769)
        sketch = setsketch.registers(np.concatenate([a, b]), np.array([len(a), len(b)]))
        both = setsketch.registers(np.concatenate([a, b]), np.array([len(a) + len(b)]))
        assert (setsketch.merge(sketch[0], sketch[1]) == both[0]).all()
        estimate = setsketch.similarity(sketch[:1], sketch[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(estimate - 1000 / (1000 + 2 * own)) < 0.12


def test_packing_is_whole_full_and_mixed(spark, docs, odd, empty, vocabulary):
    reference = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(docs, vocabulary).collect()
    ids = {i: np.array(reference.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    by_doc, windows = {}, {}
    for p in pieces:
        assert bytes(p.ids) == ids[p.doc_id][p.start : p.start + p.length].tobytes() and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, own in ids.items():
        assert [s for s, _ in sorted(by_doc[i])] == [0, *np.cumsum([n for _, n in sorted(by_doc[i])])[:-1]] and sum(n for _, n in by_doc[i]) == len(own)
    lengths = []
    for w in sorted(windows):
        at = 0
        for offset, n in sorted(windows[w]):
            assert offset == at
            at += n
        lengths.append(at)
    full = sum(map(len, ids.values())) // packing.WINDOW
    assert lengths[:full] == [packing.WINDOW] * full and all(n & (n - 1) == 0 for n in lengths[full:])
    assert sorted(windows) == list(range(len(windows)))
    found = packing.pack(odd, vocabulary, with_ids=False).collect()
    assert sum(p.length for p in found) == sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in ODD)
    assert packing.pack(empty, vocabulary).count() == 0


def test_packing_follows_targets():
    plan = packing.Plan([40_000, 40_000, 40_000], [0.6, 0.3, 0.1], 256, 16)
    used = np.zeros((200, 3))
    for q in range(3):
        _, _, length, window, _ = plan.pieces(np.array([q]), np.array([0]), np.array([20_000]))
        for n, w in zip(length, window):
            used[w if w < 200 else -1, q] += n
    early = used[2:60] / 256
    assert np.abs(early - [0.6, 0.3, 0.1]).max() < 3 * 16 / 256


def test_pii_spans_against_patterns(spark, odd, empty):
    rng = random.Random(5)
    letters = "ab1234567890.@+- ()%_\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["x 4111 1111 1111 1111 y", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "+1 (502) 555-7612", "é a.b+c@x-y.org, z", "9" * 50_000, "1." * 20_000]

    def brute(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        if len(text) < 1000:
            out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            out += [("card", *m.span())] if 16 <= len(digits) <= 19 and total % 10 == 0 else []
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]

    for text in texts:
        got = pii.base_spans(text)
        assert got == brute(text) or len(text) >= 1000
    found = pii.find_spans(odd.drop("base", "terms")).collect()
    assert len(found) == len(ODD) and all(not r.base and not r.terms for r in found)
    assert pii.find_spans(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_pii_terms_disclose(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)]
    for i in range(4):  # one name keeps appearing next to one address, in different surroundings
        rows.append((1000 + i, " ".join(rng.choice(words) for _ in range(10)) + " Wolfhart jo@ex.org " + " ".join(rng.choice(words) for _ in range(10))))
    rows.append((2000, "Wolfhart alone"))
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        assert "jo@ex.org" not in clean[1000 + i] and "Wolfhart" not in clean[1000 + i] and "[EMAIL]" in clean[1000 + i]
    assert clean[2000] == "Wolfhart alone" and all(clean[i] == t for i, t in rows[:300])


def test_pii_terms_of_many_spans_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)]
    near = [" ".join(rng.choice(words) for _ in range(10)) + " Wolfhart jo@ex.org" for _ in range(4)]
    # Equal ids and lengths, other texts: the spans of one must not mark the other.
    rows += [(1000, near[0]), (1000, "y" * len(near[0])), (None, near[1]), (None, None), (1001, near[2]), (1002, near[3])]
    # Thousands of addresses; none of their own parts may count as a word around the next.
    rows.append((2000, "\n".join(f"user@host.net to Ulmenhof" for _ in range(3000))))
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        shown = {(r.text or "")[s.start : s.end] for s in r.terms or ()}
        assert shown <= {"Wolfhart"} and (("Wolfhart" in (r.text or "")) == bool(shown))
    assert next(len(r.base) for r in found if r.doc_id == 2000) == 3000
    starts, ends = pii._covered([("a", 3, 5), ("b", 4, 9), ("a", 20, 22)])
    assert (starts, ends) == ([3, 20], [9, 22])
    long = "1" * 400
    assert pii._entity("ip", long + "1") != pii._entity("ip", long + "2")


def test_bpe_equals_the_tokenizer(spark, docs, odd, empty, vocabulary):
    reference = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    texts = ["".join(rng.choice(" \n\t'strevmld12²é!?-aB 　中") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "I've 'sx it''s", "x<|endoftext|>y <|endoftext|>", LONG]
    encoder = bpe.Encoder(vocabulary, cached=500)
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert np.frombuffer(ids, np.uint32).tolist() == reference.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == text
    lexicon = bpe.build_lexicon(docs, vocabulary, max_words=500)
    for df in (docs, odd):
        for r in bpe.round_trip(df, vocabulary, lexicon).collect():
            ids = reference.encode(r.text or "", add_special_tokens=False).ids
            assert r.round_trip.n_tokens == len(ids) and r.round_trip.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.round_trip.decoded_sha256 == sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(odd, vocabulary, lexicon), vocabulary).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.round_trip(empty, vocabulary, bpe.build_lexicon(empty, vocabulary)).count() == 0


def test_lexicon_shares_suffixes_and_finds_words(tmp_path, vocabulary):
    words = [f"{a}{b}ing".encode() for a in "abcdefgh" for b in "xyz"]
    (tmp_path / "lexicon").write_bytes(bpe.pack_lexicon(vocabulary, words))
    lexicon = bpe.Lexicon(tmp_path / "lexicon")
    assert len(lexicon.keys) == 8 + 3 + 3
    assert lexicon.find(words) == bpe.merge_words(vocabulary, words) and lexicon.find([b"ax", b"axingx", b""]) == [None] * 3


def test_components_of_chains_stars_and_random_links(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)] + [(i, 190) for i in range(170, 190)]
    random = [tuple(map(int, p)) for p in rng.integers(200, 400, (120, 2))]
    links = chain + star + random + star[:5]
    least = {n: n for p in links for n in p}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = {r[0]: r[1] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: m for n, m in least.items() if n != m}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii_terms_anywhere_in_the_texts_of_an_entity(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(i, some(40)) for i in range(300)]
    rows += [(1000 + i, f"Wolfhart {some(30)}\n{some(10)}\nContact jo@ex.org\n{some(30)} wolfhart {some(5)}") for i in range(4)]
    copy = f"Ulmenhof {some(30)} to al@ex.org {some(20)}"
    rows += [(2000 + i, f"{copy} {some(3)}") for i in range(4)]  # copies of one text prove nothing
    rows += [(3000 + i, t) for i, t in enumerate([rows[300][1]] * 2 + ["Wolfhart alone"])]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in [1000, 1001, 1002, 1003, 3000, 3001]:
        assert "wolfhart" not in clean[i].lower() and "[EMAIL]" in clean[i]
    assert all("Ulmenhof" in clean[2000 + i] and "[EMAIL]" in clean[2000 + i] for i in range(4)) and clean[3002] == "Wolfhart alone"


def test_licenses_against_every_span():
    rng = random.Random(11)
    grant = licenses.words(licenses.TEMPLATES["MIT-grant"])
    added = [*grant[:5], "w", "x", *grant[5:12], "y", "z", *grant[12:]]
    texts = [" ".join(grant[:9]) + "\n" + " ".join(grant[9:17]), " ".join(added[:10]) + "\n" + " ".join(added[10:])]
    for _ in range(60):
        body = licenses.words(rng.choice(list(licenses.TEMPLATES.values())))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(body))
            body[k:k + rng.randrange(2)] = [rng.choice([*body, "other"])] * rng.randrange(3)
        texts.append("".join(w + rng.choice("   \n") for w in ["some", "text", *body, "more"]))
    scanner = licenses.Scanner({**licenses.TEMPLATES, "one": "Unlicensed"})
    for text in [*texts, "it is\nunlicensed now"]:
        words, best = licenses.words(text), {}
        for name, _, wanted in scanner.parts:
            score = max(licenses.dice(licenses.bigrams(words[a:b]), wanted) for a in range(len(words)) for b in range(a + 1, len(words) + 1))
            if score >= licenses.THRESHOLD:
                best[name] = pytest.approx(score)
        assert {m[0]: m[3] for m in scanner.scan(text)} == best
    assert [m[0] for m in scanner.scan(texts[0])] == [m[0] for m in scanner.scan(texts[1])] == ["MIT-grant"]


def test_ann_repeated_queries_keep_all_their_neighbours(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    once = ann.nearest(df, df.where("vec_id = 0"))
    three = ann.nearest(df, df.where("vec_id = 0").union(df.where("vec_id = 0")).union(df.where("vec_id = 0")))
    assert sorted(three.collect()) == sorted(once.collect()) and three.select("vec_id").distinct().count() == 20


def test_langid_long_texts_pass_messages_on(monkeypatch):
    """A text cut into segments has the probabilities of the whole one."""
    rng = np.random.default_rng(3)
    texts = ["the cat und der Hund 12 x9 " * 40, "", "one", "là où " * 100, "x" * 700]
    data, offsets = langid.byte_view(pa.array(texts))
    weights = rng.standard_normal((1 << langid.BITS, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], np.zeros(0, np.uint64), None, weights, 1.0, np.zeros(3, np.float32), rng.standard_normal((3, 3)))

    def run():
        out = {}
        for a, _, _, _, _, text, chance in langid.fields(model, langid.Words(), data, offsets):
            for k, row in zip((a + text).tolist(), chance):
                out.setdefault(k, []).append(row)
        return {k: np.array(v) for k, v in out.items()}

    whole = run()
    real = langid.slices
    monkeypatch.setattr(langid, "slices", lambda o, limit, rows: real(o, 200, rows))
    monkeypatch.setattr(langid, "max", lambda *a: 200 if a[-1] == 1 << 11 else max(*a), raising=False)
    cut = run()
    assert whole.keys() == cut.keys() and all(np.allclose(whole[k], cut[k]) for k in whole)


def test_langid_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "_SEQUENCES", 100)
    monkeypatch.setattr(langid, "_ROUNDS", 2)
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)}oo " * 12, f"l{i:03d}") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300


def test_toxicity_sample_is_bounded_and_moves_no_text(spark, monkeypatch):
    rows = [(i, ("vile " if i % 2 else "calm ") * 5 + str(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    seen = []
    real = toxicity.gram_counts
    monkeypatch.setattr(toxicity, "gram_counts", lambda rows: seen.append(rows) or real(rows))
    model = toxicity.fit(docs, labels, max_train=60, max_labelled=200)
    assert 100 < seen[0].count() <= 200 and "Exchange hashpartitioning" not in seen[0]._jdf.queryExecution().toString()
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == i % 2 for i in got) >= 380


def test_encoders_take_runs_of_blanks_and_many_special_tokens(spark, vocabulary):
    texts = [" " * 1_100_000 + "x", "<|endoftext|>" * 1500 + "a", "a" + "<|endoftext|>b" * 3000, "\n" * 50_000, "no　 " * 30 + "\t" * 5000 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r.round_trip for r in bpe.round_trip(docs, vocabulary).collect()}
    assert all(got[k].n_tokens == len(i) and got[k].ids_sha256 == sha256(",".join(map(str, i)).encode()).hexdigest() for k, i in enumerate(ids))
    pieces = packing.pack(docs.withColumn("source", F.lit("s")), vocabulary).collect()
    for k, own in enumerate(ids):
        found = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start))
        assert np.frombuffer(found, np.uint32).tolist() == [*own, packing.END_ID]


def test_targets_hold_with_any_number_of_sources(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 8)
    rows = [(i, "word " * 40, "big" if i % 2 else f"s{i}") for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), vocabulary, shares={"big": 0.25}).collect()
    assert {p.queue for p in pieces if p.queue.startswith("s")} == {"sbig"} and len({p.queue for p in pieces}) <= 9
    early = [p for p in pieces if p.sequence_id < 3]
    share = sum(p.length for p in early if p.queue == "sbig") / sum(p.length for p in early)
    assert abs(share - 0.25 / (0.25 + 0.5)) < 0.1


def test_tasks_get_plain_data(vocabulary):
    """What is broadcast names no class of the package, so executors need no copy of it."""
    import pickle

    state = pickle.dumps(vars(vocabulary))
    assert b"corpusctx" not in state and bpe.Vocabulary.of(pickle.loads(state)).tokens == vocabulary.tokens


def test_sanitised_documents_keep_their_columns(odd):
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    assert sorted((r.doc_id, r.text, r.base, r.terms) for r in clean.collect() if r.text) == sorted((i, t, "x", "x") for i, t, *_ in ODD if t)
