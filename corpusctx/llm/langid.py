"""Language identification by a linear-chain conditional random field over words.

Each word gets emission scores from hashed prefixes, suffixes and byte n-grams and from a lexicon
of word counts per language; learned transitions say how readily the language changes from one
word to the next. Forward-backward gives every word's language probabilities, exactly and for
whole texts: words go by in blocks whose transfer matrices are multiplied up, and a text longer
than ``FIELD_BYTES`` in segments that end at blanks and pass their messages on, so memory follows
the segment and not the text. A document's language is the one with the largest mean probability. ``judge`` adds what a filter needs: the
share of its words in each language and how many of their features the training texts know.

The lexicon counts all training documents. Weights are fitted on code-switched sequences made of
spans of a bounded sample of them. A text that is null or has no letter is ``und`` with score 0,
and so is every text when there are no labelled rows. Repeated rows get repeated results; columns
named ``lang_pred`` and ``lang_score`` are replaced. Every value of ``lang`` is a language: the
model holds a weight per feature and language.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusctx.llm.arrow import byte_view, column_udf, releasing, slices
from corpusctx.llm.bounded import most_frequent
from corpusctx.llm.shingles import Words
from corpusctx.sources.scratch import materialize

UNKNOWN = "und"
BITS = 16
LEXICON_WORDS = 1 << 16
#: Training documents whose words the weights are fitted on, chosen by a hash of their id; at least 8 a language.
MAX_TRAIN = 1500
#: Only documents up to this size are in that sample, each whole, so it stays bounded.
TRAIN_BYTES = 1 << 16
_SPAN, _LENGTH, _SEQUENCES, _ROUNDS, _RATE, _PENALTY = 12, 64, 2500, 40, 0.3, 1e-6
_BLOCK = 64
#: Bytes of text that the field works on at once with four languages; fewer with more of them.
FIELD_BYTES = 1 << 17
_FIELD_TEXTS = 1024
#: A document in one language has at least this share of its words in it (its ``lang``, if the field knows that one).
MIN_SHARE = 0.6
#: At least this share of its words' features must be known, else it is gibberish or in no language of the field.
MIN_KNOWN = 0.6
#: A text of fewer words is too short for these two; it only goes if its ``lang`` has less than ``SURE_OTHER``.
MIN_WORDS, SURE_OTHER = 8, 0.1
#: A feature is known if this share of one language's sampled distinct texts has it, and two of them at least.
_KNOWN_TEXTS = 0.02

# A word is a run of ASCII letters and of bytes of other characters.
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_PREFIX, _SUFFIX, _GRAM = (1, 2, 3), (1, 2, 3, 4), (2, 3)


def word_bounds(data, offsets):
    """Starts, ends and text numbers of the words of texts laid end to end."""
    word = ~_GAP[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = word[first]
    end[first[1:] - 1] = word[first[1:] - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def _hash(low, starts, width, salt):
    h = np.full(len(starts), salt * 0x61C88647 & 0xFFFFFFFF, np.uint32)
    for k in range(width):
        h = (h ^ low[starts + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def features(data, starts, ends):
    """(word number, hashed feature) of all words' affixes and n-grams; every word has at least one."""
    low, size = _LOWER[data], ends - starts
    words, found = [], []
    for k in _PREFIX:
        has = np.flatnonzero(size >= k)
        words.append(has)
        found.append(_hash(low, starts[has], k, k))
    for k in _SUFFIX:
        has = np.flatnonzero(size >= k)
        words.append(has)
        found.append(_hash(low, ends[has] - k, k, 8 + k))
    for k in _GRAM:
        count = np.maximum(size - k + 1, 0)
        word = np.repeat(np.arange(len(starts)), count)
        at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        words.append(word)
        found.append(_hash(low, at, k, 16 + k))
    return np.concatenate(words), np.concatenate(found).astype(np.int64)


def _word_hashes(words, data, starts, ends):
    """Hash of each word, the same in every text."""
    low = _LOWER[data].astype(np.uint8)
    return words.spans(low, starts, ends)


def lexicon_counts(docs, languages):
    """(word hash, one count per language) over all training documents."""
    number = {name: i for i, name in enumerate(languages)}
    names = [f"c{i}" for i in range(len(languages))]

    def run(batches):
        words, found = Words(), [[] for _ in languages]

        def total(parts):
            h = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            h, inverse = np.unique(h, return_inverse=True)
            return h, np.bincount(inverse, n, len(h)).astype(np.int64)

        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            language = np.array([number[x] for x in batch.column(1).to_pylist()])
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, text = word_bounds(part, offsets[a : b + 1] - offsets[a])
                hashes = _word_hashes(words, part, starts, ends)
                for k in np.unique(language[a:b]).tolist():
                    h, n = np.unique(hashes[language[a:b][text] == k], return_counts=True)
                    found[k].append((h, n))
                    if len(found[k]) >= 16:
                        found[k] = [total(found[k])]
        for k, parts in enumerate(found):
            if parts:
                h, n = total(parts)
                for at in range(0, len(h), 1 << 16):
                    own = pa.array(n[at : at + (1 << 16)])
                    zero = pa.array(np.zeros(len(own), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)].view(np.int64)), *[own if i == k else zero for i in range(len(names))]], ["word", *names])

    schema = "word long, " + ", ".join(f"{c} long" for c in names)
    found = docs.select("text", "lang").mapInArrow(releasing(run), schema)
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


class Model:
    """Weights of a fitted field."""

    def __init__(self, languages, words, odds, weights, lexicon_weight, bias, transitions, familiar=None):
        self.languages, self.words, self.odds, self.familiar = languages, words, odds, familiar
        self.weights, self.lexicon_weight, self.bias, self.transitions = weights, lexicon_weight, bias, transitions

    def known(self, hashes):
        """Lexicon scores of words; zero for words it lacks."""
        if not len(self.words):
            return np.zeros((len(hashes), len(self.languages)), np.float32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return self.odds[at] * (self.words[at] == hashes)[:, None]

    def emissions(self, words, data, starts, ends):
        """Score of each language for each word."""
        low, size = _LOWER[data], ends - starts
        out = self.known(_word_hashes(words, data, starts, ends)) * self.lexicon_weight + self.bias
        for k in _PREFIX:
            has = size >= k
            out[has] += self.weights[_hash(low, starts[has], k, k)]
        for k in _SUFFIX:
            has = size >= k
            out[has] += self.weights[_hash(low, ends[has] - k, k, 8 + k)]
        for k in _GRAM:
            has = np.flatnonzero(size >= k)
            if len(has):
                count = size[has] - k + 1
                begin = np.cumsum(count) - count
                at = np.repeat(starts[has] - begin, count) + np.arange(int(count.sum()))
                out[has] += np.add.reduceat(self.weights[_hash(low, at, k, 16 + k)], begin, axis=0)
        return out


    def familiarity(self, data, starts, ends):
        """How many features each word has that enough training texts know, and how many in all."""
        low, size = _LOWER[data], ends - starts
        has, all_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for widths, salt, at_end in ((_PREFIX, 0, False), (_SUFFIX, 8, True)):
            for k in widths:
                own = np.flatnonzero(size >= k)
                has[own] += self.familiar[_hash(low, (ends[own] - k) if at_end else starts[own], k, salt + k)]
                all_of[own] += 1
        for k in _GRAM:
            own = np.flatnonzero(size >= k)
            if len(own):
                count = size[own] - k + 1
                begin = np.cumsum(count) - count
                at = np.repeat(starts[own] - begin, count) + np.arange(int(count.sum()))
                has[own] += np.add.reduceat(self.familiar[_hash(low, at, k, 16 + k)].astype(np.int64), begin)
                all_of[own] += count
        return has, all_of


def _potentials(scores):
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def _normal(x, axes=-1):
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def _blocks(scores, counts, transitions):
    """Words dealt into blocks of one text each: their places, potentials and transfer matrices."""
    n, languages = scores.shape
    step = np.exp(transitions - transitions.max())
    blocks = -(-counts // _BLOCK)
    n_blocks = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    block, at = first[text] + inner // _BLOCK, inner % _BLOCK
    m = np.zeros((_BLOCK, n_blocks, languages))
    m[at, block] = _potentials(scores.astype(np.float64))
    used = np.zeros((_BLOCK, n_blocks), bool)
    used[at, block] = True
    carry = np.broadcast_to(np.eye(languages), (n_blocks, languages, languages)).copy()
    for t in range(_BLOCK):
        moved = _normal((carry @ step) * m[t][:, None, :], (-1, -2))
        carry = np.where(used[t][:, None, None], moved, carry)
    return step, blocks, first, block, at, m, used, carry


def transfer(scores, transitions):
    """Message matrix of a run of words of one text, from what enters it to what leaves it."""
    out = np.eye(scores.shape[1])
    if len(scores):
        for matrix in _blocks(scores, np.array([len(scores)]), transitions)[-1]:
            out = _normal(out @ matrix, (-1, -2))
    return out


def marginals(scores, counts, transitions, entering=None, leaving=None):
    """Language probabilities of each word; ``counts``: words of each text, in order.

    The product of a block's transition and emission matrices carries messages across it, so
    texts of any length take few steps. For a segment of one text, ``entering`` and ``leaving``
    are the messages of the words before and after it.
    """
    languages = scores.shape[1]
    step, blocks, first, block, at, m, used, carry = _blocks(scores, counts, transitions)
    n_blocks = len(carry)
    enter, leave = np.full((n_blocks, languages), 1.0 / languages), np.full((n_blocks, languages), 1.0 / languages)
    if entering is not None:
        enter[0] = entering
    if leaving is not None:
        leave[-1] = leaving
    order = np.argsort(-blocks, kind="stable")
    for k in range(1, int(blocks.max(initial=0))):
        long = first[order[: np.searchsorted(-blocks[order], -k, "left")]] + k
        enter[long] = _normal(np.einsum("bi,bij->bj", enter[long - 1], carry[long - 1]))
    for k in range(int(blocks.max(initial=0)) - 2, -1, -1):
        long = first[order[: np.searchsorted(-blocks[order], -(k + 1), "left")]] + k
        leave[long] = _normal(np.einsum("bij,bj->bi", carry[long + 1], leave[long + 1]))
    forward = np.empty_like(m)
    state = enter
    for t in range(_BLOCK):
        state = np.where(used[t][:, None], _normal((state @ step) * m[t]), state)
        forward[t] = state
    state = leave
    for t in range(_BLOCK - 1, -1, -1):
        forward[t] = _normal(forward[t] * state)
        state = np.where(used[t][:, None], _normal((m[t] * state) @ step.T), state)
    return forward[at, block]


def _segments(data, limit):
    """Bounds of pieces of about ``limit`` bytes that end at blanks."""
    bounds = [0]
    while bounds[-1] < len(data):
        stop = min(bounds[-1] + limit, len(data))
        while stop < len(data) and data[stop] != 32 and not 9 <= data[stop] <= 13:
            near = data[stop : stop + limit]
            blank = np.flatnonzero((near == 32) | (near >= 9) & (near <= 13))
            stop += int(blank[0]) if len(blank) else len(near)
        bounds.append(stop)
    return list(zip(bounds[:-1], bounds[1:]))


def fields(model, words, data, offsets):
    """Parts of texts of bounded size with their words' probabilities, exact over whole texts.

    Yields (number of the first text, bytes, offsets, starts, ends, text of each word, probabilities);
    a long text comes in several parts. Parts without words are left out.
    """
    limit = max(FIELD_BYTES * 4 // max(len(model.languages), 4), 1 << 11)
    for a, b in slices(offsets, limit, _FIELD_TEXTS):
        part = data[offsets[a] : offsets[b]]
        if b - a > 1 or len(part) <= limit:
            own = offsets[a : b + 1] - offsets[a]
            starts, ends, text = word_bounds(part, own)
            if len(starts):
                chance = marginals(model.emissions(words, part, starts, ends), np.bincount(text, minlength=b - a), model.transitions)
                yield a, part, own, starts, ends, text, chance
            continue
        bounds = _segments(part, limit)

        def scores(k):
            piece = part[bounds[k][0] : bounds[k][1]]
            own = np.array([0, len(piece)])
            starts, ends, text = word_bounds(piece, own)
            return piece, own, starts, ends, text, model.emissions(words, piece, starts, ends)

        across = [transfer(scores(k)[-1], model.transitions) for k in range(len(bounds))]
        leaving = [np.full(len(model.languages), 1.0 / len(model.languages))]
        for matrix in across[:0:-1]:
            leaving.append(_normal(matrix @ leaving[-1]))
        entering = leaving[0]
        for k, leave in enumerate(leaving[::-1]):
            piece, own, starts, ends, text, emission = scores(k)
            if len(starts):
                yield a, piece, own, starts, ends, text, marginals(emission, np.array([len(starts)]), model.transitions, entering, leave)
            entering = _normal(entering @ across[k])


def familiar_features(n_lang, data, starts, ends, text, labels):
    """Whether enough texts of some language have each feature; ``labels``: one language number a text."""
    counts = np.zeros((1 << BITS, n_lang), np.int32)
    cuts = np.searchsorted(text, np.arange(len(labels) + 1))
    for a, b, k in zip(cuts[:-1], cuts[1:], labels):
        if b > a:
            counts[np.unique(features(data, starts[a:b], ends[a:b])[1]), k] += 1
    least = np.maximum(np.bincount(labels, minlength=n_lang) * _KNOWN_TEXTS, 2)
    return (counts >= least).any(axis=1)


def _train(languages, words, odds, texts, labels, seed=7):
    """Weights by gradient ascent on the log-likelihood of code-switched sequences of sampled spans."""
    rng, n_lang = np.random.default_rng(seed), len(languages)
    data, offsets = byte_view(pa.array(texts))
    starts, ends, text = word_bounds(data, offsets)
    if not len(starts):
        return Model(languages, words, odds, np.zeros((1 << BITS, n_lang), np.float32), 1.0, np.zeros(n_lang, np.float32), np.eye(n_lang) * 4)
    label = np.array(labels)[text]
    by_language = [np.flatnonzero(label == k) for k in range(n_lang)]
    present = [k for k in range(n_lang) if len(by_language[k])]
    rows = np.empty((_SEQUENCES, _LENGTH), np.int64)
    for r in range(_SEQUENCES):
        at = 0
        while at < _LENGTH:
            own = by_language[rng.choice(present)]
            size = min(1 + rng.geometric(1 / _SPAN), _LENGTH - at)
            begin = rng.integers(len(own))
            rows[r, at : at + size] = np.take(own, range(begin, begin + size), mode="wrap")
            at += size
    gold = label[rows]
    used, where = np.unique(rows, return_inverse=True)
    where = where.reshape(rows.shape)
    word, feature = features(data, starts[used], ends[used])
    lexicon = np.zeros((len(used), n_lang), np.float32)
    model = Model(languages, words, odds, None, 1.0, None, None)
    lexicon = model.known(_word_hashes(Words(), data, starts[used], ends[used]))
    weights, bias, alpha, moves = np.zeros((1 << BITS, n_lang)), np.zeros(n_lang), 1.0, np.zeros((n_lang, n_lang))
    seen = [np.full(x.shape, 1e-6) for x in (weights, bias, np.zeros(1), moves)]
    hot = np.eye(n_lang)[gold]
    for _ in range(_ROUNDS):
        emission = np.stack([np.bincount(word, weights[feature, k], len(used)) for k in range(n_lang)], axis=1) + lexicon * alpha + bias
        m, step = _potentials(emission[where]), np.exp(moves - moves.max())
        alphas, betas = np.empty_like(m), np.ones_like(m)
        state = _normal(m[:, 0])
        alphas[:, 0] = state
        for t in range(1, _LENGTH):
            state = _normal((state @ step) * m[:, t])
            alphas[:, t] = state
        for t in range(_LENGTH - 2, -1, -1):
            betas[:, t] = _normal((m[:, t + 1] * betas[:, t + 1]) @ step.T)
        gap = hot - _normal(alphas * betas)
        after = m[:, 1:] * betas[:, 1:]
        mass = ((alphas[:, :-1] @ step) * after).sum(axis=-1, keepdims=True)
        pair = step * ((alphas[:, :-1] / np.maximum(mass, 1e-300)).reshape(-1, n_lang).T @ after.reshape(-1, n_lang))
        by_word = np.stack([np.bincount(where.ravel(), gap[:, :, k].ravel(), len(used)) for k in range(n_lang)], axis=1)
        slopes = [
            np.stack([np.bincount(feature, by_word[word, k], 1 << BITS) for k in range(n_lang)], axis=1) - _PENALTY * rows.size * weights,
            by_word.sum(axis=0),
            np.array([(by_word * lexicon).sum()]),
            hot[:, :-1].reshape(-1, n_lang).T @ hot[:, 1:].reshape(-1, n_lang) - pair,
        ]
        steps = []
        for s, past in zip(slopes, seen):
            past += s**2
            steps.append(_RATE * s / np.sqrt(past))
        weights, bias, alpha, moves = weights + steps[0], bias + steps[1], alpha + float(steps[2][0]), moves + steps[3]
    once = sorted({t: i for i, t in enumerate(texts)}.values())
    known_data, known_offsets = byte_view(pa.array([texts[i] for i in once]))
    bounds = word_bounds(known_data, known_offsets)
    familiar = familiar_features(n_lang, known_data, *bounds, np.array(labels)[once])
    return Model(languages, words, odds, weights.astype(np.float32), np.float32(alpha), bias.astype(np.float32), moves, familiar)


def fit(docs, lang_col="lang", text_col="text", id_col="doc_id"):
    """Model learned from the labelled rows of ``docs``; pass only the documents that may be learned from."""
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = train.where("text IS NOT NULL AND lang IS NOT NULL")
    sized = F.octet_length("text") <= TRAIN_BYTES
    found = train.groupBy("lang").agg(F.count(F.when(sized, 1)).alias("n")).collect()  # a row per language
    languages = sorted(r.lang for r in found)
    if not languages:
        return None
    counts = lexicon_counts(train, languages)
    columns = [F.col(f"c{i}") for i in range(len(languages))]
    total = F.aggregate(F.array(*columns), F.lit(0).cast("long"), lambda a, n: a + n)
    counts = materialize(counts.withColumn("n", total).where("n > 1"), "words")
    lexicon = most_frequent(counts, LEXICON_WORDS).toPandas()  # at most LEXICON_WORDS rows
    n = lexicon[[f"c{i}" for i in range(len(languages))]].to_numpy(float)
    rate = (n + 0.5) / (n.sum(axis=0) + 0.5 * max(len(n), 1))
    odds = np.log(rate) - np.log(rate).mean(axis=1, keepdims=True)
    hashes = lexicon.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    share = max(MAX_TRAIN // len(languages), 8)
    below = [(r.lang, (1 << 30) if r.n <= share else int((1 << 30) * share * 0.95 / r.n)) for r in found]
    below = train.sparkSession.createDataFrame(below, "lang string, below long")
    chosen = train.where(sized).join(F.broadcast(below), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("below"))
    # Repeated ids would all be chosen together: one row of each.
    rows = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).limit(2 * share * len(languages)).collect()
    number = {x: i for i, x in enumerate(languages)}
    rows.sort(key=lambda r: (r.lang, str(r.doc_id)))
    return _train(languages, hashes[order], odds[order].astype(np.float32), [r.text for r in rows], [number[r.lang] for r in rows])


def predict(docs, model, text_col="text"):
    """``docs`` with ``lang_pred`` and ``lang_score``, the mean probability of that language."""
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("lang_score", F.lit(0.0))

    def prepare():
        words, names = Words(), [*model.languages, UNKNOWN]

        def run(texts):
            data, offsets = byte_view(texts)
            total, lettered = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), bool)
            for a, part, own, _, _, text, chance in fields(model, words, data, offsets):
                filled, begin = np.unique(text, return_index=True)
                total[a + filled] += np.add.reduceat(chance, begin, axis=0)
                ascii_letter = np.add.reduceat(~_GAP[part] & (part < 128), own[filled]) > 0
                lettered[a + filled[ascii_letter]] = True
                for k in filled[~ascii_letter & ~lettered[a + filled]].tolist():
                    lettered[a + k] = any(c.isalpha() for c in part[own[k] : own[k + 1]].tobytes().decode())
            mean = _normal(total)
            best, share = np.where(lettered, mean.argmax(axis=1), len(model.languages)), np.where(lettered, mean.max(axis=1), 0)
            return pa.StructArray.from_arrays([pa.array([names[k] for k in best], pa.string()), pa.array(np.clip(share, 0, 1))], ["lang_pred", "score"])

        return run

    found = docs.withColumn("_lang", column_udf(prepare, "lang_pred string, score double")(F.col(text_col)))
    return found.withColumns({"lang_pred": F.col("_lang.lang_pred"), "lang_score": F.col("_lang.score")}).drop("_lang")


def judge(docs, model, text_col="text", lang_col="lang"):
    """``docs`` with ``lang_words``, ``lang_share`` and ``lang_known``, over the words that touch no digit.

    ``lang_share`` is the mean probability of the document's ``lang``, or of the likeliest language
    if the field doesn't know that one; ``lang_known`` the share of the words' features that are known.
    """

    def prepare():
        words = Words()

        def run(texts):
            data, offsets = byte_view(texts)
            n, shares = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)))
            known, features_of = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for a, part, own, starts, ends, text, chance in fields(model, words, data, offsets):
                # Runs of letters inside numbers, keys and digests are no words.
                digit = np.concatenate([(part >= 48) & (part < 58), [False]])
                before = digit[starts - 1] & (starts > own[text])
                after = digit[ends] & (ends < own[text + 1])
                good = np.flatnonzero(~(before | after))
                if not len(good):
                    continue
                filled, begin = np.unique(text[good], return_index=True)
                n[a + filled] += np.diff(np.append(begin, len(good)))
                shares[a + filled] += np.add.reduceat(chance[good], begin, axis=0)
                if model.familiar is not None:
                    has, all_of = model.familiarity(part, starts[good], ends[good])
                    known[a + filled] += np.add.reduceat(has, begin)
                    features_of[a + filled] += np.add.reduceat(all_of, begin)
            shares, known = _normal(shares), np.where(features_of, known / np.maximum(features_of, 1), 1.0)
            ends_at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(model.languages))
            share = pa.ListArray.from_arrays(ends_at, pa.array(shares.ravel()))
            return pa.StructArray.from_arrays([pa.array(n), share, pa.array(known)], ["words", "shares", "known"])

        return run

    found = docs.withColumn("_judged", column_udf(prepare, "words long, shares array<double>, known double")(F.col(text_col)))
    names, shares = F.array(*[F.lit(x) for x in model.languages]), F.col("_judged.shares")
    at = F.array_position(names, F.col(lang_col))
    share = F.when(at > 0, F.get(shares, (at - 1).cast("int"))).otherwise(F.array_max(shares))
    return found.withColumns({"lang_words": F.col("_judged.words"), "lang_share": share, "lang_known": F.col("_judged.known")}).drop("_judged")


def in_one_language(docs, model, text_col="text", lang_col="lang"):
    """Rows with a letter whose words the field finds to be in their language; without a model, all with a letter."""
    lettered = docs.where(F.col(text_col).rlike(r"\p{L}"))
    if model is None:
        return lettered
    judged = judge(lettered, model, text_col, lang_col)
    long = (F.col("lang_share") >= MIN_SHARE) & (F.col("lang_known") >= MIN_KNOWN)
    # With no word that touches no digit there is nothing to judge by.
    short = (F.col("lang_words") == 0) | (F.col("lang_share") >= SURE_OTHER)
    return judged.where(F.when(F.col("lang_words") >= MIN_WORDS, long).otherwise(short)).drop("lang_words", "lang_share", "lang_known")
