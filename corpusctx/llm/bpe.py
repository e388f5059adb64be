"""Byte-level BPE: frequent words from a minimal acyclic transducer, all others merged exactly.

``word_counts`` counts the words of the whole corpus, ``build_lexicon`` compiles the most
frequent ones with their ids into an automaton with shared suffixes, ``Lexicon`` maps that
file into memory, and ``Encoder`` looks words up there and merges the rest by the vocabulary's
ranks. The vocabulary and its merges come from a tokenizer file whose path is a parameter.

Null and empty texts have no ids. Repeated rows give repeated results. A word of any length
is merged exactly; texts longer than a slice are cut only where a run of blanks begins, which
no word crosses.
"""

import json
import re
import unicodedata
import uuid
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import functions as F

from corpusctx.llm.arrow import SLICE_BYTES, byte_view, column_udf, releasing, slices
from corpusctx.llm.bounded import most_frequent
from corpusctx.sources.scratch import materialize, scratch_dir

LEXICON_WORDS = 1 << 17
CACHED_WORDS = 400_000
COUNTED_WORDS = 400_000

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The contractions the pre-tokenizer splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Code points with the Unicode property White_Space.
BLANKS = (
    [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
_NO_PAIR = np.int32(2**31 - 1)


def char_classes():
    """Class of each code point: blank, letter, number or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[BLANKS] = SPACE
    return table


def byte_letters():
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file, as arrays."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token
        self.first = np.array([ids[c] for c in letters], np.int32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.classes = char_classes()

    @classmethod
    def of(cls, state):
        """A vocabulary again from its plain parts, ``vars``: tasks get these, so they need no copy of the package."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def ranks(self, left, right):
        """Rank of each pair of neighbouring ids, ``_NO_PAIR`` where there is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NO_PAIR)


def merge_words(vocabulary, words):
    """Ids of each word (non-empty bytes) by exact merging: all words go one merge further at a time."""
    done = [None] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = vocabulary.first[np.frombuffer(b"".join(words), np.uint8)]
    names = np.arange(len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    ranks = np.full(len(ids), _NO_PAIR)
    if len(ids) > 1:
        ranks[:-1] = vocabulary.ranks(ids[:-1], ids[1:])
    ranks[starts[1:] - 1] = _NO_PAIR
    while len(names):
        best = np.minimum.reduceat(ranks, starts)
        open_words = best != _NO_PAIR
        if not open_words.all():
            ends = np.append(starts[1:], len(ids))
            packed = ids.astype("<u4").tobytes()
            for k in np.flatnonzero(~open_words):
                done[names[k]] = packed[4 * starts[k] : 4 * ends[k]]
            sizes = (ends - starts)[open_words]
            keep = np.repeat(open_words, ends - starts)
            ids, ranks, names, best = ids[keep], ranks[keep], names[open_words], best[open_words]
            starts = np.cumsum(sizes) - sizes
            if not len(names):
                break
        word_of = np.repeat(np.arange(len(names)), np.diff(np.append(starts, len(ids))))
        at = np.flatnonzero(ranks == best[word_of])
        # Of overlapping places, as in "aaa", every second one from the left is merged.
        run_start = np.r_[True, np.diff(at) != 1]
        run = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        ids[at] = vocabulary.merged[ranks[at]]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        removed = np.bincount(word_of[at], minlength=len(names))
        place = at - np.arange(len(at))  # where the merged ids stand once the gaps are closed
        ids, ranks = ids[keep], ranks[keep]
        sizes = np.diff(np.append(starts, len(word_of))) - removed
        starts = np.cumsum(sizes) - sizes
        touched = np.concatenate([place, place[place > 0] - 1])
        inner = touched[touched < len(ids) - 1]
        ranks[touched] = _NO_PAIR
        ranks[inner] = vocabulary.ranks(ids[inner], ids[inner + 1])
        ranks[starts[1:] - 1] = _NO_PAIR
        ranks[-1] = _NO_PAIR
    return done


def split_words(classes, data, offsets):
    """Words of each text of a slice, by the byte-level pre-tokenizer's rules.

    ``data`` holds the UTF-8 bytes of texts that lie between ``offsets``. Returns the words
    of all texts in order, as bytes, and where each text's words start.
    """
    if not len(data):
        return [], np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(at_byte, offsets[:-1][np.diff(offsets) > 0])  # each text's first character
    kind = classes[points]
    n = len(points)
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    text_start[n] = True
    start = text_start[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A run of blanks before a word leaves its last blank: a plain one joins the word, others stand alone.
    blank = kind == SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = blank[:-1] & ~blank[1:] & ~text_start[1:n]
    at = np.flatnonzero(before_word)
    start[at] = True
    start[at[points[at] == 0x20] + 1] = False
    # A contraction splits off where an apostrophe opens a word.
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        ends = np.append(np.flatnonzero(text_start[1:]) + 1, n)
        limit = ends[np.searchsorted(ends, quote, "right")]
        for tail in CONTRACTIONS:
            fits = quote + 1 + len(tail) <= limit
            here = quote[fits]
            for k, letter in enumerate(tail):
                here = here[points[here + 1 + k] == ord(letter)]
            if not len(here):
                continue
            start[here + 1] = False
            after = here + 1 + len(tail)
            inside = after < n
            after = after[inside]
            # What follows the contraction opens a word; only a blank that joins what follows it opens itself.
            start[after] = True
    cuts = at_byte[np.flatnonzero(start)]
    words = np.insert(data, cuts[1:], 0xFF).tobytes().split(b"\xff")
    return words, np.searchsorted(cuts, offsets)


def cut_long(data, offsets, limit=SLICE_BYTES):
    """Offsets with more cuts in long texts, each where a run of blanks begins; and each piece's text."""
    pieces, owner = [0], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > 2 * limit:
            blank = np.flatnonzero(data[a + limit : b] == 0x20)
            before = data[a + limit + blank - 1]
            good = blank[(before < 0x80) & (before > 0x20)]
            if not len(good):
                break
            a += limit + int(good[0])
            pieces.append(a)
            owner.append(k)
        pieces.append(b)
        owner.append(k)
    return np.array(pieces, np.int64), np.array(owner, np.int64)


class Automaton:
    """Minimal acyclic automaton of sorted words, built word by word.

    Each arc carries how many words come before those it leads to, so the sum along a path
    is the word's position: the transducer's output.
    """

    def __init__(self):
        self.arcs, self.final, self.known, self.path = [{}], [False], {}, []
        self.last = b""

    def _share(self, down_to):
        while len(self.path) > down_to:
            parent, byte, state = self.path.pop()
            shape = (self.final[state], tuple(self.arcs[state].items()))
            self.arcs[parent][byte] = self.known.setdefault(shape, state)

    def add(self, word):
        common = 0
        while common < min(len(word), len(self.last)) and word[common] == self.last[common]:
            common += 1
        self._share(common)
        state = self.path[-1][2] if self.path else 0
        for byte in word[common:]:
            self.arcs.append({})
            self.final.append(False)
            new = len(self.arcs) - 1
            self.arcs[state][byte] = new
            self.path.append((state, byte, new))
            state = new
        self.final[state] = True
        self.last = word

    def arrays(self):
        """Arc keys (state, byte) in order, their targets and outputs, and which states end a word."""
        self._share(0)
        words, number, order = {}, {0: 0}, [0]
        stack = [(0, False)]
        while stack:
            state, ready = stack.pop()
            if state in words:
                continue
            if ready:
                words[state] = self.final[state] + sum(words[t] for t in self.arcs[state].values())
            else:
                stack.append((state, True))
                stack.extend((t, False) for t in self.arcs[state].values() if t not in words)
        for state in order:  # grows while it is read
            for target in self.arcs[state].values():
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
        keys, targets, outputs = [], [], []
        for state in order:
            before = int(self.final[state])
            for byte, target in sorted(self.arcs[state].items()):
                keys.append(number[state] << 8 | byte)
                targets.append(number[target])
                outputs.append(before)
                before += words[target]
        return (
            np.array(keys, np.int64),
            np.array(targets, np.int32),
            np.array(outputs, np.int32),
            np.array([self.final[s] for s in order], np.bool_),
        )


_PARTS = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.bool_), ("spans", np.int64), ("ids", np.uint32))


def pack_lexicon(vocabulary, words):
    """The file of a lexicon: part sizes, the automaton's arrays, and the ids of each word."""
    words = sorted({w for w in words if w})
    automaton = Automaton()
    for word in words:
        automaton.add(word)
    ids = merge_words(vocabulary, words) if words else []
    spans = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int64)
    parts = [*automaton.arrays(), spans, np.frombuffer(b"".join(ids), np.uint32)]
    packed = [np.array([len(p) for p in parts], np.int64).tobytes()]
    for part in parts:
        raw = part.tobytes()
        packed.append(raw + bytes(-len(raw) % 8))
    return b"".join(packed)


class Lexicon:
    """A packed lexicon, mapped into memory."""

    def __init__(self, path):
        raw = np.memmap(path, np.uint8, "r")
        sizes = raw[: 8 * len(_PARTS)].view(np.int64)
        at = 8 * len(_PARTS)
        for (name, kind), size in zip(_PARTS, sizes.tolist()):
            length = size * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + length].view(kind))
            at += length + -length % 8

    def find(self, words):
        """Ids of each word as packed bytes, None where the lexicon lacks it."""
        found = [None] * len(words)
        if not len(self.keys):
            return found
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        alive, state, index, depth = np.flatnonzero(sizes), None, None, 0
        state = np.zeros(len(alive), np.int64)
        index = np.zeros(len(alive), np.int64)
        while len(alive):
            keys = state << 8 | data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ok = self.keys[at] == keys
            alive, at = alive[ok], at[ok]
            state, index = self.targets[at].astype(np.int64), index[ok] + self.outputs[at]
            depth += 1
            ended = sizes[alive] == depth
            for k, i in zip(alive[ended & self.final[state]].tolist(), index[ended & self.final[state]].tolist()):
                found[k] = self.ids[self.spans[i] : self.spans[i + 1]].tobytes()
            alive, state, index = alive[~ended], state[~ended], index[~ended]
        return found


class Encoder:
    """Texts to ids and back. ``lexicon`` may be None: then every word is merged."""

    def __init__(self, vocabulary, lexicon=None, cached=CACHED_WORDS):
        self.vocabulary, self.lexicon, self.cached, self.known = vocabulary, lexicon, cached, {}

    def _learn(self, words):
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > self.cached:
            self.known = {}
            new = list(set(words))
        if not new:
            return
        found = self.lexicon.find(new) if self.lexicon else [None] * len(new)
        self.known.update((w, i) for w, i in zip(new, found) if i is not None)
        rest = [w for w, i in zip(new, found) if i is None]
        if rest:
            self.known.update(zip(rest, merge_words(self.vocabulary, rest)))

    def _plain(self, data, offsets):
        words, starts = split_words(self.vocabulary.classes, data, offsets)
        self._learn(words)
        ids = list(map(self.known.__getitem__, words))
        starts = starts.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(starts, starts[1:])]

    def _with_special(self, text):
        """Ids of one text that may hold special tokens, any number of them."""
        special = self.vocabulary.special
        parts = re.split(b"(" + b"|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + b")", text)
        offsets = np.cumsum([0, *map(len, parts[::2])])
        plain = self.encode_bytes(np.frombuffer(b"".join(parts[::2]), np.uint8), offsets, plain=True)
        marks = [np.uint32(special[t]).tobytes() for t in parts[1::2]]
        return b"".join(x for pair in zip(plain, [*marks, b""]) for x in pair)

    def encode_bytes(self, data, offsets, plain=False):
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        special = None
        if not plain and any(s in data.tobytes() for s in self.vocabulary.special):
            special = [i for i in range(len(offsets) - 1) if any(s in data[offsets[i] : offsets[i + 1]].tobytes() for s in self.vocabulary.special)]
        pieces, owner = cut_long(data, offsets)
        out = [[] for _ in range(len(offsets) - 1)]
        for a, b in slices(pieces):
            part = data[pieces[a] : pieces[b]]
            for k, ids in zip(owner[a:b].tolist(), self._plain(part, pieces[a : b + 1] - pieces[a])):
                out[k].append(ids)
        out = [b"".join(p) for p in out]
        for i in special or ():
            out[i] = self._with_special(data[offsets[i] : offsets[i + 1]].tobytes())
        return out

    def encode(self, array):
        """Packed ids of each text of an Arrow string array, slice by slice."""
        data, offsets = byte_view(array)
        for a, b in slices(offsets):
            yield from self.encode_bytes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def decode(self, ids):
        """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, np.uint32).tolist()]).decode("utf-8", "replace")


def word_counts(docs, vocabulary, text_col="text"):
    """How often each word occurs in all texts: (word binary, n long)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # as large as the vocabulary file

    def count(batches):
        classes, counts = shared.value["classes"], Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            data, offsets = byte_view(batch.column(0))
            pieces, _ = cut_long(data, offsets)
            for a, b in slices(pieces):
                part = data[pieces[a] : pieces[b]]
                counts.update(split_words(classes, part, pieces[a : b + 1] - pieces[a])[0])
                if len(counts) > COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(releasing(count), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs, vocabulary, text_col="text", max_words=LEXICON_WORDS):
    """Compile the ``max_words`` most frequent words of the corpus; returns the shared file's name for the workers.

    At most ``max_words`` words of at most 64 bytes come to the driver; the file is written to
    the session's shared folder, from which Spark hands it to every executor, also to later ones.
    """
    spark = docs.sparkSession
    counts = word_counts(docs, vocabulary, text_col).where((F.col("n") > 1) & (F.octet_length("word") <= 64))
    top = most_frequent(materialize(counts, "words"), max_words).collect()
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm, target = spark.sparkContext._jvm, f"{scratch_dir(spark)}/{name}"
    path = jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(pack_lexicon(vocabulary, [bytes(r.word) for r in top])))
    finally:
        stream.close()
    spark.sparkContext.addFile(target)
    return name


def _encoder(shared, lexicon_file):
    return Encoder(Vocabulary.of(shared.value), Lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None)


def encode_texts(docs, vocabulary, lexicon_file=None, text_col="text", ids_col="ids"):
    """``docs`` with the packed ids of each text in ``ids_col``; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def prepare():
        encoder = _encoder(shared, lexicon_file)
        return lambda texts: pa.array(encoder.encode(texts), pa.binary())

    return docs.withColumn(ids_col, column_udf(prepare, "binary")(F.col(text_col)))


def decode_ids(df, vocabulary, ids_col="ids", text_col="decoded"):
    """``df`` with the text of the packed ids; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def prepare():
        encoder = Encoder(Vocabulary.of(shared.value))
        return lambda ids: pa.array((encoder.decode(i.as_py() or b"") for i in ids), pa.string())

    return df.withColumn(text_col, column_udf(prepare, "string")(F.col(ids_col)))


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs, vocabulary, lexicon_file=None, text_col="text"):
    """``docs`` with ``round_trip``: how many ids each text has, and digests of the ids and of the text decoded from them.

    Encoding and decoding happen in one pass, so the ids themselves never leave the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def prepare():
        encoder = _encoder(shared, lexicon_file)
        shown = [b"%d" % i for i in range(len(shared.value["tokens"]))]

        def digest(ids):
            numbers = np.frombuffer(ids, np.uint32).tolist()
            decimal = b",".join([shown[i] for i in numbers])
            return len(numbers), sha256(decimal).hexdigest(), sha256(encoder.decode(ids).encode()).hexdigest()

        def run(texts):
            columns = list(zip(*map(digest, encoder.encode(texts)))) or [[], [], []]
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, DIGEST)], fields=list(DIGEST))

        return run

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.withColumn("round_trip", column_udf(prepare, kind)(F.col(text_col)))
