"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers, A (byte-level BPE, of a space and the text) and B (sentence pieces, which put
the space in front themselves), cut the same bytes at different places. The sorted ends of A's
and of B's tokens form a merge path; diagonals at equal distances, each placed by a binary search,
divide it into pieces of equal work that are merged independently. Each piece emits the ends that
A and B share; an end whose A and B fall on two sides of a border is stitched there. Shared ends cut the tokens into groups, and each of
them links an A token to a B token.

Long texts go by in parts that start at a space after a character that is no blank: no token of
either side crosses such a place. Ids, groups and links of a document are made once and written
with packed links. Counts of id pairs cover the whole corpus. The two ids of a pair end with the same bytes,
so there are at most ``pair_bound`` pairs, whatever the corpus: that is the size of what is broadcast.

Null and empty texts, and texts that either side does not give back byte by byte (such as those
with U+2581, which B reads as a space), have no tokens: zeros and an empty digest. Strings of special tokens are
plain text. Repeated rows count as often as they stand. Only id and text are read; an empty
table gives no rows.
"""

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from corpusctx.llm.arrow import byte_view
from corpusctx.llm.bpe import Vocabulary
from corpusctx.llm.encoders import ByteEncoder, cut
from corpusctx.sources.scratch import materialize

#: Characters of a part of a long text, and of the parts that are aligned at once.
PART, TOGETHER = 1 << 15, 1 << 17
#: Merge steps of a piece.
WORK = 1 << 12
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def piece_bytes(model):
    """Bytes of each piece of a sentence-piece model (given as bytes); None for what stands for no text."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = []
    for i in range(pieces.get_piece_size()):
        byte = _BYTE.fullmatch(pieces.id_to_piece(i)) if pieces.is_byte(i) else None
        if byte:
            out.append(bytes([int(byte[1], 16)]))
        else:
            out.append(None if pieces.is_control(i) or pieces.is_unknown(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
    return out


def pair_bound(tokens_a, tokens_b):
    """How many id pairs can end together at most: one token's bytes must end the other's."""

    def endings(tokens):
        count = {}
        for t in tokens:
            if t:
                count[t] = count.get(t, 0) + 1
        return count

    a, b = endings(tokens_a), endings(tokens_b)
    shorter = sum(n * sum(b.get(t[k:], 0) for k in range(len(t))) for t, n in a.items())
    return shorter + sum(n * sum(a.get(t[k:], 0) for k in range(1, len(t))) for t, n in b.items())


def diagonals(a, b, work=WORK):
    """Places (i, j) on the merge path of two sorted arrays, ``work`` steps apart; of equal values a's comes first."""
    at = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (low < high).any():
        open_ = low < high
        mid = (low + high) // 2
        other = np.where(open_, at - 1 - mid, 0)
        further = open_ & (a[np.where(open_, mid, 0)] <= b[other]) if len(a) and len(b) else open_ & False
        low, high = np.where(further, mid + 1, low), np.where(open_ & ~further, mid, high)
    return low, at - low


def shared_ends(a, b, work=WORK):
    """Row numbers (in a, in b) of values that stand in both sorted arrays, merged piece by piece."""
    i, j = diagonals(a, b, work)
    left, right = [], []
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist()):
        # The pair that the border cuts: a's end was the last step, b's is the first one here.
        if i0 and j0 < len(b) and a[i0 - 1] == b[j0]:
            left.append(np.array([i0 - 1]))
            right.append(np.array([j0]))
        if i1 > i0 and j1 > j0:
            own, other = a[i0:i1], b[j0:j1]
            at = np.searchsorted(other, own)
            hit = np.flatnonzero(other[np.minimum(at, len(other) - 1)] == own)
            left.append(i0 + hit)
            right.append(j0 + at[hit])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


class _Tokens:
    """Token bytes laid end to end, and the decimal ids that a digest is made of."""

    def __init__(self, tokens, last):
        self.lengths = np.array([len(t or b"") for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        self.inner = np.array([f"{i}," for i in range(len(tokens))], object)
        self.outer = np.array([f"{i}{last}" for i in range(len(tokens))], object)

    def spell(self, ids):
        """All bytes of a run of tokens, and where each token ends."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.data[at], ends


class Aligner:
    """Aligns the two tokenizations of texts."""

    def __init__(self, tokens_a, model):
        tokens_b = piece_bytes(model)
        self.a, self.b = _Tokens(tokens_a, "|"), _Tokens(tokens_b, ";")
        self.bytes_of = ByteEncoder(tokens_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n_b = len(tokens_b)
        # Parts may start at a space if no piece has one behind another character.
        self.cuts = not any(t and b" " in t.lstrip(b" ") for t in tokens_b)

    def parts(self, text):
        whole = " " + text
        return cut(whole, PART) if self.cuts else iter([whole])

    def align(self, parts):
        """(n_a, n_b, packed pairs, digest text) of each part, None for one that a side does not give back."""
        ids_a = [self.bytes_of.encode(p) for p in parts]
        ids_b = [np.array(x, np.int64) for x in self.pieces.encode([p[1:] for p in parts], num_threads=1)]
        count_a, count_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        own = [p.encode() for p in parts]
        sizes = np.array([len(x) for x in own], np.int64)
        good = np.ones(len(parts), bool)
        for side, ids, counts in ((self.a, ids_a, count_a), (self.b, ids_b, count_b)):
            spelt, ends = side.spell(np.concatenate(ids).astype(np.int64))
            stops = np.concatenate([[0], ends])[np.cumsum(counts)]
            same = np.diff(np.concatenate([[0], stops])) == sizes
            if not (same.all() and spelt.tobytes() == b"".join(own)):
                starts = np.concatenate([[0], stops[:-1]])
                good &= [bool(s) and spelt[x:y].tobytes() == o for s, x, y, o in zip(same, starts, stops, own)]
        kept = np.flatnonzero(good)
        out = [None] * len(parts)
        if not len(kept):
            return out
        a, b = (np.concatenate([ids[k] for k in kept]).astype(np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        left, right = shared_ends(ends_a, ends_b)
        pairs = a[left] * self.n_b + b[right]
        # Groups: how many shared ends stand before each token.
        closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        closes_a[left], closes_b[right] = True, True
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = np.where(closes_a, self.a.outer[a], self.a.inner[a])
        shown[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(closes_b, self.b.outer[b], self.b.inner[b])
        shown = shown.tolist()
        stop_a, stop_b = np.cumsum(count_a[kept]), np.cumsum(count_b[kept])
        stop_pair = np.searchsorted(left, stop_a, "left")
        at_a = at_b = at_pair = 0
        for k, x, y, z in zip(kept.tolist(), stop_a.tolist(), stop_b.tolist(), stop_pair.tolist()):
            out[k] = (x - at_a, y - at_b, pairs[at_pair:z], "".join(shown[at_a + at_b : x + y])[:-1].encode())
            at_a, at_b, at_pair = x, y, z
        return out

    def documents(self, texts):
        """(n_a, n_b, packed pairs, digest) of each text, in order; parts of many texts are aligned together."""
        state = None
        for some in _together(self._all_parts(texts)):
            found = iter(self.align([part for part, _, _ in some if part]))
            for part, first, last in some:
                if first:
                    state = [0, 0, [], sha256(), bool(part)]
                own = next(found) if part else None
                if own is None:
                    state[4] = False
                elif state[4]:
                    state[0] += own[0]
                    state[1] += own[1]
                    state[2].append(own[2])
                    state[3].update(own[3] if first else b";" + own[3])
                if last:
                    n_a, n_b, pairs, digest, good = state
                    yield (n_a, n_b, np.concatenate(pairs), digest.hexdigest()) if good else (0, 0, np.zeros(0, np.int64), "")

    def _all_parts(self, texts):
        """(part, whether it is its text's first, its last); None for a text without characters."""
        for text in texts:
            if not text:
                yield None, True, True
                continue
            first, held = True, None
            for part in self.parts(text):
                if held is not None:
                    yield held, first, False
                    first = False
                held = part
            yield held, first, True


def _together(parts):
    """Lists of parts with about ``TOGETHER`` characters in all."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0] or "") + 64
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


_ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def align_texts(docs, path_a, path_b, text_col="text", id_col="doc_id"):
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of each row, written once; ``links``: packed id pairs."""
    context = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(path_a)
    tokens = [b"" if t in vocabulary.special else t for t in vocabulary.tokens]
    with open(path_b, "rb") as file:
        model = file.read()
    shared = context.broadcast((tokens, model))  # as large as the two files
    kind = "<u4" if len(tokens) * len(piece_bytes(model)) <= 1 << 32 else "<u8"

    def run(batches):
        aligner = Aligner(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                found = list(aligner.documents(t.as_py() for t in rows.column(1)))
                n_a, n_b, pairs, digests = zip(*found)
                columns = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([len(p) for p in pairs], pa.int64())]
                packed = pa.array([p.astype(kind).tobytes() for p in pairs], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns, pa.array(digests, pa.string()), packed], _names)

    _names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(chosen.mapInArrow(run, "doc_id long, " + _ALIGNED), "aligned"), kind


def _packed(column, kind):
    """All numbers of a column of packed arrays, and where each row's begin and end."""
    data, offsets = byte_view(column)
    width = np.dtype(kind).itemsize
    return np.frombuffer(data.tobytes(), kind), offsets // width


def pair_counts(aligned, kind):
    """(pair, n): how many links of the whole corpus hold each id pair; at most ``pair_bound`` rows."""

    def run(batches):
        pairs, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            found, n = np.unique(np.concatenate(held).astype(np.int64), return_counts=True) if held else (pairs[:0], counts[:0])
            every, where = np.unique(np.concatenate([pairs, found]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, where, np.concatenate([counts, n]))
            return every, total

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(_packed(batch.column(0).slice(at, 256), kind)[0])
                size += len(held[-1])
                if size >= 1 << 20:
                    pairs, counts = merged()
                    held, size = [], 0
        pairs, counts = merged()
        for at in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs, path_a, path_b, text_col="text", id_col="doc_id"):
    """Alignment of each row with its links' corpus-wide counts.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id),
    count_sum (over links), groups_sha256.
    """
    aligned, kind = align_texts(docs, path_a, path_b, text_col, id_col)
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = pair_counts(aligned, kind).toPandas().sort_values("pair")  # at most pair_bound rows
    pair, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pair % n_b, n)
    shared = docs.sparkSession.sparkContext.broadcast((pair.astype(kind), n, n == highest[pair % n_b]))

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            good, total = [], []
            for at in range(0, batch.num_rows, 256):
                links, bounds = _packed(batch.column(batch.num_columns - 1).slice(at, 256), kind)
                found = np.searchsorted(pair, links)
                for out, values in ((good, best), (total, n)):
                    sums = np.concatenate([[0], np.cumsum(values[found], dtype=np.int64)])
                    out.append(sums[bounds[1:]] - sums[bounds[:-1]])
            good, total = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (good, total))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(good), pa.array(total)], [*batch.schema.names[:-1], "n_best", "count_sum"])

    slim = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"
    out = aligned.mapInArrow(run, slim).withColumn("n_links", F.col("n_groups"))  # an end that both share is one link
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
