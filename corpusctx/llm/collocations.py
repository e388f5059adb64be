"""Phrase collocations by Rabin-Karp fingerprints.

Words become 64-bit hashes; prefix sums of a polynomial over them give the fingerprint of every
n-gram of a text at once. Tasks add equal fingerprints up before the shuffle. Orders go one after
the other: an n-gram is only counted where both (n-1)-grams in it may be frequent, which a bit table of
the frequent fingerprints says (no frequent n-gram is lost, since its parts occur as often).

The frequent fingerprints are then aggregated with pointers to an occurrence (a hash of the text and the byte
where it stands) and with a second, independent fingerprint of all their occurrences. Where these
disagree, different phrases collide, and they are counted again by their words. Texts are read
again for frequent phrases only, at their pointers, and their words must have that fingerprint.

Languages are counted apart; a null ``lang`` is ``und``, and counts with texts whose ``lang`` is that word. Null, empty and
wordless texts have no phrases. Repeated rows count as often as they stand. Only text and
language are read. Texts of any length go by in segments that overlap by a phrase less one word.
An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from corpusctx.llm.arrow import byte_view, column_udf, release, releasing, slices
from corpusctx.llm.shingles import Words, mix
from corpusctx.sources.scratch import materialize

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
SEGMENT = 1 << 19
#: Entries a task takes in before it adds equal fingerprints up; it sends what it holds at one and a half times as many.
_PENDING = 1 << 19
#: Bits of a table of fingerprints: 32 for each, between these bounds. A full table only prunes less.
_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 26
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _SEPARATES.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = bytes([*range(65), *range(97, 123), *range(91, 256)])
_SIDES = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0xD1342543DE82EF95, 0x9FB21C651E98DF25)]
UNKNOWN = "und"


class _Grams:
    """Words of a run of texts and the fingerprints of their n-grams."""

    def __init__(self, tables, data, offsets, salts, width):
        self.offsets = offsets
        gap = _GAP[data]
        word = ~gap
        start, end = word.copy(), word.copy()
        start[1:] &= gap[:-1]
        end[:-1] &= gap[1:]
        filled = np.diff(offsets) > 0
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        start[first], end[last] = word[first], word[last]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        # Words of one piece have the same number of separators, and texts, in front of them.
        self.piece = np.cumsum(_SEPARATES[data])[self.starts] + self.text if len(data) else self.starts
        hashes = tables.spans(data, self.starts, self.ends)
        self.salts, self.width = salts[self.text], width
        self.sums = []
        for k, (base, inverse) in enumerate(_SIDES):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(hashes) - 1, 0), base)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(hashes) - 1, 0), inverse)]), dtype=np.uint64)
            own = mix(hashes, k + 1)
            self.sums.append((np.concatenate([[np.uint64(0)], np.cumsum(own * up[: len(own)], dtype=np.uint64)]), down))

    def whole(self, n):
        """Where n-grams of one piece begin."""
        if len(self.starts) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1])

    def prints(self, at, n, side=0):
        """Fingerprints of the n-grams that begin at these words."""
        sums, down = self.sums[side]
        h = mix((sums[at + n] - sums[at]) * down[at] + self.salts[at], n + 16 * side)
        h = h >> np.uint64(64 - self.width) if n and side == 0 and self.width < 64 else h
        return h.view(np.int64)


def _lower(data):
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def _all_grams(batch, tables, width, longest):
    """(grams, first text, first byte, first new word) of the texts (key, salt, text) of a batch, in bounded segments."""
    data, offsets = byte_view(batch.column(2))
    salts = batch.column(1).to_numpy().view(np.uint64)
    for a, b in slices(offsets, SEGMENT):
        part = data[offsets[a] : offsets[b]]
        if b - a > 1 or len(part) <= SEGMENT:
            yield _Grams(tables, _lower(part), offsets[a : b + 1] - offsets[a], salts[a:b], width), a, 0, 0
            continue
        at = new = 0
        while new < len(part):
            stop = min(new + SEGMENT, len(part))
            while stop < len(part) and not _GAP[part[stop]]:
                gap = np.flatnonzero(_GAP[part[stop : stop + SEGMENT]])
                stop = min(stop + (int(gap[0]) if len(gap) else SEGMENT), len(part))
            grams = _Grams(tables, _lower(part[at:stop]), np.array([0, stop - at]), salts[a:b], width)
            yield grams, a, at, int(np.searchsorted(grams.starts, new - at))
            # The next segment begins with the words that a phrase across the border may need.
            overlap = min(longest - 1, len(grams.starts))
            at, new = at + int(grams.starts[len(grams.starts) - overlap]) if overlap else stop, stop


class _Totals:
    """Entries of equal fingerprints, added up now and then.

    Columns: fingerprint, n, and, if pointed, lowest and highest second fingerprint, key and byte of an occurrence.
    """

    def __init__(self, names, size):
        self.names, self.size = names, size
        self.held, self.pending = [], 0

    def add(self, *columns):
        self.held.append(columns)
        self.pending += len(columns[0])

    def merged(self):
        columns = list(zip(*self.held))
        self.held = []
        for k in range(len(columns)):  # one column at a time is held twice
            columns[k] = np.concatenate(columns[k])
        prints, n, *more = columns
        del columns
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        out = [prints[first]]
        del prints
        out.append(np.add.reduceat(n[order], first))
        if more:
            low, high, key, at = more
            out += [np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), key[order[first]], at[order[first]]]
        self.held, self.pending = [out], 0
        return out

    def batches(self, done=False):
        if not self.held or not done and self.pending < self.size:
            return
        out = self.merged()
        if done or 2 * len(out[0]) >= 3 * self.size:
            self.held = []
            for k in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in out], self.names)


def _table_of(df, column="fp"):
    """Bits set for the values of a column: bounded bytes, made by the tasks, held by the driver."""
    bits = _LEAST_BITS
    n = df.count()
    while bits < _MOST_BITS and bits < 32 * n:
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = df.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return df.sparkSession.sparkContext.broadcast(table.tobytes())


def _bits(shared):
    """The table as it was sent: 8 bits a byte."""
    return np.frombuffer(shared.value, np.uint8)


def _in_table(bits, prints):
    at = prints & np.int64(8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)


def _counted(texts, order, before, width, longest):
    """(fp, n) of all n-grams of one order that may be frequent."""

    def run(batches):
        tables, totals, bits = Words(), _Totals(["fp", "n"], _PENDING), None if before is None else _bits(before)
        for batch in batches:
            for grams, _, _, new in _all_grams(batch, tables, width, longest):
                at = grams.whole(order)
                at = at[at + order - 1 >= new]
                if bits is not None and len(at):
                    at = at[_in_table(bits, grams.prints(at, order - 1)) & _in_table(bits, grams.prints(at + 1, order - 1))]
                if len(at):
                    totals.add(grams.prints(at, order), np.ones(len(at), np.int64))
                yield from totals.batches()
            release()
        yield from totals.batches(done=True)

    return texts.mapInArrow(releasing(run), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


def _pointed(texts, frequent, width, longest):
    """(words, fp, n, low, high, key, at) of the n-grams in the bit tables; order 0 counts the words of each language.

    All occurrences of a fingerprint hold the same phrase or are told apart by ``low`` and ``high``, so any pointer does.
    """

    def run(batches):
        tables, bits = Words(), [_bits(f) for f in frequent]
        names = ["fp", "n", "low", "high", "key", "at"]
        totals = [_Totals(names, _PENDING // 4) for _ in range(longest + 1)]

        def out(done=False):
            for order, own in enumerate(totals):
                for b in own.batches(done):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, order, np.int32)), *b.columns], ["words", *names])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for grams, first, begin, new in _all_grams(batch, tables, width, longest):
                for order in range(longest + 1):
                    if order:
                        at = grams.whole(order)
                        at = at[at + order - 1 >= new]
                        prints = grams.prints(at, order)
                        hit = _in_table(bits[order - 1], prints)
                        at, prints = at[hit], prints[hit]
                        n, place = np.ones(len(at), np.int64), begin + grams.starts[at] - grams.offsets[grams.text[at]]
                    else:
                        count = np.bincount(grams.text[new:])
                        text = np.flatnonzero(count)
                        at, n, place = np.searchsorted(grams.text, text), count[text], np.zeros(len(text), np.int64)
                        prints = grams.prints(at, 0)
                    if len(at):
                        check = grams.prints(at, order, 1)
                        totals[order].add(prints, n, check, check, keys[first + grams.text[at]], place)
                yield from out()
            release()
        yield from out(done=True)

    found = texts.mapInArrow(releasing(run), "words int, fp long, n long, low long, high long, key long, at long")
    return found.groupBy("words", "fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("key").alias("key"), F.first("at").alias("at"))


def _words_at(body, at, n):
    """Bounds of the n words from byte ``at`` on, or None if the piece has fewer there."""
    bounds = []
    while len(bounds) < n and at < len(body):
        stop = at
        while stop < len(body) and not _GAP[body[stop]]:
            stop += 1
        if stop == at:
            return None
        bounds.append((at, stop))
        at = stop
        while at < len(body) and body[at] in b" \t":
            at += 1
    return bounds if len(bounds) == n else None


def _materialised(texts, pointers, width):
    """(fp, lang, phrase) of each pointer, read from the texts."""
    wanted = _table_of(pointers, "key")

    def prepare():
        bits = _bits(wanted)
        return lambda keys: pa.array(_in_table(bits, keys.to_numpy()))

    # Only texts that some pointer may name move, one of each; pointers of one text are no more than its words.
    near = texts.where(column_udf(prepare, "boolean")(F.col("key"))).groupBy("key").agg(F.first("salt").alias("salt"), F.first("text").alias("text"), F.first("lang").alias("lang"))
    grouped = pointers.groupBy("key").agg(F.collect_list(F.struct("fp", "words", "at")).alias("pointers"))

    def run(batches):
        tables = Words()
        for batch in batches:
            for text, lang, salt, pointers in zip(*(batch.column(k) for k in range(4))):
                body, found = text.as_py().encode().translate(_LOWER), []
                for pointer in pointers.as_py():
                    bounds = _words_at(body, pointer["at"], pointer["words"])
                    if bounds is not None:
                        found.append((pointer["fp"], pointer["words"], b" ".join(body[x:y] for x, y in bounds)))
                if not found:
                    continue
                prints, sizes, phrases = zip(*found)
                prints, sizes = np.array(prints, np.int64), np.array(sizes, np.int64)
                data = np.frombuffer(b".".join(p for p in phrases if p), np.uint8)
                grams = _Grams(tables, data, np.array([0, len(data)]), np.array([salt.as_py()], np.int64).view(np.uint64), width)
                firsts, same = np.cumsum(sizes) - sizes, sizes == 0
                for n in np.unique(sizes[sizes > 0]).tolist():
                    own = np.flatnonzero(sizes == n)
                    same[own] = grams.prints(firsts[own], n) == prints[own]
                names = pa.array([p.decode() for p in phrases]).filter(pa.array(same))
                yield pa.RecordBatch.from_arrays([pa.array(prints[same]), pa.array([lang.as_py()] * len(names), pa.string()), names], ["fp", "lang", "phrase"])

    joined = near.join(grouped, "key").select("text", "lang", "salt", "pointers")
    return joined.mapInArrow(releasing(run), "fp long, lang string, phrase string")


def _recounted(texts, collided, width, longest):
    """(lang, words, phrase, n) of all phrases whose fingerprint collides, counted by their words."""
    orders = [r.words for r in collided.select("words").distinct().collect()]  # LONGEST at most
    table = _table_of(collided)

    def run(batches):
        tables, bits = Words(), _bits(table)
        for batch in batches:
            langs = batch.column(3).to_pylist()
            body = byte_view(batch.column(2))[0].tobytes().translate(_LOWER)
            offsets = byte_view(batch.column(2))[1]
            counts = {}
            for grams, first, begin, new in _all_grams(batch, tables, width, longest):
                for order in orders:
                    at = grams.whole(order)
                    at = at[at + order - 1 >= new]
                    prints = grams.prints(at, order)
                    hit = _in_table(bits, prints)
                    for k, fp in zip(at[hit].tolist(), prints[hit].tolist()):
                        base = int(offsets[first]) + begin
                        phrase = b" ".join(body[base + x : base + y] for x, y in zip(grams.starts[k : k + order].tolist(), grams.ends[k : k + order].tolist()))
                        key = (fp, langs[first + int(grams.text[k])], order, phrase.decode())
                        counts[key] = counts.get(key, 0) + 1
            if counts:
                columns = [*zip(*counts), list(counts.values())]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["fp", "lang", "words", "phrase", "n"])

    found = texts.mapInArrow(releasing(run), "fp long, lang string, words int, phrase string, n long")
    return found.join(collided.select("fp", "words"), ["fp", "words"], "left_semi").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs, min_count=MIN_COUNT, longest=LONGEST, text_col="text", lang_col="lang", width=64):
    """(lang, words, phrase, n) of all phrases of up to ``longest`` words with ``min_count`` occurrences, written once.

    ``words`` = 0, with an empty phrase, holds the number of all words of a language. ``width``: bits of a fingerprint.
    """
    lang, text = F.coalesce(F.col(lang_col), F.lit(UNKNOWN)), F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.xxhash64(lang, text).alias("key"), F.xxhash64(lang).alias("salt"), text.alias("text"), lang.alias("lang"))
    slim = named.select("key", "salt", "text")
    counts, frequent = None, []
    for order in range(1, longest + 1):
        level = materialize(_counted(slim, order, frequent[-1] if frequent else None, width, longest).where(F.col("n") >= min_count), f"grams{order}")
        frequent.append(_table_of(level))
        level = level.withColumn("words", F.lit(order))
        counts = level if counts is None else counts.union(level)
    pointed = materialize(_pointed(slim, frequent, width, longest), "pointed")
    every = pointed.where("words > 0").drop("n").join(counts, ["words", "fp"])
    # Most corpora have none: then nothing is read again.
    collided = materialize(every.where("low != high").select("fp", "words"), "collided")
    columns = ["fp", "words", "n", "key", "at"]
    sound = materialize(every.where("low = high").select(columns).union(pointed.where("words = 0").select(columns)), "sound")
    phrases = _materialised(named, sound, width)
    found = sound.join(phrases.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))), ["fp", "words"])
    found = found.select("lang", "words", "phrase", "n")
    if collided.isEmpty():
        return materialize(found, "phrases")
    again = _recounted(named, collided, width, longest).where(F.col("n") >= min_count).select("lang", "words", "phrase", "n")
    return materialize(found.union(again), "phrases")


def collocations(docs, min_count=MIN_COUNT, longest=LONGEST, top=TOP, percent=100, text_col="text", lang_col="lang", width=64):
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut, ``n`` all words, and
    ``score`` is floor(1000 a n / (l r)), in exact arithmetic. A phrase inside a longer one that occurs
    at least ``percent`` % as often is dropped.
    """
    counts = phrase_counts(docs, min_count, longest, text_col, lang_col, width)
    phrases = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", *[
        F.array_join(p, " ").alias(name) for name, p in (("head", F.slice("parts", 1, F.col("k"))), ("rest", F.slice("parts", F.col("k") + 1, F.col("words") - F.col("k"))))
    ])
    part = counts.where("words > 0")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(materialize(counts.where("words = 0").select("lang", "n"), "totals"), "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alrn"}
    score = F.expr("(1000BD * wide_a * wide_n) div (wide_l * wide_r)")
    cuts = cuts.withColumns({f"wide_{c}": w for c, w in wide.items()}).withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    # A phrase one word longer is enough: between it and a still longer one all counts are at least as high.
    longer = phrases.where("words > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array(
        F.array_join(F.slice("parts", 1, F.col("words") - 1), " "), F.array_join(F.slice("parts", 2, F.col("words") - 1), " ")
    )).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("cut.a")))
    ranked = kept.select("lang", "phrase", "cut.*").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
