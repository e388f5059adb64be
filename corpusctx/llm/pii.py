"""Information-theoretic sanitisation: patterns find entities, corpus co-occurrence the terms that disclose them.

Emails, IP addresses, card and phone numbers are found by fixed patterns. A term discloses an
entity when the corpus shows so: with t a word anywhere in the texts that hold entity c,
    pmi(t, c) = log2(P(t with c) / P(t))  against  ic(c) = -log2(P(c)),
a term that reaches ``GENERALISE`` of the entity's information is generalised, and one that
reaches ``REMOVE`` is removed, wherever it stands in a text that holds the entity. P(t) and P(c)
are shares of all documents; P(t with c) counts the texts of c, and needs ``SUPPORT`` of them.
Copies count once: texts are counted by the ``NEAR`` words on either side of the entity and by
each of ``SKETCH`` minima over hashes of their word triples, and the least of these counts holds.

Null text counts as empty and has no spans. Offsets are code points, ends exclusive. Spans of one
kind never overlap. Repeated rows give repeated results, rows that share an id keep their own
spans, and rows without an id count as one document; an empty table gives no rows.
"""

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusctx.llm.arrow import column_udf, releasing
from corpusctx.sources.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR, SKETCH, SUPPORT, GENERALISE, REMOVE = 5, 4, 3, 0.6, 0.9
_KEYS = ["around", *[f"copy{k}" for k in range(SKETCH)]]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text):
    """The part before an @ is all that can belong to it, back to the end of the last address."""
    past = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        if start < m.start():
            yield start, m.end()
            past = m.end()


def ips(text):
    """Four numbers at a time along each dotted run of numbers."""
    for m in _DOTTED.finditer(text):
        numbers = list(_NUMBER.finditer(text, m.start(), m.end()))
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            if all(len(n[0].lstrip("0")) <= 3 and int(n[0][-3:]) <= 255 for n in four):
                yield four[0].start(), four[3].end()


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text):
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = [c for c in m[0] if c not in " -"]
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.start(), m.end()


def phones(text):
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.start(), m.end()


def base_spans(text):
    """(kind, start, end) by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    for kind, finder in (("ip", ips), ("card", cards), ("phone", phones)):
        found += [(kind, *s) for s in finder(text)]
    return found


_WORD = re.compile(r"[^\W\d_]{3,64}")


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_base(docs, text_col="text"):
    """``docs`` with ``base``: the spans of the patterns, as structs in order."""

    def prepare():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return lambda texts: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in base_spans(t or "")] for t in _strings(texts)], kind)

    return docs.withColumn("base", column_udf(prepare, _SPAN)(F.col(text_col)))


def _strings(array):
    return (x.as_py() for x in array)


def _covered(spans):
    """Disjoint stretches that the spans cover, in order."""
    merged = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [s for s, _ in merged], [e for _, e in merged]


def _entity(kind, shown):
    """Name of an entity; long ones by a digest of the whole."""
    name = f"{kind}:{shown.lower()}"
    return name if len(name) <= 300 else f"{kind}#{hashlib.sha256(name.encode()).hexdigest()}"


def free_words(text, spans):
    """(word, start, end) of the words that no span covers, in order."""
    starts, ends = _covered(spans)

    def outside(m):
        # The last stretch that starts before the word's end must be over by its start.
        k = bisect_left(starts, m.end()) - 1
        return k < 0 or ends[k] <= m.start()

    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text) if outside(m)]


def sketch(words):
    """``SKETCH`` least hashes of the triples of words; copies agree in most of them."""
    triples = {" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))}
    digests = b"".join(hashlib.blake2b(t.encode(), digest_size=8 * SKETCH).digest() for t in triples)
    return np.frombuffer(digests, "<i8").reshape(-1, SKETCH).min(axis=0).tolist()


def contexts(docs, text_col="text", id_col="doc_id"):
    """One row per document and entity it holds: (doc_id, text_hash, entity, around, copy0, ..).

    ``around``: the least of the ``NEAR`` words on either side over the entity's places; ``copy0, ..``: the text's sketch.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _strings(batch.column(2))):
                spans, least = base_spans(text or ""), {}
                free = free_words(text, spans) if spans else []
                begins, ends = [w[1] for w in free], [w[2] for w in free]
                for kind, start, end in spans:
                    before, after = bisect_right(ends, start), bisect_left(begins, end)
                    near = free[max(before - NEAR, 0) : before] + free[after : after + NEAR]
                    entity, around = _entity(kind, text[start:end]), " ".join(w[0] for w in near)
                    least[entity] = min(least.get(entity, around), around)
                copy = sketch([w[0] for w in free]) if least else []
                rows += [(doc, digest, *own, *copy) for own in least.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    names = ["doc_id", "text_hash", "entity", *_KEYS]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * SKETCH]
    schema = "doc_id string, text_hash long, entity string, around string" + "".join(f", copy{k} long" for k in range(SKETCH))
    return materialize(chosen.mapInArrow(releasing(run), schema), "contexts")


def text_terms(docs, hashes, text_col="text"):
    """(text_hash, term): the different words outside the entities of the texts with these hashes."""

    def run(batches):
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), _strings(batch.column(1))):
                terms = sorted({w[0] for w in free_words(text, base_spans(text))})
                for at in range(0, len(terms), 1 << 16):
                    part = terms[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(part), pa.int64()), pa.array(part, pa.string())], ["text_hash", "term"])

    held = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return held.join(hashes, "text_hash", "left_semi").mapInArrow(releasing(run), "text_hash long, term string").distinct()


def document_frequency(docs, terms, text_col="text"):
    """(term, n): documents that hold each of the terms anywhere, over all documents."""

    def run(batches):
        counts = {}
        for batch in batches:
            for text in _strings(batch.column(0)):
                for word in {w.lower() for w in _WORD.findall(text or "")}:
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) > 300_000:
                    yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})
                    counts = {}
        if counts:
            yield pa.RecordBatch.from_pydict({"term": list(counts), "n": list(counts.values())})

    found = docs.select(F.col(text_col)).mapInArrow(releasing(run), "term string, n long")
    return found.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(near, docs, text_col="text"):
    """(text_hash, term, share): how much of the information of an entity of the text a term reveals, from ``GENERALISE`` on."""
    texts = F.least(*[F.countDistinct(k) for k in _KEYS])
    entities = near.groupBy("entity").agg(texts.alias("texts"), F.countDistinct(F.coalesce("doc_id", F.lit(""))).alias("holders"))
    entities = materialize(entities.where(F.col("texts") >= SUPPORT), "entities")
    held = near.join(entities.select("entity"), "entity").groupBy("text_hash", "entity").agg(*[F.min(k).alias(k) for k in _KEYS])
    held = materialize(held, "held")
    if held.isEmpty():  # no entity has the support, so no term can disclose
        return held.select("text_hash", F.lit("").alias("term"), F.lit(0.0).alias("share"))
    words = materialize(text_terms(docs, held.select("text_hash").distinct(), text_col), "words")
    # Equal rows are summed up before they move, so no popular entity or word is one task's work.
    often = held.join(words, "text_hash").groupBy("entity", "term").agg(texts.alias("together"))
    often = materialize(often.where(F.col("together") >= SUPPORT), "often")
    total = docs.count()
    seen = document_frequency(docs, materialize(often.select("term").distinct(), "terms"), text_col)
    joined = often.join(entities, "entity").join(materialize(seen, "seen"), "term")
    information = -F.log2(F.col("holders") / total)
    pmi = F.log2(F.least(F.col("together") / F.col("texts"), F.lit(1.0)) / (F.col("n") / total))
    share = F.when(information > 0, pmi / information).otherwise(F.lit(0.0))
    disclosing = materialize(joined.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE), "disclosing")
    shown = held.join(disclosing, "entity").join(words, ["text_hash", "term"])
    return shown.groupBy("text_hash", "term").agg(F.max("share").alias("share"))


def mark_terms(row):
    """Spans of a text's disclosing terms outside its entities, each with what it reveals."""
    share = {t["term"]: t["share"] for t in row["shown"]}
    found = free_words(row["text"], [(s["kind"], s["start"], s["end"]) for s in row["base"]])
    return [{"start": start, "end": end, "share": share[word]} for word, start, end in found if word in share]


_TERMS = "array<struct<start:int,end:int,share:double>>"


def _disclosed(docs, text_col, id_col):
    """(_hash, _shown): the disclosing terms of each text that has any, written once."""
    near = contexts(docs, text_col, id_col)
    # Bounded by the different words of one text.
    shown = disclosing_terms(near, docs, text_col).groupBy("text_hash").agg(F.collect_list(F.struct("term", "share")).alias("_shown"))
    return materialize(shown, "terms").withColumnRenamed("text_hash", "_hash")


def find_spans(docs, text_col="text", id_col="doc_id"):
    """``docs`` with ``base`` (pattern spans) and ``terms`` (spans of disclosing terms, with their share)."""
    shown = _disclosed(docs, text_col, id_col)

    def prepare():
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))
        return lambda rows: pa.array([mark_terms(r) if r["shown"] is not None else None for r in (x.as_py() for x in rows)], kind)

    found = find_base(docs, text_col).join(shown, F.xxhash64(text_col) == F.col("_hash"), "left")
    has = F.col("_shown").isNotNull()
    row = F.struct(F.when(has, F.col(text_col)).alias("text"), F.when(has, F.col("base")).alias("base"), F.col("_shown").alias("shown"))
    return found.withColumn("terms", column_udf(prepare, _TERMS)(row)).drop("_hash", "_shown")


def sanitise(docs, text_col="text", id_col="doc_id"):
    """``docs`` with entities replaced by their kind, disclosing terms generalised to ``[TERM]`` or removed.

    All other columns stay, whatever their names. Spans are found and replaced in one pass, by one
    Python worker per task.
    """

    def prepare():
        def clean(text, shown):
            if text is None:
                return None
            base = [dict(zip(("kind", "start", "end"), s)) for s in base_spans(text)]
            terms = mark_terms({"text": text, "base": base, "shown": shown}) if shown is not None else ()
            marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
            marks += [(s["start"], s["end"], "" if s["share"] >= REMOVE else "[TERM]") for s in terms]
            out, past = [], 0
            for start, end, shown in sorted(marks, key=lambda m: (m[0], -m[1])):
                if start >= past:
                    out += [text[past:start], shown]
                elif end > past:
                    shown = ""  # overlaps the span before: the rest of it goes too
                past = max(past, end)
            return "".join(out) + text[past:]

        return lambda rows: pa.array((clean(r["text"].as_py(), r["shown"].as_py()) for r in rows), pa.string())

    found = docs.join(_disclosed(docs, text_col, id_col), F.xxhash64(text_col) == F.col("_hash"), "left")
    row = F.struct(F.col(text_col).alias("text"), F.col("_shown").alias("shown"))
    return found.withColumn(text_col, column_udf(prepare, "string")(row)).drop("_hash", "_shown")
