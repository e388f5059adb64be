"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

Each round is worth one window. A queue's credit grows by its quantum, its target share of a
window; it is served whole ``PIECE``-token units of its credit, and what is left of the credit,
its deficit, is carried into the next round. The served tokens form one stream, cut into
windows, so every window holds the target proportions to within a piece per source.

How far a queue has been served after k rounds has a closed form, so a document's place in the
stream follows from its place in its queue alone: partitions carry deficits to each other
without running one after the other. Queue places come from the sizes of earlier partitions.

Nothing is padded: all windows are full, and what is left at the end is cut into windows whose
lengths are powers of two. Null text counts as empty (its document is the end id alone), a null
source is a queue of its own, repeated rows are packed each on their own, and an empty table
gives no pieces.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window, functions as F

from corpusctx.llm.arrow import releasing
from corpusctx.llm.encoders import ByteEncoder
from corpusctx.operators.joins import join_on
from corpusctx.sources.scratch import materialize

WINDOW = 2048
PIECE = 64
#: Queues whose sizes the driver holds, beside those of sources with a target of their own. With more
#: sources than that, those without a target share queues by hash; targets hold at every number of sources.
MAX_QUEUES = 4096
END_ID = 1
_SCALE_BITS = 12  # quanta are whole multiples of 1/4096 token


def tokenize(docs, vocabulary, queue, text_col="text", id_col="doc_id"):
    """Token table, written once: (doc_id, queue, ids as packed 16- or 32-bit, doc_tokens, part, before).

    ``before``: tokens of the same queue in front of the document within its part.
    """
    # As large as the vocabulary file, and plain data: tasks need no copy of the package.
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.tokens, vocabulary.special))
    kind = "<u2" if len(vocabulary.tokens) <= 1 << 16 else "<u4"

    def run(batches):
        encoder = ByteEncoder(*shared.value)
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, counts, before = [], [], []
                rows = batch.slice(at, 512)
                for text, q in zip(rows.column(2), rows.column(1).to_pylist()):
                    own = np.append(encoder.encode(text.as_py() or ""), END_ID)
                    ids.append(own.astype(kind).tobytes())
                    counts.append(len(own))
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + len(own)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64())],
                    ["doc_id", "queue", "ids", "doc_tokens", "part", "before"],
                )

    chosen = docs.select(F.col(id_col).alias("doc_id"), queue.alias("queue"), F.col(text_col).alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()
    table = chosen.mapInArrow(releasing(run), f"doc_id {id_type}, queue string, ids binary, doc_tokens long, part int, before long")
    return materialize(table, "tokens"), kind


class Plan:
    """Quanta, totals and the stream's cut points; the same arithmetic in every task."""

    def __init__(self, totals, shares, window=WINDOW, piece=PIECE):
        self.window, self.piece = window, piece
        self.totals = np.array(totals, np.int64)
        weight = np.array(shares, np.float64)
        weight = weight / weight.sum() if len(weight) else weight
        self.quanta = np.maximum(np.rint(weight * window * (1 << _SCALE_BITS)).astype(np.int64), 1)
        tokens = int(self.totals.sum())
        full, rest = divmod(tokens, window)
        lengths = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full, self.tail = full, full * window + np.cumsum([0, *lengths])

    def served(self, rounds, queue=slice(None)):
        """Tokens each queue has given after so many rounds."""
        unit = self.piece << _SCALE_BITS
        return np.minimum(rounds * self.quanta[queue] // unit * self.piece, self.totals[queue])

    def round_of(self, queue, at):
        """The round (from 1) that serves the queue's token at this place."""
        unit = self.piece << _SCALE_BITS
        return -(-((at // self.piece + 1) * unit) // self.quanta[queue])

    def place(self, queue, at):
        """Place in the stream of tokens of a queue."""
        rounds = self.round_of(queue, at)
        before = np.zeros(len(at), np.int64)
        for q in range(len(self.totals)):
            # Earlier queues have had this round's turn, later ones only the rounds before.
            before += self.served(rounds - (q >= queue), q)
        return before + at - self.served(rounds - 1, queue)

    def window_of(self, place):
        return np.where(place < self.full * self.window, place // self.window, self.full + np.searchsorted(self.tail, place, "right") - 1)

    def window_start(self, number):
        return np.where(number < self.full, number * self.window, self.tail[np.maximum(number - self.full, 0)])

    def pieces(self, queue, start, length):
        """Pieces of token ranges of queues: (row, start within the row, length, window, offset)."""
        def expand(counts):
            row = np.repeat(np.arange(len(counts)), counts)
            return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)

        # Units of a row, then runs of units of one round, then cuts at window borders.
        row, unit = expand((start + length - 1) // self.piece - start // self.piece + 1)
        low = np.maximum(start[row], (start[row] // self.piece + unit) * self.piece)
        rounds = self.round_of(queue[row], low)
        fresh = np.r_[True, (row[1:] != row[:-1]) | (rounds[1:] != rounds[:-1])] if len(row) else np.zeros(0, bool)
        row, low = row[fresh], low[fresh]
        high = np.append(low[1:], 0)
        last = np.append(row[1:] != row[:-1], True)
        high = np.where(last, (start + length)[row], high)
        place = self.place(queue[row], low)
        first_window = self.window_of(place)
        run, step = expand(self.window_of(place + high - low - 1) - first_window + 1)
        number = first_window[run] + step
        begins = self.window_start(number)
        ends = np.where(number < self.full, begins + self.window, self.tail[np.minimum(np.maximum(number - self.full, -1) + 1, len(self.tail) - 1)])
        a, b = np.maximum(place[run], begins), np.minimum((place + high - low)[run], ends)
        return row[run], low[run] - start[row[run]] + a - place[run], b - a, number, a - begins


def pack(docs, vocabulary, source_col="source", text_col="text", id_col="doc_id", shares=None, window=WINDOW, with_ids=True):
    """Pieces of all documents, packed into windows.

    Columns: doc_id, source queue, start, length, ids (packed 32-bit, if ``with_ids``), ids_crc32,
    doc_tokens, sequence_id, offset. ``shares``: target proportion per source (None: what the
    corpus holds, so all queues end together); sources it does not name get their corpus share.
    """
    queue = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    few = docs.select(queue.alias("q")).distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES
    wanted = {f"s{s}": w for s, w in (shares or {}).items()}
    if not few:
        hashed = F.concat(F.lit("h"), F.pmod(F.xxhash64(queue), F.lit(MAX_QUEUES)).cast("string"))
        queue = F.when(queue.isin(list(wanted)), queue).otherwise(hashed) if wanted else hashed
    table, kind = tokenize(docs, vocabulary, queue, text_col, id_col)
    sizes = materialize(table.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "sizes")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(sizes.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    totals = {r.queue: r.n for r in sizes.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MAX_QUEUES and the named sources at most
    names = sorted(totals)
    all_tokens = sum(totals.values()) or 1
    plan = Plan([totals[q] for q in names], [wanted.get(q, totals[q] / all_tokens) for q in names], window)
    number = {q: i for i, q in enumerate(names)}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                doc_tokens = rows.column(3).to_numpy()
                queue_no = np.array([number[q] for q in rows.column(1).to_pylist()], np.int64)
                start = rows.column(4).to_numpy() + rows.column(5).to_numpy()
                row, first, length, sequence, offset = plan.pieces(queue_no, start, doc_tokens)
                ids = [memoryview(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in rows.column(2).to_pylist()]
                cut = [ids[r][4 * f : 4 * (f + n)] for r, f, n in zip(row.tolist(), first.tolist(), length.tolist())]
                taken = pa.array(row)
                columns = [rows.column(0).take(taken), rows.column(1).take(taken), pa.array(first), pa.array(length)]
                columns += [pa.array(map(bytes, cut), pa.binary())] if with_ids else []
                columns += [pa.array(map(zlib.crc32, cut), pa.int64()), pa.array(doc_tokens[row]), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, names_out)

    id_type = table.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, queue string, start long, length long, {'ids binary, ' * with_ids}ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names_out = [c.split(" ")[0] for c in schema.split(", ")]
    placed = join_on(table, bases, ["queue", "part"])
    return placed.select("doc_id", "queue", "ids", "doc_tokens", "base", "before").mapInArrow(releasing(run), schema)
