"""First matching rule of each file, for rule books of any number and length.

A book is compiled once per task into lookups by the literal ends of its patterns: a value is
looked up by its head and tail of each length that occurs, and only patterns whose ends agree are
tried. So the work per file follows the number of lengths, not the number of rules.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from corpusctx.functions.globs import compile_glob, compile_segments, literal_ends, segment_head

#: Rules whose texts take up to this many bytes, as counted, are sent to every task; a larger table meets the files by key.
BOOK_BYTES = 8 << 20
#: Parts that the files of one key are dealt into when they meet a large table of rules.
SALTS = 16
_NONE = 1 << 62


def _python(regex):
    return re.compile(regex.removesuffix(r"\z") + r"\Z")


class FirstMatch:
    """Smallest ordinal among the patterns that match a value."""

    def __init__(self):
        self._whole, self._heads, self._tails, self._inside, self._loose = {}, {}, {}, [], []

    def add(self, ordinal, kind, text, head="", tail=""):
        """A test of the kinds of ``compile_glob``; ``head`` and ``tail`` are literal ends of a regex."""
        test = _python(text) if kind == "regex" else None
        if kind == "literal":
            self._whole.setdefault(text, []).append((ordinal, None))
        elif kind == "contains":
            self._inside.append((ordinal, text))
        else:
            head, tail = (text if kind == "prefix" else head), (text if kind == "suffix" else tail)
            if tail:
                self._tails.setdefault(len(tail), {}).setdefault(tail, []).append((ordinal, test))
            elif head:
                self._heads.setdefault(len(head), {}).setdefault(head, []).append((ordinal, test))
            else:
                self._loose.append((ordinal, test))

    def ready(self):
        for table in (self._whole, *self._heads.values(), *self._tails.values()):
            for entries in table.values():
                entries.sort(key=lambda e: e[0])
        self._inside.sort(key=lambda e: e[0])
        self._loose.sort(key=lambda e: e[0])
        self._some = re.compile("|".join(re.escape(t) for _, t in self._inside)) if self._inside else None
        return self

    def find(self, value, best=_NONE):
        """The smaller of ``best`` and the first ordinal that matches ``value``."""

        def first(entries, best):
            for ordinal, test in entries:
                if ordinal >= best:
                    break
                if test is None or test.match(value):
                    return ordinal
            return best

        if value is None:
            return best
        if value in self._whole:
            best = first(self._whole[value], best)
        for n, table in self._heads.items():
            if (entries := table.get(value[:n])) is not None:
                best = first(entries, best)
        for n, table in self._tails.items():
            if (entries := table.get(value[-n:])) is not None:
                best = first(entries, best)
        if self._some and self._some.search(value):
            for ordinal, text in self._inside:
                if ordinal >= best:
                    break
                if text in value:
                    best = ordinal
        return first(self._loose, best)


def needs_name(pattern, glob):
    """Whether the file name can match although the whole path does not."""
    if pattern.startswith("*") and not set(pattern) & {"\\", "["}:
        return False
    return glob.kind == "regex" or "/" not in glob.text


class RuleList:
    """Ignore or exclude rules (pattern, is_folder, any_level) in order, over path and name."""

    def __init__(self, rules):
        self._paths, self._names, self._patterns = FirstMatch(), FirstMatch(), {}
        for ordinal, (pattern, is_folder, any_level) in enumerate(rules):
            self._patterns[ordinal] = pattern
            if is_folder:
                self._paths.add(ordinal, "prefix", pattern)
                self._paths.add(ordinal, "literal", pattern[:-1])
                if any_level:
                    self._paths.add(ordinal, "contains", "/" + pattern)
                continue
            glob = compile_glob(pattern)
            head, tail = literal_ends(pattern)
            self._paths.add(ordinal, glob.kind, glob.text, head, tail)
            if needs_name(pattern, glob):
                self._names.add(ordinal, glob.kind, glob.text, head, tail)
        self._paths.ready()
        self._names.ready()

    def first(self, path, name):
        return self._patterns.get(self._names.find(name, self._paths.find(path)))


class IncludeList:
    """Include patterns in order, over whole paths; unusable ones match nothing."""

    def __init__(self, patterns):
        self._paths, self._patterns = FirstMatch(), {}
        for ordinal, pattern in enumerate(patterns):
            members = compile_segments(pattern).members
            if members is not None:
                self._patterns[ordinal] = pattern
                self._paths.add(ordinal, "regex", members, segment_head(pattern))
        self._paths.ready()

    def first(self, path):
        return self._patterns.get(self._paths.find(path))


def match_list(values, compile_book, rules, out):
    """Column of struct ``out``: what one book, ``rules`` of plain values, says of the ``values`` of a row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        book, kind = compile_book(rules), _arrow(out)
        for batch in batches:
            yield pa.array([dict(zip(out, book(*row))) for row in zip(*(c.to_pylist() for c in batch.flatten()))], kind)

    return F.arrow_udf(run, _ddl(out))(F.struct(*values))


def _ddl(out):
    return ", ".join(f"{c} string" for c in out)


def _arrow(out):
    return pa.struct([(c, pa.string()) for c in out])


def match_by_table(files, rules, by, values, compile_book, out):
    """``files`` with the string columns ``out``: what the book of a row's key says of its ``values``.

    ``rules``: ``by`` and the columns of a rule, in whose order they are sorted.
    ``compile_book`` makes a function of the values from the rules of one key. A key without rules
    has nulls, and so has a key that holds null. Equal books are compiled once in a task.
    """
    by, columns = list(by), [c for c in rules.columns if c not in by]
    known = rules.dropna(subset=by)
    known = known.select(*[F.col(b).cast(files.schema[b].dataType).alias(b) for b in by], *columns)
    size = known.agg(F.sum(64 + sum((F.octet_length(F.col(c).cast("string")) for c in [*by, *columns]), F.lit(0)))).first()[0]
    if (size or 0) <= BOOK_BYTES:
        return _sent(files, known, by, values, compile_book, columns, out)
    return _met(files, known, by, values, compile_book, columns, out)


def _order(rule):
    return [(x is None, x) for x in rule]


def _sent(files, rules, by, values, compile_book, columns, out):
    books, number = {}, {}
    for row in rules.collect():  # BOOK_BYTES at most
        books.setdefault(tuple(row[b] for b in by), []).append(tuple(row[c] for c in columns))
    distinct = {}
    for key, own in books.items():
        number[key] = distinct.setdefault(tuple(sorted(own, key=_order)), len(distinct))
    shared = files.sparkSession.sparkContext.broadcast((number, list(distinct)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number, distinct = shared.value
        compiled, kind, nothing = {}, _arrow(out), dict.fromkeys(out)
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.flatten())):
                k = number.get(row[: len(by)])
                if k is not None and k not in compiled:
                    compiled[k] = compile_book(distinct[k])
                found.append(nothing if k is None else dict(zip(out, compiled[k](*row[len(by) :]))))
            yield pa.array(found, kind)

    matched = files.withColumn("_matched", F.arrow_udf(run, _ddl(out))(F.struct(*[F.col(b) for b in by], *values)))
    return matched.withColumns({c: F.col(f"_matched.{c}") for c in out}).drop("_matched")


def _met(files, rules, by, values, compile_book, columns, out):
    """Rules travel in front of the files of their key, once for each part that a key's files are dealt into."""
    kept = files.columns
    marked = files.withColumns({f"_value{i}": v for i, v in enumerate(values)}).withColumn("_salt", F.pmod(F.xxhash64("_value0"), F.lit(SALTS)).cast("int"))
    ahead = rules.withColumnsRenamed({c: f"_rule{i}" for i, c in enumerate(columns)})
    ahead = ahead.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_file", F.lit(False))
    keys = [*by, "_salt"]
    both = marked.withColumn("_file", F.lit(True)).unionByName(ahead, allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "_file")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in files.schema])
    for c in out:
        schema = schema.add(c, "string")
    names = [f"_rule{i}" for i in range(len(columns))]
    inputs = [f"_value{i}" for i in range(len(values))]

    def run(batches):
        key, own, book, compiled = None, [], None, {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys_of = list(zip(*(table[k].to_pylist() for k in keys)))
            is_file = table["_file"].to_pylist()
            rule_rows = zip(*(table[c].to_pylist() for c in names))
            value_rows = zip(*(table[c].to_pylist() for c in inputs))
            found, chosen = [], []
            for i, (k, f, rule, value) in enumerate(zip(keys_of, is_file, rule_rows, value_rows)):
                if k != key:
                    key, own, book = k, [], None
                if not f:
                    own.append(rule)
                    continue
                if own and book is None:
                    text = tuple(sorted(own, key=_order))
                    if text not in compiled:
                        compiled = {text: compile_book(text)}  # the last book alone: keys come sorted
                    book = compiled[text]
                chosen.append(i)
                found.append(book(*value) if book else (None,) * len(out))
            if chosen:
                rows = table.take(pa.array(chosen)).select(kept)
                for j, c in enumerate(out):
                    rows = rows.append_column(c, pa.array([x[j] for x in found], pa.string()))
                yield from rows.to_batches()

    return both.mapInArrow(run, schema)
