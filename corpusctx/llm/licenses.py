"""Licence scans: paragraphs against licence templates by the Dice coefficient of word bigrams.

Text is normalised (letters and digits in lower case, everything else a blank) and cut into its
lines; a template line matches a text line when the Dice coefficient of their bigram sets is at
least the threshold. Since 2 min / (a + b) bounds the coefficient, only templates whose number of
bigrams lies within those bounds are compared at all. Every run of words, over any lines, is
compared too, so that a notice that is wrapped, cut short or added to is found.

Null and empty texts match nothing. Ties go to the template that sorts first.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from corpusctx.llm.arrow import column_udf

THRESHOLD = 0.8
# Public notices of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_WORD = re.compile(r"[^\W_]+")


def words(text):
    return _WORD.findall(text.lower())


def bigrams(sequence):
    """Set of neighbouring words; one word alone is its own bigram."""
    return set(zip(sequence, sequence[1:])) or {(w,) for w in sequence}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    """Templates by size, compared only where their size allows a match."""

    def __init__(self, templates, threshold=THRESHOLD):
        self.threshold, self.parts = threshold, []
        for name in sorted(templates):
            sequence = words(templates[name])
            if sequence:
                self.parts.append((name, len(sequence), bigrams(sequence)))
        self.vocabulary = {b for _, _, own in self.parts for b in own}

    def fits(self, a, b):
        return 2 * min(a, b) >= self.threshold * (a + b)

    def scan(self, text):
        """(template, first line, last line, coefficient) of the best match of each template."""
        lines, sequence, line_of = text.split("\n"), [], []
        for k, line in enumerate(lines):
            own = words(line)
            sequence += own
            line_of += [k] * len(own)
        best = {}

        def offer(name, first, last, score):
            if score >= self.threshold and score > best.get(name, (0, 0, 0.0))[2]:
                best[name] = (first, last, score)

        # Windows that can match hold a bigram of some template; all others are passed over.
        known = [i for i in range(len(sequence) - 1) if (sequence[i], sequence[i + 1]) in self.vocabulary]
        known += [i for i, w in enumerate(sequence) if (w,) in self.vocabulary]
        if not known:
            return []
        starts = [0] * (len(lines) + 1)
        for k in line_of:
            starts[k + 1] += 1
        for k in range(len(lines)):
            starts[k + 1] += starts[k]
        for k in sorted({line_of[i] for i in known}):
            own = bigrams(sequence[starts[k] : starts[k + 1]])
            for name, _, wanted in self.parts:
                if self.fits(len(own), len(wanted)):
                    offer(name, k, k, dice(own, wanted))
        pairs = list(zip(sequence, sequence[1:]))
        for name, size, wanted in self.parts:
            if size == 1:
                for i, w in enumerate(sequence):
                    if (w,) in wanted:
                        offer(name, line_of[i], line_of[i], 1.0)
                        break
                continue
            # A best span begins and ends with a bigram of the template, as others only add to its size.
            at = [i for i in known if i < len(pairs) and pairs[i] in wanted]
            for i in dict.fromkeys(at):
                seen, shared = set(), 0
                for j in range(i, len(pairs)):
                    if j > i and pairs[j] == pairs[i]:
                        break  # the span from the next bigram on has the same set
                    if pairs[j] not in seen:
                        seen.add(pairs[j])
                        if 2 * len(wanted) < self.threshold * (len(seen) + len(wanted)):
                            break
                        if pairs[j] in wanted:
                            shared += 1
                            offer(name, line_of[i], line_of[j + 1], 2 * shared / (len(seen) + len(wanted)))
        return [(name, *best[name]) for name in sorted(best)]


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("dice", pa.float64())]))


def scan(docs, templates=None, threshold=THRESHOLD, text_col="text", out_col="licenses"):
    """``docs`` with the templates each text matches, where, and how well."""
    chosen = dict(templates or TEMPLATES)

    def prepare():
        scanner = Scanner(chosen, threshold)
        names = [f.name for f in _MATCH.value_type]
        return lambda texts: pa.array([[dict(zip(names, m)) for m in scanner.scan(t.as_py() or "")] for t in texts], _MATCH)

    kind = "array<struct<license:string,first_line:int,last_line:int,dice:double>>"
    return docs.withColumn(out_col, column_udf(prepare, kind)(F.col(text_col)))
