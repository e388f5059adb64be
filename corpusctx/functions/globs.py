"""Two glob dialects compiled to Java regular expressions and plain string tests.

*Whole-path* globs (``compile_glob``): ``*`` and ``?`` also cross ``/``.
*Segment* globs (``compile_segments``): wildcards stay inside one path segment, ``**``
spans any number of folders.
Both run on the small list of patterns; matching is a JVM expression over the paths.
"""

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_STAR, _ANY = object(), object()


def _escape(char):
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def _char_class(body, negated):
    """Java class for the inside of ``[...]``; None when it can match nothing (or, negated, anything)."""
    items, i = [], 0
    while i < len(body):
        low = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            high = body[i + 2]
            if low <= high:
                items.append(f"{_escape(low)}-{_escape(high)}")
            i += 3
        else:
            items.append(_escape(low))
            i += 1
    if not items:
        return None
    return f"[{'^' if negated else ''}{''.join(items)}]"


def _tokens(pattern):
    """Yield literal characters, ``_STAR``, ``_ANY`` and (body, negated) classes."""
    i, n = 0, len(pattern)
    while i < n:
        char = pattern[i]
        i += 1
        if char == "*":
            yield _STAR
        elif char == "?":
            yield _ANY
        elif char == "[":
            start = i + 1 if pattern[i : i + 1] == "!" else i
            # A closing bracket in first place is a member of the class.
            end = pattern.find("]", start + 1)
            if end < 0:
                yield char
            else:
                yield (pattern[start:end], start > i)
                i = end + 1
        else:
            yield char


def _regex(tokens, star, any_char, inside_segment):
    out, last = [], None
    for token in tokens:
        if token is _STAR:
            if last is not _STAR:
                out.append(star)
        elif token is _ANY:
            out.append(any_char)
        elif isinstance(token, tuple):
            body = _char_class(*token)
            if body is None:
                out.append(any_char if token[1] else "(?!)")
            else:
                out.append(f"(?!/){body}" if inside_segment else body)
        else:
            out.append(_escape(token))
        last = token
    return "".join(out)


@dataclass(frozen=True)
class Glob:
    """``kind`` names the cheapest exact test; ``text`` is its operand, a regex only for kind ``regex``."""

    kind: str
    text: str


def compile_glob(pattern: str) -> Glob:
    tokens = list(_tokens(pattern))
    plain = "".join(t for t in tokens if isinstance(t, str))
    wild = [i for i, t in enumerate(tokens) if not isinstance(t, str)]
    if all(tokens[i] is _STAR for i in wild):
        ends = (bool(tokens) and tokens[0] is _STAR, bool(tokens) and tokens[-1] is _STAR)
        middle = tokens
        while middle and middle[0] is _STAR:
            middle = middle[1:]
        while middle and middle[-1] is _STAR:
            middle = middle[:-1]
        if _STAR not in middle:
            kind = {
                (False, False): "literal",
                (True, False): "suffix",
                (False, True): "prefix",
                (True, True): "contains",
            }[ends]
            return Glob(kind, plain)
    return Glob("regex", r"(?s)\A" + _regex(tokens, ".*", ".", False) + r"\z")


def literal_ends(pattern):
    """Literal text that whatever matches a whole-path glob begins with, and ends with."""
    tokens = list(_tokens(pattern))
    wild = [i for i, t in enumerate(tokens) if not isinstance(t, str)]
    if not wild:
        return "".join(tokens), "".join(tokens)
    return "".join(tokens[: wild[0]]), "".join(tokens[wild[-1] + 1 :])


# How each kind is tested; the operand may be a literal or a column of a rules table.
GLOB_TESTS = {
    "literal": lambda value, text: value == text,
    "suffix": lambda value, text: F.endswith(value, text),
    "prefix": lambda value, text: F.startswith(value, text),
    "contains": lambda value, text: F.contains(value, text),
    "regex": lambda value, text: F.rlike(value, text),
}


def glob_test(value, glob: Glob) -> Column:
    return GLOB_TESTS[glob.kind](value, F.lit(glob.text))


@dataclass(frozen=True)
class SegmentGlob:
    """Regexes over paths: files matched, folders matched, files brought in by either."""

    pattern: str
    error: str | None
    files: str | None = None
    folders: str | None = None
    members: str | None = None


def compile_segments(pattern: str) -> SegmentGlob:
    """Compile an include pattern; an unusable one carries ``error`` and no regex."""
    if not pattern or pattern.startswith("/"):
        return SegmentGlob(pattern, "pattern must be relative and not empty")
    folders_only = pattern.endswith("/")
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    if any("**" in s and s != "**" for s in segments):
        return SegmentGlob(pattern, "** must be a whole path segment")
    if not segments:
        return SegmentGlob(pattern, None, None, r"(?s)\A\.\z", r"(?s)\A.+\z")

    deep_end = segments[-1] == "**"
    while segments and segments[-1] == "**":
        segments.pop()
    body, folder_gap = [], ""
    for segment in segments:
        if segment == "**":
            folder_gap = "(?:[^/]+/)*"
            continue
        own = "[^/]+" if segment == "*" else _regex(_tokens(segment), "[^/]*", "[^/]", True)
        body.append(folder_gap + own)
        folder_gap = ""
    stem = "/".join(body)
    if deep_end and not stem:
        return SegmentGlob(pattern, None, None, r"(?s)\A.+\z", r"(?s)\A.+\z")
    if deep_end:
        return SegmentGlob(pattern, None, None, rf"(?s)\A{stem}(?:/.*)?\z", rf"(?s)\A{stem}/.+\z")
    if folders_only:
        return SegmentGlob(pattern, None, None, rf"(?s)\A{stem}\z", rf"(?s)\A{stem}/.+\z")
    return SegmentGlob(pattern, None, rf"(?s)\A{stem}\z", rf"(?s)\A{stem}\z", rf"(?s)\A{stem}(?:/.*)?\z")


def segment_head(pattern):
    """Literal text that every file of an include pattern begins with."""
    whole = "/".join(s for s in pattern.split("/") if s not in ("", "."))
    wild = [i for i in (whole.find(c) for c in "*?[") if i >= 0]
    return whole[: min(wild)].rstrip("/") if wild else whole
