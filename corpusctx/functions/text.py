"""Text measures and text repair, all as JVM-side column expressions."""

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Fixed value: characters per token when no ratio, or an unusable one, is given.
DEFAULT_RATIO = 4.0

# Every character str.strip() removes, by rule.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Fixed values of the slug format.
SLUG_MAX = 100
SLUG_EMPTY = "unnamed"
SLUG_ONLY_PUNCTUATION = "----------.txt"

# Characters of a text looked at first, for each one of its slug.
SLUG_START = 3

# Fixed values of the key mask: longer keys keep both ends, shorter ones nothing.
MASK_SHORT = "***"
MASK_GAP = "..."
MASK_LIMIT, MASK_HEAD, MASK_TAIL = 12, 8, 4

# Default shape of a key in free text: vendor-style keys and long hex strings.
KEY_PATTERN = "sk-[A-Za-z0-9_-]{8,}|[0-9a-fA-F]{32,}"


def strip(col) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACES))


def is_blank(col) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def estimate_tokens(chars, ratio=DEFAULT_RATIO) -> Column:
    """Token estimate from a character count: 0 for nothing, else at least 1.

    ``ratio`` is a number or a column, so it can come from a table of models.
    """
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    ratio = F.when(ratio > 0, ratio).otherwise(F.lit(DEFAULT_RATIO))
    chars = F.coalesce(chars, F.lit(0))
    return (
        F.when(chars <= 0, F.lit(0))
        .otherwise(F.greatest(F.lit(1), F.floor(chars / ratio)))
        .cast("bigint")
    )


def text_tokens(col, ratio=DEFAULT_RATIO) -> Column:
    return estimate_tokens(F.length(col), ratio)


def unify_newlines(col) -> Column:
    """CRLF and CR become LF; texts without CR skip the regex."""
    return F.when(F.contains(col, F.lit("\r")), F.regexp_replace(col, "\r\n?", "\n")).otherwise(col)


def decode_text(content) -> Column:
    """Bytes to text: bad UTF-8 becomes U+FFFD, line ends become LF."""
    return unify_newlines(F.make_valid_utf8(content.cast("string")))


def sha256(col) -> Column:
    return F.sha2(col, 256)


def json_literal(col) -> Column:
    """A string column as a JSON string literal."""
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


@lru_cache(maxsize=1)
def _ascii_folds():
    """Code points whose compatibility decomposition leaves ASCII, by rule.

    The kept part of a decomposed text is the concatenation of the kept parts of
    its characters, so a per-character table is exact.
    """
    single, multi = {}, {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        kept = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            single[char] = kept
        elif kept:
            multi[char] = kept
    return single, multi


def _let(value, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_NON_ASCII = r"[^\x00-\x7F]"


def ascii_fold(col) -> Column:
    """Compatibility-decompose, then drop whatever is not ASCII. Pure ASCII passes through."""
    single, multi = _ascii_folds()
    signs = F.lit("".join(multi))
    spellings = F.split(F.lit("\x00".join(multi.values())), "\x00")

    def spelled(char):
        known = F.get(spellings, F.position(char, signs) - 1)
        return F.when(char <= "\x7f", char).otherwise(F.coalesce(known, F.lit("")))

    def finish(text):
        return F.when(text.rlike(_NON_ASCII), F.array_join(F.transform(F.split(text, ""), spelled), "")).otherwise(text)

    plain = F.translate(col, "".join(single), "".join(single.values()))
    return F.when(col.rlike(_NON_ASCII), _let(plain, finish)).otherwise(col)


def _dashed(name):
    """Runs of other characters as dashes, none at the ends, in lower case."""
    slug = F.regexp_replace(name, r"[ \t\n\x0B\f\r\x1c-\x1f/\\:]+", "-")
    slug = F.regexp_replace(slug, r"[^A-Za-z0-9_.\-]+", "-")
    return F.lower(F.btrim(slug, F.lit("-")))


def whole_slug(col, max_length=SLUG_MAX) -> Column:
    """``slugify`` by way of the whole text."""

    def cut(slug):
        return F.when(slug == "", F.lit(SLUG_EMPTY)).otherwise(F.left(slug, F.lit(max_length)))

    def shape(name):
        only_punctuation = name.rlike(r"\A[^A-Za-z0-9_]*\.txt\n?\z")
        return F.when(only_punctuation, F.lit(SLUG_ONLY_PUNCTUATION)).otherwise(_let(_dashed(name), cut))

    return _let(ascii_fold(col), shape)


def slugify(col, max_length=SLUG_MAX) -> Column:
    """A file-name-safe, lower-case form of a text.

    Each step maps a start of the text to a start of its result, so a start that gives ``max_length``
    characters settles the slug, once a letter, digit or underscore among them shows that it is
    not mere punctuation before ``.txt``. Only other texts are shaped whole.
    """
    near = F.left(col, F.lit(SLUG_START * max_length))
    word = r"[a-z0-9_]"

    def settle(start):
        # The last four characters may be the ``.txt`` itself.
        settled = (F.length(start) >= max_length) & F.left(start, F.lit(max_length - 4)).rlike(word)
        return F.when(settled, F.left(start, F.lit(max_length))).otherwise(whole_slug(col, max_length))

    return F.when(col.isNotNull(), _let(_dashed(ascii_fold(near)), settle))


def mask_key(col) -> Column:
    """Show only the ends of a key."""
    return F.when(
        F.length(col) > MASK_LIMIT,
        F.concat(F.left(col, F.lit(MASK_HEAD)), F.lit(MASK_GAP), F.right(col, F.lit(MASK_TAIL))),
    ).otherwise(F.lit(MASK_SHORT))


def find_keys(col, pattern=KEY_PATTERN) -> Column:
    """All key-shaped tokens; texts without any pay for one search only."""
    found = F.regexp_extract_all(col, F.lit(f"({pattern})"), F.lit(1))
    return F.when(col.rlike(pattern), found).otherwise(F.array().cast("array<string>"))


def mask_keys(col, pattern=KEY_PATTERN) -> Column:
    """Mask every key-shaped token of a text and leave the rest as it is."""
    between = F.split(col, pattern, -1)
    masked = F.transform(find_keys(col, pattern), mask_key)
    pieces = F.transform(
        F.arrays_zip(between.alias("gap"), masked.alias("key")),
        lambda p: F.concat(p["gap"], F.coalesce(p["key"], F.lit(""))),
    )
    return F.when(col.rlike(pattern), F.array_join(pieces, "")).otherwise(col)
