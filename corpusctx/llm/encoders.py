"""Exact encoders for tasks, from plain data: executors need no copy of the package."""

import re

import numpy as np
import tiktoken

# Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points with the Unicode property White_Space.
_WHITE = "\t-\r \x85\xa0  -     　"
#: The pattern's look-ahead goes back over a run of blanks; longer runs are split off first.
_RUN = 2048
_LONG_RUN = re.compile(f"[{_WHITE}]{{{_RUN},}}")
_BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WHITE}]", c))
#: A place that no token crosses: between a character that is no blank and a space.
_BORDER = re.compile(f"(?<=[^{_WHITE}])(?= .)", re.DOTALL)


class ByteEncoder:
    """Byte-level BPE of a list of token bytes; ``special`` maps the bytes of special tokens to ids."""

    def __init__(self, tokens, special=None):
        special = special or {}
        ranks = {t: i for i, t in enumerate(tokens) if t and t not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t.decode(): i for t, i in special.items()})
        self.whole = re.compile("(" + "|".join(re.escape(t.decode()) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special = {t.decode(): i for t, i in special.items()}

    def _plain(self, text, out):
        """Ids of a text whose special tokens, if any, are plain text."""
        at = 0
        # A run that long covers one of these places.
        for run in () if _BLANKS.isdisjoint(text[_RUN - 1 :: _RUN]) else _LONG_RUN.finditer(text):
            # The last blank of a run belongs to what follows; the others are one word.
            stop = run.end() if run.end() == len(text) else run.end() - 1
            out.append(self.encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
            out.append(np.array(self.encoding._encode_single_piece(text[run.start() : stop]), np.uint32))
            at = stop
        out.append(self.encoding.encode_to_numpy(text[at:] if at else text, disallowed_special=()))

    def encode(self, text):
        """Ids as an array of unsigned 32-bit numbers, special tokens recognised."""
        out = []
        if self.whole is None:
            self._plain(text, out)
        else:
            for k, part in enumerate(self.whole.split(text)):
                if k % 2:
                    out.append(np.array([self.special[part]], np.uint32))
                elif part:
                    self._plain(part, out)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def cut(text, limit):
    """Pieces of about ``limit`` characters that start at a space after a character that is no blank."""
    at = 0
    while len(text) - at > limit:
        border = _BORDER.search(text, at + limit)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:] if at else text
