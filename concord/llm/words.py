"""Vectorised word splitting for byte-level BPE vocabularies.

``split`` cuts a batch of texts into the same words as the pre-tokenizers of the two
public vocabularies, working on whole code point arrays instead of matching a pattern
word by word.  Style ``spaced`` keeps white space (words tile the text; one space joins the
word after it); style ``bare`` drops it and takes every digit alone.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: fixed values: code points with the Unicode property White_Space
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198,
               8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)


@functools.cache
def classes() -> np.ndarray:
    """Class (other, letter, number, space) of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    first = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    table[first == "L"] = LETTER
    table[first == "N"] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def split(texts: list[str], style: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(utf-8 bytes, word starts, word ends, words per text); starts and ends are byte
    positions in the concatenated texts."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = code_points(joined)
    data = joined.encode("utf-8")
    n = len(cp)
    if n == 0:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends_of_text = np.cumsum(lengths)
    cls = classes()[cp]
    first = np.zeros(n + 1, bool)  # a word or gap begins here
    np.not_equal(cls[1:], cls[:-1], out=first[1:n])
    text_edge = np.zeros(n + 1, bool)
    text_edge[0] = True
    text_edge[ends_of_text] = True
    first |= text_edge
    if style == "bare":
        first[:n] |= cls == NUMBER
        first[1:n] |= cls[:-1] == NUMBER
    else:
        # the last white space before a word: a plain space joins the word, any other stands alone
        last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~text_edge[1:n])
        first[last] = True
        first[last[cp[last] == 32] + 1] = False
    _contractions(cp, cls, first, text_edge, spaced=style != "bare")
    starts = np.flatnonzero(first[:n])
    ends = np.append(starts[1:], n)
    if style == "bare":
        keep = cls[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    per_text = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    if len(data) != n:
        at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int8) + (cp >= 0x10000), out=at[1:])
        starts, ends = at[starts], at[ends]
    return data, starts, ends, per_text


def _contractions(cp, cls, first, text_edge, spaced: bool) -> None:
    """'s 't 'm 'd 're 've 'll are words where an apostrophe begins a word."""
    n = len(cp)
    at = np.flatnonzero(cp == 39)
    at = at[(at + 1 < n)]
    at = at[~text_edge[at + 1] & first[at]]
    # style spaced: first[] is also off where a space has joined, so those are gone already
    if not len(at):
        return
    nxt = cp[at + 1]
    two = cp[np.minimum(at + 2, n - 1)]
    has_two = (at + 2 < n) & ~text_edge[np.minimum(at + 2, n)]
    one = np.isin(nxt, [ord(c) for c in "stmd"])
    pair = has_two & (((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e")))
                      | ((nxt == ord("l")) & (two == ord("l"))))
    for hit, width in ((at[one], 2), (at[pair], 3)):
        first[hit + 1] = False
        stop = hit + width
        stop = stop[stop < n]
        first[stop] = True
