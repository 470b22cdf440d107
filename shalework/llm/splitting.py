"""Texts over a token limit as pieces under it, cut at natural boundaries, consecutive pieces sharing some tokens.

Balanced targets: from the token count follows the least number of pieces; their ends are placed at equal distances and each
is moved to the strongest boundary near its target, the nearest of equally strong ones. If a piece then breaks the limit, one
piece more is tried. The overlap of a piece begins at the strongest boundary within the last ``overlap`` tokens of the piece
before, or at its end where there is none, so that no piece starts inside a line or sentence.

Boundaries by strength: an empty line, a heading or fence line, a line end, the end of a sentence, the start of a statement or clause, white
space, any place where the tokenizer's pattern ends a word. All of them are *fixed cuts* (see :mod:`shalework.llm.tokens`):
a text cut there has on either side exactly the tokens it has in the whole. Where a stretch of more than ``limit`` tokens has no
fixed cut a character is chosen, the pieces of the stretch are encoded again to prove the limit, and share nothing; the text
before and behind the stretch is split like a text of its own. Where no count of pieces places all ends though the cuts are near
enough, each piece ends at the strongest boundary in the last half of what the limit lets it reach.

Defined results. Texts of at most ``limit`` tokens, null and empty ones give no pieces. Every character of the text lies in a
piece; piece k covers the characters [char_start, char_end), and ``char_start`` of piece k + 1 is at most ``char_end`` of piece k.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalework.llm.tokens import _LETTER, CUT, Encoder, encoder

LIMIT, OVERLAP = 512, 64

RESULT = "{id} {kind}, piece_no int, pieces int, char_start int, char_end int, n_tokens int, shared_tokens int, boundary string, text string"

#: Names of the strengths, weakest first; index is strength.
STRENGTHS = ("character", "word", "space", "clause", "sentence", "line", "heading", "paragraph")

# Classes of characters; a cut lies between two of them.
_PLAIN, _LETTERS, _DIGITS, _BLANK, _BREAK, _APOSTROPHE, _CLAUSE, _STOP, _WIDE_CLAUSE, _WIDE_STOP, _PILCROW, _WHITE = range(12)
_OPENING = "、。，．（「！？"  # wide signs before which a word may end


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class, may a word end in front of it) of each code point."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(0x3001):
        if chr(i).isspace():
            kind[i] = _WHITE
    for a, z in re.findall(r"(.)-(.)", _LETTER):
        kind[ord(a) : ord(z) + 1] = _LETTERS
    for chars, k in (("0123456789", _DIGITS), (" \t", _BLANK), ("\r\n", _BREAK), ("'", _APOSTROPHE), (";,:)]}", _CLAUSE), (".!?", _STOP), ("、，", _WIDE_CLAUSE), ("。！？", _WIDE_STOP), ("¶", _PILCROW)):
        kind[[ord(c) for c in chars]] = k
    opening = np.zeros(sys.maxunicode + 1, bool)
    opening[[ord(c) for c in _OPENING]] = True
    return kind, opening


_HEADING = re.compile(r"#|```|\* \* \*|---")
_CLOSING = re.compile(r"(?<=」|）)(?=[%s0-9])" % _LETTER)


def boundaries(text: str, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(places, strengths) of the boundaries inside the text, in order; the strongest counts where several meet.

    All but the rarest are found by comparing the classes of neighbouring characters at once. ``words`` adds the places where
    only the tokenizer's pattern ends a word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, opens = _classes()
    k = np.append(kinds[points], _PLAIN)  # one more, so that every place has a class on either side
    n = len(points)
    strength = np.zeros(n + 1, np.int8)
    if words:
        strength[[m.start() for m in CUT.finditer(text)]] = 1
    before, after = k[:-2], k[1:-1]  # of the places 1 .. n - 1
    inner = strength[1:n]
    word = (before == _LETTERS) | (before == _DIGITS)
    next_word = (after == _LETTERS) | (after == _DIGITS)
    inner[(before == _LETTERS) & opens[points[1:]]] = 1
    if "」" in text or "）" in text:
        strength[[m.start() for m in _CLOSING.finditer(text)]] = 1
    solid = (before != _BLANK) & (before != _BREAK) & (before != _WHITE) & (before != _APOSTROPHE)
    blank = after == _BLANK
    inner[solid & blank] = 2
    inner[((before == _CLAUSE) & blank) | ((before == _WIDE_CLAUSE) & next_word)] = 3
    inner[((before == _STOP) & blank) | ((before == _WIDE_STOP) & next_word)] = 4
    # the first character from each place on that is no blank
    ahead = np.where(k != _BLANK, np.arange(n + 1), n)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    line = solid & (k[ahead[1:n]] == _BREAK)
    pilcrow = (word & (after == _PILCROW)) | (solid & (points[1:] == 32) & (k[2 : n + 1] == _PILCROW))
    inner[line | pilcrow] = 5
    at = np.flatnonzero(line) + 1
    if len(at):
        start = ahead[at] + 1  # behind the line break, which may be two characters
        pair = (points[start - 1] == 13) & (start < n) & (points[np.minimum(start, n - 1)] == 10)
        following = ahead[np.minimum(start + pair, n)]
        inner[at[k[following] == _BREAK] - 1] = 7
        sign = np.isin(points[np.minimum(following, n - 1)], (35, 42, 45, 96)) & (following < n)
        heads = [p for p, f in zip(at[sign].tolist(), following[sign].tolist()) if _HEADING.match(text, f)]
        strength[heads] = 6
    strength[0] = strength[n] = 0
    at = np.flatnonzero(strength)
    return at, strength[at]


def _byte_offsets(text: str) -> np.ndarray | None:
    """Bytes before each character; None if every character is one byte."""
    if text.isascii():
        return None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate([[0], np.cumsum(width)])


def split(text: str, ids: np.ndarray, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """(start, end, tokens, shared tokens, strength of the end) of each piece. ``ids`` are the tokens of the whole text."""
    total, least = len(ids), 1 + max(1, -(-(len(ids) - limit) // (limit - overlap)))
    ends = np.concatenate([[0], np.cumsum(enc.size[ids])])  # bytes before each token
    offsets = _byte_offsets(text)
    # natural boundaries first; where they are too far apart, as in encoded data, any place where a word ends
    for words, most in ((False, least + max(2, least // 8)), (True, 2 * least + 4)):
        at, strength = boundaries(text, words)
        where = at if offsets is None else offsets[at]
        token = np.searchsorted(ends, where)
        real = ends[np.minimum(token, total)] == where  # a cut is a token boundary too
        at, strength, token = at[real], strength[real], token[real]
        pieces = least
        while pieces <= most:
            cuts = _place(at, strength, token, total, pieces, limit, overlap)
            if cuts is not None:
                return _finish(cuts, text)
            pieces += max(1, pieces // 16)
    return _by_stretches(text, enc, at, strength, token, total, limit, overlap)


def _by_stretches(text: str, enc: Encoder, at: np.ndarray, strength: np.ndarray, token: np.ndarray, total: int, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a text in which no count of balanced pieces fits: only stretches of more than ``limit`` tokens without a fixed cut are
    forced, what lies between them is balanced."""
    chars = np.concatenate([[0], at, [len(text)]])
    tokens = np.concatenate([[0], token, [total]])
    kinds = np.concatenate([[0], strength, [len(STRENGTHS)]])
    out: list[tuple[int, int, int, int, int]] = []
    i = 0
    for j in [*np.flatnonzero(np.diff(tokens) > limit).tolist(), len(tokens) - 1]:  # a stretch begins at edge j
        a, z = int(chars[i]), int(chars[j])
        if i < j:
            inner = slice(i + 1, j)
            n = int(tokens[j] - tokens[i])
            part = _balanced(chars[inner] - a, kinds[inner], tokens[inner] - tokens[i], n, limit, overlap)
            out += [(a + x, a + y if y >= 0 else z, n, shared, s if y >= 0 else int(kinds[j])) for x, y, n, shared, s in part]
        if j + 1 < len(tokens):
            part = _forced(text[z : int(chars[j + 1])], enc, limit)
            out += [(z + x, z + y, n, shared, s) for x, y, n, shared, s in part[:-1]]
            x, y, n, shared, _ = part[-1]
            out.append((z + x, z + y, n, shared, int(kinds[j + 1])))
        i = j + 1
    return out


def _balanced(at: np.ndarray, strength: np.ndarray, token: np.ndarray, total: int, limit: int, overlap: int) -> list:
    """As ``_place`` with the first count that fits, else ``_walk``; no two neighbouring cuts are more than ``limit`` tokens apart."""
    pieces = least = 1 if total <= limit else 1 + -(-(total - limit) // (limit - overlap))
    while pieces <= 2 * least + 4:
        cuts = _place(at, strength, token, total, pieces, limit, overlap)
        if cuts is not None:
            return cuts
        pieces += max(1, pieces // 16)
    return _walk(at, strength, token, total, limit, overlap)


def _walk(at: np.ndarray, strength: np.ndarray, token: np.ndarray, total: int, limit: int, overlap: int) -> list:
    """Piece after piece, each to the strongest boundary, the last of equals, in the last half of its reach, or the last before; the
    overlap is shortened where the next cut would be out of reach."""
    out, start_tok, start_char, last_end = [], 0, 0, 0
    while total - start_tok > limit:
        hi = int(np.searchsorted(token, start_tok + limit, "right"))
        lo = int(np.searchsorted(token, max(last_end + 1, start_tok + limit // 2), "left"))
        best = int(np.lexsort((-token[lo:hi], -strength[lo:hi]))[0]) + lo if lo < hi else hi - 1
        end_tok = int(token[best])
        out.append((start_char, int(at[best]), end_tok - start_tok, last_end - start_tok, int(strength[best])))
        last_end = end_tok
        following = int(token[best + 1]) if best + 1 < len(token) else total
        lo = int(np.searchsorted(token, max(end_tok - overlap, start_tok + 1, following - limit), "left"))
        first = int(np.lexsort((token[lo:best], -strength[lo:best]))[0]) + lo if lo < best else best
        start_tok, start_char = int(token[first]), int(at[first])
    out.append((start_char, -1, total - start_tok, last_end - start_tok, len(STRENGTHS)))
    return out


def _place(at: np.ndarray, strength: np.ndarray, token: np.ndarray, total: int, pieces: int, limit: int, overlap: int) -> list | None:
    """The ends of ``pieces`` balanced pieces and where each next piece begins; None if a limit fails."""
    step = total / pieces
    slack = max(8.0, min((limit - step) / 2, step / 3))
    out, start_tok, start_char, last_end = [], 0, 0, 0
    for k in range(1, pieces):
        target = k * step
        lo = np.searchsorted(token, max(last_end + 1, target - slack), "left")
        hi = np.searchsorted(token, min(start_tok + limit, target + slack), "right")
        if lo >= hi:
            return None
        near = slice(lo, hi)
        best = np.lexsort((np.abs(token[near] - target), -strength[near]))[0] + lo
        end_tok = int(token[best])
        out.append((start_char, int(at[best]), end_tok - start_tok, last_end - start_tok, int(strength[best])))
        last_end = end_tok
        # the overlap begins at the strongest boundary within reach, the longest of equals
        lo = np.searchsorted(token, max(end_tok - overlap, start_tok + 1), "left")
        if lo < best:
            first = np.lexsort((token[lo:best], -strength[lo:best]))[0] + lo
            start_tok, start_char = int(token[first]), int(at[first])
        else:
            start_tok, start_char = end_tok, int(at[best])
    if total - start_tok > limit:
        return None
    out.append((start_char, -1, total - start_tok, last_end - start_tok, len(STRENGTHS)))
    return out


def _finish(cuts: list, text: str) -> list[tuple[int, int, int, int, int]]:
    a, _, n, shared, s = cuts[-1]
    return [*cuts[:-1], (a, len(text), n, shared, s)]


def _forced(text: str, enc: Encoder, limit: int) -> list[tuple[int, int, int, int, int]]:
    """For stretches without a fixed cut: the longest prefix within the limit, again and again, without overlap.

    A prefix of ``limit`` bytes always fits, since a token has at least one byte; from there it grows by bisection between
    natural boundaries and then characters.
    """
    at, strength = boundaries(text)
    kind = dict(zip(at.tolist(), strength.tolist()))
    out, start = [], 0
    while start < len(text):
        fits = lambda end: len(enc.plain(text[start:end])) <= limit
        lo = start + 1
        width = limit
        while lo < len(text) and fits(min(len(text), start + width)):
            lo = min(len(text), start + width)
            width *= 2
        hi = min(len(text), start + width)
        while lo < hi:  # the count need not rise with the length everywhere; what is kept is proven to fit
            mid = (lo + hi + 1) // 2
            if fits(mid):
                lo = mid
            else:
                hi = mid - 1
        end = lo
        if end < len(text):
            i = int(np.searchsorted(at, end, "right"))
            natural = [p for p in at[max(0, i - 200) : i].tolist() if p > start + (end - start) // 2]
            for p in sorted(natural, key=lambda p: (-kind[p], -p)):
                if fits(p):
                    end = p
                    break
        n = len(enc.plain(text[start:end]))
        out.append((start, end, n, 0, kind.get(end, 0) if end < len(text) else len(STRENGTHS)))
        start = end
    return out


def split_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The pieces of every text with more than ``limit`` tokens."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    kind = documents.schema[id_col].dataType.simpleString()
    names = ("piece_no", "pieces", "char_start", "char_end", "n_tokens", "shared_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            rows: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows)) if rows else [[]] * 9
                return pa.record_batch([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, pa.int32()) for c in cols[1:7]), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.string())], [id_col, *names, "boundary", "text"])

            for did, cell in zip(b.column(0).to_pylist(), b.column(1)):
                text = cell.as_py()
                ids = enc.encode(text)
                if len(ids) <= limit:
                    continue
                pieces = split(text, np.asarray(ids), enc, limit, overlap)
                for k, (a, z, n, shared, s) in enumerate(pieces):
                    rows.append((did, k + 1, len(pieces), a, z, n, shared, STRENGTHS[s] if s < len(STRENGTHS) else "end", text[a:z]))
                    size += z - a
                if size > 8_000_000:
                    yield out()
                    rows, size = [], 0
            yield out()

    # a token has at least one byte, so shorter texts need no encoding
    long = documents.where(F.octet_length(text_col) > limit).select(id_col, text_col)
    return long.mapInArrow(run, RESULT.format(id=id_col, kind=kind))
