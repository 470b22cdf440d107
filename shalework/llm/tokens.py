"""Encoding by a public byte-level tokenizer as a reduction over a monoid.

A text is halved until its pieces are short, the pieces are encoded, and neighbours are joined up the tree. Joining encodes a
window round the seam again and keeps all tokens outside it. The window starts at the last *fixed cut* of the left piece and
ends at the first one of the right piece: places where the splitting pattern ends a word whatever stands around them, so that
the tokens outside cannot change. Where a piece has none nearby the window grows, up to the whole piece. The result equals
the encoding of the whole text; texts of any length take time in proportion to it.

A cut between two characters is fixed if they belong to different classes (letter, digit, white space, other), the left one
is no white space (which may open the next word) and no apostrophe (which may open a contraction). Only characters whose
class every Unicode version agrees on are used.

Defined results. Null and empty texts have no tokens: an empty list. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters in a leaf, and the first reach of a window on either side of a seam.
LEAF = 1 << 14
REACH = 64

#: Ranges whose class is the same in every Unicode version.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿぁ-ゖァ-ヺ一-龥"
_OTHER = "!-&(-/:-@\\[-`{-~、。「」『』（）"
_SPACE = " \t\n\r"
#: White space and the start of a letter or digit run after an apostrophe do not qualify on the left.
CUT = re.compile(
    f"(?<=[{_LETTER}])(?=[0-9{_OTHER}{_SPACE}'])|(?<=[0-9])(?=[{_LETTER}{_OTHER}{_SPACE}'])|(?<=[{_OTHER}])(?=[{_LETTER}0-9{_SPACE}])"
)


def vocabulary_file(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary: in ``folder``, else where the installed collection keeps it."""
    return f"{folder.rstrip('/')}/{name}" if folder else importlib.import_module("public_tokenizers").path(name)


class Encoder:
    """A byte-level BPE tokenizer from a rank file."""

    def __init__(self, file: str, pattern: str) -> None:
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = self.bpe.encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        for token, i in ranks.items():
            self.size[i] = len(token)

    def encode(self, text: str | None, leaf: int = LEAF) -> np.ndarray | list[int]:
        """Token ids of the whole text."""
        if not text:
            return []
        return self.plain(text) if len(text) <= leaf else self._tree(text, leaf)

    def _tree(self, text: str, leaf: int) -> np.ndarray:
        if len(text) <= leaf:
            return np.asarray(self.plain(text), np.int32)
        half = len(text) // 2
        return self._join(text[:half], self._tree(text[:half], leaf), text[half:], self._tree(text[half:], leaf))

    def _join(self, a: str, left: np.ndarray, b: str, right: np.ndarray) -> np.ndarray:
        """The tokens of a + b from those of a and of b."""
        start, keep_l = self._last_cut(a, left)
        end, keep_r = self._first_cut(b, right)
        seam = a[start:] + b[:end]
        middle = self._tree(seam, LEAF * 4) if LEAF * 4 < len(seam) < len(a) + len(b) else np.asarray(self.plain(seam), np.int32)
        return np.concatenate([left[:keep_l], middle, right[keep_r:]])

    def _last_cut(self, a: str, tokens: np.ndarray) -> tuple[int, int]:
        """(character, token) of the last fixed cut of a; (0, 0) if there is none."""
        reach = REACH
        while True:
            base = max(0, len(a) - reach)
            # one character less: a cut at the very end is the seam itself
            cuts = [m.start() for m in CUT.finditer(a, base, len(a))]
            for at in reversed(cuts):
                tail = len(a[at:].encode())
                back = np.cumsum(self.size[tokens[::-1][: tail + 1]])
                i = int(np.searchsorted(back, tail))
                if i < len(back) and back[i] == tail:
                    return at, len(tokens) - i - 1
            if base == 0:
                return 0, 0
            reach *= 4

    def _first_cut(self, b: str, tokens: np.ndarray) -> tuple[int, int]:
        reach = REACH
        while True:
            stop = min(len(b), reach)
            for m in CUT.finditer(b, 1, stop):
                head = len(b[: m.start()].encode())
                ahead = np.cumsum(self.size[tokens[: head + 1]])
                i = int(np.searchsorted(ahead, head))
                if i < len(ahead) and ahead[i] == head:
                    return m.start(), i + 1
            if stop == len(b):
                return len(b), len(tokens)
            reach *= 4


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Encoder:
    """One encoder for each Python worker; reading the ranks takes half a second."""
    pattern = importlib.import_module("public_tokenizers").PATTERN
    return Encoder(vocabulary_file(f"{name}.tiktoken", folder), pattern)


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids) of every row: no shuffle, one pass, one text at a time."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            parts, sizes, done, held = [], [], 0, 0
            for i, text in enumerate(b.column(1)):
                ids = enc.encode(text.as_py())
                parts.append(np.asarray(ids, np.int32))
                sizes.append(len(ids))
                held += len(ids)
                if held > 1_000_000:
                    yield _lists(b.column(0).slice(done, i + 1 - done), parts, sizes, id_col)
                    parts, sizes, done, held = [], [], i + 1, 0
            if sizes:
                yield _lists(b.column(0).slice(done), parts, sizes, id_col)

    return documents.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def _lists(ids: pa.Array, parts: list[np.ndarray], sizes: list[int], name: str) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], [name, "ids"])


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, text) from (id, ids): the tokens' bytes one after another; null ids give null."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            texts = [None if x is None else enc.bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")
