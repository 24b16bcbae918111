"""Byte-level BPE ids for whole columns.

Texts are cut by the tokenizer's own split rule, applied to whole buffers at
once; each distinct piece of a buffer is encoded once, and ids are gathered
back. The ids are those of the ``tokenizers`` library for the same vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

from .text import SLICE_BYTES, column_bytes, slices

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Encoded pieces that a worker keeps between buffers.
KEPT = 60_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point by its Unicode properties."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    place = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(rule, everything):
            out[place[m.start() : m.end()]] = kind
    return out


def piece_starts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First byte of each piece of the split rule: contractions, an optional space with letters, numbers or other
    signs, white space up to the last one before anything else, white space."""
    if not len(buf):
        return np.empty(0, np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = _classes()[cp]
    head = np.zeros(len(at) + 1, bool)
    head[np.searchsorted(at, bounds)] = True
    head = head[:-1]
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start & (kind != SPACE) & ~head)
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    quote = np.flatnonzero(start & (cp == 0x27))
    if len(quote):
        far = np.append(cp, [0, 0, 0])
        edge = np.append(head, [True] * 3)
        one, two = far[quote + 1], far[quote + 2]
        inside = ~edge[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~edge[quote + 2] & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((quote[short], 1), (quote[long], 2)):
            start[found + 1] = False
            then = found + 1 + size
            start[then[then < len(start)]] = True
    return at[start]


def cut_at(buf: np.ndarray, bounds: np.ndarray, starts: np.ndarray, token: bytes) -> np.ndarray:
    """Piece starts where each ``token`` inside a text is one piece, and what is around it is split on its own."""
    whole, found, at = buf.tobytes(), [], -1
    while (at := whole.find(token, at + 1)) >= 0:
        found.append(at)
    first = np.array(found, np.int64)
    first = first[np.searchsorted(bounds, first, "right") == np.searchsorted(bounds, first + len(token) - 1, "right")]  # not across texts
    if not len(first):
        return starts
    last = first + len(token)
    starts = np.union1d(piece_starts(buf, np.union1d(bounds, np.concatenate([first, last]))), np.append(first, last[last < len(buf)]))
    k = np.searchsorted(first, starts, "right") - 1
    return starts[(k < 0) | (starts == first[k]) | (starts >= last[k])]


class Encoder:
    """Ids of whole columns under the ranks of a byte-level BPE; ``added`` is a token, and the one id it is wherever a text has it."""

    def __init__(self, ranks: str, added: tuple[bytes, int] | None = None):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
        # pieces come cut: the pattern takes each whole
        self.core = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
        self.added = {added[0]: [added[1]]} if added else {}
        self.kept: dict[bytes, list[int]] = {}

    def column(self, column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per slice of rows i to j: all ids (uint32) and the rows' bounds."""
        buf, bounds = column_bytes(column)
        for i, j in slices(bounds, limit):
            part, own = buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            starts = piece_starts(part, own)
            for token in self.added:
                starts = cut_at(part, own, starts, token)
            offsets = np.append(starts, len(part)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))]).dictionary_encode()
            coded = []
            for piece in pieces.dictionary.to_pylist():
                ids = self.added.get(piece) or self.kept.get(piece)
                if ids is None:
                    ids = self.core.encode_ordinary(piece.decode())
                    if len(self.kept) < KEPT:
                        self.kept[piece] = ids
                coded.append(ids)
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((x for ids in coded for x in ids), np.uint32, int(size.sum()))
            begin = np.cumsum(size) - size
            of = pieces.indices.to_numpy()
            run = size[of]
            total = np.concatenate([[0], np.cumsum(run)])
            ids = flat[np.repeat(begin[of] - total[:-1], run) + np.arange(total[-1])]
            yield i, j, ids, total[np.searchsorted(starts, own)]


@lru_cache(2)
def encoder(ranks: str, added: tuple[bytes, int] | None = None) -> Encoder:
    return Encoder(ranks, added)
