"""Word codes of whole texts, computed with array operations on their UTF-8 bytes.

Words are runs without ASCII white space.  A word's code is a polynomial in 64-bit arithmetic over a random value
for each byte; with prefix sums over a block of texts, the codes of all its words take a few array operations.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

from .common import mixed

BLOCK = 1 << 18
SPACES = b" \t\n\x0b\x0c\r"
_ANY_SPACE = re.compile(b"[" + SPACES + b"]")
_P = 0xD1342543DE82EF95
_P_INVERSE = pow(_P, -1, 1 << 64)


@cache
def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, whether it is white space)."""
    value = np.array([xxhash.xxh3_64_intdigest(bytes([b + 32 if lower and 65 <= b <= 90 else b]), seed=11) for b in range(256)], np.uint64)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return value, space


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _P, np.uint64)])),
            np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _P_INVERSE, np.uint64)])))


def _codes(data: np.ndarray, begins: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first bytes) of the words in ``data``; a text begins at each of ``begins``."""
    value, space = _tables(lower)
    power, inverse = _powers(1 << max(18, int(len(data)).bit_length()))
    gap = space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    edge[-1] = True
    first = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
    last = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]])))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value[data] * power[:len(data)])])
    return mixed((sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)), first


def word_codes(text: bytes, lower: bool = False) -> np.ndarray:
    """Codes of one text's words, block by block."""
    parts, at = [], 0
    while at < len(text):
        cut = _ANY_SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        parts.append(_codes(np.frombuffer(text, np.uint8, end - at, at), np.zeros(1, np.int64), lower)[0])
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


def batch_codes(batch: pa.RecordBatch, name: str, lower: bool = False):
    """The codes of each text of a binary or string column, in order (null: no words)."""
    col = batch.column(name)
    if not len(col):
        return
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    nulls = np.zeros(len(col), bool) if not col.null_count else ~col.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(col):
        end = int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1
        if end <= at:  # a text longer than a block
            yield np.empty(0, np.uint64) if nulls[at] else word_codes(data[offsets[at]:offsets[at + 1]].tobytes(), lower)
            at += 1
            continue
        end = min(end, len(col))
        part = data[offsets[at]:offsets[end]]
        begins = offsets[at:end + 1] - offsets[at]
        if len(part):
            codes, first = _codes(part, begins[:-1], lower)
            cuts = np.searchsorted(first, begins)
            for k in range(end - at):
                yield codes[:0] if nulls[at + k] else codes[cuts[k]:cuts[k + 1]]
        else:
            for _ in range(end - at):
                yield np.empty(0, np.uint64)
        at = end
