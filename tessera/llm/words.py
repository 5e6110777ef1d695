"""Words of a text as 64-bit hashes, a stretch of the text at a time.

Words are runs of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased. A text is read in stretches of ``STRETCH`` bytes; a word that runs over the
end of one is carried into the next. So memory beside the text is a few hashes a word, whatever the length of the text or of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STRETCH = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IN_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def _powers(base: int) -> np.ndarray:
    factors = np.full(STRETCH, base, np.uint64)
    factors[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(factors)


_POWER, _INVERSE = _powers(int(ODD)), _powers(pow(int(ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(value: pa.Scalar) -> np.ndarray:
    """The bytes of a string in an Arrow batch, where they stand; none for null."""
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid and len(value.as_buffer()) else np.empty(0, np.uint8)


def of_text(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def words(raw: np.ndarray, marks: np.ndarray | None = None, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, ...]]:
    """``hashes, lengths, counts`` of the words that end in each stretch.

    ``marks`` has a row of numbers for each of the 256 bytes; ``counts`` are their sums over the bytes of each word (none without marks).
    """
    kept: tuple | None = None
    for at in range(0, max(len(raw), 1), stretch):
        part = raw[at : at + stretch]
        inside = _IN_WORD[part]
        edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        lengths = ends - starts
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], dtype=np.uint64, out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * _INVERSE[starts]
            if marks is None:
                counts = np.empty((len(starts), 0), np.int64)
            else:
                running = np.zeros((len(part) + 1, marks.shape[1]), np.int64)
                np.cumsum(marks[part], axis=0, out=running[1:])
                counts = running[ends] - running[starts]
            if kept is not None:
                if len(part) and inside[0]:
                    hashes[0] = kept[0] + hashes[0] * np.uint64(pow(int(ODD), int(kept[1]), 1 << 64))
                    lengths[0] += kept[1]
                    counts[0] += kept[2]
                else:
                    hashes, lengths, counts = np.insert(hashes, 0, kept[0]), np.insert(lengths, 0, kept[1]), np.insert(counts, 0, kept[2], axis=0)
                kept = None
            if at + stretch < len(raw) and inside[-1]:
                kept = hashes[-1], lengths[-1], counts[-1].copy()
                hashes, lengths, counts = hashes[:-1], lengths[:-1], counts[:-1]
            yield mix(hashes + lengths.astype(np.uint64) * ODD), lengths, counts
