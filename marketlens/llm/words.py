"""Words of texts as numpy arrays, and 64-bit hashes of words and of runs of words.

A word is ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` yields. Hashes are polynomial
prefix sums modulo 2**64, so any run's hash is one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers = {m: np.ones(1, np.uint64) for m in (_MULT, _INVERSE)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as longer texts arrive."""
    have = _powers[base]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values`` against rising powers, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_MULT, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever that run of values stands."""
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def _each(texts: list[str | None] | pa.Array) -> Iterator[str | None]:
    """The texts, a few hundred of an Arrow column at a time as Python strings."""
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        yield from part.to_pylist() if isinstance(part, pa.Array) else part


def chunked(texts: list[str | None] | pa.Array, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts) of runs of about ``most`` bytes, CHUNK_BYTES unless given; a null counts as empty."""
    most = CHUNK_BYTES if most is None else most
    first, size, held = 0, 0, []
    for i, text in enumerate(_each(texts)):
        raw = text.encode() if text else b""
        if held and size + len(raw) > most:
            yield first, held
            first, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds): words of raws[i] are hashes[bounds[i]:bounds[i + 1]]."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span(prefix(_BYTE[data]), start, end)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)])
