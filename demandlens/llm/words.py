"""Words of UTF-8 texts as numpy arrays: positions and 64-bit hashes.

Every delimiter that the operators use is an ASCII character, so words can be found in the bytes. Equal words always
have equal hashes; different words of at most 8 bytes and equal length never share one, any others as random 64-bit numbers do,
whatever regular pattern the texts have.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are what stands between white space: U+0020 and U+0009 to U+000D.
BETWEEN_SPACES = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
#: Words are runs of digits, a to z and everything outside ASCII (of lower-cased texts).
ALNUM = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_spans(b: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = lut[b]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: Longer byte ranges are hashed one by one.
LONG = 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range: its length and then its 8-byte blocks are stirred in one after the other, each by a
    bijection that isn't linear in the blocks. Ranges over LONG bytes get a cryptographic hash."""
    size = ends - starts
    padded = np.concatenate([b, np.zeros(8, dtype=np.uint8)])
    block = np.ndarray((len(b) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(size <= LONG) if len(size) and size.max() > LONG else None
    at, left, own = (starts, size, out) if rows is None else (starts[rows], size[rows], out[rows])
    done = 0
    live = np.flatnonzero(left > 0)
    while len(live):
        part = block[at[live] + done] & _MASK[np.minimum(left[live] - done, 8)]
        own[live] = mix((own[live] ^ part) * U(0xD6E8FEB86659FD93) + U(0xA0761D6478BD642F))
        done += 8
        live = live[left[live] > done]
    if rows is not None:
        out[rows] = own
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(text: bytes, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_spans(b, lut)
    return starts, ends, span_hashes(b, starts, ends)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values; none if there are fewer."""
    if len(h) < n:
        return h[:0]
    acc = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        acc = acc * U(0xD1B54A32D192ED03) + h[j : len(h) - n + 1 + j]
    return mix(acc + U(n))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted values, each once."""
    h = np.sort(h)
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word runs of a lower-cased text; of fewer words, the whole sequence is the only one."""
    h = word_hashes(text.translate(LOWER), BETWEEN_SPACES)[2]
    return distinct(ngram_hashes(h, min(n, len(h)))) if len(h) else h


def covered(flags: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n positions lie in a run of the given length that starts at a flagged one."""
    step = np.zeros(n + 1, dtype=np.int32)
    at = np.flatnonzero(flags)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0
