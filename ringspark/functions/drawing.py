"""Draws of many pairs at once: the md5 uniforms of :func:`ringspark.functions.basic.uniform` in arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
ORDER = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
U = np.uint32


def block(state: list[np.ndarray], words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The state after one more block of 16 words; both broadcast to ``shape``, and no more is held than six arrays of it."""
    a, b, c, d = (np.broadcast_to(x, shape).copy() for x in state)
    f = np.empty(shape, U)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        turn = TURNS[i // 16][i % 4]
        np.add(f, a, out=f), np.add(f, words[ORDER[i]] + U(SINES[i]), out=f)
        np.left_shift(f, U(turn), out=a), np.right_shift(f, U(32 - turn), out=f)
        np.bitwise_or(a, f, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip((a, b, c, d), state, strict=True)]


def packed(texts: list[bytes], start: int, size: int) -> np.ndarray:
    """(words, texts): texts of one length from byte ``start`` on, zeros around them, as the words of ``size`` bytes."""
    out = np.zeros((len(texts), size), np.uint8)
    out[:, start : start + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return np.ascontiguousarray(out.view("<u4").T).astype(U)


def draws(prefix: str, us: list[bytes], vs: list[bytes]) -> np.ndarray:
    """The first 32 bits of md5(prefix + u + ":" + v) of each u and v; us have one length, vs have one length."""
    head = prefix.encode()
    n = len(head) + len(us[0]) + 1 + len(vs[0])
    size = (n + 8) // 64 * 64 + 64
    fixed = np.frombuffer(head + bytes(len(us[0])) + b":" + bytes(len(vs[0])) + b"\x80" + bytes(size - n - 9) + (8 * n).to_bytes(8, "little"), "<u4").astype(U)
    left, right = packed(us, len(head), size), packed(vs, n - len(vs[0]), size)
    words, none = [], np.zeros((1, 1), U)
    for x, u, v in zip(fixed, left, right, strict=True):  # a word is as small as what it depends on
        words.append(x | (u[:, None] if u.any() else none) | (v[None, :] if v.any() else none))
    state = [np.full((1, 1), x, U) for x in START]
    for at in range(0, len(words), 16):
        state = block(state, words[at : at + 16], (len(us), len(vs)))
    return state[0].byteswap()


def by_length(values: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The values, by the length of their decimal texts, with these texts."""
    texts = [b"%d" % x for x in values.tolist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(size).tolist():
        yield values[size == n], [x for x in texts if len(x) == n]


def least(prefix: str, us: np.ndarray, vs: np.ndarray, not_u: np.ndarray, not_v: np.ndarray, at_once: int) -> tuple[int, int, int] | None:
    """(draw, u, v) least of the pairs u < v of two sorted arrays that are not pairs of the other two; None without any."""
    best, numbers = None, list(by_length(vs))
    order = np.argsort(not_u, kind="stable")
    not_u, not_v = not_u[order], not_v[order]
    for own, own_texts in by_length(us):
        for others, texts in numbers:
            rows = max(1, at_once // len(others))
            for at in range(0, len(own), rows):
                u, first = own[at : at + rows], int(np.searchsorted(others, own[at], "right"))
                v = others[first:]
                if not len(v):
                    break
                found = draws(prefix, own_texts[at : at + rows], texts[first:]).astype(np.int64)
                found[v[None, :] <= u[:, None]] = 1 << 32
                lo, hi = np.searchsorted(not_u, u[0], "left"), np.searchsorted(not_u, u[-1], "right")
                x, y = not_u[lo:hi], not_v[lo:hi]
                i, j = np.searchsorted(u, x), np.searchsorted(v, y)
                here = (i < len(u)) & (j < len(v))
                i, j, x, y = i[here], j[here], x[here], y[here]
                same = (u[i] == x) & (v[j] == y)
                found[i[same], j[same]] = 1 << 32
                i, j = np.unravel_index(int(found.argmin()), found.shape)
                one = int(found[i, j]), int(u[i]), int(v[j])
                if one[0] < 1 << 32 and (best is None or one < best):
                    best = one
    return best
