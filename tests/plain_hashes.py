"""The hashes, a byte string at a time, to hold the vectorised ones against."""

import numpy as np

_M, _MASK = 0xC6A4A7935BD1E995, (1 << 64) - 1


def murmur64(data: bytes, seed: int = 1) -> int:
    """MurmurHash64A, as a signed number."""
    h = seed ^ (len(data) * _M & _MASK)
    n = len(data) & ~7
    for k in np.frombuffer(data[:n], "<u8").tolist():
        k = k * _M & _MASK
        k = (k ^ (k >> 47)) * _M & _MASK
        h = (h ^ k) * _M & _MASK
    if len(data) > n:
        h = (h ^ int.from_bytes(data[n:], "little")) * _M & _MASK
    h = (h ^ (h >> 47)) * _M & _MASK
    h ^= h >> 47
    return h - (1 << 64) if h >> 63 else h


def siphash(data: bytes, k0: int = 0, k1: int = 1) -> int:
    """SipHash-2-4, as a signed number."""
    # the constants of the published algorithm spell "somepseudorandomlygeneratedbytes"
    start = b"somepseudorandomlygeneratedbytes"
    v = [int.from_bytes(start[i : i + 8], "big") ^ (k0, k1)[(i // 8) % 2] for i in range(0, 32, 8)]

    def rounds(n: int) -> None:
        a, b, c, d = v
        for _ in range(n):
            a = (a + b) & _MASK
            c = (c + d) & _MASK
            b = ((b << 13 | b >> 51) & _MASK) ^ a
            d = ((d << 16 | d >> 48) & _MASK) ^ c
            a = (a << 32 | a >> 32) & _MASK
            c = (c + b) & _MASK
            a = (a + d) & _MASK
            b = ((b << 17 | b >> 47) & _MASK) ^ c
            d = ((d << 21 | d >> 43) & _MASK) ^ a
            c = (c << 32 | c >> 32) & _MASK
        v[:] = a, b, c, d

    n = len(data) & ~7
    tail = int.from_bytes(data[n:], "little") | (len(data) & 0xFF) << 56
    for k in [*np.frombuffer(data[:n], "<u8").tolist(), tail]:
        v[3] ^= k
        rounds(2)
        v[0] ^= k
    v[2] ^= 0xFF
    rounds(4)
    h = v[0] ^ v[1] ^ v[2] ^ v[3]
    return h - (1 << 64) if h >> 63 else h
