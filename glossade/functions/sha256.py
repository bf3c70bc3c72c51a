"""SHA-256 that can be put down and taken up elsewhere: a chain over bytes of which no process holds, or reads, all."""

from __future__ import annotations

import struct
from functools import cache

#: State before the first byte, as Chain.state() gives it: eight words, the number of bytes so far, and those of the last block that is not full.
START = struct.pack(">8IQ", 0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19, 0)
#: Bytes that are copied at a time.
STEP = 4 << 20


@cache
def _constants() -> list[int]:
    """The first 32 bits of the fractions of the cube roots of the first 64 primes."""
    primes = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
    roots = []
    for p in primes:
        x = round(p ** (1 / 3) * 2**32)
        while x**3 > p << 96:
            x -= 1
        while (x + 1) ** 3 <= p << 96:
            x += 1
        roots.append(x & 0xFFFFFFFF)
    return roots


def plain_blocks(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
    """The eight words after whole blocks of 64 bytes, in Python alone: right wherever there is no OpenSSL, and about a thousand times as slow."""
    k, m = _constants(), 0xFFFFFFFF
    turned = lambda x, n: x >> n | x << 32 - n
    for at in range(0, len(data), 64):
        w = list(struct.unpack_from(">16I", data, at))
        for i in range(16, 64):
            a, b = w[i - 15], w[i - 2]
            w.append(w[i - 16] + w[i - 7] + ((turned(a, 7) ^ turned(a, 18) ^ a >> 3) & m) + ((turned(b, 17) ^ turned(b, 19) ^ b >> 10) & m) & m)
        a, b, c, d, e, f, g, h = words
        for i in range(64):
            x = h + ((turned(e, 6) ^ turned(e, 11) ^ turned(e, 25)) & m) + (e & f ^ ~e & g) + k[i] + w[i]
            y = ((turned(a, 2) ^ turned(a, 13) ^ turned(a, 22)) & m) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = x + y & m, a, b, c, d + x & m, e, f, g
        words = tuple(p + q & m for p, q in zip(words, (a, b, c, d, e, f, g, h)))
    return words


@cache
def _blocks():
    """plain_blocks() by the OpenSSL that hashlib is linked to: its SHA256_CTX holds the words openly. plain_blocks() where that can't be had or differs."""
    try:
        import ctypes

        import _hashlib

        class State(ctypes.Structure):
            _fields_ = [("words", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("size", ctypes.c_uint), ("spare", ctypes.c_uint8 * 64)]

        lib = ctypes.CDLL(_hashlib.__file__)  # its symbols and those of the libraries it needs
        init, update = lib.SHA256_Init, lib.SHA256_Update
        init.argtypes, update.argtypes = [ctypes.POINTER(State)], [ctypes.POINTER(State), ctypes.c_char_p, ctypes.c_size_t]
    except (ImportError, OSError, AttributeError):
        return plain_blocks

    def blocks(words: tuple[int, ...], data: bytes) -> tuple[int, ...]:
        own = State()
        init(own)
        own.words[:] = words
        update(own, data, len(data))
        return tuple(own.words)

    sample, first = bytes(range(256)), struct.unpack(">8I", START[:32])
    return blocks if blocks(blocks(first, sample), sample) == plain_blocks(first, sample * 2) else plain_blocks


class Chain:
    """A SHA-256 from a state on: that of another Chain, in whatever process, or START."""

    def __init__(self, state: bytes = START, blocks=None):
        *words, self.length = struct.unpack_from(">8IQ", state)
        self.words, self.rest, self.blocks = tuple(words), state[40:], blocks or _blocks()

    def update(self, data: bytes | memoryview) -> None:
        view = memoryview(data)
        for at in range(0, len(view), STEP):
            own = self.rest + bytes(view[at : at + STEP])
            cut = len(own) - len(own) % 64
            self.words, self.rest = self.blocks(self.words, own[:cut]), own[cut:]
        self.length += len(view)

    def state(self) -> bytes:
        return struct.pack(">8IQ", *self.words, self.length) + self.rest

    def hexdigest(self) -> str:
        end = self.rest + b"\x80" + b"\0" * ((55 - self.length) % 64) + struct.pack(">Q", 8 * self.length)
        return struct.pack(">8I", *self.blocks(self.words, end)).hex()
