"""Digests that are put down and taken up, against hashlib."""

import hashlib

import pytest

from glossade.functions import sha256


@pytest.mark.parametrize("blocks", [None, sha256.plain_blocks])
def test_chain(blocks):
    """Any length around whole blocks, in pieces of any length, by states alone; the Python loop and OpenSSL give the same states."""
    data = bytes(n * 7 % 251 for n in range(1000))
    for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 1000):
        state = sha256.START
        for a, b in ((0, n // 3), (n // 3, n // 3), (n // 3, n // 2), (n // 2, n)):
            own = sha256.Chain(state, blocks)
            own.update(memoryview(data)[a:b])
            state = own.state()
        whole = sha256.Chain()
        whole.update(data[:n])
        assert state == whole.state() and own.length == n
        assert sha256.Chain(state, blocks).hexdigest() == hashlib.sha256(data[:n]).hexdigest()


def test_pieces_over_a_step(monkeypatch):
    monkeypatch.setattr(sha256, "STEP", 100)
    own = sha256.Chain()
    own.update(b"abc" * 333)
    assert own.hexdigest() == hashlib.sha256(b"abc" * 333).hexdigest()
