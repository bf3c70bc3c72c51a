import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from glossade.llm.bpe import bpe
from glossade.llm.packing import pack, piece_lengths
from glossade.llm.token_counts import count_tokens

from .conftest import ODD

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_code_point(library):
    """tiktoken splits and merges around every code point as tokenizers does (a code point in many places of one text each)."""
    b = bpe(PATH)
    assert b.fast is not None
    texts = [f"a{c}b 1{c}2 {c} ,{c}{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000][::7]
    for k in range(0, len(texts), 20_000):
        for t, e in zip(texts[k : k + 20_000], library.encode_batch(texts[k : k + 20_000], add_special_tokens=False)):
            assert b.ids(t).tolist() == e.ids, t


def test_splicing(library):
    b, rng = bpe(PATH), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "'s", "12", "<|endoftext|>", "!?", "日本", " \t", "\r\n", "’", "\x1c", "!\x1c", "\x1f ", "\x85"]
    for _ in range(200):
        s = "".join(rng.choices(parts, k=rng.randint(0, 2000)))
        assert b.ids(s, rng.choice([16, 64, 300]), rng.choice([4, 8, 50])).tolist() == ids(library, s)
    for s in ("a" * 5000, " " * 5000, "<|endoftext|>" * 300, "a" * 900 + " " + "b" * 900):
        assert b.ids(s, 64, 8).tolist() == ids(library, s)


def test_counts(spark, make, library):
    got = count_tokens(make(ODD), PATH).collect()
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(ids(library, r[1]))) for r in ODD)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert count_tokens(make([]), PATH).count() == 0


def test_piece_lengths():
    for n in [*range(1, 70), 2047, 2048, 2049, 100_001]:
        p = piece_lengths(n, 64)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 64 for x in p) and p == sorted(p, reverse=True)
        assert len(set(p) - {64}) == len([x for x in p if x < 64])


def test_packing_round_trip(spark, make, library):
    rows = pack(make(ODD), PATH).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.length == 1 << r.bucket and r.offset == 0 and r.length <= 2048
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, t in ODD:
        if d == 5:
            continue
        own = sorted(by[d], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*ids(library, t), 1]
        assert all(r.doc_tokens == len(ids(library, t)) + 1 for r in own)
    assert sum(r.length for r in by[5]) == 2 * (len(ids(library, "same row")) + 1)
    with pytest.raises(ValueError):
        pack(make(ODD), PATH, longest=100)
    assert pack(make([]), PATH).count() == 0
