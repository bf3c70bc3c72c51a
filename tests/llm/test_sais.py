import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossade.llm import sais


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([1, 3, 8, 2048]), st.sampled_from([0, 9_000]))
def test_suffix_array_and_prefixes(values, batch, gap):
    values = [v + gap if v else v for v in values]
    old, sais.BATCH = sais.BATCH, batch
    try:
        sa = sais.suffix_array(np.array(values, dtype=np.int64))
    finally:
        sais.BATCH = old
    assert sa.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    lcp = sais.permuted_lcp(np.array(values, dtype=np.int64), sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while max(a, b) + n < len(values) and values[a + n] == values[b + n]:
            n += 1
        assert lcp[b] == n


def test_many_names():
    """More names on the second level than two bytes tell apart."""
    rng = np.random.default_rng(1)
    part = rng.integers(0, 200, 150_000)
    values = np.concatenate([part, rng.integers(0, 200, 300_000), part])
    sa = sais.suffix_array(values)
    assert np.array_equal(np.sort(sa), np.arange(len(values)))
    rank = np.empty(len(values) + 1, dtype=np.int64)
    rank[sa], rank[-1] = np.arange(len(values)), -1
    a, b = sa[:-1], sa[1:]
    assert ((values[a] < values[b]) | ((values[a] == values[b]) & (rank[a + 1] < rank[b + 1]))).all()  # which only the suffix array fulfils
