import numpy as np
import pytest

from tesserae.llm.suffix import permuted_lcp, suffix_array


def naive(b):
    return sorted(range(len(b)), key=lambda i: b[i:])


CASES = [b"", b"a", b"ab", b"ba", b"aaaaaaaa", b"mississippi", b"abababababab", b"banana" * 30, bytes(range(256)) * 3, b"\0\0\1\0\0\1\0", b"zyx" * 40 + b"a" * 300]
rng = np.random.default_rng(4)
CASES += [bytes(rng.integers(0, k, n, np.uint8)) for k, n in ((2, 500), (3, 2000), (256, 3000), (20, 4000))]
CASES += [bytes(rng.integers(97, 101, 300, np.uint8)) * 7]


@pytest.mark.parametrize("b", CASES)
def test_array_and_shared_prefixes(b):
    t = np.frombuffer(b, np.uint8).astype(np.uint16) + 1
    sa = suffix_array(t)
    want = naive(b)
    assert sa.tolist() == want == suffix_array(t, recurse=0).tolist() == suffix_array(t, recurse=1 << 20).tolist()
    lcp = permuted_lcp(t, sa, 50)
    for r, i in enumerate(want):
        n = 0
        if r:
            x, y = b[want[r - 1] :], b[i:]
            while n < min(len(x), len(y), 50) and x[n] == y[n]:
                n += 1
        assert lcp[i] == n
