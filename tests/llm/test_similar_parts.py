"""Every pair that meets in a part of the pipeline's near-dedup stage is checked."""

import numpy as np

from loomwright.llm import similar
from loomwright.llm.simhash import local_roots


def test_strangers_in_a_bucket_hide_no_pair(monkeypatch):
    """Rows with equal or close table values, in which near pairs lie between strangers."""
    rng = np.random.Generator(np.random.PCG64(4))
    n, bits, lead = 600, 32, 4
    family = np.arange(n) % 200  # three true copies each
    rng.shuffle(family)
    flips = np.array([sum(1 << int(k) for k in rng.choice(np.arange(32, 60), int(rng.integers(0, 4)), replace=False)) for _ in range(n)], dtype=np.uint64)
    value, left = np.uint64(0xA5A5A5A500000000) ^ flips, np.full(n, similar.HALF)
    near = lambda a, b: family[a] == family[b]
    far = np.bitwise_count(value[:, None] ^ value[None, :])
    want = local_roots(n, *np.nonzero((far <= 4) & (family[:, None] == family[None, :])))
    a, b = similar.meet(value, left, lead, bits)
    ok = near(a, b)
    neighbours = local_roots(n, a[ok], b[ok])
    assert (neighbours != want).any()  # neighbours alone lose pairs
    for tile in ((256, 8192), (7, 50)):
        monkeypatch.setattr(similar, "TILE", tile)
        for first in (neighbours, np.arange(n)):
            assert (similar.sweep(value, left, first, near) == want).all()
