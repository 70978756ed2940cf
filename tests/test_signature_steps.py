import numpy as np

from clipmill.functions import shingles as S


def test_signatures_in_small_steps():
    """Steps that fit the cache, and the same minima as all names at once."""
    assert S.SIGNED * S.LANES * 8 <= 1 << 18
    names = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 1000)
    h = names.view(np.uint64)[:, None] * S.MULTIPLY + S.ADD
    assert (S.signature_of(names) == ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64).min(0)).all()
