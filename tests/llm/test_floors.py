"""The signatures' floors of the near-duplicate operator let pairs right at the threshold through."""

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import minhash
from stratalens.llm.hashing import shingle_sets


@pytest.mark.parametrize("seventh", [3, 6, 40])
def test_pairs_at_the_threshold_pass_both_floors(seventh):
    rng = np.random.default_rng(seventh)
    floor, fine_floor = 0.75 - minhash.SLACK, 0.75 - minhash.SLACK * (minhash.BINS / minhash.FINE) ** 0.5
    for _ in range(400):
        words = [f"w{x:x}" for x in rng.integers(0, 1 << 40, 8 * seventh + 4)]
        a, b = words[: 7 * seventh + 4], words[: 6 * seventh + 4] + words[7 * seventh + 4 :]
        x, y = shingle_sets(pa.array([" ".join(a), " ".join(b)]))
        assert 4 * len(set(x) & set(y)) == 3 * len(set(x) | set(y))
        coarse = [minhash.signature(s) & np.uint64(0xFFFF) for s in (x, y)]
        fine = [minhash.signature(s, *minhash._fine()) & np.uint64(0xFF) for s in (x, y)]
        assert (coarse[0] == coarse[1]).mean() >= floor
        assert (fine[0] == fine[1]).mean() >= fine_floor + (1 - fine_floor) / 256
