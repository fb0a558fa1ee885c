"""Messages of the slices of a large Kneser-Ney model."""

import numpy as np
import pyarrow as pa

from panelweave.llm import kneser_ney


def test_small_counts_take_a_byte_in_messages():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    types = np.uint32, np.uint64, np.int64, np.float64, np.uint8
    sent = []
    for most in (1, 255, 256, 1 << 16, (1 << 32) - 1):
        counts = rng.integers(0, most, 1000, endpoint=True).astype(np.uint32)
        counts[3] = most
        sent.append([counts, keys, counts.astype(np.int64) << (8 if most > 1 << 30 else 0), rng.random(1000), counts.astype(np.uint8)])
    sent.append([np.zeros(0, t) for t in types])
    messages = [kneser_ney._message(*arrays) for arrays in sent]
    assert len(messages[0]) < 20_000 < len(messages[-2])
    for some in ([0], [4], range(len(sent)), []):
        found = kneser_ney._read(pa.array([messages[i] for i in some], pa.binary()), *types)
        for k, t in enumerate(types):
            wanted = np.concatenate([np.zeros(0, t), *(sent[i][k] for i in some)])
            assert found[k].dtype == t and (found[k] == wanted).all()
