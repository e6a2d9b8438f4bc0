"""Documents of just over half a sequence leave little padding."""

import numpy as np

from rowferry.llm import packing


def test_documents_over_half_a_sequence_are_packed_whole():
    rng = np.random.default_rng(4)
    for lengths in ([2100] * 700, rng.integers(2049, 4096, 500).tolist(), [2100] * 3, [4096] * 5, [1], [0], []):
        docs = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(lengths)]
        found = list(packing.pack_rows(iter(docs), 0, 4096, 4096, 256))
        filled = {}
        for _, _, n, ids, _, sequence, at, _ in found:
            assert n > 0 and len(ids) == 4 * n and at == filled.get(sequence, 0)
            filled[sequence] = at + n
        assert all(n <= 4096 for n in filled.values())
        assert len(filled) <= 1.04 * sum(lengths) / 4096 + 2
        for i, ids in docs:
            parts = sorted((r[1], r[3]) for r in found if r[0] == i)
            assert b"".join(p for _, p in parts) == ids
