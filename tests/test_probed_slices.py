"""What a task holds of queries and cells."""

import numpy as np

from paperlode.operators import vector_index as V


def test_queries_meet_few_cells_at_a_time():
    matrix, rows = np.ones((1000, 2)), np.arange(1000)
    parts = list(V._slices(matrix, rows, 4096))
    assert max(len(m) * 4096 for m, _ in parts) <= V.HELD_PAIRS
    assert np.concatenate([r for _, r in parts]).tolist() == rows.tolist()
    assert list(V._slices(matrix[:0], rows[:0], 3)) == []
