"""The state of a chain comes with the rows of its key."""

import hashlib

import pandas as pd

from paperlode.operators.integrity import GENESIS
from paperlode.streaming import chains as C


class _State:
    def __init__(self, value=None):
        self.value, self.updates = value, 0

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


def test_a_key_is_linked_by_the_state_that_comes_with_its_rows():
    state, parts = _State(), [pd.DataFrame({"order_": [3, 1], "payload_": ["c", "a"]}), pd.DataFrame({"order_": [2, 3], "payload_": ["b", "d"]})]
    found = pd.concat(C._append((5,), iter(parts), state))
    prev, want = GENESIS, []
    for k, p in enumerate("abc"):
        digest = hashlib.sha256((prev + p).encode()).hexdigest()
        want.append((5, k + 1, k + 1, prev, digest))
        prev = digest
    assert [tuple(r) for r in found.itertuples(index=False)] == want
    assert state.value == (3, 3, prev) and state.updates == 1
    assert list(C._append((5,), iter(parts), state)) == [] and state.updates == 1
