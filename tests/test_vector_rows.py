"""Large rows become Python objects one at a time."""

from types import SimpleNamespace

from mnemospark.operators.vector_index import _rows


def test_rows_come_one_at_a_time():
    read = []

    class Cell:
        def __init__(self, i):
            self.i = i

        def as_py(self):
            read.append(self.i)
            return self.i

    class Batch(SimpleNamespace):
        def __len__(self):
            return 3

    rows = _rows(Batch(columns=[[Cell(i) for i in range(3)]] * 2))
    assert next(rows) == (0, 0) and read == [0, 0]
    assert list(rows) == [(1, 1), (2, 2)]
