"""Texts are taken in pieces: results of a large frame are given back before all are made."""

import pandas as pd

from corpusmill.functions.frames import PIECE_ROWS, pieces
from corpusmill.operators import diff, scopes


class Lazy:
    """Stands for files: runs what it is given over one frame, and counts the results."""

    def __init__(self, frame):
        self.frame, self.sizes = frame, []

    def select(self, *names):
        return self

    def mapInPandas(self, f, schema):
        self.sizes = [len(x) for x in f(iter([self.frame]))]
        return self


def test_pieces_hold_all_rows_in_order():
    frame = pd.DataFrame({"x": range(2 * PIECE_ROWS + 1)})
    found = list(pieces(iter([frame, frame.iloc[:0], frame.iloc[:3]])))
    assert [len(x) for x in found] == [PIECE_ROWS, PIECE_ROWS, 1, 3]
    assert [x for p in found for x in p["x"]] == [*range(2 * PIECE_ROWS + 1), 0, 1, 2]


def test_diffs_and_scopes_give_results_piece_by_piece():
    n = 1500
    pairs = pd.DataFrame({"path": [f"p{k}" for k in range(n)], "old_path": None, "status": "modified", "old": "a\n", "new": "b\n"})
    made = diff.hunks(Lazy(pairs))
    assert sum(made.sizes) == n and max(made.sizes) == PIECE_ROWS
    files = pd.DataFrame({"path": [f"p{k}" for k in range(n)], "language": "python", "content": "def f(): pass\n"})
    made = scopes.scopes(Lazy(files))
    assert sum(made.sizes) == n and len(made.sizes) == 2
