"""Line diffs: they apply, are short, and name renamed files."""

import random

import pytest

from corpusmill.operators import diff, transcript


def shortest(a, b):
    """Lines dropped and added by the shortest diff, by the table of longest common sequences."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return len(a) + len(b) - 2 * table[0][0]


def cost(found):
    return sum(e[1] - e[0] + e[3] - e[2] for e in found)


@pytest.mark.parametrize("seed", range(4))
def test_diffs_apply_and_are_short(seed):
    r = random.Random(seed)
    for _ in range(150):
        old = [r.choice("abcdefghij") * r.randrange(1, 3) for _ in range(r.randrange(0, 25))]
        new = list(old)
        for _ in range(r.randrange(0, 6)):
            at = r.randrange(len(new) + 1)
            new[at : at + r.randrange(3)] = [r.choice("abcxyz") for _ in range(r.randrange(3))]
        before, after = "\n".join(old) + r.choice(["", "\n"]), "\n".join(new) + r.choice(["", "\n"])
        hunks = diff.unified(before, after, r.randrange(4))
        assert diff.patched(before, [h[4] for h in hunks]) == after
        a, b = diff.lines(before), diff.lines(after)
        found = diff.edits(a, b)
        assert all(x[1] < y[0] or x[3] < y[2] for x, y in zip(found, found[1:]))
        if not diff._anchors(a, b, 0, len(a), 0, len(b)):
            assert cost(found) == shortest(a, b)
        assert cost(found) <= 2 * shortest(a, b) + 4
        assert bool(hunks) == (before != after)


def test_gaps_with_many_changes_are_replaced():
    a, b = [str(k % 7) for k in range(300)], [str(k % 5) for k in range(280)]
    few, all_ = diff.edits(a, b, 10), diff.edits(a, b, 10_000)
    assert cost(few) >= cost(all_) == shortest(a, b)
    assert diff.patched("\n".join(a), [h[4] for h in diff.unified("\n".join(a), "\n".join(b))]) == "\n".join(b)


def test_moved_blocks_keep_their_anchors():
    old = [f"line {k}\n" for k in range(1000)]
    new = old[:100] + ["in\n"] + old[100:500] + old[520:] + ["end"]
    assert diff.edits(old, new) == [(100, 100, 100, 101), (500, 520, 501, 501), (1000, 1000, 981, 982)]


def test_a_hunk_that_does_not_fit():
    hunks = [h[4] for h in diff.unified("a\nb\nc", "a\nx\nc")]
    assert diff.patched("a\nb\nc", hunks) == "a\nx\nc"
    with pytest.raises(ValueError, match="line 2"):
        diff.patched("a\nz\nc", hunks)


def test_files_of_two_versions(spark):
    old = [("same", "s"), ("mod", "a\nb\nc\n"), ("gone", "x\ny"), ("from/a", "moved\ntext"), ("from/b", "moved\ntext"), ("blank", ""), ("null", None)]
    new = [("same", "s"), ("mod", "a\nB\nc\nd"), ("to/a", "moved\ntext"), ("born", "n\n"), ("blank2", "")]
    before, after = (spark.createDataFrame(x, "path string, content string") for x in (old, new))
    pairs = diff.paired(before, after)
    found = diff.hunks(pairs)
    told = {r.path: (r.old_path, r.status) for r in found.collect()}
    assert told == {"mod": (None, "modified"), "gone": (None, "deleted"), "to/a": ("from/a", "renamed"), "from/b": (None, "deleted"), "born": (None, "added"), "blank": (None, "deleted"), "blank2": (None, "added")}
    back = {r.path: r.content for r in diff.applied(before, found).collect()}
    assert back == {**dict(new), "null": None}
    text = diff.text(found)
    parsed = {r.path: (r.status, r.hunks, r.additions, r.deletions, r.old_path) for r in transcript.parse_diff(text.select(text.path.alias("diff_id"), "text")).collect()}
    assert parsed == {"mod": ("modified", 1, 2, 1, None), "gone": ("deleted", 1, 0, 2, None), "to/a": ("renamed", 0, 0, 0, "from/a"), "from/b": ("deleted", 1, 0, 2, None), "born": ("added", 1, 1, 0, None), "blank": ("deleted", 0, 0, 0, None), "blank2": ("added", 0, 0, 0, None)}
    ranges = {r.path: (r.old_first, r.old_lines, r.new_first, r.new_lines) for r in transcript.parse_hunks(text.select(text.path.alias("diff_id"), "text")).collect()}
    assert ranges == {r.path: (r.old_first, r.old_lines, r.new_first, r.new_lines) for r in found.collect() if r.nth}
