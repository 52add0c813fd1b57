"""Tables against a canvas on which every character is put by itself."""

import random

import pytest

from netloom.llm import html_text
from netloom.llm.html_text import extract


def canvas(rows):
    """``rows`` of cells (columns spanned, rows spanned, lines) as a grid of characters."""
    owner, placed = {}, []
    for r, row in enumerate(rows):
        c = 0
        for span, down, lines in row:
            while (r, c) in owner:
                c += 1
            down = min(down, len(rows) - r)
            for i in range(down):
                for j in range(span):
                    owner.setdefault((r + i, c + j), len(placed))
            placed.append((r, c, span, down, lines))
            c += span
    left = dict.fromkeys({c for _, c, *_ in placed} | {c + span for _, c, span, *_ in placed}, 0)
    wide = lambda lines: max((len(x) for x in lines if len(x) <= html_text.WIDEST), default=0)
    for _ in left:  # pushed to the right until nothing collides
        for _, c, span, _, lines in placed:
            left[c + span] = max(left[c + span], left[c] + wide(lines) + 2)
        for c in left:
            left[c] = max(left[d] for d in left if d <= c)
    shown = {}
    for r in range(len(rows)):
        here = [(k, p) for k, p in enumerate(placed) if p[0] <= r < p[0] + p[3]]
        rest = {k: p[4][shown.get(k, 0):] for k, p in here}
        height = max((len(rest[k]) if r == p[0] + p[3] - 1 else min(1, len(rest[k])) for k, p in here), default=0)
        for i in range(height):
            grid = {}
            for k, p in sorted(here, key=lambda x: x[1][1]):
                if i < len(rest[k]):
                    x = left[p[1]]
                    if grid and max(grid) + 3 > x:  # a line that ran over its column
                        x = max(grid) + 3
                    for j, ch in enumerate(rest[k][i]):
                        grid[x + j] = ch
            yield "".join(grid.get(x, " ") for x in range(max(grid, default=-1) + 1))
        for k, _ in here:
            shown[k] = shown.get(k, 0) + height


@pytest.mark.parametrize("seed", range(60))
def test_against_canvas(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 8, 250 if seed % 7 == 0 else 5])))
    rows = [[(rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 1, 2, 3]), [word() for _ in range(rng.choice([0, 1, 1, 1, 2, 4]))]) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 7))]
    markup = "<table>" + "".join("<tr>" + "".join(f"<td colspan={s} rowspan={d}>" + "<br>".join(lines) for s, d, lines in row) for row in rows) + "</table>"
    assert extract(markup).split("\n") == ([line for line in canvas(rows)] or [""])
