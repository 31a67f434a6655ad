import random
import time

from loomseries.functions import text as tx


def table_walk(a, b):
    """The whole table, walked from its end."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    i, j, found = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.append(a[i])
        elif rows[i - 1][j] < rows[i][j - 1]:
            j -= 1
        else:
            i -= 1
    return "".join(reversed(found))


def test_rows_computed_again_give_the_same_walk():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 30))) for _ in range(2))
        for cells in (1, 60, 1 << 24):
            assert tx._lcs_text(a, b, cells) == table_walk(a, b)
        assert tx._lcs_length(a, b) == len(table_walk(a, b))


def test_long_texts_fit():
    rng = random.Random(2)
    a, b = ("".join(rng.choices("ab", k=20_000)) for _ in range(2))  # the table would take 1.6 GB
    start = time.monotonic()
    found = tx._lcs_text(a, b)
    assert len(found) == tx._lcs_length(a, b) and time.monotonic() - start < 60
