"""Key ranges of about equal rows for parallel reads of a table.

Equal steps between the smallest and the largest key leave most readers idle
where keys have gaps or cluster. Here the source counts its rows per key
bucket (one aggregate a round, a bounded number of rows back), crowded buckets
are counted again in finer steps, and ranges are cut where rows are.

The predicates cover every value once whatever the counts were: the first also
takes NULLs and all smaller keys, the last all larger ones, so rows added
between counting and reading are read as well. A single key value can't be
split by a range; use a column whose values are (nearly) unique.
"""

from __future__ import annotations

from collections.abc import Callable

# (low, width, highest key) -> [(bucket number, rows)] of the keys in low .. highest.
Counter = Callable[[int, int, int], list[tuple[int, int]]]
# Buckets a round counts for each wanted range, and rounds at most.
FINER, ROUNDS = 8, 6


def bounds_sql(table: str, column: str) -> str:
    """Smallest and largest key, in SQL any database reads."""
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"


def counts_sql(table: str, column: str, low: int, width: int, high: int) -> str:
    """Rows per bucket of ``width`` keys from ``low`` to ``high``; only filled buckets come back."""
    at = f"({column} - {low})"
    # Less the remainder, the division is whole in databases that divide to fractions too.
    bucket = f"({at} - ({at} % {width})) / {width}" if width > 1 else at
    return (f"SELECT {bucket} AS bucket, COUNT(*) AS n FROM {table} "
            f"WHERE {column} >= {low} AND {column} <= {high} GROUP BY {bucket}")


def fill_ranges(low: int, high: int, tasks: int, count: Counter, *, finer: int = FINER, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Filled key ranges ``(first, last, rows)`` in order, none crowded unless it is one key or the rounds are used up.

    A range is crowded when it holds more than its share (all rows by ``tasks``).
    A round counts each crowded range in up to ``finer * tasks`` buckets; at
    most ``2 * tasks`` ranges can be crowded, whatever the table's size.
    """
    def counted(a: int, b: int) -> list[tuple[int, int, int]]:
        width = max(1, -(-(b - a + 1) // (finer * tasks)))
        return sorted((a + round(i) * width, min(b, a + (round(i) + 1) * width - 1), int(n)) for i, n in count(a, width, b))

    filled = counted(low, high)
    share = -(-sum(n for *_, n in filled) // tasks)
    for _ in range(rounds):
        crowded = [r for r in filled if r[2] > share and r[0] < r[1]]
        if not crowded:
            break
        filled = sorted([r for r in filled if r not in crowded] + [piece for a, b, _ in crowded for piece in counted(a, b)])
    return filled


def cut_points(filled: list[tuple[int, int, int]], tasks: int) -> list[int]:
    """First keys of the second and later ranges: cut before a piece that would overfill the running range."""
    share, cuts, held = -(-sum(n for *_, n in filled) // tasks) if filled else 0, [], 0
    for first, _, n in filled:
        if held and held + n > share:
            cuts.append(first)
            held = 0
        held += n
    return cuts


def range_predicates(column: str, cuts: list[int]) -> list[str]:
    """One predicate a range; together they hold for every row exactly once, NULL keys in the first."""
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def plan_reads(column: str, tasks: int, bounds: Callable[[], tuple[int | None, int | None]], count: Counter) -> list[str]:
    """Predicates of about ``tasks`` (at most twice as many) ranges with about equal rows."""
    low, high = bounds()
    if low is None or tasks < 2:
        return range_predicates(column, [])
    return range_predicates(column, cut_points(fill_ranges(int(low), int(high), tasks, count), tasks))
