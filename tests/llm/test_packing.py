"""Bin completion against all packings."""

import random
from collections import Counter
from functools import cache

from tidemark.llm import packing


def fewest(pieces, capacity):
    """The fewest sequences by trying, for each sequence, every set of pieces with the longest one left."""

    @cache
    def need(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        seen = set()

        def choose(at, room, kept):
            nonlocal best
            if at == len(rest):
                key = tuple(kept)
                if key not in seen:
                    seen.add(key)
                    best = min(best, 1 + need(key))
                return
            if rest[at] <= room:
                choose(at + 1, room - rest[at], kept)
            choose(at + 1, room, [*kept, rest[at]])

        choose(0, capacity - first, [])
        return best

    return need(tuple(sorted(pieces, reverse=True)))


def check(made, histogram, capacity):
    used = Counter()
    for filling, times in made.fillings:
        assert sum(filling) <= capacity
        for x in filling:
            used[x] += times
    assert used == Counter(histogram) and made.sequences == sum(t for _, t in made.fillings) >= made.bound


def test_plans_of_small_tables_are_optimal():
    rng = random.Random(4)
    won = Counter()
    for n in range(400):
        capacity = rng.choice((20, 30, 50, 60))
        pieces = [rng.randint(1 if n % 2 else capacity // 6, capacity * 3 // 5) for _ in range(rng.randint(1, 9))]
        histogram = Counter(pieces)
        made = packing.solve(histogram, capacity)
        check(made, histogram, capacity)
        assert made.sequences == fewest(pieces, capacity), (capacity, pieces)
        won[made.by] += 1
    assert packing.solve(Counter([11, 12, 12, 14, 17, 18, 18, 21, 21]), 50).sequences == 3
    assert won["bin completion"] > 0


def test_fillings_are_the_undominated_ones():
    rng = random.Random(5)
    for _ in range(200):
        counts = Counter(rng.randint(1, 12) for _ in range(7))
        found = packing.fillings(counts, 15, 15, [10**6])
        wastes = [w for w, _ in found]
        assert found and wastes == sorted(wastes)
        sums = packing._sums(counts)
        assert wastes[0] == 15 - max(k for k in range(16) if sums >> k & 1)  # the fullest filling is never dominated
    assert packing.fillings({5: 2, 9: 1}, 10, 0, [100]) == [(0, {5: 2})]


def test_search_beats_best_fit_on_common_lengths():
    histogram = {44: 300, 29: 300, 27: 600}
    made = packing.solve(histogram, 100)
    check(made, histogram, 100)
    assert made.bound <= made.sequences <= sum(t for _, t in packing.best_fit(histogram, 100))


def test_bound_is_sound_and_sees_large_pieces():
    rng = random.Random(6)
    for _ in range(200):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        assert packing.lower_bound(Counter(pieces), 20) <= fewest(pieces, 20)
    assert packing.lower_bound({2100: 3000, 1: 1500}, 4096) == 3000 and packing.solve({}, 4096).sequences == 0


def test_steps_end_the_search():
    rng = random.Random(7)
    histogram = Counter(rng.randint(700, 1900) for _ in range(400))
    made = packing.solve(histogram, 4096, 20_000)
    check(made, histogram, 4096)
