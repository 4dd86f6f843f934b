"""The cuts minimise the stated cost with the powers of two of production."""

import random

from quietlog.llm import packing


def pad(n, width):
    return 0 if n & (n - 1) == 0 else width - n


def test_every_power_below_the_width_needs_no_padding():
    assert packing.POWERS == (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048) and packing.WIDTH == 4096


def test_cuts_with_all_powers_are_the_cheapest():
    r = random.Random(6)
    for width in [*[100] * 30, *[700] * 30, *[packing.WIDTH] * 10]:
        place = [0]
        while len(place) < 60:
            place.append(place[-1] + r.choice([1, 2, 3, 8, 17, 32, 64, 96, r.randint(1, width)]))
        place = [p for i, p in enumerate(place) if not i or p - place[i - 1] <= width]
        price = [0, *(r.choice([0, packing.SENTENCE, packing.ANYWHERE]) for _ in place[1:])]
        best = [0] + [10**9] * (len(place) - 1)
        for j in range(1, len(place)):
            best[j] = min((best[i] + pad(place[j] - place[i], width) for i in range(j) if place[j] - place[i] <= width), default=10**9) + price[j]
        ends = [0, *packing.cuts(place, price, width)]
        assert sum(pad(b - a, width) + price[place.index(b)] for a, b in zip(ends, ends[1:], strict=False)) == best[-1]
