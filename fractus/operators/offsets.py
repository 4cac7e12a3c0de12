"""The 26-neighbourhood."""

from itertools import product

OFFSETS = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]
HALF = [o for o in OFFSETS if o > (0, 0, 0)]
