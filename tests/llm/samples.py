"""Invented texts."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n))
