import random

import pytest

WORDS = "the of and river stone cloud amber winter paper morning silver garden window bridge market thunder".split()


@pytest.fixture
def prose():
    """prose(n, seed): a text of n words."""

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))

    return make
