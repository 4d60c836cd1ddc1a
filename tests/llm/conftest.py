import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def say(rng):
    return lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
