import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(r.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def prose(words):
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make
