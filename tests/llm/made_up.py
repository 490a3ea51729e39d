"""Made-up prose."""
import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo") for b in ("da", "fe", "gi", "ho", "ju", "le", "mo", "na")]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))
