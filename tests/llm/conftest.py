import random

import pytest

BENCH = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil potions under a pale moon tonight"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:2] for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Null, empty, blank, short, very long, repeated, near and exact copies, other scripts."""
    long = prose(1, 9000)
    base = prose(2, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(3, 40)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, long), (7, long + " end"), (8, base), (9, " ".join(near)), (10, base),
        (11, prose(4, 30) + " " + passage + " " + prose(5, 30)), (12, prose(6, 30) + " " + passage), (13, "aaaa" * 200), (14, "aaaa" * 120), (15, "日本語のテキスト " * 20),
        (16, "é" * 40 + " ÀB"), (17, "x" * 64), (8, base), (None, base + " null id"), (18, "To To To To To To To To To To"), (19, prose(7, 10) + " " + BENCH + " " + prose(8, 10)),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge texts with extra columns whose names clash with the operators' own."""
    data = [(i, t, "en", "s", len(t or ""), "x", 1.0, None) for i, t in edge_texts()]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
