from __future__ import annotations

import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    """Words drawn with a frequent head."""
    return ["w" + LETTERS[i % 26] + LETTERS[i // 26 % 26] for i in (min(int(rng.expovariate(1 / (vocabulary / 4))), vocabulary) for _ in range(n))]


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of all lengths with exact and near copies, odd rows, and columns whose names clash with results'."""
    rng, rows = random.Random(5), []
    for i in range(60):
        rows.append((i, " ".join(words(rng, rng.choice([1, 2, 5, 30, 120, 400])))))
    for i in range(60, 75):  # near copies
        base = rows[i - 60][1].split()
        if len(base) > 20:
            base[rng.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base).upper() if i % 2 else " ".join(base)))
    rows += [(75, rows[3][1]), (76, rows[3][1]), (77, None), (78, ""), (79, " \t\n"), (80, "!!! ... 123"), (81, " ".join(words(rng, 6000))), (82, "Äpfel ÉTÉ ﬁne\u0301 İstanbul Σς <|endoftext|> it's 12,5"), (3, rows[3][1])]
    full = [(i, t, "en" if i % 5 else None, f"src{i % 3}", len(t or ""), 0.5, "clash") for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("false")
