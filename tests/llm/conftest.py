import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "\x00\x1c é 中文 🙂 <|endoftext|> \\ <| <s>"), (6, "tie tie tie"), (6, "tie tie tie"), (7, "x" * 30_000), (8, "word " * 20_000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash with the operators' own."""
    rows = [(i, t, None, "src", 0, 1.0, "x") for i, t in ODD]
    return spark.createDataFrame(rows, f"{DOCS}, score double, piece string")


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    return lambda n, seed: (lambda r: [r.choice(vocabulary) for _ in range(n)])(random.Random(seed))
