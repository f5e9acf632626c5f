import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, src int, shard int, bucket int, fp string, label int"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["an", "or", "ti", "she", "lo", "ver", "mi", "da"]) for _ in range(draw.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, blanks, ties, repeated rows, copies and one long text."""
    out = [(k, prose(k, 20 + 7 * (k % 9)), "en", f"s{k % 4}" if k % 6 else None, 1, 0.5, k, k, k, "x", 1) for k in range(60)]
    copy = out[3][1]
    out += [(100 + k, copy, "en", "hot", 1, None, None, None, None, None, None) for k in range(30)]  # exact copies
    out += [(200 + k, prose(5, 300) + f" tail{k}", "en", "hot", 1, 0.1, 1, 1, 1, "y", 0) for k in range(10)]  # near copies
    out += [out[7], out[7]]  # repeated rows
    out += [(300, None, None, None, None, None, None, None, None, None, None), (301, "", "en", "s1", 0, 0.0, 0, 0, 0, "", 0), (302, " \t\n ", "en", "s2", 4, 0.0, 0, 0, 0, "", 0)]
    out += [(303, "one", "en", "s3", 3, 0.0, 0, 0, 0, "", 0), (304, prose(8, 20_000), "en", "s1", 9, 0.0, 0, 0, 0, "", 0), (305, "É" * 70_000, "fr", "s1", 9, 0.0, 0, 0, 0, "", 0)]
    out += [(None, prose(11, 30), "en", "s0", 3, 0.0, 0, 0, 0, "", 0), (None, None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
