import pytest

#: Words of the texts below: many, so that unrelated texts share no shingles.
WORDS = [f"{a}{b}{c}" for a in "kmprst" for b in ("an", "el", "or", "ui") for c in ("da", "fo", "gu", "ne", "vi")]


def text(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens long, bits string"


def rows() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, repeated rows, and columns with clashing names."""
    base = text(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    texts = [base, base, near, None, "", " \n\t ", "one", "two words", text(2, 40_000), text(3, 80) + "\n" + text(4, 60), text(5, 80) + "\n" + text(4, 60), "é漢字   x  y\t\n z<|endoftext|> q"]
    out = [(k, t, "en" if k % 2 else None, "s", None, 1, "x") for k, t in enumerate(texts)]
    return out + [out[1], (None, "no id at all", None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    from tallyline.llm.queries import vocabulary

    return vocabulary()
