import random

import pytest

# Columns that no operator reads, named like those that operators make themselves.
CLASHING = "score double, part int, chunk string, kept binary, spans string, group long, fp long, key long, ids string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def document(doc_id, text):
    return (doc_id, text, "en", None, None if text is None else len(text), 0.5, 1, None, b"x", "s", 7, 8, 9, None)


def words(seed, n, alphabet=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghéü") for _ in range(rng.randrange(2, 9))) for _ in range(alphabet)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, copies, repeated rows, odd white space and special strings."""
    base = words(1, 120)
    texts = [
        None, "", " ", base, base, base.replace(base.split()[40], "changed"), words(2, 9000), "x" * 30_000, "short",
        "Tabs\tand\r\nlines\n\n\n here   and  there ", "<|endoftext|> <s> </s> <unk> 日本語 😀 Ünï ½ don't WE'LL",
        "a\x00b ﬁ İ Σς é", words(3, 30) + "\n" + base, base.upper(),
    ]
    rows = [document(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, document(None, base), document(None, None), document(9, base), rows[8]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
