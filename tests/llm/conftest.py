import random

import pytest

TEXTS = [
    None, "", "   \n\t ", "a", "Hello, World! don't STOP", "ﬁne café naïve ÉTÉ Σίσυφος", "x" * 3000, "word " * 4000, "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>",
    "tabs\tand\nlines\r\n  double  spaces ", "中文字符 और हिन्दी 👍🏽", "\x1c\x1f\x85 odd space", "a\u0000b", "12 345 6.7e8", "▁mark ▁▁ x", "² ½ Ⅷ ٣ _ 1",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, one of them twice, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, f"l{i}", i, "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "l4", 4, "s"), (None, "no id here", "x", 0, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_tokens int, node string")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(n))
