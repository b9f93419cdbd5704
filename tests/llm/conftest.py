import hashlib
import random
import re

import pytest

SF = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Columns that no operator may trip over.
CLASHING = ["id", "n", "size", "key", "rows", "block", "kept", "host", "rule", "ids", "_id", "_size", "h", "class", "taken"]


@pytest.fixture
def documents(spark):
    """Builds a documents table of (doc_id, text[, source]) with clashing extra columns."""
    def build(rows, partitions=3):
        rows = [(*r, None) if len(r) == 2 else r for r in rows]
        extra = ", ".join(f"{c} string" for c in CLASHING)
        df = spark.createDataFrame([(i, t, s, *["x"] * len(CLASHING)) for i, t, s in rows],
                                   f"doc_id long, text string, source string, {extra}")
        return df.repartition(partitions)
    return build


@pytest.fixture
def odd_texts():
    """Null, empty, blank, control, long and repeated texts."""
    rnd = random.Random(7)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "Delta", "naïve", "日本"]) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "One"), (5, "one"), (6, "One"), (6, "One"), (None, "none"),
            (7, "x" * 50_000), (8, long), (9, "a b c\n" * 400), (10, "\x00\x85\u2028 é́ 😀 <|endoftext|> </s>[INST]"), (6, "other")]


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
