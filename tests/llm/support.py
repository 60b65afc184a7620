"""Small tables with every awkward case, and brute-force words and hashes."""

import hashlib
import random
import re

from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [f"w{i}" for i in range(400)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text) -> list[str]:
    return re.findall(WORD, text or "")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, source): nulls, empties, copies, a long text, no white space, odd characters."""
    base, other = prose(1, 120), prose(2, 90)
    changed = base.split()
    changed[60] = "changed"
    return [
        (1, base, "a"), (2, base, "b"), (3, base.replace(" ", "\n\t"), "a"), (4, " ".join(changed), None), (5, other, "a"), (6, other + " " + base, "c"),
        (7, None, "a"), (8, "", "b"), (9, " \n\t ", None), (10, "one two three", "a"), (11, "One TWO three", "b"), (12, "x" * 9000, "c"), (13, prose(3, 6000), "c"),
        (14, "naïve Ünïcode 漢字 😀 end here", "d"), (15, base + " " + base, "a"), (16, prose(4, 300), None), (16, prose(4, 300), None), (17, "a b c d e", "b"), (17, "e d c b a", "b"),
    ]


CLASH = ("size", "target", "score", "predicted", "node", "name", "label", "key", "token", "idx", "text_sha256", "order", "bucket", "anchor", "did", "packed", "words", "position", "copies", "base", "spans")


def table(spark, rows, columns="doc_id long, text string, source string", clash=True):
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({c: F.lit(c) for c in CLASH}) if clash else df
