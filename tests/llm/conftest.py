import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def as_docs(spark):
    def build(docs, hosts=None):
        rows = [(d, t, "en", (hosts or {}).get(d, "a"), len(t or "")) for d, t in docs.items()]
        return spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)

    return build


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", ".", "é", "!"]) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", "\n", "  "]) for w in words).strip()


@pytest.fixture(scope="session")
def corpus():
    """Prose, exact and near copies, shared passages and lines, junk, nulls and texts without words."""
    rng = random.Random(7)
    docs, passage, line = {}, prose(rng, 60), "The same line stands in MANY documents."
    for d in range(60):
        docs[d] = prose(rng, rng.randrange(3, 160))
    for d in range(60, 100):
        words = docs[rng.randrange(12)].split(" ")
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        docs[d] = " ".join(words)
    for d in range(100, 120):
        docs[d] = f"{prose(rng, 40)}\n{line}\n{passage}\n{prose(rng, 20)}"
    for d in range(120, 130):
        docs[d] = docs[110]
    docs |= {130: None, 131: "", 132: " \n\t ", 133: "two words", 134: "Two  WORDS", 135: "a b c d", 136: "ab " * 300, 137: "ab " * 300, 138: "\n\n" + line, 139: "é" * 130, 140: "é" * 130}
    docs[141] = prose(rng, 4000, 3000)
    docs[142] = docs[141][5000:9000]
    docs[143] = "### $$$ |x| <b> & % * " + docs[3]
    return docs
