"""Small tables that every operator must handle, and plain versions of what they compute."""

import hashlib
import random
import re

LONG = " ".join(f"word{k % 977} shared passage" for k in range(20_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while"


def odd_rows():
    """``doc_id, text, lang, source, n_chars`` with nulls, empties, a very long text, ties and repeated rows."""
    texts = [None, "", " ", "a", "a b", LONG, PASSAGE, PASSAGE, PASSAGE + " again", "x " + PASSAGE, "é" * 60, "\x00\ufffd\t", "UPPER lower 123", "UPPER lower 123"]
    rows = [(k, t, None if k % 3 else "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, PASSAGE, None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def with_clashes(df):
    """``df`` with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("score", "spans", "items", "n_words", "n_hit", "fp", "id", "key", "shard", "part", "size", "component_id", "n_removed", "bin", "host", "found", "kept_id", "kept_d", "digest", "tillmark_digest", "root", "node", "grp", "sub")
    return df.select("*", *(F.lit("theirs").alias(c) for c in names))


def corpus(n=120, seed=5):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(700)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(5)]
    out = []
    for k in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.35:
            w = rng.choice(out).split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300)))
            out.append(t + "\n" + rng.choice(passages) if kind > 0.8 else t)
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(out)]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())
