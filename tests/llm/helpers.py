"""Plain versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, first=0, clash=True):
    """A documents table of the texts, with extra columns whose names clash with the operators' own."""
    rows = [(first + i if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, "en", "s", 0, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, length int")
    return df if clash else df.drop("digest", "length")


def prose(seed=0, n=60, copies=True):
    """Texts with copies, near copies, shared passages, repeats, empty and null ones."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijé ") for _ in range(r.randrange(1, 8))).strip() or "a" for _ in range(150)]
    passage = " ".join(r.choice(vocab) for _ in range(90))
    out = []
    for _ in range(n):
        k = r.random()
        body = " ".join(r.choice(vocab) for _ in range(r.choice([0, 3, 8, 40, 120, 300])))
        if out and copies and k < 0.2:
            body = r.choice(out) or ""
        elif out and copies and k < 0.4:
            w = (r.choice(out) or "x").split(" ")
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            body = " ".join(w)
        elif k < 0.55:
            body = f"{body} {passage[r.randrange(60):]}\n{body[:30]}"
        out.append(body)
    return [*out, None, "", " \n\t ", "word " * 700, "é" * 300]
