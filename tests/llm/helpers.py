"""Small tables with the awkward cases, and brute-force versions."""

import itertools
import random
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, repeated rows, texts without letters, near and exact copies."""
    base = words(1, 120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", None),
        (3, base.replace(" ", " x ", 1), None, "a"),
        (4, None, "en", "a"),
        (5, "", "de", "a"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (6, words(2, 20_000), "de", "a"),
        (7, words(3, 60) + " mail someone@example.org now " + words(1, 120), "en", "b"),
        (7, words(3, 60) + " mail someone@example.org now " + words(1, 120), "en", "b"),
        (8, "12345 ... !!! 4111 1111 1111 1111 , 1.2.3.4 +49 (30) 1234-5678", "en", "b"),
        (9, "ß é 漢字 🙂   tab\tnew\nline", "fr", "b"),
        (10, "one", "en", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def clashing(docs):
    """docs with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "nameless", "ranges", "terms", "term", "kept", "label", "hub", "component_id", "rank", "task", "n", "_nth")
    return docs.withColumns({c: F.lit(c) for c in names})


def linked_components(texts: dict[int, str | None], n: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of its set, component) by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        m = min(n, len(w))
        sets[i] = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def removed(texts: list[str | None], length: int) -> list[tuple[bytes, int]]:
    """What is left of each text, and the number of removed runs."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((bytes(b for b, g in zip(d, gone) if not g), sum(1 for k, g in itertools.groupby(gone) if k)))
    return out
