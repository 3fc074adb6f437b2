"""Small document tables with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    while len(out) < words:
        line = ["".join(rng.choices("abcdeéoßrstn", k=rng.randint(2, 9))) for _ in range(12)]
        out += [*line[:-1], line[-1] + "."]
    return " ".join(out[:words])


def edited(text: str, every: int, seed: int) -> str:
    words = text.split(" ")
    for k in range(seed % every, len(words), every):
        words[k] = f"x{seed}y{k}"
    return " ".join(words)


def documents() -> list[tuple]:
    base, other = prose(1, 160), prose(2, 120)
    passage = prose(3, 60)
    rows = [
        (0, base, "en", "b"),
        (1, base, "en", "a"),  # exact copy
        (2, edited(base, 150, 5), "en", "a"),  # near copy
        (3, edited(base, 12, 1), None, "c"),  # too far away
        (4, None, "en", "a"),
        (5, "", "en", None),
        (6, " \t\n ", "en", "a"),
        (7, "one two three", "en", "b"),
        (8, "One two  three", "en", "b"),
        (9, "\n".join([prose(9, 24), "Menu | Home | About | News", prose(19, 24), "ok."]), "en", "a"),
        (10, "a b c d e f g h " * 30, "en", "c"),
        (11, other + "\n" + passage, "en", "a"),
        (12, passage + "\n" + prose(12, 100), "de", "a"),
        (13, prose(13, 6000), "en", "a"),  # very long
        (14, "Released under the MIT License.\n" + prose(14, 40), "en", "d"),
        (15, "a" * 120, "en", "d"),
        (16, "### $$$ %%% " * 20, "en", "d"),
        (17, "É" * 49, "fr", "d"),
        (18, "Licensed under CC BY-NC 4.0. <|endoftext|> it's 中文 ２ ǅ", "en", "d"),
    ]
    rows += [(20 + k, edited(base, 160, 20 + k), "en", "a") for k in range(14)]  # a long list
    rows.append(rows[0])  # a repeated row
    rows.append((None, base, "en", "a"))
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if (
        words
    ) else frozenset()


def groups(sets: dict, percent: int) -> dict:
    """Least member reachable over links of similar sets, by comparing all pairs."""
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and both * 100 >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                home[high] = low
    return {i: find(i) for i in sets}


def without_repeats(rows: list[tuple], length: int = 50) -> list[tuple]:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    owner: dict[bytes, int] = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, raw in data:
        for k in range(len(raw) - length + 1):
            if i is not None:
                part = raw[k : k + length]
                owner[part] = min(owner.get(part, i), i)
    out = []
    for i, raw in data:
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if i is not None and owner[raw[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def as_counter(rows) -> Counter:
    return Counter(tuple(r) for r in rows)
