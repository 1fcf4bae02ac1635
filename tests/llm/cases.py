"""Tables that every operator must take, and plain versions to compare with."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 4001}x{seed % 13}" for i in range(n)) + "."


#: Nulls in any column, empty and very long texts, ties, repeated rows.
ODD_ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (None, "no id here", "en", "b", 10),
    (None, "another without id", None, "b", 18),
    (4, "One two three four five six seven.", "en", "a", 34),
    (5, "ONE two three four FIVE six seven.", "en", "b", 34),
    (5, "ONE two three four FIVE six seven.", "en", "b", 34),
    (6, "é È ß 漢字 🙂   end ", "xx", "é", 15),
    (7, "one", "en", "a", 3),
    (8, "ONE", "en", "a", 3),
    (9, "a b", "en", "z", 3),
    (10, sentence(1, 60_000), "en", "a", None),
    (11, sentence(2, 300), "en", "a", None),
    (12, sentence(2, 300) + " more", "en", "c", None),
    (13, "x" * 300_000, "en", "c", None),
    (-5, "line one.\nline one.\nline two", "en", "a", 28),
]


def plain_shingles(text: str | None, width: int) -> set:
    words = WORDS.findall((text or "").translate(LOW))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_components(rows, width: int, percent: int) -> dict:
    """component of each id, by comparing all pairs that share a shingle."""
    sets = [(doc, plain_shingles(text, width)) for doc, text in rows if doc is not None]
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, left) in enumerate(sets):
        for b, right in sets[:i]:
            if left and right and 100 * len(left & right) >= percent * len(left | right):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {doc: find(doc) for doc in parent}
