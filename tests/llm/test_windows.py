"""Decontamination windows that lie between two alignments of an item."""

import random
from collections import Counter

from groundwalk.llm import decontaminate


def best_window(text, item, k=5):
    """(similarity, start) by brute force over all windows."""
    w, b = text.split(), item.split()
    count = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    own, found = count(b), []
    for s in range(max(1, len(w) - len(b) + 1)):
        c = count(w[s : s + len(b)])
        both = (c & own).total()
        found.append((round(both / (c.total() + own.total() - both), 6), -s))
    return max(found)


def edited(item, edge, inserted):
    w = item.split()
    half = len(w) // 2
    for i in range(edge):
        w[i], w[-1 - i] = f'"{w[i]}', f'{w[-1 - i]}"'
    return " ".join(w[:half] + [f"new{i}" for i in range(inserted)] + w[half:])


def test_windows_between_alignments(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    items = {0: prose(59), 1: prose(120), 2: prose(40)}
    docs = {
        10: f"{prose(30)} {edited(items[0], 1, 2)} {prose(30)}",
        11: f"{prose(9)} {edited(items[1], 4, 8)} {prose(200)}",
        12: f"{prose(9)} {items[2]} {prose(5)} {edited(items[0], 1, 2)} {items[2]}",
        13: prose(300),
    }
    truth = {}
    for d, text in docs.items():
        for i, item in items.items():
            similarity, start = best_window(text, item)
            if similarity >= 0.8:
                truth[d, i] = similarity
    assert {(10, 0), (11, 1), (12, 0), (12, 2)} == set(truth)
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.similarity for x in found} == truth
