"""Decontamination with items of every size against a plain version."""

import random

from flowmill.llm import decontaminate


def shingles(text, width):
    w = text.lower().split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def test_items_of_all_sizes(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 900)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 2, 4, 5, 6, 9, 13, 20, 37, 70, 150, 400)]
    docs = []
    for n, text in items:
        w = text.split()
        docs += [(len(docs), f"{word()} {text} {word()}"), (len(docs) + 1, " ".join(w[: len(w) * 9 // 10])),
                 (len(docs) + 2, " ".join(w[: len(w) // 2] + [word()] + w[len(w) // 2:])), (len(docs) + 3, text)]
    docs += [(900, " ".join(t for _, t in items)), (901, " ".join(word() for _ in range(3000))), (902, ""), (903, None),
             (900, " ".join(t for _, t in items))]
    want = set()
    for i, text in docs:
        for k, item in items:
            width = min(5, len(item.split()))
            q, d = shingles(item, width), shingles(text or "", width)
            if len(q & d) * 100 >= 80 * len(q):
                want.add((i, k, len(q & d), len(q)))
    got = decontaminate.find_contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {k for i, k, *_ in want if i == 900} == {k for k, _ in items}
