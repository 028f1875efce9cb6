"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from flowmill.llm import fill_middle

SCHEMA = "doc_id long, text string, n string, output string, h1 long"


def plain(doc_id, text, rate=100, spm_share=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_share:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def documents():
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a", "é", "日", "😀", "\n", "\n\n", "<", "<P", ">", "long word ", "\r"])
                        for _ in range(rng.randint(0, 60)))) for i in range(300)]
    return rows + [(None, "x\ny\nz"), (None, None), (7, None), (7, ""), (8, "\n"), (8, "\n"), (9, "<S>\n"), (10, "x<M>"),
                   (11, "line of é\n" * 40_000), (12, "z" * 100_001)]


def test_rearranged_as_plain_python_and_restored(spark):
    rows = documents()
    table = spark.createDataFrame([(i, t, "given", "given", 5) for i, t in rows], SCHEMA).repartition(3)
    for rate, share, block in ((100, 50, 4 << 20), (60, 10, 500)):
        got = fill_middle.restore(fill_middle.rearrange(table, 7, rate, share, block)).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(plain(i, t or "", rate, share) for i, t in rows)
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)


def test_rank_and_select_in_words():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 64, 333):
        data = rng.choice(np.array([10, 9, 11, 138, 10 + 128, 0, 255, 195, 169], np.uint8), size).tobytes()
        words = fill_middle.as_words(data)
        for marks, hits in ((fill_middle.line_end_marks(words), [b == 10 for b in data]),
                            (fill_middle.code_point_marks(words), [b & 0xC0 != 0x80 for b in data])):
            held, at = fill_middle.Marks(marks), np.arange(size + 1)
            assert held.rank(at).tolist() == [sum(hits[:i]) for i in range(size + 1)]
            places = [i for i, hit in enumerate(hits) if hit]
            assert held.select(np.arange(len(places))).tolist() == places
