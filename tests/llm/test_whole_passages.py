"""Repeated passages go wherever sentences begin and end."""

import random

from flowmill.llm import sentence_spans


def test_repeated_passages_in_any_context(spark):
    rng = random.Random(7)
    word = lambda: f"{rng.choice(['é', 'n', 'N'])}{rng.randint(0, 10 ** 6)}"
    rows, passages = [(1000, "w x y z " * 60)], {}
    for i in range(40):
        # no mark at all, a mark inside, or one edited word before the passage; wrapped differently
        passage = [word() + ("." if i % 3 == 1 and k in (17, 36) else "") for k in range(50)]
        own = [word() for _ in range(rng.randint(1, 45))]
        rows.append((i, " ".join([word() for _ in range(rng.randint(1, 45))] + passage + [word()])))
        rows.append((100 + i, " ".join([*own, "\n".join(passage).replace("n", "N"), word(), word()])))
        passages[100 + i] = (own, passage)
    long = " ".join(f"w{i}" for i in range(60))
    rows += [(2011, long), (2012, "x. " + long + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(docs).collect()}
    given = dict(rows)
    for i in range(40):
        assert got[i].text == given[i] and got[i].n_removed == 0
    for i, (own, passage) in passages.items():
        left = got[i].text.split()
        assert left[:len(own)] == own and left[-2:] == given[i].split()[-2:]
        assert len(left) - len(own) - 2 <= 24 and got[i].n_removed > 0
    assert got[2011].text == long and got[2012].text.startswith("x. ") and got[2012].text.endswith("tail")
    assert len(got[2012].text.split()) <= 2 + 24
    # the first occurrence of a run that overlaps its own repeats is not eaten
    assert 16 <= len(got[1000].text.split()) < 60
