"""The corpus operators against brute force on small fixtures."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import (bpe, decontaminate, html_extract, line_dedup, minhash, quality, queries, repetition,
                          secrets, sentence_spans, suffix_dedup)
from flowmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, spans string, start long"


def table(spark, rows):
    """Documents with nulls, repeats and columns named like those that operators add."""
    return spark.createDataFrame([(i, t, None, "given", None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [rng.choice("abcdeé") * rng.randint(1, 3) + rng.choice(["", ".", ","]) for _ in range(40)]
    base = " ".join(rng.choice(words) for _ in range(400))
    rows = []
    for i in range(40):
        a = rng.randint(0, 800)
        rows.append((i, base[a:a + rng.randint(0, 500)] + rng.choice(["", "\n", " x. y! "]) + base[:rng.randint(0, 80)]))
    return rows + [(40, None), (41, ""), (42, base), (42, base), (43, base), (None, base), (None, None), (44, " \n\t"),
                   (45, "z" * 3000)]


def test_suffix_dedup(spark, texts):
    known = sorted({(i, t) for i, t in texts if i is not None}, key=lambda r: r[0])
    first = {}
    for i, t in texts:
        data = (t or "").encode()
        for p in range(len(data) - 49):
            key = data[p:p + 50]
            first[key] = min(first.get(key, 10 ** 9), -1 if i is None else i)
    want = {}
    for i, t in known:
        data, gone = (t or "").encode(), set()
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] < i:
                gone.update(range(p, p + 50))
        want[i] = (len(data), len(gone), sum(p - 1 not in gone for p in gone),
                   bytes(b for p, b in enumerate(data) if p not in gone))
    got = suffix_dedup.remove_repeats(table(spark, texts), block_bytes=700).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_line_dedup(spark):
    line = "This line is shared by many Documents, and is long."
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend") for i in range(6)]
    rows += [(None, line), (7, None), (8, ""), (9, "\n\n"), (5, rows[5][1])]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (0, 1, 2, 3, 4):
            assert (r.text, r.n_lines, r.n_dropped) == (f"own {r.doc_id}\nend", 3, 1)
        if r.doc_id == 5:
            assert r.n_dropped == 0 and r.text == rows[5][1]
        if r.doc_id is None:
            assert (r.text, r.n_dropped) == ("", 1)
    assert {(r.doc_id, r.text, r.n_lines) for r in got if r.doc_id in (7, 8, 9)} == {(7, "", 1), (8, "", 1), (9, "\n\n", 3)}


def base_spans(text):
    out = []
    for no, (kind, pattern, least) in enumerate([
            ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
            ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)]):
        for m in re.finditer(pattern, text):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_secrets(spark):
    random_key = base64.b64encode(hashlib.sha256(b"x").digest()).decode().rstrip("=")
    rows = [(1, "é😀 token = \"abcdef0123\" secret=token:abcdef AKIA" + "A1" * 10), (2, "0" * 23 + " " + "ab12" * 8),
            (3, f"see {random_key} here"), (4, "internationalisationalities " * 3), (5, None), (6, ""), (None, "apikey: 123456"),
            (7, "PassWord:'x' password=longenough"), (7, "PassWord:'x' password=longenough")]
    got = secrets.scan(table(spark, rows)).select(
        "doc_id", secrets.render(F.filter("spans", lambda s: s["kind"] != "random")).alias("base"),
        secrets.render(F.col("spans")).alias("all")).collect()
    assert Counter((r.doc_id, r.base) for r in got) == Counter((i, base_spans(t or "")) for i, t in rows)
    by_id = {r.doc_id: r["all"] for r in got}
    assert by_id[4] == ""
    assert by_id[3] == f"random:4:{4 + len(random_key)}"


def shingles(text, width):
    found = (text or "").encode().lower().split()
    return {tuple(found[i:i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def test_near_duplicates(spark):
    rng = random.Random(2)
    rows = []
    for g in range(6):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([3, 30, 90]))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 300)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    rows += [(200, None), (201, " "), (202, rows[0][1].upper()), (None, rows[0][1])]
    named = [(i, shingles(t, 4)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in named}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in named:
        for j, b in named:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(table(spark, rows), width=4).collect()
    assert len(got) == len(rows)
    sizes = {i: len(s) for i, s in named}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (root(r.doc_id), sizes[r.doc_id], root(r.doc_id) == r.doc_id)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_decontamination(spark):
    rng = random.Random(3)
    item = " ".join(f"q{rng.randint(0, 500)}" for _ in range(30))
    items = spark.createDataFrame([(1, item), (2, "Short item here"), (3, None), (4, item), (1, "a b c d e f")],
                                  "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(300))
    changed = item.split()
    changed[15] = "other"
    rows = [(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, f"{filler} short ITEM\nhere {filler}"),
            (4, " ".join(changed[:10])), (5, f"x {' '.join(changed)} y"), (6, None), (7, ""), (None, item), (1, "a b c d e f g")]
    got = decontaminate.find_contaminated(table(spark, rows), items).collect()
    want = {}
    for i, t in rows:
        for k, text in ((1, item), (2, "Short item here"), (4, item), (1, "a b c d e f")):
            w = min(5, len(text.split()))
            q = shingles(text, w)
            n = len(q & (shingles(t, w) if len((t or "").split()) >= w else set()))
            if n * 100 >= len(q) * 80:
                want[i, k] = max(want.get((i, k), (0, 0)), (n, len(q)))
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got} == want
    empty = items.limit(0)
    assert decontaminate.find_contaminated(table(spark, rows), empty).count() == 0


def test_bpe_is_the_library_and_round_trips(spark, texts):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts + [(50, "  two  spaces \n\n<|endoftext|> don't 12345 日本語 😀")]
    v = bpe.Vocabulary.read(path, public.PATTERN)
    got = bpe.decode(bpe.encode(table(spark, rows), v, block_bytes=900), v).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_sentence_spans(spark):
    passage = "One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen sixteen. The end of it."
    rows = [(3, f"Own start here. {passage} Then more of it."), (1, passage), (2, "Clean. Text. The end."),
            (9, None), (10, ""), (None, "Clean and alone."), (11, " ".join(f"w{i}" for i in range(60))),
            (12, "x. " + " ".join(f"w{i}" for i in range(60)) + " tail")]
    got = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(table(spark, rows)).collect()}
    assert got[3].text == "Own start here. Then more of it." and got[3].n_removed == 3
    for i in (1, 2, 10, None, 11):
        assert got[i].text == dict(rows)[i] and got[i].n_removed == 0
    assert got[9].text == ""


def test_repetition_counts():
    rng = random.Random(1)
    for _ in range(400):
        t = " ".join(rng.choice(["a", "bb", "é", "d#", "x"][:rng.randint(1, 5)]) for _ in range(rng.randint(0, 40)))
        found = t.split()
        for width in (3, 5, 7):
            seen = Counter(tuple(found[i:i + width]) for i in range(len(found) - width + 1))
            inside = {i + k for i in range(len(found) - width + 1) if seen[tuple(found[i:i + width])] > 1 for k in range(width)}
            m = repetition.measures(t)
            if width == 3:
                assert m["n_repeat_words"] == len(inside)
            else:
                share = sum(len(found[i]) for i in inside) / max(1, sum(map(len, found)))
                assert abs(m["dup_shares"].get(width, 0) - share) < 1e-9


def test_repetition_table(spark, texts):
    got = repetition.apply_rules(table(spark, texts)).collect()
    assert len(got) == len(texts)
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (40, 41, 44))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav>
<div class="sidebar"><p>Side text, with marks, and more.</p></div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
para&shy;graph, long enough to count.<p>Second one<br>goes on. 1 &lt; 2</p><div class="ad">Buy!</div><ul><li>Item</li></ul>
<div class="comments"><p>Nice post, thanks!</p></div></article><footer>&copy; us</footer><script>var a="<p>";</script>"""


def test_html(spark):
    want = ["Title & more", "First bold para\xadgraph, long enough to count.", "Second one goes on. 1 < 2", "Item"]
    assert html_extract.content(PAGE) == want
    for odd in ("", "<", "<p", "<p class='", "</p>", "<!--", "a<b", "<script>", "<div " * 2000, "<p>" * 3000, "<a href=\"'>" * 500):
        html_extract.content(odd)
    pages = spark.createDataFrame([(1, "u", PAGE, "given"), (None, None, None, None), (1, "u", "", "x")],
                                  "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert sorted(r.text for r in got) == ["", "", "\n\n".join(want)]


def test_quality_separates_held_out_documents(spark, sf):
    at = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    out = quality.held_out(F.col("doc_id"))
    scored = quality.classify(docs, labels).join(labels, "doc_id").where(out).select("doc_id", "score", "quality").collect()
    assert len(scored) > 80 and np.mean([(r.score >= 0.7) == (r.quality == 1) for r in scored]) > 0.97
    # What is held out teaches nothing.
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, turned).where(out).collect()}
    assert all(again[r.doc_id] == r.score for r in scored)


def test_quality_of_odd_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    none = quality.classify(table(spark, [(1, None), (None, "x"), (2, "long word " * 50_000)]), labels).collect()
    assert [r.score > 0.99 for r in none] == [True] * 3
    rows = [(i, "Good words are here, and more of them." if i % 2 else "### $$$ !!!") for i in range(60)] + [(3, "aaa"), (None, "### $$$ !!!")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0), (5, None)], "doc_id long, quality int")
    got = quality.classify(table(spark, rows), marks)
    assert got.count() == len(rows) and "spans" in got.columns
    scores = {r.text: r.score for r in got.collect()}
    assert scores["Good words are here, and more of them."] > 0.7 > scores["### $$$ !!!"]


def test_forest_is_a_walk_through_its_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(float)
    forest = quality.fit_folds(x, y, depth=3, rounds=20)

    def walk(row):
        total = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.9
    assert quality.fit_folds(x[:3], np.array([0.0, 1, 1])).score(x[:3]).shape == (3,)


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.startswith("op") and not q.startswith("op1_")])
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
