"""The transducer against a dictionary, and ids and texts against the tokenizers library."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

from flowmill.llm import word_lexicon

PATH = public.path("word_bpe_49k.json")


def test_transducer_is_the_dictionary_and_minimal():
    rng = random.Random(3)
    for size in (0, 1, 5, 400):
        known = {bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(0, 9))): [rng.randint(0, 3) for _ in range(rng.randint(0, 4))]
                 for _ in range(size)}
        lexicon = word_lexicon.Lexicon(word_lexicon.compile_transducer(sorted(known.items())))
        asked = list(known) + [bytes(rng.choice(b"abc\xc3") for _ in range(rng.randint(0, 12))) for _ in range(200)]
        found, numbers, ids = lexicon.look_up(asked, 10)
        assert found.tolist() == [w in known for w in asked]
        assert numbers.tolist() == [len(known.get(w, ())) for w in asked]
        assert ids.tolist() == [i for w in asked for i in known.get(w, ())]
    stems, ends = [b"play", b"work", b"walk"], [b"", b"ed", b"ing", b"s"]
    entries = sorted((s + e, [n, 7 + len(e)]) for n, s in enumerate(stems) for e in ends)
    held = word_lexicon.Lexicon(word_lexicon.compile_transducer(entries))
    assert len(held.final) == 13  # start, p, pl, pla, w, wo, wa, one for wor and wal, and five for the endings of all stems


def documents():
    rng = random.Random(6)
    words = ["Hello", "world's", "it'll", "12345", "CAFÉ", "café", "ΑΣ", "Σας", "İstanbul", "日本語", "😀!", "<|startoftext|>",
             "<|endoftext|>x", "<|StartOfText|>", "a b", "x\x1cy", " ", "́", "...", "don't", "ﬁ", "ǅ", "q" * 70, "​"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "", "\x0b"]) for _ in range(rng.randint(0, 40))))
            for i in range(60)]
    return rows + [(60, None), (61, ""), (62, " \n"), (None, "Hello world"), (None, None), (5, rows[5][1]), (63, "word " * 60_000),
                   (64, "z" * 30_000)]


def test_ids_and_texts_are_the_librarys(spark):
    library = Tokenizer.from_file(PATH)
    tokenizer, rows = word_lexicon.WordTokenizer.read(PATH), documents()
    table = spark.createDataFrame([(i, t, "given", "given") for i, t in rows],
                                  "doc_id long, text string, ids string, decoded string").repartition(3)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    for most, block in ((1 << 16, 4 << 20), (20, 300), (0, 300)):
        encoded = word_lexicon.encode(table, tokenizer, most, block)
        got = word_lexicon.decode(encoded, tokenizer, 5000).collect()
        assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want


def test_frequent_words_are_counted_over_all_tasks(spark):
    rows = [(i, "b a a\tlonely%d" % i) for i in range(4)] + [(9, None), (10, "c c b")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert word_lexicon.frequent_words(table) == [b"a", b"b", b"c"]
    assert word_lexicon.frequent_words(table, 1, 1) == [b"a"]


def test_words_merged_together_are_merged_alone():
    library, merge, rng = Tokenizer.from_file(PATH), word_lexicon.WordTokenizer.read(PATH).merger(), random.Random(1)
    chars = "abC'sȩ́́İΣςßﬁǅ日가각😀‍️  \u0085\x1c​<|>012.,!क़Ω"
    for _ in range(5):
        words = "\n".join("".join(rng.choice(chars) if rng.random() < .9 else rng.choice(["<|endoftext|>", chr(rng.randint(33, 0xd7ff))])
                                  for _ in range(rng.randint(1, 12))) for _ in range(1200)).encode().split()
        assert merge(words) == [e.ids for e in library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
