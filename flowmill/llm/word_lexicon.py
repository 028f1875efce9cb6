"""BPE with word ends: frequent words are read off a minimal acyclic transducer, all others are merged."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowmill.llm.batches import slices
from flowmill.llm.bpe import binary_array, ragged
from flowmill.session import cut_lineage, scratch_path

# Bounds of the lexicon, which only saves work: words beyond it are merged exactly.
MAX_WORDS = 1 << 16
MAX_WORD_BYTES = 48
# Tokenizer files beyond this size are refused: the file goes to every task.
MAX_TOKENIZER_BYTES = 64 << 20
# Words that a task remembers once merged, and those merged in one call: the library's results are large.
REMEMBERED = 200_000
MERGED_AT_ONCE = 1000


@dataclass(frozen=True)
class WordTokenizer:
    """A tokenizer file whose normaliser and pre-tokeniser never look across white space, and that has no decoder,
    so that decoding joins tokens by a space."""

    definition: str

    @classmethod
    def read(cls, path: str) -> WordTokenizer:
        if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
            raise ValueError(f"{path} has more than {MAX_TOKENIZER_BYTES} bytes")
        with open(path, encoding="utf-8") as file:
            definition = file.read()
        if json.loads(definition).get("decoder") is not None:
            raise ValueError(f"{path} has a decoder; its tokens are not joined by spaces")
        return cls(definition)

    def merger(self):
        """words -> their ids, by the merges of the file."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        tokenizer = Tokenizer.from_str(self.definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def merge(words: list[bytes]) -> list[list[int]]:
            ids = []
            for at in range(0, len(words), MERGED_AT_ONCE):
                part = [w.decode() for w in words[at:at + MERGED_AT_ONCE]]
                whole = tokenizer.encode(" ".join(part), add_special_tokens=False)
                # A token belongs to the word that its first character lies in.
                begins = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
                owner = np.searchsorted(begins, [a for a, _ in whole.offsets], side="right") - 1
                if (np.diff(owner) < 0).any():
                    ids += [tokenizer.encode(w, add_special_tokens=False).ids for w in part]
                    continue
                ends = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
                held = whole.ids
                ids += [held[a:b] for a, b in zip(ends, ends[1:])]
            return ids

        return merge

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' text in order of id, a space after each, and where each begins."""
        known = json.loads(self.definition)
        names = {i: t for t, i in known["model"]["vocab"].items()} | {a["id"]: a["content"] for a in known["added_tokens"]}
        parts = [names[i].encode() + b" " if i in names else b"" for i in range(max(names, default=-1) + 1)]
        return (np.frombuffer(b"".join(parts), np.uint8),
                np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs, self.final, self.tail = {}, False, ()


def compile_transducer(entries) -> np.ndarray:
    """The minimal acyclic transducer of (word, ids) pairs, in ascending order of distinct words, as one array of 32-bit numbers.

    Words are added in order. Ids move as far towards the start as all words through an arc share them;
    once no further word can pass through a state, it is replaced by an equal one if there is one, so
    equal endings are stored once.

    Layout: numbers of states, arcs and ids; per state 1 if final, place and number of ids at the end;
    per arc `state * 256 + byte` in ascending order, target, place and number of its ids; the ids.
    """
    register, finals, arcs, pool, place = {}, [], [], [], {}

    def stored(ids: tuple) -> int:
        if ids not in place:
            place[ids] = len(pool)
            pool.extend(ids)
        return place[ids]

    def freeze(state: _State) -> int:
        key = (state.final, state.tail, tuple((b, t, o) for b, (t, o) in state.arcs.items()))
        number = register.get(key)
        if number is None:
            number = register[key] = len(finals)
            finals.append((state.final, stored(state.tail), len(state.tail)))
            arcs.extend((number << 8 | b, t, stored(o), len(o)) for b, (t, o) in state.arcs.items())
        return number

    path, last = [_State()], b""
    for word, ids in entries:
        ids, shared = tuple(ids), len(os.path.commonprefix((last, word)))
        for i in range(len(last), shared, -1):
            path[i - 1].arcs[last[i - 1]][0] = freeze(path[i])
        del path[shared + 1:]
        for i in range(1, shared + 1):
            arc = path[i - 1].arcs[word[i - 1]]
            keep = len(os.path.commonprefix((arc[1], ids)))
            rest, arc[1], ids = arc[1][keep:], arc[1][:keep], ids[keep:]
            if rest:
                for below in path[i].arcs.values():
                    below[1] = rest + below[1]
                if path[i].final:
                    path[i].tail = rest + path[i].tail
        for i in range(shared, len(word)):
            path[i].arcs[word[i]] = [None, ids if i == shared else ()]
            path.append(_State())
        path[-1].final = True
        if shared == len(word):  # the empty word
            path[-1].tail = ids
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[last[i - 1]][0] = freeze(path[i])
    start = freeze(path[0])
    ends = np.array(finals, np.int32).reshape(-1, 3).T
    moves = np.array(sorted(arcs), np.int64).reshape(-1, 4).T.astype(np.int32)
    head = np.array([len(finals), moves.shape[1], len(pool), start], np.int32)
    return np.concatenate([head, ends.ravel(), moves.ravel(), np.array(pool, np.uint32).view(np.int32)])


class Lexicon:
    """Look-ups in the array of compile_transducer, which may be a memory map."""

    def __init__(self, held: np.ndarray):
        states, arcs, ids, self.start = (int(x) for x in held[:4])
        self.final, self.tail_at, self.tail_size = held[4:4 + 3 * states].reshape(3, states)
        moves = held[4 + 3 * states:4 + 3 * states + 4 * arcs]
        self.key, self.target, self.out_at, self.out_size = moves.reshape(4, arcs)
        self.pool = held[len(held) - ids:].view(np.uint32)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, "<i4", "r"))

    def look_up(self, words: list[bytes], longest: int = MAX_WORD_BYTES):
        """Whether each word is known, its number of ids, and all known words' ids in a row.
        All words move through the automaton together, a byte a step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state = np.full(len(words), self.start, np.int64)
        live = np.flatnonzero(sizes <= longest)
        known = np.zeros(len(words), bool)
        who, at, count = [], [], []

        def emit(words_, places, numbers):
            some = numbers > 0
            who.append(words_[some]), at.append(places[some]), count.append(numbers[some])

        for step in range(longest + 1):
            done = live[sizes[live] == step]
            ended = done[self.final[state[done]] == 1]
            known[ended] = True
            emit(ended, self.tail_at[state[ended]], self.tail_size[state[ended]])
            live = live[sizes[live] > step]
            if not len(live) or not len(self.key):
                break
            wanted = (state[live] << 8 | data[begins[live] + step]).astype(np.int32)
            arc = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[arc] == wanted
            live, arc = live[found], arc[found]
            emit(live, self.out_at[arc], self.out_size[arc])
            state[live] = self.target[arc]
        who, at, count = (np.concatenate(x).astype(np.int64) for x in (who, at, count))
        kept = known[who]
        who, at, count = who[kept], at[kept], count[kept]
        order = np.argsort(who, kind="stable")  # a word's ids stay in the order of its steps
        numbers = np.bincount(who, count, len(words)).astype(np.int64)
        return known, numbers, self.pool[ragged(at[order], count[order])]


def frequent_words(docs: DataFrame, most: int = MAX_WORDS, hold: int = 300_000) -> list[bytes]:
    """The most frequent words that occur twice at least, in ascending order of bytes. Tasks count before the shuffle
    and hold `hold` different words. Counts fall into steps of a sixteenth of a doubling; the driver gets the
    words of the highest steps that hold `most` words together, each up to MAX_WORD_BYTES long."""

    def run(batches):
        counts = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              names=["word", "n"])

        for part, data, bounds in slices(batches, "text", 1 << 20):
            held, edges = data.tobytes(), bounds.tolist()
            for a, b in zip(edges, edges[1:]):
                counts.update(held[a:b].split())
            if len(counts) > hold:
                yield rows()
                counts.clear()
        yield rows()

    counted = docs.select("text").mapInArrow(run, "word binary, n long").where(F.octet_length("word") <= MAX_WORD_BYTES)
    step = F.floor(F.log2("n") * 16)
    repeated = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", step))
    held, least = 0, None
    for row in sorted(repeated.groupBy("step").count().collect(), reverse=True):  # at most a thousand steps
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    if least is None:
        return []
    return sorted(r.word for r in repeated.where(F.col("step") >= least).select("word").collect())


def publish(spark: SparkSession, held: np.ndarray) -> str:
    """Write an array to the shared folder and name it as a file of the job: each executor fetches it
    once, one started later as well. Returns the name for SparkFiles.get."""
    name = f"lexicon-{uuid.uuid4().hex}"
    target = f"{scratch_path(spark, 'lexicon')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(held.astype("<i4").tobytes()))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


def encode(docs: DataFrame, tokenizer: WordTokenizer, most_words: int = MAX_WORDS, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id and `ids` (little-endian unsigned 32-bit token ids) of every whole text.

    Words are runs without white space `[\\x20\\x09-\\x0D]`; the tokenizer never looks across that, so a text's
    ids are its words' ids in a row. A first scan counts words; the most frequent ones, with the ids that merging
    gives them, become a minimal acyclic transducer that every executor memory-maps. The second scan
    reads the ids of known words off it, all different words of a block in step, and merges the others exactly,
    each once a task while it is remembered. The lexicon only saves work: rows are the same for any. Nothing but
    word counts is shuffled; a task holds about `block_bytes` of text, or one longer text.

    Null and empty texts have no ids. Null and repeated doc_ids and repeated rows keep one row each; words
    with tied counts enter the lexicon together or not at all. Only doc_id and text are read, so other columns cannot clash.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    words = frequent_words(docs, most_words)
    name = publish(spark, compile_transducer(zip(words, tokenizer.merger()(words))))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def run(batches):
        lexicon, merge, remembered = Lexicon.mapped(SparkFiles.get(name)), None, {}
        for part, data, bounds in slices(batches, "text", block_bytes):
            number, codes, counts = {}, [], []
            held, edges = data.tobytes(), bounds.tolist()
            for a, b in zip(edges, edges[1:]):
                found = held[a:b].split()
                counts.append(len(found))
                codes += [number.setdefault(w, len(number)) for w in found]
            different = list(number)
            known, sizes, flat = lexicon.look_up(different)
            others = np.flatnonzero(~known)
            unseen = [different[i] for i in others.tolist()]
            new = [w for w in unseen if w not in remembered]
            if new:
                merge = merge or tokenizer.merger()
                if len(remembered) + len(new) > REMEMBERED:
                    remembered = {w: remembered[w] for w in unseen if w in remembered}
                remembered.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(new, merge(new)))
            merged = [remembered[w] for w in unseen]
            sizes[others] = np.fromiter(map(len, merged), np.int64, len(merged)) >> 2
            order = np.concatenate((np.flatnonzero(known), others))
            starts = np.zeros(len(different), np.int64)
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            pool = np.concatenate((flat, np.frombuffer(b"".join(merged), "<u4")))
            codes = np.array(codes, np.int64)
            stream = pool[ragged(starts[codes], sizes[codes])]
            ends = np.concatenate(([0], np.cumsum(sizes[codes])))
            cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), binary_array(stream.astype("<u4").view(np.uint8), cuts * 4)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: WordTokenizer, block_bytes: int = 1 << 20) -> DataFrame:
    """`encoded` with `decoded`, the tokens' text joined by spaces, special ones included: ids index the table of
    tokens, which is bounded by the vocabulary. Null and empty ids give an empty text; an id outside the
    table is an error. A column `decoded` that is there already is replaced."""
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in columns], T.StructField("decoded", T.StringType())])

    def run(batches):
        table, places = tokenizer.token_bytes()
        for part, data, bounds in slices(batches, "ids", block_bytes):
            ids, cuts = data.view("<u4").astype(np.int64), bounds >> 2
            sizes = places[ids + 1] - places[ids]
            sizes[cuts[1:][cuts[1:] > cuts[:-1]] - 1] -= 1  # no space after the last token
            ends = np.concatenate(([0], np.cumsum(sizes)))[cuts]
            decoded = binary_array(table[ragged(places[ids], sizes)], ends).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], decoded], names=schema.names)

    return encoded.select(*[f"`{c}`" for c in columns]).mapInArrow(run, schema)
