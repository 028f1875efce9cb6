"""Substring dedup by sliding spans of sentences, and of words at places their content picks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowmill.llm.common import keep_row, unfold

# A sentence ends after its closing marks and the white space behind them, or with its line.
END = re.compile(r"[.!?]+[\"')\]]*\s+|\n\s*")
WORDS = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
SIGNED = 1 << 63
PART_BYTES = 16 << 20  # text whose spans a task holds at a time
# Hashes that pick places in a text; sums of byte codes times powers, modulo 2^64.
CODES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, dtype=np.uint64)
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)


def sentences(text: str, max_words: int) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, word count) of each sentence; a longer one is cut at every
    `max_words` words, so a span can never be one endless sentence. The pieces cover the text."""
    out, at = [], 0
    ends = [m.end() for m in END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = text[at:end].encode().lower().split()
        if len(words) > max_words:
            found = [m.end() for m in WORDS.finditer(text, at, end)]
            for k in range(0, len(words), max_words):
                stop = end if k + max_words >= len(words) else found[k + max_words - 1]
                part = words[k:k + max_words]
                out.append((at, stop, b" ".join(part), len(part)))
                at = stop
        elif words or not out:
            out.append((at, end, b" ".join(words), len(words)))
        else:  # white space alone belongs to the sentence before
            out[-1] = (out[-1][0], end, *out[-1][2:])
        at = end
    return out


def spans(counts: list[int], least: int, min_words: int) -> set[tuple[int, int]]:
    """The shortest runs of at least `least` sentences and `min_words` words that start at, or end
    with, each sentence; (first, behind the last)."""
    out, n = set(), len(counts)
    total = [0]
    for c in counts:
        total.append(total[-1] + c)
    end = 0
    for start in range(n):
        end = max(end, start + least)
        while end <= n and total[end] - total[start] < min_words:
            end += 1
        if end > n:
            break
        out.add((start, end))
    start = n
    for end in range(n, 0, -1):
        start = min(start, end - least)
        while start >= 0 and total[end] - total[start] < min_words:
            start -= 1
        if start < 0:
            break
        out.add((start, end))
    return out


def _run_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of codes[start:stop] for each pair, the same wherever the run lies."""
    powers = np.full(len(codes) + 1, BASE, np.uint64)
    powers[0] = 1
    totals = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * np.cumprod(powers)[:-1], out=totals[1:])
    powers[1:] = pow(BASE, -1, 1 << 64)
    h = (totals[stops] - totals[starts]) * np.cumprod(powers)[starts]
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(33))


def _windows(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """`best` (minimum or maximum) of every `width` values in a row."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = best(values[:-step], values[step:])
        reach += step
    return values


def passages(text: str, size: int, gap: int) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised words) of the runs of `size` words whose hash is the least of `gap`
    runs in a row. A run is picked by the words of those runs alone, whatever stands around them: a
    passage of size + gap - 1 words has a run that is picked in every text that holds it."""
    data = text.encode().lower()
    raw = np.frombuffer(data, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = (raw == 32) | (raw >= 9) & (raw <= 13)
    first = np.flatnonzero(space[:-1] & ~space[1:])
    if len(first) < size:
        return []
    behind = np.flatnonzero(~space[:-1] & space[1:])
    at = np.arange(len(first) - size + 1)
    runs = _run_hashes(_run_hashes(CODES[raw], first, behind), at, at + size)
    gap = min(gap, len(runs))
    least = np.pad(_windows(np.minimum, runs, gap), gap - 1)
    picked = np.flatnonzero(_windows(np.maximum, least, gap) == runs)
    if len(data) == len(text):
        starts = np.append(first, len(text))
    else:
        starts = np.append((np.cumsum((raw & 0xC0) != 0x80) - 1)[first], len(text))
    words = data.split()
    return [(a, b, b" ".join(words[i:i + size]))
            for i, a, b in zip(picked.tolist(), starts[picked].tolist(), starts[picked + size].tolist())]


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(pairs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of text, so that the spans held at a time are bounded."""
    upto = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    bounds = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def drop_repeated_spans(docs: DataFrame, sentences_per_span: int = 2, min_words: int = 16,
                        max_sentence_words: int = 40, gap: int = 13) -> DataFrame:
    """Documents without the text that a repeated span covers, its first occurrence apart.

    A span is a run of several consecutive sentences (words lower-cased A-Z, white space ignored):
    for each sentence the shortest run of at least `sentences_per_span` sentences and `min_words` words
    from it on, and the shortest up to it. Wherever sentences begin and end, a run of `min_words` words
    is a span too if its hash is the least of `gap` such runs in a row. Two neighbours of these are at
    most `gap` words apart, so with gap <= min_words a repeated passage of min_words + gap - 1 words or
    more loses all but at most gap - 1 words at each of its ends, in any context. The first occurrence
    is the one with the smallest doc_id, then the earliest; a run of words that overlaps it is no
    repeat of it. Returns the columns of `docs` with `text` rewritten, n_sentences and n_removed (the
    sentences that lost words).

    Each part of a batch hashes its spans (128 bits) and decides repeats within itself, so a passage of every
    document is one row a part in the shuffle, and decided spans are merged; spans meet their first
    occurrence in a window over the hash, then positions return to the texts. The spans are shuffled
    once and the texts once.

    Null texts count as empty and come back empty. Null doc_ids sort before all others. Rows of equal
    doc_id and text are one occurrence: neither loses what only the other repeats. Columns named like
    the added ones are replaced. An empty table gives an empty table.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("id", id_type),
        T.StructField("text_id", T.LongType()), T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()), T.StructField("gone", T.BooleanType())])

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_intdigest
        for batch in (part for whole in batches for part in _parts(whole, PART_BYTES)):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            rows.sort(key=lambda r: (False, r[1]) if r[0] is None else (True, r[0], r[1]))
            first: dict[int, int] = {}  # the row below that has a key first
            h, g, texts, starts, stops = (array("q") for _ in range(5))
            ids, gone = [], []

            def put(key, doc_id, text_id, start, stop, decided):
                h.append((key & (SIGNED * 2 - 1)) - SIGNED)
                g.append((key >> 64) - SIGNED)
                ids.append(doc_id)
                texts.append(text_id)
                starts.append(start)
                stops.append(stop)
                gone.append(decided)

            for doc_id, text_id, text in rows:
                decided = []
                units = sentences(text or "", max_sentence_words)
                for a, b in sorted(spans([u[3] for u in units], sentences_per_span, min_words)):
                    start, stop = units[a][0], units[b - 1][1]
                    key = digest(b" ".join([u[2] for u in units[a:b]]))
                    k = first.setdefault(key, len(ids))
                    if k == len(ids):
                        put(key, doc_id, text_id, start, stop, False)
                    elif (ids[k], texts[k], starts[k]) != (doc_id, text_id, start):
                        decided.append((start, stop))
                for start, stop, words in passages(text or "", min_words, gap):
                    key = digest(words, 1)  # apart from runs of sentences, which may start at white space
                    k = first.setdefault(key, len(ids))
                    if k == len(ids):
                        put(key, doc_id, text_id, start, stop, False)
                    elif (ids[k], texts[k]) != (doc_id, text_id) or start >= stops[k]:
                        decided.append((start, stop))
                for start, stop in merged(decided):  # spread by position, since nothing has to meet it
                    put(digest(f"{doc_id} {text_id} {start} {stop}"), doc_id, text_id, start, stop, True)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(h), pa.int64()), pa.array(np.array(g), pa.int64()),
                pa.array(ids, batch.column(0).type), pa.array(np.array(texts), pa.int64()),
                pa.array(np.array(starts).astype(np.int32)), pa.array(np.array(stops).astype(np.int32)),
                pa.array(gone, pa.bool_())], names=schema.names)

    body = F.coalesce("row.text", F.lit(""))
    source = keep_row(docs).select("row", F.col("row.doc_id").alias("id"), F.xxhash64(body).alias("text_id"))
    runs = source.select("id", "text_id", body.alias("body")).mapInArrow(run, schema)
    here = F.struct("id", "text_id", "start")
    removed = (runs.withColumn("gone", F.col("gone") | (F.min(here).over(Window.partitionBy("h", "g")) < here))
               .where("gone").groupBy(F.col("id").alias("of_id"), F.col("text_id").alias("of_text"))
               .agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    joined = source.join(removed, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_id") == F.col("of_text")), "left")
    out = T.StructType([joined.schema["row"], T.StructField("body", T.StringType()),
                        T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rewrite(batches):
        for batch in batches:
            kept, n_all, n_gone = [], [], []
            for text, marked in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                units = [u for u in sentences(text, max_sentence_words) if u[3]]
                cuts = merged([tuple(map(int, p.split(":"))) for p in marked.split(",")]) if marked else []
                parts, at, hit, k = [], 0, 0, 0
                for start, stop in cuts:
                    parts.append(text[at:start])
                    at = stop
                for u in units:
                    while k < len(cuts) and cuts[k][1] <= u[0]:
                        k += 1
                    hit += k < len(cuts) and cuts[k][0] < u[1]
                kept.append("".join([*parts, text[at:]]))
                n_all.append(len(units))
                n_gone.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string()),
                                              pa.array(n_all, pa.int64()), pa.array(n_gone, pa.int64())],
                                             names=out.names)

    # Spans go to Python as text: list columns make Arrow batches slow to write.
    marked = F.array_join(F.transform("spans", lambda p: F.concat_ws(":", p["start"], p["stop"])), ",")
    done = joined.select("row", body.alias("body"), marked.alias("spans")).mapInArrow(rewrite, out)
    return unfold(done, docs.columns, {"text": F.col("body"), "n_sentences": F.col("n_sentences"),
                                       "n_removed": F.col("n_removed")})
