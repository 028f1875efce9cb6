"""Fill-in-the-middle: texts cut at ends of lines, found by rank and select over UTF-8 read as 64-bit words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowmill.llm.batches import slices

# The marks that open prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
TOP = np.uint64(0x8080808080808080)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)


def as_words(data: bytes | np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, zero bytes at the end and one word more."""
    held = np.frombuffer(data, np.uint8)
    padded = np.zeros((len(held) // 8 + 2) * 8, np.uint8)
    padded[:len(held)] = held
    return padded.view("<u8")


def line_end_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is a line feed. Adding 7 low bits to 127 never carries into the next byte."""
    other = words ^ NEWLINES
    return ~(((other & LOW) + LOW) | other) & TOP


def code_point_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that begins a code point, that is, has not the form 10xxxxxx."""
    return (~words | (words << ONE)) & TOP


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each byte position."""
        word, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((ONE << bits) - ONE))

    def select(self, number: np.ndarray) -> np.ndarray:
        """The position of the marked byte with each number, from 0: its word by search in the
        running counts, then its bit by taking away the lower ones."""
        word = np.searchsorted(self.before, number, side="right") - 1
        left = number - self.before[word]
        bits = self.marks[word]
        for step in range(7):
            bits = np.where(left > step, bits & (bits - ONE), bits)
        lowest = bits & (~bits + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE) >> 3)


def cut_lines(data: bytes, starts: np.ndarray, ends: np.ndarray, draws: np.ndarray):
    """Units of each text `data[start:end]`, the two cut positions after draw % (units + 1) units in
    ascending order, and the code points before the first and between both."""
    words = as_words(data)
    lines, points = Marks(line_end_marks(words)), Marks(code_point_marks(words))
    first = lines.rank(starts)
    closed = lines.rank(ends) - first
    final = np.frombuffer(data, np.uint8)[np.maximum(ends - 1, 0)] if data else np.zeros(len(ends), np.uint8)
    units = closed + ((ends > starts) & (final != 10))
    wanted = np.sort(draws % (units + 1)[:, None], axis=1)
    cuts = np.empty_like(wanted)
    for side in range(2):
        k = wanted[:, side]
        at = np.where(k > closed, ends, starts)
        inner = np.flatnonzero((k > 0) & (k <= closed))
        at[inner] = lines.select(first[inner] + k[inner] - 1) + 1
        cuts[:, side] = at
    begin, one, two = points.rank(starts), points.rank(cuts[:, 0]), points.rank(cuts[:, 1])
    return units, cuts, one - begin, two - one


def _draw(digest: Column, group: int) -> Column:
    """The 8-digit group of a hex digest as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def rearrange(docs: DataFrame, seed: int = 7, rate: int = 100, spm_share: int = 50,
              block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and `output` of every whole text.

    Units are lines with their line feeds. Draws come from sha256 of `seed:doc_id`, so they do not
    depend on partitioning: the text is cut after two drawn numbers of units and written prefix,
    suffix, middle (psm) or suffix, prefix, middle (spm). It stays plain where it is empty, holds one
    of the marks, or its draw is not below `rate` per cent.

    A batch's UTF-8 is one run of 64-bit words: unit-ending bytes are marked by word arithmetic and
    counted per word; a cut is a search in the running counts and a select inside one word. Nothing is
    shuffled; a task holds about `block_bytes` of text, or one longer text.

    Null texts are empty: plain, with 0 units. A null doc_id draws as an empty name. Repeated ids and rows
    keep one row each, and equal ids draw alike; draws that tie give an empty middle. Only doc_id and
    text are read, so other columns cannot clash. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(
        text, F.lit(MIDDLE)) | (_draw(digest, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(digest, 3) % 100 < spm_share, "spm").otherwise("psm")
    drawn = docs.select("doc_id", text.alias("text"), _draw(digest, 0).alias("h1"), _draw(digest, 1).alias("h2"),
                        form.alias("form"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(
        "n long, form string, prefix_chars long, middle_chars long, output string").fields])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for part, data, bounds in slices(batches, "text", block_bytes):
            data, (p, s, m) = data.tobytes(), marks
            starts, ends = bounds[:-1], bounds[1:]
            draws = np.stack([part.column("h1").to_numpy(), part.column("h2").to_numpy()], axis=1)
            units, cuts, before, between = cut_lines(data, starts, ends, draws)
            out = []
            for form, a, b, (x, y) in zip(part.column("form").to_pylist(), starts.tolist(), ends.tolist(), cuts.tolist()):
                if form == "plain":
                    out.append(data[a:b])
                elif form == "psm":
                    out.append(b"".join((p, data[a:x], s, data[y:b], m, data[x:y])))
                else:
                    out.append(b"".join((s, data[y:b], p, data[a:x], m, data[x:y])))
            unset = pa.array(part.column("form").to_numpy(zero_copy_only=False) == "plain")
            counts = [pc.if_else(unset, pa.scalar(None, pa.int64()), pa.array(c.astype(np.int64)))
                      for c in (before, between)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(units.astype(np.int64)), part.column("form"), *counts,
                 pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    return drawn.mapInArrow(run, schema)


def restore(rearranged: DataFrame) -> DataFrame:
    """`rearranged` with `text`, rebuilt from output and form alone. No text with marks is cut, and none of
    the marks can arise across a joint, so splitting at the marks gives the three parts back. Null
    outputs give null texts."""
    parts = F.split("output", "<[PSM]>", -1)
    ordered = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    text = F.when(F.col("form") == "plain", F.col("output"))
    for form, order in ordered.items():
        text = text.when(F.col("form") == form, F.concat(*[parts[i] for i in order]))
    return rearranged.withColumn("text", text)
