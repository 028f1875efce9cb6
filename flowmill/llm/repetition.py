"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Limits on the share of repeated lines and of characters inside repeated lines and word n-grams. They
# are looser than published ones, which reject 1 % of the documents labelled good for a repeated line.
LINE_SHARE, LINE_CHAR_SHARE = 0.50, 0.30
TOP_SHARES = {2: 0.30, 3: 0.28, 4: 0.26}
DUPLICATE_SHARES = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
MAX_SYMBOLS_PER_WORD = 0.1
SYMBOLS = [c.encode() for c in "#*$%&|<>"]
MULTIPLIER, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, and the start and size of each run of equal keys in that order."""
    order = np.argsort(keys)
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return order, starts, np.diff(np.append(starts, len(keys)))


def _lines(text: str) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, and the characters of both."""
    seen: set[str] = set()
    n = duplicate = duplicate_chars = chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += 1
            chars += len(line)
            if line in seen:
                duplicate += 1
                duplicate_chars += len(line)
            else:
                seen.add(line)
    return n, duplicate, duplicate_chars, chars


def measures(text: str) -> dict:
    """Counts and coverage of one text.

    A repeated n-gram starts where a repeated (n-1)-gram starts and one starts a word later, so each
    length sorts only what is left of the one before. Lengths to 3 compare word numbers exactly,
    longer ones a 64-bit rolling hash of them.
    """
    data = text.encode()
    found = data.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(found)
    names: dict[bytes, int] = {}
    ids = np.fromiter([names.setdefault(w, len(names)) for w in found], np.int64, n)
    points = names if data.isascii() else map(bytes.decode, names)
    lengths = np.fromiter(map(len, points), np.int64, len(names))
    ends = np.concatenate(([0], np.cumsum(lengths[ids]))) if n else np.zeros(1, np.int64)
    chars = int(ends[-1])
    n_lines, n_dup, dup_chars, line_chars = _lines(text)
    out = {"n_words": n, "word_chars": chars, "n_symbols": sum(map(data.count, SYMBOLS)), "n_dup_lines": n_dup,
           "n_repeat_words": 0, "dup_line_share": n_dup / max(n_lines, 1),
           "dup_line_char_share": dup_chars / max(line_chars, 1),
           "top_shares": {}, "dup_shares": {}}
    many = np.bincount(ids, minlength=1)[ids] > 1 if n else np.zeros(0, bool)
    base = np.int64(max(len(names), 1))
    keys = ids.astype(np.uint64)
    rolled = None
    for width in range(2, 11):
        at = np.flatnonzero(many[:-1] & many[1:]) if len(many) > 1 else np.zeros(0, np.int64)
        at = at[at + width <= n]
        if not len(at):
            break
        if width <= 3:
            keys = (number if width == 3 else ids)[at] * base + ids[at + width - 1]
        else:
            with np.errstate(over="ignore"):
                keys = rolled[at] * MULTIPLIER + ids[at + width - 1].astype(np.uint64) * ODD
                keys ^= keys >> np.uint64(29)
        order, starts, counts = _groups(keys)
        again = counts > 1
        repeats = at[order[np.repeat(again, counts)]]
        many = np.zeros(n, bool)
        many[repeats] = True
        if width == 2:
            number = np.zeros(n, np.int64)
            number[at[order]] = np.repeat(np.arange(len(starts)), counts)
        if width >= 3:
            rolled = np.zeros(n, np.uint64)
            rolled[at] = keys.astype(np.uint64)
        if width in TOP_SHARES:
            top = int(counts.max())
            first = at[order[starts[counts == top]]]
            out["top_shares"][width] = top * int((ends[first + width] - ends[first]).max()) / chars if top > 1 else 0.0
        if width == 3 or width not in TOP_SHARES:
            steps = np.zeros(n + 1, np.int64)
            steps[repeats] += 1
            steps[repeats + width] -= 1  # repeats are distinct positions
            inside = np.cumsum(steps)[:n] > 0
            if width == 3:
                out["n_repeat_words"] = int(inside.sum())
            else:
                out["dup_shares"][width] = int(lengths[ids[inside]].sum()) / chars
    return out


def verdict(m: dict) -> bool:
    """The method's verdict: no limit on repetition or symbols is passed. Ties with a limit pass."""
    return (m["dup_line_share"] <= LINE_SHARE and m["dup_line_char_share"] <= LINE_CHAR_SHARE
            and m["n_symbols"] <= MAX_SYMBOLS_PER_WORD * m["n_words"]
            and all(m["top_shares"].get(w, 0) <= s for w, s in TOP_SHARES.items())
            and all(m["dup_shares"].get(w, 0) <= s for w, s in DUPLICATE_SHARES.items()))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["dup_line_share", "dup_line_char_share"]


def apply_rules(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, counts, base_failed, kept, and the shares behind the verdict, one row per document.

    One pass without a shuffle, a text at a time in numpy. Null texts have no words and fail the base
    rule, as blank ones do. Null doc_ids are passed on, repeated rows give repeated rows, other
    columns are not read, an empty table gives an empty table.
    """
    long, double, flag = T.LongType(), T.DoubleType(), T.BooleanType()
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, long) for c in COUNTS],
                           T.StructField("base_failed", flag), T.StructField("kept", flag),
                           *[T.StructField(c, double) for c in SHARES],
                           T.StructField("top_ngram_share", double), T.StructField("dup_ngram_share", double)])

    def run(batches):
        for batch in batches:
            rows = [measures(t or "") for t in batch.column("text").to_pylist()]
            failed = [m["n_words"] < min_words or 100 * m["n_repeat_words"] > 50 * m["n_words"] for m in rows]
            kept = [not f and verdict(m) for f, m in zip(failed, rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([m[c] for m in rows], pa.int64()) for c in COUNTS],
                 pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()),
                 *[pa.array([m[c] for m in rows], pa.float64()) for c in SHARES],
                 pa.array([max(m["top_shares"].values(), default=0.0) for m in rows], pa.float64()),
                 pa.array([max(m["dup_shares"].values(), default=0.0) for m in rows], pa.float64())],
                names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
