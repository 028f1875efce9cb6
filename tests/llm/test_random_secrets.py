"""The randomness tests and their false-discovery control against plain Python."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from flowmill.llm import secrets

AZ, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = [DIGITS + "abcdef", DIGITS + "ABCDEF", AZ + "234567", DIGITS + AZ.lower(), AZ + AZ.lower() + DIGITS + "+/"]


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def chances(match):
    """(p_natural, p_fit) of a candidate, None where no alphabet holds it."""
    body = match.rstrip("=").replace("-", "+").replace("_", "/")
    plain = match.rstrip("=")
    at = next((i for i, a in enumerate(ALPHABETS) if all(c in a for c in (plain if i < 4 else body))), None)
    if at is None or len(body) < 20:
        return None
    alphabet, n = ALPHABETS[at], len(body)
    size, free = len(alphabet), len(alphabet) - 1
    squares = sum(k * k for k in Counter(body).values())
    values = [alphabet.index(c) + 1 for c in body]
    chi2 = squares * size / n - n
    uniform = tail(((max(chi2, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    bits = [v > (size + 1) / 2 for v in values]
    high = sum(bits)
    if high in (0, n):
        runs = 2.0 ** (1 - n)
    else:
        mixed = 2 * high * (n - high)
        found = 1 + sum(a != b for a, b in zip(bits, bits[1:]))
        runs = 2 * tail(abs(found - (mixed / n + 1)) / math.sqrt(max(mixed * (mixed - n) / (n * n * (n - 1)), 1e-9)))
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    lagged = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:]))
    serial = 2 * tail(abs(lagged / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    natural = tail(-2 * (math.sqrt((squares - n) / 2 + 0.375) - math.sqrt(n * (n - 1) / 2 * secrets.COINCIDENCE)))
    if at < 2:
        natural = min(natural, secrets.HEX_SHARE ** n)
    half = -sum(math.log(max(p, 1e-12)) for p in (uniform, runs, serial))
    return natural, math.exp(-half) * (1 + half + half * half / 2)


def random_spans(texts, rate=0.01, least_fit=0.001):
    """Spans of kind random per (id, text), before those that touch a fixed pattern go."""
    tokens = defaultdict(list)
    for key in set(texts):
        for m in re.finditer(secrets.CANDIDATE, key[1]):
            if p := chances(m.group()):
                step = min(math.floor(-math.log10(max(p[0], 1e-40)) * 10), 400)
                tokens[int(math.log2(len(m.group())))].append((step, p[1], key, m.start(), m.end()))
    out = defaultdict(set)
    for found in tokens.values():
        counts, rank, least = Counter(t[0] for t in found), 0, None
        for step in sorted(counts, reverse=True):
            rank += counts[step]
            if 10.0 ** (-step / 10) <= rate * rank / len(found):
                least = step
        for step, fit, key, a, b in found:
            if least is not None and step >= least and fit >= least_fit:
                out[key].add((a, b))
    return out


def test_random_spans_are_those_of_plain_python(spark, sf):
    rng = random.Random(11)
    token = lambda n: base64.b64encode(hashlib.sha512(str(rng.random()).encode()).digest()).decode()[:n]
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, f"key {token(rng.randint(20, 80))}== and {token(24)} é {hashlib.md5(str(i).encode()).hexdigest().upper()} "
                          f"{'internationalisation' * 2} {rng.choice('ab') * 30} sig={token(43)}") for i in range(40)]
    rows += [(10_000, rows[-1][1]), (10_001, ""), rows[-1]]
    want, base = random_spans(rows), {}
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = Counter()
    for r in got.select("doc_id", "text_id", "spans").collect():
        spans = [(s["start"], s["stop"], s["kind"]) for s in r.spans]
        base[r.doc_id, bytes(r.text_id)] = [s for s in spans if s[2] != "random"]
        found[r.doc_id, bytes(r.text_id), tuple((a, b) for a, b, kind in spans if kind == "random")] += 1
    expected = Counter()
    for i, text in rows:
        key = (i, hashlib.md5(text.encode()).digest())
        own = [s for s in sorted(want.get((i, text), ())) if not any(a < s[1] and s[0] < b for a, b, _ in base[key])]
        expected[(*key, tuple(own))] += 1
    assert found == expected and sum(len(k[2]) for k in found) > 80
