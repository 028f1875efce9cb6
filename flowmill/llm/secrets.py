"""Secret scans: fixed patterns, and a battery of randomness tests (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from flowmill.llm.common import digest
from flowmill.session import cut_lineage

# The patterns every scan reports, in the order that breaks ties, and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # shorter runs are dropped anyway
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
# What the tests look at: unbroken runs of characters that encodings of random bytes use, and their
# padding. A '=' elsewhere ends a run, so the value behind a name and '=' is a run of its own.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]
# Pre-filters: a text or run without a match here has none above either.
ANY = r"(?i:password|passwd|secret|token|api_?key)[\"' ]{0,2}\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|" + CANDIDATE

# The alphabets of the encodings that are inferred, smallest first, and their orders.
DIGITS = "0123456789"
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", AZ + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + az),
    ("base64", r"^[A-Za-z0-9+/_-]+$", AZ + az + DIGITS + "+/"),
]
# Chance that two letters, or that one letter and a hexadecimal digit, agree in natural text.
COINCIDENCE, HEX_SHARE = 0.065, 0.3


def _spans(source: DataFrame, pattern: str, kind: str, least) -> DataFrame:
    """(id, text_id, kind, start, stop, match) of a pattern's leftmost, non-overlapping matches.

    A split gives the gaps between matches, so starts are running sums of gaps and matches, taken
    over the few rows that matches are."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), found.alias("match"))  # the last gap has no match
    rows = (source.where(F.col("text").rlike(pattern))
            .select("id", "text_id", F.posexplode_outer(steps).alias("n", "step"))
            .select("id", "text_id", "n", F.length("step.gap").alias("gap"), F.col("step.match").alias("match"))
            .where(F.col("match").isNotNull()))
    so_far = Window.partitionBy("id", "text_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(so_far))
            .select("id", "text_id", F.lit(kind).alias("kind"),
                    (F.col("stop") - F.length("match")).alias("start"), "stop", "match")
            .where(least(F.col("match"))))


# Coefficients of a published polynomial fit to the complementary error function.
FIT_AT, FIT = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z (error under 1e-7), inputs evaluated once."""
    def tail(v):
        x = F.abs(v) / 2 ** 0.5
        half = F.aggregate(F.array(*map(F.lit, reversed(FIT))), F.lit(0.0),
                           lambda a, c: (a + c) / (1 + FIT_AT * x)) * F.exp(-x * x) / 2
        return F.when(v >= 0, half).otherwise(1 - half)

    return F.get(F.transform(F.array(z), tail), 0)


def randomness_tests(tokens: DataFrame) -> DataFrame:
    """Adds encoding, p_uniform, p_runs, p_serial, p_fit and p_natural to a table with `match`.

    The encoding is the smallest alphabet that holds all characters (trailing '=' apart). Under
    "drawn evenly from it": the chi-squared test of symbol counts (cube-root normal form), the runs
    test about the middle of the alphabet and the lag-1 serial correlation; p_fit joins them by
    Fisher's method. p_natural is the chance that natural text of that length repeats its letters as
    rarely (counts of agreeing pairs, square-root normal form), or has only hexadecimal digits.
    """
    body = F.regexp_replace("match", "=+$", "")
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, symbols in reversed(ENCODINGS):
        encoding = F.when(body.rlike(pattern), F.lit(name)).otherwise(encoding)
        alphabet = F.when(body.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    known = (tokens.withColumn("encoding", encoding).withColumn("alphabet", alphabet)
             .withColumn("body", F.translate(body, "-_", "+/"))
             .where(F.col("encoding").isNotNull() & (F.length("body") >= 20)))
    n, size = F.length("body").cast("double"), F.length("alphabet").cast("double")
    chars = F.regexp_extract_all("body", F.lit("."), F.lit(0))
    counted = known.withColumns({
        "n": n, "size": size,
        "squares": F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.pow(
            (F.length("body") - F.length(F.replace(F.col("body"), c, F.lit("")))).cast("double"), F.lit(2.0))),
            F.lit(0.0), lambda a, x: a + x),
        "values": F.transform(chars, lambda c: F.position(c, F.col("alphabet")).cast("double")),
    })
    middle = (F.col("size") + 1) / 2
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    counted = counted.withColumns({
        "high": total(F.transform("values", lambda v: (v > middle).cast("double"))),
        "bits": F.array_join(F.transform("values", lambda v: (v > middle).cast("int").cast("string")), ""),
        "mean": total(F.col("values")) / F.col("n")})
    counted = counted.withColumns({
        "runs": F.length(F.regexp_replace("bits", "0+|1+", "x")).cast("double"),
        "spread": total(F.transform("values", lambda v: (v - F.col("mean")) * (v - F.col("mean")))),
        "lagged": total(F.zip_with(F.slice("values", F.lit(1), F.size("values") - 1), F.expr("slice(values, 2, size(values) - 1)"),
                                   lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))))})
    n, size = F.col("n"), F.col("size")
    free = size - 1
    chi2 = F.col("squares") * size / n - n
    z_chi = (F.pow(F.greatest(chi2, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    high, low = F.col("high"), n - F.col("high")
    mixed = 2 * high * low
    run_sd = F.sqrt(F.greatest(mixed * (mixed - n) / (n * n * (n - 1)), F.lit(1e-9)))
    z_runs = F.abs(F.col("runs") - (mixed / n + 1)) / run_sd
    z_lag = F.abs(F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n)
    pairs = n * (n - 1) / 2
    agreeing = (F.col("squares") - n) / 2
    z_natural = 2 * (F.sqrt(agreeing + 0.375) - F.sqrt(pairs * COINCIDENCE))
    fit = lambda p: F.greatest(p, F.lit(1e-12))
    out = counted.withColumns({
        "p_uniform": _upper_tail(z_chi),
        "p_runs": F.when((high == 0) | (low == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * _upper_tail(z_runs)),
        "p_serial": F.when(F.col("spread") == 0, F.lit(0.0)).otherwise(2 * _upper_tail(z_lag)),
        "p_natural": F.least(_upper_tail(-z_natural), F.when(
            F.col("encoding").startswith("hex"), F.pow(F.lit(HEX_SHARE), n)).otherwise(F.lit(1.0)))})
    half = -(F.log(fit(F.col("p_uniform"))) + F.log(fit(F.col("p_runs"))) + F.log(fit(F.col("p_serial"))))
    return (out.withColumn("p_fit", F.exp(-half) * (1 + half + half * half / 2))
            .drop("alphabet", "body", "squares", "values", "high", "bits", "mean", "runs", "spread", "lagged", "size", "n"))


def discoveries(tested: DataFrame, rate: float = 0.01, least_fit: float = 0.001) -> DataFrame:
    """Tokens that natural text does not explain, at a false-discovery rate held per length class.

    The step-up rule needs ranks of p_natural among all tokens of a length class (powers of two).
    They come from counts in steps of -log10(p), at most 400 steps a class, so the only table
    that is ranked or broadcast is bounded whatever the input; a step counts as its largest p.
    """
    steps = 400
    step = F.least(F.floor(-F.log10(F.greatest(F.col("p_natural"), F.lit(1e-40))) * 10), F.lit(steps)).cast("int")
    classed = (tested.withColumn("length_class", F.floor(F.log2(F.length("match"))).cast("int"))
               .withColumn("step", step))
    counts = classed.groupBy("length_class", "step").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("length_class")
    upto = by_class.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    limit = (counts.withColumn("rank", F.sum("n").over(upto)).withColumn("m", F.sum("n").over(by_class))
             .where(F.pow(F.lit(10.0), -F.col("step") / 10.0) <= rate * F.col("rank") / F.col("m"))
             .groupBy("length_class").agg(F.min("step").alias("least_step")))
    return (classed.join(F.broadcast(limit), "length_class")
            .where((F.col("step") >= F.col("least_step")) & (F.col("p_fit") >= least_fit))
            .drop("length_class", "step", "least_step"))


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """One row a document row: doc_id, text_id and `spans`, an array of (start, kind_no, kind, stop)
    in order of start, then kind; code points, end exclusive.

    Kinds assign, access and hex are the fixed patterns. Kind random are runs of 20 or more
    characters that pass the randomness tests and touch no span of a fixed pattern. Long runs of
    text cost time in proportion to their length; texts without a candidate pass one pattern only.

    Null texts count as empty and have no spans. Rows of equal doc_id and text share their spans;
    each gets a row. A null doc_id is an id like any other. Tokens whose chances tie fall into one step and are found or
    not together. Other columns are not read; an empty table gives an empty one.
    """
    source = docs.select(F.col("doc_id").alias("id"), digest(F.coalesce("text", F.lit(""))).alias("text_id"),
                         F.coalesce("text", F.lit("")).alias("text"))
    # Read by every pattern: the one scan of all texts is not repeated.
    likely = cut_lineage(source.where(F.col("text").rlike(ANY)).dropDuplicates(["id", "text_id"]))
    base = (_spans(likely, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN)
            .unionByName(_spans(likely, ACCESS, "access", lambda m: F.length(m) >= MIN_ACCESS))
            .unionByName(_spans(likely, HEX, "hex", lambda m: F.length(m) >= MIN_HEX)))
    tokens = _spans(likely, CANDIDATE, "random", lambda m: F.length(m) >= 20)
    # The tests cost more than their few bytes suggest, so tokens are dealt by number, and results are used twice.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    random = discoveries(cut_lineage(randomness_tests(tokens.repartition(tasks))), rate).select("id", "text_id", "kind", "start", "stop", "match")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(F.col("start"), number.alias("kind_no"), "kind", F.col("stop"))
    spans = (base.unionByName(random).groupBy(F.col("id").alias("of_id"), F.col("text_id").alias("of_text"))
             .agg(F.array_sort(F.collect_list(span)).alias("spans")))
    fixed = F.filter("spans", lambda s: s["kind"] != "random")
    own = F.filter("spans", lambda s: (s["kind"] != "random") | ~F.exists(
        fixed, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    spans = spans.withColumn("spans", own)
    empty = F.array().cast(spans.schema["spans"].dataType)
    return (source.select("id", "text_id").join(
        spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_id") == F.col("of_text")), "left")
        .select(F.col("id").alias("doc_id"), "text_id", F.coalesce("spans", empty).alias("spans")))


def render(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
