"""The registered queries of the operators and, where SQL can say it, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.llm import (bpe, decontaminate, fill_middle, html_extract, line_dedup, minhash, quality, repetition, secrets,
                          sentence_spans, suffix_dedup, vector_codes, word_lexicon)
from flowmill.llm.common import table
from flowmill.session import tune

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# DuckDB: white space, A-Z in lower case, and the words of a text.
WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + ", '[^\\x20\\x09-\\x0D]+')"

LINE_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, parts[pos] AS line,
         trim({LOWER.format('parts[pos]')}, {WS}) AS k, len(parts) AS n
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) a) b),
shared AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40
           GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, (s.k IS NOT NULL AND l.doc_id <> s.keeper) AS gone FROM l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, max(n)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op6_line_dedup", LINE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"),
                        F.sha2(secrets.render(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.render(F.col("spans")).alias("spans"))


CONTAINMENT_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5) x),
s AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 4], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS s FROM i WHERE len(w) >= 5) y),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT doc_id, s.item_id AS item_id, count(*)::BIGINT AS n_shared, max(n_item)::BIGINT AS n_item
FROM ds JOIN s ON ds.g = s.g JOIN n ON n.item_id = s.item_id
GROUP BY doc_id, s.item_id HAVING count(*) * 100 >= max(n_item) * 80
"""


@query("op9_decontaminate", CONTAINMENT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_tag_path_ratios")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op2_repetition_coverage")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.apply_rules(table(spark, sf_dir, "documents"))


MIN_SCORE = 0.7  # documents below are rejected


def byte_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_vocabulary())


@query("op10_quality_trees")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_sentence_spans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.drop_repeated_spans(docs)


@query("op8_circulant_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p,
                  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(p) - (p[-1] = '')::INT END AS n,
             ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
             ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::INT AS k1, greatest(h1 % (n + 1), h2 % (n + 1))::INT AS k2,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, CASE WHEN k1 = 0 THEN 0 WHEN k1 >= len(p) THEN length(t)
                     ELSE length(array_to_string(p[1:k1], chr(10))) + 1 END AS a,
                CASE WHEN k2 = 0 THEN 0 WHEN k2 >= len(p) THEN length(t)
                     ELSE length(array_to_string(p[1:k2], chr(10))) + 1 END AS b FROM k),
o AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""


@query("op11_fill_middle", MIDDLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.restore(fill_middle.rearrange(table(spark, sf_dir, "documents")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


def word_tokenizer() -> word_lexicon.WordTokenizer:
    import public_tokenizers

    return word_lexicon.WordTokenizer.read(public_tokenizers.path("word_bpe_49k.json"))


@query("op12_word_lexicon")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = word_tokenizer()
    both = word_lexicon.decode(word_lexicon.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Rounds of plain assignment to all entries, and of means."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS y
  FROM v, (SELECT unnest(range({parts})) AS part) g),
b0 AS MATERIALIZED (
  SELECT part, entry, y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) o USING (vec_id)
  WHERE entry < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, p.y,
         min(list_sum(list_transform(list_zip(p.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {entries} + b.entry) AS m
  FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.label, p.part, p.y)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS y
         FROM (SELECT part, m % {entries} AS entry, pos, sum(y[pos])::BIGINT AS s, count(*) AS n
               FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(y)) FROM p) + 1)) AS pos) g GROUP BY ALL) t GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m{r}.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} ON m{r}.part = b.part AND m{r}.entry = b.entry)""")
    return ",".join(steps) + f""",
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY part) AS code,
             sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""


@query("op13_vector_codes", codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error",
                        F.sha2(F.lit(books.text()).cast("binary"), 256).alias("codebooks_sha256"))
