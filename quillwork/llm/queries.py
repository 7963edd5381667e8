"""The corpus operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bytebpe, contamination, langid, licences, linededup, packing, quality, simhash, substring, toxicity, variants, warc,
               whitening)
from .textkit import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return wrap


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM r
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return warc.digests(warc.read_archives(archives))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), longest=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_substring", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS s,
         unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], ' ')))) AS h
  FROM d WHERE len(w) >= 50
), f AS (
  SELECT h, min(doc_id) AS source FROM k GROUP BY h
), g AS (
  SELECT DISTINCT k.doc_id, s + unnest(range(50)) AS p FROM k JOIN f USING (h) WHERE k.doc_id > f.source
), v AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), r AS (
  SELECT v.doc_id, count(g.p) AS n, string_agg(word, ' ' ORDER BY v.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM v LEFT JOIN g USING (doc_id, p) GROUP BY v.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed",
                        F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest"))).alias("kept_sha256"))

def _template_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(name)}, {quote(text)})" for name, texts in licences.TEMPLATES.items() for text in texts)


_BIGRAMS = """list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
              WHEN len(w) = 1 THEN [w[1] || ' '] ELSE [] END)"""


@query("op5_licences", f"""
WITH t AS (
  SELECT licence, {_BIGRAMS} AS g FROM (
    SELECT col0 AS licence, regexp_extract_all(lower(col1), '[\\p{{L}}\\p{{N}}]+') AS w FROM (VALUES {_template_sql()}) v)
), p AS (
  SELECT DISTINCT doc_id, unnest(string_split(text, chr(10)) || string_split(text, chr(10) || chr(10)) || [text]) AS part FROM documents
), b AS (
  SELECT doc_id, part, {_BIGRAMS} AS g FROM (
    SELECT doc_id, part, regexp_extract_all(lower(part), '[\\p{{L}}\\p{{N}}]+') AS w FROM p)
  WHERE len(w) > 0
), m AS (
  SELECT doc_id, part, licence, 2.0 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS score
  FROM b JOIN t ON 0.8 * len(t.g) <= 1.2 * len(b.g) + 1e-6 AND 0.8 * len(b.g) <= 1.2 * len(t.g) + 1e-6
), f AS (
  SELECT doc_id, licence, score FROM m WHERE score >= 0.8 - 1e-12
  QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY score DESC, licence) = 1
)
SELECT d.doc_id, coalesce(string_agg(DISTINCT f.licence, ',' ORDER BY f.licence), '') AS licences,
       round(max(f.score), 9) AS best_score
FROM documents d LEFT JOIN (SELECT doc_id, licence, max(score) AS score FROM f GROUP BY ALL) f USING (doc_id)
GROUP BY d.doc_id
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.col("hits.licence"))), ",").alias("licences"),
                        F.round(F.array_max("hits.score"), 9).alias("best_score"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.weak_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.round("quality", 6).alias("quality"))


def _remainder(id_col: str, parts: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))


@query("op7_langid")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.train(docs.filter(_remainder("doc_id", 3) != 1))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    net = toxicity.train(docs, table(spark, sf_dir, "labels").filter(_remainder("doc_id", 5) != 0))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_linededup", """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS raw,
         list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lines
  FROM documents
), w AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS n FROM l
), p AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, lines, n FROM w
), k AS (
  SELECT doc_id, pos, size, lines[pos:pos + size - 1] AS run FROM p, (VALUES (1), (2), (3)) s(size)
  WHERE pos + size - 1 <= len(lines) AND (size = 3 OR list_sum(n[pos:pos + size - 1]) >= 50)
), first AS (
  SELECT run, min({'d': doc_id, 'a': pos}) AS source FROM k GROUP BY run HAVING count(*) > 1
), gone AS (
  SELECT k.doc_id, list_distinct(flatten(list(range(pos, pos + size)))) AS places
  FROM k JOIN first USING (run) WHERE {'d': k.doc_id, 'a': k.pos} > first.source GROUP BY k.doc_id
)
SELECT l.doc_id, len(l.lines) AS n_lines, coalesce(len(places), 0) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN l.text ELSE array_to_string(
         list_transform(list_filter(range(1, len(raw) + 1), lambda i: NOT list_contains(places, i)), lambda i: raw[i]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN gone USING (doc_id)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _word_list(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op10_contamination", f"""
WITH i AS (
  SELECT item_id, {_word_list('text')} AS w FROM benchmark
), b AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda k: array_to_string(w[k:k + 12], ' '))) AS h
  FROM i WHERE len(w) > 0
), d AS (
  SELECT doc_id, {_word_list('text')} AS w FROM documents
), k AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s,
         unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS h
  FROM d JOIN (SELECT DISTINCT n FROM b) l ON len(d.w) >= l.n
), m AS (
  SELECT k.doc_id, k.s, k.n, b.item_id FROM k JOIN b ON b.h = k.h AND b.n = k.n
), p AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, s + unnest(range(n)) AS at_word FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                        contamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained",
                        "identity_error")


@query("op12_bytebpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def _crc_step(byte: str) -> str:
    """SQL of the table entry of a byte in the reflected polynomial of crc32; entries are linear in the bits of the byte."""
    terms = []
    for bit in range(8):
        entry = 1 << bit
        for _ in range(8):
            entry = entry >> 1 ^ (0xEDB88320 if entry & 1 else 0)
        terms.append(f"(({byte} >> {bit}) & 1) * {entry}")
    sql = terms[0]
    for term in terms[1:]:
        sql = f"xor({sql}, {term})"
    return sql


@query("op13_variants", f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
                                           '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), c AS (
  SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run HAVING length(run) >= 5
), b AS (
  SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''),
                                        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM c
), h AS (
  SELECT run, k, xor(list_reduce(list_transform([4294967295] || bytes, lambda x: x::BIGINT),
                                 lambda s, x: xor(s >> 8, {_crc_step('(xor(s, x) & 255)')})), 4294967295) AS crc FROM b
), m AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, k FROM h
), v AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), p AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), e AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT p.word, p.n, v.word, v.n FROM p JOIN v ON v.word = p.rest
  UNION SELECT v.word, v.n, p.word, p.n FROM p JOIN v ON v.word = p.rest
), g AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM e GROUP BY word, n
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form,
         CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN g USING (word)
), w AS (
  SELECT word, word AS root, 0 AS step FROM f
  UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL
), z AS (
  SELECT word, arg_max(root, step) AS root FROM w GROUP BY word
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z USING (word)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"), shortest=5, least=3, ratio=2, every=97)
