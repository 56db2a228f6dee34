"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode_ids, encode_texts, load_vocabulary
from .durable import shared_path
from .kneser_ney import classify_quality
from .language_id import fit_language_model, identify_languages
from .license_scan import KNOWN, SPELLINGS, scan_licenses
from .line_chunk_dedup import LONG_LINE, REACH, remove_repeated_chunks
from .minhash_dedup import near_duplicates
from .pareto_mix import mix_sources
from .part_codes import ENTRIES, PARTS, ROUNDS, SCALE, books_digest, compress_vectors, fit_codebooks, with_label_error
from .rule_cascade import rule_cascade
from .spelling_groups import count_words, group_spellings
from .url_filter import filter_urls
from .warc_revisit import read_archives, resolve_revisits, write_archives
from .winnow_decontam import find_leaks

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, over 4-word shingles at 0.8."""
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc, b AS root FROM u UNION SELECT r.doc, u.b FROM r JOIN u ON r.root = u.a),
m AS (SELECT doc, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.root, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.root, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.doc = d.doc_id
"""



def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, by entire text and by entire lines."""
    out = scan_licenses(_read(spark, sf_dir, "documents"))
    return out.withColumn("line_licenses", F.array_join("line_licenses", ","))


def _canonical_sql(text: str) -> str:
    sql = rf"regexp_replace(lower({text}), '(?m)^[^\n\p{{L}}]*(?:copyright\b|\(c\)|©)[^\n]*$', '', 'g')"
    sql = rf"regexp_replace({sql}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    for other, usual in SPELLINGS:
        sql = rf"regexp_replace({sql}, '\b{other}\b', '{usual}', 'g')"
    return rf"regexp_replace({sql}, ' ?\n ?', chr(10), 'g')"


def _digest_sql(text: str) -> str:
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"CASE WHEN {flat} <> '' THEN sha256({flat}) END"


_OP2 = f"""
WITH k AS (SELECT {_digest_sql(_canonical_sql("t"))} AS digest, name FROM (VALUES {", ".join(f"('{n}', '{t}')" for n, t in KNOWN)}) v(name, t)),
c AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS t FROM documents),
d AS (SELECT doc_id, {_digest_sql("t")} AS digest FROM c),
l AS (SELECT doc_id, {_digest_sql("line")} AS digest FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c)),
f AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names, count(*) AS n FROM l JOIN k USING (digest) GROUP BY 1)
SELECT d.doc_id, d.digest, k.name AS license, coalesce(f.names, '') AS line_licenses, coalesce(f.n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN k USING (digest) LEFT JOIN f ON f.doc_id = d.doc_id
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict for all documents; trusted are those labelled good and not toxic."""
    trusted = _read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return classify_quality(_read(spark, sf_dir, "documents"), trusted)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the cascade's verdict for all documents."""
    return rule_cascade(_read(spark, sf_dir, "documents")).drop("failed_rule")


_OP4 = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM d) GROUP BY 1),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, len(ls) AS n_lines
  FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 100 * n_upper > 60 * n_letters OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM b
"""


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives with revisit records, and read back."""
    path = shared_path(spark, "archives")
    write_archives(_read(spark, sf_dir, "pages"), path, least_bytes=0)
    return resolve_revisits(read_archives(spark, path, payloads=False))


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(s, {a + 1}, 5))::INT >> {b} & 31) + 1, 1)" for a in range(0, 40, 5) for b in (15, 10, 5, 0))
_OP5 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS newest FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM m
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit_language_model(docs.where(~held & F.col("doc_id").isNotNull()))
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: The rules of the query: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


_OP7 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND k = 1
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    leaks = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return leaks.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT item_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM k)),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM k) ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, item_id, i, k FROM dw JOIN iw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 1, 2, 3 in turn."""
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_OP9 = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM g),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least((max(level) OVER ()) * weight::DOUBLE, cap::DOUBLE) AS target FROM l),
d AS (SELECT s.doc_id, s.source, size, source_size, target FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT source, least(floor(target / sum(size)::DOUBLE), 3)::BIGINT AS whole, sum(size)::BIGINT AS fits FROM d WHERE size <= target GROUP BY source, target HAVING sum(size) > 0),
u AS (SELECT d.*, CASE WHEN size <= target THEN coalesce(whole, 0) ELSE 0 END AS whole, greatest(target - (coalesce(whole * fits, 0))::DOUBLE, 0.0::DOUBLE) AS rest,
             ((greatest(size, 1) >> greatest(len(bin(greatest(size, 1))) - 8, 0)) << greatest(len(bin(greatest(size, 1))) - 8, 0))::BIGINT AS weight,
             (('0x' || substr(md5('mix|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw
      FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source),
v AS (SELECT *, size <= target AND size > 0 AND size <= rest AND whole < 3 AS eligible FROM u),
n AS (SELECT source, rest, weight, sum(size)::BIGINT AS words, sum(weight::HUGEINT * size)::HUGEINT AS mass FROM v WHERE eligible GROUP BY 1, 2, 3),
q AS (SELECT *, (rest - coalesce(sum(words) OVER o, 0)::DOUBLE) / (sum(mass) OVER (PARTITION BY source) - coalesce(sum(mass) OVER o, 0))::DOUBLE AS scale
      FROM n WINDOW o AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT source, arg_max(scale, weight) AS scale FROM q WHERE scale * weight <= 1 GROUP BY 1),
c AS (SELECT v.*, CASE WHEN eligible THEN CASE WHEN scale IS NULL THEN 1::DOUBLE ELSE least(scale * weight, 1::DOUBLE) END END AS chance FROM v LEFT JOIN a ON v.source IS NOT DISTINCT FROM a.source),
h AS (SELECT *, CASE WHEN chance < 1 THEN ((draw / (1 - draw)) / (chance / (1 - chance))) / (1 + (draw / (1 - draw)) / (chance / (1 - chance))) END AS place FROM c),
k AS (SELECT *, sum(CASE WHEN chance IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY CASE WHEN chance >= 1 THEN -1 ELSE place END, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM h),
x AS (SELECT *, CASE WHEN chance >= 1 OR (chance < 1 AND upto <= rest) THEN 1 ELSE 0 END AS extra FROM k),
y AS (SELECT *, target - (sum(size * (whole + extra)) OVER (PARTITION BY source))::DOUBLE AS gap FROM x),
i AS (SELECT *, row_number() OVER (PARTITION BY source, extra = 0 AND size > 0 AND whole < 3 AND size < 2 * gap ORDER BY abs(gap - size), coalesce(place, 1), doc_id) = 1
             AND extra = 0 AND size > 0 AND whole < 3 AND size < 2 * gap AS best FROM y)
SELECT doc_id, size, source_size, target, (size * (whole + extra + best::INT))::BIGINT AS taken FROM i
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without chunks of lines that repeat."""
    out = remove_repeated_chunks(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


_OP10 = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, ls, list_transform(ls, lambda x: ascii(md5(x)) % 4) AS ts FROM l),
e AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR length(ls[i]) >= {LONG_LINE} OR coalesce(length(ls[i + 1]) >= {LONG_LINE}, false)
        OR (ts[i] + 2 * (CASE WHEN i > 1 THEN ts[i - 1] ELSE 0 END)) % 4 <> 0) AS ends FROM g),
k AS (SELECT doc_id, ls, ends, unnest(range(1, len(ends) + 1)) AS k FROM e),
c AS (SELECT doc_id, ls, (CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END) AS lo, ends[k] AS hi FROM k),
b AS (SELECT doc_id, lo, hi, ls[lo:hi] AS body, list_reverse(ls[greatest(lo - {REACH}, 1):lo - 1]) AS up, ls[hi + 1:hi + {REACH}] AS down FROM c
      WHERE len(list_filter(ls[lo:hi], lambda x: trim(x) <> '')) > 0),
o AS (SELECT *, first_value(doc_id) OVER w AS o_id, first_value(lo) OVER w AS o_lo, first_value(up) OVER w AS o_up, first_value(down) OVER w AS o_down
      FROM b WINDOW w AS (PARTITION BY body ORDER BY doc_id, lo)),
x AS (SELECT doc_id, o_id, lo - o_lo AS shift, lo, hi,
             list_position(list_transform(range(1, {REACH} + 2), lambda i: coalesce(up[i] = o_up[i], false)), false) - 1 AS u,
             list_position(list_transform(range(1, {REACH} + 2), lambda i: coalesce(down[i] = o_down[i], false)), false) - 1 AS d
      FROM o WHERE doc_id <> o_id OR lo <> o_lo),
r AS (SELECT DISTINCT doc_id, o_id, shift, lo - u AS lo, hi + d AS hi FROM x),
f AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY doc_id, o_id, shift ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, o_id, shift ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM f),
m AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY doc_id, o_id, shift, island),
q AS (SELECT doc_id, lo, hi FROM m JOIN l USING (doc_id)
      WHERE len(list_filter(ls[lo:hi], lambda x: trim(x) <> '')) > 1 OR length(array_to_string(ls[lo:hi], chr(10))) >= {LONG_LINE}),
z AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS i FROM q) GROUP BY 1),
t AS (SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
             coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)), '') AS text
      FROM l LEFT JOIN z USING (doc_id))
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(t.text) AS text_sha256 FROM documents LEFT JOIN t USING (doc_id)
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and digests of them and of what they decode to."""
    vocabulary = load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = decode_ids(encode_texts(_read(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, one occurrence in 199 misspelt."""
    return group_spellings(count_words(_read(spark, sf_dir, "documents"), typo_every=199))


_STEPS = "c"
for _ in range(8):  # the polynomial's step, once for each bit of a byte
    _STEPS = f"list_transform([{_STEPS}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
_OP12 = rf"""
WITH RECURSIVE b(b, crc) AS (SELECT b, list_transform([b], lambda c: {_STEPS})[1] FROM range(256) t(b)),
tab AS (SELECT list(crc ORDER BY b) AS crcs FROM b),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, {_LOWER} AS t FROM documents),
o AS (SELECT doc, w, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS w FROM d) GROUP BY 1, 2),
x AS (SELECT doc, w, n, hex(encode(doc || ':' || w)) AS h FROM o),
y AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, v: xor(c >> 8, crcs[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) AS crc FROM x, tab),
z AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(w, 1, (crc % length(w))::BIGINT) || substr(w, (crc % length(w))::BIGINT + 2) ELSE w END AS word, n FROM y),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM z GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
c AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS e FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT l.word, r.word AS near, r.n AS near_n FROM c l JOIN c r ON l.i = r.i AND l.a = r.a AND l.e = r.e AND l.word <> r.word
      UNION SELECT c.word, v.word, v.n FROM c JOIN v ON v.word = c.a || c.e
      UNION SELECT v.word, c.word, c.n FROM c JOIN v ON v.word = c.a || c.e),
m AS (SELECT word, count(*)::BIGINT AS n_near, min({{'less': -near_n, 'near': near}}) AS best FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 5 * v.n THEN best.near END AS form,
        CASE WHEN -best.less >= 5 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN m USING (word)),
g(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM g JOIN f ON f.form = g.word)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN g USING (word)
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by codebooks fitted to all of them."""
    vectors = _read(spark, sf_dir, "embeddings")
    model = fit_codebooks(vectors)
    out = with_label_error(compress_vectors(vectors, model))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(model[1])).alias("codebooks_sha256"))


def _op13() -> str:
    near = f"""AS MATERIALIZED (SELECT rid, part, min({{{{'d': d, 'entry': entry}}}}) AS best
      FROM (SELECT rid, c.part, entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{{0}} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""
    moves = "".join(
        f""",
a{i} {near.format(i)},
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
      SELECT c.part, best.entry AS entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM c JOIN a{i} a ON a.rid = c.rid AND a.part = c.part GROUP BY ALL) m USING (part, entry, pos))"""
        for i in range(ROUNDS)
    )
    return f"""
WITH k AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS MATERIALIZED (SELECT rid, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS pos, floor({SCALE} * v[i]::DOUBLE)::BIGINT AS x
      FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS i FROM k)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM c WHERE rid <= {ENTRIES}){moves},
z {near.format(ROUNDS)},
e AS (SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM z GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM k JOIN e USING (rid)
"""


_OP13 = _op13()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_license_scans": op2_license_scans,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_quality_rules": op4_quality_rules,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_language_id": op6_language_id,
        "op7_url_filters": op7_url_filters,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_source_mixing": op9_source_mixing,
        "op10_line_dedup": op10_line_dedup,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": _OP1,
        "op2_license_scans": _OP2,
        "op4_quality_rules": _OP4,
        "op5_warc_revisits": _OP5,
        "op7_url_filters": _OP7,
        "op8_benchmark_decontamination": _OP8,
        "op9_source_mixing": _OP9,
        "op10_line_dedup": _OP10,
        "op12_spelling_variants": _OP12,
        "op13_vector_codes": _OP13,
    }
