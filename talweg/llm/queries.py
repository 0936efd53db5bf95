"""One query for each operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import decontamination, html_text, language_id, license_scan, line_dedup, packing, passage_dedup, quality_rules, simhash, spelling_variants, suffix_dedup, turn_repair, warc
from talweg.llm.license_templates import TEMPLATES
from talweg.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(_table(spark, sf_dir, "pages"))
    records = warc.read_records(warc.list_records(spark, packages), with_payload=False)
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast("long")
    return records.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


OP1_SQL = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
known AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM page),
coded AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST(('0x' || substr(hex, 1 + 5 * (k // 4), 5)) AS BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT, 1)), '') AS digest
  FROM known)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER (PARTITION BY hex) THEN NULL ELSE max(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM coded
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontamination.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontamination.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


OP2_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS g
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
first_word AS (SELECT DISTINCT size, split_part(g, ' ', 1) AS f FROM win),
place AS (SELECT doc_id, w, i, w[i] AS f FROM doc, unnest(range(1, len(w) + 1)) AS t(i)),
gram AS (
  SELECT doc_id, i, p.f, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g
  FROM place p JOIN first_word s ON p.f = s.f WHERE i + size - 1 <= len(w)),
hit AS (SELECT doc_id, i, h.size, item FROM gram h JOIN win USING (g)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, size)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def packed_digests(docs: DataFrame) -> DataFrame:
    """The packing of ``docs``: each piece's place, and a digest of its ids in their stead."""
    pieces = packing.token_pieces(docs, ["doc_id"])
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, i - 1 AS number, regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+') AS w
  FROM doc, unnest(range(1, len(lines) + 1)) AS t(i)),
worded AS (
  SELECT doc_id, number, array_to_string(w, ' ') AS body, len(w) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY number) AS k,
         sum(len(w)) OVER (PARTITION BY doc_id ORDER BY number) AS upto
  FROM line WHERE len(w) > 0),
run AS (
  SELECT a.doc_id, a.k AS k1, b.k AS k2
  FROM worded a JOIN worded b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + 50 AND b.upto - a.upto + a.n >= 50),
win AS (
  SELECT doc_id, k1, min(k2) AS k2 FROM run GROUP BY doc_id, k1
  UNION SELECT doc_id, max(k1) AS k1, k2 FROM run GROUP BY doc_id, k2),
body AS (
  SELECT v.doc_id, min(l.number) AS start, max(l.number) AS stop, string_agg(l.body, chr(10) ORDER BY l.k) AS g
  FROM win v JOIN worded l ON l.doc_id = v.doc_id AND l.k BETWEEN v.k1 AND v.k2 GROUP BY v.doc_id, v.k1, v.k2),
later AS (
  SELECT doc_id, start, stop FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS nth FROM body) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, number FROM later, unnest(range(start, stop + 1)) AS t(number)),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE opens) AS n_runs FROM (
    SELECT doc_id, coalesce(number - lag(number) OVER (PARTITION BY doc_id ORDER BY number) > 1, true) AS opens FROM gone)
  GROUP BY doc_id),
rest AS (
  SELECT line.doc_id, string_agg(lines[line.number + 1], chr(10) ORDER BY line.number) AS body
  FROM line JOIN doc USING (doc_id) ANTI JOIN gone ON line.doc_id = gone.doc_id AND line.number = gone.number
  GROUP BY line.doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       CASE WHEN r.doc_id IS NULL THEN d.text ELSE coalesce(rest.body, '') END AS text
FROM doc d LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN rest ON d.doc_id = rest.doc_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"), TEMPLATES, ["doc_id"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
string AS (
  SELECT doc_id, unnest(range(0, len(x) // 2 - 99)) AS i,
         unnest(list_transform(range(0, len(x) // 2 - 99), lambda k: md5_number(substr(x, 2 * k + 1, 200)))) AS s
  FROM doc),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM string)
  WHERE nth > 1),
numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS INT) AS opens
    FROM later)),
span AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
gap AS (
  SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a0, a, b FROM span),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(x, 2 * a0 + 1, 2 * (a - a0)), '' ORDER BY run) AS head
  FROM gap JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(0, 256), lambda c: list_reduce(list_prepend(c, range(0, 8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
seen AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS mark, run, count(*) AS n FROM run GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(mark)) AS x FROM seen),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
                    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc),
vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
marked AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS g FROM place),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM place),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM marked a JOIN marked b ON a.g = b.g AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN vocabulary v ON v.word = c.g
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN vocabulary v ON v.word = c.g),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS near_n, min(near) FILTER (WHERE nth = 1) AS near FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS nth FROM pair) GROUP BY word),
form AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
         CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
walk AS (
  WITH RECURSIVE step AS (
    SELECT word, word AS spot, form AS next FROM form
    UNION ALL SELECT s.word, f.word, f.form FROM step s JOIN form f ON f.word = s.next)
  SELECT word, spot AS root FROM step WHERE next IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM form JOIN walk USING (word)
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.conversation_repairs(_table(spark, sf_dir, "conversations"))


_CRC_TABLE = """crc AS (
  SELECT list_transform(range(0, 256), lambda c: list_reduce(list_prepend(c, range(0, 8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""
# The states START, SYSTEM, USER and ASSISTANT are 0 to 3; g0 to g3 are the costs still to pay.
OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
coded AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
marked AS (
  SELECT cid, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS fault FROM coded, crc),
damaged AS (
  SELECT cid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (
  SELECT cid, i, turn, role, text, left(role, 1) AS t, bare = '' AS blank, bare <> '' AND nth > 1 AS again, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) AS before FROM placed),
counts AS (
  SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || t NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY cid),
backward AS (
  SELECT cid, n + 1 AS i, 0 AS g0, 10 AS g1, 5 AS g2, 0 AS g3 FROM counts
  UNION ALL
  SELECT cid, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT j.cid, j.i,
           CASE WHEN blank OR again THEN 2 + g0 ELSE least(2 + g0, 1 + e + g2, CASE t WHEN 's' THEN e + g1 WHEN 'u' THEN e + g2 ELSE 1 + e + g2 END) END AS b0,
           CASE WHEN blank OR again THEN 2 + g1 ELSE least(2 + g1, 1 + e + g2, CASE t WHEN 'u' THEN e + g2 ELSE 1 + e + g2 END) END AS b1,
           CASE WHEN blank OR again THEN 2 + g2 ELSE least(2 + g2, 1 + e + g3, CASE t WHEN 'a' THEN e + g3 ELSE 1 + e + g3 END) END AS b2,
           CASE WHEN blank OR again THEN 2 + g3 ELSE least(2 + g3, 1 + e + g2, CASE t WHEN 'u' THEN e + g2 ELSE 1 + e + g2 END) END AS b3
    FROM backward b JOIN (SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS e FROM judged) j ON j.cid = b.cid AND j.i = b.i - 1)),
walk AS (
  SELECT cid, n, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS body FROM counts
  UNION ALL
  SELECT cid, n, CASE WHEN edit = 'I' THEN i ELSE i + 1 END AS i,
         CASE WHEN edit = 'D' THEN s WHEN edit = 'K' AND t = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END AS s, audit || edit AS audit,
         CASE edit WHEN 'D' THEN body WHEN 'K' THEN list_append(body, role || ':' || text) ELSE list_append(body, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END AS body
  FROM (
    SELECT w.*, j.role, j.text, j.t,
           CASE WHEN w.i > n OR [h.g0, h.g1, h.g2, h.g3][s + 1] <> 2 + [k.g0, k.g1, k.g2, k.g3][s + 1] THEN
             CASE WHEN w.i > n OR [h.g0, h.g1, h.g2, h.g3][s + 1] = 5 + [h.g2, h.g2, h.g3, h.g2][s + 1] THEN 'I'
                  WHEN (t = 's' AND s = 0 OR t = CASE s WHEN 2 THEN 'a' ELSE 'u' END)
                       AND [h.g0, h.g1, h.g2, h.g3][s + 1] = CASE WHEN cut THEN 5 ELSE 0 END + CASE WHEN t = 's' THEN k.g1 WHEN t = 'a' THEN k.g3 ELSE k.g2 END THEN 'K'
                  ELSE 'R' END
           ELSE 'D' END AS edit
    FROM walk w JOIN backward h ON h.cid = w.cid AND h.i = w.i LEFT JOIN backward k ON k.cid = w.cid AND k.i = w.i + 1 LEFT JOIN judged j ON j.cid = w.cid AND j.i = w.i
    WHERE w.i <= n OR s IN (1, 2))),
last AS (SELECT cid, audit, array_to_string(body, chr(10)) AS body FROM walk WHERE i > n AND s IN (0, 3))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(g0, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.cid = coalesce(CAST(c.conv_id AS VARCHAR), ' ')
LEFT JOIN last l ON l.cid = n.cid LEFT JOIN backward b ON b.cid = n.cid AND b.i = 1
"""


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i,
         unnest(list_transform(range(1, len(w) - 18), lambda k: md5_number(array_to_string(list_slice(w, k, k + 19), ' ')))) AS s
  FROM doc),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(range(0, 20)) AS t(k)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM doc),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_decontamination": op2_decontamination,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_simhash": op6_simhash,
        "op7_quality_rules": op7_quality_rules,
        "op8_html_text": op8_html_text,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_language_id": op10_language_id,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_turn_repair": op12_turn_repair,
        "op13_passage_dedup": op13_passage_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_decontamination": OP2_SQL, "op4_line_dedup": OP4_SQL, "op9_suffix_dedup": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_passage_dedup": OP13_SQL}
