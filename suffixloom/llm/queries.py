"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .alignment import align
from .common import SPACE_RUN, table
from .decontaminate import decontaminate
from . import quality as rules
from .licence_texts import LICENCES, NOTICES, SPELLINGS
from .licences import COPYRIGHT_LINE, NOT_WORD, licence_scan
from .line_dedup import line_dedup
from .main_text import main_text
from .ngram_join import ngram_join
from .pieces import sentencepiece
from .quality import quality
from .resampling import resample
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import is_held_out, toxicity, train
from .url_filter import url_filter

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, keep=["doc_id"]).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op4_sentencepiece(spark, sf_dir):
    encoded = sentencepiece(table(spark, sf_dir, "documents"), PIECE_MODEL,
                            ("n_tokens", "ids_text", "spans_sha256", "decoded"), keep=["doc_id"])
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), "spans_sha256",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_licence_scan(spark, sf_dir):
    return licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "canonical_sha256", "license", F.array_join("notices", ",").alias("notices"))


def op6_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op9_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("repeats"))


def op11_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op12_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL, keep=["doc_id"], digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_group_links")


def op13_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "repeats")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_main_text": op3_main_text,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_licence_scan": op5_licence_scan,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_resampling": op11_resampling,
    "op12_alignment": op12_alignment,
    "op13_substring_dedup": op13_substring_dedup,
}

LINE_KEYS = r"""translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _taken(line: str, pattern: str) -> str:
    return f"(length({line}) - length(regexp_replace({line}, {_quoted(pattern)}, '', 'g')))"


LINE_FAILS = f"""(NOT regexp_matches(l, {_quoted(rules.SENTENCE_END)})
 OR (regexp_matches(l, {_quoted(rules.MENU)}) AND {_taken('l', rules.MENU_MARK)} * {rules.MENU_EVERY} >= 2 * length(l))
 OR 10 * (length(l) - length(regexp_replace(l, '{rules.SYMBOLS}', '', 'g'))) > length(l)
 OR (regexp_matches(l, '{rules.SHOUT_MARKS}') AND {_taken('l', rules.SHOUT_MARK)} * {rules.SHOUT_EVERY} >= 2 * length(l))
 OR (NOT regexp_matches(l, '{rules.SMALL_LETTER}') AND regexp_matches(l, '{rules.CAPITAL}')
     AND length(l) >= {rules.SHOUT_LENGTH})
 OR (regexp_matches(lower(l), '{rules.BOILERPLATE}')
     AND {_taken('lower(l)', rules.BOILERPLATE)} * 100 > {rules.NOTICE_PERCENT} * length(lower(l))))"""


def _canonical(text: str) -> str:
    out = f"' ' || regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', ' ', 'g'), '{NOT_WORD}', ' ', 'g') || ' '"
    for found, meant in SPELLINGS:
        out = f"replace({out}, ' {found} ', ' {meant} ')"
    return f"trim({out})"


def _known(texts) -> str:
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in texts)
    return f"SELECT {_canonical('t')} AS c, min(license) AS license FROM (VALUES {rows}) v(license, t) GROUP BY c"


# CRC-32 from its definition: the table follows from the polynomial, a word is folded byte by byte.
CRC_TABLE = """SELECT list_transform(generate_series(0, 255), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, octet_length(encode(f))),
  lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"""


def _feature_words(text: str) -> str:
    small = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({small}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLES = {
    "op2_ngram_join": f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(coalesce(text, ''), '{rules.HAS_WORD}+') AS w FROM documents),
sh AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE
   WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs)),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_have AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT x, y FROM both_have JOIN sizes s ON s.r = x JOIN sizes t ON t.r = y
  WHERE 10 * c >= 8 * (s.n + t.n - c)),
reach AS (SELECT r, r AS m FROM docs UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.m),
classes AS (SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN docs d ON d.r = reach.m GROUP BY reach.r),
degrees AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM docs JOIN classes USING (r) LEFT JOIN degrees USING (r)""",
    "op5_licence_scan": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
entire AS ({_known(LICENCES + NOTICES)}), single AS ({_known(NOTICES)}),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
noticed AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM lines JOIN single ON {_canonical('l')} = c GROUP BY r)
SELECT doc_id, sha256({_canonical('text')}) AS canonical_sha256, license, coalesce(notices, '') AS notices
FROM docs LEFT JOIN entire ON {_canonical('text')} = c LEFT JOIN noticed USING (r)""",
    "op7_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, doc_id, text, regexp_extract_all(text, '{rules.HAS_WORD}+') AS w FROM docs),
words AS (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM parts),
wins AS (SELECT r, i, x AS a, lead(x) OVER p AS b, lead(x, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
twins AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM wins WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twins) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
judged AS (SELECT r, l, {LINE_FAILS} AS fails,
  length(regexp_replace(l, '{SPACE_RUN}', '', 'g')) AS chars FROM lines WHERE regexp_matches(l, '{rules.HAS_WORD}')),
sums AS (SELECT r, count(*) - count(DISTINCT l) AS dups, sum(chars) FILTER (fails) AS lost FROM judged GROUP BY r),
figures AS (SELECT doc_id, len(w)::BIGINT AS n_words,
  length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '{rules.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM parts LEFT JOIN sums USING (r) LEFT JOIN covered USING (r)),
verdict AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND 100 * lost <= {rules.MAX_LOSS_PERCENT} * word_chars AS kept FROM verdict""",
    "op9_line_dedup": f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS i FROM split),
keyed AS (SELECT r, doc_id, i, l, {LINE_KEYS} AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.k)::BIGINT AS n_dropped,
 sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (bad.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad USING (k) GROUP BY r, doc_id""",
    "op11_resampling": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_feature_words('text')} AS w FROM documents),
own AS (SELECT r, unnest(w) AS f FROM docs), goal AS (SELECT unnest({_feature_words('text')}) AS f FROM benchmark),
crc AS ({CRC_TABLE}),
buckets AS MATERIALIZED (SELECT f, {CRC} % 10000 AS b FROM (SELECT f FROM own UNION SELECT f FROM goal), crc),
s AS (SELECT b, count(*) AS n FROM own JOIN buckets USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM goal JOIN buckets USING (f) GROUP BY b),
sums AS (SELECT (SELECT count(*) FROM own) AS s_all, (SELECT count(*) FROM goal) AS t_all),
gains AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE
   / ((s.n + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, s LEFT JOIN t USING (b)),
weights AS (SELECT r, sum(gain)::BIGINT AS total, count(*) AS n FROM own JOIN buckets USING (f) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features,
  coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
    AS noise FROM docs LEFT JOIN weights USING (r)),
drawn AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, (weight + noise)::BIGINT AS score,
 CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN drawn USING (r)""",
    "op13_substring_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{rules.HAS_WORD}+') AS w FROM documents),
wins AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS x
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM docs)),
several AS (SELECT x, min(doc_id) AS low FROM wins GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS k FROM wins JOIN several USING (x) WHERE low < doc_id),
lost AS (SELECT r, list(k) AS ks FROM gone GROUP BY r), twice AS (SELECT DISTINCT r FROM wins JOIN several USING (x))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
 sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)),
  lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END, ' ')) AS kept_sha256, twice.r IS NOT NULL AS repeats
FROM docs LEFT JOIN lost USING (r) LEFT JOIN twice USING (r)""",
}
