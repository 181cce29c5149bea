"""DuckDB SQL that defines the result of each registered query.

The statements follow the definitions (sort all suffixes, compare them with all
base suffixes) and share nothing with the Spark plans.
"""

from __future__ import annotations

from .operators.base_index import BLOCK
from .queries import PREFIX, RECORD_PIECE

COLLECTIONS = {
    "benchmark": "SELECT item_id AS doc, text AS t FROM benchmark",
    "part": "SELECT p_partkey AS doc, p_name AS t FROM part",
    "customer": "SELECT c_custkey AS doc, c_name AS t FROM customer",
    "supplier": "SELECT s_suppkey AS doc, s_name AS t FROM supplier",
    "nation": "SELECT n_nationkey::BIGINT AS doc, n_name AS t FROM nation",
    "events": "SELECT event_id AS doc, props AS t FROM events",
    "conversations": "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc, text AS t FROM conversations",
    "pages": "SELECT page_id AS doc, html AS t FROM pages",
    "documents": "SELECT doc_id AS doc, text AS t FROM documents",
    # the names of each nation's customers as one record
    "records": "SELECT row_number() OVER (ORDER BY c_nationkey) AS doc, string_agg(c_name, '' ORDER BY c_custkey) AS t "
               "FROM customer GROUP BY c_nationkey",
}


def sorted_suffixes(docs: str = "docs") -> str:
    """All suffixes of ``docs (doc, t)`` with their place and preceding symbol."""
    return f"""
      SELECT CAST(row_number() OVER (ORDER BY substr(t, i), doc) - 1 AS BIGINT) AS bwt_idx,
             doc, CAST(i - 1 AS BIGINT) AS off,
             CASE WHEN i = 1 THEN chr(2) ELSE substr(t, i - 1, 1) END AS ch
      FROM (SELECT doc, t, unnest(generate_series(1, length(t) + 1)) AS i FROM {docs})"""


RUNS = """
      SELECT CAST(row_number() OVER (ORDER BY min(bwt_idx)) - 1 AS BIGINT) AS run_id, ch,
             CAST(count(*) AS BIGINT) AS run_len
      FROM (SELECT *, sum(starts) OVER (ORDER BY bwt_idx ROWS UNBOUNDED PRECEDING) AS grp
            FROM (SELECT *, CASE WHEN ch = lag(ch) OVER (ORDER BY bwt_idx) THEN 0 ELSE 1 END AS starts FROM sorted))
      GROUP BY grp, ch"""


def bwt_sql(name: str) -> str:
    return f"WITH docs AS ({COLLECTIONS[name]}), sorted AS ({sorted_suffixes()}) SELECT bwt_idx, ch FROM sorted"


def rl_bwt_sql(name: str) -> str:
    return f"WITH docs AS ({COLLECTIONS[name]}), sorted AS ({sorted_suffixes()}) {RUNS}"


def doubled_suffixes(name: str, first: int = 32, top: int = 1 << 18) -> str:
    """CTEs ending in ``sorted``, for texts too long to sort whole suffixes: ranks by
    the first symbols, then by ranks of suffixes that start twice as far away."""
    sql = f"""WITH docs AS ({COLLECTIONS[name]}),
    r0 AS MATERIALIZED (SELECT doc, off, rank() OVER (ORDER BY k, tie) AS r FROM (
      SELECT doc, i AS off, substr(t, i + 1, {first}) AS k, CASE WHEN length(t) - i < {first} THEN doc ELSE -1 END AS tie
      FROM (SELECT doc, t, unnest(generate_series(0, length(t))) AS i FROM docs)))"""
    done, n = first, 0
    while done < top:
        sql += f""",
    r{n + 1} AS MATERIALIZED (SELECT doc, off, rank() OVER (ORDER BY r, nx) AS r FROM (
      SELECT doc, off, r, lead(r, {done}, 0) OVER (PARTITION BY doc ORDER BY off) AS nx FROM r{n}))"""
        done, n = done * 2, n + 1
    return sql + f""",
    sorted AS (SELECT r - 1 AS bwt_idx, CASE WHEN off = 0 THEN chr(2) ELSE c END AS ch
      FROM r{n} LEFT JOIN (SELECT doc, i AS off, l[i] AS c FROM (SELECT doc, l, unnest(generate_series(1, len(l))) AS i
        FROM (SELECT doc, string_split(t, '') AS l FROM docs WHERE t <> ''))) USING (doc, off))"""


def common_prefix(source: str, a: str, b: str, out: str, top: int = 1 << 20) -> str:
    """Add ``out`` = length of the common prefix of the strings ``a`` and ``b``."""
    sql, step = f"SELECT *, 0::BIGINT AS {out} FROM ({source})", top
    while step:
        sql = (f"SELECT * REPLACE ({out} + CASE WHEN length({a}) >= {out} + {step} AND length({b}) >= {out} + {step}"
               f" AND substr({a}, {out} + 1, {step}) = substr({b}, {out} + 1, {step}) THEN {step} ELSE 0 END AS {out})"
               f" FROM ({sql})")
        step //= 2
    return sql


def augmented(base: str) -> str:
    """CTE ``x``: the base text, the symbols it lacks, and the end symbol."""
    return f"""
    base AS ({base}),
    syms AS (SELECT chr(i::INTEGER) AS c FROM range(3, 128) r(i)
             UNION SELECT unnest(string_split(t, '')) FROM docs WHERE t <> ''),
    have AS (SELECT DISTINCT unnest(string_split(b, '')) AS c FROM base),
    x AS (SELECT b || coalesce((SELECT string_agg(c, '' ORDER BY unicode(c)) FROM syms
                                WHERE c NOT IN (SELECT c FROM have)), '') || chr(1) AS x FROM base),
    rs AS (SELECT pos, substr(x, pos + 1) AS s FROM (SELECT x, unnest(generate_series(0, length(x))) AS pos FROM x)),
    ri AS (SELECT pos, s, CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS isa FROM rs)"""


# --- base index: all texts of benchmark, joined -------------------------------

INDEX = f"""WITH docs AS ({COLLECTIONS['benchmark']}),
    {augmented("SELECT string_agg(t, '' ORDER BY doc) AS b FROM docs")}"""
LCP = INDEX + f""",
    pairs AS (SELECT pos, isa, s, coalesce(lag(s) OVER (ORDER BY isa), '') AS p FROM ri),
    la AS MATERIALIZED (SELECT pos, isa, lcp FROM ({common_prefix('SELECT * FROM pairs', 's', 'p', 'lcp', 1 << 17)})),
    uniq AS MATERIALIZED (SELECT pos, isa, lcp,
        greatest(lcp, coalesce(lead(lcp) OVER (ORDER BY isa), -1)) AS uniq_len FROM la)"""


def nearest(at: str, bound: str, source: str) -> str:
    """Add psv / nsv over ``la`` to the probes in ``source``."""
    return f"""
      SELECT p.*, (SELECT max(q.isa) FROM la q WHERE q.isa <= p.{at} AND q.lcp < p.{bound}) AS psv,
             (SELECT min(q.isa) FROM la q WHERE q.isa >= p.{at} AND q.lcp < p.{bound}) AS nsv
      FROM ({source}) p"""


# The widest interval around suffix `probe` that shares `len` symbols.
def interval(source: str) -> str:
    return f"""
      SELECT p.isa, p.len,
             coalesce((SELECT max(q.isa) FROM la q WHERE q.isa <= p.probe AND q.lcp < p.len), 0) AS lo,
             coalesce((SELECT min(q.isa) FROM la q WHERE q.isa >= p.probe + 1 AND q.lcp < p.len) - 1,
                      (SELECT max(isa) FROM la)) AS hi
      FROM ({source}) p"""


INDEX_SQL = {
    "suffix_array": INDEX + " SELECT isa AS sa_idx, pos FROM ri",
    "inverse_suffix_array": INDEX + " SELECT pos, isa FROM ri",
    "ref_bwt": INDEX + """ SELECT isa, CAST(CASE WHEN pos = 0 THEN 0 ELSE unicode(substr(x, pos, 1)) END AS BIGINT) AS code
                           FROM ri, x""",
    "lcp_array": LCP + " SELECT isa, lcp FROM la",
    "uniq_threshold": LCP + " SELECT pos, uniq_len FROM uniq",
    "range_min": LCP + " SELECT isa // 128 AS block, min(lcp) AS min_lcp FROM la GROUP BY 1",
    "prev_smaller_value": LCP + f""" SELECT isa, lcp, coalesce(psv, -1) AS psv
        FROM ({nearest('isa', 'lcp', 'SELECT isa, lcp FROM la')})""",
    "next_smaller_value": LCP + f""" SELECT isa, lcp, coalesce(nsv, -1) AS nsv
        FROM ({nearest('isa', 'lcp', 'SELECT isa, lcp FROM la')})""",
    "lcp_interval": LCP + interval("SELECT isa, uniq_len AS len, isa AS probe FROM uniq"),
    "contract_left": LCP + interval("""SELECT u.isa, u.uniq_len - 1 AS len, v.isa AS probe
        FROM uniq u JOIN uniq v ON v.pos = u.pos + 1 WHERE u.uniq_len > 0"""),
}


# --- matching statistics and heads ---------------------------------------------

def matched(name: str) -> str:
    """CTEs up to ``m`` (matches), ``h`` (heads) and ``ord`` (true suffix order)."""
    nearest_base = """
      SELECT doc, off, s, np, pp, coalesce(ns, '') AS ns, coalesce(ps, '') AS ps FROM (
        SELECT *, first_value(pos IGNORE NULLS) OVER fol AS np, first_value(r IGNORE NULLS) OVER fol AS ns,
               last_value(pos IGNORE NULLS) OVER pre AS pp, last_value(r IGNORE NULLS) OVER pre AS ps
        FROM (SELECT NULL::BIGINT AS doc, NULL::BIGINT AS off, pos, s, s AS r FROM rs
              UNION ALL SELECT doc, off, NULL, substr(t, off + 1) || chr(2), NULL
              FROM (SELECT doc, t, unnest(generate_series(0, length(t) - 1)) AS off FROM docs))
        WINDOW fol AS (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
               pre AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WHERE doc IS NOT NULL"""
    both = common_prefix(common_prefix(nearest_base, "s", "ns", "ln", 4096), "s", "ps", "lp", 4096)
    return f"""WITH docs AS ({COLLECTIONS[name]}),
    {augmented("SELECT t AS b FROM docs ORDER BY doc LIMIT 1")},
    m0 AS (SELECT doc, off, CASE WHEN np IS NOT NULL AND ln >= lp THEN np ELSE pp END AS pos,
                  greatest(ln, lp) AS len, (np IS NOT NULL AND ln >= lp) AS smaller FROM ({both})),
    m AS MATERIALIZED (SELECT *, coalesce(pos <> lag(pos) OVER (PARTITION BY doc ORDER BY off) + 1, true) AS is_head
                       FROM m0),
    last_pos AS (SELECT max(pos) AS sep FROM rs),
    hs AS (SELECT doc, off AS start, pos, len, smaller FROM m WHERE is_head
           UNION ALL SELECT doc, length(t), sep, 0, false FROM docs, last_pos),
    h1 AS (SELECT *, CAST(row_number() OVER (ORDER BY doc, start) - 1 AS BIGINT) AS head_id,
                  coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start) - start - 1, 0) AS run_len FROM hs),
    h2 AS (SELECT a.*, CASE WHEN a.len = 0 THEN a.head_id ELSE
                  (SELECT min(b.head_id) FROM h1 b WHERE b.doc = a.doc AND b.head_id > a.head_id
                          AND (b.len = 0 OR b.start + b.len > a.start + a.len)) END AS next_head_id FROM h1 a),
    h AS MATERIALIZED (
      SELECT h2.*, r.isa AS isa_pos, rn.isa AS isa_next,
             CASE WHEN h2.smaller THEN 0 ELSE 1 END::BIGINT AS above,
             CASE WHEN h2.smaller THEN h2.len ELSE -h2.len END AS reach,
             CASE WHEN h2.start = 0 THEN chr(2) ELSE substr(t, h2.start, 1) END AS prev_ch
      FROM h2 JOIN h1 n ON n.head_id = h2.next_head_id JOIN ri r ON r.pos = h2.pos
           JOIN ri rn ON rn.pos = n.pos + h2.start + h2.len - n.start JOIN docs ON docs.doc = h2.doc),
    sorted AS MATERIALIZED ({sorted_suffixes()}),
    hr AS MATERIALIZED (SELECT h.*, bwt_idx, CAST(row_number() OVER (ORDER BY bwt_idx) - 1 AS BIGINT) AS head_rank
           FROM h JOIN sorted ON sorted.doc = h.doc AND sorted.off = h.start),
    allpos AS (SELECT doc, off, pos, is_head FROM m UNION ALL SELECT doc, length(t), sep, true FROM docs, last_pos)"""


def head_queries(name: str) -> dict[str, str]:
    cte = matched(name)
    return {
        "matching_statistics": cte + " SELECT doc AS doc_ord, off, pos, len, smaller, is_head FROM m",
        "insert_heads": cte + " SELECT head_id, doc AS doc_ord, start, pos, len, smaller, run_len, prev_ch FROM h",
        "next_head": cte + " SELECT head_id, next_head_id, isa_next FROM h",
        "next_rank": cte + """ SELECT a.head_id, a.next_head_id, b.head_rank AS next_rank
                               FROM hr a JOIN hr b ON b.head_id = a.next_head_id""",
        "head_rank": cte + " SELECT doc AS doc_ord, start, head_rank, prev_ch FROM hr",
        "head_groups": cte + """ SELECT pos, len, isa_next, first(smaller) AS smaller, first(run_len) AS run_len,
                                 count(*) AS n_heads FROM h GROUP BY pos, len, isa_next""",
        "group_offsets": cte + """ SELECT *, CAST(sum(n_heads) OVER (ORDER BY pos, above, reach, isa_next) - n_heads AS BIGINT)
            AS first_slot FROM (SELECT pos, above, reach, isa_next, count(*) AS n_heads FROM h GROUP BY ALL)""",
        "head_order": cte + """ SELECT *, CAST(row_number() OVER (ORDER BY isa_pos, above, reach, isa_next) - 1 AS BIGINT)
            AS place FROM (SELECT DISTINCT isa_pos, above, reach, isa_next FROM h)""",
        "head_class_rank": cte + """ SELECT doc AS doc_ord, start, CAST(dense_rank() OVER (ORDER BY isa_pos, above, reach,
            isa_next, CASE WHEN len = 0 THEN doc ELSE -1 END) - 1 AS BIGINT) AS class_rank FROM h""",
        "run_stats": cte + f""" SELECT * FROM (SELECT count(*) AS n_heads,
              count(DISTINCT (pos, len, isa_next)) AS n_groups, count(DISTINCT pos) AS n_head_buckets,
              CAST(count(*) FILTER (len = 0) AS BIGINT) AS n_docs, max(len) AS max_len FROM h),
            (SELECT count(*) AS n_symbols FROM sorted), (SELECT count(*) AS n_runs FROM ({RUNS}))""",
        "bucket_counts": cte + " SELECT pos, count(*) AS cnt, bool_or(is_head) AS has_head FROM allpos GROUP BY pos",
        "expand_nonheads": cte + """ SELECT m.pos, above, CASE WHEN h.smaller THEN h.len - (m.off - h.start)
              ELSE (m.off - h.start) - h.len END AS reach, isa_next, count(*) AS cnt
            FROM m JOIN h ON h.doc = m.doc AND m.off > h.start AND m.off <= h.start + h.run_len
            WHERE m.pos IN (SELECT pos FROM h) GROUP BY 1, 2, 3, 4""",
        "gap_before_head": cte + """ SELECT head_rank, CAST(bwt_idx - coalesce(
              lag(bwt_idx) OVER (PARTITION BY pos ORDER BY bwt_idx) + 1,
              first_idx) AS BIGINT) AS gap
            FROM hr JOIN (SELECT pos, min(bwt_idx) AS first_idx FROM allpos JOIN sorted USING (doc, off) GROUP BY pos)
                 USING (pos)""",
        "bwt_heads": bwt_sql(name),
        "rl_bwt_heads": rl_bwt_sql(name),
    }


# --- sources ---------------------------------------------------------------------

def scanned(name: str) -> str:
    return f"""WITH docs AS ({COLLECTIONS[name]}),
    lines AS (SELECT doc, 0 AS k, '>' || doc::VARCHAR AS line FROM docs
              UNION ALL SELECT doc, i AS k, l[i] AS line FROM
                (SELECT doc, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc, string_split(t, chr(10)) AS l FROM docs))),
    marked AS (SELECT *, CASE WHEN line = '' OR line[1] = '>' THEN 1 ELSE 0 END AS is_break FROM lines)"""


def limited(name: str, limit: int) -> str:
    return f"""WITH whole AS ({COLLECTIONS[name]}),
    placed AS (SELECT doc, t, CAST(sum(length(t) + 1) OVER (ORDER BY doc) - length(t) - 1 AS BIGINT) AS t_start FROM whole),
    docs AS (SELECT doc, substr(t, 1, {limit} - 1 - t_start) AS t FROM placed
      WHERE t_start < {limit} - 1 OR (t_start = {limit} - 1 AND t = ''))"""


SOURCE_SQL = {
    "ref_scan": scanned("benchmark") + f""" SELECT CAST(block AS BIGINT) AS block, CAST(length(part) AS BIGINT) AS n_chars, part AS text
        FROM (SELECT block, substr(text, block * {BLOCK} + 1, {BLOCK}) AS part
              FROM (SELECT text, unnest(generate_series(0, (length(text) - 1) // {BLOCK})) AS block FROM (
        SELECT regexp_replace(regexp_replace(string_agg(line, '' ORDER BY doc, k), '[\\n\\r]$', ''), '[$]$', '') AS text
        FROM marked WHERE is_break = 0)))""",
    "plain_scan": f"""WITH docs AS ({COLLECTIONS['part']}), whole AS (SELECT string_agg(t, chr(10) ORDER BY doc) AS text FROM docs)
        SELECT CAST(block AS BIGINT) AS block, CAST(length(part) AS BIGINT) AS n_chars, part AS text
        FROM (SELECT block, substr(text, block * {BLOCK} + 1, {BLOCK}) AS part
              FROM (SELECT text, unnest(generate_series(0, (length(text) - 1) // {BLOCK})) AS block FROM whole))""",
    "collection_scan": scanned("documents") + """,
        numbered AS (SELECT *, CAST(sum(is_break) OVER (ORDER BY doc, k) - is_break AS BIGINT) AS doc_ord FROM marked),
        texts AS (SELECT doc_ord, max(is_break) AS closed,
                         coalesce(string_agg(line, '' ORDER BY doc, k) FILTER (is_break = 0), '') AS text
                  FROM numbered GROUP BY doc_ord)
        SELECT doc_ord, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5
        FROM texts WHERE closed = 1 OR text <> ''""",
    "pieces_scan": f"""WITH docs AS ({COLLECTIONS['records']}) SELECT doc AS doc_ord, start, substr(t, start + 1, {RECORD_PIECE}) AS text
        FROM (SELECT doc, t, unnest(generate_series(0, length(t) - 1, {RECORD_PIECE})) AS start FROM docs)""",
    "prefix_limit": limited("documents", PREFIX) +
        " SELECT doc AS doc_ord, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM docs",
    "alphabet_augment": """SELECT CAST(code AS BIGINT) AS code FROM (
        SELECT i AS code FROM range(3, 128) r(i)
        UNION SELECT unicode(c) FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''))
      WHERE code NOT IN (SELECT unicode(c) FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark WHERE text <> ''))""",
}


def oracles() -> dict[str, str]:
    out = {
        "bwt": bwt_sql("benchmark"),
        "rl_bwt": rl_bwt_sql("benchmark"),
        "suffix_order": f"WITH docs AS ({COLLECTIONS['benchmark']}), sorted AS ({sorted_suffixes()}) "
                        "SELECT bwt_idx, doc AS doc_ord, off, ch FROM sorted",
        "rl_bwt_conversations": rl_bwt_sql("conversations"),
        "rl_bwt_pages": doubled_suffixes("pages") + RUNS,
        "rl_bwt_documents": doubled_suffixes("documents") + RUNS,
        "bwt_planned": bwt_sql("supplier"),
        "bwt_planned_conversations": bwt_sql("conversations"),
        "bwt_prefix": limited("events", 50_000) + f", sorted AS ({sorted_suffixes()}) SELECT bwt_idx, ch FROM sorted",
        "bwt_heads_events": bwt_sql("events"),
        # the header that opens the first file closes an empty document
        "bwt_job": f"WITH docs AS (SELECT -1 AS doc, '' AS t UNION ALL {COLLECTIONS['customer']}), "
                   f"sorted AS ({sorted_suffixes()}) SELECT bwt_idx, ch FROM sorted",
        "bwt_pieces": bwt_sql("records"),
        "rl_bwt_heads_pieces": rl_bwt_sql("records"),
        "bwt_part_files": bwt_sql("supplier"),
        "rl_bwt_part_files": rl_bwt_sql("supplier"),
    }
    benchmark = head_queries("benchmark")
    out["matching_statistics_joint"], out["insert_heads_joint"] = benchmark["matching_statistics"], benchmark["insert_heads"]
    out["matching_statistics_pieces"] = head_queries("records")["matching_statistics"]
    out["matching_statistics_conversations"] = head_queries("conversations")["matching_statistics"]
    out["rl_bwt_heads_conversations"] = rl_bwt_sql("conversations")
    for name in ("part", "customer", "nation", "events", "conversations"):
        out[f"bwt_{name}"] = bwt_sql(name)
    out |= SOURCE_SQL | INDEX_SQL | head_queries("benchmark")
    customer = head_queries("customer")
    for q in ("matching_statistics", "insert_heads", "bucket_counts", "expand_nonheads", "gap_before_head", "bwt_heads",
              "next_head", "next_rank", "head_rank", "head_groups", "group_offsets", "head_order", "head_class_rank",
              "run_stats"):
        out[f"{q}_customer"] = customer[q]
    return out
