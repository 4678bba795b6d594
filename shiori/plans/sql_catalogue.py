"""DuckDB SQL of the catalogue's queries, over views named like the tables.

DuckDB has no compatibility normal form: where a query folds text, single characters are mapped by a
translate built from Python's character data and the result is composed. That equals NFKC for texts
without characters that expand to several. Fields of structs are taken out in materialised parts before
any filter.
"""

from __future__ import annotations

import unicodedata
from functools import cache

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_JA = r"\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_JB = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}"


@cache
def _compatible() -> tuple[str, str]:
    pairs = []
    for code in (*range(0xA0, 0x3400), *range(0xF900, 0xFFEF)):
        form = unicodedata.normalize("NFKC", chr(code))
        if len(form) == 1 and form != chr(code) and unicodedata.normalize("NFC", chr(code)) != form:
            pairs.append((chr(code), form))
    return "".join(a for a, _ in pairs).replace("'", "''"), "".join(b for _, b in pairs).replace("'", "''")


def composed(x: str) -> str:
    a, b = _compatible()
    return f"nfc_normalize(translate({x}, '{a}', '{b}'))"


def lowered(x: str) -> str:
    return f"lower({composed(x)})"


def folded(x: str) -> str:
    return f"replace({lowered(x)}, 'ß', 'ss')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '{_SPACE}', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def tokens_a(x: str) -> str:
    """Tokens of a folded text."""
    runs = rf"regexp_extract_all(regexp_replace({x}, '[^\p{{L}}\p{{N}}{_JA}]', ' ', 'g'), '[0-9a-zA-Z]+|[{_JA}]+|[^ 0-9a-zA-Z{_JA}]+')"
    gram = lambda n: f"list_transform(range(1, length(r) - {n - 2}), lambda k: 'j{n}:' || substring(r, k, {n}))"
    return f"""flatten(list_transform({runs}, lambda r: CASE WHEN NOT regexp_matches(r, '^[{_JA}]') THEN ['w:' || r]
  WHEN length(r) = 1 THEN ['j1:' || r] WHEN length(r) = 2 THEN {gram(2)} ELSE list_concat({gram(2)}, {gram(3)}) END))"""


def tokens_b(x: str) -> str:
    """Tokens of a lowered text."""
    runs = f"regexp_extract_all({x}, '[{_JB}]+')"
    return rf"list_concat(regexp_extract_all({x}, '[0-9A-Za-z_][0-9A-Za-z_.\-]*'), flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda k: substring(r, k, 2)) END)))"


def values_of(x: str) -> str:
    lines = f"list_filter(string_split_regex({x}, '{_BREAK}'), lambda l: contains(l, ':'))"
    return f"list_filter(list_transform({lines}, lambda l: {strip('substring(l, instr(l, chr(58)) + 1)')}), lambda v: v <> '')"


_UNITS = "units AS MATERIALIZED (SELECT DISTINCT unit_seq, search_unit_id, document_id, unit_type, text.search_text AS search_text, source_evidence_ids FROM search_units WHERE search_unit_id IS NOT NULL)"

_INDEX = f"""{_UNITS},
postings_a AS MATERIALIZED (SELECT unit_seq, term, count(*) AS tf FROM (SELECT unit_seq, unnest({tokens_a("f")}) AS term FROM (SELECT unit_seq, {folded("search_text")} AS f FROM units)) GROUP BY ALL),
lengths AS MATERIALIZED (SELECT unit_seq, CAST(sum(tf) AS BIGINT) AS dl FROM postings_a GROUP BY unit_seq),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
known AS MATERIALIZED (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM postings_a GROUP BY term), size)"""

_LINE = strip("l")
_VALUE = f"CASE WHEN contains(l, ':') THEN {strip('substring(l, instr(l, chr(58)) + 1)')} ELSE l END"
_EVERY_20TH = "SELECT * FROM asked WHERE query <> '' AND unit_seq % 20 = 0"
_SAMPLE = "SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (PARTITION BY unit_type ORDER BY unit_seq) AS turn FROM asked WHERE query <> '') ORDER BY turn, unit_type LIMIT 100"
_ASKED = f"""asked AS (
  SELECT *, {strip(f"substring(CASE WHEN unit_type = 'table_row' THEN array_to_string(list_slice(vals, 1, 4), ' ') ELSE {collapse('search_text')} END, 1, 80)")} AS query
  FROM (SELECT *, list_filter(raw, lambda v, i: v <> '' AND list_position(raw, v) = i) AS vals FROM (
    SELECT *, list_transform(list_filter(list_transform(string_split_regex(search_text, '{_BREAK}'), lambda l: {_LINE}), lambda l: l <> ''), lambda l: {_VALUE}) AS raw FROM units))
),
chosen AS (CHOSEN),
cases AS MATERIALIZED (
  SELECT 'qe_' || substring(sha256('{{"generator":"self-retrieval-eval-builder","generator_version":"0.1.0","method":"self_retrieval","query":' || CAST(to_json(query) AS VARCHAR) || ',"relevant_search_unit_ids":["' || search_unit_id || '"]}}'), 1, 32) AS query_id,
    query, {folded("query")} AS f, search_unit_id AS relevant_id, unit_type AS category, unit_seq FROM chosen
),
terms_of AS MATERIALIZED (SELECT query_id, unnest(list_distinct(toks)) AS term, len(list_distinct(toks)) AS n_terms FROM (SELECT query_id, {tokens_a("f")} AS toks FROM cases)),
scored AS MATERIALIZED (
  SELECT query_id, unit_seq, sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS lexical, count(*) AS matched, any_value(n_terms) AS n_terms
  FROM postings_a JOIN terms_of USING (term) JOIN known USING (term) JOIN lengths USING (unit_seq), size GROUP BY query_id, unit_seq
)"""

_CASES = _ASKED.replace("CHOSEN", _EVERY_20TH)


def _rerank(k: int) -> str:
    """Hits with rank up to k, out of a pool of max(50, 5 * k)."""
    return f"""pool AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 8) DESC, unit_seq) AS r FROM scored)
  JOIN units USING (unit_seq) JOIN (SELECT query_id, f FROM cases) USING (query_id) WHERE r <= {max(50, 5 * k)}
),
vals AS MATERIALIZED (
  SELECT query_id, unit_seq, v, {folded("v")} AS fv, {bare("f")} AS fq FROM (SELECT query_id, unit_seq, f, unnest(list_distinct({values_of("search_text")})) AS v FROM pool)
),
named AS MATERIALIZED (SELECT query_id, unit_seq, v, fv FROM (SELECT *, {bare("fv")} AS bv FROM vals) WHERE length(bv) BETWEEN 2 AND 64 AND contains(fq, bv)),
counted AS (SELECT query_id, unit_seq, count(*) AS n_values FROM named GROUP BY ALL),
extra AS (
  SELECT query_id, unit_seq, 0.5 * sum(idf) AS bonus FROM (SELECT DISTINCT query_id, unit_seq, term FROM (SELECT query_id, unit_seq, unnest({tokens_a("fv")}) AS term FROM named))
  JOIN terms_of USING (query_id, term) JOIN known USING (term) GROUP BY query_id, unit_seq
),
parents AS (
  SELECT DISTINCT a.query_id, a.unit_seq FROM pool a JOIN (SELECT p.* FROM pool p JOIN counted USING (query_id, unit_seq)) b
  ON a.query_id = b.query_id AND a.document_id = b.document_id AND a.unit_seq <> b.unit_seq
  AND list_has_all(b.source_evidence_ids, a.source_evidence_ids) AND len(list_distinct(a.source_evidence_ids)) < len(list_distinct(b.source_evidence_ids))
),
final AS (
  SELECT p.*, coalesce(n_values, 0) AS n_values, coalesce(bonus, 0) AS bonus, CASE WHEN x.unit_seq IS NULL THEN 0.0 ELSE 2.0 END AS penalty,
    lexical + coalesce(bonus, 0) - CASE WHEN x.unit_seq IS NULL THEN 0.0 ELSE 2.0 END AS score
  FROM pool p LEFT JOIN counted c ON c.query_id = p.query_id AND c.unit_seq = p.unit_seq LEFT JOIN extra e ON e.query_id = p.query_id AND e.unit_seq = p.unit_seq
  LEFT JOIN parents x ON x.query_id = p.query_id AND x.unit_seq = p.unit_seq
),
hits AS MATERIALIZED (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, unit_seq) AS INTEGER) AS rank FROM final) WHERE rank <= {k}
)"""


_VECTORS = """vectors AS MATERIALIZED (
  SELECT unit_seq, search_unit_id, CAST(arg_min(matrix, row_no) AS DOUBLE[96]) AS v FROM semantic_index
  WHERE search_unit_id IS NOT NULL AND model = 'embedstub-96' AND len(matrix) = 96
    AND len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0
  GROUP BY unit_seq, search_unit_id
)"""


def _fusion(adaptive: bool) -> str:
    weight = "CASE WHEN coverage IS NULL OR (coverage < 0.25 AND margin < 1.4) THEN 1.0 ELSE 0.25 END" if adaptive else "0.25"
    return f"""WITH {_INDEX}, {_CASES}, {_rerank(50)}, {_VECTORS},
near AS (SELECT c.query_id, w.search_unit_id, w.unit_seq, array_cosine_similarity(q.v, w.v) AS s FROM cases c JOIN vectors q ON q.unit_seq = c.unit_seq, vectors w),
semantic AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, unit_seq) AS INTEGER) AS rank FROM near) WHERE rank <= 50),
sure AS (
  SELECT query_id, max(CASE WHEN rank = 1 THEN matched / greatest(n_terms, 1) END) AS coverage,
    max(CASE WHEN rank = 1 THEN round(score, 8) END) / greatest(max(CASE WHEN rank = 2 THEN round(score, 8) END), 1e-12) AS margin FROM hits GROUP BY query_id
),
weights AS (SELECT query_id, {weight} AS w FROM (SELECT DISTINCT query_id FROM cases) LEFT JOIN sure USING (query_id)),
merged AS (
  SELECT query_id, search_unit_id, min(l) AS lexical_rank, min(s) AS semantic_rank FROM (
    SELECT query_id, search_unit_id, rank AS l, CAST(NULL AS INTEGER) AS s FROM hits UNION ALL SELECT query_id, search_unit_id, NULL, rank FROM semantic) GROUP BY ALL
),
fused AS (SELECT *, CAST(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(CAST(w AS DOUBLE) / (60 + semantic_rank), 0) AS DOUBLE) AS score FROM merged JOIN weights USING (query_id))
SELECT query_id, rank, search_unit_id, round(score, 10) AS score, lexical_rank, semantic_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, search_unit_id) AS INTEGER) AS rank FROM fused) WHERE rank <= 10"""


_METRICS = ", ".join(f"round(avg(CASE WHEN hits_{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}, round(avg(hits_{k} / n_relevant), 6) AS recall_{k}" for k in (1, 3, 5, 10))
_OUTCOMES = f"""{_INDEX}, {_CASES}, {_rerank(10)},
outcomes AS (
  SELECT c.query_id, c.category, count(*) AS n_relevant, min(h.rank) AS first_rank, {", ".join(f"CAST(sum(CASE WHEN h.rank <= {k} THEN 1 ELSE 0 END) AS BIGINT) AS hits_{k}" for k in (1, 3, 5, 10))}
  FROM cases c LEFT JOIN hits h ON h.query_id = c.query_id AND h.search_unit_id = c.relevant_id GROUP BY c.query_id, c.category
)"""

_PIECES = f"""pieces AS MATERIALIZED (
  SELECT doc_id, project, file_name, CAST(start // 1200 AS INTEGER) AS piece_no, CAST(start AS INTEGER) AS start, substring(text, start + 1, 1400) AS piece
  FROM (SELECT *, unnest(CASE WHEN length(text) <= 1400 THEN [0] ELSE range(0, length(text), 1200) END) AS start FROM documents WHERE length(text) > 0)
  WHERE {strip("substring(text, start + 1, 1400)")} <> ''
)"""

_LEGACY = f"""{_PIECES},
chunks AS MATERIALIZED (
  SELECT doc_id * 10000 + piece_no AS cid, coalesce(project, '共通') || '/' || coalesce(file_name, '') AS path, project, file_name AS filename, 'chunk ' || piece_no AS location, piece AS text, {lowered("coalesce(file_name, '')")} AS low_name,
    coalesce(file_name, '') || ' ' || coalesce(project, '共通') || ' chunk ' || piece_no || chr(10) || piece AS indexed FROM pieces
),
post AS MATERIALIZED (SELECT cid, term, count(*) AS tf FROM (SELECT cid, unnest({tokens_b("f")}) AS term FROM (SELECT cid, {lowered("indexed")} AS f FROM chunks)) GROUP BY ALL),
lens AS MATERIALIZED (SELECT cid, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY cid),
legacy_size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
legacy_idf AS MATERIALIZED (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY term), legacy_size),
questions AS MATERIALIZED (
  SELECT doc_id AS query_id, coalesce(project, '') || ' ' || {collapse("text")} AS query, text FROM documents WHERE text IS NOT NULL AND doc_id % 20 = 0
),
projects AS (SELECT DISTINCT project FROM chunks WHERE length(project) >= 3),
targets AS MATERIALIZED (SELECT query_id, list(project) AS targets FROM questions, projects WHERE contains(query, project) GROUP BY query_id),
wanted AS MATERIALIZED (
  SELECT q.query_id, query, targets, list_filter(regexp_extract_all({lowered("query")}, '[0-9A-Za-z_][0-9A-Za-z_.-]{{2,}}'), lambda t: length(t) >= 4) AS names_in, list_reduce(list_prepend(query || chr(10), coalesce(targets, [])), lambda t, p: replace(t, p, ' ')) AS expanded
  FROM questions q LEFT JOIN targets t ON t.query_id = q.query_id
),
legacy_terms AS (SELECT query_id, term, least(count(*), 3) AS times FROM (SELECT query_id, unnest({tokens_b("f")}) AS term FROM (SELECT query_id, {lowered("expanded")} AS f FROM wanted)) GROUP BY ALL),
base AS (
  SELECT query_id, cid, sum(idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * times) AS base_score
  FROM post JOIN legacy_terms USING (term) JOIN legacy_idf USING (term) JOIN lens USING (cid), legacy_size GROUP BY query_id, cid
),
boosted AS (
  SELECT query_id, cid, base_score, base_score
    * CASE WHEN len(list_filter(names_in, lambda t: contains(low_name, t))) > 0 THEN 2.5 ELSE 1.0 END
    * CASE WHEN targets IS NULL THEN 1.0 WHEN list_contains(targets, project) THEN 3.0 WHEN length(project) > 0 THEN 0.25 ELSE 1.2 END AS score
  FROM base JOIN chunks USING (cid) JOIN wanted USING (query_id)
),
legacy_hits AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, cid DESC) AS INTEGER) AS rank FROM boosted) WHERE rank <= 12)"""

_ANSWERS = f"""{_LEGACY},
gold AS MATERIALIZED (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN substring(text, 1, 12) || '※' ELSE substring(text, 1, 12) END AS expected,
  CASE WHEN query_id % 4 = 1 THEN 'わかりません' WHEN query_id % 2 = 0 THEN substring(text, 1, 12) ELSE 'わかりません' END AS predicted FROM questions),
places AS MATERIALIZED (SELECT query_id, cid FROM gold, chunks WHERE length(expected) > 0 AND contains(chunks.text, expected)),
judged AS (
  SELECT query_id, predicted, query_id IN (SELECT query_id FROM places) AS in_corpus, query_id IN (SELECT query_id FROM places JOIN legacy_hits USING (query_id, cid)) AS in_top,
    {strip(composed("predicted"))} = {strip(composed("expected"))} AS same FROM gold
),
diagnosed AS (SELECT *, CASE WHEN same THEN '成功' WHEN in_top THEN '回答生成不足' WHEN in_corpus THEN '検索不足' ELSE '要目視' END AS automatic FROM judged)"""

_EVIDENCE = rf"""records AS MATERIALIZED (
  SELECT DISTINCT evidence_id, document_id, evidence_type, seq, content.raw_text AS raw_text, content.raw_value AS raw_value, location.page_number AS page_number, location.slide_number AS slide_number,
    location.sheet_name AS sheet_name, location.cell AS cell, location.paragraph_index AS paragraph_index, location.table_index AS table_index, location.row_index AS row_index, location.column_index AS column_index, location.shape_id AS shape_id
  FROM evidence WHERE evidence_id IS NOT NULL
),
kinds AS (
  SELECT *, CASE WHEN evidence_type IN ('heading', 'paragraph') THEN 'p' WHEN evidence_type = 'table' THEN 't' WHEN evidence_type = 'table_cell' THEN 'c' WHEN evidence_type = 'shape' THEN 's' WHEN evidence_type = 'page' THEN 'g'
    WHEN evidence_type = 'text_block' THEN CASE WHEN slide_number IS NOT NULL THEN 's' WHEN page_number IS NOT NULL THEN 'g' ELSE 'p' END END AS kind, {strip("coalesce(raw_text, raw_value, '')")} AS value
  FROM records
),
events AS MATERIALIZED (SELECT * FROM kinds WHERE kind IS NOT NULL AND document_id IS NOT NULL AND seq IS NOT NULL),
placed_cells AS MATERIALIZED (
  SELECT *, CASE WHEN cell IS NOT NULL AND sheet_name IS NOT NULL THEN CASE WHEN letters <> '' THEN concat_ws('/', 'sheet', sheet_name) END
      WHEN table_index IS NOT NULL AND row_index IS NOT NULL THEN concat_ws('/', 'table', coalesce(CAST(slide_number AS VARCHAR), ''), coalesce(shape_id, ''), CAST(table_index AS VARCHAR))
      WHEN shape_id IS NOT NULL AND row_index IS NOT NULL AND slide_number IS NOT NULL THEN concat_ws('/', 'slide_table', CAST(slide_number AS VARCHAR), shape_id) END AS container,
    CASE WHEN cell IS NOT NULL AND sheet_name IS NOT NULL THEN CASE WHEN letters <> '' THEN CAST(regexp_extract(cell, '(\d+)$', 1) AS INTEGER) END WHEN (table_index IS NOT NULL OR (shape_id IS NOT NULL AND slide_number IS NOT NULL)) THEN row_index END AS row_no,
    CASE WHEN cell IS NOT NULL AND sheet_name IS NOT NULL THEN CASE WHEN letters <> '' THEN CAST(list_reduce(list_prepend(0, list_transform(string_split(letters, ''), lambda c: ascii(c) - 64)), lambda a, c: a * 26 + c) AS INTEGER) END
      WHEN (table_index IS NOT NULL OR (shape_id IS NOT NULL AND slide_number IS NOT NULL)) AND row_index IS NOT NULL THEN coalesce(column_index, 1) END AS column_no,
    CASE WHEN cell IS NOT NULL AND sheet_name IS NOT NULL THEN CASE WHEN letters <> '' THEN letters END
      WHEN (table_index IS NOT NULL OR (shape_id IS NOT NULL AND slide_number IS NOT NULL)) AND row_index IS NOT NULL THEN CAST(coalesce(column_index, 1) AS VARCHAR) END AS label
  FROM (SELECT *, coalesce(regexp_extract(cell, '^([A-Z]{{1,3}})([1-9]\d*)$', 1), '') AS letters FROM events)
)"""

_ROWS = f"""{_EVIDENCE},
flow AS (SELECT *, CASE WHEN kind = 'c' THEN container || '/' || row_no END AS row_key FROM placed_cells WHERE kind <> 't' AND (kind <> 'c' OR container IS NOT NULL)),
started AS (SELECT *, kind = 'c' AND row_key IS DISTINCT FROM lag(row_key) OVER (PARTITION BY document_id ORDER BY seq, evidence_id) AS starts FROM flow),
numbered AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY seq, evidence_id ROWS UNBOUNDED PRECEDING) AS run FROM started),
table_lines AS MATERIALIZED (
  SELECT document_id, container, row_no, run, list({{'c': column_no, 'l': label, 'v': value, 'e': evidence_id}} ORDER BY column_no, seq, evidence_id) AS cells, any_value(sheet_name) AS sheet, any_value(table_index) AS tbl, any_value(slide_number) AS slide, any_value(shape_id) AS shape
  FROM numbered WHERE kind = 'c' GROUP BY ALL HAVING count(*) FILTER (value <> '') > 0
),
heads AS (SELECT document_id, container, min(run) AS head, arg_min(cells, run) AS head_cells FROM table_lines GROUP BY ALL),
headings AS (
  SELECT *, last_value(CASE WHEN evidence_type = 'heading' THEN {{'e': evidence_id, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seq, evidence_id ROWS UNBOUNDED PRECEDING) AS heading FROM events
),
above AS (
  SELECT document_id, CASE WHEN table_index IS NOT NULL THEN concat_ws('/', 'table', coalesce(CAST(slide_number AS VARCHAR), ''), coalesce(shape_id, ''), CAST(table_index AS VARCHAR)) ELSE concat_ws('/', 'slide_table', CAST(slide_number AS VARCHAR), shape_id) END AS container,
    arg_max(heading, (seq, evidence_id)) AS heading, 'table' AS ck FROM headings WHERE kind = 't' AND (table_index IS NOT NULL OR (slide_number IS NOT NULL AND shape_id IS NOT NULL)) GROUP BY ALL
),
labelled AS (
  SELECT *, run = head AS is_head, coalesce(heading.v, '') AS section, CASE WHEN run = head THEN [] ELSE list_filter(head_cells, lambda x: x.v <> '') END AS named
  FROM table_lines JOIN heads USING (document_id, container) LEFT JOIN above USING (document_id, container)
),
lettered AS (SELECT *, list_transform(cells, lambda x: {{'v': x.v, 'e': x.e, 't': coalesce(list_last(list_filter(named, lambda h: h.c = x.c)).v, x.l)}}) AS shown FROM labelled)"""


def _grouped(kind: str, number: str, breaks: str, prefix: str, name: str = "") -> str:
    """Units of runs of events; with a name, as parts of a WITH that come after the evidence's."""
    parts = f"""mine{name} AS (SELECT *, kind = '{kind}' AND value <> '' AND {number} IS NOT NULL AS is_mine FROM events),
flow{name} AS (SELECT *, is_mine AND ((lag(kind) OVER w) IS NULL OR (lag(kind) OVER w) <> '{kind}' OR (lag({number}) OVER w) IS DISTINCT FROM {number}) AS starts FROM mine{name} WHERE is_mine OR kind IN ({breaks}) WINDOW w AS (PARTITION BY document_id ORDER BY seq, evidence_id)),
numbered{name} AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY seq, evidence_id ROWS UNBOUNDED PRECEDING) AS run FROM flow{name}),
units{name} AS (SELECT document_id, list(evidence_id ORDER BY seq, evidence_id) AS ids, {prefix} || {strip("string_agg(value, chr(10) || chr(10) ORDER BY seq, evidence_id)")} AS search_text, {number} AS number
  FROM numbered{name} WHERE is_mine GROUP BY document_id, run, {number})"""
    return parts if name else f"WITH {_EVIDENCE}, {parts} SELECT document_id, array_to_string(ids, ',') AS sources, search_text FROM units"


_PACKED_PARTS = f"""passages AS (
  SELECT *, last_value(CASE WHEN evidence_type = 'heading' THEN {{'e': evidence_id, 'v': value, 'i': paragraph_index}} END IGNORE NULLS) OVER w AS heading,
    coalesce(sum(CASE WHEN kind IN ('t', 'c', 'g') OR evidence_type = 'heading' THEN 1 ELSE 0 END) OVER w, 0) AS section
  FROM events WHERE kind IN ('t', 'c', 'g') OR (kind = 'p' AND value <> '') WINDOW w AS (PARTITION BY document_id ORDER BY seq, evidence_id ROWS UNBOUNDED PRECEDING)
),
paragraphs AS MATERIALIZED (
  SELECT document_id, section, evidence_id, value, heading, length(value) AS size, length(heading.v) AS hsize, paragraph_index, row_number() OVER (PARTITION BY document_id, section ORDER BY seq, evidence_id) AS n FROM passages WHERE kind = 'p'
),
fold AS (
  SELECT document_id, section, n, 0 AS chunk, false AS again, size AS total, 1 AS cnt FROM paragraphs WHERE n = 1
  UNION ALL
  SELECT document_id, section, n + 1, chunk + over_, CASE WHEN over_ = 1 THEN h IS NOT NULL ELSE again END,
    CASE WHEN over_ = 1 THEN coalesce(h, 0) ELSE total END + s, CASE WHEN over_ = 1 THEN CASE WHEN h IS NULL THEN 0 ELSE 1 END ELSE cnt END + 1
  FROM (SELECT f.*, p.size AS s, p.hsize AS h, CASE WHEN f.total + p.size + 2 * f.cnt > 1200 THEN 1 ELSE 0 END AS over_ FROM fold f JOIN paragraphs p ON p.document_id = f.document_id AND p.section = f.section AND p.n = f.n + 1)
),
grouped AS (
  SELECT p.document_id, p.section, chunk, again, list(p.evidence_id ORDER BY n) AS ids, string_agg(value, chr(10) || chr(10) ORDER BY n) AS body, arg_max(heading, n) AS heading, min(paragraph_index) AS low, max(paragraph_index) AS high
  FROM paragraphs p JOIN fold f USING (document_id, section, n) GROUP BY p.document_id, p.section, chunk, again
),
packed AS (SELECT document_id, CASE WHEN again THEN list_prepend(heading.e, ids) ELSE ids END AS ids, CASE WHEN again THEN least(low, heading.i) ELSE low END AS low, CASE WHEN again THEN greatest(high, heading.i) ELSE high END AS high, nullif(heading.v, '') AS above, {strip("(CASE WHEN again THEN heading.v || chr(10) || chr(10) ELSE '' END || body)")} AS search_text FROM grouped)"""
_PACKED = f"WITH RECURSIVE {_EVIDENCE}, {_PACKED_PARTS} SELECT document_id, array_to_string(ids, ',') AS sources, search_text FROM packed"

# One unit per run of cells: its sources and text.
_ROW_IDS = "list_concat(CASE WHEN section <> '' THEN [heading.e] ELSE [] END, list_concat(list_transform(named, lambda h: h.e), list_transform(list_filter(cells, lambda x: x.v <> ''), lambda x: x.e)))"
_ROW_TEXT = "CASE WHEN section <> '' THEN 'セクション: ' || section || chr(10) ELSE '' END || array_to_string(list_transform(list_filter(shown, lambda x: x.v <> ''), lambda x: x.t || ': ' || x.v), chr(10))"


def _member(name: str, column: str) -> str:
    """A member of a canonical JSON object; null where the value is."""
    return f"""'"{name}":' || CAST(to_json({column}) AS VARCHAR)"""


def _object(**members: str) -> str:
    """A canonical JSON object of columns."""
    return "'{' || concat_ws(',', " + ", ".join(_member(k, members[k]) for k in sorted(members)) + ") || '}'"


_DERIVED = f"""{_ROWS}, {_PACKED_PARTS}, {_grouped("s", "slide_number", "'g'", "'コンテナ種別: スライド' || chr(10)", "_s")}, {_grouped("g", "page_number", "''", "''", "_g")},
every AS (
  SELECT document_id, 'paragraph_chunk' AS unit_type, ids, search_text, {_object(paragraph_start="low", paragraph_end="high")} AS locator, above, NULL AS ck, NULL AS title, NULL AS title_id, NULL AS labels, NULL AS head_ids, CAST(NULL AS BOOLEAN) AS is_head FROM packed
  UNION ALL SELECT document_id, 'table_row', list_filter({_ROW_IDS}, lambda x, i: list_position({_ROW_IDS}, x) = i), {_ROW_TEXT},
    {_object(row_index="row_no", sheet_name="CASE WHEN starts_with(container, 'sheet/') THEN sheet END", table_index="CASE WHEN starts_with(container, 'table/') THEN tbl END", slide_number="CASE WHEN NOT starts_with(container, 'sheet/') THEN slide END", shape_id="CASE WHEN NOT starts_with(container, 'sheet/') THEN shape END")},
    NULL, ck, CASE WHEN section <> '' THEN section END, CASE WHEN section <> '' THEN heading.e END, CASE WHEN NOT is_head THEN array_to_string(list_transform(shown, lambda x: x.t), '|') END, CASE WHEN NOT is_head THEN array_to_string(list_transform(named, lambda h: h.e), ',') END, is_head FROM lettered
  UNION ALL SELECT document_id, 'slide_text', ids, search_text, {_object(slide_number="number")}, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM units_s
  UNION ALL SELECT document_id, 'page_text', ids, search_text, {_object(page_number="number")}, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM units_g
),
hashed AS (SELECT *, sha256(search_text) AS sha256 FROM every WHERE search_text <> ''),
derived AS MATERIALIZED (SELECT 'su_' || substring(sha256('{{' || concat_ws(',', '"builder":"search-unit-builder"', '"builder_version":"0.2.0"', {_member("document_id", "document_id")}, '"locator":' || locator, {_member("source_evidence_ids", "ids")}, {_member("text_sha256", "sha256")}, {_member("unit_type", "unit_type")}) || '}}'), 1, 32) AS search_unit_id, * FROM hashed)"""

_DAYS = "days AS (SELECT try_cast(strftime(ts, '%-d') AS DOUBLE) AS x, event_type, value FROM events)"
_PIXELS = """pixels AS (SELECT l_returnflag AS image, CAST(l_orderkey % 256 AS INTEGER) AS r, CAST(l_partkey * 7 % 256 AS INTEGER) AS g, CAST(l_suppkey * 13 % 256 AS INTEGER) AS b FROM lineitem),
spread AS (SELECT *, greatest(r, g, b) AS high, least(r, g, b) AS low FROM pixels)"""


def _hue(r: str, g: str, b: str) -> str:
    """Hue in degrees of a colour."""
    high, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    part = lambda x: f"(({high} - {x}) / CAST({high} - {low} AS DOUBLE))"
    turn = f"CASE WHEN {r} = {high} THEN {part(b)} - {part(g)} WHEN {g} = {high} THEN 2 + {part(r)} - {part(b)} ELSE 4 + {part(g)} - {part(r)} END"
    return f"CASE WHEN {high} = {low} THEN 0.0 ELSE 60 * (({turn}) - 6 * floor(({turn}) / 6.0)) END"


_HUES = f"""bins AS (SELECT image, CAST(r // 32 * 32 + 16 AS DOUBLE) AS r, CAST(g // 32 * 32 + 16 AS DOUBLE) AS g, CAST(b // 32 * 32 + 16 AS DOUBLE) AS b, count(*) AS n FROM spread
  WHERE high - low >= 40 AND (high - low) / greatest(high, 1) >= 0.2 AND (r + g + b) / 3 BETWEEN 35 AND 245 GROUP BY ALL),
queue AS MATERIALIZED (SELECT *, {_hue("r", "g", "b")} AS h, row_number() OVER (PARTITION BY image ORDER BY n DESC, r, g, b) AS k FROM bins WHERE n >= 24),
fold AS (
  SELECT image, 1 AS k, [{{'r': r, 'g': g, 'b': b, 'n': n, 'h': h}}] AS found FROM queue WHERE k = 1
  UNION ALL
  SELECT image, k, CASE WHEN spot IS NULL THEN list_append(found, {{'r': r, 'g': g, 'b': b, 'n': n, 'h': h}})
    ELSE list_transform(found, lambda c, i: CASE WHEN i <> spot THEN c ELSE {{'r': mr, 'g': mg, 'b': mb, 'n': m, 'h': {_hue("mr", "mg", "mb")}}} END) END
  FROM (SELECT *, found[spot].n + n AS m, (found[spot].r * found[spot].n + r * n) / (found[spot].n + n) AS mr, (found[spot].g * found[spot].n + g * n) / (found[spot].n + n) AS mg, (found[spot].b * found[spot].n + b * n) / (found[spot].n + n) AS mb
    FROM (SELECT f.image, q.k, f.found, q.r, q.g, q.b, q.n, q.h, list_position(list_transform(f.found, lambda c: least(abs(c.h - q.h), 360 - abs(c.h - q.h)) <= 18.0), true) AS spot FROM fold f JOIN queue q ON q.image = f.image AND q.k = f.k + 1))
),
merged AS (SELECT image, unnest(arg_max(found, k)) AS c FROM fold GROUP BY image),
placed AS (SELECT image, c.r AS r, c.g AS g, c.b AS b, c.n AS n, max(c.n) OVER (PARTITION BY image) AS most FROM merged)"""


def _checks(key: str, parts: dict[str, str], extra: str = "") -> str:
    rows = [f"""SELECT '{name}' AS "check", CAST({key} AS VARCHAR) AS record_id FROM ({query})""" for name, query in parts.items()]
    return f"""WITH {extra}found AS ({" UNION ALL ".join(rows)}) SELECT DISTINCT "check", record_id FROM found"""


_TOP10 = "row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 8) DESC, unit_seq) AS r"

SQL = {
    "tokenize_units": f"""WITH {_UNITS} SELECT unit_seq, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT unit_seq, {tokens_a("f")} AS t FROM (SELECT unit_seq, {folded("search_text")} AS f FROM units))""",
    "tokenize_documents": f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_b("f")} AS t FROM (SELECT doc_id, {lowered("text")} AS f FROM documents))""",
    "unit_postings": f"WITH {_INDEX} SELECT term, unit_seq, tf AS term_frequency FROM postings_a",
    "term_stats": f"WITH {_INDEX} SELECT term, count(*) AS document_frequency, CAST(sum(tf) AS BIGINT) AS occurrences FROM postings_a GROUP BY term",
    "corpus_stats": f"WITH {_INDEX} SELECT count(*) AS n_units, CAST(sum(dl) AS BIGINT) AS total_length, round(avg(dl), 6) AS average_length FROM lengths",
    "unit_counts": f"""WITH {_UNITS} SELECT 'unit_type' AS kind, unit_type AS value, count(*) AS n_units FROM units GROUP BY unit_type
UNION ALL SELECT 'document_id', coalesce(document_id, ''), count(*) FROM units GROUP BY document_id""",
    "self_eval_cases": f"WITH {_INDEX}, {_ASKED.replace('CHOSEN', _SAMPLE)} SELECT query_id AS eval_case_id, query, relevant_id, category FROM cases",
    "bm25_search": f"""WITH {_INDEX}, {_CASES} SELECT query_id, CAST(r AS INTEGER) AS rank, unit_seq, round(lexical, 6) AS score, matched AS matched_terms
FROM (SELECT *, {_TOP10} FROM scored) WHERE r <= 10""",
    "bm25_type_filter": f"""WITH {_INDEX}, {_CASES} SELECT query_id, CAST(r AS INTEGER) AS rank, unit_seq, round(lexical, 6) AS score, matched AS matched_terms
FROM (SELECT *, {_TOP10} FROM scored WHERE unit_seq IN (SELECT unit_seq FROM units WHERE unit_type IN ('paragraph_chunk', 'page_text'))) WHERE r <= 10""",
    "bm25_rerank": f"""WITH {_INDEX}, {_CASES}, {_rerank(10)} SELECT query_id, rank, search_unit_id, round(score, 6) AS score, round(bonus, 6) AS bonus, CAST(round(penalty, 6) AS DOUBLE) AS penalty, CAST(n_values AS INTEGER) AS n_values, matched AS matched_terms,
  md5(CASE WHEN length(search_text) > 500 THEN substring(search_text, 1, 500) || '…' ELSE search_text END) AS snippet_md5 FROM hits""",
    "semantic_topk": f"""WITH {_VECTORS} SELECT query_id, CAST(r AS INTEGER) AS rank, unit_seq, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, unit_seq) AS r FROM (SELECT q.unit_seq AS query_id, w.unit_seq, array_cosine_similarity(q.v, w.v) AS s FROM vectors q, vectors w WHERE q.unit_seq % 20 = 0)) WHERE r <= 10""",
    "semantic_type_filter": f"""WITH {_VECTORS} SELECT query_id, CAST(r AS INTEGER) AS rank, unit_seq, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, unit_seq) AS r FROM (SELECT q.unit_seq AS query_id, w.unit_seq, array_cosine_similarity(q.v, w.v) AS s FROM vectors q, vectors w
    WHERE q.unit_seq % 20 = 0 AND w.unit_seq IN (SELECT unit_seq FROM search_units WHERE unit_type = 'table_row' AND search_unit_id IS NOT NULL))) WHERE r <= 10""",
    "embedding_topk": """WITH rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings) SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, w.vec_id, array_cosine_similarity(q.v, w.v) AS s FROM rows q, rows w WHERE q.vec_id % 20 = 0)) WHERE r <= 5""",
    "hybrid_rrf": _fusion(False),
    "hybrid_adaptive": _fusion(True),
    "retrieval_outcomes": f"WITH {_OUTCOMES} SELECT * FROM outcomes",
    "retrieval_metrics": f"""WITH {_OUTCOMES} SELECT 'all' AS category, count(*) AS n_cases, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, {_METRICS} FROM outcomes
UNION ALL SELECT category, count(*), round(avg(coalesce(1.0 / first_rank, 0)), 6), {_METRICS} FROM outcomes GROUP BY category""",
    "missing_targets": "SELECT DISTINCT search_unit_id FROM search_units WHERE search_unit_id IS NOT NULL AND search_unit_id NOT IN (SELECT search_unit_id FROM semantic_index WHERE search_unit_id IS NOT NULL)",
    "sliding_chunks": f"WITH {_PIECES} SELECT doc_id, piece_no, start, CAST(length(piece) AS INTEGER) AS n_chars, md5(piece) AS piece_md5 FROM pieces",
    "legacy_search": f"WITH {_LEGACY} SELECT query_id, rank, cid, round(score, 6) AS score, round(base_score, 6) AS base_score FROM legacy_hits",
    "context_budget": f"""WITH {_LEGACY}, blocks AS (SELECT query_id, rank, cid, '--- [' || path || ' / ' || location || ']' || chr(10) || text || chr(10) AS block FROM legacy_hits JOIN chunks USING (cid)),
spent AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM blocks)
SELECT query_id, rank, cid, used, md5(block) AS block_md5 FROM spent WHERE used <= 6000""",
    "glossary_expand": """WITH names AS (SELECT DISTINCT substring(project, 1, 2) AS alias, project AS canonical FROM documents WHERE length(project) > 2),
lines AS (SELECT doc_id, coalesce(project, '') || ': ' || text AS query FROM documents WHERE text IS NOT NULL),
found AS (SELECT doc_id, alias, list(canonical ORDER BY canonical) AS canons FROM lines, names WHERE contains(query, alias) GROUP BY doc_id, alias),
listed AS (SELECT doc_id, string_agg('- ' || alias || ' = ' || array_to_string(canons, ' / '), chr(10) ORDER BY length(alias) DESC, alias) AS explained, flatten(list(canons ORDER BY length(alias) DESC, alias)) AS canons FROM found GROUP BY doc_id)
SELECT doc_id AS query_id, CASE WHEN explained IS NULL THEN query ELSE query || chr(10) || chr(10) || '[社内用語の展開]' || chr(10) || explained END AS expanded,
  coalesce(array_to_string(list_filter(canons, lambda c, i: list_position(canons, c) = i), ','), '') AS names FROM lines LEFT JOIN listed USING (doc_id)""",
    "paragraph_chunks": _PACKED,
    "table_row_units": f"""WITH {_ROWS} SELECT document_id,
  array_to_string({_ROW_IDS}, ',') AS sources, {_ROW_TEXT} AS search_text,
  is_head AS is_header_candidate, CASE WHEN NOT is_head THEN array_to_string(list_transform(shown, lambda x: x.t), '|') END AS header_labels FROM lettered""",
    "slide_units": _grouped("s", "slide_number", "'g'", "'コンテナ種別: スライド' || chr(10)"),
    "page_units": _grouped("g", "page_number", "''", "''"),
    "derived_units": f"WITH RECURSIVE {_DERIVED} SELECT search_unit_id, document_id, unit_type, sha256, CAST(length(search_text) AS BIGINT) AS char_count FROM derived",
    "remap_targets": f"""WITH RECURSIVE {_UNITS}, {_DERIVED},
made AS (SELECT document_id, unit_type, search_text, count(DISTINCT search_unit_id) AS n FROM derived GROUP BY ALL)
SELECT u.search_unit_id AS relevant_id, coalesce(n, 0) AS n_candidates, coalesce(n, 0) = 1 AS found FROM units u LEFT JOIN made m ON m.document_id IS NOT DISTINCT FROM u.document_id AND m.unit_type IS NOT DISTINCT FROM u.unit_type AND m.search_text IS NOT DISTINCT FROM u.search_text""",
    "unit_contexts": f"""WITH RECURSIVE {_DERIVED} SELECT search_unit_id, above AS heading_text, ck AS container_kind, title AS container_heading_text, CASE WHEN unit_type = 'table_row' THEN 'first_non_empty_row_candidate' END AS header_method, is_head AS is_header_candidate,
  title_id AS container_heading_evidence_ids, labels AS header_labels, head_ids AS header_evidence_ids FROM derived""",
    "containment_edges": """SELECT 'rel_' || substring(sha256('{"class":"structural","from":{"record_id":' || CAST(to_json(from_id) AS VARCHAR) || ',"record_type":"' || from_type || '"},"generator":"intermediate-extractor","generator_version":"0.4.0","to":{"record_id":' || CAST(to_json(to_id) AS VARCHAR) || ',"record_type":"evidence"},"type":"contains"}'), 1, 32) AS relation_id, from_type, from_id, to_id
FROM (SELECT DISTINCT CASE WHEN parent_evidence_id IS NOT NULL THEN 'evidence' ELSE 'document' END AS from_type, coalesce(parent_evidence_id, document_id) AS from_id, evidence_id AS to_id FROM evidence) WHERE from_id IS NOT NULL""",
    "content_hashes": """SELECT DISTINCT evidence_id, sha256('{"raw_text":' || CAST(to_json(raw_text) AS VARCHAR) || '}') AS content_sha256,
  'ev_' || substring(sha256('{"content_sha256":"' || sha256(raw_text) || '","evidence_id":"' || evidence_id || '"}'), 1, 32) AS stable_id FROM (SELECT evidence_id, content.raw_text AS raw_text FROM evidence) WHERE raw_text IS NOT NULL""",
    "cell_positions": f"WITH {_EVIDENCE} SELECT evidence_id, container, row_no, column_no, label FROM placed_cells WHERE kind = 'c'",
    "display_values": f"WITH {_EVIDENCE} SELECT evidence_id, value FROM kinds WHERE value <> ''",
    "field_values": f"""WITH {_UNITS} SELECT search_unit_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS field_values FROM (SELECT search_unit_id, {values_of("search_text")} AS v FROM units) WHERE len(v) > 0""",
    "snippets": f"""WITH {_UNITS} SELECT search_unit_id, CASE WHEN length(search_text) > 40 THEN substring(search_text, 1, 40) || '…' ELSE search_text END AS snippet, {collapse("substring(search_text, 1, 40)")} AS line FROM units""",
    "leaf_sample": f"""WITH {_EVIDENCE} SELECT document_id, evidence_id, CAST(n AS INTEGER) AS leaf_no FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq, evidence_id) AS n FROM records WHERE document_id IS NOT NULL AND evidence_type IN ('table_cell', 'paragraph', 'text_block')) WHERE n <= 40""",
    "round_robin_sample": f"""WITH {_UNITS} SELECT unit_type, unit_seq, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY unit_type ORDER BY unit_seq) AS turn FROM units) ORDER BY turn, unit_type LIMIT 200""",
    "chart_groupby": f"WITH {_DAYS} SELECT x, count(*) AS n_rows, round(avg(value), 6) AS mean FROM days WHERE x IS NOT NULL GROUP BY x",
    "chart_points": f"WITH {_DAYS} SELECT event_type AS series_id, x, round(avg(value), 6) AS y, CASE WHEN avg(value) IS NULL THEN 'unresolved' ELSE 'exact' END AS status FROM days WHERE x IS NOT NULL GROUP BY event_type, x",
    "chart_tables": f"""WITH {_DAYS}, series AS (SELECT event_type, count(DISTINCT x) AS n FROM days WHERE x IS NOT NULL GROUP BY event_type), axis AS (SELECT DISTINCT x FROM days WHERE x IS NOT NULL)
SELECT 'events' AS chart_id, (SELECT count(*) FROM series) AS n_series, CAST((SELECT count(*) FROM axis) AS INTEGER) AS points_per_series, CASE WHEN (SELECT min(n) FROM series) = (SELECT count(*) FROM axis) THEN 'complete' ELSE 'partial' END AS completeness, (SELECT string_agg(CAST(CAST(x AS INTEGER) AS VARCHAR), ',' ORDER BY x) FROM axis) AS x_values""",
    "chart_axis": f"WITH {_DAYS} SELECT event_type, count(x) > 0 AND min(x) >= 1 AND max(x) <= 31 AS is_day FROM days GROUP BY event_type",
    "colour_bins": f"""WITH {_PIXELS} SELECT image, CAST(r // 32 * 32 + 16 AS INTEGER) AS qr, CAST(g // 32 * 32 + 16 AS INTEGER) AS qg, CAST(b // 32 * 32 + 16 AS INTEGER) AS qb, count(*) AS n FROM spread
WHERE high - low >= 40 AND (high - low) / greatest(high, 1) >= 0.2 AND (r + g + b) / 3 BETWEEN 35 AND 245 GROUP BY ALL""",
    "colour_clusters": f"""WITH RECURSIVE {_PIXELS}, {_HUES} SELECT * FROM (SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY n DESC) - 1 AS INTEGER) AS cluster_no, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, CAST(n AS BIGINT) AS weight FROM placed WHERE n >= 0.35 * most) WHERE cluster_no < 6""",
    "diagnose_answers": f"WITH {_ANSWERS} SELECT query_id, in_corpus, in_top, automatic, automatic AS category FROM diagnosed",
    "answer_categories": f"WITH {_ANSWERS} SELECT automatic AS category, count(*) AS n_questions, count(*) FILTER (starts_with(predicted, 'わかりません')) AS n_abstained FROM diagnosed GROUP BY automatic",
    "submission_check": """WITH given AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS index,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN repeat(o_orderpriority, 200) ELSE o_orderpriority END AS answer FROM orders WHERE o_orderkey % 97 <> 0)
SELECT o_orderkey AS position, 'order differs' AS "check" FROM orders LEFT JOIN given ON position = o_orderkey WHERE index IS DISTINCT FROM o_orderkey
UNION ALL SELECT position, 'index repeated' FROM given WHERE index IN (SELECT index FROM given GROUP BY index HAVING count(*) > 1)
UNION ALL SELECT position, 'answer empty' FROM given WHERE trim(answer) = '' UNION ALL SELECT position, 'answer too long' FROM given WHERE strlen(answer) > 1000""",
    "submission_longest": """WITH given AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS index, strlen(CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN repeat(o_orderpriority, 200) ELSE o_orderpriority END) AS n FROM orders WHERE o_orderkey % 97 <> 0)
SELECT CAST(n AS INTEGER) AS most_bytes, index FROM given ORDER BY n DESC, index LIMIT 1""",
    "violations_documents": _checks("document_id", {
        "schema version or record type wrong": "SELECT * FROM docs WHERE version IS DISTINCT FROM '0.1' OR kind IS DISTINCT FROM 'document'",
        "required field missing": "SELECT * FROM docs WHERE document_id IS NULL OR no_source OR no_extraction",
        "document id unstable": "SELECT * FROM docs WHERE document_id IS DISTINCT FROM 'doc_' || substring(sha256('{' || concat_ws(',', '\"relative_path\":' || CAST(to_json(path) AS VARCHAR), '\"source_sha256\":' || CAST(to_json(sha) AS VARCHAR)) || '}'), 1, 32)",
        "document id malformed": "SELECT * FROM docs WHERE NOT coalesce(regexp_full_match(document_id, 'doc_[0-9a-f]{16,64}'), false)",
        "status unknown": "SELECT * FROM docs WHERE NOT coalesce(status IN ('pending', 'success', 'partial', 'deferred', 'failed'), false)",
        "document id ambiguous": "SELECT document_id FROM docs GROUP BY document_id HAVING count(DISTINCT path) > 1",
    }, "docs AS MATERIALIZED (SELECT document_id, extraction.status AS status, source.relative_path AS path, source.sha256 AS sha, schema_version AS version, record_type AS kind, source IS NULL AS no_source, extraction IS NULL AS no_extraction FROM source_documents), "),
    "violations_evidence": _checks("evidence_id", {
        "schema version or record type wrong": "SELECT * FROM ev WHERE version IS DISTINCT FROM '0.1' OR kind IS DISTINCT FROM 'evidence'",
        "required field missing": "SELECT * FROM ev WHERE evidence_id IS NULL OR document_id IS NULL OR lacking",
        "document dangling": "SELECT * FROM ev WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM source_documents WHERE document_id IS NOT NULL)",
        "parent dangling": "SELECT * FROM ev WHERE parent_evidence_id IS NOT NULL AND parent_evidence_id NOT IN (SELECT evidence_id FROM ev WHERE evidence_id IS NOT NULL)",
        "evidence id malformed": "SELECT * FROM ev WHERE NOT coalesce(regexp_full_match(evidence_id, 'ev_[0-9a-f]{16,64}'), false)",
        "text hash wrong": "SELECT * FROM ev WHERE sha256(raw_text) <> sha",
        "evidence id ambiguous": "SELECT evidence_id FROM (SELECT DISTINCT evidence_id, document_id, parent_evidence_id, raw_text FROM ev) GROUP BY evidence_id HAVING count(*) > 1",
        "parent in another document": "SELECT a.evidence_id FROM ev a JOIN ev b ON b.evidence_id = a.parent_evidence_id WHERE a.document_id <> b.document_id",
    }, "ev AS MATERIALIZED (SELECT evidence_id, document_id, parent_evidence_id, content.raw_text AS raw_text, content.sha256 AS sha, schema_version AS version, record_type AS kind, evidence_type IS NULL OR location IS NULL OR content IS NULL OR provenance IS NULL AS lacking FROM evidence), "),
    "violations_relations": _checks("relation_id", {
        "from_ref missing": "SELECT * FROM rel WHERE f IS NULL",
        "to_ref missing": "SELECT * FROM rel WHERE t IS NULL",
        "from_ref dangling": "SELECT * FROM rel WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes WHERE k = ft AND id = f)",
        "to_ref dangling": "SELECT * FROM rel WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes WHERE k = tt AND id = t)",
        "from_ref of another type": "SELECT * FROM rel WHERE NOT coalesce(ft IN ('document', 'evidence'), false)",
        "to_ref of another type": "SELECT * FROM rel WHERE NOT coalesce(tt IN ('document', 'evidence'), false)",
        "supporting evidence dangling": "SELECT relation_id FROM (SELECT relation_id, unnest(support) AS e FROM rel) WHERE e IS NOT NULL AND e NOT IN (SELECT id FROM nodes WHERE k = 'evidence' AND id IS NOT NULL)",
        "relation id unstable": f"SELECT * FROM rel WHERE relation_id IS DISTINCT FROM 'rel_' || substring(sha256('{{' || concat_ws(',', {_member('class', 'class')}, '\"from\":{{' || concat_ws(',', {_member('record_id', 'f')}, {_member('record_type', 'ft')}) || '}}', {_member('generator', 'made_by')}, {_member('generator_version', 'made_version')}, '\"to\":{{' || concat_ws(',', {_member('record_id', 't')}, {_member('record_type', 'tt')}) || '}}', {_member('type', 'kind')}) || '}}'), 1, 32)",
        "relation id malformed": "SELECT * FROM rel WHERE NOT coalesce(regexp_full_match(relation_id, 'rel_[0-9a-f]{16,64}'), false)",
        "relation to itself": "SELECT * FROM rel WHERE f = t",
    }, """rel AS MATERIALIZED (SELECT relation_id, from_ref.record_id AS f, from_ref.record_type AS ft, to_ref.record_id AS t, to_ref.record_type AS tt, supporting_evidence_ids AS support, relation_class AS class, relation_type AS kind, provenance.generated_by AS made_by, provenance.generator_version AS made_version FROM relation),
nodes AS MATERIALIZED (SELECT DISTINCT 'document' AS k, document_id AS id FROM source_documents UNION SELECT 'evidence', evidence_id FROM evidence), """),
    "violations_units": _checks("search_unit_id", {
        "unit id malformed": "SELECT * FROM u WHERE NOT coalesce(regexp_full_match(search_unit_id, 'su_[0-9a-f]{16,64}'), false)",
        "unit id ambiguous": "SELECT search_unit_id FROM (SELECT DISTINCT search_unit_id, document_id, unit_type, t FROM u) GROUP BY search_unit_id HAVING count(*) > 1",
        "text empty": "SELECT * FROM u WHERE coalesce(t, '') = ''",
        "document dangling": "SELECT * FROM u WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM source_documents WHERE document_id IS NOT NULL)",
        "source dangling or of another document": "SELECT * FROM (SELECT search_unit_id, document_id, unnest(source_evidence_ids) AS e FROM u) x WHERE e IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence v WHERE v.evidence_id = x.e AND v.document_id = x.document_id)",
        "heading not among sources": "SELECT * FROM u WHERE NOT list_has_all(source_evidence_ids, ch)",
        "provenance wrong": "SELECT * FROM u WHERE builder IS DISTINCT FROM 'build_search_units' OR deterministic IS DISTINCT FROM true",
        "unit type unknown": "SELECT * FROM u WHERE NOT coalesce(unit_type IN ('paragraph_chunk', 'table_row', 'slide_text', 'page_text'), false)",
        "text hash wrong": "SELECT * FROM u WHERE sha256(t) <> sha",
        "char count wrong": "SELECT * FROM u WHERE n IS DISTINCT FROM length(t)",
        "no sources": "SELECT * FROM u WHERE coalesce(len(source_evidence_ids), 0) < 1",
        "source repeated": "SELECT * FROM u WHERE len(source_evidence_ids) <> len(list_distinct(source_evidence_ids))",
        "header not among sources": "SELECT * FROM u WHERE NOT list_has_all(source_evidence_ids, h)",
    }, "u AS MATERIALIZED (SELECT search_unit_id, document_id, provenance.builder AS builder, provenance.deterministic AS deterministic, context.container_heading_evidence_ids AS ch, unit_type, text.search_text AS t, text.sha256 AS sha, text.char_count AS n, source_evidence_ids, context.header_evidence_ids AS h FROM search_units), "),
    "violations_lexical": _checks("term_id", {
        "document frequency wrong": "SELECT t.term_id FROM terms t LEFT JOIN (SELECT term_id, count(*) AS n FROM postings GROUP BY term_id) p ON p.term_id = t.term_id WHERE document_frequency IS DISTINCT FROM coalesce(n, 0)",
        "posting of a missing unit": "SELECT term_id FROM postings WHERE doc_rowid NOT IN (SELECT unit_seq FROM search_units WHERE unit_seq IS NOT NULL)",
        "posting repeated": "SELECT term_id FROM postings GROUP BY term_id, doc_rowid HAVING count(*) > 1",
        "frequency not positive": "SELECT term_id FROM postings WHERE coalesce(term_frequency, 0) <= 0",
        "term of a posting missing": "SELECT term_id FROM postings WHERE term_id NOT IN (SELECT term_id FROM terms)",
        "term repeated": "SELECT min(term_id) AS term_id FROM terms GROUP BY term HAVING count(*) > 1",
    }),
    "violations_semantic": _checks("row_no", {
        "other model": "SELECT row_no FROM semantic_index WHERE model IS DISTINCT FROM 'embedstub-96'",
        "vector missing": "SELECT row_no FROM semantic_index WHERE matrix IS NULL",
        "dimensions wrong": "SELECT row_no FROM semantic_index WHERE len(matrix) <> 96",
        "not finite": "SELECT row_no FROM semantic_index WHERE len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) > 0",
        "length not one": "SELECT row_no FROM semantic_index WHERE len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND abs(sqrt(coalesce(list_sum(list_transform(matrix, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 0)) - 1) > 1.1e-5",
        "unit missing": "SELECT row_no FROM semantic_index WHERE search_unit_id IS NULL OR search_unit_id NOT IN (SELECT search_unit_id FROM search_units WHERE search_unit_id IS NOT NULL)",
    }),
    "document_status": """WITH ev AS MATERIALIZED (SELECT evidence_id, document_id, content.is_truncated AS cut, provenance.warnings AS ws FROM evidence),
each AS (SELECT DISTINCT evidence_id, document_id, cut, w FROM (SELECT evidence_id, document_id, cut, unnest(CASE WHEN ws IS NULL OR len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM ev)),
warned AS (SELECT document_id, CASE WHEN cut THEN 'truncated' ELSE w END AS warning FROM each)
SELECT document_id, CASE WHEN count(warning) = 0 THEN 'success' WHEN bool_or(starts_with(warning, 'failed')) THEN 'failed' WHEN bool_or(starts_with(warning, 'deferred')) THEN 'deferred' ELSE 'partial' END AS status,
  count(*) AS n_evidence, coalesce(string_agg(DISTINCT warning, ',' ORDER BY warning), '') AS warnings FROM warned WHERE document_id IS NOT NULL GROUP BY document_id""",
    "event_windows": """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
    "coverage_counts": """WITH docs AS MATERIALIZED (SELECT DISTINCT document_id, source.extension AS extension, extraction.status AS status, extraction.warnings AS warnings FROM source_documents)
SELECT extension, status, count(*) AS n_documents, CAST(sum(coalesce(len(warnings), 0)) AS BIGINT) AS n_warnings FROM docs GROUP BY extension, status""",
    "incremental_pending": """WITH docs AS MATERIALIZED (SELECT source.relative_path AS path, source.sha256 AS sha256, source.size_bytes AS n, extraction.status AS status FROM source_documents),
done AS (SELECT path, CASE WHEN n % 2 = 0 THEN sha256 ELSE 'changed' END AS sha256 FROM docs WHERE status IN ('success', 'partial', 'deferred'))
SELECT DISTINCT path, sha256 FROM docs WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.path = docs.path AND done.sha256 = docs.sha256)""",
    "mined_dates": r"""WITH parts AS (SELECT doc_id, regexp_extract_all(text, '(20\d{2})[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})', 1) AS y, regexp_extract_all(text, '(20\d{2})[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})', 2) AS m, regexp_extract_all(text, '(20\d{2})[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})', 3) AS t FROM documents),
found AS (SELECT doc_id, list_transform(y, lambda v, i: v || lpad(m[i], 2, '0') || lpad(t[i], 2, '0')) AS d FROM parts)
SELECT doc_id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',') AS dates FROM found WHERE len(d) > 0""",
    "password_candidates": r"""WITH docs AS MATERIALIZED (SELECT DISTINCT source.relative_path AS path, source.modified_at AS stamp FROM source_documents),
parts AS (SELECT path, string_split(path, '/')[-1] AS name, coalesce(list_distinct(list_transform(regexp_extract_all(stamp, '20\d{2}-?\d{2}-?\d{2}'), lambda d: replace(d, '-', ''))), []) AS dates FROM docs),
stems AS (SELECT path, regexp_replace(name, '\.[^.]*$', '') AS stem, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS ext, dates FROM parts),
listed AS (SELECT path, list_concat(regexp_extract_all(stem, '(?i)(?:pw|pass|password)[-_]?([0-9A-Za-z]{6,})', 1), list_concat(regexp_extract_all(stem, '([A-Za-z]{2,}\d{8})', 1),
  flatten(list_transform(['hk', 'ay'], lambda a: flatten(list_transform(dates, lambda d: ['DA-' || a || '-' || d || '-' || ext, 'DA-' || upper(a) || '-' || d || '-' || ext])))))) AS c FROM stems),
once AS (SELECT path, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM listed)
SELECT path, CAST(unnest(range(0, len(c))) AS INTEGER) AS ord, unnest(c) AS candidate FROM once""",
    "path_projects": """WITH docs AS MATERIALIZED (SELECT DISTINCT source.relative_path AS path FROM source_documents)
SELECT path, CASE WHEN list_position(p, 'プロジェクト') > 0 THEN p[list_position(p, 'プロジェクト') + 1] END AS project FROM (SELECT path, string_split(path, '/') AS p FROM docs)""",
    "plain_answers": f"""WITH made AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' わかりません。 ' ELSE '<b>' || substring(text, 1, 30) || '</b> ' END AS a FROM documents WHERE text IS NOT NULL),
clean AS (SELECT doc_id, {strip("regexp_replace(a, '</?[A-Za-z][^>]{0,200}>', '', 'g')")} AS t FROM made)
SELECT doc_id, CASE WHEN t = '' OR regexp_full_match(t, '(?:わかりません|わからない|不明)[。．.]*') THEN 'わかりません' ELSE t END AS answer FROM clean""",
}
