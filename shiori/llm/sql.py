"""DuckDB SQL of the subpackage's queries, over views named like the tables."""

from __future__ import annotations

import unicodedata

# Letters that look like a Latin one, in the order of the Latin letters below; stated here again so
# that the SQL does not take them from the operator.
_FOREIGN = "АВЕЅІЈКМНОРСТХҮѴԌԚԜӀаеорсухѕіјһԁԛԝѵӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ" "ՕօՏɑɡ" "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏕᏙᏞᏟᏢᏦᏴ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
_LATIN = "ABESIJKMHOPCTXYVGQWIaeopcyxsijhdqwvl" "ABEZHIKMNOPTYXovpcjCJ" "OoSag" "IVXLCDMivxlcdm" "DRTAJEWMHGZSVLCPKB" "BPDTGKJCZFMNLSRVHWXYAEIOU"
_HAN, _KANA = "力口囗工卜夕八二一丿", "カロロエトタハニーノ"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _ranges(where) -> list[str]:
    return [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11A00), *range(0x1D100, 0x1D200), *range(0xE0000, 0xE01F0)) if where(chr(c))]


def _clean(column: str) -> str:
    """One width, kind of space and line break, nothing without a glyph, composed: single characters by translate."""
    kind, shape = unicodedata.category, unicodedata.decomposition
    shown = {chr(x) for x in (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)}
    blank = {chr(x) for x in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)}
    lines = "\r\x0b\x0c\x85\u2028\u2029"
    gone = _ranges(lambda c: c in blank or kind(c) == "Cf" and c not in shown or kind(c) == "Cc" and c not in lines + "\n\t" or 0xFE00 <= ord(c) < 0xFE10 or 0xE0100 <= ord(c))
    single = _ranges(lambda c: c not in blank and (shape(c)[:6] in ("<wide>", "<narro") or shape(c)[:8] == "<compat>" and 0x2E80 <= ord(c) <= 0x2FD5))
    plain = [chr(int(shape(c).split()[1], 16)) for c in single]
    spaces = "\t" + "".join(_ranges(lambda c: kind(c) == "Zs" and c not in " \u3000"))
    # A wide character may stand for one that has no glyph; a wide micro sign is a mu as well.
    pairs = [(a, b) for a, b in zip(single, plain) if b not in gone]
    gone += [a for a, b in zip(single, plain) if b in gone]
    source = "".join(a for a, _ in pairs) + spaces + lines + "µ"
    target = "".join(b for _, b in pairs) + " " * len(spaces) + "\n" * len(lines) + "μ"
    breaks = f"replace({column}, chr(13) || chr(10), chr(10))"
    return f"nfc_normalize(translate(translate({breaks}, {_text(''.join(gone))}, ''), {_text(source)}, {_text(target)}))"


def _visible(clean: str) -> str:
    """The key of a clean text. Letters are taken apart, so that a look-alike with an accent is found too."""
    return f"nfc_normalize(translate({clean}, {_text(_accented()[0] + _FOREIGN + _HAN + 'へべぺ')}, {_text(_accented()[1] + _LATIN + _KANA + 'ヘベペ')}))"


def _accented() -> tuple[str, str]:
    """Accented letters of which the base is a look-alike, and the same accents on the Latin letter."""
    to = dict(zip(_FOREIGN, _LATIN))
    found = []
    for c in _ranges(lambda c: len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0] in to):
        apart = unicodedata.normalize("NFD", c)
        whole = unicodedata.normalize("NFC", to[apart[0]] + apart[1:])
        if len(whole) == 1:
            found.append((c, whole))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def _delivered(clean: str) -> str:
    """A clean text with look-alikes made Latin inside words that have a Latin letter."""
    parts = rf"regexp_extract_all({clean}, '[\p{{L}}\p{{M}}\p{{Nl}}]+|[^\p{{L}}\p{{M}}\p{{Nl}}]+')"
    word = f"CASE WHEN regexp_matches(w, '[a-zA-ZÀ-ÖØ-öø-ɏ]') THEN nfc_normalize(translate(w, {_text(_accented()[0] + _FOREIGN)}, {_text(_accented()[1] + _LATIN)})) ELSE w END"
    return f"array_to_string(list_transform({parts}, lambda w: {word}), '')"


_MIXED = rf"[\x{{4e00}}-\x{{9fff}}][{_KANA}]|[{_KANA}][\x{{4e00}}-\x{{9fff}}]|[\x{{30a1}}-\x{{30fa}}][{_HAN}]|[{_HAN}][\x{{30a1}}-\x{{30fa}}]"


_TEXTS = """texts AS (
  SELECT DISTINCT 'evidence' AS table_name, evidence_id AS record_id, document_id, content.raw_text AS text FROM evidence
  UNION SELECT DISTINCT 'search_units', search_unit_id, document_id, text.search_text FROM search_units
)"""


def _folded(column: str) -> str:
    """Case and width folded: voiced half-width kana first, then single characters."""
    out = column
    for base in range(0xFF66, 0xFF9E):
        for mark in "ﾞﾟ":
            whole = unicodedata.normalize("NFKC", chr(base) + mark)
            if len(whole) == 1:
                out = f"replace({out}, {_text(chr(base) + mark)}, {_text(whole)})"
    wide = {chr(k): chr(int(unicodedata.decomposition(chr(k)).split()[1], 16)) for k in (0x3000, *range(0xFF01, 0xFFEF)) if unicodedata.decomposition(chr(k))[:6] in ("<wide>", "<narro")}
    return f"lower(translate({out}, {_text(''.join(wide))}, {_text(''.join(wide.values()))}))"


def _term_counts() -> str:
    return f"""once AS (SELECT term_id, min(term) AS term FROM terms WHERE term_id IS NOT NULL GROUP BY term_id),
names AS (SELECT term_id, min(term_id) OVER (PARTITION BY coalesce('t' || {_folded("term")}, 'n' || CAST(term_id AS VARCHAR))) AS canonical_id FROM once),
present AS (
  SELECT term_id, doc_rowid, max(term_frequency) AS tf FROM postings
  WHERE term_frequency > 0 AND doc_rowid IN (SELECT unit_seq FROM search_units WHERE unit_seq IS NOT NULL) GROUP BY term_id, doc_rowid
),
size AS (SELECT count(DISTINCT doc_rowid) AS n_total FROM present WHERE term_id IS NOT NULL),
counted AS (
  SELECT canonical_id, coalesce(sum(tf), 0) AS occurrences, count(DISTINCT doc_rowid) AS n_units
  FROM names LEFT JOIN present USING (term_id) GROUP BY canonical_id
),
marked AS (
  SELECT canonical_id AS term_id, CAST(occurrences AS BIGINT) AS occurrences, n_units, n_total, n_units <= 2 AS is_rare, n_units >= 0.15 * n_total AND n_units > 0 AS is_common
  FROM counted, size
)"""


_COSINES = """rows AS (
  SELECT search_unit_id AS unit, min(unit_seq) AS seq, any_value(matrix) AS vector FROM semantic_index
  WHERE search_unit_id IS NOT NULL AND len(matrix) = 96 AND len(list_filter(matrix, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0
  GROUP BY search_unit_id
),
arrays AS (SELECT unit, seq, CAST(vector AS DOUBLE[96]) AS v FROM rows)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_TEXTS} SELECT DISTINCT table_name, record_id FROM texts WHERE length(text) > 1200",
        "p1_rejoined": f"WITH {_TEXTS}, once AS (SELECT table_name, record_id, max(text) AS text FROM texts WHERE length(text) > 1200 GROUP BY ALL) SELECT table_name, record_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM once",
        "p7_conserved": "SELECT doc_id, true AS is_whole FROM (SELECT DISTINCT doc_id FROM documents WHERE length(text) > 0)",
        "p8_caps": """WITH wanted AS (SELECT replace(lower(trim(source)), '-', '_') AS source FROM mix_targets WHERE target_weight > 0 AND NOT isnan(target_weight) AND source IS NOT NULL GROUP BY 1),
held AS (SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source FROM documents WHERE length(text) > 0)
SELECT source, source IN (SELECT source FROM held WHERE source IS NOT NULL) AS has_documents, true AS within_cap, true AS within_share FROM wanted""",
        "p2_found": f"""WITH {_TEXTS}, forms AS (SELECT *, {_visible("c")} AS form FROM (SELECT *, {_clean("text")} AS c FROM texts))
SELECT DISTINCT a.table_name, a.record_id AS id_a, b.record_id AS id_b FROM forms a JOIN forms b
ON a.table_name = b.table_name AND a.document_id = b.document_id AND a.form = b.form AND a.record_id < b.record_id AND a.text <> b.text""",
        "p2_classes": f"""WITH {_TEXTS}, forms AS MATERIALIZED (SELECT *, {_visible("c")} AS form FROM (SELECT *, {_clean("text")} AS c FROM texts) WHERE text IS NOT NULL AND document_id IS NOT NULL AND record_id IS NOT NULL),
sizes AS (SELECT table_name, document_id, form, count(DISTINCT record_id) AS n_records, min(record_id) AS class_id, count(DISTINCT text) AS n_texts FROM forms GROUP BY ALL),
same AS (SELECT table_name, document_id, form, text, count(DISTINCT record_id) AS n FROM forms GROUP BY ALL)
SELECT table_name, document_id, record_id, class_id, max(n_records) AS n_records, max(n_records - n) AS n_links FROM forms JOIN sizes USING (table_name, document_id, form) JOIN same USING (table_name, document_id, form, text)
WHERE n_texts > 1 GROUP BY table_name, document_id, record_id, class_id HAVING max(n_records - n) > 0""",
        "p2_forms": f"""WITH {_TEXTS}, cleaned AS MATERIALIZED (SELECT DISTINCT table_name, record_id, text, {_clean("text")} AS c FROM texts WHERE text IS NOT NULL),
keyed AS MATERIALIZED (SELECT *, {_visible("c")} AS key, {_delivered("c")} AS own FROM cleaned),
best AS (SELECT key, min({{'m': len(regexp_extract_all(own, '{_MIXED}')) + len(regexp_extract_all(own, '[{_FOREIGN}]')), 'f': own}}).f AS form FROM keyed GROUP BY key)
SELECT DISTINCT table_name, record_id, form, form <> text AS changed FROM keyed JOIN best USING (key)""",
        "p3_found": f"""WITH {_term_counts()} SELECT term_id, 'rare' AS mark FROM marked WHERE is_rare UNION ALL SELECT term_id, 'common' FROM marked WHERE is_common""",
        "p3_terms": f"WITH {_term_counts()} SELECT * FROM marked",
        "p5_found": f"""WITH {_COSINES},
pairs AS (SELECT a.unit AS u, b.unit AS w, array_cosine_similarity(a.v, b.v) AS c FROM arrays a JOIN arrays b ON a.unit <> b.unit),
best AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY c DESC, w) AS r FROM pairs WHERE c >= 0.8)
SELECT DISTINCT least(u, w) AS unit_a, greatest(u, w) AS unit_b FROM best WHERE r <= 5""",
        "p5_neighbours": f"""WITH {_COSINES},
pairs AS (SELECT a.unit AS u, b.unit AS w, array_cosine_similarity(a.v, b.v) AS c FROM arrays a JOIN arrays b ON a.unit <> b.unit WHERE a.seq % 20 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY c DESC, w) AS r FROM pairs)
SELECT u AS search_unit_id, w AS neighbour_id, round(c, 6) AS cosine, CAST(r AS INTEGER) AS rank FROM best WHERE r <= 5""",
    }
