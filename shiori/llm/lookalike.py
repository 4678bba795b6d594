"""One consistent form for visually identical text (problem 2).

The quick-check properties of the normal form tell which characters can change: those with a mapping
here, and those that canonical composition may move or join. Only the runs of such characters, with the
stable character before them as context, are normalised; everything else is copied unchanged.

Two forms come of it. The key (visible_form) serves to compare: in it every look-alike letter is one. The
delivered text (consistent_forms) keeps letters where they belong: letters of another script are changed only
inside a word that has Latin letters, and of Han and kana look-alikes nothing is changed in a text that no
other resembles. Texts of one key all get the same text, the one among them whose scripts mix least.

What a reader cannot see is levelled: width, composition of accents, characters without a glyph, the kind
of a space or of a line break, and the script of a look-alike letter. Case, accents, voicing marks,
raised, lowered or circled digits, small kana, spaces, line breaks and letter against digit stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import md5

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.joins import HOT_ROWS, hot_join
from ..session import cut
from ..sources.tables import table

# Letters of other scripts and the letter they look like.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ү": "Y", "Ѵ": "V", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Latin variants
    "Օ": "O", "օ": "o", "Տ": "S", "ɑ": "a", "ɡ": "g",
    # Roman numerals of one letter
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮥ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}

# Han characters and hiragana, and the katakana they look like.
KANA_ALIKE = {
    "力": "カ", "口": "ロ", "囗": "ロ", "工": "エ", "卜": "ト", "夕": "タ", "八": "ハ", "二": "ニ", "一": "ー", "丿": "ノ", "へ": "ヘ",
}

_ALIKE = LOOK_ALIKE | KANA_ALIKE
_SPACES = {"\t"}
_BREAKS = {"\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029"}
#: Format characters that do have a glyph, and fillers outside Cf that have none.
_VISIBLE_FORMAT = {chr(x) for x in (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)}
_NO_GLYPH = {chr(x) for x in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))}


def _single(char: str, alike: dict[str, str]) -> str:
    """The visible form of one character, before composition; alike: look-alike letters that become one."""
    kind = unicodedata.category(char)
    if char in _BREAKS:
        return "\n"
    if char in _SPACES or kind == "Zs":
        return " "
    if char in _NO_GLYPH or kind == "Cf" and char not in _VISIBLE_FORMAT or kind == "Cc" and char != "\n":
        return ""
    tag, _, rest = unicodedata.decomposition(char).partition(" ")
    if tag in ("<wide>", "<narrow>"):
        return _single(chr(int(rest, 16)), alike)
    if 0x2E80 <= ord(char) <= 0x2FD5 and tag == "<compat>":  # radicals
        return _single(chr(int(rest, 16)), alike)
    return "μ" if char == "µ" else alike.get(char, char)


@cache
def _tables(key: bool = True) -> tuple[dict[int, str], re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    """For the key, or the form without look-alikes: the mapping of changing characters; patterns of a run of them, of a joining mark, and of a run with its context."""
    mapped, maybe = {}, set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for code in (*range(0x3400), *range(0x4E00, 0xA000), *range(0xA640, 0xABFF), *range(0xF900, 0x10000), *range(0x10A00, 0x11A00), *range(0x1D100, 0x1D200), *range(0x1E000, 0x1EA00), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        full = unicodedata.normalize("NFD", char)
        form = unicodedata.normalize("NFC", "".join(_single(c, _ALIKE if key else {}) for c in full))
        if form != char:
            mapped[code] = form
        if unicodedata.combining(char):
            maybe.add(code)
        if len(full) > 1 and unicodedata.normalize("NFC", full) == char:
            maybe.add(ord(unicodedata.normalize("NFD", char)[-1]))
    maybe |= {k for k, form in mapped.items() if any(ord(c) in maybe for c in form)}
    plain = re.compile(f"(?:\r\n|[{_spans(k for k in mapped if k < 0x10000)}])+")
    hard = re.compile(f"[{_spans(k for k in maybe if k < 0x10000)}]")
    every = _spans(mapped.keys() | maybe)
    return mapped, plain, hard, re.compile(f"[^{every}]?(?:\r\n|[{every}])+")


def _spans(codes) -> str:
    """The inside of a character class."""
    ordered, out = sorted(codes), []
    first = ordered[0]
    for a, b in zip(ordered, [*ordered[1:], None]):
        if b != a + 1:
            out.append(f"\\U{first:08x}-\\U{a:08x}")
            first = b
    return "".join(out)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_known: dict[bool, dict[str, str]] = {True: {}, False: {}}


def _splicer(key: bool):
    known, mapping = _known[key], _tables(key)[0]

    def canonical(run: re.Match[str]) -> str:
        text = run.group()
        form = known.get(text)
        if form is None:
            mapped = text.replace("\r\n", "\n").translate(mapping)
            form = mapped if unicodedata.is_normalized("NFC", mapped) else unicodedata.normalize("NFC", mapped)
            if len(known) >= 200_000:
                known.clear()
            known[text] = form
        return form

    return canonical


@cache
def _normaliser(key: bool):
    _, plain, hard, full = _tables(key)
    canonical = _splicer(key)
    # Only where the text holds marks that may join the character before them, or characters beyond the
    # basic plane, do the runs need the context before them.
    return lambda text: (full if hard.search(text) or _ASTRAL.search(text) else plain).sub(canonical, text)


def visible_form(text: str) -> str:
    """The key of a text: the one form of all texts that look like it, to compare by."""
    if text.isascii() and text.isprintable():
        return text
    return _normaliser(True)(text)


_FOREIGN = re.compile(f"[{''.join(LOOK_ALIKE)}]")
_LETTERS = regex.compile(r"[\p{L}\p{M}\p{Nl}]+")
_LATIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ɏ]")
_TO_LATIN = str.maketrans(LOOK_ALIKE)


def clean_form(text: str) -> str:
    """text in one width, composition and kind of space, without what has no glyph; letters of other scripts
    become Latin inside words that have Latin letters. Everything a reader can name stays as it is."""
    if text.isascii() and text.isprintable():
        return text
    form = _normaliser(False)(text)
    if not _FOREIGN.search(form):
        return form
    return unicodedata.normalize("NFC", _LETTERS.sub(lambda m: m.group().translate(_TO_LATIN) if _LATIN.search(m.group()) else m.group(), form))


_KANA, _HAN_ONES = "".join(sorted({v for k, v in KANA_ALIKE.items() if k != "へ"})), "".join(k for k in KANA_ALIKE if k != "へ")
_MIXED = re.compile(f"[\u4e00-\u9fff][{_KANA}]|[{_KANA}][\u4e00-\u9fff]|[\u30a1-\u30fa][{_HAN_ONES}]|[{_HAN_ONES}][\u30a1-\u30fa]")


def mixing(form: str) -> int:
    """How often a look-alike of Han and katakana stands beside the other script, and letters of other scripts."""
    return len(_MIXED.findall(form)) + len(_FOREIGN.findall(form))


def fold_width(text: str) -> str:
    """text with full- and half-width characters in their usual width; nothing else changes."""
    if text.isascii():
        return text

    def usual(m: re.Match[str]) -> str:
        return unicodedata.normalize("NFKC", m.group()) if len(m.group()) > 1 else _usual_width(m.group())

    return _WIDTH.sub(usual, text)


_WIDTH = re.compile("[ｦ-ﾝ][ﾞﾟ]|[　！-￮]")


def _usual_width(char: str) -> str:
    tag, _, rest = unicodedata.decomposition(char).partition(" ")
    return chr(int(rest, 16)) if tag in ("<wide>", "<narrow>") else char


def with_visible_form(df: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """df with a column form, the key of text; null stays null."""
    if form in df.columns:
        raise ValueError(f"there is already a column {form}")
    schema = StructType([*df.schema.fields, StructField(form, StringType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if t is None else visible_form(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, form])

    return df.mapInArrow(run, schema)


def alike_pairs(records: DataFrame, block_rows: int = 5_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (table_name, id_a, id_b), id_a < id_b, of records of one table and document whose texts differ
    but have one visible form.

    records: table_name, record_id, document_id, text (other columns are ignored). Defined results: null
    texts and null documents form no pairs, empty texts are texts; repeated rows count once; equal texts
    form no pair; an empty table gives no rows. Groups are told apart by counts alone, so a form that
    most rows share costs one row per task until it is known to hold different texts; a group of more
    than block_rows rows is paired in blocks.
    """
    kept = records.where(F.col("text").isNotNull() & F.col("document_id").isNotNull() & F.col("record_id").isNotNull()).select("table_name", "record_id", "document_id", "text")
    keyed = with_visible_form(kept).select("table_name", "record_id", "document_id", F.unhex(F.md5("form")).alias("form_key"), F.unhex(F.md5("text")).alias("text_key"))
    keyed = cut(keyed)
    on = ["table_name", "document_id", "form_key"]
    groups = keyed.groupBy(*on, "text_key").agg(F.count(F.lit(1)).alias("n")).groupBy(*on).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).where(F.col("texts") > 1)
    groups = cut(groups.select(*on, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    members = cut(hot_join(keyed, groups, on, "inner", hot_rows).distinct())
    block = F.pmod(F.xxhash64("record_id"), F.col("blocks")).cast("int")
    a = members.select(*on, F.col("record_id").alias("id_a"), F.col("text_key").alias("text_a"), block.alias("block"))
    b = members.select(*on, F.col("record_id").alias("id_b"), F.col("text_key").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = a.join(b, [*on, "block"]).where((F.col("id_a") < F.col("id_b")) & (F.col("text_a") != F.col("text_b")))
    return pairs.select("table_name", "id_a", "id_b").distinct()


def alike_classes(records: DataFrame) -> DataFrame:
    """(table_name, document_id, record_id, class_id, n_records, n_links) of the records that look like another
    of a different text: their class, its size, and how many of its records have another text.

    The same links as alike_pairs, without a row for each; defined results as there. A record that occurs
    with several texts has the links of the text with most of them.
    """
    kept = records.where(F.col("text").isNotNull() & F.col("document_id").isNotNull() & F.col("record_id").isNotNull()).select("table_name", "record_id", "document_id", "text")
    keyed = cut(with_visible_form(kept).select("table_name", "record_id", "document_id", F.unhex(F.md5("form")).alias("form_key"), F.unhex(F.md5("text")).alias("text_key")).distinct())
    on = ["table_name", "document_id", "form_key"]
    texts = keyed.groupBy(*on, "text_key").agg(F.count(F.lit(1)).alias("n"))
    groups = keyed.groupBy(*on, "record_id").agg(F.count(F.lit(1)).alias("k")).groupBy(*on).agg(F.count(F.lit(1)).alias("n_records"), F.min("record_id").alias("class_id"))
    # Records of each text key, and those that another key of the same record holds as well, count once.
    several = texts.groupBy(*on).agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > 1)
    sized = cut(texts.join(several, on, "left_semi").join(groups, on))
    members = hot_join(keyed, sized, [*on, "text_key"], "inner")
    linked = members.withColumn("n_links", F.col("n_records") - F.col("n"))
    return linked.groupBy("table_name", "document_id", "record_id", "class_id").agg(F.max("n_records").alias("n_records"), F.max("n_links").alias("n_links")).where(F.col("n_links") > 0)


def consistent_forms(records: DataFrame) -> DataFrame:
    """(table_name, record_id, form, changed) of every text: its delivered form and whether that differs.

    Texts of one key get the clean form, among theirs, whose scripts mix least; of such the smallest.
    Defined results: null texts have none, empty ones an empty form; repeated rows count once; an empty
    table gives no rows. Keys are told apart by counts of hashes alone, so only the few texts that look
    like another travel.
    """
    rows = records.where(F.col("text").isNotNull()).select("table_name", "record_id", "text")
    schema = StructType([*rows.schema.fields, StructField("form", StringType()), StructField("key", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            forms = [clean_form(t) for t in texts]
            keys = [md5(visible_form(t).encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string()), pa.array(keys, pa.string())], names=schema.names)

    made = cut(rows.mapInArrow(run, schema))
    several = made.groupBy("key").agg(F.min(F.xxhash64("form")).alias("low"), F.max(F.xxhash64("form")).alias("high")).where(F.col("low") != F.col("high")).select("key")
    mixed = F.pandas_udf(lambda forms: forms.map(mixing), "int")
    few = hot_join(made.select("key", "form"), cut(several), ["key"], "left_semi").distinct()
    best = cut(few.groupBy("key").agg(F.min(F.struct(mixed("form").alias("mixing"), "form")).alias("b")).select("key", F.col("b.form").alias("best")))
    given = hot_join(made, best, ["key"], "left").withColumn("form", F.coalesce("best", "form"))
    return given.select("table_name", "record_id", "form", (F.col("form") != F.col("text")).alias("changed")).distinct()


def visible_records(spark: SparkSession, folder: str) -> DataFrame:
    evidence = table(spark, folder, "evidence").select(F.lit("evidence").alias("table_name"), F.col("evidence_id").alias("record_id"), "document_id", F.col("content.raw_text").alias("text"))
    units = table(spark, folder, "search_units").select(F.lit("search_units").alias("table_name"), F.col("search_unit_id").alias("record_id"), "document_id", F.col("text.search_text").alias("text"))
    return evidence.unionByName(units)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike_pairs(visible_records(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The records of p2_found's pairs, one row each, with their class and number of links."""
    return alike_classes(visible_records(spark, folder))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its consistent form, and whether that differs from the text."""
    return consistent_forms(visible_records(spark, folder))
