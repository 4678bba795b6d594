"""Splitting oversized texts at natural boundaries (problem 1).

Lexical cohesion: the words of the sentences before and after each gap are compared (blocks of
BLOCK sentences, cosine); a gap's depth is how far its similarity lies below the peaks on either side.
Within each size window, behind the length of an overlap, the cut goes to the deepest valley, the last of
equal ones. A sentence longer than the window is first
cut at clauses, then at spaces, then between grapheme clusters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

LIMIT = 1_200
OVERLAP = 150
BLOCK = 4

_SENTENCE = re.compile(r"[^。．！？!?.\n]*(?:[。．！？!?]+[」』）)\]\"'”’]*[ \t\u3000]*|\.+(?=\s|$)[ \t\u3000]*|\.|\n\s*|$)")
_CLAUSE = re.compile(r"[^、，,;；:：|]*(?:[、，,;；:：|]+\s*|$)")
_SPACE = re.compile(r"\S*(?:\s+|$)")
_WORD = re.compile(r"[0-9a-zÀ-ɏ]+|[\u30a0-\u30ff]+|[\u3400-\u9fff\uf900-\ufaff]+")
_CLUSTER = regex.compile(r"\X")

PIECE_SCHEMA = "table_name string, record_id string, document_id string, locator string, piece_no int, start int, end int, piece_text string"


def _atoms(text: str, size: int) -> list[int]:
    """Ends of the smallest natural parts, none longer than size where a finer boundary exists."""
    ends: list[int] = []

    def add(start: int, stop: int, rules: tuple) -> None:
        if stop - start <= size or not rules:
            ends.append(stop)
            return
        at = start
        for m in rules[0].finditer(text, start, stop):
            if m.end() > at:
                add(at, m.end(), rules[1:])
                at = m.end()
        if at < stop:
            add(at, stop, rules[1:])

    at = 0
    for m in _SENTENCE.finditer(text):
        if m.end() > at and (m.end() == len(text) or not _joins(text[m.end()])):
            add(at, m.end(), (_CLAUSE, _SPACE, _CLUSTER))
            at = m.end()
    if at < len(text):
        add(at, len(text), (_CLAUSE, _SPACE, _CLUSTER))
    return ends


def _joins(char: str) -> bool:
    """Whether char belongs to the cluster before it."""
    return unicodedata.combining(char) != 0 or char == "\u200d" or "\ufe00" <= char <= "\ufe0f"


def _words(part: str) -> Counter:
    out: Counter = Counter()
    for w in _WORD.findall(part.lower()):
        if w[0] < "\u3400" or len(w) < 3:
            out[w] += 1
        else:
            out.update(w[k : k + 2] for k in range(len(w) - 1))
    return out


def cohesion_depths(parts: list[Counter], block: int = BLOCK) -> list[float]:
    """Depth of the valley at the gap after each part; the last part has none."""
    n = len(parts)
    if n < 2:
        return []
    left, right = Counter(), Counter()
    for part in parts[1 : 1 + block]:
        right.update(part)
    left.update(parts[0])
    sims = []
    for gap in range(n - 1):
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(v * large[w] for w, v in small.items() if w in large)
        size = sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        sims.append(dot / size if size else 0.0)
        left.update(parts[gap + 1])
        right.subtract(parts[gap + 1])
        if gap + 1 >= block:
            left.subtract(parts[gap + 1 - block])
        if gap + 1 + block < n:
            right.update(parts[gap + 1 + block])
        left, right = +left, +right
    up, peak = [0.0] * len(sims), [0.0] * len(sims)
    for order, out in ((range(len(sims)), up), (range(len(sims) - 1, -1, -1), peak)):
        top = before = None
        for k in order:  # the peak is where the climb away from the gap ends
            top = sims[k] if before is None or sims[k] >= before else top
            out[k], before = top, sims[k]
    return [a + b - 2 * s for a, b, s in zip(up, peak, sims)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text: each at most limit long, each but the first beginning overlap
    characters before the end of the one before. Texts within the limit are one piece; '' is none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    step = limit - overlap
    ends = _atoms(text, max(1, step // 2))
    starts = [0, *ends[:-1]]
    depths = cohesion_depths([_words(text[a:b]) for a, b in zip(starts, ends)], block)
    pieces, done, k, room = [], 0, 0, limit
    while len(text) - done > room:
        best = last = None
        while k < len(ends) and ends[k] <= done + room:
            if ends[k] > done:
                last = k
                if ends[k] - done > overlap and (best is None or depths[k] >= depths[best]):
                    best = k
            k += 1
        cut = ends[best if best is not None else last] if last is not None else done + room
        pieces.append((max(0, done - overlap) if pieces else 0, cut))
        while k and ends[k - 1] > cut:
            k -= 1
        done, room = cut, step
    pieces.append((max(0, done - overlap) if pieces else 0, len(text)))
    return pieces


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for name, record, document, locator, text in zip(*[c.to_pylist() for c in batch.columns]):
                for no, (start, end) in enumerate(split_text(text, limit, overlap)):
                    for column, value in zip(rows, (name, record, document, locator, no, start, end, text[start:end])):
                        column.append(value)
            types = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return run


def split_oversized(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every record whose text is longer than limit code points.

    records: table_name, record_id, document_id, locator, text (other columns are ignored). Defined
    results: null and short texts have no pieces; repeated rows of one record count once, and of
    different texts of one record the largest in order counts; a null locator or document stays null;
    an empty table gives no rows.
    """
    long = records.where(F.length("text") > limit)
    once = long.groupBy("table_name", "record_id").agg(F.max(F.struct("text", "document_id", "locator")).alias("r"))
    rows = once.select("table_name", "record_id", "r.document_id", "r.locator", "r.text")
    return rows.mapInArrow(_split_batches(limit, overlap), PIECE_SCHEMA)


def text_records(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of evidence and search units with their ids and locators (as JSON)."""
    evidence = table(spark, folder, "evidence").select(F.lit("evidence").alias("table_name"), F.col("evidence_id").alias("record_id"), "document_id", F.to_json("location").alias("locator"), F.col("content.raw_text").alias("text"))
    units = table(spark, folder, "search_units").select(F.lit("search_units").alias("table_name"), F.col("search_unit_id").alias("record_id"), "document_id", F.to_json("locator").alias("locator"), F.col("text.search_text").alias("text"))
    return evidence.unionByName(units)


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(text_records(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where(F.col("piece_no") == 0).select("table_name", "record_id")


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, record_id, n_chars, text_md5) of the pieces of each oversized text put together again, each
    piece after the first without the OVERLAP characters that it repeats; only if every piece is in its
    limit and repeats what it should."""
    pieces = p1_pieces(spark, folder)
    item = F.struct("piece_no", "start", "end", "piece_text")
    each = pieces.groupBy("table_name", "record_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    bare = F.transform("p", lambda x, k: F.when(k == 0, x["piece_text"]).otherwise(F.substring(x["piece_text"], F.lit(OVERLAP + 1), F.lit(LIMIT))))
    repeats = F.transform("p", lambda x, k: (F.length(x["piece_text"]) <= LIMIT) & (x["piece_no"] == k) & ((k == 0) | (F.right(F.get("p", k - 1)["piece_text"], F.lit(OVERLAP)) == F.left(x["piece_text"], F.lit(OVERLAP)))))
    text = F.when(F.forall(repeats, lambda x: x), F.array_join(bare, ""))
    return each.select("table_name", "record_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))
