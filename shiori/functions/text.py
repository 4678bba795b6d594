"""Text functions: normal forms, the two tokenizers, snippets, field values."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The Japanese blocks of the two tokenizers.
JAPANESE_A = r"\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
JAPANESE_B = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}"
#: White space as Python's str.strip sees it, for Java patterns.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_SPACE = f"[^{SPACE[1:]}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC; null stays null."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def folded_text(text: str) -> str:
    """NFKC, then full case folding. ASCII texts need only be lowered."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def compatible_fold(texts: pd.Series) -> pd.Series:
    """folded_text as a column; null stays null."""
    return texts.map(lambda t: None if t is None else folded_text(t))


@F.pandas_udf(StringType())
def compatible_lower(texts: pd.Series) -> pd.Series:
    """NFKC, then lower case; null stays null."""
    return texts.map(lambda t: None if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower())


def strip(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def grams(run: Column, n: int) -> Column:
    """The n-grams of a run that has at least n characters."""
    return F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda k: F.substring(run, k, n))


def tokens_a(folded: Column) -> Column:
    """Script-run tokens of a folded text: words as w:, Japanese runs as 2- and 3-grams (j2:, j3:), single characters as j1:."""
    runs = F.regexp_extract_all(folded, F.lit(rf"[0-9a-zA-Z]+|[{JAPANESE_A}]+|[\p{{L}}\p{{N}}&&[^0-9a-zA-Z{JAPANESE_A}]]+"), F.lit(0))

    def of_run(run: Column) -> Column:
        marked = lambda n: F.transform(grams(run, n), lambda g: F.concat(F.lit(f"j{n}:"), g))
        japanese = F.when(F.length(run) == 1, F.array(F.concat(F.lit("j1:"), run))).when(F.length(run) == 2, marked(2)).otherwise(F.concat(marked(2), marked(3)))
        return F.when(run.rlike(f"^[{JAPANESE_A}]"), japanese).otherwise(F.array(F.concat(F.lit("w:"), run)))

    return F.flatten(F.transform(runs, of_run))


def tokens_b(lowered: Column) -> Column:
    """ASCII words first, then the 2-grams of Japanese runs; other letters are dropped."""
    words = F.regexp_extract_all(lowered, F.lit(r"[0-9A-Za-z_][0-9A-Za-z_.\-]*"), F.lit(0))
    runs = F.regexp_extract_all(lowered, F.lit(f"[{JAPANESE_B}]+"), F.lit(0))
    return F.concat(words, F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(grams(r, 2)))))


def _python(pattern: str, blocks: str) -> regex.Pattern[str]:
    """A pattern whose BLOCKS are Java's classes, for Python."""
    return regex.compile(pattern.replace("BLOCKS", regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), blocks)), regex.V1)


_RUNS_A = _python(r"[0-9a-zA-Z]+|([BLOCKS]+)|[[\p{L}\p{N}]--[0-9a-zA-ZBLOCKS]]+", JAPANESE_A)
_WORDS_B = regex.compile(r"[0-9A-Za-z_][0-9A-Za-z_.\-]*")
_RUNS_B = _python(r"[BLOCKS]+", JAPANESE_B)


def script_run_tokens(text: str) -> list[str]:
    """tokens_a of a text that isn't folded yet, in Python."""
    out = []
    for m in _RUNS_A.finditer(unicodedata.normalize("NFKC", text).casefold()):
        run = m.group()
        if m.group(1) is None:
            out.append("w:" + run)
        elif len(run) == 1:
            out.append("j1:" + run)
        else:
            out += ["j2:" + run[k : k + 2] for k in range(len(run) - 1)]
            out += ["j3:" + run[k : k + 3] for k in range(len(run) - 2)]
    return out


def word_pair_tokens(text: str) -> list[str]:
    """tokens_b of a text that isn't lowered yet, in Python."""
    low = unicodedata.normalize("NFKC", text).lower()
    out = _WORDS_B.findall(low)
    for run in _RUNS_B.findall(low):
        out += [run] if len(run) == 1 else [run[k : k + 2] for k in range(len(run) - 1)]
    return out


def _blocks(blocks: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, b in regex.findall(r"\\x\{([0-9a-f]+)\}(?:-\\x\{([0-9a-f]+)\})?", blocks)]


def word_pair_counts(texts: list[str | None]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How often each token of tokens_b occurs in each of the texts, which aren't lowered yet: the text of each
    entry in ascending order, its token, its count. Pairs are counted by their code points, all texts at once."""
    low = ["" if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).lower() for t in texts]
    # No run goes over the line break after each text.
    points = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in low])
    inside = np.zeros(len(points) + 1, bool)
    for first, last in _blocks(JAPANESE_B):
        inside[:-1] |= (points >= first) & (points <= last)
    at = np.flatnonzero(inside)
    pair = inside[at + 1]
    counted = pair | ~inside[at - 1]  # one character alone, or the first of two; the last place is outside
    at, pair = at[counted], pair[counted]
    token = np.where(pair, points[at] << 16 | points[at + pair], points[at])
    text = np.searchsorted(ends, at, "right")
    known: dict[str, int] = {}
    words, sizes = [], []
    for t in low:
        found = _WORDS_B.findall(t)
        sizes.append(len(found))
        words += [known.setdefault(w, len(known)) for w in found]
    names = list(known)
    # A word's number has a bit that no pair has: the blocks lie below 2 ** 16.
    word = np.repeat(np.arange(len(low)), sizes) << 33 | 1 << 32 | np.array(words, np.int64)
    every = np.sort(np.concatenate([text << 33 | token, word]))
    new = np.flatnonzero(np.diff(every, prepend=-1))
    codes, keys = pd.factorize(every[new] & (1 << 33) - 1)
    tokens = [names[k & 0xFFFFFFFF] if k >> 32 else chr(k >> 16) + chr(k & 0xFFFF) if k >> 16 else chr(k) for k in keys.tolist()]
    return every[new] >> 33, pa.array(tokens, pa.string()).take(pa.array(codes, pa.int64())), np.diff(new, append=len(every))


def without_space(folded: Column) -> Column:
    return F.regexp_replace(folded, SPACE, "")


def clip(text: Column, limit: int, mark: str = "…") -> Column:
    """text, or its first limit characters and a mark."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def field_values(text: Column) -> Column:
    """The distinct values after the first colon of each line, in order, stripped and not empty."""
    lines = F.filter(F.split(text, LINE_BREAK), lambda x: F.instr(x, ":") > 0)
    values = F.transform(lines, lambda x: strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def column_number(letters: Column) -> Column:
    """Number of a spreadsheet column from its letters; null if they aren't capital letters."""
    number = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(letters.rlike("^[A-Z]+$"), number)


def column_letters(number: Column) -> Column:
    """Letters of a spreadsheet column up to ZZZ."""
    n = number.cast("int") - 1
    one = lambda x: F.char(x % 26 + 65)
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.when(n < 26, one(n)).when(n < 702, F.concat(one(two), one(n))).otherwise(F.concat(one(three), one(two), one(n)))


def split_alternatives(cell: Column) -> Column:
    """The alternatives of a glossary cell, stripped and not empty."""
    return F.filter(F.transform(F.split(cell, "[,、/／・]"), strip), lambda x: x != "")


# Tags, and what says no more than not to know.
TAG = r"</?[A-Za-z][^>]{0,200}>"
UNKNOWN = r"^(?:わかりません|わからない|不明)[。．.]*$"


def plain_answer(text: Column, abstain: str = "わかりません") -> Column:
    """An answer without tags; the abstention for empty answers and those that say no more than not to know."""
    bare = strip(F.regexp_replace(F.coalesce(text, F.lit("")), TAG, ""))
    return F.when((bare == "") | bare.rlike(UNKNOWN), F.lit(abstain)).otherwise(bare)
