"""Keyword-stuffed and link-list pages (problem 9): a hidden Markov model over lines.

A text is cut into lines (at line breaks and sentence ends); each line gives a few categorical
observations: counts of character classes, grammar (function words, hiragana), and how much of its words the
page repeats throughout. Grammar is known of a few languages only, so in sentences of other languages and in
program code that observation is missing, which leaves the decision to the others. The hidden states are prose, record
(labelled values), title, code, link list, tag list and menu. The model starts from seed lines and is refined
on the hand-labelled pages by Baum-Welch, a page's label weighing for or against the three list states.
Viterbi decoding labels the lines; a page is flagged if links, tags and menus hold more than half of its
characters.

All counting is done on the code points of a whole batch of texts at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

STATES = ["prose", "record", "title", "code", "link", "tag", "menu"]
LISTS = np.array([s in ("link", "tag", "menu") for s in STATES])
#: Labelled pages the model is fitted on, at most (those with the smallest hashes), and the length of the longest.
LABELLED_PAGES = 2_000
LABELLED_CHARS = 20_000
ROUNDS = 6
#: Characters of a sentence that may stand alone, and of a title.
SHORT = 12
TITLE = 30
#: Weight of a seed line against an observed one, and of the list states in pages labelled as clean or spam.
SEED_WEIGHT = 20.0
CLEAN_FACTOR, SPAM_FACTOR = 0.03, 3.0

# Frequent function words of the western languages met here.
FUNCTION_WORDS = (
    "the a an of to in on at is are was were be been it its that this these and or but because before after by as with from until who nobody most about has have had will we they please not "
    "der die das dem den des ein eine einen ist sind war wurde werden und oder aber zum zur im am bei mit auf nach vor wegen falls für wir sie nicht noch wer es gab hat bis aus von um "
    "le la les un une est sont a à et ou mais que qui pour nous vous on sur au aux dans du des été il elle ne se si par après avant encore l d s"
).split()

# Lines as they typically look, by state.
SEED_LINES = {
    "prose": [
        "The committee met on Monday and agreed to review the budget before the end of the month.",
        "After the repair nobody knew who had to pay for the work.",
        "We will check the results again in the spring.",
        "会議では来月の予定を確認し、担当を決めることになった。",
        "詳しい内容は、後で資料を見てください。",
        "この問題については、まだ結論が出ていない。",
        "担当者から、手順が分かりにくいという意見があった。",
        "Die Abteilung hat den Bericht geprüft und am Freitag genehmigt.",
        "Nous avons revu le plan après la réunion de mardi.",
        "用語: 作業を始める前に、機械の状態を確かめること。",
        "valve: A part that opens and closes to control the flow of a liquid.",
    ],
    "record": ["name: bolt", "数量: 12", "品名: 台座", "日付: 2024-05-01", "price: 1,200", "状態: 完了", "Wert: 12.5", "AB-12: 台座", "date: 2023-11-02", "備考: 至急", "担当: 総務課"],
    "code": ["def total(rows):", "    return sum(r['n'] for r in rows)", "if (a == b) { count += 1; }", "x = load(path)", "for (int i = 0; i < n; i++) {", "}", "SELECT a, count(*) AS n"],
    "title": ["作業計画 v2", "Annual report", "品質記録", "Betriebsanleitung", "メモ 第3版", "Overview"],
    "link": [
        "cheap bolts https://shop.example/item/123",
        "» ボルト 通販 www.shop.example/p/99?ref=a",
        "[bolts sale](https://shop.example/c/5)",
        '<a href="https://shop.example/c/5">ボルト 安い</a> | <a href="https://shop.example/c/6">ナット 安い</a>',
        "https://shop.example/list/88",
        "/tag/1234.html bolts online",
        "ボルト 比較 ¥900 → https://shop.example/sale/7",
    ],
    "tag": [
        "#bolts#cheapbolts#boltsale#boltonline",
        "#ボルト通販＃ナット人気#ボルト最安値",
        "#cheapbolts, #boltsale, ＃boltonline, #nutrepair, #bestnut",
        "#ボルト通販 ＃ナット人気 #ボルト最安値、#ナット修理",
        "ボルト 通販、ナット 安い、ボルト 比較、ナット おすすめ",
        "cheap bolts, buy bolts online, bolts sale, best bolts, bolts repair",
        "tags: cheap bolts, buy bolts, bolts sale, best bolts, bolts 2024",
        "人気 ボルト ; ナット 通販 ; ボルト 買取 ; ナット 最安値",
        "ボルト 通販 ナット 人気 ボルト 安い",
        "ボルト通販ナット人気座金送料無料ボルト最安値。",
        "Cheap bolts best bolts bolts discount bolts sale repair bolts.",
        "The best bolts are the cheap bolts and our bolts are bolts for the bolts you need.",
        "If you want a pump then buy a pump because our pump is the best pump for a pump repair.",
        "We have bolts in the bolts shop and the bolts sale is on for bolts of all bolts.",
        "AB-123",
        "AB4567/X",
        "AB-123 AB-456 ボルト AB-789 AB-012 ナット",
        "ボルト／AB-123／AB-456／ナット／AB-789",
        "買取 ボルト",
        "ボルト 送料無料",
        "人気 ナット",
        "cheap bolts",
    ],
    "menu": ["Home | Products | About | Contact | Login", "ホーム > 製品 > 会社案内 > 採用", "Home ・ Sitemap ・ Cart ・ Login ・ About", "トップ | 製品 | お問い合わせ | カート | サイトマップ", "Home » Shop » Sale » Cart"],
}

_CLASS = np.zeros(0x10000, np.uint8)
_OTHER, _SPACE, _BREAK, _LATIN, _DIGIT, _HIRAGANA, _KATAKANA, _HAN, _END, _HARD, _SLASH, _COLON, _DOT, _SOFT, _HASH, _LETTER, _CODE = range(17)
for _first, _last, _kind in ((0x61, 0x7A, _LATIN), (0x41, 0x5A, _LATIN), (0xC0, 0x24F, _LATIN), (0xFF21, 0xFF3A, _LATIN), (0xFF41, 0xFF5A, _LATIN), (0x30, 0x39, _DIGIT), (0xFF10, 0xFF19, _DIGIT), (0x3041, 0x309F, _HIRAGANA), (0x30A0, 0x30FF, _KATAKANA), (0xFF66, 0xFF9F, _KATAKANA), (0x3400, 0x9FFF, _HAN), (0xF900, 0xFAFF, _HAN)):
    _CLASS[_first : _last + 1] = _kind
for _chars, _kind in ((" \t　 ", _SPACE), ("\n\r", _BREAK), ("。！？!?．।؟۔።։", _END), ("|｜>＞・･／»›•★☆→¥–—[]", _HARD), ("/", _SLASH), (":：", _COLON), (".", _DOT), (",、，;；", _SOFT), ("#＃", _HASH), ("(){}_=<*&\"\'", _CODE)):
    for _c in _chars:
        _CLASS[ord(_c)] = _kind

for _code in range(0xAA, 0x10000):
    if not _CLASS[_code] and unicodedata.category(chr(_code))[0] in "LM":
        _CLASS[_code] = _LETTER

_POWERS = np.cumprod(np.full(40, 1_000_003, np.uint64))


def _word_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    size = np.diff(np.r_[starts, len(codes)])
    place = np.arange(len(codes)) - np.repeat(starts, size)
    return np.add.reduceat(codes.astype(np.uint64) * _POWERS[np.minimum(place, 39)], starts)


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.unique([(np.array([ord(c) for c in w], np.uint64) * _POWERS[: len(w)]).sum() for w in words])


_FUNCTION = _hashes_of(FUNCTION_WORDS)
# Letters of the languages whose function words are listed; others tell of another language.
_COVERED = np.array([ord(c) for x in ("abcdefghijklmnopqrstuvwxyz", "äöüß", "àâæçéèêëîïôœùûÿ") for c in x + x.upper() if len(c) == 1])
# Frequent Chinese characters that Japanese does not write.
_CHINESE = np.array([ord(c) for c in "们这吗呢吧很还没过从对为个时说请让谁您你她它們這嗎還個請讓誰妳"])
#: Number of values of each observation; the last of grammar and of separators means that it is missing.
LEVELS = [12, 3, 5, 4, 4, 6, 4, 4, 4, 2, 2]
MISSING = {0: 11, 2: 4}
#: A word is repeated throughout if it occurs so often and makes up so much of a page's words.
OFTEN, MUCH = 4, 0.2
#: Least share of different words in sentences of languages whose grammar is not known.
DIVERSE = 0.8


def observe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, observations, characters without spaces) of each line of the texts that has any."""
    joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    codes = np.r_[joined, np.uint32(10)]
    kind = _CLASS[np.minimum(codes, 0xFFFF)]
    after = np.r_[kind[1:], np.uint8(_BREAK)]
    latin_stop = ((kind == _DOT) | (codes == 33) | (codes == 63)) & ((after == _SPACE) | (after == _BREAK))
    ends = (kind == _BREAK) | latin_stop | (kind == _END) & (codes > 127) & (after != _END)
    # A sentence too short to tell anything stays with the one before it.
    solid = np.cumsum(np.r_[0, (kind != _SPACE) & (kind != _BREAK)])
    stops = np.flatnonzero(ends)
    short = solid[stops[1:] + 1] - solid[stops[:-1] + 1] < SHORT
    ends[stops[:-1][short & (kind[stops[:-1]] != _BREAK)]] = False
    line = np.cumsum(np.r_[False, ends[:-1]])
    n = int(line[-1]) + 1
    count = np.bincount(line * 17 + kind, minlength=17 * n).reshape(n, 17)
    width = count.sum(axis=1) - count[:, _SPACE] - count[:, _BREAK]
    text_of = np.repeat(np.arange(len(texts)), sizes)[np.flatnonzero(np.r_[True, ends[:-1]])]
    # Words: runs of letters of one class. Function words among western ones; others are content.
    letters = np.flatnonzero((kind == _LATIN) | (kind == _LETTER) | (kind == _KATAKANA) | (kind == _HAN))
    lower = codes[letters]
    lower = np.where((lower >= 65) & (lower <= 90) | (lower >= 0xC0) & (lower <= 0xDE) & (lower != 0xD7), lower + 32, lower)
    words = function = contents = repeated = np.zeros(n, np.int64)
    known_share = different = np.zeros(len(texts))
    if len(letters):
        starts = np.flatnonzero(np.r_[True, (np.diff(letters) > 1) | (np.diff(kind[letters]) != 0)])
        where, kinds, hashes = line[letters[starts]], kind[letters[starts]], _word_hashes(lower, starts)
        latin = kinds == _LATIN
        words = np.bincount(where[latin], minlength=n)
        known = latin & np.isin(hashes, _FUNCTION)
        function = np.bincount(where[known], minlength=n)
        page = text_of[where]
        known_share = np.bincount(page[known], minlength=len(texts)) / np.maximum(np.bincount(page[latin], minlength=len(texts)), 1)
        content = ~known & (np.diff(np.r_[starts, len(letters)]) >= np.where((kinds == _KATAKANA) | (kinds == _HAN), 2, 3))
        _, number, times = np.unique(hashes[content] ^ page[content].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
        total = np.bincount(page[content], minlength=len(texts))
        often = times[number]
        different = np.bincount(page[content], 1.0 / often, len(texts)) / np.maximum(total, 1)
        hot = (often >= OFTEN) & (often >= MUCH * total[page[content]])
        contents = np.bincount(where[content], minlength=n)
        repeated = np.bincount(where[content][hot], minlength=n)
    cjk = count[:, _HIRAGANA] + count[:, _KATAKANA] + count[:, _HAN]
    size = np.maximum(width, 1)
    east = (cjk >= count[:, _LATIN]) & (cjk >= count[:, _LETTER])
    share = np.where(east, count[:, _HIRAGANA] / np.maximum(cjk, 1), function / np.maximum(words, 1))
    level = np.where(east, np.searchsorted([0.001, 0.1, 0.2, 0.3], share, "right"), np.searchsorted([0.001, 0.13, 0.22, 0.36], share, "right"))
    grammar = np.where(cjk + count[:, _LATIN] + count[:, _LETTER] == 0, 10, level + np.where(east, 0, 5))
    # A colon before a slash belongs to an address; one near the start of a line ends a label.
    scheme = np.bincount(line[(kind == _COLON) & (after == _SLASH)], minlength=n)
    colons = np.flatnonzero((kind == _COLON) & (after != _SLASH))
    first_of_line = np.flatnonzero(np.r_[True, np.diff(line) > 0])
    label = np.zeros(n, bool)
    label[line[colons[colons - first_of_line[line[colons]] <= 24]]] = True
    link = np.where((scheme > 0) | (count[:, _SLASH] >= 2) & (count[:, _DOT] > 0), 2, (count[:, _SLASH] > 0).astype(int))
    equals = np.bincount(line[codes == 61], minlength=n)
    hard = np.searchsorted([1e-9, 0.03, 0.08], (count[:, _HARD] + count[:, _HASH] + equals) / size, "right")
    soft = np.searchsorted([1e-9, 0.045, 0.075], count[:, _SOFT] / size, "right")
    stop = np.bincount(line[latin_stop | (kind == _END)], minlength=n) > 0
    commas = count[:, _SOFT] >= 3
    shape = np.where(stop & ~(label & commas), 1, np.where(label & commas, 3, np.where(label, 2, 0)))
    length = np.searchsorted([7, 15, 31, 61, 121], width, "right")
    digits = np.searchsorted([1e-9, 0.15, 0.35], count[:, _DIGIT] / size, "right")
    gaps = np.where(east, np.searchsorted([1e-9, 0.08], count[:, _SPACE] / size, "right"), 3)
    repeats = np.where(repeated == 0, 0, 1 + np.searchsorted([0.25, 0.45], repeated / np.maximum(contents, 1), "right"))
    # Sentences of other languages: no separators, no links, different words; and code, of which marks tell.
    plain = (hard == 0) & (link == 0) & (soft <= 2) & (repeats == 0)
    uncovered = np.bincount(text_of[line[(kind == _LATIN) & ~np.isin(codes, _COVERED)]], minlength=len(texts))
    chinese_text = np.bincount(text_of[line[np.isin(codes, _CHINESE)]], minlength=len(texts))
    diverse = different[text_of] >= DIVERSE
    strange = count[:, _LETTER] > np.maximum(cjk, count[:, _LATIN])
    western = ~east & (known_share[text_of] < 0.1) & (uncovered[text_of] > 0) & stop & (words >= 3)
    chinese = east & (count[:, _HIRAGANA] + count[:, _KATAKANA] == 0) & (count[:, _HAN] >= 8) & (chinese_text[text_of] > 0) & stop & (count[:, _SPACE] <= 1)
    marks = count[:, _CODE]
    code = (marks >= 2) & (marks >= 0.05 * size) & (link < 2) & (count[:, _HASH] <= 1) & (cjk == 0)
    unknown = plain & diverse & (strange | western | chinese)
    grammar = np.where(unknown | code, MISSING[0], grammar)
    shape = np.where(unknown & strange & (width >= 20), 1, shape)  # some scripts don't mark the end of a sentence
    hard = np.where(code, MISSING[2], hard)
    seen = np.stack([grammar, link, hard, soft, shape, length, digits, gaps, repeats, code.astype(np.int64)], axis=1)
    text = text_of
    some = width > 0
    text, seen, width = text[some], seen[some], width[some]
    alone = (np.bincount(text, minlength=len(texts))[text] == 1) & (width <= TITLE)
    return text, np.c_[seen, alone.astype(np.int64)], width


class LineModel:
    """Start, transition and emission probabilities (as logarithms)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, k]] for k, table in enumerate(self.emit)).T

    def decode(self, text: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The most probable state of each line; all texts advance together, longest first."""
        if not len(text):
            return np.zeros(0, np.int64)
        score = self.scores(seen)
        first = np.flatnonzero(np.r_[True, np.diff(text) > 0])
        size = np.diff(np.r_[first, len(text)])
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        best = self.start + score[first]
        back = np.zeros((len(text), len(STATES)), np.int8)
        final = np.zeros_like(best)
        for step in range(1, int(size[0])):
            alive = int(np.searchsorted(-size, -step, "left"))
            final[alive : len(best)] = best[alive:]
            best = best[:alive]
            ways = best[:, :, None] + self.move
            back[first[:alive] + step] = ways.argmax(axis=1)
            best = ways.max(axis=1) + score[first[:alive] + step]
        final[: len(best)] = best
        state = np.zeros(len(text), np.int64)
        now = final.argmax(axis=1)
        for step in range(int(size[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-size, -step, "left"))
            at = first[:alive] + step
            state[at] = now[:alive]
            if step:
                now[:alive] = back[at, now[:alive]]
        return state


def _from_counts(start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> LineModel:
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    made = [log(e if f not in MISSING else e[:, : MISSING[f]]) for f, e in enumerate(emit)]
    for f in MISSING:
        made[f] = np.c_[made[f], np.zeros(len(made[f]))]  # a missing observation favours no state
    return LineModel(log(start), log(move), made)


def fit(pages: list[tuple[str, int]]) -> LineModel:
    """A model from the seed lines and labelled pages (text, 1 for spam)."""
    states = len(STATES)
    emit0 = [np.full((states, n), 0.5) for n in LEVELS]
    for k, name in enumerate(STATES):
        _, seen, _ = observe(SEED_LINES[name])
        seen[:, -1] = name == "title"  # only titles usually make a page of one line
        for f, table in enumerate(emit0):
            table[k] += SEED_WEIGHT * np.bincount(seen[:, f], minlength=LEVELS[f])
    # A title stands alone or leads into something else; every other kind of line goes on.
    stay = np.array([0.9, 0.93, 0.05, 0.93, 0.9, 0.93, 0.9])
    move0 = np.full((states, states), 1.0)
    move0[:, STATES.index("title")] = 0.5
    move0[np.arange(states), np.arange(states)] = 0
    move0 = move0 / move0.sum(axis=1, keepdims=True) * (1 - stay)[:, None] + np.diag(stay)
    start0 = np.array([0.5, 0.14, 0.14, 0.02, 0.07, 0.07, 0.06])
    model = _from_counts(start0, move0, emit0)
    if not pages:
        return model
    text, seen, _ = observe([t for t, _ in pages])
    if not len(text):
        return model
    lean = np.log(np.where(LISTS, np.where(np.array([y for _, y in pages])[:, None] == 1, SPAM_FACTOR, CLEAN_FACTOR), 1.0))
    bounds = np.flatnonzero(np.r_[True, np.diff(text) > 0, True])
    one_hot = [np.eye(n)[seen[:, f]] for f, n in enumerate(LEVELS)]
    for _ in range(ROUNDS):
        score = model.scores(seen) + lean[text]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        start, move, weight = np.zeros(states), np.zeros((states, states)), np.zeros((len(text), states))
        step = np.exp(model.move)
        for a, b in zip(bounds, bounds[1:]):
            ahead = np.empty((b - a, states))
            now = np.exp(model.start) * score[a]
            ahead[0] = now / now.sum()
            for t in range(1, b - a):
                now = (ahead[t - 1] @ step) * score[a + t]
                ahead[t] = now / now.sum()
            behind = np.ones(states)
            for t in range(b - a - 1, -1, -1):
                both = ahead[t] * behind
                weight[a + t] = both / both.sum()
                if t:
                    arrive = score[a + t] * behind
                    pair = ahead[t - 1][:, None] * step * arrive
                    move += pair / pair.sum()
                    behind = step @ arrive
                    behind /= behind.sum()
            start += weight[a]
        weight[:, STATES.index("code")] = 0  # code keeps what its seeds say: no labelled page need hold any
        model = _from_counts(20 * start0 + start, 200 * move0 + move, [e0 + weight.T @ hot for e0, hot in zip(emit0, one_hot)])
    return model


def list_share(texts: list[str | None], model: LineModel) -> tuple[np.ndarray, np.ndarray]:
    """(characters in link, tag and menu lines, all characters) of each text, spaces left out."""
    filled = [t or "" for t in texts]
    text, seen, width = observe(filled)
    lists = LISTS[model.decode(text, seen)] if len(text) else np.zeros(0, bool)
    return np.bincount(text, width * lists, minlength=len(texts)), np.bincount(text, width, minlength=len(texts))


def labelled_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most LABELLED_PAGES labelled pages of up to LABELLED_CHARS characters, in a fixed order."""
    once = labels.where(F.col("doc_id").isNotNull() & F.col("is_spam").isNotNull()).groupBy("doc_id").agg(F.max("is_spam").alias("is_spam"))
    few = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_PAGES)
    pages = documents.where(F.length("text") <= LABELLED_CHARS).join(F.broadcast(few), "doc_id").select("doc_id", "text", "is_spam")
    return [(r["text"], r["is_spam"]) for r in sorted(pages.collect(), key=lambda r: (r["doc_id"], r["text"]))]


def flag_spam(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_list_chars, n_chars, list_share, is_spam) of each document.

    documents: doc_id, text; labels: doc_id, is_spam. Defined results: null and empty texts are no spam;
    repeated rows count once, of different texts of one doc_id the one of the larger share counts;
    without labels the model is that of the seed lines; an empty table gives no rows.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    model = fit(labelled_sample(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                lists, every = list_share(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists.astype(np.int64)), pa.array(every.astype(np.int64))], names=["doc_id", "n_list_chars", "n_chars"])

    counted = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_list_chars long, n_chars long")
    share = F.when(F.col("n_chars") > 0, F.col("n_list_chars") / F.col("n_chars")).otherwise(0.0)
    once = counted.withColumn("list_share", share).groupBy("doc_id").agg(F.max(F.struct("list_share", "n_list_chars", "n_chars")).alias("r"))
    return once.select("doc_id", "r.n_list_chars", "r.n_chars", "r.list_share", (F.col("r.list_share") > 0.5).alias("is_spam"))


def p9_pages(spark: SparkSession, folder: str) -> DataFrame:
    return flag_spam(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "page_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pages(spark, folder).where("is_spam").select("doc_id")
