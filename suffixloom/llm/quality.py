"""Quality rules, lines first.

Each line with a word is judged by itself: it must have a sentence end, must not be a
row of menu entries, a notice that sites repeat everywhere, shouting, or symbol noise.
Failing lines are removed, and a document that loses too much of its text that way, is
too short or repeats itself is rejected.

Everything is a row-wise expression over native functions: no exchange, so neither hot
sources nor groups of copies matter, and a document never leaves its row.

Defined cases: a null or empty text has no words and fails; a repeated row is judged
again; further columns pass through, those named as an added column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RUN, bound, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if its failing lines hold more than this percentage of its words' characters.
MAX_LOSS_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^ \t\n\x0b\x0c\r]"
#: What a line of prose has: a sentence mark of any script, then closing quotes or brackets, then white
#: space or the end; or letters of Thai or Lao, which are written without sentence marks.
SENTENCE_END = r"[.!?…:;。！？．：；｡؟۔؛।॥։።။។‽]['\")\]»”’]*([ \t\x0b\x0c\r]|$)|[ก-๏ກ-ໝ]"
#: A row of menu entries has three separators and one in so many characters; shouting has three
#: doubled marks and one in so many characters, or no small letter.
MENU = r"(?:[|•·»›>][ \t][^|•·»›>]*){3}"
MENU_MARK, MENU_EVERY = r"[|•·»›>][ \t]", 40
SHOUT_MARKS = r"(?:[!?]{2}[^!?]*){3}"
SHOUT_MARK, SHOUT_EVERY = r"[!?]{2}", 120
SMALL_LETTER, CAPITAL = r"\p{Ll}", r"\p{Lu}"
SHOUT_LENGTH = 20
#: Phrases of notices that many sites repeat (fixed values); a line fails if they are more than
#: this percentage of its characters.
NOTICE_PERCENT = 25
BOILERPLATE = (
    "all rights reserved|cookie policy|cookies on this|accept cookies|privacy policy|terms of (use|service)|"
    "subscribe to our|sign up for|click here|enable javascript|lorem ipsum|powered by|share this|"
    "read more|log ?in to")


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more."""
    windows = bound(words, lambda w: F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(
            F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))

    def is_twin(rows):
        def test(e, i):
            same = lambda j: F.coalesce(F.get(rows, j)["h"] == e["h"], F.lit(False))
            return same(i - 1) | same(i + 1)
        return test

    def starts(win):
        placed = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.sort_array(F.transform(bound(placed, lambda rows: F.filter(rows, is_twin(rows))), lambda e: e["i"]))

    def covered(at):
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)

    return bound(windows, lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("bigint"))
                 .otherwise(bound(starts(win), covered)))


def symbols_in(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))


def taken_by(line: Column, pattern: str) -> Column:
    """Characters of the line that matches of the pattern take."""
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks one of the line rules, all of them but the first shares of the line."""
    small = F.lower(line)
    return (~line.rlike(SENTENCE_END)
            | (line.rlike(MENU) & (taken_by(line, MENU_MARK) * MENU_EVERY >= 2 * F.length(line)))
            | (line.rlike(SYMBOLS) & (symbols_in(line) * 10 > F.length(line)))
            | (line.rlike(SHOUT_MARKS) & (taken_by(line, SHOUT_MARK) * SHOUT_EVERY >= 2 * F.length(line)))
            | (~line.rlike(SMALL_LETTER) & line.rlike(CAPITAL) & (F.length(line) >= SHOUT_LENGTH))
            | (small.rlike(BOILERPLATE) & (taken_by(small, BOILERPLATE) * 100 > NOTICE_PERCENT * F.length(small))))


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` with the base figures ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words``, ``base_failed``, ``cleaned`` (the text without failing lines),
    ``lost_chars`` (characters of words on them) and the verdict ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    word_chars = lambda t: F.length(F.regexp_replace(t, SPACE_RUN, ""))

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        repeated_words(w).alias("n_repeat_words"))

    lines = F.split(text, "\n", -1)
    judged = F.transform(lines, lambda l: F.struct(
        l.alias("line"), l.rlike(HAS_WORD).alias("words"), (l.rlike(HAS_WORD) & line_fails(l)).alias("fails")))

    def of_lines(js):
        full = F.transform(F.filter(js, lambda j: j["words"]), lambda j: j["line"])
        good = F.transform(F.filter(js, lambda j: ~j["fails"]), lambda j: j["line"])
        lost = F.aggregate(F.filter(js, lambda j: j["fails"]), F.lit(0),
                           lambda s, j: s + word_chars(j["line"]))
        return F.struct(bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                        F.array_join(good, "\n").alias("cleaned"), lost.cast("long").alias("lost_chars"))

    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned",
             "lost_chars", "kept")
    own = [c for c in docs.columns if c not in added]
    parts = docs.select(
        F.struct(*own).alias("row"), bound(words_of(text), of_words).alias("w"), bound(judged, of_lines).alias("l"),
        symbols_in(text).cast("long").alias("n_symbols"))
    figures = parts.select("row", "w.*", "l.*", "n_symbols")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    loses = 100 * F.col("lost_chars") > MAX_LOSS_PERCENT * F.col("word_chars")
    return figures.select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          failed.alias("base_failed"), "cleaned", "lost_chars", (~failed & ~loses).alias("kept"))
