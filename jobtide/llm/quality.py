"""Line-first cleaning of documents, in DataFrame functions only.

Lines that fail are taken out, and a document that loses too much of its text with them is
rejected. A line of several words in which no sentence ends passes if it leads, over such lines
only, to one in which one does: so hard-wrapped prose stays, and lists of titles go. Sentences
end as each script has it. Repetition inside a document is judged by sorting
the hashes of its three-word windows, so no row leaves its task: there is no shuffle.

Defined results: a null text has no words and is rejected; so is an empty one. Equal rows
get equal verdicts. An empty table gives an empty table. Result
columns replace columns of the same names; working columns carry a prefix.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.columns import only_kept

NOT_SPACE = "[^ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"
# A full stop, mark or ellipsis before a blank; the marks of other scripts, which need none; and
# for Thai and Lao, which have none, a long stretch of letters.
PLAIN_SENTENCE = "[.!?][\"')\\]]*([ \\t-\\r]|$)"
SENTENCE = ("[.!?…][\"'»”)\\]]*([ \\t-\\r]|$)"
            "|[\u0964\u0965\u06d4\u061f\u3002\uff0e\uff61\uff01\uff1f\u1362\u1367\u1368\u0589\u17d4\u17d5\u104b"
            "\u0f0d\u1803\u1809\u0df4]|[\u0e01-\u0eff]{20}")
# Four words, or as much of a script without blanks.
SEVERAL_WORDS = "([^ \\t-\\r]+[ \\t-\\r]+){3}[^ \\t-\\r]|[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff]{12}"
# The upper half of a 64-bit hash; a place in an array fits the lower one.
HALF = -1 << 32
# Kinds of lines from the last to the first: lines that go on in later ones up to the end of a
# sentence follow a 2, or one such line after another.
CONTINUED = r"(?<=2)1|(?!^)\G1"

# Phrases that mark a line as page furniture and not as text.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum",
    "privacy policy", "subscribe to our newsletter", "terms of service", "terms of use",
]
PHRASES = "(" + "|".join(BOILERPLATE) + ")"
# The phrase as a sentence of its own.
ALONE = f"(^|[.!?|\u2026] *|^ +){PHRASES} *([.!?|\u2026]|$)"
# Phrases mark a line of which they are so large a part, or as a sentence so large a part.
PHRASE_SHARE, ALONE_SHARE = 1 / 8, 1 / 20

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "cleaned_text", "base_failed", "kept"]
WORKING = ["_q_hashes", "_q_halves", "_q_windows", "_q_places"]


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once however often it is used above.

    Without the one-element explode the optimizer would copy a costly expression into
    every place, and into lambda bodies, where it would run once per element.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return (df.withColumn("_q_once", F.explode(F.array(packed)))
            .select(*[c for c in df.columns], "_q_once.*"))


def _repeated_words(words: str) -> tuple[list[dict], Column]:
    """Steps that count the words lying in a three-word window that occurs twice.

    Half of each window's hash and its place make one whole number, and such numbers sort
    fast; windows with a neighbour of the same half are few, and of these the whole hashes
    are sorted with their places, so that equal windows are neighbours. Of the places that
    have an equal neighbour, each adds three words, less what the next one shares with it.
    """
    w = F.col(words)
    hashes = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        1, F.greatest(F.size(w) - 2, F.lit(0)))
    h = F.col("_q_hashes")
    halves = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(HALF).bitwiseOR(i.cast("long"))))
    k = F.col("_q_halves")

    def same_half(x, y):
        return F.coalesce(x.bitwiseXOR(y).bitwiseAND(HALF) == 0, F.lit(False))

    near = F.filter(k, lambda x, i: same_half(x, F.get(k, i + 1)) | same_half(x, F.get(k, i - 1)))
    windows = F.transform(near, lambda x: x.bitwiseAND(~HALF).cast("int"))
    s = F.col("_q_windows")
    twice = F.filter(F.transform(s, lambda x, i: F.when(
        (x.h == F.get(s, i + 1).h) | (x.h == F.get(s, i - 1).h), x.i)), lambda p: p.isNotNull())
    p = F.col("_q_places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    steps = [
        {"_q_hashes": hashes}, {"_q_halves": halves},
        {"_q_windows": F.sort_array(F.transform(windows, lambda i: F.struct(
            F.get(h, i).alias("h"), i.alias("i"))))},
        {"_q_places": F.sort_array(twice)}]
    return steps, covered


def _has_furniture(text: Column) -> Column:
    # through an array of one, so that the text is lower-cased once and not for each phrase
    return F.exists(F.array(F.lower(text)), lambda lowered: reduce(
        Column.__or__, [F.contains(lowered, F.lit(phrase)) for phrase in BOILERPLATE]))


def _is_furniture(line: Column) -> Column:
    """Whether boilerplate phrases make up a good part of the line, and are not just mentioned."""
    lowered = F.lower(line)
    size = F.length(lowered)
    phrases = size - F.length(F.regexp_replace(lowered, F.lit(PHRASES), F.lit("")))
    alone = (phrases >= ALONE_SHARE * size) & F.rlike(lowered, F.lit(ALONE))
    return _has_furniture(line) & ((phrases >= PHRASE_SHARE * size) | alone)


def line_kind(line: Column, max_symbols: float = 0.1, furniture: Column | None = None) -> Column:
    """2: a sentence ends in the line; 1: several words without an end; 0: it fails by itself.

    It fails by navigation, boilerplate or noise: three or more of ``|``; too many symbols;
    shouted (no lower-case letter, ending in ``!!``); boilerplate phrases as a good part of
    it, which are only looked for where ``furniture`` holds; or a few words that are no sentence.
    """
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouted = (F.contains(line, F.lit("!!")) & F.rlike(line, F.lit("!![ \\t-\\r]*$"))
               & (line == F.upper(line)))
    phrase = _is_furniture(line)
    if furniture is not None:
        phrase = furniture & phrase
    pipes = F.contains(line, F.lit("|")) & F.rlike(line, F.lit("[|][^|]*[|][^|]*[|]"))
    noise = (symbols > max_symbols * F.length(line)) | pipes | shouted | phrase
    # most sentences end in ASCII marks, which the short pattern finds sooner
    ended = F.rlike(line, F.lit(PLAIN_SENTENCE)) | F.rlike(line, F.lit(SENTENCE))
    return (F.when(noise, "0").when(ended, "2")
            .when(F.rlike(line, F.lit(SEVERAL_WORDS)), "1").otherwise("0"))


def passing_lines(lines: Column, furniture: Column | None = None) -> Column:
    """For each of ``lines``, with the blank ones, "2" if it passes."""
    kinds = F.array_join(F.transform(lines, lambda x: line_kind(x, furniture=furniture)), "")
    back = F.regexp_replace(F.reverse(kinds), F.lit(CONTINUED), F.lit("2"))
    return F.split(F.reverse(back), "")


def judge_quality(
    docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: float = 0.5,
    max_lost: float = 0.5,
) -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``cleaned_text`` and ``kept``.

    ``kept`` is false for a text under ``min_words`` words, one with more than
    ``max_repeat`` of its words in repeated windows, and one that loses more than
    ``max_lost`` of the characters of its lines with those that fail.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = _barrier(
        docs.drop(*RESULTS),
        _q_words=F.filter(F.split(body, "[ \\t-\\r]+"), lambda x: x != ""),
        _q_every=F.split(body, "\n"),
        _q_furniture=_has_furniture(body),
        n_symbols=F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
    lined = _barrier(
        split, _q_pass=passing_lines(F.col("_q_every"), F.col("_q_furniture")),
        _q_lines=F.filter("_q_every", lambda x: F.rlike(x, F.lit(NOT_SPACE))))
    (hashes, *steps), covered = _repeated_words("_q_words")
    counted = _barrier(
        lined, **hashes,
        n_words=F.size("_q_words").cast("long"),
        word_chars=F.length(F.array_join("_q_words", "")).cast("long"),
        n_dup_lines=(F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        _q_chars=F.length(F.array_join("_q_lines", "\n")),
        cleaned_text=F.array_join(F.filter(
            "_q_every", lambda line, i: F.get(F.col("_q_pass"), i) == "2"), "\n"))
    counted = counted.drop("_q_words", "_q_lines", "_q_every", "_q_pass", "_q_furniture")
    for step in steps:
        counted = _barrier(counted, **step)
    counted = _barrier(counted, n_repeat_words=covered).drop(*WORKING)
    failed = ((F.col("n_words") < min_words)
              | (F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    lost = (F.col("_q_chars") - F.length("cleaned_text")) > max_lost * F.col("_q_chars")
    return (counted.withColumn("base_failed", failed)
            .withColumn("kept", ~failed & ~lost).drop("_q_chars"))


def drop_low_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    return only_kept(docs, text, lambda d: judge_quality(d, text), "kept")
