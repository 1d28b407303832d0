import re
from collections import Counter

import duckdb

from jobtide.llm.oracles import OP10
from jobtide.llm.quality import drop_low_quality, judge_quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def seen(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)


PROSE = " ".join(f"word{i}" for i in range(60)) + "."


def test_counts_against_brute_force(spark):
    texts = [None, "", " ", "\n\n", "a b c a b c", "a " * 49 + "a", PROSE, PROSE + "\n" + PROSE, "x\u00a0y é漢 #*$%&|<>",
             "one\ntwo\none\n one\n\n\none", "\t\x0b\x0c a\r\nb\r\nb\r\n", "a b a b a b a", "p q r s p q r",
             "long " * 30_000 + "end.", "é" * 5000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[4])] * 2, "doc_id long, text string")
    rows = judge_quality(table).collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        assert seen(row) == brute(row.text), row.text


def verdicts(spark, *texts):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.kept for r in judge_quality(table).orderBy("doc_id").collect()]


def test_verdicts(spark):
    menu = "Home | News | Sport | Weather | About\n"
    shouted = " ".join(f"WORD{i}!!" for i in range(60))
    noise = " ".join(f"word{i}***" for i in range(60)) + "."
    bare = " ".join(f"word{i}" for i in range(60))
    legal = "All rights reserved. " + " ".join(f"w{i}" for i in range(60)) + "."
    assert verdicts(spark, PROSE, menu + PROSE, menu * 30, shouted, noise, bare, legal, PROSE + "\nother words without a stop",
                    PROSE + "\nEnd without a stop", bare + ". And then more") == [
        True, True, False, False, False, False, False, True, True, True]


def test_cleaned_text_keeps_the_good_lines(spark):
    table = spark.createDataFrame([(1, "Home | News | Sport |\n" + PROSE + "\n\nLast one.")], "doc_id long, text string")
    assert judge_quality(table).first().cleaned_text == PROSE + "\nLast one."


def test_no_python_and_no_shuffle(spark):
    table = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    plan = judge_quality(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_drop_keeps_columns_with_clashing_names(spark):
    table = spark.createDataFrame([(1, PROSE, "a", 2), (2, "short", "b", 3)],
                                  "doc_id long, text string, kept string, n_words int")
    kept = drop_low_quality(table)
    assert [tuple(r) for r in kept.collect()] == [(1, PROSE, "a", 2)]
    assert kept.columns == table.columns
    assert judge_quality(table.filter("false")).count() == 0


def test_hard_wrapped_prose_is_kept_and_lists_of_titles_are_not(spark):
    words = PROSE.split()
    wrapped = "\n".join(" ".join(words[i:i + 7]) for i in range(0, 60, 7))
    crlf = wrapped.replace("\n", "\r\n")
    titles = "\n".join(f"Ten best ways to cook number{i} at home" for i in range(20))
    menu = "\n".join(f"Our part{i}" for i in range(40)) + "\nEnd."
    assert verdicts(spark, wrapped, crlf, wrapped + "\n\n" + wrapped.replace("word", "term"), titles, menu,
                    titles + "\n\n" + "One sentence.") == [True, True, True, False, False, False]
    long_one = "\n".join(f"line{i} of a long list that never ends" for i in range(20_000))
    assert verdicts(spark, long_one) == [False]


def test_sentence_marks_of_other_scripts(spark):
    words = [f"\u0936\u092c\u094d\u0926{i}" for i in range(60)]
    marks = "\u0964\u06d4\u061f\u3002\uff01\uff1f\u1362\u0589"
    texts = ["\n".join(" ".join(words[i:i + 12]) + mark for i in range(0, 60, 12)) for mark in marks]
    chinese = "\n".join(" ".join("\u6c34\u706b" + chr(0x5000 + 60 * j + i) for i in range(12)) + "\u3002\u4f60\u597d" for j in range(5))
    thai = "\n".join(f"\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e\u0e21\u0e2b\u0e32\u0e19\u0e04\u0e23 {i} " + "\u0e2d\u0e21\u0e23\u0e23\u0e31\u0e15\u0e19\u0e42\u0e01\u0e2a\u0e34\u0e19\u0e17\u0e23\u0e4c\u0e21\u0e2b\u0e34\u0e19\u0e17\u0e23\u0e32\u0e22\u0e38\u0e18\u0e22\u0e32" + f" a{i} b{i} c{i}" for i in range(12))
    assert verdicts(spark, *texts, chinese, thai) == [True] * (len(marks) + 2)


def test_a_phrase_fails_only_a_line_it_makes_up_a_good_part_of(spark):
    words = PROSE.split()
    long_ones = [" ".join([*words[:30], phrase, *words[30:]]) for phrase in (
        "the privacy policy of", "terms of use", "lorem ipsum", "subscribe to our newsletter", "ALL RIGHTS RESERVED to")]
    article = " ".join(f"term{i}" for i in range(300)) + ". All rights reserved."
    lines = "See our privacy policy.\nAll rights reserved.\nPlease enable JavaScript to go on, or read the terms of service.\n"
    assert verdicts(spark, *long_ones, article, lines + PROSE, "Lorem ipsum. " * 40) == [True] * 7 + [False]
    table = spark.createDataFrame([(1, lines + PROSE)], "doc_id long, text string")
    assert judge_quality(table).first().cleaned_text == PROSE


def wrapped(lines, mark="."):
    """Ten words a line, with one full stop at the end of all."""
    return "\n".join(" ".join(f"w{10 * i + j}" for j in range(10)) for i in range(lines)) + mark


def test_wrapped_prose_of_any_number_of_lines_is_kept(spark):
    assert verdicts(spark, *[wrapped(n) for n in (10, 30, 31, 62, 200, 5_000)], wrapped(5_000, "")) == [True] * 6 + [False]


def test_sql_has_the_same_rule(spark):
    words = PROSE.split()
    thai = "\n".join("\u0e01" * 25 + f" a{i} b{i}" for i in range(30))
    texts = [
        None, "", "\n \n", PROSE, wrapped(10), wrapped(62), wrapped(62, ""), wrapped(40) + "\n\n" + wrapped(40, ""),
        wrapped(40, "") + "\nHome | News | Sport | x\n" + wrapped(30), wrapped(40).replace("\n", "\r\n"),
        "Home | News | Sport | Weather | About\n" * 30, " ".join(f"WORD{i}!!" for i in range(60)),
        " ".join(f"WORD{i}" for i in range(60)) + "!!\r", " ".join(f"word{i}***" for i in range(60)) + ".",
        "Lorem ipsum. " * 40, " ".join([*words[:30], "the privacy policy of", *words[30:]]),
        "All rights reserved.\r\n" + PROSE, "See our terms of use\r\n" * 5 + PROSE,
        " ".join(words) + " ALL RIGHTS RESERVED", " ".join(words * 6)[:-1] + ". all rights reserved",
        "\n".join(f"Ten best ways to cook number{i} at home" for i in range(20)) + "\n\nOne sentence.", thai,
        "\n".join(" ".join(f"\u0936{10 * i + j}" for j in range(10)) + "\u0964" for i in range(6)),
        "\n".join(" ".join(f"x{10 * i + j}" for j in range(10)) + "\u0964" * (i % 3 == 0) for i in range(9)),
        "\n".join("\u6c34" * 15 + f"{i} a{i} b{i}" for i in range(30)), " ".join(f"u{i}" for i in range(70)) + ".\u2028",
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    seen = sorted(tuple(r) for r in judge_quality(table).select(*columns).collect())
    documents = table.toPandas()  # noqa: F841 - the SQL's table
    expected = duckdb.connect().execute(f"select {', '.join(columns)} from ({OP10})").fetchall()
    assert seen == sorted(expected)
    assert {row[-1] for row in seen} == {True, False}
