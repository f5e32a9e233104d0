"""Texts of megabytes, of one line, one word or one sign: time in proportion, results as for short ones."""

import random
import re
import time

from pyspark.sql import functions as F

from storyloom.llm import chat, lines, lm, quality, secrets


def took(f, *args):
    began = time.perf_counter()
    out = f(*args)
    return time.perf_counter() - began, out


def test_secrets_are_linear_in_the_text():
    scanner = secrets.Scanner()
    for text in ("-" * 3_000_000, "_" * 3_000_000, "well-" + "known" * 600_000, "x" * 1_000_000 + "/" + "y" * 1_000_000 + "/" + "z" * 900_000 + "/", "ab-/" * 750_000):
        seconds, spans = took(scanner.spans, text)
        assert seconds < 3 and spans == []  # quadratic ones took half an hour
    for text in ("0f" * 500_000, "password = " + "x1" * 400_000):
        seconds, spans = took(scanner.spans, text)
        assert seconds < 5 and len(spans) == 1


def test_allowed_paths_as_before():
    """From the start of a segment on, or from any letter of it: the same characters are allowed."""
    old, new, rng = re.compile(r"(?:[A-Za-z_-]+/){3}"), re.compile(secrets.ALLOW[2]), random.Random(1)

    def covered(pattern, word):
        out, k = set(), 0
        while (f := pattern.search(word, k)) is not None:
            out |= set(range(*f.span()))
            k = f.start() + 1
        return out

    for _ in range(3000):
        word = "".join(rng.choice("ab-_/9/+=") for _ in range(rng.randint(0, 40)))
        assert covered(old, word) == covered(new, word)


def test_tables_with_long_texts(spark):
    rng = random.Random(2)
    words = [f"word{rng.randint(0, 5000)}" for _ in range(120_000)]
    texts = [" ".join(words), "x" * 1_000_000, "\n".join(words[:60_000]), "a b c d e f g h. " * 20_000, "-" * 1_000_000, "", None]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in quality.apply_rules(docs, labels).collect()}
    assert judged[0].n_words == 120_000 and judged[1].n_words == 1 and judged[2].word_chars == sum(map(len, words[:60_000])) and judged[3].n_repeat_words > 150_000
    cut = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert cut[0].text == texts[0] and cut[1].text == texts[1] and len(cut[3].text) < len(texts[3]) and len(cut) == len(texts)
    scores = {r.doc_id: r for r in lm.score(docs).collect()}
    assert scores[0].n_tokens == 120_001 and scores[1].n_tokens == 2 and all(r.score < 0 for r in scores.values())
    turns = spark.createDataFrame([(1, 0, "user", texts[0]), (1, 1, "assistant", texts[4] + "</s>")], "conv_id long, turn int, role string, text string")
    out = chat.read_back(chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))).first()
    assert [len(x) for x in out.loss] == [1_000_004] and out.turns[0].text == texts[0]
