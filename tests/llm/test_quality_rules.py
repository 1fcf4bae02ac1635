import random
import textwrap
from collections import Counter

from lineflow.llm import quality_rules as qr
from tests.llm.cases import ODD_ROWS, WORDS, sentence


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {
        i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(inside), failed


def test_base_counts_of_odd_rows(odd):
    found = qr.clean_documents(odd).collect()
    got = sorted(
        ((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in found),
        key=str,
    )
    assert got == sorted(((row[0], base_counts(row[1])) for row in ODD_ROWS), key=str)
    assert all(not r.kept for r in found if r.base_failed)


def test_base_counts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in qr.clean_documents(docs).collect():
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        assert got == base_counts(texts[r.doc_id])


def test_empty_table(empty):
    assert qr.clean_documents(empty).collect() == []
    assert qr.keep_good_documents(empty).collect() == []


def fault(line):
    return qr.line_fault(line, WORDS.findall(line), qr.Rules())


def test_faults_of_lines():
    assert fault("This is a sentence of a text.") is None
    assert fault('He said "yes."') is None
    assert fault("Home | News | Sport | Weather | More.") == "navigation"
    assert fault("Read more") == "punctuation"
    assert fault("WOW!! BUY!! THIS!! NOW!!") == "punctuation"
    assert fault("A### b$$$ c%%% d&&&.") == "symbols"
    assert fault("ALL OF THIS IS WRITTEN IN CAPITALS ONLY.") == "capitals"
    assert fault("Copyright 2020 by someone.") == "boilerplate"
    assert fault("same " * 20 + ".") == "repetition"
    assert fault("A long line without an end, but with commas, as prose has them, and so on and on") is None


def test_bad_lines_go_and_documents_that_lost_too_much(docs):
    good = "\n".join(sentence(i, 30) for i in range(4))
    menu = "\n".join("Home | News | Sport | Weather" for _ in range(3))
    bad = sentence(9, 20) + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i} | f{i} | g{i}" for i in range(12))
    found = {r.doc_id: r for r in qr.clean_documents(docs((1, good), (2, good + "\n" + menu), (3, bad))).collect()}
    assert found[1].kept and found[1].cleaned == good
    assert found[2].kept and found[2].cleaned == good
    assert not found[3].base_failed and not found[3].kept


def test_kept_rows_have_all_columns(odd):
    kept = qr.keep_good_documents(odd)
    assert kept.schema == odd.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in qr.clean_documents(odd).collect() if r.kept}


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = qr.clean_documents(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    clean = [r.kept for r in judged if r.quality == 1]
    junk = [r.kept for r in judged if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.05


def prose(n_words, seed=1):
    """Sentences of words drawn as in a natural text, few of them often."""
    rng, words = random.Random(seed), []
    weights = [1 / (r + 5) for r in range(2500)]
    while len(words) < n_words:
        own = [f"wo{r}rd" for r in rng.choices(range(2500), weights, k=rng.randrange(9, 24))]
        words += [own[0].capitalize(), *own[1:-1], own[-1] + "."]
    return " ".join(words)


def test_long_lines_are_judged_by_their_length():
    text = prose(2000).replace("wo2rd", "copyright law", 1)
    assert fault(text) is None
    assert len(set(prose(20000).split())) < 0.25 * len(prose(20000).split())
    assert fault(prose(20000)) is None
    assert fault("the same few words again and again " * 2000 + ".") == "repetition"
    notice = "Copyright 2020 by someone. All rights reserved. Privacy policy and terms of use of this place apply to you. "
    assert fault(notice + "By your visit, you accept cookies and the cookie policy of our partners, too.") == "boilerplate"


def test_hard_wrapped_text_stays_whole():
    for width in (40, 60, 72):
        paragraphs = [textwrap.fill(prose(300, seed).replace("wo3rd", "copyright law", 1), width) for seed in range(4)]
        for text in ("\n\n".join(paragraphs), "\n".join(paragraphs), paragraphs[0]):
            counts, left = qr.assess(text, qr.Rules())
            assert counts["lost_chars"] <= 0.02 * counts["word_chars"] and qr.verdict(counts, qr.Rules())[1]


def test_short_lines_beside_prose_still_go():
    good = prose(200)
    for bad in ("Home\nNews\nSport", "Copyright 2020 by someone.", "Read more about it here and now\nNext page"):
        assert qr.assess(f"{good}\n{bad}", qr.Rules())[1] == good
        assert qr.assess(f"{bad}\n{good}", qr.Rules())[1] == good
