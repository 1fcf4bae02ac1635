"""Random inputs against the rules written out in plain Python."""

import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from lineflow import operators as op
from lineflow.workspace import small_table
from tests.test_functions import utf16_key
from tests.test_operators import expected_order

RULES = settings(max_examples=8, deadline=None)

NUMBER = re.compile(r"[\t-\r ]*([+-]?[0-9]+)[\t-\r ]*\0*")
HEADS = st.text(alphabet="0123456789+- \t\x01\0.", max_size=6)
TAILS = st.text(alphabet=string.ascii_letters + " .\r_[\u00df\u00e9\u0131\ue000\U00010428", max_size=6)
NUMBERS = st.integers(-(2**31), 2**31 - 1)


def parsed(line):
    head, dot, rest = line.partition(".")
    if not dot:
        return "no_dot"
    if not head:
        return "dot_first"
    match = NUMBER.fullmatch(head)
    if match is None or not -(2**31) <= int(match[1]) < 2**31:
        return "bad_number"
    return (int(match[1]), rest[1:]) if rest else "no_text"


@RULES
@given(st.lists(st.tuples(HEADS, TAILS).map("".join), min_size=1, max_size=60))
def test_strict_parse(lines, values):
    df = lines(*values)
    outcomes = [parsed(v) for v in values]
    records = sorted(o for o in outcomes if isinstance(o, tuple))
    assert sorted((r.num, r.text) for r in op.parse_lines(df).collect()) == records
    reasons = {r: outcomes.count(r) for r in outcomes if isinstance(r, str)}
    assert {r.reason: r.lines for r in op.reject_counts(df).collect()} == reasons


@RULES
@given(st.lists(st.tuples(NUMBERS, TAILS), min_size=1, max_size=60), st.integers(1, 5))
def test_sort_and_positions(records, rows, partitions):
    df = records(*rows).repartition(partitions)
    assert [(r.num, r.text) for r in op.sort_lines(df).collect()] == expected_order(rows)
    placed = sorted(op.line_positions(df).collect(), key=lambda r: r.position)
    assert [r.position for r in placed] == list(range(1, len(rows) + 1))
    assert [(r.num, r.text) for r in placed] == expected_order(rows)


@RULES
@given(st.lists(st.lists(st.tuples(NUMBERS, TAILS), max_size=20), min_size=1, max_size=4))
def test_merge_is_the_sorted_union(records, inputs):
    merged = op.merge_sorted(*[op.sort_chunks(records(*rows)) for rows in inputs])
    assert [(r.num, r.text) for r in merged.collect()] == expected_order([r for rows in inputs for r in rows])


@RULES
@given(st.lists(st.tuples(st.sampled_from("aab"), TAILS), min_size=1, max_size=60), st.integers(1, 20))
def test_chunks(spark, rows, size):
    numbered = [(source, place, text) for place, (source, text) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "source string, place int, text string")
    laid, expected = {}, {}
    for source, place, text in numbered:
        expected[place] = laid.get(source, 0) // size
        laid[source] = laid.get(source, 0) + len(text.encode("utf-16-be")) // 2
    chunked = op.assign_chunks(df, size, ["source"], ["place"])
    assert {r.place: r.chunk_id for r in chunked.collect()} == expected


def test_keys_agree_with_the_definition_on_every_character(spark):
    """One text per character of the whole range, ordered by key and by definition."""
    chars = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = small_table(spark, num=chars, text=[chr(c) for c in chars]).repartition(8)
    got = [r.num for r in op.sort_lines(df).select("num").collect()]
    assert got == sorted(chars, key=lambda c: (utf16_key(chr(c)), c))
