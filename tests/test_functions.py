import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineflow import functions as lf

PARSED = [
    ("1. Apple", 1, "Apple", None),
    ("415. Apple", 415, "Apple", None),
    ("30432. a\rb", 30432, "a\rb", None),
    ("", None, None, "no_dot"),
    ("a\r", None, None, "no_dot"),
    ("12", None, None, "no_dot"),
    ("5.", None, None, "no_text"),
    ("5. ", 5, "", None),
    ("5.xyz", 5, "yz", None),
    ("007. Zed", 7, "Zed", None),
    ("+8. plus", 8, "plus", None),
    (" -9 . neg", -9, "neg", None),
    ("-0. zero", 0, "zero", None),
    ("2147483647. most", 2147483647, "most", None),
    ("-2147483648. least", -2147483648, "least", None),
    ("2147483648. big", None, None, "bad_number"),
    (".x", None, None, "dot_first"),
    (". x", None, None, "dot_first"),
    ("abc. d", None, None, "bad_number"),
    ("1 2. x", None, None, "bad_number"),
    ("- 1. x", None, None, "bad_number"),
    ("1.5. foo", 1, ". foo", None),
    ("\x01 7. x", None, None, "bad_number"),
    ("7\x00. nul", 7, "nul", None),
    ("7\x00 . nul", None, None, "bad_number"),
    ("\u0661. arabic digit", None, None, "bad_number"),
    ("\u00a07. no-break space", None, None, "bad_number"),
    ("3. \u00e9t\u00e9. \U0001f600", 3, "\u00e9t\u00e9. \U0001f600", None),
    (".", None, None, "dot_first"),
    ("x.", None, None, "bad_number"),
]

ORDERED = [
    "", "ax", "BX", "bx", "Ix", "SSx", "stx", "Zx", "[x", "_x", "`x", "\u00e9a", "\u00c9b", "\u00dfx", "\u0131x",
    "\U00010428x", "\U0010ffff", "\U0010ffffa", "\U0010ffff\ue000", "\ue000x", "\uff41x",
]


FOLD = str.maketrans(*lf.case_table())


def utf16_key(text):
    """The order by its definition, in Python."""
    return text.translate(FOLD).encode("utf-16-be", "surrogatepass")


def test_parse_and_reasons(lines):
    rows = lines(*[line for line, *_ in PARSED]).select(
        "value",
        lf.line_number("value"),
        F.when(lf.line_number("value").isNotNull(), lf.line_text("value")),
        lf.reject_reason("value"),
    )
    got = {row[0]: tuple(row)[1:] for row in rows.collect()}
    for line, num, text, reason in PARSED:
        assert got[line][2] == reason, line
        if reason is None:
            assert got[line][:2] == (num, text), line


def test_strip_carriage_returns(lines):
    rows = lines("a\r", "a\r\r", "a\rb", "\r", "", "\u00e9\r").select(
        lf.strip_cr("value"), lf.strip_all_cr("value")
    ).collect()
    assert [r[0] for r in rows] == ["a", "a\r", "a\rb", "", "", "\u00e9"]
    assert [r[1] for r in rows] == ["a", "a", "ab", "", "", "\u00e9"]


def test_render_is_canonical(records):
    row = records((7, "Zed"), (-9, "")).select(lf.render_line("num", "text"), lf.line_bytes("num", "text")).collect()
    assert [tuple(r) for r in row] == [("7. Zed", 7), ("-9. ", 5)]


def test_key_order(lines):
    assert sorted(ORDERED, key=lambda t: (utf16_key(t), t)) == ORDERED
    got = lines(*reversed(ORDERED)).orderBy(lf.ordinal_ci_key("value"), "value").collect()
    assert [r.value for r in got] == ORDERED


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=6), min_size=2, max_size=60))
def test_key_order_is_utf16_order(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = [r.value for r in df.orderBy(lf.ordinal_ci_key("value"), F.encode("value", "UTF-16BE")).collect()]
    assert got == sorted(texts, key=lambda t: (utf16_key(t), t.encode("utf-16-be")))


def test_case_table_is_the_simple_mapping(spark):
    lower, upper = lf.case_table()
    assert len(lower) == len(upper) > 1400 and len(set(lower)) == len(lower)
    assert "\u0131" not in lower and "\u017f" not in lower and "\u00df" not in lower
    to_upper = spark.sparkContext._jvm.java.lang.Character.toUpperCase
    # The JVM may know fewer characters than Python, but must not contradict it.
    known = {c: chr(to_upper(ord(c))) for c in lower}
    assert all(known[c] in (u, c) for c, u in zip(lower, upper))
    assert sum(known[c] == u for c, u in zip(lower, upper)) > 1380


def test_ci_predicates(spark):
    df = spark.createDataFrame(
        [("Apple", "aPPLE"), ("stra\u00dfe", "STRASSE"), ("_a", "B"), ("a", "B"), (None, "x"), (None, None)],
        "l string, r string",
    )
    got = df.select(lf.ordinal_ci_equal("l", "r"), lf.ordinal_ci_compare("l", "r")).collect()
    assert [tuple(r) for r in got] == [
        (True, 0), (False, 1), (False, 1), (False, -1), (False, None), (True, None),
    ]
    inside = df.filter(lf.ordinal_ci_between("l", F.lit("A"), F.lit("b"))).select("l").collect()
    assert sorted(r.l for r in inside) == ["Apple", "a"]


def test_utf16_length(lines):
    got = lines("", "abc", "\u00e9", "\U0001f600x").select(lf.utf16_length("value")).collect()
    assert [r[0] for r in got] == [0, 3, 1, 3]


SIZES = {
    "10GB": 10737418240, " 500mb ": 524288000, "1 KB": 1024, "7B": 7, "42": 42, "-5KB": -5120, "+3kb": 3072,
    "\u00a09 mb\u3000": 9437184, "x": None, "": None, "  ": None, "1.5GB": None, "9999999999GB": None,
    "1KBB": None, "- 5KB": None, "KB": None, "99999999999999999999": None,
}


def test_parse_size(lines):
    got = lines(*SIZES).select("value", lf.parse_size("value")).collect()
    assert {r[0]: r[1] for r in got} == SIZES


@pytest.mark.parametrize("literal", SIZES)
def test_size_in_bytes(literal):
    if SIZES[literal] is None:
        with pytest.raises(ValueError):
            lf.size_in_bytes(literal)
    else:
        assert lf.size_in_bytes(literal) == SIZES[literal]


def test_part_path(spark):
    assert lf.part_path("data/p-{0}.tmp", 3) == "data/p-3.tmp"
    assert spark.range(2).select(lf.part_path("p-{0}", F.col("id"))).collect()[1][0] == "p-1"


def test_part_numbers_order_more_files_than_five_digits(spark):
    names = ["part-99999-a.txt", "part-100000-a.txt", "part-00007-b.parquet", "other-1.txt", "part-x"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", lf.part_number("name").alias("part"))
    assert [r.name for r in rows.filter("part IS NOT NULL").orderBy("part").collect()] == [names[2], names[0], names[1]]
    assert rows.filter("part IS NULL").count() == 2


def test_draws_do_not_depend_on_partitioning(spark):
    def drawn(n):
        return spark.range(0, 1000, 1, n).select(
            "id", lf.draw_below(7, 1, "a", "id"), lf.mixture(30, F.lit(1), F.lit(0), 1, "b", "id")
        )

    assert sorted(drawn(1).collect()) == sorted(drawn(7).collect())
    share = drawn(3).toDF("id", "d", "m").agg(F.avg("m"), F.min("d"), F.max("d")).first()
    assert 0.25 < share[0] < 0.35 and share[1] == 0 and share[2] == 6
