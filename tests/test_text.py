import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.functions import text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


def test_clean_and_norm(spark):
    assert one(spark, " a  b\x1c c\n", text.clean) == "a b c"
    assert one(spark, None, text.clean) == ""
    assert one(spark, "Élan, Vital-7!", text.norm) == "lan vital 7"


def test_space_class_equals_python(spark):
    every = "".join(chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert one(spark, every, lambda v: F.regexp_replace(v, text.SPACE, "")) == re.sub(r"\s", "", every)


def test_content_hash_ignores_case_and_punctuation(spark):
    a, b, c = (one(spark, t, text.content_hash) for t in ("Hello, World!", "hello   world", "hello there"))
    assert a == b == hashlib.sha256(b"hello world").hexdigest() != c


def test_shingles_of_few_and_many_words(spark):
    of = lambda t: one(spark, t, lambda v: text.shingles(text.tokens(v)))
    assert of("") == [""]
    assert of("a b") == ["a b"]
    assert of("a b c d e") == ["a b c d e"]
    assert of("a b c d e f") == ["a b c d e", "b c d e f"]
    assert of("a a a a a a a") == ["a a a a a"]


def test_stat_values_and_labels(spark):
    for s, value, label in [("449 Hp (335 kW)", True, False), ("~ 5 km", True, False), ("Combined Power", False, True), ("12", False, False), ("5 kW.", False, False), ("# Head", False, False), ("Ends:", False, False), ("one two three four five six", False, False), ("٣ km", True, False)]:
        assert (one(spark, s, text.is_stat_value), one(spark, s, text.is_stat_label)) == (value, label), s


def test_top_lines_skips_blanks(spark):
    assert one(spark, "\n\n  A \n\nB\nC", lambda v: text.top_lines(v, 2)) == ["A", "B"]
    assert one(spark, "", text.top_lines) == []


def test_strip_lines(spark):
    df = spark.createDataFrame([("# Site\n\n# Own\n\n\n\nBody", ["# Site"]), ("# Site\nx", []), ("# Site\nx", None)], "md string, d array<string>")
    assert [r[0] for r in df.select(text.strip_lines(F.col("md"), F.col("d"))).collect()] == ["# Own\n\nBody\n", "# Site\nx", "# Site\nx"]


def test_front_matter_is_skipped(spark):
    assert one(spark, "---\na: 1\n---\nbody", text.after_front_matter) == "\nbody"
    assert one(spark, "body", text.after_front_matter) == "body"


def test_headings(spark):
    assert one(spark, "# A b\ntext\n### C!\n#no", text.headings) == ["a b", "c"]


def test_image_title(spark):
    long = "word " * 40
    df = spark.createDataFrame([(" alt ", "c", long), ("", "cap", long), (None, "", long), ("", "", "short"), ("", None, "")], "a string, c string, s string")
    got = [r[0] for r in df.select(text.image_title(F.col("a"), F.col("c"), F.col("s"))).collect()]
    assert got[:2] == ["alt", "cap"] and got[3:] == ["short", "image"]
    assert got[2].endswith("word…") and len(got[2]) <= 81


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x1c\x85 #", max_size=12), min_size=5, max_size=5))
def test_lines_are_pythons(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in df.select(text.lines(F.col("v")), "i").orderBy("i").collect()] == [v.splitlines() for v in values]
