import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from phrasemill.functions.tokens import SMALL_NUMBERS, ascii_fold, has_tokens, one_line, token_count, words_of


def words_by_rule(text: str) -> list[str]:
    """The rule, step by step, on the UTF-8 bytes of the text."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    for mark in (b"http", b"www", b"@", b"#"):
        raw = raw.replace(mark, b" " + mark)
    kept = [t for t in raw.split() if not t.startswith((b"@", b"&", b"http", b"www"))]
    plain = re.sub(rb"[^a-z0-9]", b" ", b" ".join(kept)).decode("ascii").split()
    return [SMALL_NUMBERS[int(w)] if w.isdigit() and int(w) <= 21 else w for w in plain]


CASES = {
    "hi@bob RT:http://x.co www.q awwwesome &amp; 007 21 22 00 #Tag1 it's a2 café":
        "hi rt a seven twenty-one 22 zero tag1 it s a2 caf".split(),
    "httpwww a@@b": ["a"],
    " \t\x0b\n": [],
    "": [],
}


def spark_words(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", words_of(F.col("text")).alias("w")).collect()
    return [r.w for r in sorted(got, key=lambda r: r.i)]


def test_cases(spark):
    assert spark_words(spark, list(CASES)) == list(CASES.values())
    assert [words_by_rule(c) for c in CASES] == list(CASES.values())


PIECE = st.sampled_from(
    ["http", "www", "w", "h", "@", "#", "&", " ", "\n", "\t", "\x0b", "\x0c", "\r", "0", "7", "21", "22", "007", "-", "'",
     "K", "İ", "é", "ß", "\u00a0", "\u2003", "x", "HTTP", "WwW", "😀", "ab", "Z9", "_"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECE, max_size=14).map("".join), min_size=40, max_size=40))
def test_rule_on_random_texts(spark, texts):
    assert spark_words(spark, texts) == [words_by_rule(t) for t in texts]


def test_stream_text_functions(spark):
    rows = spark.createDataFrame([(" Café\nau lait № 5 \x0b",), (None,)], "text string")
    folded, empty = rows.select(one_line(ascii_fold("text")).alias("t")).collect()
    assert folded.t == "Cafeau lait No 5"
    assert empty.t is None
    assert spark.range(1).select(token_count(F.lit(" a  b\x0bc\n"))).first()[0] == 3
    for text in ("a b c d", " a b\x0bc d e ", "", "a b c d ", "a\nb\tc d e f"):
        one = spark.range(1).select(*[has_tokens(F.lit(text), n) for n in (1, 4, 5)]).first()
        assert list(one) == [len(text.split()) >= n for n in (1, 4, 5)]
