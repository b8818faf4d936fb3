"""Searches find what Python's regular expressions find."""

import re

import pytest

from assetlens.errors import SearchPatternError
from assetlens.functions.patterns import java_pattern
from assetlens.operators.filters import found_in

PATTERNS = [
    "hq", "^hq", "hq$", r"\Ahq", r"hq\Z", "a|b", "(?P<x>a)(?P=x)", r"(a)(b)?\1", r"(?P<first>\d)-(?P<second>\d)",
    r"\d+", r"\D+$", r"\w+\s\w+", r"\W", r"\S", r"\s", r"\bhq\b", r"\Bq", "a{2}", "a{2,}", "a{,2}b", "a+?b", "a*+b", "a++b",
    "(?>a+)b", "[abc]", "[^abc]", "[a-c5]", "[^\\W\\d]", r"[\w.-]+@[\w-]+", r"[\]\[]", r"[\^-]", "[&&a]", "a.b", "(?s)a.b", "(?m)^b$",
    "(?m)a$", "(?a)\\w", "(?x) a  b # both", "(?i:HQ)", "(?-i:HQ)", "x(?=y)", "x(?!y)", "(?<=x)y", "(?<!x)y", r"\x41", r"\u00e9", r"\.",
    r"a\tb", "", "()", "é", "É", "ß", r"\$5", r"\\", "#", "a#b", " ", "[ ]", "(?:ab)+c", "(a|b)*c$", r"[\s\S]{3}", "𝄞", "[𝄞-𝄢]", r"\N{BULLET}",
    "\\Qa", "[[]", "a[b[c]",
]
TEXTS = [
    "", "hq", "HQ", "hq\n", "at hq now", "shq", "aa", "ab", "aab", "abab", "aaab", "b", "a\nb", "a\tb", "ab\nb", "1-2", "12", "١٢", "x y",
    "x\u00a0y", "x\u2003y", "xy", "xz", "é", "É", "ß", "ss", "me@x-y.z", "[", "]", "^", "-", "&", "$5", "\\", "#", "a#b", "Qa", "𝄞", "•", "_", "a b",
    "ba", "abc", "c", "a\r", "a\u2028b", "\x1c", "²", "ǆ", "A",
]


def readable(pattern):
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def test_same_rows_as_python(spark):
    patterns = [p for p in PATTERNS if readable(p)]
    assert len(patterns) >= 60
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    found = df.select("id", *[found_in([df.text], p).alias(f"p{k}") for k, p in enumerate(patterns)]).collect()
    for row in found:
        for k, pattern in enumerate(patterns):
            expected = re.search(pattern, TEXTS[row["id"]], re.IGNORECASE) is not None
            assert row[f"p{k}"] == expected, (pattern, TEXTS[row["id"]], java_pattern(pattern))


@pytest.mark.parametrize("pattern", ["(", "[a", "a**", "(?P<n>a)(?P<n>b)", "(a)?(?(1)b|c)", "(?P=x)", r"\g", "(?<=a+)b"])
def test_what_cannot_be_is_an_error_before_any_job(spark, pattern):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(SearchPatternError):
        found_in([df.text], pattern)
