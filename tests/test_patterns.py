import re

import pytest

from ruleloom.functions.patterns import PatternError, choices, java_pattern, matched, plain


def full(pattern, text, ignore_case=False):
    p = java_pattern(pattern, ignore_case).replace("\\z", "\\Z").replace("(?siu)", "(?si)")
    return re.match(p, text) is not None


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("https?://%w+%.com", ["http://a1.com", "https://ab.com"], ["http://a_b.com", "xhttp://a.com", "http://a.com/"]),
        ("a.c", ["abc", "a\nc"], ["ac", "abbc"]),
        ("[z-a]+", ["abcxyz"], ["ABC", ""]),
        ("[^0-9]{2,3}", ["ab", "abc"], ["a", "a1", "abcd"]),
        ("[a%-z]+", ["a-z"], ["b"]),
        ("[az-]+", ["a-z"], ["b"]),
        ("(ab|cd)*e?", ["", "abcd", "cde"], ["abc"]),
        ("%d+%%", ["5%", "12%"], ["%", "5"]),
        ("%x{4}", ["09aF"], ["09ag"]),
        ("%u%l*", ["Été", "Abc"], ["abc"]),
        ("a\\d", ["a\\d"], ["a1"]),
        ("%s%p%a", [" !x", "\t?É"], ["a!x"]),
        ("hello.*", ["hello", "hello x"], ["say hello"]),
        ("$1^", ["$1^"], ["1"]),
    ],
)
def test_language(pattern, yes, no):
    assert all(full(pattern, x) for x in yes)
    assert not any(full(pattern, x) for x in no)


def test_ignore_case():
    assert full("ab[c-d]", "ABD", True) and not full("ab[c-d]", "ABD")


@pytest.mark.parametrize("pattern", ["*", ".**", ".?*", "a{2", "a{101}", "a{3,2}", "(a", "a)", "[a", "%", "|*", "{2}"])
def test_invalid(pattern):
    with pytest.raises(PatternError):
        java_pattern(pattern)


def test_spark_agrees(spark):
    rows = [("http://ab.com",), ("a\nb",), ("é",), (None,)]
    df = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in df.select(df.x.rlike(java_pattern("%a.?b?"))).collect()] == [False, True, True, None]


def test_linear_on_long_values(spark):
    """Repeated alternations, nested repeats and many repeats: neither stack nor time grows beyond the value."""
    long = {"(a|b|cd)*": "abcd" * 25_000, "(a|a|aa)+b": "a" * 100_000, "(x+x+)+y": "x" * 100_000, "a*a*a*a*c": "a" * 100_000, "((a|b)*c)*": "abc" * 40_000, "a?" * 30 + "a" * 30: "a" * 30}
    df = spark.createDataFrame([(k, v) for k, v in enumerate(long.values())], "k int, v string")
    for k, p in enumerate(long):
        assert [r[0] for r in df.where(df.k == k).select(matched(df.v, p, False)).collect()] == [p in ("(a|b|cd)*", "((a|b)*c)*", "a?" * 30 + "a" * 30)]


def test_ways_of_matching_agree(spark):
    texts = ["", "a", "ab", "abcd", "cdab", "http://a.com", "x.y", "A", "\n", "ab\ncd", "é", "a-b]", None, "aXbXc", "50%"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    patterns = [".*a", "a.*", ".*b.*", "http://.*%.com", ".*%..*", "(ab|cd)*", "(ab|cd)+", "[a-c%-]+%]", "%a{1,2}", "(%a|%d)*%%?", ".*X.*X.*", "x%.y", "%u*", "(.|a)*", "[^x]*b[^x]*"]
    for p in patterns:
        for icase in (False, True):
            got = [r[0] for r in df.select(matched(df.v, p, icase)).collect()]
            assert got == [None if t is None else full(p, t, icase) for t in texts], p


def test_what_goes_where():
    assert plain("https://.*") == ("", "https://", ".*") and plain(".*%.example%..*") == (".*", ".example.", ".*") and plain("a%.*") is None and plain(".*") is None and plain("a+") is None
    assert choices("a+b{3}c{1,2}") == (2, 1, False) and choices("(?:a|b)*")[2] and choices(r"[+*]{2}\+") == (0, 0, False)


def test_items_refuse_what_they_cannot_match_in_linear_time(spark):
    with pytest.raises(PatternError):
        matched(spark.range(1).id.cast("string"), "(a|b)*", False, in_item=True)
