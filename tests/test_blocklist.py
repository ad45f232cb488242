"""Long blocklists against a plain scan of all patterns."""

import random
import re

import pytest

from cardamom.operators import blocklist


def plain(patterns, text):
    found = ((name, re.search(p, text, re.I)) for name, p in patterns)
    return [(name, m[0]) for name, m in found if m and m[0]]


@pytest.mark.parametrize(
    ("pattern", "text"),
    [("free money", "free money"), (r"cheap\s+pills", "cheap"), (r"a?bcd*ef+gh", "bc"), (r"x{2,3}yz", "yz"), (r"call\.now", "call.now"), ("one|two", ""), ("(?i)one", ""), ("[abc]def", "def"), ("[^]x]long", "long"), (r"[\]]ab", ""), ("(group)tail", "tail"), (r"\x41bc", ""), ("ΣΑΣ", "σασ"), ("", ""), ("a+", "a"), (r"(a)\1long", ""), (r"ab\w", "ab"), ("q{w", "w")],
)
def test_required_text(pattern, text):
    assert blocklist.required(pattern) == text


def test_equals_the_plain_scan():
    rnd = random.Random(1)
    letters = "abikKsſıİIßẞςσΣéÉЯя .x"
    pieces = ["a", "b", "i", "k", "s", "ß", "σ", "é", "я", "ab", "is", "ss", r"\s", r"\w", ".", "[abс]", "a?", "k*", "i+", "(ab)", "(a|b)", "b{2}", r"\.", "x"]
    patterns = [(f"p{i}", "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 4)))) for i in range(300)]
    made = blocklist.Blocklist(patterns)
    for _ in range(400):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        assert made.hits(text) == plain(patterns, text), text


def test_five_thousand_patterns(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    patterns = [(f"w{i}", word(5) + rnd.choice(["", r"\s+x", "[0-9]*"])) for i in range(5000)]
    texts = [" ".join(word(5) for _ in range(60)).upper() for _ in range(40)] + [None, "", patterns[7][1][:5] + " " + patterns[7][1][:5]]
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    got = blocklist.blocked(spark.createDataFrame(rows, "id int, text string, match string").withColumnRenamed("match", "more"), "text", patterns).collect()
    assert sorted((r["id"], r["pattern"], r["match"]) for r in got) == sorted((i, *hit) for i, t, _ in rows for hit in plain(patterns, t or ""))
    assert got and all(r["more"] == "kept" for r in got)
    made = blocklist.Blocklist(patterns)
    for t in texts:
        made.hits(t or "")
    assert made.ran < 0.01 * len(patterns) * len(texts)


def test_broken_and_empty_lists(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(re.error):
        blocklist.blocked(df, "text", [("x", "(")])
    assert blocklist.blocked(df, "text", []).count() == 0
    assert blocklist.blocked(df.limit(0), "text", [("x", "a")]).count() == 0
