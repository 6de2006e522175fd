"""Surrogates against expectations written by hand, and entities of any length."""

from __future__ import annotations

import re

import pytest

from sluice.llm import pii


def made(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.with_surrogates(df).orderBy("doc_id").collect()]


def test_given_names_that_look_like_particles(spark):
    text = "Mr Ben Smith and Mr Al Smith and Mr Smith; Mrs Della Rossi, Mr Van Ho, Ms Anne-Marie St. Clair, Herr Ludwig van der Berg"
    out = made(spark, [text])[0]
    names = re.fullmatch(r"Mr (\w+) (\w+) and Mr (\w+) (\w+) and Mr (\w+); Mrs (\w+) (\w+), Mr (\w+) (\w+), Ms (\w+(?:-\w+)?) St\. (\w+), Herr (\w+) van der (\w+)", out)
    assert names, out
    n = names.groups()
    assert n[1] == n[3] == n[4] and n[0] != n[2]
    assert not {"Ben", "Al", "Smith", "Della", "Rossi", "Van", "Ho", "Clair", "Ludwig", "Berg"} & set(n)
    assert n[5] in pii.FEMALE_NAMES[0].split() and n[0] in pii.MALE_NAMES[0].split()


#: Each text, and what it becomes: a pattern in which groups with one name must be equal.
HAND = [
    ("Dr. John Smith called. Later Smith and John Smith left.", r"Dr\. (?P<g>\w+) (?P<s>\w+) called\. Later (?P=s) and (?P=g) (?P=s) left\."),
    ("Prof. Dr. Anna Meyer, Sir Ian Kay", r"Prof\. Dr\. \w+ \w+, Sir \w+ \w+"),
    ("MR JOHN SMITH and MRS O'NEILL", r"MR [A-Z]+ [A-Z]+ and MRS [A-Z']+"),
    ("from 2001:db8::8a2e:370:7334 and 2001:DB8::8A2E:370:7334 or fe80::1.", r"from (?P<a>[0-9a-f:]+) and (?P<b>[0-9A-F:]+) or [0-9a-f]{4}::[0-9a-f]\."),
    ("call 0171 2345678 or 0049 171 2345678 or +49 171 2345678", r"call 0?\d{4} \d{7} or 0049 (?P<x>\d{3} \d{7}) or \+49 (?P=x)"),
    ("SSN: 123456789 or 123-45-6789, number 987654321", r"SSN: (?P<n>\d{9}) or \d{3}-\d{2}-\d{4}, number 987654321"),
    ("the password is hunter22 and the password is required", r"the password is [a-z]{6}\d\d and the password is required"),
    ("Mr Long said: how long? Longer. Long ago, Mr Longman", r"Mr (?P<s>\w+) said: how long\? Longer\. (?P=s) ago, Mr \w+"),
    ("std::vector, 10:30:45, a:b, :: and 1.2.3 and 2024-01-05 are kept", r"std::vector, 10:30:45, a:b, :: and 1\.2\.3 and 2024-01-05 are kept"),
    ("x@y.com1, z@b.co.uk. and u@1b.c.org", r"\w@\w\.com1, \w@\w\.\w\w\.uk\. and \w@\d\w\.\w\.org"),
    ("Smith and Meyer stay without a title", r"Smith and Meyer stay without a title"),
]


def test_by_hand(spark):
    secrets = ["John", "Smith", "Anna", "Meyer", "Ian", "Kay", "JOHN", "SMITH", "NEILL", "2001:", "fe80", "2345678", "123456789", "6789", "hunter", "Long ", "Longman"]
    for (before, pattern), after in zip(HAND, made(spark, [t for t, _ in HAND]), strict=True):
        assert re.fullmatch(pattern, after), (before, after)
        if before != after:
            assert not [x for x in secrets if x in before.replace("Longer", "") and x in after.replace("Longer", "")], after
    a, b = re.search(r"from (\S+) and (\S+) or", made(spark, [HAND[3][0]])[0]).groups()
    assert a == b.lower()


def test_a_mention_has_the_surrogate_of_its_text(spark):
    out = made(spark, ["Mrs Eve Hart spoke. Hart's view: Eve Hart agrees.", "Mr Eve Hart", "Eve Hart alone"])
    first = re.fullmatch(r"Mrs (\w+) (\w+) spoke\. (\w+)'s view: (\w+) (\w+) agrees\.", out[0]).groups()
    assert first[1] == first[2] == first[4] and first[0] == first[3]
    assert out[1].split()[2] == first[1] and out[1].split()[1] != first[0]
    assert out[2] == "Eve Hart alone"


LONG = 60_000


@pytest.mark.parametrize(
    "before, after",
    [
        ("mail x@" + "a." * (LONG // 2) + "com", r"mail \w@(?:\w\.){30000}com"),
        ("mail " + "x" * LONG + "@mail.com", r"mail \w{60000}@\w{4}\.com"),
        ("mail x@" + "a" * LONG + ".com", r"mail \w@\w{60000}\.com"),
        ("Mr Abc" + "-bc" * (LONG // 3) + " left", r"Mr [\w-]+ left"),
        ("Mr A" + "b" * LONG + " left", r"Mr \w+ left"),
        ("Mr O'N" + "'Na" * (LONG // 3) + " left", r"Mr [\w']+ left"),
        ("password=" + "k" * LONG, r"password=\w{60000}"),
        ("4" * LONG + " 4111 1111 1111 1111 " + "1:" * LONG + " ok", r"4{60000} 4\d{3} \d{4} \d{4} \d{4} (?:1:){60000} ok"),
        ("+1 " + "555 " * LONG, None),
    ],
)
def test_entities_of_any_length(spark, before, after):
    out = made(spark, [before, "next"])
    assert out[1] == "next"
    if after:
        assert re.fullmatch(after, out[0]), out[0][:200]
    for word in ("x@a.", "Abc-bc", "bbbb", "kkkk", "N'Na'N", "4111 1111"):
        assert word not in out[0] or word not in before
