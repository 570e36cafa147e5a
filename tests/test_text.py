"""Scalar functions against goldens and plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import charset, tokenizer
from keyloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "pattern, replacement, text, want",
    [("a(b)", "$1$1", "xabx", "xbbx"), ("a", r"\n", "bab", r"b\nb"), ("(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)", "$10", "abcdefghij", "j"), ("x", "y", "", "")],
)
def test_replace_all(spark, pattern, replacement, text, want):
    assert one(spark, text, lambda c: T.replace_all(c, pattern, replacement)) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a \n\n  b\t\tc", "a\nb c"),
        ("java.util.List x", "List x"),
        ("int[] a = { 1, 2 };\nnew int[] {3}", "int[] a = { };\nnew int[] { }"),
        ("\npublic static int f", "\nstatic int f"),
        ("while (x)", ";while (x)"),
        ("   lead", "lead"),
        ("a; if (x)\nreturn y;", "a; {\\n\nreturn y;\\n}\\n"),
        (None, None),
        ("", ""),
    ],
)
def test_type1(spark, text, want):
    assert one(spark, text, T.normalize_type1) == want


def test_type2(spark):
    assert one(spark, "int a1 = b.c.d(22);", T.normalize_type2) == "t t1 = t. t. t(1);"


def test_lines(spark):
    for text, want in (("a\nb\nc\nd\ne\nf\ng\n", list("abcdefg")), ("a", ["a"]), ("", [""]), ("\n", [""]), ("a\n\n", ["a", ""]), (None, None)):
        assert one(spark, text, T.lines) == want
    cut = lambda start, n: one(spark, "a\nb\nc\nd\ne\nf\ng\n", lambda c: T.get_lines(T.lines(c), F.lit(start), n))
    assert cut(3, 3) == "\nd\ne\nf\n" and cut(0, 2) == "a\nb\n" and cut(5, 3) is None and cut(-1, 1) is None
    assert [one(spark, x, T.count_lines) for x in ("", "a\nb", "a\r\nb\rc\n")] == [1, 2, 4]


def plain_shingles(doc):
    out, start = [], 0
    import re

    for _ in range(4):
        out += re.findall(T.SHINGLE, doc[start:])
        start = doc.find(" ", start + 1)
        if start < 0:
            return None
    return out


def plain_sketch(doc):
    found = plain_shingles(doc)
    if found is None:
        return None
    hashes = list(dict.fromkeys(hashlib.sha1(s.encode()).digest() for s in found))
    for mask in (3, 1, 0):
        acc = 0
        for h in hashes:
            if h[0] & mask == mask:
                acc ^= int.from_bytes(h)
        if acc:
            return acc.to_bytes(20).hex()
    return None


def test_shingles_and_sketch(spark):
    six = "one two three four five six"
    assert one(spark, six, T.shingles) == ["one two three four", "two three four five", "three four five six"]
    assert one(spark, six, T.sketch).startswith("448e")
    rng = random.Random(1)
    docs = [" ".join(rng.choice(["a", "bb", "c\n", "", "dd"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", " ", " a b c d", "a b c d e", None]
    rows = spark.createDataFrame([(d,) for d in docs], "x string").select("x", T.shingles(F.col("x")).alias("s"), T.sketch(F.col("x")).alias("h")).collect()
    for r in rows:
        want = None if r["x"] is None else plain_shingles(r["x"])
        assert r["s"] == want and r["h"] == (plain_sketch(r["x"]) if r["x"] is not None else None), repr(r["x"])


def test_xor_digest(spark):
    hashes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(5)]
    acc = 0
    for h in hashes:
        acc ^= int(h, 16)
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    assert df.agg(T.xor_digest(F.col("h")).alias("x")).first()["x"] == f"{acc:040x}"
    assert df.agg(T.xor_of(F.collect_list("h")).alias("x")).first()["x"] == f"{acc:040x}"


def test_vocabulary(spark):
    df = spark.createDataFrame([("a b1 c", "a b1 d 2", False), ("", "", None), ("x y z q w", "x y z q w", True)], "a string, b string, same boolean")
    rows = df.select("same", T.vocabulary_similarity(T.vocabulary(F.col("a")), T.vocabulary(F.col("b"))).alias("s"), T.is_spam(F.col("a"), F.col("b")).alias("spam")).collect()
    assert [(r["s"], r["spam"]) for r in rows] == [(0.5, True), (None, False), (1.0, False)]


def test_signed_order(spark):
    keys = [b"\x7f\x00", b"\x80\x00", b"\x00\xff", b"\xff\x01", b"\x00\x01", b"\x01"]
    got = [bytes(r["k"]) for r in spark.createDataFrame([(k,) for k in keys], "k binary").orderBy(T.signed_order(F.col("k"))).collect()]
    assert got == sorted(keys, key=lambda k: [b - 256 if b > 127 else b for b in k])


def test_charsets(spark):
    raw = ["häß".encode(), b"plain", "Größe".encode("latin-1"), b"\xef\xbb\xbfx", None, b""]
    df = spark.createDataFrame([(r,) for r in raw], "r binary")
    assert [r["c"] for r in df.select(charset.guess_charset("r").alias("c")).collect()] == ["UTF-8", "US-ASCII", "ISO-8859-1", "UTF-8", None, "US-ASCII"]
    assert [r["t"] for r in df.select(charset.decoded("r").alias("t")).collect()][:3] == ["häß", "plain", "Größe"]


SOURCE = """package a;
import b.C;

public class Tool {
    int x;

    int size(String s) {
        if (s == null) {
            return 0;
        }
        return s.length();
    }

    void run(List<String> a, int[] b) {
        while (true) {
            step();
        }
    }
}
"""


def test_tokenizer(spark):
    assert [(line, part.split("\n")[0].strip()) for line, part in tokenizer.split_functions(SOURCE)] == [(3, "public class Tool {"), (6, "int size(String s) {"), (13, "void run(List<String> a, int[] b) {")]
    assert "".join(p for _, p in tokenizer.split_functions(SOURCE)) in SOURCE
    assert tokenizer.split_functions("no head here") == [(0, "no head here")] and tokenizer.split_functions("") == [(0, "")]
    df = spark.createDataFrame([(1, SOURCE, "x"), (2, None, "x"), (3, "", "x")], "id int, text string, hash string")
    got = tokenizer.functions_of(df, "id", "text").collect()
    assert {r["base_line"] for r in got if r["code_file"] == 1} >= {6, 13} and all(r["code_file"] == 1 for r in got)
    assert all(bytes(r["hash"]) == hashlib.sha1(r["contents"].encode()).digest() for r in got)
