"""Generated files, syntax, encodings, packing, contamination and personal data on small cases."""

import hashlib
import random
import re

import pytest

from keyloom.llm import contamination, encoding_repair, generated_files, packing, personal_data, syntax

CODE = "package a.b;\n\nclass Tool {\n    int size(String s) {\n        return s.length() + 1;\n    }\n}\n"


@pytest.mark.parametrize(
    "path, text, kind",
    [
        ("src/main/java/a/b/Tool.java", CODE, None),
        ("src/main/java/a/b/Tool.java", "// Generated by toolgen. DO NOT EDIT!\n" + CODE, "generated"),
        ("src/main/java/a/b/Tool.java", "/* generado automáticamente */\n" + CODE, "generated"),
        ("src/main/java/a/b/Tool.java", "// Writes the header \"DO NOT EDIT\" into the files it emits\n" + CODE, None),
        ("src/main/java/a/b/Tool.java", CODE.replace("int size", 'String h = "Code generated by x, do not edit"; int size'), None),
        ("build/generated/a/b/Tool.java", CODE, "generated"),
        ("src/main/java/generated/a/b/Tool.java", CODE, None),
        ("third_party/x/Tool.java", CODE, "vendored"),
        ("src/main/java/a/vendor/Tool.java", CODE, None),
        ("web/x.js", "// libx v1.2.3 (c) the libx contributors\nfunction f() {\n  return 1;\n}\n", "vendored"),
        ("web/x.js", "function f(a){return a.b(1)}" * 40, "minified"),
        ("web/x.js", "var t = [" + ",".join(map(str, range(1000, 1300))) + "];\n", "data"),
        ("src/x.py", "BLOB = (\n" + "".join(f'    "{"QUJDRAfe" * 10}"\n' for _ in range(9)) + ")\n", "data"),
        ("conf/x.json", "[" + ",".join(map(str, range(1000, 1300))) + "]", None),
        ("src/x.py", "BLOB = (\n" + "".join(f"    '{'0a9f3c' * 8}'\n" for _ in range(9)) + ")\n", "data"),
        ("src/x.py", "BLOB = (\n" + "".join("    b'" + "\\x0a\\xff" * 10 + "'\n" for _ in range(9)) + ")\n", "data"),
        ("web/x.js", "// loader\n" * 30 + "a.b(1);" * 300 + "\n", "minified"),
        ("web/x.js", "// loader\n" * 300 + "a.b(1);" * 50 + "\n", None),
        (None, "", None),
        ("vendor/x.py", "", "vendored"),
    ],
)
def test_file_kinds(path, text, kind):
    assert generated_files.kind(path, text) == kind


def test_file_kinds_name_their_source():
    assert generated_files.verdict("vendor/x.js", "function f(a){return a.b(1)}" * 40) == ("minified", "layout")
    assert generated_files.verdict("vendor/x.js", "f();\n") == ("vendored", "path")
    assert generated_files.verdict("web/x.js", "// Generated by x\nf();\n") == ("generated", "head")
    assert generated_files.verdict("web/x.js", "f();\n") == (None, None)


def test_layouts(spark):
    df = spark.createDataFrame([(1, "ab 1\n\nx\ncdé\n", "a"), (2, "", "b"), (3, None, "c"), (None, "a", "d")], "file_id int, text string, chars string")
    got = {r["id"]: (r["chars"], r["lines"], r["max_line"], r["mean_line"]) for r in generated_files.layouts(df, "file_id", "text").collect()}
    assert got == {1: (13, 2, 4, 4.0), 2: (0, 1, 0, 0.0), None: (1, 1, 0, 0.0)}
    assert generated_files.layouts(df.limit(0), "file_id", "text").count() == 0


def test_file_kinds_of_dirty_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (None, "vendor/a.py", None, "b"), (2, None, CODE * 400, "c"), (2, None, CODE, "c")], "file_id int, path string, contents string, kind string")
    assert sorted((str(r["id"]), str(r["kind"])) for r in generated_files.file_kinds(df, "file_id", "path", "contents").collect()) == [("1", "None"), ("2", "None"), ("2", "None"), ("None", "vendored")]
    assert generated_files.file_kinds(df.limit(0), "file_id", "path", "contents").count() == 0


GOOD = {
    "java": [
        CODE, "", "// only a comment", "import static a.B.*;\n@interface A { int x() default 1; String[] y() default {}; }",
        "enum E { A(1) { int f() { return 2; } }, B; E(int... x) {} int f() { return 1; } }",
        "class A<T extends Number & Comparable<T>> { <R> R f(List<? super T>[] x) throws E { for (int i = 0, j = 1; i < j; i++, j--) continue; for (final T t : x) { } return (R) (x == null ? this.<R>g() : new int[3][]); } }",
        "class A { void f() { try (R r = open(); S s = r.s()) { } catch (A | B e) { throw e; } finally { } switch (x) { case 1: default: break; } do x++; while (x < 3); a: while (true) break a; } }",
        "class A { int x = 0b1010_01 + 0x1.8p3f > 3 ? -1 : ~2; char c = '\\u0041', d = '\\''; Object o = new Object() { int y; { y = (int) +1; } }; int[] z = {1, 2,}; Class<?> k = int[].class; }",
        "class A { static { synchronized (this) { assert x > 0 : \"m\"; } } List<List<String>> l = new ArrayList<>(); boolean b = a < c && d > (e) || x instanceof Map.Entry; }",
    ],
    "js": ["var a = 1\nvar b = a / 2 / 3\n", "x = /[/]\\/(a)/g.test(y) ? {get: 1, set a(v) {}, 'b': [,1,,]} : void 0", "for (var k in o) if (k) { delete o[k] } else throw new E\n", "a: do { continue a } while (0) b()", "var i = function f(){ return\n1 }", "if (a) ; else b.class = c.new\n", ""],
    "py": ["x: int = 1\nif (y := x):\n    print(f'{y!r}')\n", "", "async def f():\n    await g()\n"],
    "json": ["{\"a\": [1, 2.5e3, null, true]}", "3"],
    "xml": ["<?xml version=\"1.0\"?><a b='c'>&lt;<!-- x --><![CDATA[<]]></a>"],
}
BAD = {
    "java": [
        CODE[:-3], CODE.replace(";\n    }", "\n    }"), "<<<<<<< HEAD\n" + CODE, "class A { void f() { x -> 1; } }", "class A { String s = \"a; }", "class A { /* }", "class A { void f() { a + b; } }", "class A { void f() { if x { } } }",
        "class A { int f( { } }", "class A { void f() { try { } } }", "class A { int x = ; }", "class A { void f() { else { } } }", "class { }", "int x;", "class A { char c = ''; }", "1;2;3\n4;5;6\n", "class A { void f() { int 3x; } }", "class A { void f() { foo(1,); } }",
    ],
    "js": ["let x = 1", "const a = 2", "() => 1", "`a`", "function (", "var a = {", "a b", "if (x) {", "x = 'a\nb'", "class A {}", "return )", "3 = x", "var a = 1 var b"],
    "py": ["print 'a'\n", "if x:\n", "def f(:\n    pass\n", "x = (1\n", "\tx\n  y\n"],
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": NaN}", "{} {}"],
    "xml": ["", "<a><b></a>", "<a>&</a>", "<a/><b/>"],
}


def test_syntax_verdicts():
    judge = syntax.Judge()
    for lang in GOOD:
        assert [t for t in GOOD[lang] if not judge(lang, t)] == [], lang
        assert [t for t in BAD[lang] if judge(lang, t)] == [], lang


def test_any_chunks_give_the_same_verdict():
    judge = syntax.Judge()
    for lang in ("java", "js", "json"):
        for valid, texts in ((True, GOOD[lang]), (False, BAD[lang])):
            for text in texts:
                text = text.replace("{", "{\n").replace(";", ";\n").replace("/*", "/*\n")
                whole = judge(lang, text)
                assert all(judge(lang, text, size) == whole for size in (1, 5, 40)), (lang, text)
    text = "/* a\n b */ class A {\n int x; /* } \n\n*/ void f() {\n g(\"/*\");\n }\n}\n" * 5
    assert all(judge("java", text, size) is True and judge("java", text + "/*", size) is False for size in (1, 5, 40, 10**6))
    text = "/* a\n b */ var x = 'a\\\n/*';\nvar y = a\n/ 2 / x; y = /[/*]/\n/* } \n\n*/\n"
    assert all(judge("js", text * 3, size) is True for size in (1, 5, 40, 10**6))
    assert syntax.join_summaries(("", "({"), ("})]", "[")) == ("]", "[")
    assert syntax.join_summaries(("", "("), ("}", "")) is None


def test_maps_fold_in_any_grouping():
    judge = syntax.Judge()
    text = CODE.replace("}\n", "/* c\n{ */ }\n") * 4
    maps = [judge.chunk("java", p) for p in syntax.chunks(text, 20)]
    want = judge.verdict("java", judge.from_start("java", maps))
    for k in range(1, len(maps)):
        parts = [judge.fold("java", maps[:k]), judge.fold("java", maps[k:])]
        assert judge.verdict("java", judge.from_start("java", parts)) == want


@pytest.mark.parametrize("n", [2000, 50_000])
def test_deep_nesting_is_no_syntax_error(n):
    judge = syntax.Judge()
    arms = min(n, 5000)
    for lang, text in (
        ("java", "class A { int x = " + "(" * n + "1" + ")" * n + "; }"),
        ("java", "class A { int x = " + "a ? 1 : " * arms + "2; }"),
        ("java", "class A { void f() { " + "if (a) { b(); } else " * arms + "c(); } }"),
        ("java", "class A { void f() " + "{\n" * n + "}\n" * n + " }"),
        ("js", "x = " + "(" * n + "1" + ")" * n),
        ("js", "x = " + "a ? 1 : " * arms + "2"),
        ("json", "[" * n + "]" * n),
    ):
        assert judge(lang, text) is True and judge(lang, text + ")") is False, lang


def test_parse_verdicts_of_dirty_and_long_rows(spark):
    long = "class A {\n" + "    void f() { g(1); }\n" * 200 + "}\n"
    rows = [(1, "a/A.java", long), (2, "a/A.java", long[:-2]), (3, "a/B.java", "/*\n" * 900), (4, "x.txt", "{"), (5, None, "{"), (6, "a.py", None), (None, "a.json", "{"), (7, "a.py", "x = 1"), (7, "a.py", "x = 1")]
    df = spark.createDataFrame(rows, "file_id int, path string, name string").withColumnRenamed("name", "contents").selectExpr("*", "1 as valid", "2 as lang")
    got = sorted((str(r["id"]), r["lang"], r["valid"]) for r in syntax.parse_verdicts(df, "file_id", "path", "contents", chunk=300, spread_chars=1000).collect())
    assert got == [("1", "java", True), ("2", "java", False), ("3", "java", False), ("7", "py", True), ("7", "py", True), ("None", "json", False)]
    assert syntax.parse_verdicts(df.limit(0), "file_id", "path", "contents").count() == 0


CLEAN = ["Für jede Änderung muss der Schlüssel zurückgesetzt werden", "Les données sont lues après la fermeture, même en cas d’échec", "Проверка длины строки перед записью", "行の長さを確認してから書き込む", "ATENÇÃO: NÃO ALTERAR ESTA SEÇÃO"]


@pytest.mark.parametrize("meant, read", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251")])
def test_encoding_repair_round_trip(spark, meant, read):
    rows = [(i, f"// {CLEAN[i % 5]} ({i})\nint x;\n") for i in range(60)]
    garbled = f"// {CLEAN[0]}".encode(meant).decode(read)
    rows += [(100, garbled + "\nint y;\n"), (101, "int z; // caf�s"), (102, None), (103, ""), (None, "plain"), (104, "'�'")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "file_id int, contents string, restored string")
    got = {r["id"]: (r["whole"], r["restored"]) for r in encoding_repair.garbled(df, "file_id", "contents").collect()}
    assert got == {100: (True, f"// {CLEAN[0]}\nint y;\n"), 101: (False, "int z; // caf�s")}
    assert encoding_repair.garbled(df.limit(0), "file_id", "contents").count() == 0


def test_best_two_fit_keeps_all_items_whole():
    rng = random.Random(4)
    for capacity in (1, 10, 257):
        sizes = [rng.randint(1, capacity) for _ in range(700)]
        bins = packing.best_two_fit(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in b) for b in bins) <= capacity
        assert len(bins) <= 1.03 * sum(sizes) / capacity + 1
    assert packing.best_two_fit([], 5) == []
    assert [sorted(b) for b in packing.best_two_fit([7, 5, 4, 6, 2], 12)] == [[0, 1], [2, 3, 4]]
    with pytest.raises(ValueError):
        packing.best_two_fit([6], 5)


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(0, 80), "a", 1) for i in range(300)] + [(500, "word " * 700, "a", 1), (501, None, "a", 1), (502, "", "a", 1), (None, "word", "a", 1), (0, "word word", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, container string, slot int").repartition(3)
    got = packing.pack(df, "doc_id", "text", capacity=256).toPandas()
    fill = got.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 256 and fill.sum() / (256 * len(fill)) > 0.95
    count = packing.token_counter()
    assert got["n_tokens"].sum() == sum(count(t) for _, t, *_ in rows if t)
    pieces = got[got["doc_id" if "doc_id" in got else "id"] == 500].sort_values("piece")
    assert (pieces["n_tokens"].iloc[:-1] == 256).all() and list(pieces["piece"]) == list(range(len(pieces)))
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def test_leaks(spark):
    rng = random.Random(8)
    lexicon = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(lexicon) for _ in range(40))) for i in range(20)]
    docs = []
    for k in range(80):
        body = [rng.choice(lexicon) for _ in range(60)]
        if k % 2:
            w = words(items[k % 20][1])
            n = rng.choice([11, 12, 13, 14, 30])
            at = rng.randrange(0, 40 - n + 1)
            body[20:20] = w[at : at + n]
        docs.append((k, ("\n- " if k % 3 else " ").join(body).upper() if k % 5 else ", ".join(body)))
    rows = [(*x, "x", 1) for x in docs] + [(None, items[0][1], "x", 1), (300, None, "x", 1), (301, "", "x", 1), (1, docs[1][1], "x", 1)]
    d = spark.createDataFrame(rows, "doc_id int, text string, item string, how int")
    b = spark.createDataFrame([*items, (None, items[1][1]), (50, None), (51, "short"), items[3]], "item_id int, text string")
    grams = lambda t: {tuple(words(t)[i : i + 13]) for i in range(len(words(t)) - 12)}
    want = {(k, i) for k, t in docs for i, u in items if grams(t) & grams(u)}
    got = {(r["doc"], r["item"]) for r in contamination.leaks(d, b, changed=False).collect()}
    assert got == want and got
    few, contamination.LEAST_BITS, contamination.MOST_BITS = (contamination.LEAST_BITS, contamination.MOST_BITS), 4, 4
    try:  # a filter that lets much through changes nothing
        assert {(r["doc"], r["item"]) for r in contamination.leaks(d, b, changed=False).collect()} == want
    finally:
        contamination.LEAST_BITS, contamination.MOST_BITS = few
    assert contamination.leaks(d.limit(0), b).count() == 0 and contamination.leaks(d, b.limit(0)).count() == 0


def test_changed_items_need_consistent_slots(spark):
    item = "a train leaves the town at 9 hours and runs 120 km until 9 hours are over and 120 km are done then it stops"
    other = item.replace("9", "7").replace("120", "88")
    mixed = item.replace("at 9", "at 7").replace("120", "88")
    d = spark.createDataFrame([(1, item), (2, other), (3, mixed), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")], "doc_id int, text string")
    b = spark.createDataFrame([(1, item), (2, "9 8 7 6 5 4 3 2 1 0 11 12 13 14 15")], "item_id int, text string")
    got = {(r["doc"], r["item"]): r["how"] for r in contamination.leaks(d, b, w=22).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "changed"}


QUESTION = "{a} has {n} boxes of screws and {b} brings {m} kg of nails to the workshop, so how many hours do {a} and {b} need until every shelf is full"


def test_names_are_told_on_each_side(spark):
    item = QUESTION.format(a="Alice", b="Robert", n="12", m="7")
    docs = {
        1: QUESTION.format(a="Brigitte", b="Cedric", n="12", m="7"),
        2: QUESTION.format(a="Alice", b="Robert", n="12.5", m="1,000"),
        3: QUESTION.format(a="Mary Ann", b="Robert", n="3", m="7"),
        4: QUESTION.format(a="Brigitte", b="Cedric", n="12", m="7").replace("do Brigitte", "do Dora"),
        5: QUESTION.format(a="Alice", b="Robert", n="12", m="7").upper(),
        6: QUESTION.format(a="alice", b="robert", n="15", m="7"),
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    for others in ([], [(2, "it was alice who said that robert would come to the office in the late afternoon of that day")]):
        b = spark.createDataFrame([(1, item), *others], "item_id int, text string")
        got = {r["doc"]: r["how"] for r in contamination.leaks(d, b, w=30).filter("item = 1").collect()}
        assert got == {1: "changed", 2: "changed", 3: "changed", 5: "verbatim", 6: "changed"}


def test_recall_of_planted_changes(spark):
    rng = random.Random(11)
    lexicon = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "mu", "re") for b in ("la", "ne", "to", "vi") for c in ("n", "s", "r")]
    names = [a + b + c for a in "BCDFGKLMNPRST" for b in ("arvo", "elin", "imka", "ostra", "ulem") for c in ("", "na", "to")]
    numbers = [*map(str, range(2, 90)), *(f"{i}.{i + 7}" for i in range(40))]
    pools = {"name": names, "number": numbers, "unit": ["km", "hours", "kg"]}
    items, docs = [], []
    for i in range(150):
        words = [rng.choice(["name", "number", "unit"]) + str(rng.randrange(3)) if rng.random() < 0.25 else rng.choice(lexicon) for _ in range(45)]
        sides = []
        for _ in range(2):
            slot = {f"{k}{j}": v for k, pool in pools.items() for j, v in enumerate(rng.sample(pool, 3))}
            sides.append(" ".join(slot.get(w, w) for w in words))
        items.append((i, sides[0]))
        docs.append((i, "Intro words come first. " + sides[1] + " And more."))
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc"], r["item"]) for r in contamination.leaks(d, b, w=13).collect()}
    assert all(x == y for x, y in got) and len(got) >= 0.9 * len(items)


def test_personal_data_places():
    text = (
        "Ask Sofia Varley about this.\nAuthor: Varley, Sofia <svarley@example.com>\nmobile: 0049 (30) 23125275 or (202) 555-0122, +33 1 99 00 39 78\n"
        "SSN 959-24-8536, Steuer-ID: 29 474 832 602, passport no. XQ2543565\nDr. A. Dorane (ANNA at example dot org), who wrote it\n"
        "Our office is at 206 Fern Street, or Brindlegasse 239, 12 bis, rue des Ravens, Calle Copper 120.\nBest,\nPetra\n> Quindahl"
    )
    got = [(k, text[a:b]) for k, a, b in personal_data.find(text)]
    assert got == [
        ("name", "Sofia Varley"), ("name", "Varley, Sofia"), ("email", "svarley@example.com"), ("phone", "0049 (30) 23125275"), ("phone", "(202) 555-0122"), ("phone", "+33 1 99 00 39 78"),
        ("idnum", "959-24-8536"), ("idnum", "29 474 832 602"), ("idnum", "XQ2543565"), ("name", "A. Dorane"), ("email", "ANNA at example dot org"),
        ("address", "206 Fern Street"), ("address", "Brindlegasse 239"), ("address", "12 bis, rue des Ravens"), ("address", "Calle Copper 120"), ("name", "Petra\n> Quindahl"),
    ]
    for decoy in ("Street View tiles", "Merge Sort and Hash Join", "git@code.host.test:a/b.git", "<user>@<host>", "Call f() at 583-535-124 boundaries", "Build 369.404.607", "Port 80 on 10.0.8.11", "lib@95.403.1", "Signed-off-by: deck-bot", "2013-03-14 04:13:24", ""):
        assert personal_data.find(decoy) == [], decoy


def test_very_long_texts():
    text = "Ask Zeynep Yilmaz about this, or mail a.b@example.com at 206 Fern Street. " * 20_000 + "Aa" * 200_000 + " " * 200_000 + "a.b" * 100_000
    found = personal_data.find(text)
    assert len(found) == 60_000 and found == sorted(found, key=lambda x: x[1]) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))
    assert generated_files.kind("a.java", "int x;\n" * 200_000) is None
    assert syntax.Judge()("java", "class A { void f() { " + "g(1);\n" * 200_000 + "} }") is True


def test_surrogates():
    key = b"k"
    assert personal_data.canonical("name", "Varley,\n> Sofia") == personal_data.canonical("name", "Sofia Varley")
    seen = {personal_data.permuted(key, "phone", f"{i:04}") for i in range(10_000)}
    assert len(seen) == 10_000 and all(len(x) == 4 for x in seen)
    a = personal_data.surrogate(key, "name", "Sofia Varley")
    b = personal_data.surrogate(key, "name", "Varley, Sofia")
    assert a.split(" ") == b.split(", ")[::-1] and a.split(" ")[0] in personal_data.FEMALE
    phone = personal_data.surrogate(key, "phone", "(202) 555-0122")
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", phone) and phone != "(202) 555-0122"
    assert personal_data.surrogate(key, "phone", "(202) 555-0122", 0) == phone
    for kind, piece in (("address", "206 Fern Street"), ("address", "Brindlegasse 239"), ("address", "Calle Copper 120"), ("email", "a.b at example dot org"), ("idnum", "XQ2543565")):
        assert personal_data.surrogate(key, kind, piece) not in ("", piece)


@pytest.mark.parametrize(
    "text, name",
    [
        ("Ask Zeynep Yilmaz about this.", "Zeynep Yilmaz"), ("Priya Raman wrote:", "Priya Raman"), ("Signed-off-by: Kwame Mensah <k@x.org>", "Kwame Mensah"), ("Thanks to Wojciech Kowalski", "Wojciech Kowalski"),
        ("I talked to Nguyen Van Minh yesterday", "Nguyen Van Minh"), ("Ask 李雷 about this.", "李雷"), ("作者：李雷", "李雷"), ("Иван Петров написал код", "Иван Петров"), ("Best,\n\nKwame Mensah\n", "Kwame Mensah"),
        ("co-authored by Zeynep X. Yilmaz", "Zeynep X. Yilmaz"), ("Reported-by: Mensah, Kwame <k@x.org>", "Mensah, Kwame"),
    ],
)
def test_names_outside_the_list(text, name):
    assert [text[a:b] for k, a, b in personal_data.find(text) if k == "name"] == [name]


def test_given_names_are_learned_from_the_corpus(spark):
    rng = random.Random(5)
    first = [a + b for a in ("Bra", "Ove", "Kwi", "Tjo") for b in ("ndo", "lisa", "mek", "run")]
    last = [a + b for a in ("Dor", "Fel", "Gam") for b in ("ander", "stok", "wick")]
    person = lambda: f"{rng.choice(first)} {rng.choice(last)}"
    told = [(i, f"The Merge Sort is slow. Signed-off-by: {person()} <a{i}@x.org>") for i in range(150)]
    plain = [(1000 + i, f"Yesterday {person()} changed the Merge Sort and the Hash Join.") for i in range(100)]
    df = spark.createDataFrame([*told, *plain, (None, None), (5, "")], "doc_id int, text string")
    learned = personal_data.given_names(df, "text")
    assert learned == frozenset(first)
    got = personal_data.personal_data(df, "doc_id", "text").filter("kind = 'name' and id >= 1000").collect()
    assert len(got) == 100 and all(r["piece"].split()[0] in learned for r in got)
    assert personal_data.given_names(df.limit(0), "text") == frozenset()


def test_surrogates_keep_script_gender_and_form():
    key = b"k"
    show = lambda x: personal_data.surrogate(key, "name", x)
    assert re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+ова", show("Вера Петрова")) and show("Вера Петрова").split()[0] in personal_data.SCRIPTS["cyrillic"][1]
    assert re.fullmatch(r"[一-鿿]{3}", show("李小雷")) and re.fullmatch(r"[가-힣]{3}", show("김민수"))
    assert len(show("Zeynep Yilmaz").split()) == 2 and not show("Zeynep Yilmaz").split()[0].endswith(".")
    assert re.fullmatch(r"[A-Z]\. [A-Z][a-z]+", show("A. Dorane")) and re.fullmatch(r"[A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+", show("Petra X. Dorane"))


def test_clashing_surrogates_are_drawn_again(spark, monkeypatch):
    rows = [("phone", f"{i:03}", f"{i:03}") for i in range(60)] + [("name", f"anna a{chr(97 + i)}", f"Anna A{chr(97 + i)}") for i in range(20)]
    monkeypatch.setattr(personal_data, "surrogate", lambda key, kind, piece, salt=0: f"{(sum(map(ord, piece)) * 7 + salt * 131) % 4099:04}" if kind == "phone" else f"anna {'abcdefghij'[(sum(map(ord, piece)) + salt * 3) % 10] * (salt + 1)}")
    entities = spark.createDataFrame(rows, "kind string, name string, piece string")
    import sys

    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["keyloom.llm.personal_data"])
    try:
        got = personal_data.surrogates(entities, b"k").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["keyloom.llm.personal_data"])
    assert len(got) == 80 and len({(r["kind"], r["shown"]) for r in got}) == 80 and any(r["salt"] for r in got)
    assert not {(r["kind"], r["shown"]) for r in got} & {(k, n) for k, n, _ in rows}


def test_replacement_of_rows(spark):
    rows = [(1, "Ask Sofia Varley about this."), (2, "call me at (202) 555-0122"), (3, None), (4, ""), (None, "Ask Sofia Varley about this."), (5, "nothing here")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, kind string, piece int")
    for mode in ("placeholder", "surrogate"):
        got = {r["id"]: r["text"] for r in personal_data.pseudonymised(df, "doc_id", "text", b"k", mode).collect()}
        assert got[1] == got[None] and "Varley" not in got[1] and got[1].endswith("about this.")
        assert "555-0122" not in got[2] and got[3] is None and got[4] == "" and got[5] == "nothing here"
    assert [tuple(r)[:3] for r in personal_data.personal_data(df, "doc_id", "text").filter("id = 1").collect()] == [(1, "name", 4)]
    assert personal_data.personal_data(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("near", [False, True])
@pytest.mark.parametrize("meant", ["// Schlüssel für 21 °C ± 3 µm", "// Проверка длины строки"])
def test_encoding_repair_of_a_third_of_all_rows(spark, meant, near):
    rows = [(i, f"// {CLEAN[i % 5]} ({i})\nint x;\n") for i in range(60)]
    garbled = encoding_repair.meant_text(meant.encode(), "latin_1")
    tails = {i: f"\nint y{i if near else 0};\n" for i in range(100, 130)}
    df = spark.createDataFrame([*rows, *((i, garbled + t) for i, t in tails.items())], "file_id int, contents string")
    got = {r["id"]: (r["whole"], r["restored"]) for r in encoding_repair.garbled(df, "file_id", "contents").collect()}
    assert got == {i: (True, meant + t) for i, t in tails.items()}


def test_every_clean_file_is_planted(spark, tmp_path):
    texts = [f"// {CLEAN[i % 5]} ({i})\nint x;\n" for i in range(60)]
    texts = [t for t in texts if hashlib.sha1(t.encode()).hexdigest()[0] in "07f"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (2, "// " + encoding_repair.meant_text(CLEAN[0].encode(), "latin_1")), (None, "// caf�s"), (100, None), (101, "int x;")]
    spark.createDataFrame(rows, "file_id bigint, contents string").write.parquet(str(tmp_path / "code_files.parquet"))
    got = {r["read_as"]: (r["n"], r["n_found"]) for r in encoding_repair.planted(spark, str(tmp_path)).collect()}
    n = {read: sum(encoding_repair.meant_text(t.encode(), read) is not None for t in texts) for read in ("windows-1252", "ISO-8859-1", "windows-1251")}
    assert n["ISO-8859-1"] == len(texts) >= 6 and {read: k for read, (k, _) in got.items()} == n
    assert sum(f for _, f in got.values()) >= 0.8 * sum(n.values())


def test_words_well_formed_by_chance_are_left_alone():
    texts = ["dans le CAFÉ» et TERMINÉ…", "PÓŁ", "пункт В»", "там и тем", "═╗ ╚═", "├── a\n└── b"]
    counts = encoding_repair.pair_counts([line for t in texts for line in t.split("\n")])
    model = encoding_repair.PairModel(counts, sum(counts.values()))
    assert [w for t in texts for w in t.split() if encoding_repair.certain(w, model)] == []
    assert encoding_repair.certain("fÃ¼r", model) == "für" and encoding_repair.certain("Ã\xa0", model) == "à" and encoding_repair.certain("é", model) is None
