"""Problem 9: evaluation items inside documents, by template canonicalisation.

A text becomes a row of templates: a word is a typed placeholder if it is a number, a unit or (in the second form) a name,
else itself. The type depends on the word as it is written and on nothing else, neither on the rest of the text nor on other items, so
both sides decide alike and no result depends on how items are grouped. Template windows of the items and of all
documents are hash-joined; the slots, the words behind the placeholders, then tell verbatim leaks (slots equal)
from re-parameterised ones (slots mapped one to one).

Two forms are used. Plain: words are runs of [a-z0-9] after lower-casing, with numbers and units as types; windows with equal words
have equal templates. Cased: words as written, 12.5 or 1,000 is one number, capitalised words and identifiers in mixed case are
names, and a name of several words is one slot.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.hashing import U, blocks, mix
from keyloom.operators.skew import spread
from keyloom.store import written

WORD = re.compile(r"[a-z0-9]+")
CASED = re.compile(r"\d+(?:[.,]\d+)*[^\W_]*|[^\W\d_][^\W_]*(?:['’][a-z]+)?")
NUMBER = re.compile(r"[0-9][0-9.,]*|0x[0-9a-f]+|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|fifty|hundred|thousand")
UNITS = frozenset("ms s sec secs second seconds minute minutes hour hours day days week weeks month months year years byte bytes kb mb gb tb kib mib gib mm cm m km inch inches mile miles g kg mg lb lbs pound pounds eur usd dollar dollars euro euros percent degree degrees hz khz mhz ghz w kw px line lines thread threads row rows file files".split())
#: Words that begin sentences and are no names.
STARTERS = frozenset("a after all also an and any are as at because before both but by can could did do does each either every find first for from given had has have he her here his how however i if in is it its let many may more most much my neither next no not now of on once one only or other our out over see she should since so some such than that the their then there these they this those to two under until up use using was we were what when where which while who whose why will with would you your".split())
BASE = 0x9E3779B97F4A7C15 | 1
PLAIN, WITH_NAMES = 1, 2


def kind_of(word: str, form: int) -> str | None:
    """number, unit, name or None, by the word alone."""
    low = word.lower() if form == WITH_NAMES else word
    if word[0].isdigit() or NUMBER.fullmatch(low):
        return "number"
    if low in UNITS:
        return "unit"
    if form == WITH_NAMES and len(word) > 1 and not word.isupper():
        mixed = any(c.isupper() for c in word[1:])
        if mixed or word[0].isupper() and low.split("'")[0].split("’")[0] not in STARTERS:
            return "name"
    return None


class Templates:
    """Words of one form as rows: the word, its template and the template's hash; emptied between blocks when large."""

    def __init__(self, form: int, most: int = 500_000):
        self.form, self.most = form, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: list[str] = []
        self.templates: list[str] = []
        self.kinds: list[int] = []
        self.table, self.names = np.empty(0, U), np.empty(0, bool)

    def _add(self, word: str) -> None:
        kind = kind_of(word, self.form)
        self.ids[word] = len(self.words)
        self.words.append(word.lower())
        self.templates.append(f"<{kind}>" if kind else word.lower())
        self.kinds.append(0 if kind is None else 2 if kind == "name" else 1)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word ids of all texts, first word of each template, template hashes, number of templates of each text). Names in a row are one template."""
        if len(self.ids) > self.most:
            self.clear()
        ids, flat, sizes = self.ids, [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = [] if not text else WORD.findall(text.lower()) if self.form == PLAIN else CASED.findall(text)
            sizes[k] = len(words)
            try:
                flat += [ids[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in ids:
                        self._add(w)
                flat += [ids[w] for w in words]
        done = len(self.table)
        if len(self.words) > done:
            self.table = np.append(self.table, np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in self.templates[done:]), U, len(self.words) - done))
            self.names = np.append(self.names, np.array(self.kinds[done:]) == 2)
        at = np.array(flat, np.int64)
        keep = np.ones(len(at), bool)
        if self.form == WITH_NAMES and len(at):
            owner, name = np.repeat(np.arange(len(texts)), sizes), self.names[at]
            keep[1:] = ~(name[1:] & name[:-1] & (owner[1:] == owner[:-1]))
            sizes = np.bincount(owner[keep], minlength=len(texts))
        first = np.flatnonzero(keep)
        return at, first, self.table[at[first]], sizes

    def window(self, at: np.ndarray, first: np.ndarray, p: int, w: int) -> tuple[str, list[str]]:
        """(templates, slots) of the w templates from p."""
        ends = [*first[p + 1 : p + w].tolist(), int(first[p + w]) if p + w < len(first) else len(at)]
        shown, slots = [], []
        for a, b in zip(first[p : p + w].tolist(), ends):
            i = int(at[a])
            shown.append(self.templates[i])
            if self.kinds[i]:
                slots.append(" ".join(self.words[j] for j in at[a:b].tolist() if self.kinds[j] == self.kinds[i]))
        return " ".join(shown), slots


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.concatenate([[U(1)], np.cumprod(np.full(max(n - 1, 0), U(b)), dtype=U)])[:n] for b in (BASE, inverse))


def rolling(t: np.ndarray, w: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Polynomial hash of each window of w successive values, modulo 2^64."""
    if len(t) < w:
        return np.empty(0, U)
    sums = np.concatenate([[U(0)], np.cumsum(t * powers[0][: len(t)], dtype=U)])
    n = len(t) - w + 1
    return mix((sums[w:] - sums[:n]) * powers[1][:n])


def _windows(w: int, form: int, kind: pa.DataType, held=None, bits: int = 0):
    """(id, window, template, slots), distinct within a block; only windows whose bit is set if a bitmap is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, powers = Templates(form), _powers(1)
        known = None if held is None else np.frombuffer(held.value, np.uint8)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for i, j in blocks(texts):
                at, first, th, sizes = enc.encode(texts[i:j])
                if len(th) >= len(powers[0]):
                    powers = _powers(2 * len(th))
                h = rolling(th, w, powers)
                ends = np.cumsum(sizes)
                if known is None:
                    hit = np.arange(len(h))
                else:
                    at_bit = h >> U(64 - bits)
                    hit = np.flatnonzero(known[(at_bit >> U(3)).astype(np.int64)] >> (at_bit & U(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(ends, hit, side="right")
                inside = hit + w <= ends[doc] if len(hit) else np.empty(0, bool)
                hit, doc = hit[inside], doc[inside]
                rows = {}
                for p, d in zip(hit.tolist(), doc.tolist()):
                    shown, slots = enc.window(at, first, p, w)
                    rows[d, shown, tuple(slots)] = p
                at_rows = list(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(i, j - i).take(pa.array([d for d, _, _ in at_rows], pa.int64())).cast(kind),
                        pa.array(h[list(rows.values())].view(np.int64) if rows else [], pa.int64()),
                        pa.array([t for _, t, _ in at_rows], pa.string()),
                        pa.array([list(s) for _, _, s in at_rows], pa.list_(pa.string())),
                    ],
                    ["id", "window", "template", "slots"],
                )

    return run


def _windowed(rows: DataFrame, w: int, form: int, held=None, bits: int = 0) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_windows(w, form, to_arrow_type(kind), held, bits), f"id {kind.simpleString()}, window bigint, template string, slots array<string>")


def bitmap(windows: DataFrame, bits: int) -> bytearray:
    """2^bits bits, set for the leading bits of each window's hash. Built by executors in segments of 4 KB, so at most 2^bits / 8 bytes reach the driver, whatever the input."""
    x = F.shiftrightunsigned("window", 64 - bits) + 1
    parts = windows.select(F.bitmap_bucket_number(x).alias("segment"), F.bitmap_bit_position(x).alias("position"))
    out = bytearray(1 << bits - 3)
    for r in parts.groupBy("segment").agg(F.bitmap_construct_agg("position").alias("b")).collect():
        out[(r["segment"] - 1) * 4096 : r["segment"] * 4096] = r["b"]
    return out


def one_to_one(a: Column, b: Column) -> Column:
    """Whether position by position a maps to b and b to a."""
    pairs = F.size(F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b"))))
    return (pairs == F.size(F.array_distinct(a))) & (pairs == F.size(F.array_distinct(b)))


#: Bits of the filter: 16 for each item window, but at most 2^MOST_BITS, 64 MB. Beyond 2^25 windows more documents' windows pass it and the join does more.
LEAST_BITS, MOST_BITS = 20, 29


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", w: int = 13, changed: bool = True, least_fixed: int = 8, names: bool = True) -> DataFrame:
    """(doc, item, how), one row each: how is verbatim (w successive words in common) or changed (w successive templates equal, numbers, units and names mapped one to one, at least
    least_fixed of them words); a window that some item has word for word counts for that item only.
    Without names only numbers and units are types.

    Null ids and texts, and items of fewer than w words, leak nothing; repeated rows count once; other columns are not read.

    One plan whatever the number of items: the windows of the items set bits in a filter of bounded size, which is broadcast; a pass over
    the documents keeps the windows that pass it, and these are joined by hash with those of the items by an ordinary (adaptive) join.
    Templates are compared as text after the join, so equal hashes of different windows give no leak. No item text goes
    through the driver. In documents without capitals names are no slots: there only numbers and units may differ.
    """
    spark = docs.sparkSession
    rows = spread(docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text")).filter("id is not null and text is not null"))
    source = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null")
    found = None
    for form in (PLAIN, WITH_NAMES) if changed and names else (PLAIN,):
        theirs = written(_windowed(source, w, form).distinct(), "item_windows")
        bits = min(MOST_BITS, max(LEAST_BITS, (16 * theirs.count()).bit_length()))
        held = spark.sparkContext.broadcast(bytes(bitmap(theirs, bits)))
        mine = _windowed(rows, w, form, held, bits).select(F.col("id").alias("doc"), "window", F.col("template").alias("t"), F.col("slots").alias("s"))
        named = theirs.withColumnRenamed("id", "item")
        hits = []
        if form == PLAIN:
            hits.append(mine.join(named, "window").filter((F.col("t") == F.col("template")) & (F.col("s") == F.col("slots"))).select("doc", "item", F.lit("verbatim").alias("how")))
        if changed:
            # a window that some item has word for word is that item's, not a changed one of the others with its template
            told = theirs.select("window", F.col("template").alias("t"), F.col("slots").alias("s")).distinct()
            open_ = mine.join(told, ["window", "t", "s"], "left_anti").join(named, "window").filter((F.col("t") == F.col("template")) & (w - F.size("slots") >= least_fixed))
            hits.append(open_.filter(one_to_one(F.col("s"), F.col("slots"))).select("doc", "item", F.lit("changed").alias("how")))
        for h in hits:
            found = h if found is None else found.unionByName(h)
    return found.groupBy("doc", "item").agg(F.max("how").alias("how"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id: documents and items with at least 13 successive words in common."""
    found = leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"), changed=False)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id, how: also items whose numbers, units and names were changed."""
    found = leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "how")


def p9_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id, how: documents against items whose numbers got a further digit, so that leaks are re-parameterised ones; numbers and units are types."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").withColumn("text", F.regexp_replace("text", r"\b([0-9]+)\b", "$17"))
    found = leaks(spark.read.parquet(f"{d}/documents.parquet"), items, names=False)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "how")


_TYPED = f"CASE WHEN regexp_full_match(x, '[0-9].*|{NUMBER.pattern}') THEN '<number>' WHEN x IN ({', '.join(repr(u) for u in sorted(UNITS))}) THEN '<unit>' ELSE x END"
QUERIES = {"p9_found": p9_found, "p9_renumbered": p9_renumbered, "p9_leaks": p9_leaks}
SQL = {
    "p9_renumbered": rf"""
WITH a AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(regexp_replace(text, '\b([0-9]+)\b', '\17', 'g')), '[a-z0-9]+') FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
t AS (SELECT side, id, w, list_transform(w, lambda x: {_TYPED}) AS t FROM a),
p AS (SELECT side, id, w[i : i + 12] AS w, t[i : i + 12] AS t FROM (SELECT side, id, w, t, unnest(range(1, len(w) - 11)) AS i FROM t)),
x AS (SELECT DISTINCT side, id, array_to_string(w, ' ') AS g, array_to_string(t, ' ') AS g2, t, list_filter(w, lambda v, k: t[k] IN ('<number>', '<unit>')) AS s FROM p),
told AS (SELECT DISTINCT g FROM x WHERE side = 'i'),
m AS (SELECT d.id AS doc_id, i.id AS item_id, d.g = i.g AS same, d.g IN (SELECT g FROM told) AS known, d.s AS ds, i.s AS s FROM x d JOIN x i ON d.g2 = i.g2 WHERE d.side = 'd' AND i.side = 'i')
SELECT doc_id, item_id, max(how) AS how FROM (SELECT doc_id, item_id, CASE WHEN same THEN 'verbatim' WHEN NOT known AND 13 - len(s) >= 8
  AND len(list_distinct(list_zip(ds, s))) = len(list_distinct(ds)) AND len(list_distinct(list_zip(ds, s))) = len(list_distinct(s)) THEN 'changed' END AS how FROM m) WHERE how IS NOT NULL GROUP BY ALL""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b))
SELECT DISTINCT doc_id, item_id FROM dw JOIN bw USING (g)"""
}
