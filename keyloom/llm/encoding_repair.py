"""Problem 6: text garbled by a wrong decoding, found by character-pair statistics and undone by inverse mappings.

The corpus' pairs of adjacent characters with a non-ASCII one are counted; a pair's weight is its share of the corpus
mutual information, that is its relative frequency times its association. Runs of improbable pairs are the
maximum-scoring segments of each line. In them the inverse mappings (encode as it was read, decode as it was
meant) are tried; a run is garbled if one of them gives clearly more probable text, or well-formed UTF-8, or if
it holds characters that only a wrong decoding leaves (replacement characters in words, C1 controls).
What is garbled often is not improbable: so each text counts once, and every word outside these runs is tried for
well-formed UTF-8 too, whatever its own weight.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.skew import spread
from keyloom.store import discard, written

#: Pairs of a lower relative frequency are not sent to the tasks and count as unseen, so at most RARE of them are.
RARE = 1 << 20
#: Encodings of legacy text, by Python's names. "raw" is Windows Latin with the bytes it leaves open passed through.
READERS = ["raw", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp1253", "cp1254", "gbk", "shift_jis", "euc_jp", "euc_kr", "big5"]
MEANT = ["utf_8", "cp1252", "mac_roman", "cp850", "cp437", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1253", "cp1254", "shift_jis", "euc_jp", "gbk", "euc_kr", "big5"]
LATIN = frozenset(["raw", "latin_1"])
WESTERN = LATIN | {"mac_roman", "cp437", "cp850"}
WIDE = frozenset(["gbk", "shift_jis", "euc_jp", "euc_kr", "big5"])
NON_ASCII_LINE = re.compile(r"[^\n]*[^\x00-\x7f\n][^\n]*")
LOST = re.compile(r"\w�|�\w|��")
#: Blanks of ASCII only: a no-break space may be a byte of a garbled character.
NON_ASCII_WORD = re.compile(r"[^\x00-\x20\x7f-\U0010ffff]*[^\x00-\x7f][^\x00-\x20]*")
CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")


def pair_counts(lines: list[str]) -> Counter:
    """Counts of adjacent pairs with a non-ASCII character, a line's ends counting as blanks."""
    n: Counter = Counter()
    for line in lines:
        line = f" {line} "
        n.update(a + b for a, b in zip(line, line[1:]) if a > "\x7f" or b > "\x7f")
    return n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], ["pair", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            n.update(pair_counts(NON_ASCII_LINE.findall(text)))
        if len(n) > 300_000:
            yield out()
            n.clear()
    if n:
        yield out()


class PairModel:
    """Log weights of pairs: log p(x, y), plus the log of the pair's association where that is below 1."""

    def __init__(self, counts: dict[str, int], total: int):
        self.kept: dict[str, str | None] = {}  # what certain() says of words
        self.floor = math.log(0.5 / max(total, RARE // 16))
        left, right = Counter(), Counter()
        for pair, n in counts.items():
            left[pair[0]] += n
            right[pair[1]] += n
        self.weight = {}
        for pair, n in counts.items():
            association = math.log(n * total / (left[pair[0]] * right[pair[1]]) + 1e-12)
            self.weight[pair] = math.log(n / total) + math.log(min(1.0, max(association, 0.05)))
        # what half of the corpus' pairs exceed: lower pairs are worth a look
        seen, self.usual = 0, self.floor
        for pair, n in sorted(counts.items(), key=lambda x: -self.weight[x[0]]):
            seen += n
            self.usual = self.weight[pair]
            if seen > 0.6 * total:
                break

    def mean(self, text: str) -> tuple[float, int, int]:
        """(mean weight, pairs, unseen pairs) of the pairs with a non-ASCII character."""
        text = f" {text} "
        pairs = [a + b for a, b in zip(text, text[1:]) if a > "\x7f" or b > "\x7f"]
        got = [self.weight.get(p, self.floor) for p in pairs]
        return (sum(got) / len(got) if got else 0.0), len(got), sum(p not in self.weight for p in pairs)

    def segments(self, line: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs, widened to word ends, joined where only ASCII lies between."""
        padded, best, start, run, found = f" {line} ", 0.0, 0, 0.0, []
        end = 0
        for i, (a, b) in enumerate(zip(padded, padded[1:])):
            score = self.usual - self.weight.get(a + b, self.floor) if a > "\x7f" or b > "\x7f" else -0.02
            if run <= 0:
                if best > 0:
                    found.append((start, end))
                run, best, start = 0.0, 0.0, i
            run += score
            if run > best:
                best, end = run, i + 1
        if best > 0:
            found.append((start, end))
        out: list[tuple[int, int]] = []
        for a, b in found:
            a, b = max(a - 1, 0), min(b, len(line))
            while a > 0 and not line[a - 1].isspace():
                a -= 1
            while b < len(line) and not line[b].isspace():
                b += 1
            if out and line[out[-1][1] : a].isascii():
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out


def raw_bytes(text: str, reader: str) -> bytes | None:
    try:
        if reader != "raw":
            return text.encode(reader)
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode("cp1252")
            except UnicodeEncodeError:
                if not "\x80" <= ch <= "\x9f":
                    return None
                out.append(ord(ch))
        return bytes(out)
    except UnicodeEncodeError:
        return None


def meant_text(raw: bytes, meant: str) -> str | None:
    try:
        return raw.decode(meant)
    except UnicodeDecodeError:
        return None


def inverse(run: str, model: PairModel, depth: int = 2) -> tuple[str, str, str] | None:
    """(restored, reader, meant) of the best inverse mapping that makes the run clearly more probable, or None."""
    own, n, _ = model.mean(run)
    best, won = own, None
    high, letters = sum(ch > "\x7f" for ch in run), sum(ch.isalpha() and ch < "\x80" for ch in run)
    for reader in READERS:
        raw = raw_bytes(run, reader)
        if raw is None or raw.isascii():
            continue
        for meant in MEANT:
            if meant == reader or (reader in ("raw", "latin_1") and meant == "cp1252"):
                continue
            text = meant_text(raw, meant)
            if text is None or text == run or text.isascii() or CONTROL.search(text) and meant != "utf_8":
                continue
            if meant == "utf_8" and depth > 1 and not model.mean(text)[2] == 0 and (deeper := inverse(text, model, depth - 1)):
                text = deeper[0]
            mean, m, unseen = model.mean(text)
            strict = meant == "utf_8" and reader not in WIDE
            # well-formed UTF-8 is evidence of its own; other mappings must give pairs that the corpus knows
            # the bytes of a multi-byte encoding, read as single characters, give runs with hardly an ASCII letter
            dense = meant in WIDE and reader not in WIDE and len(text) >= 4 and high >= 6 and high > 4 * letters
            gain = mean - own + (3.0 if strict else 2.5 if dense else 0.0)
            if gain > max(best - own, 1.2) and (strict or unseen * 4 <= m or dense and unseen * 3 <= 2 * m):
                best, won = own + gain, (text, reader, meant)
    return won


def certain(word: str, model: PairModel, depth: int = 2) -> str | None:
    """The well-formed UTF-8 that the word is when encoded as it was read, or None; the word's own weight is not looked at.

    Short words of other languages are well-formed by chance, so what comes out must be of a kind that chance hardly gives:
    characters of Latin-1, several Greek or Cyrillic ones, or any of three bytes or more, read as Western text; else two or more
    characters all of whose pairs the corpus knows.
    """
    best, won = -math.inf, None
    for reader in READERS:
        raw = raw_bytes(word, reader) if reader not in WIDE else None
        text = meant_text(raw, "utf_8") if raw else None
        if text is None or text == word or text.isascii() or CONTROL.search(text):
            continue
        high = [ch for ch in text if ch > "\x7f"]
        mean, _, unseen = model.mean(text)
        latin = reader in LATIN and all("\xa0" <= ch <= "\xff" or ch >= "\u0370" and (len(high) > 1 or ch >= "\u0800") for ch in high)
        western = reader in WESTERN and all(ch >= "\u0800" for ch in high)
        if (latin or western or len(high) > 1 and unseen == 0) and mean > best:
            best, won = mean, text
    return (certain(won, model, depth - 1) or won) if won and depth > 1 else won


def certain_runs(line: str, taken: list[tuple[int, int]], model: PairModel, kept: dict) -> list[tuple[int, int, str]]:
    """(start, end, restored) of the words outside the taken spans that certain() restores, joined where only ASCII lies between."""
    out: list[tuple[int, int, str]] = []
    for m in NON_ASCII_WORD.finditer(line):
        word, (a, b) = m.group(), m.span()
        if "\ufffd" in word or any(x < b and a < y for x, y in taken):
            continue
        if word not in kept:
            if len(kept) > 100_000:
                kept.clear()
            kept[word] = certain(word, model)
        if kept[word] is None:
            continue
        if out and line[out[-1][1] : a].isascii() and not any(out[-1][1] <= x < a for x, _ in taken):
            out[-1] = (out[-1][0], b, out[-1][2] + line[out[-1][1] : a] + kept[word])
        else:
            out.append((a, b, kept[word]))
    return out


def examine(text: str, model: PairModel) -> list[tuple[int, int, str | None]]:
    """(start, end, restored or None) of each garbled run of a text."""
    found = []
    for m in NON_ASCII_LINE.finditer(text):
        line, taken = m.group(), []
        spans = model.segments(line)
        lost = [(x.start(), x.end()) for x in LOST.finditer(line)] + [(x.start(), x.end()) for x in CONTROL.finditer(line)]
        for a, b in spans:
            run = line[a:b]
            inner = any(a <= x and y <= b for x, y in lost)
            won = None if "�" in run else inverse(run, model)
            if won or inner:
                found.append((m.start() + a, m.start() + b, won[0] if won else None))
                taken.append((a, b))
                lost = [(x, y) for x, y in lost if not (a <= x and y <= b)]
        sure = certain_runs(line, taken, model, model.kept)
        found += [(m.start() + a, m.start() + b, new) for a, b, new in sure]
        found += [(m.start() + x, m.start() + y, None) for x, y in lost if not any(a <= x and y <= b for a, b, _ in sure)]
    return sorted(found)


def _repair(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairModel(*held.value)
        for batch in batches:
            at, n_runs, whole, restored = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if runs := examine(text, model):
                    out, last = [], 0
                    for a, b, new in runs:
                        if a < last:
                            continue
                        out += [text[last:a], text[a:b] if new is None else new]
                        last = b
                    at.append(i)
                    n_runs.append(len(runs))
                    whole.append(all(new is not None for _, _, new in runs))
                    restored.append("".join([*out, text[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n_runs, pa.int32()), pa.array(whole, pa.bool_()), pa.array(restored, pa.string())], ["id", "n_runs", "whole", "restored"])

    return run


def non_ascii(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text): the rows whose text holds a non-ASCII character."""
    c = F.col(text)
    return spread(texts.select(F.col(key).alias("id"), c.alias("text")).filter(c.isNotNull() & (F.length(c) < F.octet_length(c))))


def pair_table(texts: DataFrame) -> DataFrame:
    """(pair, n): the pairs of all texts, the only column."""
    return texts.mapInArrow(_count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def repaired(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, n_runs, whole, restored): the garbled ones among rows of (id, text), by the stored pair counts. Frequent pairs go to the tasks: at most RARE, since each has at least 1 / RARE of the total."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    usual = {r["pair"]: r["n"] for r in counts.filter(F.col("n") * RARE >= total).toLocalIterator()}
    held = rows.sparkSession.sparkContext.broadcast((usual, max(total, 1)))
    return rows.mapInArrow(_repair(held), f"id {rows.schema['id'].dataType.simpleString()}, n_runs int, whole boolean, restored string")


def garbled(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_runs, whole, restored): each row whose text holds garbled runs; whole if all were restored, restored has them replaced.

    Null and ASCII texts are never garbled (the JVM drops them before any Python runs); a null key is kept, repeated
    rows come repeatedly; other columns are not read. The statistics cover all distinct texts.
    """
    rows = non_ascii(texts, key, text)
    return repaired(rows, written(pair_table(rows.select("text").distinct()), "pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """file_id of files with garbled text."""
    found = garbled(spark.read.parquet(f"{d}/code_files.parquet"), "file_id", "contents")
    return found.filter("id is not null").select(F.col("id").alias("file_id")).distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """file_id, n_runs, whole, contents_hash: the repaired files, whose text is given by its SHA-1."""
    found = garbled(spark.read.parquet(f"{d}/code_files.parquet"), "file_id", "contents")
    return found.select(F.col("id").alias("file_id"), "n_runs", "whole", F.sha1(F.col("restored").cast("binary")).alias("contents_hash")).distinct()


#: Share of planted files that must be found, and restored to the character.
LEAST_FOUND, LEAST_RESTORED = 0.95, 0.85


def planted(spark: SparkSession, d: str) -> DataFrame:
    """(read_as, n, n_found, n_restored): garbled copies of every clean file, each read as three wrong encodings, besides the whole table.

    Copies of all files at once would outnumber the clean text that the statistics are to be learned from. So there is a round for
    each first digit of the files' SHA-1, with the whole table and the copies of the files of that digit; the figures are the sums
    over all rounds. Pair counts add up, so those of the table are taken once, and a round counts and examines its copies only.
    """
    files = spark.read.parquet(f"{d}/code_files.parquet").select("contents").distinct()
    table = written(non_ascii(files.withColumn("id", F.sha1(F.col("contents").cast("binary"))), "id", "contents"), "table")
    own = written(pair_table(spread(table).select("text")), "pairs")
    bad = written(repaired(spread(table), own).select("id"), "bad")
    # sorted, so that a round reads its own part
    clean = written(table.join(bad, "id", "left_anti").sort("id"), "clean")
    figures = []
    for (digit,) in sorted(clean.select(F.substring("id", 1, 1)).distinct().collect()):
        made = written(clean.filter(F.col("id").startswith(digit)).mapInPandas(_misread, "id string, read_as string, meant string, text string"), "planted")
        rows = spread(made.select("id", "text"))
        # a copy may be equal to another one or to a text of the table: equal texts count once
        added = rows.select(F.sha1(F.col("text").cast("binary")).alias("id"), "text").dropDuplicates(["id"]).join(table.select("id"), "id", "left_anti")
        counts = written(own.unionByName(pair_table(added.select("text"))).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
        both = made.join(repaired(rows, counts).select("id", "restored"), "id", "left")
        figures += both.groupBy("read_as").agg(F.count(F.lit(1)).alias("n"), F.count("restored").alias("n_found"), F.count(F.when(F.col("restored") == F.col("meant"), 1)).alias("n_restored")).collect()
        discard(made)
        discard(counts)
    sums = spark.createDataFrame(figures, "read_as string, n bigint, n_found bigint, n_restored bigint").groupBy("read_as")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n", "n_found", "n_restored")])


def _misread(batches):
    for pdf in batches:
        out = []
        for key, meant in zip(pdf["id"], pdf["text"]):
            for read_as in ("windows-1252", "ISO-8859-1", "windows-1251"):
                try:
                    text = meant.encode().decode(read_as)
                except UnicodeDecodeError:
                    continue  # bytes that the encoding has no characters for
                out.append((f"{read_as}-{key}", read_as, meant, text))
        yield pd.DataFrame(out, columns=["id", "read_as", "meant", "text"])


def p6_planted(spark: SparkSession, d: str) -> DataFrame:
    """found, restored: whether LEAST_FOUND of all planted files are found and LEAST_RESTORED restored to the character."""
    n = planted(spark, d).agg(F.sum("n").alias("n"), F.sum("n_found").alias("f"), F.sum("n_restored").alias("r"))
    return n.select((F.col("f") >= LEAST_FOUND * F.col("n")).alias("found"), (F.col("r") >= LEAST_RESTORED * F.col("n")).alias("restored"))


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored, "p6_planted": p6_planted}
SQL = {"p6_planted": "SELECT true AS found, true AS restored"}
