"""Text functions as column expressions: normalisation, line windows, shingle sketches, vocabularies.

All stay inside the JVM. Null in, null out, unless a docstring says otherwise.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MINIMUM_LINES = 5

#: The normalisation rules, (pattern, replacement) in the order they apply. A backslash in a replacement is literal.
TYPE1 = [
    (r"\s*\n\s*", "\n"),
    (r"[ \f\r\t]+", " "),
    (r"\b[a-z]+[a-z.]*\.([A-Z])", "$1"),
    (r"=\s?\{.*?\}", "= { }"),
    (r"\]\s?\{.*?\}", "] { }"),
    (r"(\s)(?:private\s|public\s|protected\s)", "$1"),
    (r"\sif\s*\((?:.*)\)\s*(\n[^\n\{\}]*)$", r" {\n$1\n}\n"),
    ("while", ";while"),
    (r"^[ \f\r\t]*", ""),
]
TYPE2 = [(r"[a-zA-Z]+", "t"), (r"\d+", "1"), (r"(\w)\.(\w)", "$1. $2"), (r"(\w)\.(\w)", "$1. $2")]
SHINGLE = r"[^ ]+ [^ ]+ [^ ]+ [^ ]+"
WORD = r"\p{Alpha}\p{Alnum}*"
SPAM_BELOW = 0.8


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """Every match replaced; $n names a group (of one or more digits), a backslash stands for itself."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement.replace("\\", "\\\\")))


def apply_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules one after the other."""
    return reduce(lambda c, rule: replace_all(c, *rule), rules, text)


def normalize_type1(text: Column) -> Column:
    return apply_rules(text, TYPE1)


def normalize_type2(text: Column) -> Column:
    """On top of the type-1 normal form."""
    return apply_rules(text, TYPE2)


def lines(text: Column) -> Column:
    """Lines of a text; a newline at the end begins no line, the empty text has one line."""
    pieces = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")), F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def get_lines(parts: Column, start: Column, n: Column | int, strict: bool = False) -> Column:
    """n lines from `start` (from 0) as one text. It ends in a newline and, but for start 0, begins with the newline before it.

    Null if the range goes beyond the lines; strict raises an error then.
    """
    n = F.lit(n) if isinstance(n, int) else n
    body = F.concat(F.when(start > 0, F.lit("\n")).otherwise(F.lit("")), F.array_join(F.slice(parts, start + 1, n), "\n"), F.lit("\n"))
    inside = F.when((start >= 0) & (n >= 0) & (start + n <= F.size(parts)), body)
    return inside.otherwise(F.when(parts.isNotNull(), F.raise_error(F.lit("lines out of range")).cast("string"))) if strict else inside


def count_lines(text: Column) -> Column:
    """Line ends (LF, CR or CRLF) plus one."""
    return F.size(F.split(text, r"\r\n|\r|\n", -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where lambdas keep the compiler from sharing it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(doc: Column) -> Column:
    """Runs of four blank-separated tokens, without overlap, counted from each of the first four tokens; null with fewer than four blanks after the first character."""

    def runs(d: Column, pieces: Column) -> Column:
        starts = F.array(d, *[F.array_join(F.slice(pieces, F.lit(k + 1), F.greatest(F.size(pieces) - k, F.lit(0))), " ") for k in (1, 2, 3)])
        found = F.flatten(F.transform(starts, lambda s: F.regexp_extract_all(s, F.lit(SHINGLE), F.lit(0))))
        return F.when(F.size(pieces) > 4, found)

    return let(doc, lambda d: let(F.split(F.substring(d, 2, 1 << 30), " ", -1), lambda pieces: runs(d, pieces)))


def _lane(sha1_hex: Column, k: int) -> Column:
    """15 of the 40 hex digits as a number, so that three lanes hold a digest."""
    return F.conv(F.substring(sha1_hex, 15 * k + 1, 15), 16, 10).cast("bigint")


def _joined(lanes: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(lane)), width, "0") for lane, width in zip(lanes, (15, 15, 10))])


def xor_of(hashes: Column) -> Column:
    """Exclusive or of an array of SHA-1 hex strings, as hex; zeros for an empty array."""

    def lane(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(_lane(h, k)))

    return _joined([lane(k) for k in range(3)])


def xor_digest(sha1_hex: Column) -> Column:
    """Aggregate: exclusive or of the SHA-1 hex strings of a group, which must be distinct; combined on the map side."""
    return _joined([F.bit_xor(_lane(sha1_hex, k)) for k in range(3)])


def sketch(doc: Column) -> Column:
    """Exclusive or of the hashes of the distinct shingles whose lowest bits of the first byte are set: two bits, else one, else all; the first that is not zero.

    One pass: nine lanes, three for each mask, are folded together.
    """
    masks = (3, 1, 0)
    hashed = F.array_distinct(F.transform(shingles(doc), lambda s: F.sha1(s.cast("binary"))))
    parts = F.transform(hashed, lambda h: F.struct(F.conv(F.substring(h, 1, 2), 16, 10).cast("int").alias("b"), *[_lane(h, k).alias(f"l{k}") for k in range(3)]))
    start = F.struct(*[F.lit(0).cast("bigint").alias(f"m{m}_{k}") for m in masks for k in range(3)])

    def fold(acc: Column, x: Column) -> Column:
        def lane(m: int, k: int) -> Column:
            old = acc[f"m{m}_{k}"]
            return F.when(x["b"].bitwiseAND(F.lit(m)) == m, old.bitwiseXOR(x[f"l{k}"])).otherwise(old).alias(f"m{m}_{k}")

        return F.struct(*[lane(m, k) for m in masks for k in range(3)])

    def first(acc: Column) -> Column:
        tries = [[acc[f"m{m}_{k}"] for k in range(3)] for m in masks]
        return F.coalesce(*[F.when((a != 0) | (b != 0) | (c != 0), _joined([a, b, c])) for a, b, c in tries])

    return F.aggregate(parts, start, fold, first)


def vocabulary(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def vocabulary_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of two vocabularies; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def is_spam(a: Column, b: Column) -> Column:
    """Whether the vocabularies of two texts differ too much; two texts without words do not."""
    return F.coalesce(vocabulary_similarity(vocabulary(a), vocabulary(b)) < SPAM_BELOW, F.lit(False))


def signed_order(binary: Column) -> Column:
    """A text whose order is that of the binaries by signed bytes: hex with each byte's top bit flipped."""
    h = F.hex(binary)
    high = F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1)), F.lit(2)), lambda i: F.concat(F.translate(F.substr(h, i, F.lit(1)), "0123456789ABCDEF", "89ABCDEF01234567"), F.substr(h, i + 1, F.lit(1))))
    return F.array_join(high, "")
