"""Pieces of SQL (DuckDB) that the catalogue's oracles share."""

from keyloom.functions import text as T

#: RE2 has no `$` before a final newline: the rule for a brace-less if names that newline itself.
_BRACELESS = (r"\sif\s*\((?:.*)\)\s*(\n[^\n\{\}]*)(\n?)$", r" {\\n\1\\n}\\n\2")


def replaced(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        if pattern == T.TYPE1[6][0]:
            pattern, replacement = _BRACELESS
        else:
            replacement = replacement.replace("$", "\\")
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return expr


def type1(expr: str) -> str:
    return replaced(expr, T.TYPE1)


def type2(expr: str) -> str:
    return replaced(expr, T.TYPE2)


def lines(expr: str) -> str:
    return f"(CASE WHEN {expr} LIKE '%' || chr(10) THEN string_split({expr}, chr(10))[:-2] ELSE string_split({expr}, chr(10)) END)"


def lane(expr: str, k: int) -> str:
    return f"('0x' || substr({expr}, {15 * k + 1}, {15 if k < 2 else 10}))::BIGINT"


def joined(lanes: list[str]) -> str:
    return " || ".join(f"lpad(lower(to_hex({x})), {w}, '0')" for x, w in zip(lanes, (15, 15, 10)))


def xor_digest(expr: str) -> str:
    return joined([f"bit_xor({lane(expr, k)})" for k in range(3)])


#: Every function text once: fn (hex), c.
FUNCTIONS = "fns AS (SELECT lower(hex(hash)) AS fn, min(contents) AS c FROM code_functions WHERE hash IS NOT NULL AND contents IS NOT NULL GROUP BY 1)"


def window_rows(normal: str) -> str:
    """fn, position and the window text w of every five lines of the normal form."""
    return f"""normal AS (SELECT fn, {normal} AS t FROM fns),
parts AS (SELECT fn, {lines("t")} AS p FROM normal),
frames AS (SELECT fn, p, unnest(range(0, len(p) - 4)) AS position FROM parts WHERE len(p) >= 5),
windows AS (SELECT fn, position::INTEGER AS position, CASE WHEN position > 0 THEN chr(10) ELSE '' END || array_to_string(p[position + 1 : position + 5], chr(10)) || chr(10) AS w FROM frames)"""


def _sketch() -> str:
    out = []
    for mask in (3, 1, 0):
        picked = f"list_filter(h, lambda x: (('0x' || substr(x, 1, 2))::BIGINT & {mask}) = {mask})"
        lanes = [f"list_reduce(list_prepend(0::BIGINT, list_transform({picked}, lambda x: {lane('x', k)})), lambda a, b: xor(a, b))" for k in range(3)]
        out.append(f"nullif({joined(lanes)}, repeat('0', 40))")
    return f"coalesce({', '.join(out)})"


def gapped() -> str:
    """The sketch s of every window w."""
    starts = ", ".join(f"regexp_extract_all({'w' if k == 0 else f'''array_to_string(b[{k + 1}:], ' ')'''}, '{T.SHINGLE}')" for k in range(4))
    return f"""blanks AS (SELECT fn, position, w, string_split(substr(w, 2), ' ') AS b FROM windows),
shingled AS (SELECT fn, position, list_distinct(list_transform(flatten([{starts}]), lambda x: sha1(x))) AS h FROM blanks WHERE len(b) > 4),
sketched AS (SELECT fn, position, {_sketch()} AS s FROM shingled)"""


#: One snippet for each (hash, function) with n, the functions of its hash.
COLLIDING = """one AS (SELECT hash, function, clone_type, position FROM (SELECT *, row_number() OVER (PARTITION BY hash, function ORDER BY clone_type, position) AS r FROM snippets WHERE hash IS NOT NULL AND function IS NOT NULL) WHERE r = 1),
many AS (SELECT hash, count(*) AS n FROM one GROUP BY hash HAVING count(*) > 1),
colliding AS (SELECT one.*, n FROM one JOIN many USING (hash))"""


def rough(threshold: int = 500) -> str:
    return f"""rough AS (SELECT * FROM (SELECT a.function AS this_function, b.function AS that_function, a.position AS this_position, b.position AS that_position, hash,
  row_number() OVER (PARTITION BY a.function, b.function, a.position ORDER BY hash, b.position) AS r FROM colliding a JOIN colliding b USING (hash) WHERE a.n < {threshold} AND a.function < b.function) WHERE r = 1)"""


def woven(threshold: int = 500) -> str:
    """matches: the rough ones, and those of popular hashes for functions with a rough match."""
    return f"""pop AS (SELECT * FROM colliding WHERE n >= {threshold}),
mine AS (SELECT * FROM pop WHERE function IN (SELECT this_function FROM rough)),
woven AS (SELECT a.function AS this_function, b.function AS that_function, a.position AS this_position, b.position AS that_position, hash FROM mine a JOIN pop b USING (hash) WHERE a.function < b.function),
matches AS (SELECT this_function, that_function, this_position AS p, that_position AS q, hash, 1 AS w FROM rough UNION ALL SELECT this_function, that_function, this_position, that_position, hash, 0 FROM woven)"""


def clones() -> str:
    """The stitching rule, a pass for each step of the recursion: a fold over the matches left of a pair of functions.

    The state of the fold: the clone (p, q, n, k: its first position on this side, the lowest on the other, both extents), the last match looked at
    (lp, lq), whether a gap has ended the pass, and the matches left for later.
    """
    wide = "{'p': x.p, 'q': x.q, 'n': 1, 'k': 1, 'lp': x.p, 'lq': x.q, 'ended': FALSE, 'rest': []::STRUCT(p INTEGER, q INTEGER)[]}"
    left = "list_append(a.rest, {'p': x.p, 'q': x.q})"
    near = "abs(x.q - a.lq) <= 10"
    step = f"""CASE WHEN a.ended OR x.p - a.lp > 10 THEN {{'p': a.p, 'q': a.q, 'n': a.n, 'k': a.k, 'lp': a.lp, 'lq': a.lq, 'ended': TRUE, 'rest': {left}}}
WHEN {near} THEN {{'p': a.p, 'q': least(a.q, x.q), 'n': x.p - a.p + 1, 'k': greatest(a.k, x.q - least(a.q, x.q) + 1), 'lp': x.p, 'lq': x.q, 'ended': FALSE, 'rest': a.rest}}
ELSE {{'p': a.p, 'q': a.q, 'n': a.n, 'k': a.k, 'lp': x.p, 'lq': x.q, 'ended': FALSE, 'rest': {left}}} END"""
    return f"""ordered AS (SELECT this_function, that_function, list({{'p': p, 'q': q}} ORDER BY p, w, hash) AS m FROM matches GROUP BY this_function, that_function),
passes AS (SELECT this_function, that_function, m AS remaining, NULL::INTEGER AS p, NULL::INTEGER AS q, NULL::INTEGER AS n, NULL::INTEGER AS k, FALSE AS ended, 0 AS nth FROM ordered
  UNION ALL SELECT this_function, that_function, c.rest, c.p, c.q, c.n, c.k, c.ended, nth + 1 FROM (
    SELECT this_function, that_function, nth, list_reduce(list_transform(remaining, lambda x: {wide}), lambda a, x: {step}) AS c FROM passes WHERE len(remaining) > 0)),
clones AS (SELECT this_function, p AS this_position, n + 4 AS this_length, that_function, q AS that_position, k + 4 AS that_length, ended, nth FROM passes WHERE p IS NOT NULL)"""


def fine() -> str:
    """The clones whose windows of the raw text share enough of their vocabulary."""
    return f"""texts AS (SELECT fn, {lines("c")} AS l FROM fns),
cut AS (SELECT DISTINCT lower(hex(f)) AS fn, p, n FROM (SELECT this_function AS f, this_position AS p, this_length AS n FROM clones UNION ALL SELECT that_function, that_position, that_length FROM clones)),
vocabularies AS (SELECT fn, p, n, list_distinct(regexp_extract_all(array_to_string(l[p + 1 : p + n], chr(10)), '[a-zA-Z][a-zA-Z0-9]*')) AS v FROM cut JOIN texts USING (fn)),
judged AS (SELECT this_function AS f, that_function AS g, a.fn AS this_function, this_position, this_length, b.fn AS that_function, that_position, that_length, ended, nth, coalesce(len(list_intersect(a.v, b.v)) < 0.8 * len(list_distinct(list_concat(a.v, b.v))), FALSE) AS spam
  FROM clones c JOIN vocabularies a ON a.fn = lower(hex(this_function)) AND a.p = this_position AND a.n = this_length JOIN vocabularies b ON b.fn = lower(hex(that_function)) AND b.p = that_position AND b.n = that_length),
fine AS (SELECT this_function, this_position, this_length, that_function, that_position, that_length FROM judged WHERE NOT spam)"""


def strict() -> str:
    """The clones before a function's first failure, in the order of its passes.

    A pass goes through a function's partners in order, takes the next clone of each, and stops at one that a gap ended. So partner after partner
    takes the first passes that no earlier partner has stopped.
    """
    return """partners AS (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY g) AS j, count(*) AS n, list(ended ORDER BY nth) AS e FROM judged GROUP BY f, g),
walk AS (SELECT f, g, j, range(0, n) AS taken, list_filter(range(0, n), lambda x: e[x + 1]) AS stopped FROM partners WHERE j = 1
  UNION ALL SELECT f, g, j, taken, list_concat(stopped, list_filter(taken, lambda x, k: e[k])) FROM (
    SELECT t.f, t.g, t.j, t.e, w.stopped, list_filter(range(0, t.n + len(w.stopped)), lambda x: NOT list_contains(w.stopped, x))[1 : t.n] AS taken FROM walk w JOIN partners t ON t.f = w.f AND t.j = w.j + 1)),
strict AS (SELECT this_function, this_position, this_length, that_function, that_position, that_length FROM (
  SELECT c.*, bool_or(spam) OVER (PARTITION BY c.f ORDER BY taken[nth], j ROWS UNBOUNDED PRECEDING) AS failed FROM judged c JOIN walk w ON w.f = c.f AND w.g = c.g) WHERE NOT failed)"""


SPAM = "len(list_intersect(va, vb)) < 0.8 * len(list_distinct(list_concat(va, vb)))"
