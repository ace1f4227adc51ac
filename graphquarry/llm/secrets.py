"""Secret scans through a trigram inverted index.

Each rule's regex is parsed into a Boolean query over trigrams that any match must contain: literal
runs give conjunctions, alternatives give disjunctions. The index holds, for each block of
documents, the posting list of every trigram that some query names. A query intersects and unites
the lists of a block, and only the documents that come out are searched with the regex itself.
Rules without a mandatory trigram scan all texts.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as C
from re import _parser as P

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, spread, stash, whole_row

# Kind, regex (group 2, if there, is the secret itself), fewest characters of group 2 or of the match.
RULES = [
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]{24,}", 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    ("google", "AIza[A-Za-z0-9_-]{35}", 39),
    ("stripe", "[rs]k_live_[A-Za-z0-9]{16,}", 24),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 30),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 27),
    ("login_url", "[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!$&*+=-]{3,64}@", 11),
]
BASE = ("assign", "access", "hex")
MARK = "[SECRET]"
_MOST = 32


# -- trigram queries: True, a trigram, ("and", ...) or ("or", ...) -------------------------------
def _join(op: str, parts) -> object:
    flat: list = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        for q in p[1:] if isinstance(p, tuple) and p[0] == op else (p,):
            if q not in flat:
                flat.append(q)
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (op, *flat)


def _of_strings(strings: set[str]) -> object:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _sequence(tree) -> tuple[set[str] | None, object]:
    """(all strings it can match, lower-cased, if few; else None), (the query that any match satisfies)."""
    run: set[str] = {""}  # what the literal run before this point can be
    exact, query = True, True

    def flush():
        nonlocal run, exact, query
        query, run, exact = _join("and", [query, _of_strings(run)]), {""}, False

    for op, arg in tree:
        own: set[str] | None = None
        more: object = True
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN:
            own = _class(arg)
        elif op is C.SUBPATTERN:
            own, more = _sequence(arg[3])
        elif op is C.BRANCH:
            sides = [_sequence(x) for x in arg[1]]
            if all(s is not None for s, _ in sides):
                own = set().union(*(s for s, _ in sides))
            else:
                more = _join("or", [q if s is None else _of_strings(s) for s, q in sides])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            strings, inner = _sequence(sub)
            if (low, high) == (0, 1) and strings is not None and all(s.isalnum() or s == "_" for s in strings):
                own = strings | {""}
            elif low:
                if strings is not None and len(run) * len(strings) <= _MOST:
                    run = {a + b for a in run for b in strings}
                flush()
                more = inner if strings is None else _of_strings(strings)
        if own is not None and len(run) * len(own) <= _MOST:
            run = {a + b for a in run for b in own}
            continue
        if own is not None:
            more = _of_strings(own)
        flush()
        query = _join("and", [query, more])
    if exact:
        return run, _of_strings(run)
    return None, _join("and", [query, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-cased trigrams; True: no trigram is mandatory."""
    return _sequence(P.parse(pattern))[1]


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


# -- index and search -----------------------------------------------------------------------------
def _escape(s: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{ord(c):02x}" for c in s)


def _lookahead(vocabulary: set[str]) -> str:
    """Matches, without width, wherever one of the trigrams begins; grouped by first character."""
    by: dict[str, list[str]] = {}
    for t in sorted(vocabulary):
        by.setdefault(t[0], []).append(t[1:])
    parts = [f"{_escape(c)}(?:{'|'.join(map(_escape, rest))})" for c, rest in by.items()]
    return f"(?=({'|'.join(parts)}))"


def build_index(docs: DataFrame, vocabulary: set[str], block_rows: int = 4096) -> DataFrame:
    """(block, trigram, rows array<bigint>): docs(row, text); a block holds about ``block_rows`` distinct rows."""
    blocks = max(1, -(-docs.count() // block_rows))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_lookahead(vocabulary)), F.lit(1)))
    posts = docs.select("row", F.explode(found).alias("trigram"))
    return posts.groupBy(F.pmod("row", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("row").alias("rows"))


def search_index(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(row, kinds array<string>): the rows that satisfy some query, with the kinds of those."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))

    def column(q):
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("lists", F.lit(q)), F.array().cast("array<bigint>"))
        return reduce(F.array_intersect if q[0] == "and" else F.array_union, map(column, q[1:]))

    names = list(queries)
    hits = lists.select(*[column(queries[k]).alias(f"k{i}") for i, k in enumerate(names)])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{i}").alias("rows")) for i, k in enumerate(names)])
    flat = hits.select(F.explode(each).alias("e")).select("e.kind", F.explode("e.rows").alias("row"))
    return flat.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def _bind(value, body):
    """body(value), with the value worked out once and not wherever the body's lambdas name it."""
    return F.transform(F.array(value), body)[0]


def _chunks(values, block: int):
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda c: F.slice(values, c * block + 1, block))


def _running_in(values, before, join):
    """The running values of a short array after ``before``."""
    zero = F.struct(before.alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        now = join(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def running(values, join, block: int = 64):
    """The running values of array<int> under ``join``, which is associative and has 0 as its zero.

    An array can't grow in place, so appending to one is quadratic: the values are taken in blocks, and
    the blocks' totals in blocks again.
    """

    def levels(first, second):
        def down(chunks, above):
            return F.flatten(F.transform(chunks, lambda c, i: _running_in(c, F.when(i > 0, F.get(above, i - 1)).otherwise(F.lit(0)), join)))

        top = _running_in(_totals(second, join), F.lit(0), join)
        return _bind(top, lambda t: _bind(down(second, t), lambda u: down(first, u)))

    def whole(v):
        first = _chunks(v, block)
        return _bind(first, lambda f: _bind(_totals(f, join), lambda t: _bind(_chunks(t, block), lambda s: levels(f, s))))

    return _bind(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))


def _totals(chunks, join):
    return F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, b: join(a, b)))


def _spans(text, kind: str, pattern: str, least: int):
    """array<struct<start,number,end,kind>> of one rule: positions from what lies between the matches, in linear time."""
    number = [k for k, _, _ in RULES].index(kind)
    group = 2 if kind == "assign" else 0
    lengths = lambda x: F.transform(x, lambda y: F.length(y))
    found = F.struct(
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("whole"), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("part"),
        lengths(F.split(text, pattern, -1)).alias("gap"),
    )

    def placed(m):
        moves = F.zip_with(F.slice(m["gap"], 1, F.size(m["whole"])), m["whole"], lambda g, w: g + w)
        ends = F.zip_with(running(moves, lambda x, y: x + y), m["whole"], lambda e, w: F.struct((e - w).alias("start"), e.alias("end")))
        spans = F.zip_with(ends, m["part"], lambda s, n: F.when(n >= least, F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(kind).alias("kind"))))
        return F.filter(spans, lambda s: s.isNotNull())

    return _bind(found, placed)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, max_broadcast: int = 200_000, carry: bool = False) -> DataFrame:
    """``docs``' id and text with spans array<struct<start,number,end,kind>> by start and rule.

    start and end count code points, end exclusive; matches of one rule are leftmost and don't
    overlap, and those below the rule's length are dropped. Null text: empty. One row for each row
    of ``docs``; repeated rows return each, null doc_ids too; extra columns are ignored.
    ``max_broadcast``: up to so many candidate documents are sent to every task, beyond it the
    candidates join by shuffle; the result is the same. carry: adds a struct of all other columns.
    """
    queries = {k: trigram_query(p) for k, p, _ in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [whole_row(docs, text_col).alias("carried")] if carry else []
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *rest), "doc_id").withColumn("row", F.xxhash64("doc_id", "text"))
    index = stash(build_index(rows, set().union(*map(trigrams, indexed.values()))), "trigrams")
    found = small(stash(search_index(index, indexed), "candidates"), max_broadcast)
    both = rows.join(found, "row", "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    spans = []
    for k, pattern, least in rules:
        own = _spans(F.col("text"), k, pattern, least)
        wanted = F.array_contains("kinds", k) if k in indexed else F.col("text").rlike(pattern)
        spans.append(F.when(wanted, own).otherwise(none))
    return both.select("doc_id", "text", *(["carried"] if carry else []), F.array_sort(F.concat(*spans)).alias("spans"))


def redacted(text, spans, block: int = 256):
    """The text with every span, joined where they overlap, replaced by MARK.

    The text is cut into blocks first, as finding a place in a text means walking to it.
    """
    parts = F.struct(
        F.transform(spans, lambda s: s["start"]).alias("start"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("end"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("size"),
    )

    def build(p):
        # a span that begins before all those so far have ended belongs to the one before
        begins = F.transform(p["start"], lambda s, i: F.when((i == 0) | (s >= F.get(p["end"], i - 1)), s))
        ends = F.transform(p["end"], lambda e, i: F.when((i == F.size(p["start"]) - 1) | (F.get(p["start"], i + 1) >= e), e))
        present = lambda x: F.filter(x, lambda y: y.isNotNull())

        def piece(a, z):
            one = F.floor(a / block).cast("int")
            held = F.array_join(F.slice(p["blocks"], one + 1, F.floor((z - 1) / block).cast("int") - one + 1), "")
            return F.when(z > a, F.substring(held, a - one * block + 1, z - a)).otherwise(F.lit(""))

        return F.array_join(F.zip_with(F.concat(F.array(F.lit(0)), present(ends)), F.concat(present(begins), F.array(p["size"])), piece), MARK)

    return F.when(F.size(spans) > 0, _bind(parts, build)).otherwise(text)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in its text replaced by MARK, and n_chars, if there, counted anew.

    The other columns stay as they are, whatever their names. Null text: empty.
    """
    found = find_secrets(docs, text_col=text_col, carry=True)
    found = found.select("carried", redacted(F.col("text"), F.col("spans")).alias("_text"))
    new = {text_col: F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return found.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("carried").getField(c).alias(c) for c in docs.columns])


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    def re2(p: str) -> str:
        body = p.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(
            "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
        return body.replace("'", "''")

    parts = []
    for i, (k, p, least) in enumerate(RULES):
        g = 2 if k == "assign" else 0
        parts.append(f"""
  SELECT doc_id, {i} AS number, '{k}' AS kind, {least} AS least,
         regexp_extract_all(t, '{re2(p)}', 0) AS whole, regexp_extract_all(t, '{re2(p)}', {g}) AS part,
         list_transform(string_split_regex(t, '{re2(p)}'), lambda x: length(x)) AS gap
  FROM d WHERE regexp_matches(t, '{re2(p)}')""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (
  SELECT doc_id, number, kind, least, unnest(part) AS part,
         unnest(list_transform(generate_series(1, len(whole)),
           lambda i: list_sum(gap[1:i]) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s,
         unnest(list_transform(whole, lambda x: length(x)))::BIGINT AS n
  FROM m),
k AS (SELECT doc_id, number, kind, s, s + n AS e FROM e WHERE length(part) >= least),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) FILTER (WHERE number < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) AS spans
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


OP3_SQL = _sql()
