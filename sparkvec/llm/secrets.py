"""Secret scans over a trigram inverted index.

:func:`trigram_query` derives from a rule's regular expression a Boolean query over lower-cased trigrams, an OR of ANDs
that every match must satisfy; a rule without mandatory trigrams has none and scans every text. The index holds postings (trigram,
doc_id) for the trigrams that the queries name; intersecting them gives each rule's candidate documents, and only those are
verified by the expression itself. Index, intersection and verification are built-in expressions; texts stay where they are,
and a text costs time in proportion to its length however many matches it has.

Rules that begin with the three base kinds, then those the method adds: private key headers, personal access tokens
and signed web tokens. Spans are code points, end exclusive, leftmost and not overlapping within a kind.

Defined results: null text is empty and has no spans; repeated rows are scanned each for itself, and rows that share a
doc_id share candidates but are verified by their own texts, as are rows without a doc_id; ties at one start are ordered by kind; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvec.llm.common import cut, let, table

#: Strings that the analysis of one expression follows at once, at most; beyond that it gives up exactness, not soundness.
LIMIT = 64
#: Elements that a running sum appends to one array.
BLOCK = 512
#: Candidate documents that are broadcast to the texts, at most: an id and a few numbers each.
MAX_BROADCAST = 1_000_000
SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least code points, of the whole match or of ``group``.
    least: int
    group: int = 0


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("pat", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28),
)
BASE = ("assign", "access", "hex")

Query = frozenset[frozenset[str]]


def _trigrams(text: str) -> frozenset[str]:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _either(queries: list[Query | None]) -> Query | None:
    return None if any(q is None for q in queries) else frozenset().union(*queries)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a if b is None else b
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= LIMIT else min(a, b, key=len)


def _need(strings: list[str]) -> Query | None:
    """What a text holds that holds one of ``strings``; None: nothing is sure."""
    sets = [_trigrams(s) for s in strings]
    return None if not all(sets) else frozenset(sets)


_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d+)(,?)(\d*)\})[?+]?")
_SPECIAL = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\x0b", "0": "\0"}
#: Most members of a character class that are followed one by one.
SET_MEMBERS = 8


class _Reader:
    """Reads a regular expression and returns, for each part of it, (all strings that it matches or None, its query)."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def either(self) -> tuple[list[str] | None, Query | None]:
        """Alternatives up to a closing bracket or the end."""
        parts = [self.sequence()]
        while self.peek("|"):
            self.at += 1
            parts.append(self.sequence())
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= LIMIT:
            return [s for p in parts for s in p[0]], None
        return None, _either([_both(_need(p[0]) if p[0] is not None else None, p[1]) for p in parts])

    def sequence(self) -> tuple[list[str] | None, Query | None]:
        run, query, whole = [""], None, True
        while self.at < len(self.pattern) and not self.peek("|") and not self.peek(")"):
            exact, inner = self.repeated()
            if exact is not None and len(exact) * len(run) <= LIMIT:
                run = list(dict.fromkeys(a + b for a in run for b in exact))
                continue
            query = _both(_both(query, _need(run)), inner)
            run, whole = exact if exact is not None else [""], False
        return (run, query) if whole else (None, _both(query, _need(run)))

    def repeated(self) -> tuple[list[str] | None, Query | None]:
        exact, query = self.single()
        while m := _QUANTIFIER.match(self.pattern, self.at):
            self.at = m.end()
            low = {"*": 0, "+": 1, "?": 0}[m[1]] if m[1] else int(m[2])
            if m[1] == "?" or (m[2] == "0" and m[4] == "1"):
                exact, query = ["", *exact] if exact is not None else None, None
            elif low != 1 or m[1] or m[3]:  # {1} changes nothing
                exact, query = None, _both(_need(exact) if exact is not None else None, query) if low else None
        return exact, query

    def single(self) -> tuple[list[str] | None, Query | None]:
        c = self.pattern[self.at]
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.members(), None
        if c == "\\":
            return self.escape(), None
        return None if c == "." else [""] if c in "^$" else [c], None

    def group(self) -> tuple[list[str] | None, Query | None]:
        around = False
        if self.peek("?"):
            m = re.compile(r"\?(?:(<?[=!])|P?<\w+>|>|[a-zA-Z-]*(?::|(?=\))))").match(self.pattern, self.at)
            if m is None:
                raise ValueError(f"cannot read {self.pattern!r} at {self.at}")
            self.at, around = m.end(), bool(m[1])
        inside = self.either()
        if not self.peek(")"):
            raise ValueError(f"{self.pattern!r} lacks a closing bracket")
        self.at += 1
        return ([""], None) if around else inside

    def escape(self) -> list[str] | None:
        c = self.pattern[self.at]
        self.at += 1
        if c in "xu":
            n = 2 if c == "x" else 4
            self.at += n
            return [chr(int(self.pattern[self.at - n : self.at], 16))]
        if c in "bBAZzG":
            return [""]
        if c in _SPECIAL:
            return [_SPECIAL[c]]
        return None if c.isalnum() else [c]

    def members(self) -> list[str] | None:
        """The characters of a class, None if it is negated, wide or nested."""
        known, first = not self.peek("^"), True
        out: list[str] = []
        self.at += not known
        while first or not self.peek("]"):
            first = False
            if self.peek("[") or self.peek("&&"):
                raise ValueError(f"nested class in {self.pattern!r}")
            c = self.pattern[self.at]
            self.at += 1
            found = self.escape() if c == "\\" else [c]
            if self.peek("-") and not self.peek("-]") and found:
                self.at += 1
                last = self.pattern[self.at]
                self.at += 1
                last = self.escape() if last == "\\" else [last]
                found = [chr(x) for x in range(ord(found[0]), ord(last[0]) + 1)] if last and ord(last[0]) - ord(found[0]) < SET_MEMBERS else None
            known = known and found is not None
            out += found or []
        self.at += 1
        return list(dict.fromkeys(out)) if known and len(out) <= SET_MEMBERS else None


def trigram_query(pattern: str) -> Query | None:
    """OR of ANDs of trigrams, in lower case, that each match's text satisfies; None: no trigram is mandatory."""
    reader = _Reader(pattern)
    strings, query = reader.either()
    if reader.at < len(pattern):
        raise ValueError(f"{pattern!r} has a stray bracket")
    query = _both(query, _need(strings) if strings is not None else None)
    return None if query is None else frozenset(a for a in query if not any(b < a for b in query))


def _fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(tri, doc_id) for the trigrams given, those that rules name."""
    found = let(
        _fold(F.coalesce("text", F.lit(""))),
        lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(x)), F.lit(i)) for i, x in enumerate(trigrams)])),
    )
    return docs.select("doc_id", F.explode(found).alias("tri"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): indices of the rules whose trigram query a document satisfies, where any does."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    if not trigrams:
        return docs.select("doc_id", F.array().cast("array<int>").alias("rules")).where("false")
    number = {t: i for i, t in enumerate(trigrams)}
    held = postings(docs, trigrams).groupBy("doc_id").agg(F.collect_set("tri").alias("tris"))
    each = []
    for k, q in queries.items():
        met = F.lit(False)
        for conj in sorted(sorted(c) for c in q):
            ids = F.array(*[F.lit(number[t]) for t in conj])
            met = met | (F.size(F.array_intersect("tris", ids)) == len(conj))
        each.append(F.when(met, F.lit(k)))
    return held.select("doc_id", F.array_compact(F.array(*each)).alias("rules")).where(F.size("rules") > 0)


def running_sums(values: Column, block: int = BLOCK) -> Column:
    """The sum of all elements before each one, linear in the array: sums grow in blocks, so no accumulator holds more than
    ``block`` or one element a block."""

    def append(base: Column) -> tuple:
        none = F.array().cast("array<int>")
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.struct(base.alias("at"), none.alias("out")), step, lambda a: a["out"]

    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    placed = let(parts, lambda p: F.flatten(F.zip_with(p, F.aggregate(F.transform(p, total), *append(F.lit(0))), lambda own, base: F.aggregate(own, *append(base)))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(placed)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, kind, end) of one rule: the pieces between matches and the matches themselves give the positions."""
    pattern = F.lit(rule.pattern)

    def placed(whole: Column, pieces: Column, checked: Column) -> Column:
        own = F.transform(whole, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("n"), F.length(F.get(checked, i)).alias("own")))

        def spans(steps: Column) -> Column:
            def made(before: Column) -> Column:
                each = F.transform(steps, lambda s, i: F.struct((F.get(before, i) + s["gap"]).alias("start"), F.lit(order).alias("kind"), (F.get(before, i) + s["gap"] + s["n"]).alias("end"), s["own"].alias("own")))
                return F.transform(F.filter(each, lambda x: x["own"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

            return let(running_sums(F.transform(steps, lambda s: s["gap"] + s["n"])), made)

        return let(own, spans)

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast(SPANS)

    def found(w: Column) -> Column:
        pieces, checked = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(rule.group))
        return F.when(F.size(w) == 0, none).otherwise(let(pieces, lambda p: let(checked, lambda c: placed(w, p, c))))

    return let(whole, found)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, found): spans (start, kind, end) of each row, sorted; kind is the index of the rule.

    Rows meet their candidate rules where they lie: up to ``max_broadcast`` candidate documents are sent to them, which is
    checked; beyond that rows and candidates are joined by doc_id, with the same result."""
    known = cut(candidates(docs, rules)).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
    if known.limit(max_broadcast + 1).count() <= max_broadcast:
        known = F.broadcast(known)

    def scanned(text: Column) -> Column:
        parts = []
        for k, rule in enumerate(rules):
            spans = _spans(text, rule, k)
            if trigram_query(rule.pattern) is not None:
                spans = F.when(F.array_contains(F.coalesce("_rules", F.array().cast("array<int>")), k), spans).otherwise(F.array().cast(SPANS))
            parts.append(spans)
        return F.array_sort(F.concat(*parts))

    joined = docs.select("doc_id", "text").join(known, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", let(F.coalesce("text", F.lit("")), scanned).alias("found"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    found = find_secrets(docs, rules)
    at = {r.kind: k for k, r in enumerate(rules)}

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == at[kind])).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("found"), rules).alias("spans"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS kind, '{r.kind}' AS name, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g, "
            f"string_split_regex(text, '{pattern}') AS p, {r.least} AS least FROM documents WHERE text IS NOT NULL"
        )
    return f"""
WITH scans AS ({" UNION ALL ".join(parts)}),
each AS (
  SELECT doc_id, kind, name, least, m[i] AS m, g[i] AS g, i, length(m[i]) AS n,
         CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM scans WHERE len(m) > 0)),
spans AS (SELECT doc_id, kind, name, s, s + n AS e FROM each WHERE length(g) >= least),
docs AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < {len(BASE)}) AS base,
         string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN docs USING (doc_id)
"""


OP1_SQL = _sql()
