"""Secret scan by a trigram inverted index (DataFrame functions only).

From the parse tree of each rule's regular expression a Boolean query over
trigrams is derived: the literal stretches that every match must contain,
as a conjunction of clauses, each a choice of spellings, each spelling the set
of its trigrams.  The index holds the postings (trigram -> text) of all
trigrams that the rules' queries name; the queries are answered by
intersecting postings (an aggregate that collects, per text, which trigrams
of a spelling it has).  The texts found are then verified with the regular
expression itself.  A rule without mandatory trigrams scans every text.

A text is known in the index by its 64-bit hash: copies share postings, and a
hash collision can only add a text to verify.  Trigrams are of the lower-cased
text, so the index never misses a spelling in other case.

Scale.  Postings are distinct per (trigram, text) and aggregated map-side by
text; no list of a trigram is gathered in one place.  The rule table is a
literal relation of a few dozen rows.  Candidates are joined back on the text hash.

Spans are code points, end exclusive, of leftmost non-overlapping matches; they
come from the lengths of the pieces between matches.

Defined cases: null text is empty; a null doc_id is kept and repeated rows are
reported once each; where two rules match, both spans are reported (by start,
then rule order).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as K
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_text, stash


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, kept where group ``group`` has at least ``least`` characters.

    ``scan`` is a pattern of the same matches that Spark runs instead: a look behind leaves out places where a match
    cannot begin because an earlier place of the same run would have matched, so that a
    long run is not scanned again from each of its characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    scan: str = ""

    def searched(self) -> str:
        return self.scan or self.pattern


# The three base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Publicly documented credential formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
         scan=r"eyJ(?<!eyJ[A-Za-z0-9_-]{0,2000}?eyJ)[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]+://[^\s:/@]+:[^\s:/@]+@", scan=r"(?<![a-z])[a-z]+://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE + MORE
MOST_SPELLINGS = 64
MOST_GRAMS = 6


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of spellings (one must) of trigrams (all must), for lower-cased text.

    No clauses: the expression has no mandatory trigrams.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(spellings: set[str]) -> None:
        grams = {frozenset(_spread([s[i:i + 3] for i in range(len(s) - 2)])) for s in spellings}
        if all(grams):
            # A spelling that asks for more than another one adds nothing to the choice.
            clauses.append(sorted((g for g in grams if not any(h < g for h in grams)), key=sorted))

    def spellings_of(node: tuple) -> set[str] | None:
        """All strings the node matches, if they are few."""
        op, arg = node
        if op is K.LITERAL:
            return {chr(arg).lower()}
        if op is K.IN:
            if any(o not in (K.LITERAL, K.RANGE) for o, _ in arg):
                return None
            chars = {chr(c).lower() for o, a in arg for c in ([a] if o is K.LITERAL else range(a[0], a[1] + 1))}
            return chars if len(chars) <= 8 else None
        if op is K.SUBPATTERN:
            return sequence(arg[3])
        if op is K.BRANCH:
            parts = [sequence(p) for p in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is K.MAX_REPEAT and arg[1] == 1:
            inner = sequence(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def sequence(nodes) -> set[str] | None:
        held = {""}
        for node in nodes:
            more = spellings_of(node)
            if more is None or len(held) * len(more) > MOST_SPELLINGS:
                return None
            held = {a + b for a in held for b in more}
        return held

    def walk(nodes) -> None:
        held = {""}
        for node in nodes:
            more = spellings_of(node)
            if more is not None and len(held) * len(more) <= MOST_SPELLINGS:
                held = {a + b for a in held for b in more}
                continue
            close(held)
            held = more or {""}
            if more is None and node[0] is K.SUBPATTERN:
                walk(node[1][3])
            elif more is None and node[0] is K.MAX_REPEAT and node[1][0] > 0:
                walk(node[1][2])
        close(held)

    walk(parser.parse(pattern))
    return clauses


def _spread(grams: list[str]) -> list[str]:
    """At most MOST_GRAMS of a spelling's trigrams, evenly spaced (fewer conditions lose no match)."""
    n = len(grams)
    return [grams[i * n // MOST_GRAMS] for i in range(MOST_GRAMS)] if n > MOST_GRAMS else grams


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (gram, text_hash) of the given trigrams over all texts of ``docs`` (doc_id, text)."""
    low = docs.select(F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams])
    return (low.select("text_hash", F.explode(F.array_compact(held)).alias("gram"))
            .groupBy("text_hash", "gram").agg(F.count(F.lit(1)).alias("rows")).select("gram", "text_hash"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(text_hash, rules long): a bit for each rule whose trigram query the text satisfies."""
    rows, clause_no = [], {}
    for r, rule in enumerate(rules):
        for c, clause in enumerate(trigram_query(rule.pattern)):
            for s, spelling in enumerate(clause):
                for t, gram in enumerate(sorted(spelling)):
                    rows.append((gram, r, c, s, 1 << t, (1 << len(spelling)) - 1))
            clause_no[r] = c + 1
    terms = _relation(index, rows, "gram string, rule int, clause int, spelling int, bit long, want long")
    whole = _relation(index, [(r, (1 << n) - 1) for r, n in clause_no.items()], "rule int, clauses long")
    spelled = (index.join(F.broadcast(terms), "gram").groupBy("text_hash", "rule", "clause", "spelling", "want")
               .agg(F.bit_or("bit").alias("bits")).where("bits = want"))
    met = (spelled.groupBy("text_hash", "rule").agg(F.bit_or(F.expr("shiftleft(1L, clause)")).alias("met"))
           .join(F.broadcast(whole), "rule").where("met = clauses"))
    return met.groupBy("text_hash").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _literal(text: str) -> str:
    """A SQL string literal of any text."""
    return "'" + "".join(c if c.isalnum() else f"\\u{ord(c):04x}" if ord(c) < 1 << 16 else f"\\U{ord(c):08x}" for c in text) + "'"


def _relation(near: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A literal relation of the given rows (its size is that of the rule table)."""
    names = [f.split() for f in schema.split(", ")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    lines = ", ".join(f"({', '.join(_literal(v) if isinstance(v, str) else str(v) for v in r)})" for r in rows)
    return near.sparkSession.sql(f"SELECT {cast} FROM VALUES {lines} AS t({', '.join(n for n, _ in names)})")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<start, rule, end>>) for every row of ``docs``."""
    d = key_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [k for k, q in enumerate(queries) if q]
    grams = sorted({g for q in queries for clause in q for spelling in clause for g in spelling})
    if grams:
        found = candidates(stash(build_index(d, grams)), rules)
        d = (d.withColumn("h", F.xxhash64("text"))
             .join(found.withColumnRenamed("text_hash", "h"), "h", "left").drop("h"))
    else:
        d = d.withColumn("rules", F.lit(0).cast("long"))
    spans = []
    for k, rule in enumerate(rules):
        test = f"coalesce(rules, 0) & {1 << k}L != 0" if queries[k] else f"regexp_like(text, {_literal(rule.searched())})"
        spans.append(f"IF({test}, {_spans(rule, k)}, CAST(array() AS {SPANS}))")
    return d.select("doc_id", F.expr(f"array_sort(concat({', '.join(spans)}))").alias("spans"))


PART = 256
SPANS = "array<struct<start:int,rule:int,end:int>>"


def _spans(rule: Rule, number: int) -> str:
    """Spans of the rule's matches: each match starts where the pieces and matches before it end."""
    p = _literal(rule.searched())
    piece = f"""(a, x) -> struct(
            a.at + length(x.`0`) + coalesce(length(x.`1`), 0) AS at,
            IF(length(x.`2`) >= {max(1, rule.least)},
               concat(a.found, array(struct(a.at + length(x.`0`) AS start, {number} AS rule,
                                            a.at + length(x.`0`) + length(x.`1`) AS end))),
               a.found) AS found)"""
    # The spans of PART pieces at a time are gathered, so that a text of many matches is not copied with each of them.
    return f"""flatten(aggregate(
        transform(array(arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0),
                                   regexp_extract_all(text, {p}, {rule.group}))),
                  z -> transform(sequence(1, size(z), {PART}), i -> slice(z, i, {PART})))[0],
        struct(0 AS at, CAST(array() AS array<{SPANS}>) AS found),
        (t, part) -> transform(array(aggregate(part, struct(t.at AS at, CAST(array() AS {SPANS}) AS found), {piece})),
                               u -> struct(u.at AS at, concat(t.found, array(u.found)) AS found))[0],
        t -> t.found))"""


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns of ``scan``."""
    kinds = ", ".join(f"'{r.kind}'" for r in rules)

    def line(spans: str) -> str:
        return (f"concat_ws(',', transform({spans}, s -> concat_ws(':', "
                f"element_at(array({kinds}), s.rule + 1), string(s.start), string(s.end))))")

    return found.selectExpr(
        "doc_id", *[f"CAST(size(filter(spans, s -> s.rule = {k})) AS long) AS n_{r.kind}" for k, r in enumerate(BASE)],
        f"sha2({line(f'filter(spans, s -> s.rule < {len(BASE)})')}, 256) AS base_sha256",
        f"{line('spans')} AS spans")


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) with the regular expressions alone (for tests)."""
    out = []
    for k, rule in enumerate(rules):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        for m in re.finditer(pattern, text or ""):
            if len(m.group(rule.group)) >= max(1, rule.least):
                out.append((m.start(), k, m.end()))
    return sorted(out)
