"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
(any of its required strings, all trigrams of one).  The index holds postings
for the trigrams that some rule requires, over lower-cased text; intersecting
them gives the documents in which a rule can match, and only there the rule
runs.  Rules without a mandatory trigram (``hex``) scan every text in full.

Base rules drop matches that are too short; the other rules add spans.  Spans
are code points, end exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows give
the same result; null ids are matched as equal to each other; extra columns
pass through ``scan`` unless they are named like its results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import free


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    base: bool = False
    fast: str = ""  # a pattern that finds the same long matches sooner


#: Fixed values, in the order that breaks ties; the first three are the base rules.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True, fast=r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
_MOST_STRINGS = 32


def required(pattern: str) -> list[set[str]]:
    """Strings of which a match must hold one, for each part of the pattern that has such; lower case, three characters at least."""
    found: list[set[str]] = []

    def strings(part) -> set[str] | None:
        """All texts that a part matches, if they are few."""
        now = {""}
        for op, arg in part:
            if op is C.LITERAL:
                more = {chr(arg).lower()}
            elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is C.SUBPATTERN:
                more = strings(arg[-1])
            elif op is C.BRANCH:
                some = [strings(p) for p in arg[1]]
                more = None if None in some else set().union(*some)
            elif op is C.MAX_REPEAT and arg[1] <= 1:
                inner = strings(arg[2])
                more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            else:
                more = None
            if more is None or len(now) * len(more) > _MOST_STRINGS:
                return None
            now = {a + b for a in now for b in more}
        return now

    def walk(part) -> None:
        run = {""}

        def close() -> None:
            nonlocal run
            if all(len(s) >= 3 for s in run):
                found.append(run)
            run = {""}

        for op, arg in part:
            alone = strings([(op, arg)])
            if alone is not None and len(run) * len(alone) <= _MOST_STRINGS and alone != {""} and "" not in alone:
                run = {a + b for a in run for b in alone}
                continue
            close()
            if op is C.SUBPATTERN:
                walk(arg[-1])
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close()

    walk(parser.parse(pattern))
    return found


def trigram_query(rule: Rule) -> list[set[str]]:
    """An OR of ANDs of trigrams; empty if the rule has no mandatory one.  Of several required parts the most selective is taken."""
    parts = required(rule.pattern)
    if not parts:
        return []
    best = max(parts, key=lambda p: min(map(len, p)))
    return [{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(best)]


_compiled: dict[str, re.Pattern] = {}


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    r = _compiled.get(rule.pattern)
    if r is None:
        r = _compiled[rule.pattern] = re.compile(rule.fast or rule.pattern, re.ASCII)
    return [m.span() for m in r.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def candidates(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, t, kinds): the rules that can match in a document, from intersected postings; input: doc_id, t, text."""
    spark = keyed.sparkSession
    clauses = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(trigram_query(r)) for t in sorted(c)]
    if not clauses:
        return keyed.select("doc_id", "t", F.array().cast("array<string>").alias("kinds")).limit(0)
    grams = sorted({c[2] for c in clauses})
    low = keyed.select("doc_id", "t", F.lower("text").alias("low"))
    postings = low.select("doc_id", "t", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    # broadcast: the rules' own trigrams
    asked = F.broadcast(spark.createDataFrame(clauses, "kind string, clause int, gram string, need int"))
    hits = postings.distinct().join(asked, "gram").groupBy("doc_id", "t", "kind", "clause", "need").agg(F.count(F.lit(1)).alias("n"))
    return hits.where("n = need").groupBy("doc_id", "t").agg(F.collect_set("kind").alias("kinds"))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds found: array of (kind, start, end), by start, then kind as listed."""
    k, t, of, mark, found = (free(documents, f"__{n}") for n in ("kinds", "t", "id", "k", "found"))
    docs = documents.withColumn(t, F.xxhash64("text"))
    keyed = documents.select("doc_id", F.xxhash64("text").alias("t"), "text").where(F.col("text").isNotNull())
    may = candidates(keyed, rules).select(F.col("doc_id").alias(of), F.col("t").alias(mark), F.col("kinds").alias(k))
    joined = docs.join(may, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(t) == F.col(mark)), "left")
    full = tuple(r.kind for r in rules if not trigram_query(r))

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def verify(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, kinds in parts:
            out = []
            for t, own in zip(text, kinds):
                own = {*full, *(own if own is not None else ())}
                got = [(s, k, e) for k, r in enumerate(rules) if t and r.kind in own for s, e in find(r, t)]
                out.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(got)])
            yield pd.Series(out, dtype=object)

    rest = [F.col(f"`{c}`") for c in documents.columns if c != "found"]
    return joined.withColumn(found, verify.asNondeterministic()("text", k)).select(*rest, F.col(found).alias("found"))
