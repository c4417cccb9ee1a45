"""Secrets in texts, found through an inverted index of trigrams. Built-in expressions only.

Each rule's pattern yields a Boolean query over trigrams. The index holds postings (trigram, text)
for the trigrams that some query names. A clause's postings are intersected by counting them per
text; texts that hold all trigrams of a clause are candidates of the rule, and the pattern verifies
them. A rule without mandatory trigrams, such as runs of hexadecimal digits, scans every text.

A missing text is empty. Rows that repeat are found alike. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import text_of
from tabeval.llm.secret_rules import BASE_KINDS, RULES, Rule, trigram_query


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """From (key, text) the index (trigram, key) of the wanted trigrams, in lower case."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key, rules): the texts whose postings satisfy a rule's query. The clauses are a few fixed rows."""
    rows = [(rule, i, t, len(c)) for rule, clauses in queries.items() for i, c in enumerate(clauses) for t in c]
    clauses = index.sparkSession.createDataFrame(rows, "rule string, clause int, trigram string, need int")
    met = index.join(F.broadcast(clauses), "trigram").groupBy("key", "rule", "clause").agg(
        F.count("*").alias("n"), F.first("need").alias("need")
    )
    return met.filter("n >= need").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost matches without overlap, as (start, number, end, kind); those too short are dropped.

    The pieces between matches and the matches themselves add up to the positions.
    """
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("counted"),
    )
    kind = "array<struct<start:int,number:int,end:int,kind:string>>"

    def place(p: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(p["between"], i))
            end = start + F.length(F.get(p["found"], i))
            one = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            good = F.length(F.get(p["counted"], i)) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), start, step, lambda s: s["out"])

    return F.when(text.rlike(rule.pattern), F.transform(F.array(parts), place)[0]).otherwise(F.array().cast(kind))


def scan(df: DataFrame, ident: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id and all spans by start, then kind in the order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = sorted({t for clauses in queries.values() for c in clauses for t in c})
    body = text_of(text)
    rows = df.select(F.xxhash64(F.col(ident), body).alias("key"), F.col(ident).alias("doc_id"), body.alias("text"))
    # Rows with one key are equal, or by a rare accident share their candidates; neither loses a match.
    index = postings(rows.select("key", "text"), wanted)
    found = rows.join(candidates(index, queries), "key", "left")
    empty = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    each = [
        F.when(F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), r.kind), spans(F.col("text"), r, i)).otherwise(empty)
        if queries[r.kind] else spans(F.col("text"), r, i)
        for i, r in enumerate(rules)
    ]
    return found.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of their spans, and all spans as text."""

    def told(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
