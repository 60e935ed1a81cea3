"""Secret scanning behind a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every match must
hold all trigrams of at least one of its conjunctions. The index maps a trigram that some rule asks for to
the documents holding it; intersecting the postings (a bit per trigram, or-ed by document and
conjunction) gives the rule's candidates, and only those are searched with the expression itself. A
rule whose expression has no mandatory trigram is searched in every document.

Spans are leftmost and non-overlapping per kind, in code points, end exclusive. A span that fails
its rule's length test is dropped, and the search goes on after it.

Edge cases: null text is empty. Rows with equal doc_id share their candidates, and each is searched on
its own; so are rows without a doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.common import Scratch, ids_and_text, ship, text_or_empty

try:
    from re import _constants as _C
    from re import _parser as _P
except ImportError:  # Python before 3.11
    import sre_constants as _C
    import sre_parse as _P

MAX_STRINGS = 64
MAX_CONJUNCTIONS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    base: bool = False


#: A run of `{n,}` characters stands for `+` and a test of the length where both find the same spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _either(queries: list[frozenset | None]) -> frozenset | None:
    """OR; None is a query that everything fits."""
    if any(q is None for q in queries):
        return None
    out = frozenset().union(*queries)
    return out if len(out) <= MAX_CONJUNCTIONS else None


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    if a is None or b is None:
        return a if b is None else b
    out = frozenset(x | y for x, y in product(a, b))
    return out if len(out) <= MAX_CONJUNCTIONS else a


def _of_strings(strings: set[str]) -> frozenset | None:
    return _either([frozenset([t]) if (t := _trigrams(s)) else None for s in strings])


def _walk(items) -> tuple[set[str] | None, frozenset | None]:
    """(all strings that the items match, if few; the query that any match fits)."""
    run: set[str] = {""}
    query: frozenset | None = None
    exact = True

    def flush() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _of_strings(run)), {""}, False

    for op, arg in items:
        strings, inner, open_end = None, None, False
        if op is _C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is _C.IN and all(o is _C.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings = {chr(a).lower() for _, a in arg}
        elif op is _C.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is _C.BRANCH:
            parts = [_walk(b) for b in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            inner = _either([q if s is None else _of_strings(s) for s, q in parts])
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT):
            lo, hi, sub = arg
            some, q = _walk(sub)
            if some is not None and (lo, hi) == (0, 1):
                strings = some | {""}
            elif some is not None and 1 <= lo <= 8 and len(some) ** lo <= MAX_STRINGS:
                strings, open_end = {"".join(x) for x in product(some, repeat=lo)}, hi != lo
            elif lo >= 1:
                inner = q if some is None else _of_strings(some)
        elif op is _C.AT:
            continue
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            if open_end:
                flush()
        else:
            flush()
            query = _both(query, inner if strings is None else _of_strings(strings))
    if exact:
        return run, _of_strings(run)
    flush()
    return None, query


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams, one of which any match holds in full; None if nothing is mandatory."""
    strings, query = _walk(_P.parse(pattern))
    query = _of_strings(strings) if strings is not None else query
    if query is None:
        return None
    return frozenset(q for q in query if not any(o < q for o in query))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the inverted index over the given trigrams."""
    folded = docs.select("doc_id", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*(F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams)))
    return folded.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(__ramify_id, __ramify_rules): for each document the kinds whose trigram query it fits."""
    spark = docs.sparkSession
    wanted = []
    for rule in rules:
        for number, conjunction in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or ()))):
            conjunction = conjunction[:63]  # fewer trigrams, more candidates
            wanted += [(t, rule.kind, number, 1 << bit, (1 << len(conjunction)) - 1) for bit, t in enumerate(conjunction)]
    if not wanted:
        return None
    names = ("trigram", "kind", "part", "bit", "full")
    rows = [F.struct(*(F.lit(v).cast("string" if i < 2 else "int" if i == 2 else "long").alias(n) for i, (n, v) in enumerate(zip(names, w, strict=True)))) for w in wanted]
    plan = spark.range(1).select(F.inline(F.array(*rows)))
    index = postings(docs, sorted({w[0] for w in wanted}))
    met = index.join(F.broadcast(plan), "trigram")  # the plan has one row per trigram of a rule
    met = met.groupBy("doc_id", "kind", "part").agg(F.expr("bit_or(bit)").alias("bits"), F.first("full").alias("full")).where("bits = full")
    return met.groupBy(F.col("doc_id").alias("__ramify_id")).agg(F.collect_set("kind").alias("__ramify_rules"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's spans that pass its test."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("found"), tested.alias("tested"))
    kind = "struct<start:int,rank:int,end:int,kind:string>"
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.struct(start.alias("start"), F.lit(number).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")).cast(kind)
        good = F.length(x["2"]) >= rule.least
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    named = F.transform(rows, lambda x: F.struct(x["gap"].alias("0"), x["found"].alias("1"), x["tested"].alias("2")))
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(named, begin, step, lambda acc: acc["spans"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """docs with __ramify_spans, sorted by start, then by the rules' order. doc_id is a long."""
    ship(docs.sparkSession)
    text = text_or_empty()
    found = candidates(ids_and_text(docs), rules)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    if found is not None:
        found = Scratch(docs.sparkSession).put(found, "candidates")
        docs = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__ramify_id"]), "left")
    parts = []
    for number, rule in enumerate(rules):
        here = text.rlike(rule.pattern)
        if trigram_query(rule.pattern) is not None:
            here = F.array_contains("__ramify_rules", rule.kind) & here
        parts.append(F.when(here, _spans(text, number, rule)).otherwise(none))
    return docs.withColumn("__ramify_spans", F.array_sort(F.concat(*parts))).drop("__ramify_id", "__ramify_rules")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and all spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = _with_spans(docs, rules).select("doc_id", F.col("__ramify_spans").alias("all"))
    ranks = [i for i, r in enumerate(rules) if r.base]

    def of_rank(rank: int) -> Column:
        return F.filter("all", lambda s: s["rank"] == rank)

    counts = [F.size(of_rank(i)).cast("long").alias(f"n_{rules[i].kind}") for i in ranks]
    base = F.filter("all", lambda s: s["rank"].isin(ranks))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by the mark; n_chars follows where it is there."""
    columns = docs.columns
    found = _with_spans(docs, rules)
    text, spans = F.col("text"), F.col("__ramify_spans")

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["done"], gap).alias("done"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("done")), step, finish)
    hit = F.size(spans) > 0
    out = found.withColumn("text", F.when(hit, clean).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)
