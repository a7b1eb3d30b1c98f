r"""Secret scans with a trigram inverted index. DataFrame functions only on the main path.

From each rule's regular expression a Boolean query over trigrams is derived: the trigrams of every literal that a match
must hold, OR over the alternatives. The index has a posting list for each trigram that some query names (lower case) and
each segment of documents: one pass of one regular expression finds all of them in a text, and every document that holds one
is posted. A rule's candidates are the intersections (AND) and unions (OR) of its posting lists; only candidates meet the
regular expression. Rules without a mandatory trigram scan every text.

Segments are hash buckets of documents, so that a posting list never holds more than a segment. Spans are in code points,
end exclusive; within a rule matches are leftmost and do not overlap, and a match that fails the rule's length test is
dropped. Null and empty texts have no spans. Equal rows share their postings; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tasks

#: Documents of one segment of the index, on average.
SEGMENT_ROWS = 4_096
#: When a query is derived: characters of a class, and alternatives, that are followed at once.
MOST_CHARS, MOST_STATES = 8, 128


@dataclass(frozen=True)
class Rule:
    """pattern: understood alike by Java and Python. tested: the group whose length counts, 0 the whole match."""

    kind: str
    pattern: str
    tested: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The first three are fixed by the contract of the query; the others are public token formats.
RULES = (
    Rule("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
)
BASE = ("assign", "access", "hex")


def trigram_query(pattern: str) -> list[list[str]]:
    """OR over AND of lower-case trigrams; empty if some alternative has none, which means: scan all."""
    from re import _constants as C
    from re import _parser

    def chars(op, arg) -> set[str] | None:
        out: set[str] = set()
        for op, arg in arg if op is C.IN else [(op, arg)]:
            if op is C.LITERAL:
                out.add(chr(arg).lower())
            elif op is C.RANGE and arg[1] - arg[0] < MOST_CHARS:
                out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if 0 < len(out) <= MOST_CHARS else None

    def close(states) -> set:
        return {(grams, "") for grams, _ in states}

    def fewest(states) -> set:
        """Without the states that another one with the same end implies."""
        return {(g, end) for g, end in states if not any(other < g and e == end for other, e in states)}

    # a state: the trigrams so far, the last two characters
    def walk(tree, states) -> set:
        for op, arg in tree:
            one = chars(op, arg) if op in (C.LITERAL, C.IN) else None
            if one is not None:
                nexts = {(g | {end + c} if len(end) == 2 else g, (end + c)[-2:]) for (g, end), c in product(states, one)}
            elif op is C.SUBPATTERN:
                nexts = walk(arg[3], states)
            elif op is C.BRANCH:
                nexts = set().union(*(walk(way, states) for way in arg[1]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[:2] == (0, 1):
                nexts = states | walk(arg[2], states)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                nexts = close(walk(arg[2], states))
            else:
                nexts = close(states)
            states = fewest(nexts)
            if len(states) > MOST_STATES:
                states = fewest(close(states))
            if len(states) > MOST_STATES:
                states = {(frozenset.intersection(*(g for g, _ in states)), "")}
        return states

    found = {grams for grams, _ in fewest(close(walk(_parser.parse(pattern), {(frozenset(), "")})))}
    return [] if not all(found) else sorted(map(sorted, found))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, matches: Column, rule: Rule, n: int) -> Column:
    """Spans (start, kind number, end) of a rule's matches: one begins where the gaps and matches before it end."""
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.tested)) if rule.tested else matches
    both = F.arrays_zip(matches.alias("w"), tested.alias("t"))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    parts = F.zip_with(gaps, both, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["w"]).alias("size"), (F.length(m["t"]) >= rule.least).alias("ok")))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), F.lit(n).alias("kind"), (start + p["size"]).alias("end"))
        out = F.when(p["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((start + p["size"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(parts, begin, step, lambda acc: acc["out"])


def _cheap(rule: Rule) -> Rule:
    """The same spans with fewer failing matches: for a repeated class the length test can move into the pattern."""
    if rule.tested == 0 and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1:
        fixed = len(rule.pattern[: rule.pattern.index("[")])
        inside = rule.pattern[rule.pattern.index("[") :]
        return Rule(rule.kind, rule.pattern[: rule.pattern.index("[")] + inside[:-1] + f"{{{max(1, rule.least - fixed)},}}", 0, 1)
    return rule


def finder(grams: list[str]) -> str:
    """A regular expression whose group 1 matches, at every place where one of the trigrams begins, that trigram."""

    def escaped(chars) -> str:
        out = "".join(c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}" for c in sorted(chars))
        return out if len(chars) == 1 else f"[{out}]"

    thirds: dict[str, set[str]] = {}
    for g in grams:
        thirds.setdefault(g[:2], set()).add(g[2])
    seconds: dict[str, dict[tuple[str, ...], set[str]]] = {}
    for two, last in thirds.items():
        seconds.setdefault(two[0], {}).setdefault(tuple(sorted(last)), set()).add(two[1])
    firsts: dict[tuple, set[str]] = {}
    for one, ways in seconds.items():
        firsts.setdefault(tuple(sorted((last, tuple(sorted(two))) for last, two in ways.items())), set()).add(one)
    ways = "|".join(escaped(one) + "(?:" + "|".join(escaped(two) + escaped(last) for last, two in rest) + ")" for rest, one in firsts.items())
    return f"(?=({ways}))"


def index(df: DataFrame, queries: list[list[list[str]]], key: str, text: str, segments: int) -> DataFrame:
    """_segment, _gram, _list array<bigint>: the documents (by key) of a segment that hold the trigram, for each trigram of the queries."""
    grams = sorted({g for q in queries for way in q for g in way})
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(finder(grams)), F.lit(1)))
    postings = df.select(F.pmod(F.col(key), F.lit(segments)).alias("_segment"), F.col(key).alias("_key"), F.explode(found).alias("_gram"))
    return postings.groupBy("_segment", "_gram").agg(F.collect_set("_key").alias("_list"))


def candidates(df: DataFrame, rules: tuple[Rule, ...], key: str, text: str, segments: int) -> DataFrame:
    """_key, _rules array<int>: documents that the index leaves for each rule that has a trigram query."""
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    if not queries:
        return df.select(F.col(key).alias("_key"), F.array().cast("array<int>").alias("_rules")).filter(F.lit(False))
    lists = index(df, list(queries.values()), key, text, segments)
    by_segment = lists.groupBy("_segment").agg(F.map_from_entries(F.collect_list(F.struct("_gram", "_list"))).alias("_lists"))
    none = F.array().cast("array<bigint>")

    def posting(g: str) -> Column:
        return F.coalesce(F.element_at("_lists", F.lit(g)), none)

    def hits(query: list[list[str]]) -> Column:
        return reduce(F.array_union, (reduce(F.array_intersect, map(posting, way)) for way in query))

    each = F.array(*(F.struct(F.lit(n).alias("rule"), hits(q).alias("keys")) for n, q in queries.items()))
    found = by_segment.select(F.explode(each).alias("r")).select(F.col("r.rule").alias("_rule"), F.explode("r.keys").alias("_key"))
    return found.groupBy("_key").agg(F.collect_set("_rule").alias("_rules"))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """keep + spans array<struct<start int, kind string, end int>> by start, then rule, for every row of df."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(*(F.col(k).alias(f"_keep{i}") for i, k in enumerate(keep)), text.alias("_text")).withColumn("_key", F.xxhash64("_text"))
    segments = max(tasks(df.sparkSession), -(-df.count() // segment_rows))
    queried = [n for n, r in enumerate(rules) if trigram_query(r.pattern)]
    left = candidates(source.select("_key", "_text"), rules, "_key", "_text", segments)
    # written, so that its size is known: a small one is broadcast by the session's limit, and beside a large one the
    # rows of a frequent text can be split
    left = materialize(df.sparkSession, left.withColumnRenamed("_key", "_of"), "candidates")
    joined = source.join(left, F.col("_key") == F.col("_of"), "left")
    none = F.array().cast("array<string>")
    cheap = [_cheap(r) for r in rules]
    found = [F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(0)) for r in cheap]
    found = [F.when(F.array_contains("_rules", F.lit(n)), m).otherwise(none) if n in queried else m for n, m in enumerate(found)]
    matched = joined.select("_text", *(f"_keep{i}" for i in range(len(keep))), *(m.alias(f"_m{n}") for n, m in enumerate(found)))
    parts = [F.when(F.size(f"_m{n}") > 0, _spans(F.col("_text"), F.col(f"_m{n}"), r, n)).otherwise(F.array().cast(SPANS)) for n, r in enumerate(cheap)]
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["kind"]).alias("kind"), s["end"].alias("end")))
    return matched.select(*(F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)), spans.alias("spans"))


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with every span that scan() finds replaced by the mark (overlapping spans by one); null texts stay null. Where
    length_col is a column of df, it gets the characters of a changed text."""
    names = [f"_f{i}" for i in range(len(df.columns))]
    text = F.col(names[df.columns.index(text_col)])
    found = scan(df.toDF(*names), rules, names[df.columns.index(text_col)], keep=tuple(names))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], before, F.lit(mark)))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = found.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))

    def column(name: str, c: str) -> Column:
        if c == text_col:
            return F.col("clean").alias(c)
        if c == length_col:
            return F.when(F.size("spans") > 0, F.length("clean")).otherwise(F.col(name)).cast(df.schema[c].dataType).alias(c)
        return F.col(name).alias(c)

    return found.select(*map(column, names, df.columns))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda k: k == kind


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of scan()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for digest(scan(documents)): gaps between the matches and the matches give the places."""
    ways = []
    for n, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        ways.append(f"SELECT r, '{r.kind}' AS kind, {n} AS k, {r.least} AS least, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}', 0)) AS w, unnest(regexp_extract_all(text, '{p}', {r.tested})) AS t, generate_subscripts(string_split_regex(text, '{p}'), 1) AS i FROM d WHERE regexp_matches(text, '{p}')")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(ways)}),
placed AS (SELECT *, CAST(sum(length(gap) + coalesce(length(w), 0)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM m),
spans AS (SELECT r, k, kind, e - length(w) AS s, kind || ':' || (e - length(w)) || ':' || e AS said FROM placed WHERE w IS NOT NULL AND length(t) >= least),
told AS (SELECT r, {counts}, coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (WHERE kind IN ({base})), '') AS base, string_agg(said, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
