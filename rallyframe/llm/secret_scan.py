"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: every clause must hold, a clause holds if all
trigrams of one of its strings occur. The index holds the postings (trigram, text fingerprint) of the needed
trigrams. A query picks its trigrams' postings, intersects them for each string, unites the strings of a clause and
intersects the clauses; only texts in a rule's candidates are verified with its regex. A rule without mandatory
trigrams scans all texts. Everything is a built-in function; the text itself is shuffled only if the candidates
are too many to broadcast. Arrays are summed up in blocks, so the work is linear in a text's matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_in, stored, text_of


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches whose `group` has `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds. The greedy runs of `access` and `hex` carry their least length in the pattern.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
# A key's body: header lines, then base64 to the end line; without an end line, the base64 lines that follow and a
# padded last one. Neither is counted: possessive loops take the Java matcher no stack, however many lines there are.
_HEADERS = r"(?:\s*[A-Za-z-]+:[^\r\n]*[\r\n]+)*+"
_ENDED = _HEADERS + r"[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]*PRIVATE KEY-----"
_OPEN = _HEADERS + r"(?:\s*[A-Za-z0-9+/]{40,}={0,2})++(?:[\r\n]+[A-Za-z0-9+/]*={1,2})?"
# Published token formats.
MORE_RULES = (
    SecretRule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_ENDED}|{_OPEN})?"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = tuple[tuple[tuple[str, ...], ...], ...]


def trigram_query(pattern: str, most: int = 64) -> Query:
    """Clauses of alternatives of trigrams that any match contains, lower-cased; () if there are none."""
    clauses: list[tuple[tuple[str, ...], ...]] = []

    def close(strings: set[str]) -> None:
        if min(map(len, strings)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            least = [s for s in sets if not any(t < s for t in sets)]
            clauses.append(tuple(sorted(tuple(sorted(s)) for s in least)))

    def exact(node) -> set[str] | None:
        """All strings of a node, if they are few."""
        strings = {""}
        for kind, value in node:
            more = None
            if kind is op.LITERAL:
                more = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                more = {chr(v).lower() for _, v in value}
            elif kind is op.SUBPATTERN:
                more = exact(value[3])
            elif kind is op.BRANCH:
                branches = [exact(b) for b in value[1]]
                more = None if None in branches else set().union(*branches)
            elif kind is op.MAX_REPEAT and value[1] == 1:
                inner = exact(value[2])
                more = inner and (inner if value[0] else inner | {""})
            if not more or len(strings) * len(more) > most:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    def walk(node, strings: set[str]) -> set[str]:
        for item in node:
            more = exact([item])
            if more and len(strings) * len(more) <= most:
                strings = {a + b for a in strings for b in more}
                continue
            close(strings)
            strings = {""}
            if item[0] is op.SUBPATTERN:
                strings = walk(item[1][3], strings)
            elif more:
                strings = more
        return strings

    close(walk(parser.parse(pattern), {""}))
    return tuple(clauses)


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(trigram, fingerprint), each once: in which texts a trigram of the list occurs, in any letter case."""
    low = docs.select(F.xxhash64(text_of(text)).alias("fingerprint"), F.lower(text_of(text)).alias("__low"))
    found = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(found).alias("trigram"), "fingerprint").distinct()


def candidates(docs: DataFrame, rules: tuple[SecretRule, ...], text: str = "text") -> tuple[DataFrame | None, list[int]]:
    """(fingerprint, rules): the texts that satisfy the query of any rule; and which rules must scan fully.

    A posting list may hold nearly all texts, so lists are intersected by counting (string, fingerprint) pairs:
    no group holds a list.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    full = [i for i in range(len(rules)) if i not in queries]
    if not queries:
        return None, full
    terms = [(t, i, c, s, len(strings)) for i, q in queries.items() for c, clause in enumerate(q) for s, strings in enumerate(clause) for t in strings]
    query = docs.sparkSession.createDataFrame(terms, "trigram string, rule int, clause int, string int, needed int")
    clauses = docs.sparkSession.createDataFrame([(i, len(q)) for i, q in queries.items()], "rule int, clauses int")
    index = stored(postings(docs, sorted({t[0] for t in terms}), text), "postings")
    # Both tables of the rules are as long as the rules' texts.
    picked = index.join(F.broadcast(query), "trigram").groupBy("rule", "clause", "string", "needed", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    united = picked.filter("n = needed").select("rule", "clause", "fingerprint").distinct()
    met = united.groupBy("rule", "fingerprint").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(clauses), "rule").filter("n = clauses")
    return met.groupBy("fingerprint").agg(F.collect_set("rule").alias("rules")), full


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, plus, block: int = 256) -> Column:
    """Inclusive running sums of an int array under `plus`, which takes 0 as its neutral value.

    Appending to an array copies it, so sums run inside blocks, then over the blocks' last values.
    """
    none = F.expr("cast(array() as array<int>)")
    last = lambda sums: F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0))
    along = lambda part: F.aggregate(part, none, lambda sums, x: F.array_append(sums, plus(last(sums), x)))
    before = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda sums, p: F.array_append(sums, plus(last(sums), last(p))))
    whole = lambda parts: _let(before(parts), lambda s: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda x: plus(F.get(s, b), x)))))
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
    return F.when(F.size(values) > 0, _let(F.transform(starts, lambda b: along(F.slice(values, b * block + 1, F.lit(block)))), whole)).otherwise(none)


def matches(rule: SecretRule, order: int, text: Column) -> Column:
    """Spans of a rule as array<struct<start, order, end, kind>>, in code points, end exclusive.

    The text between matches and the matches themselves alternate, so lengths give the places.
    """
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.filter(F.arrays_zip(between.alias("gap"), found.alias("hit"), value.alias("value")), lambda x: x["hit"].isNotNull())
    sizes = F.transform(parts, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["value"]) >= rule.least).alias("ok")))

    def spans(items: Column) -> Column:
        ends = running(F.transform(items, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        good = F.filter(F.arrays_zip(items.alias("x"), ends.alias("end")), lambda z: z["x"]["ok"])
        return F.transform(good, lambda z: F.struct((z["end"] - z["x"]["hit"]).alias("start"), F.lit(order).alias("order"), z["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return _let(sizes, spans)


SPANS = "array<struct<start int, order int, end int, kind string>>"


def scanned(docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, broadcast_rows: int = 400_000) -> DataFrame:
    """Add `spans`, sorted by start and then by the rules' order, to every row.

    Null text counts as empty and has none. Equal texts share their postings; repeated rows are found
    alike. A column named `spans` is replaced. Up to `broadcast_rows` candidates (some 30 bytes each)
    are broadcast; beyond, the join shuffles and adaptive execution splits hot fingerprints.
    """
    own = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    body = text_of(text)
    index, full = candidates(docs, rules, text)
    rows = docs.select(*own, body.alias("__text"), F.xxhash64(body).alias("__fingerprint"))
    if index is None:
        rows = rows.withColumn("__rules", F.expr("cast(array() as array<int>)"))
    else:
        index = stored(index, "candidates").select(F.col("fingerprint").alias("__fingerprint"), F.col("rules").alias("__rules"))
        rows = rows.join(F.broadcast(index) if rows_in(index) <= broadcast_rows else index, "__fingerprint", "left")
    none = F.lit(None).cast(SPANS)
    found = []
    for i, rule in enumerate(rules):
        seen = F.col("__text").rlike(rule.pattern) if i in full else F.array_contains("__rules", i)
        found.append(F.coalesce(F.when(seen, matches(rule, i, F.col("__text"))).otherwise(none), F.expr(f"cast(array() as {SPANS})")))
    return rows.select(*own, F.sort_array(F.concat(*found)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the base kinds, and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(key, *[count(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", block: int = 4096) -> DataFrame:
    """The columns of `docs`, with every span in the text replaced by its kind in brackets.

    A span that begins inside an earlier one adds nothing to it but its end. Cutting counts code points from a
    text's start, so the text is first cut into blocks, and each part between spans is cut from its blocks.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__body"))
    found = scanned(boxed, "__body")
    until = F.transform("spans", lambda s: s["end"])
    found = found.select("__row", "__body", "spans", F.when(F.size("spans") > 0, running(until, lambda a, b: F.greatest(a, b))).alias("__reach"))
    found = found.withColumn("__blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("__body", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))))

    def between(low: Column, high: Column) -> Column:
        at = F.floor(low / block).cast("int")
        some = F.array_join(F.slice("__blocks", at + 1, F.floor(F.greatest(high - 1, low) / block).cast("int") - at + 1), "")
        return F.when(high > low, F.substring(some, low - at * block + 1, high - low)).otherwise("")

    def part(s: Column, i: Column) -> Column:
        done = F.coalesce(F.get("__reach", i - 1), F.lit(0))
        return F.when(s["start"] >= done, F.concat(between(done, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

    rest = between(F.get("__reach", F.size("__reach") - 1), F.length("__body"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", part), ""), rest)).otherwise(F.col("__body"))
    found = found.select("__row", clean.alias("__clean"))
    return found.select(*[F.col("__clean").alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in docs.columns])
