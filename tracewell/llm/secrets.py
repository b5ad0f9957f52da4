"""Secrets in texts, found through an inverted index of trigrams; DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams (`trigrams.query`). The index lists, for every
trigram that some rule's query names, the texts that hold it (small letters; written once, sorted by trigram within files). Postings of a
text are intersected by its key, which tells the rules it is a candidate for; the expression itself then verifies
candidates. Rules without mandatory trigrams (long hex runs) scan every text.

Positions come without a loop over characters: the pieces between matches (`split`) and the matches (`regexp_extract_all`)
have lengths, whose running sums, in chunks of `CHUNK`, are starts and ends in code points.

Postings are a row per (text, trigram of the rules), at most some dozens; texts move once, and not at all where candidates are few enough
to be broadcast. Keys are 96 bits of id and text; what two texts of one key have is joined, so a clash could only add a verification.

Nulls: a null or empty text has no spans; null or repeated ids are rows of their own. Empty tables give no rows. Further columns are kept
out of the result. Matches are leftmost and don't overlap within a kind; kinds may overlap. Those shorter than a rule asks are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import trigrams


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The base kinds, in their order.
BASE = (
    Rule("assign", rf"""({_either('password|passwd|secret|token|api_?key')})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the method adds: public formats of keys and credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("address", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
CHUNK = 512
KEY = ["k1", "k2"]
SPAN = "struct<start: int, kind: int, end: int>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end) of a rule's matches, in order."""
    matches, groups = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    sizes = F.zip_with(matches, groups, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
    none = F.array().cast(f"array<{SPAN}>")

    def walk(chunk: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at, end = acc["at"] + x["p"], acc["at"] + x["p"] + x["m"]
            span = F.array(F.struct(at.alias("start"), F.lit(number).alias("kind"), end.alias("end")).cast(SPAN))
            return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, start, step)["out"]

    def placed(lengths: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK)), lambda i: F.slice(lengths, i, CHUNK))

        def whole(chunks: Column) -> Column:
            totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["p"] + x["m"]))
            begins = F.aggregate(totals, F.array(F.lit(0)), lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)))
            return F.flatten(F.zip_with(chunks, F.slice(begins, 1, F.size(chunks)), walk))

        return _let(chunks, whole)

    def found(sizes: Column) -> Column:
        pieces = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(sizes))
        lengths = F.zip_with(pieces, sizes, lambda p, s: F.struct(F.length(p).alias("p"), s["m"].alias("m"), s["g"].alias("g")))
        return F.when(F.size(sizes) > 0, _let(lengths, placed)).otherwise(none)

    return _let(sizes, found)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (never null) and the key of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.hash("text", "id").alias("k2"))


def _any_gram(names: list[str]) -> str:
    """A pattern that finds, at every position, the trigram that begins there if it is one of `names`; shared beginnings once."""
    def escaped(c: str) -> str:
        return c if c.isalnum() else f"\\x{{{ord(c):x}}}"

    firsts: dict[str, dict[str, list[str]]] = {}
    for g in sorted(names):
        firsts.setdefault(g[0], {}).setdefault(g[1], []).append(escaped(g[2]))
    parts = [escaped(a) + "(?:" + "|".join(escaped(b) + f"[{''.join(c)}]" for b, c in rest.items()) + ")" for a, rest in firsts.items()]
    return f"(?=({'|'.join(parts)}))"


def index(rows: DataFrame, names: list[str]) -> DataFrame:
    """gram and key of the texts that hold it, for the trigrams `names`; rows are those of `keyed`."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_gram(names)), F.lit(1)))
    return rows.select(F.explode(held).alias("gram"), *KEY).sortWithinPartitions("gram")


def holds(grams: Column, query: object) -> Column:
    """Whether a text with these trigrams may match."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(grams, query)
    kind, parts = query
    return reduce(lambda a, b: a & b if kind == "and" else a | b, (holds(grams, p) for p in parts))


def candidates(postings: DataFrame, queries: dict[int, object]) -> DataFrame:
    """Key and rules (numbers) of the texts whose postings fulfil a rule's query."""
    names = sorted(set().union(*map(trigrams.grams, queries.values())))
    lists = postings.where(F.col("gram").isin(names)).groupBy(*KEY).agg(F.collect_set("gram").alias("grams"))
    rules = F.filter(F.array(*[F.when(holds(F.col("grams"), q), n) for n, q in queries.items()]), lambda n: n.isNotNull())
    return lists.select(*KEY, rules.alias("rules")).where(F.size("rules") > 0)


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of start, kind, end; kind is the rule's number) of every row."""
    queries = {n: trigrams.query(r.pattern) for n, r in enumerate(rules)}
    queries = {n: q for n, q in queries.items() if q is not True}
    rows = keyed(docs, id_col, text_col)
    if queries:
        names = sorted(set().union(*map(trigrams.grams, queries.values())))
        postings = staged(index(rows, names), "secret-postings")
        rows = rows.join(candidates(postings, queries), KEY, "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast(f"array<{SPAN}>")
    text = F.col("text")
    each = [F.when(F.array_contains("rules", n), spans(text, r, n)).otherwise(none) if n in queries else spans(text, r, n) for n, r in enumerate(rules)]
    return rows.select("id", F.sort_array(F.concat(*each)).alias("spans"))


def written(spans_: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
