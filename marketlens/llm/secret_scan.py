"""Secret scans over a trigram inverted index (DataFrame functions only).

Each rule's regular expression gives a Boolean query over trigrams that every match must meet
(``trigrams.trigram_query``). One pass over the texts makes the postings (trigram, row) of the
trigrams that the queries name; postings are intersected per row as bit sets, and the rows that
meet a rule's query are its candidates. Only candidates are searched with the rule's expression;
rules without a mandatory trigram search every whole text. Spans are in code points, end exclusive.

Matches of a rule are leftmost and non-overlapping; one whose value group is shorter than the rule
asks is dropped after it was matched. Positions are running sums of the lengths of the pieces
between matches, one row a match, so a text with very many matches makes no large row.

Defined cases: a null text is empty and has no span; rows that repeat id and text are searched once
and all get the spans; a null id is an id; an empty table gives an empty result; only the id and the
text column are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.store import written
from marketlens.llm.trigrams import trigram_query, trigrams_in


@dataclass(frozen=True)
class Rule:
    """``kind``: name in the spans; ``value_group`` must have ``least`` characters at least."""

    kind: str
    pattern: str
    value_group: int = 0
    least: int = 1


#: The three base rules, in the order of their kinds. A run of hex digits is matched whole, so
#: asking for 24 of them in the expression drops the same matches as a check afterwards; likewise for AKIA.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further token formats that their issuers publish.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

_WORD = 62  # postings of so many trigrams fit one long


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): 128 bits of id and text, the same on every recomputation."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64(F.lit(13), "text", "id")})


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(k1, k2, gram): which of ``grams`` each row's text holds, upper and lower case alike. A look-ahead
    that captures the trigram at every position reads a text once, however many trigrams are asked for."""
    ahead = "(?=(" + "|".join(r"\Q" + g + r"\E" for g in grams) + "))"
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(ahead), F.lit(1)))
    return rows.select("k1", "k2", F.explode(found).alias("gram"))


def _meets(query, grams: list[str]) -> Column:
    """The query over the bit sets ``w0``, ``w1``, ..."""
    if isinstance(query, str):
        word, bit = divmod(grams.index(query), _WORD)
        return F.col(f"w{word}").bitwiseAND(F.lit(1 << bit)) != 0
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_meets(q, grams) for q in query[1:]])


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, one boolean a rule with mandatory trigrams) of the rows that meet a rule's query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    grams = sorted(set().union(*(trigrams_in(q) for q in queries.values())))
    place = F.array_position(F.array(*[F.lit(g) for g in grams]), F.col("gram")) - 1
    index = written(postings(rows, grams), "postings").withColumn("at", place.cast("int"))
    words = [F.bit_or(F.when(F.floor(F.col("at") / _WORD) == w, F.expr(f"shiftleft(1L, at % {_WORD})")).otherwise(F.lit(0))).alias(f"w{w}")
             for w in range((len(grams) + _WORD - 1) // _WORD)]
    per_row = index.groupBy("k1", "k2").agg(*words)
    flags = {kind: _meets(q, grams) for kind, q in queries.items()}
    return per_row.select("k1", "k2", *[c.alias(kind) for kind, c in flags.items()]).filter(
        reduce(lambda a, b: a | b, [F.col(kind) for kind in flags]))


def _matches(rule: Rule) -> Column:
    """One entry a match: characters before it (since the match before), its length, whether it stays."""
    pattern = F.lit(rule.pattern)
    before = F.transform(F.split("text", rule.pattern, -1), F.length)
    whole = F.regexp_extract_all("text", pattern, F.lit(0))
    value = whole if rule.value_group == 0 else F.regexp_extract_all("text", pattern, F.lit(rule.value_group))
    return F.arrays_zip(F.slice(before, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("long"),
                        F.transform(value, lambda v: F.length(v) >= rule.least).alias("stays"))


def find_spans(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k1, k2, kind int, start, end) of every secret in ``rows`` (from ``keyed``); kind counts the rules from 0."""
    indexed = [r.kind for r in rules if trigram_query(r.pattern) is not None]
    scanned = [r for r in rules if r.kind not in indexed]
    joined = rows.join(candidates(rows, rules), ["k1", "k2"], "left") if indexed else rows
    looked = joined.select(
        "k1", "k2", "text", *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in indexed],
        *[F.col("text").rlike(r.pattern).alias(r.kind) for r in scanned])
    likely = looked.filter(reduce(lambda a, b: a | b, [F.col(r.kind) for r in rules])).dropDuplicates(["k1", "k2"])
    per_rule = F.array(*[F.struct(F.lit(i).alias("kind"), F.when(F.col(r.kind), _matches(r)).alias("found")) for i, r in enumerate(rules)])
    each = (likely.select("k1", "k2", F.explode(per_rule).alias("r")).select("k1", "k2", "r.kind", F.posexplode("r.found").alias("n", "m"))
            .select("k1", "k2", "kind", "n", "m.*"))
    so_far = Window.partitionBy("k1", "k2", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("long")).over(so_far)
    return (each.withColumn("end", end).withColumn("start", F.col("end") - F.col("long")).filter("stays")
            .select("k1", "k2", "kind", "start", "end"))


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and spans, an array of (start, kind, end) in that order, kind
    being the rule's place in ``rules``; empty where there is none."""
    rows = keyed(docs, id_col, text_col)
    found = written(find_spans(rows, rules), "spans")
    lists = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.drop("text").join(lists, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
