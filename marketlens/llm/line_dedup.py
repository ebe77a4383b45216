"""Removal of repeated and almost repeated lines, the earliest kept (deletion-neighbourhood join).

A line goes if an earlier line of the corpus, by (document id, line number), is equal to it or one
edit away (a character inserted, deleted or replaced). Two lines are one edit apart exactly if

- deleting the same place of both leaves the same text (a replacement), or
- one is what deleting some place of the other leaves (an insertion or deletion).

So every line sends its deletion variants, as 64-bit hashes with the place, and itself; equal hashes
meet. Within a group no pairs are formed: each replacement group is compared with its earliest line,
each insertion group with the one line that the variant is. Matches are verified by edit distance.

Two lines one edit apart also share their first or their second half, so a line whose halves are
unique cannot match and sends no variants; one that shares a half sends those of the other half.
That costs four hashes a line instead of one a character.

All of it is DataFrame functions. Lines travel as hashes; a common line meets as one count per task.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; lines with
no character but white space stay and match nothing; lines shorter than MIN_CHARS match only their
equals; documents with a null id come last; rows that repeat both id and text are one document and
get the same result; an empty table gives an empty result; columns named like a result are replaced,
others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import row_key, written

#: One edit in fewer characters than this is a different line.
MIN_CHARS = 20


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, n, line, lh) of every line that is not blank."""
    return (docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"),
                        F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
            .filter(F.col("line").rlike(r"\S")).withColumn("lh", F.xxhash64("line")))


def _place(*names: str) -> Column:
    """Order of a line: by document id, nulls last, then by place."""
    return F.struct(F.isnull("id").alias("no_id"), *names)


def _halves(side: str) -> Column:
    """Hashes of the prefixes (head) or suffixes (tail) of half the length, rounded either way."""
    n = F.length("line")
    line = F.col("line")
    sizes = [F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")]
    parts = [line.substr(F.lit(1), s) if side == "head" else line.substr(n - s + 1, s) for s in sizes]
    return F.array_distinct(F.array(*[F.xxhash64(F.lit(side), p, s) for p, s in zip(parts, sizes, strict=True)]))


def _variants(lines: DataFrame) -> DataFrame:
    """(vh, place, ord): the line itself at place 0, and its deletion variants at the places that the
    shared halves leave for an edit: behind a shared head, before a shared tail."""
    n = F.length("line")
    behind = F.when(F.col("head"), F.sequence(F.floor(n / 2).cast("int") + 1, n)).otherwise(F.array().cast("array<int>"))
    ahead = F.when(F.col("tail"), F.sequence(F.lit(1), F.floor(n / 2).cast("int") + 1)).otherwise(F.array().cast("array<int>"))
    shape = F.transform(F.array_union(behind, ahead), lambda i: F.struct(
        F.xxhash64(F.concat(F.expr("line").substr(F.lit(1), i - 1), F.expr("line").substr(i + 1, n))).alias("vh"), i.alias("place")))
    itself = F.array(F.struct(F.xxhash64("line").alias("vh"), F.lit(0).alias("place")))
    return lines.select("ord", F.explode(F.concat(itself, shape)).alias("v")).select("v.vh", "v.place", "ord")


def _near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """lh of the distinct lines that an earlier line is one edit away from."""
    halves = distinct.filter(F.col("chars") >= MIN_CHARS).select("lh", "first", F.explode(F.concat(
        F.transform("head", lambda x: F.struct(x.alias("half"), F.lit(True).alias("head"))),
        F.transform("tail", lambda x: F.struct(x.alias("half"), F.lit(False).alias("head"))))).alias("h"))
    halves = halves.select("lh", "first", "h.half", "h.head")
    shared = halves.groupBy("half").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).filter("a < b").select("half")
    able = (halves.join(written(shared, "halves").hint("shuffle_hash"), "half", "left_semi")
            .groupBy("lh").agg(F.first("first").alias("first"), F.max("head").alias("head"), F.max(~F.col("head")).alias("tail")))
    same = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.k") == F.col("k")) & (F.col("first.n") == F.col("n"))
    texts = _lines(docs, id_col, text_col).join(able.hint("shuffle_hash"), "lh").filter(same).dropDuplicates(["lh"])
    # ordered once by place: the id that Spark numbers the ordered rows with is then their order
    ordered = texts.select("lh", "first", "line", "head", "tail").repartitionByRange("first").sortWithinPartitions("first")
    lines = written(ordered.select("lh", "line", "head", "tail", F.monotonically_increasing_id().alias("ord")), "lines")

    variants = written(_variants(lines), "variants")  # read twice; a row costs more to make than to store
    met = variants.groupBy("vh").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).filter("a < b").select("vh")
    meeting = written(variants.join(written(met, "met").hint("shuffle_hash"), "vh", "left_semi"), "meeting")
    deleted, itself = meeting.filter("place > 0"), meeting.filter("place = 0")
    replaced = (deleted.join(deleted.groupBy("vh", "place").agg(F.min("ord").alias("early")), ["vh", "place"])
                .filter("early < ord").select("ord", "early"))
    inserted = (deleted.join(itself.select("vh", F.col("ord").alias("other")), "vh")
                .select(F.greatest("ord", "other").alias("ord"), F.least("ord", "other").alias("early")))
    pairs = replaced.unionByName(inserted).filter("early < ord").distinct()
    return (pairs.join(lines.select("lh", "line", "ord"), "ord")
            .join(lines.select(F.col("ord").alias("early"), F.col("line").alias("early_line")), "early")
            .filter(F.levenshtein("line", "early_line", 1).between(0, 1)).select("lh").distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept_text") -> DataFrame:
    """``docs`` with ``out`` (the kept lines joined by line feeds), n_lines and n_removed."""
    docs = docs.drop(out, "n_lines", "n_removed")
    occurrences = _lines(docs, id_col, text_col)
    slim = occurrences.select("id", "k", "n", "lh", F.length("line").alias("chars"), _halves("head").alias("head"), _halves("tail").alias("tail"))
    distinct = written(slim.groupBy("lh").agg(
        F.min(_place("id", "k", "n")).alias("first"), *[F.first(c).alias(c) for c in ("chars", "head", "tail")]), "distinct")
    near = _near_lines(docs, distinct, id_col, text_col)
    fate = written(distinct.select("lh", "first").join(near.withColumn("near", F.lit(True)), "lh", "left"), "fate")
    stays = (F.col("near").isNull() & F.col("first.k").eqNullSafe(F.col("k")) & (F.col("first.n") == F.col("n"))
             & F.col("first.id").eqNullSafe(F.col("id")))
    gone = (occurrences.select("id", "k", "n", "lh").join(fate.hint("shuffle_hash"), "lh").filter(~stays)
            .groupBy("k").agg(F.sort_array(F.collect_set("n")).alias("gone")))

    lines = F.split(F.col(text_col), "\n")
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    both = (docs.withColumn("__k", row_key(id_col, text_col)).alias("d")
            .join(gone.alias("g"), F.col("d.__k") == F.col("g.k"), "left"))
    # one character a line up to the last that goes, so that each line is looked up in constant time
    marks = F.transform("g.gone", lambda x, i: F.concat(
        F.repeat(F.lit("0"), x - F.coalesce(F.get("g.gone", i - 1), F.lit(-1)) - 1), F.lit("1")))
    flags = F.split(F.array_join(marks, ""), "")
    staged = both.select(*cols, lines.alias("__lines"), F.col("g.gone").alias("__gone"), flags.alias("__flags"))
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(
        "__lines", lambda x, i: F.coalesce(F.get("__flags", i), F.lit("0")) == "0"), "\n"))
    return staged.select(*[F.col(f"`{c}`") for c in docs.columns], kept.alias(out),
                         F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
                         F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"))
