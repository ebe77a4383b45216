"""Mixing of sources to target token weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each pattern
offers its tokens up to MAX_COPIES times, every further copy at a higher cost, and a min-cost flow
routes that capacity to the source quotas: repetition is spread as thinly as the quotas allow. A
pattern's flow is then whole copies of all its documents, plus one more copy of seeded documents.

Only aggregates reach the driver: one row per pattern (at most MAX_PATTERNS, else an error), and per
pattern 2**BITS sums by bits of the seeded hash. The bucket in which a pattern's remainder ends is
split by the next bits until it holds one hash, so the selection is a threshold on the hash: no
ordering of the corpus, no window. A remainder short of the next document goes to the unselected
document whose size comes nearest.

Defined cases: a null text has size 0; documents without tokens take nothing and count in no target;
a null source is a source of its own, last in order; rows that repeat both id and text share their
hash and are selected together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.store import written

MAX_COPIES, MAX_PATTERNS, BITS, HASH_BITS = 2, 5_000, 8, 63
WEIGHTS, SHARE, SEED = (5.0, 2.0, 1.0), 1.5, 20

TOKEN = r"[^\x20\x09-\x0D]"

Pattern = tuple[str | None, ...]


def token_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(f"{TOKEN}+")), F.lit(0)).cast("long")


def seeded_hash(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """63 bits, the same for a row in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), 1)


def in_order(sources: Iterable[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict[str | None, int], total: float, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """``total`` shared by repeating weights; a target stops at MAX_COPIES times its source's size and
    its excess is shared among the others by weight until none is above."""
    names = in_order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_names = list(names)
    while open_names:
        left, parts = total - sum(out.values()), sum(weight[s] for s in open_names)
        share = {s: left * weight[s] / parts for s in open_names}
        full = [s for s in open_names if share[s] > MAX_COPIES * sizes[s]]
        if not full:
            return out | share
        out |= {s: float(MAX_COPIES * sizes[s]) for s in full}
        open_names = [s for s in open_names if s not in full]
    return out


def min_cost_flow(patterns: dict[Pattern, int], quotas: dict[str | None, int]) -> dict[tuple[Pattern, str | None], int]:
    """Tokens routed from each pattern to each of its sources: as much of the quotas as can be met, at
    the least cost, where a pattern's n-th copy costs n a token. Successive shortest paths."""
    nodes: list = ["start", "end", *(("p", p) for p in patterns), *(("s", s) for s in quotas)]
    at = {n: i for i, n in enumerate(nodes)}
    arcs: list[list[int]] = []  # [to, room, cost]; arc i ^ 1 is the reverse of arc i
    out: list[list[int]] = [[] for _ in nodes]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        out[b].append(len(arcs) + 1)
        arcs.extend(([b, room, cost], [a, 0, -cost]))
        return len(arcs) - 2

    routed = {}
    for p, size in patterns.items():
        for copy in range(1, MAX_COPIES + 1):
            arc(at["start"], at["p", p], size, copy)
        for s in dict.fromkeys(p):
            routed[p, s] = arc(at["p", p], at["s", s], MAX_COPIES * size, 0)
    for s, quota in quotas.items():
        arc(at["s", s], at["end"], quota, 0)
    while True:
        cost, via, queue = {at["start"]: 0}, {}, [at["start"]]
        while queue:
            after: dict[int, None] = {}
            for a in queue:
                for i in out[a]:
                    to, room, price = arcs[i]
                    if room and cost[a] + price < cost.get(to, 1 << 60):
                        cost[to], via[to] = cost[a] + price, i
                        after[to] = None
            queue = list(after)
        if at["end"] not in cost:
            return {key: arcs[i ^ 1][1] for key, i in routed.items()}
        path, node = [], at["end"]
        while node != at["start"]:
            path.append(via[node])
            node = arcs[via[node] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push


def _thresholds(sized: DataFrame, rest: dict[Pattern, int]) -> tuple[dict[Pattern, int], dict[Pattern, int]]:
    """(hash below which a pattern's documents get one copy more, tokens still missing after those)."""
    spark = sized.sparkSession
    low, room = dict.fromkeys(rest, 0), dict(rest)
    open_patterns, depth = [p for p in rest if rest[p] > 0], 0
    while open_patterns and depth < HASH_BITS:
        bits = min(BITS, HASH_BITS - depth)
        shift = HASH_BITS - depth - bits
        bounds = spark.createDataFrame([(list(p), low[p]) for p in open_patterns], "sources array<string>, low long")
        width = (1 << (shift + bits)) - 1
        inside = (sized.join(F.broadcast(bounds), "sources")
                  .filter((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") <= F.lit(width)) & (F.col("size") > 0)))
        part = F.shiftright(F.col("h") - F.col("low"), shift).alias("part")
        sums: dict[Pattern, list] = {}
        for r in inside.groupBy("sources", part).agg(F.sum("size").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).collect():
            sums.setdefault(tuple(r["sources"]), []).append((r["part"], r["n"], r["a"] < r["b"]))
        again = []
        for p in open_patterns:
            base = low[p]
            low[p] = min(base + width + 1, (1 << HASH_BITS) - 1)
            for k, n, several in sorted(sums.get(p, [])):
                if n > room[p]:
                    low[p] = base + (k << shift)
                    if several:
                        again.append(p)
                    break
                room[p] -= n
        open_patterns, depth = again, depth + bits
    return low, room


def _nearest(sized: DataFrame, low: dict[Pattern, int], room: dict[Pattern, int]) -> dict[Pattern, int]:
    """Per pattern, the hash of the unselected document whose size is nearest to the missing tokens,
    where taking it comes nearer than leaving it."""
    spark = sized.sparkSession
    short = [(list(p), low[p], r) for p, r in room.items() if r > 0]
    if not short:
        return {}
    open_docs = (sized.join(F.broadcast(spark.createDataFrame(short, "sources array<string>, low long, room long")), "sources")
                 .filter((F.col("h") >= F.col("low")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("room"))))
    units = open_docs.groupBy("sources", "h").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    off = F.abs(F.col("size") - F.col("room"))
    best = units.filter(off < F.col("room")).groupBy("sources").agg(F.min(F.struct(off.alias("off"), "h")).alias("b"))
    return {tuple(r["sources"]): r["b"]["h"] for r in best.collect()}


def plan(sized: DataFrame, target_of: Callable[[dict, float], dict] = targets, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """From (sources array<string>, size, h): the plan of each pattern (sources, copies, low, extra)
    and the table of sources (source, source_size, target). Both are as small as the patterns."""
    spark = sized.sparkSession
    rows = sized.groupBy("sources").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["sources"]): int(r["n"]) for r in rows}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in dict.fromkeys(p):
            sizes[s] = sizes.get(s, 0) + n
    wanted = target_of(sizes, share * sum(patterns.values())) if sizes else {}
    flow = min_cost_flow({p: n for p, n in patterns.items() if n}, {s: round(t) for s, t in wanted.items()})
    used: dict[Pattern, int] = {}
    for (p, _), n in flow.items():
        used[p] = used.get(p, 0) + n
    copies = {p: used.get(p, 0) // n if n else 0 for p, n in patterns.items()}
    low, room = _thresholds(sized, {p: used.get(p, 0) - copies[p] * n for p, n in patterns.items()})
    extra = _nearest(sized, low, room)
    plans = [(list(p), copies[p], low[p], extra.get(p, -1)) for p in patterns]
    sources = [(s, sizes[s], wanted[s]) for s in in_order(sizes)]
    return (spark.createDataFrame(plans, "sources array<string>, copies long, low long, extra long"),
            spark.createDataFrame(sources, T.StructType([
                T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])))


def with_copies(df: DataFrame, plans: DataFrame) -> DataFrame:
    """``df`` (with sources and h) and ``n_copies``, how often the mix takes each row."""
    more = ((F.col("h") < F.col("low")) | (F.col("h") == F.col("extra"))).cast("long")
    return (df.join(F.broadcast(plans), "sources").withColumn("n_copies", F.col("copies") + more).drop("copies", "low", "extra"))


def as_sources(source_col: str) -> Column:
    """Membership of documents that have one source each."""
    return F.array(F.col(source_col).cast("string"))


def mix_documents(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (not at all, once or more)."""
    keyed = docs.filter(F.col(text_col).rlike(TOKEN)).select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], sources.alias("sources"),
                        seeded_hash(id_col, text_col).alias("h"))
    sized = written(docs.select(sources.alias("sources"), token_count(text_col).alias("size"), seeded_hash(id_col, text_col).alias("h")), "sized")
    plans, _ = plan(sized)
    taken = with_copies(keyed, plans).filter("n_copies > 0")
    return (taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
            .select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns]))
