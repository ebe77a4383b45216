"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(symbol | class, history) * P(token | symbol).

- The symbol of a token: one of the SINGLES commonest tokens is a symbol of its own; any other token,
  seen or not, belongs to one of SHAPES symbols by its last two bytes. Symbols are classes of WIDTH members.
- P(class | history) and P(symbol | class, history) are softmaxes of WIDTH sums over hashed features: the last
  token, the skips to the second and third last, and the last two together, hashed with the class for the
  second factor. Rare context tokens count as their shape. Each factor of a token is a line: its goal, its
  rows of the weight table, and the logarithms of its counts, which the sums start from.
- Weights are trained by distributed gradient updates over all training documents: each shard of them takes
  Adagrad steps from the common weights, and the changes of a weight row are averaged over the shards that
  met it, ROUNDS times.
- P(token | symbol) = (c + 1) / (N_symbol + V_symbol + 1), with one unseen token a symbol: what the base
  model does with the whole vocabulary, so both treat unseen tokens alike, and each sums to 1.

Counts cover every training token. Texts are cut into words twice, to count them and to code them: what training
and scoring need of a text after that is a code of two bytes a token. Counts of the HEAD commonest tokens go to all tasks (a fixed size);
the occurrences of the others are joined with their counts. Scores are computed a block of tokens at
a time over whole texts.

A document's shard follows from a hash of its id and text, and a shard is read in the order of that hash, so
the model depends neither on the files' layout nor on the number of partitions. Copies of a document beyond SAME are counted by their hash,
and each goes to a shard of its own choice, so that no shard holds a hot one.

Bounds: HEAD (hash, count) pairs and the weights, ``table_rows`` x WIDTH, whose rows grow with the square
root of the training tokens (TABLE at least); the changes pass through the driver once a round. A shard
streams its documents and sends its changed rows once a round; there is one for about SHARE tokens a weight
row, and the changes are added up by blocks of weight rows.

Defined cases: a null text counts as empty; every text ends with one end token, so an empty one has
one token; a null id belongs to the training part; rows that repeat are scored alike; without
training documents every count is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.store import row_key, written
from marketlens.llm.words import CHUNK_BYTES, chunked, mix, word_hashes

WIDTH = 32
SINGLES, SHAPES = 896, 128
SYMBOLS = SINGLES + SHAPES
HEAD, CONTEXT = 1 << 18, 4096
TABLE, FEATURES = 1 << 16, 4
SHARE, ROUNDS, EPOCHS, ROW_BLOCK, FEW, SAME = 32, 2, 1, 2048, 6, 1000
BATCH, BLOCK, RATE, FIRST, LIMIT, EXTREME = 2048, 2048, 0.2, 0.1, 12.0, 80.0
COUNT_FLUSH = 4_000_000
#: Rows that are moved at a time.
ROWS = 1536
#: Leading bits of a hash by which the head is looked up: four times as many values as it has hashes.
FIRST_BITS = 20
_TO_FIRST = np.uint64(64 - FIRST_BITS)
#: From a place to its line; sums of a line's exponentials beyond these may have a term beyond +-EXTREME that matters.
_TO_LINE = FEATURES.bit_length() - 1
MOST, LEAST = float(np.exp(EXTREME)), 1e-6
#: Bytes of text that are cut into words at a time: what that takes for each byte stays near the processor.
CUT = 1 << 18

SPREAD = np.uint64(0x9FB21C651E98DF25)
END = np.uint64(0xE5D0C1B2A3948576)
#: Code of what stands before a text, and hashes of every code at each of the distances, and of every class.
BEFORE = 0xFFFF
_OF_PAST = [mix(np.arange(BEFORE + 1, dtype=np.uint64) << np.uint64(2) | np.uint64(i)) for i in range(FEATURES - 1)]
_OF_CLASS = mix(np.arange(WIDTH, dtype=np.uint64))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, bounds) of the tokens of each text, its end token included."""
    raws = [r.translate(_LOWER) for r in raws]
    hashes, bounds = word_hashes(raws)
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    last = np.flatnonzero(word[:-1] & ~word[1:])
    before = np.where(word[last - 1], data[last - 1], 0).astype(np.uint64)
    shape = (mix(data[last].astype(np.uint64) << np.uint64(8) | before) % np.uint64(SHAPES)).astype(np.int16)
    hashes = np.insert(hashes, bounds[1:], END)
    return hashes, np.insert(shape, bounds[1:], 0), bounds + np.arange(len(bounds))


def totals(hashes: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape, count) of each token, in the order of the hashes."""
    ordered = np.sort(hashes)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    found, lead = ordered[starts], ~np.uint64(SHAPES - 1)
    # the shapes in place of the hashes' last bits sort the same way, unless hashes differ in those alone
    tagged = np.sort(hashes & lead | shape.astype(np.uint64))
    tagged = tagged[np.concatenate([[True], tagged[1:] != tagged[:-1]])]
    if np.array_equal(tagged & lead, found & lead) and (found[1:] & lead != found[:-1] & lead).all():
        return found, (tagged & ~lead).astype(shape.dtype), np.diff(starts, append=len(ordered))
    found, first, n = np.unique(hashes, return_index=True, return_counts=True)
    return found, shape[first], n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by token of a task's documents, combined before they are sent."""
    held: list[np.ndarray] = []
    shapes: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found, shape, n = totals(np.concatenate(held), np.concatenate(shapes))
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n)], names=["h", "shape", "n"])

    for batch in batches:
        for _, raws in chunked(batch.column(0), CUT):
            hashes, shape, _ = tokens(raws)
            held.append(hashes)
            shapes.append(shape)
            size += len(hashes)
            if size >= COUNT_FLUSH:
                yield flush()
                held, shapes, size = [], [], 0
    if held:
        yield flush()


class Vocabulary:
    """Counts of the commonest tokens, and what is needed of all: classes' sizes, N and V."""

    def __init__(self, head: pd.DataFrame, shape_sizes: dict[int, tuple[int, int]], total: int, distinct: int) -> None:
        head = head.sort_values(["c", "h"], ascending=[False, True]).reset_index(drop=True)
        rank = np.arange(len(head))
        order = np.argsort(head["h"].to_numpy().view(np.uint64))
        self.hashes = head["h"].to_numpy().view(np.uint64)[order]
        self.counts, self.ranks = head["c"].to_numpy()[order], rank[order]
        # place of the first hash with these leading bits, or beyond them
        self.firsts = np.searchsorted(self.hashes, np.arange(1 << FIRST_BITS, dtype=np.uint64) << _TO_FIRST).astype(np.int32)
        self.total, self.distinct = total, distinct
        # symbol of each code: a token among the CONTEXT commonest is coded by its rank, another by its shape
        shapes = np.concatenate([np.zeros(CONTEXT, np.int64), np.arange(SHAPES)])
        shapes[: min(len(head), CONTEXT)] = head["shape"].to_numpy()[:CONTEXT]
        self.symbols = symbols(np.arange(CONTEXT + SHAPES), shapes)
        tokens_of, types_of = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        for shape, (n, v) in shape_sizes.items():
            tokens_of[SINGLES + shape], types_of[SINGLES + shape] = n, v
        for i, row in enumerate(head.head(SINGLES).itertuples()):
            tokens_of[i], types_of[i] = row.c, 1
            tokens_of[SINGLES + row.shape] -= row.c
            types_of[SINGLES + row.shape] -= 1
        room = (tokens_of + types_of + 1).reshape(-1, WIDTH)
        self.log_room = np.log10(room.reshape(-1))
        # row 0: the classes; row 1 + c: the symbols of class c
        by_class = room.sum(axis=1)
        self.prior = np.log(np.vstack([by_class / by_class.sum(), room / by_class[:, None]])).astype(np.float32)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, count) of each token; rank is HEAD for one outside the head."""
        if not len(self.hashes):
            return np.full(len(hashes), HEAD), np.zeros(len(hashes), np.int64)
        last = len(self.hashes) - 1
        at = np.minimum(self.firsts.take((hashes >> _TO_FIRST).astype(np.int64)), last)
        known = self.hashes.take(at) == hashes
        # the few that are not the first of their leading bits
        others = np.flatnonzero(~known)
        others = others[self.hashes.take(at[others]) < hashes[others]]
        at[others] = np.minimum(np.searchsorted(self.hashes, hashes[others]), last)
        known[others] = self.hashes.take(at[others]) == hashes[others]
        return np.where(known, self.ranks.take(at), HEAD), np.where(known, self.counts.take(at), 0)


def table_rows(tokens: int) -> int:
    """Rows of the weight table for so many training tokens: eight times the power of two from their square root up."""
    return max(TABLE, 8 << int(np.ceil(np.log2(max(tokens, 1)) / 2)))


def symbols(rank: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.where(rank < SINGLES, rank, SINGLES + shape.astype(np.int64))


def codes(rank: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """A token as its followers see it: its rank, or its shape if it is rare."""
    return np.where(rank < CONTEXT, rank, CONTEXT + shape.astype(np.int64)).astype(np.uint16)


def features(rank: np.ndarray, shape: np.ndarray, bounds: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of tokens, see ``lines``."""
    return lines(codes(rank, shape), symbols(rank, shape), bounds, table)


def _past(code: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The codes one, two and three tokens before each, BEFORE where the text begins later."""
    n, starts, back = len(code), bounds[:-1], []
    for distance in (1, 2, 3):
        past = np.full(n, BEFORE, np.uint16)
        past[distance:] = code[:-distance]
        for place in range(distance):
            at = starts + place
            past[at[at < n]] = BEFORE
        back.append(past)
    return back


def _hashed(back: list[np.ndarray], group: np.ndarray, least: np.uint64, of_class: np.ndarray, of_symbol: np.ndarray) -> None:
    """Weight rows of tokens after ``back``: of their classes, and of their symbols within class ``group``."""
    h = np.empty((FEATURES, len(group)), np.uint64)
    for i, (of, past) in enumerate(zip(_OF_PAST, back, strict=True)):
        of.take(past, out=h[i], mode="clip")
    pair = back[0].astype(np.uint64)
    pair <<= np.uint64(20)
    pair |= back[1]
    pair <<= np.uint64(2)
    pair |= np.uint64(FEATURES - 1)
    h[FEATURES - 1] = mix(pair)
    of_class[:] = h & least
    h ^= _OF_CLASS.take(group)
    h *= SPREAD
    h >>= np.uint64(24)
    h &= least
    of_symbol[:] = h


def lines(code: np.ndarray, symbol: np.ndarray, bounds: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of each token, first its class's, then (from the middle on) its symbol's within the class: the
    goal of each, its row of the prior, and its FEATURES rows of a weight table of ``table`` rows."""
    n, least = len(code), np.uint64(table - 1)
    group, member = symbol // WIDTH, symbol % WIDTH
    back, rows = _past(code, bounds), np.empty((FEATURES, 2 * n), np.int32)
    for a in range(0, n, BLOCK):
        z = min(a + BLOCK, n)
        _hashed([past[a:z] for past in back], group[a:z], least, rows[:, a:z], rows[:, n + a : n + z])
    return np.concatenate([group, member]), np.concatenate([np.zeros(n, np.int64), group + 1]), rows


def dealt(code: np.ndarray, symbol: np.ndarray, bounds: np.ndarray, table: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``lines`` in batches of BATCH at most, each with lines from all over, at even distances: those at a, a + k, ...
    for batch a of k."""
    n, least = len(code), np.uint64(table - 1)
    if not n:
        return
    k = -(-2 * n // BATCH)
    most = -(-n // k)
    # tokens a, a + k, ... together
    own = np.zeros((FEATURES, most * k), np.uint16)
    own[:, :n] = [*_past(code, bounds), symbol]
    own = own.reshape(FEATURES, most, k).transpose(2, 0, 1).copy()
    sizes = [most - (a >= n - (most - 1) * k) for a in range(k)]
    rows = np.empty((k, FEATURES, 2 * most), np.int32)
    for a, size in enumerate(sizes):
        # the lines of these tokens' symbols are in another batch
        b = (a + n) % k
        *back, symbols_of = own[a, :, :size]
        _hashed(back, symbols_of // WIDTH, least, rows[a, :, :size], rows[b, :, sizes[b] : sizes[b] + size])
    for a, size in enumerate(sizes):
        other = (a - n) % k
        symbols_of = own[other, -1, : sizes[other]].astype(np.int64)
        group = symbols_of // WIDTH
        yield (np.concatenate([own[a, -1, :size] // WIDTH, symbols_of % WIDTH]), np.concatenate([np.zeros(size, np.int64), group + 1]),
               rows[a, :, : size + sizes[other]])


def aligned(rows: int, kind: type = np.float32) -> np.ndarray:
    """Room for ``rows`` rows of WIDTH numbers, none of which lies across more cache lines than it fills."""
    size = rows * WIDTH * np.dtype(kind).itemsize
    room = np.empty(size + 128, np.uint8)
    first = -room.ctypes.data % 128
    return room[first : first + size].view(kind).reshape(rows, WIDTH)


def line_logs(goal: np.ndarray, base: np.ndarray, rows: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each line's goal, in blocks. Weights are within +-LIMIT, so the
    exponentials cannot overflow."""
    out, firsts = np.empty(len(goal)), np.arange(0, BLOCK * WIDTH, WIDTH)
    total, part, wide, ones = aligned(BLOCK), aligned(BLOCK), aligned(BLOCK, np.float64), np.ones(WIDTH)
    for a in range(0, len(goal), BLOCK):
        n = min(BLOCK, len(goal) - a)
        sums = np.take(prior, base[a : a + n], axis=0, out=total[:n], mode="clip")
        for row in rows[:, a : a + n].astype(np.int64):
            sums += np.take(weights, row, axis=0, out=part[:n], mode="clip")
        chosen = sums.reshape(-1).take(firsts[:n] + goal[a : a + n]).astype(np.float64)
        np.exp(sums, out=sums)
        wide[:n] = sums
        out[a : a + n] = chosen - np.log(wide[:n] @ ones)
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, bounds) of runs of texts (size, codes), each of about CHUNK_BYTES of text as ``chunked`` cuts them."""
    sizes, first, total = batch.column(0).to_pylist(), 0, 0
    for i, size in enumerate([*sizes, None]):
        if i > first and (size is None or total + size > CHUNK_BYTES):
            texts = batch.column(1).slice(first, i - first).to_pylist()
            yield np.frombuffer(b"".join(texts), np.uint16), np.concatenate([[0], np.cumsum([len(t) // 2 for t in texts])])
            first, total = i, 0
        total += size or 0


def _train_shard(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """EPOCHS of Adagrad steps over each run of a shard's texts; the changes of the rows that were met."""
    weights = aligned(len(common))
    weights[:] = common
    step = Steps(weights, vocabulary.prior)
    for batch in batches:
        for code, bounds in _runs(batch):
            for _ in range(EPOCHS):
                for some in dealt(code, vocabulary.symbols.take(code), bounds, len(common)):
                    step(*some)
    np.clip(weights, -LIMIT, LIMIT, out=weights)
    met = np.flatnonzero(step.met)
    for part in np.split(met, np.flatnonzero(np.diff(met // ROW_BLOCK)) + 1) if len(met) else []:
        change = (weights[part] - common[part]).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([int(part[0]) // ROW_BLOCK], pa.int32()), pa.array([part.astype(np.int32).tobytes()]), pa.array([change.tobytes()])],
                                         names=["block", "rows", "change"])


def _train(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The changes of each shard of a partition, whose rows come in the order of shards."""
    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b > a:
                    yield int(shard[a]), batch.slice(a, b - a).select(["size", "codes"])

    for _, same in groupby(parts(), key=itemgetter(0)):
        yield from _train_shard(map(itemgetter(1), same), vocabulary, common)


class Steps:
    """Adagrad steps over batches of lines, on ``weights`` themselves. A batch reads and writes each of its weight rows
    once and works on a copy of them, those of the most lines first. What it needs room for is kept from one to the next."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray) -> None:
        self.weights, self.prior = weights, prior
        self.whole_rows = weights.view(f"V{weights.itemsize * WIDTH}").reshape(-1)  # a row is copied at once
        self.gathered, self.met = np.full(len(weights), FIRST, np.float32), np.zeros(len(weights), bool)
        self.p, self.part, self.gradient = (aligned(k) for k in (BATCH, BATCH, ROWS))
        self.used, self.sums, self.more = (aligned(BATCH * FEATURES) for _ in range(3))
        self.firsts, self.rarities = np.arange(0, BATCH * WIDTH, WIDTH), np.arange(FEW + 1, dtype=np.uint8)
        self.places = np.arange(BATCH * FEATURES).reshape(BATCH, FEATURES).T.copy()

    def __call__(self, goal: np.ndarray, base: np.ndarray, rows: np.ndarray) -> None:
        n = len(goal)
        # rows in order, with the place of each, line by line, in the low bits
        bits = (n * FEATURES - 1).bit_length()
        kind = np.uint32 if len(self.weights) << bits <= 1 << 32 else np.uint64
        ordered = rows.astype(kind, order="C")
        ordered <<= kind(bits)
        ordered |= self.places[:, :n].astype(kind)
        ordered = ordered.reshape(-1)
        ordered.sort()
        row, place = ordered >> kind(bits), (ordered & kind((1 << bits) - 1)).astype(np.int64)
        line = place >> _TO_LINE
        new = np.ones(len(row), bool)
        np.not_equal(row[1:], row[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        times = np.empty_like(starts)
        np.subtract(starts[1:], starts[:-1], out=times[:-1])
        times[-1] = len(row) - starts[-1]
        # those of the most lines first, so that those with more lines than any number are a slice
        rare = (FEW + 1 - np.minimum(times, FEW + 1)).astype(np.uint8)
        order = np.argsort(rare, kind="stable")
        above = rare.take(order).searchsorted(self.rarities, "right").tolist()[::-1]  # rows of more than so many lines
        turn, at = np.empty_like(order), np.empty_like(place)
        turn[order] = np.arange(len(order))
        at[place] = turn.repeat(times)
        starts, times = starts.take(order), times.take(order[: above[FEW]])
        used, first = row.take(starts).astype(np.int64), line.take(starts)
        weights = self.weights.take(used, axis=0, out=self.used[: len(used)], mode="clip")
        p = self._errors(goal, base, weights, at.reshape(n, FEATURES).T.copy())
        sums = self._sums(p, line, starts, times, above)
        # most rows have one line, whose p is their gradient
        squares, several = np.einsum("ij,ij->i", p, p).take(first), len(sums)
        squares[:several] = np.einsum("ij,ij->i", sums, sums)
        squares /= WIDTH
        squares += self.gathered.take(used)
        self.gathered[used], self.met[used] = squares, True
        rate = (RATE / np.sqrt(squares))[:, None]
        sums *= rate[:several]
        weights[:several] -= sums
        for a in range(several, len(used), ROWS):
            gradient = p.take(first[a : a + ROWS], axis=0, out=self.gradient[: min(ROWS, len(used) - a)], mode="clip")
            gradient *= rate[a : a + ROWS]
            weights[a : a + ROWS] -= gradient
        self.whole_rows.put(used, weights.view(self.whole_rows.dtype).reshape(-1), mode="clip")

    def _errors(self, goal: np.ndarray, base: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The probabilities of each line, less 1 at its goal. Sums are kept within +-EXTREME where the exponentials tell
        that one may be beyond."""
        n = len(goal)
        p = self._summed(base, weights, at)
        with np.errstate(over="ignore"):
            total = np.exp(p, out=p).sum(axis=1, keepdims=True)
        if not (total.max() <= MOST and total.min() >= LEAST):
            p = self._summed(base, weights, at)
            np.exp(np.clip(p, -EXTREME, EXTREME, out=p), out=p)
            total = p.sum(axis=1, keepdims=True)
        p /= total
        p.reshape(-1)[self.firsts[:n] + goal] -= 1
        return p

    def _summed(self, base: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The sums of each line: its rows of ``weights``, and of the prior."""
        p, part = self.p[: len(base)], self.part[: len(base)]
        weights.take(at[0], axis=0, out=p, mode="clip")
        for i in range(1, FEATURES):
            p += weights.take(at[i], axis=0, out=part, mode="clip")
        p += self.prior.take(base, axis=0, out=part, mode="clip")
        return p

    def _sums(self, p: np.ndarray, line: np.ndarray, starts: np.ndarray, times: np.ndarray, above: list[int]) -> np.ndarray:
        """The sum of p over the lines of each row with more than one: one by one for most rows, as sums of runs for the
        frequent ones, which come first; ``times`` has the lines of those."""
        often, several = above[FEW], above[1]
        sums = p.take(line.take(starts[:several]), axis=0, out=self.sums[:several], mode="clip")
        for turn in range(1, FEW):
            if (more := above[turn]) > often:
                sums[often:more] += p.take(line.take(starts[often:more] + turn), axis=0, out=self.more[: more - often], mode="clip")
        if often:
            ends = np.cumsum(times)
            at = np.arange(int(ends[-1])) + np.repeat(starts[:often] - (ends - times), times)
            wide = p.take(line.take(at), axis=0).astype(np.float64)
            # two columns at a time, as the parts of complex numbers, which add up one by one just the same
            whole = np.cumsum(wide.view(np.complex128), axis=0).view(np.float64).take(ends - 1, axis=0)
            sums[0] = whole[0]
            sums[1:often] = whole[1:] - whole[:-1]
        return sums


def _step(goal: np.ndarray, rows: np.ndarray, weights: np.ndarray, gathered: np.ndarray, prior: np.ndarray) -> None:
    """A single step over a batch of lines, each with its row of ``prior``, on ``weights`` and ``gathered`` themselves."""
    step = Steps(weights, prior)
    step.gathered = gathered
    step(goal, np.arange(len(goal)), rows)


def _mean_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each weight row over the shards that met it. Sums of half-precision numbers are
    exact in double precision, so their order does not matter."""
    change: dict[int, np.ndarray] = {}
    times: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, rows, part in zip(*(batch.column(c) for c in range(3)), strict=True):
            block, at = block.as_py(), np.frombuffer(rows.as_py(), np.int32) % ROW_BLOCK
            if block not in change:
                change[block], times[block] = np.zeros((ROW_BLOCK, WIDTH)), np.zeros(ROW_BLOCK, np.int64)
            change[block][at] += np.frombuffer(part.as_py(), np.float16).reshape(-1, WIDTH)
            times[block][at] += 1
    for block, n in times.items():
        at = np.flatnonzero(n)
        mean = (change[block][at] / n[at][:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(block * ROW_BLOCK + at).astype(np.int32).tobytes()]), pa.array([mean.tobytes()])],
                                         names=["block", "rows", "change"])


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The tokens of the highest counts, as many as fit in ``most`` without parting equal counts (or, from
    4096 on, counts within a sixteenth of a power of two): a histogram of counts gives the least of them."""
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.floor(F.log2("c") * 16) + 4096)
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    return counts.filter(level >= F.lit(least)) if least is not None else counts.limit(0)


def sharded(rows: DataFrame, n: int) -> DataFrame:
    """(shard, text) of (id, text): the texts ``placed`` by their keys."""
    return placed(rows.select(row_key("id", "text").alias("k"), "text"), n)


def placed(keyed: DataFrame, n: int) -> DataFrame:
    """(shard, ...) of (k, ...): ``n`` shards that depend on the rows alone, not on where they stood, each
    whole and in the order of its hashes in one partition, however many partitions there are."""
    kept = [c for c in keyed.columns if c != "k"]
    hot = written(keyed.groupBy("k").agg(F.count("*").alias("times")).filter(F.col("times") > SAME), "hot")
    copies = (keyed.join(hot, "k").groupBy("k", "times").agg(F.min(F.struct(*kept)).alias("row"))
              .select("k", "row.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")))
    every = keyed.join(hot, "k", "left_anti").select("k", *kept, F.lit(0).cast("long").alias("copy")).unionByName(copies)
    shard = F.pmod(F.xxhash64("k", "copy"), F.lit(n)).cast("int").alias("shard")
    dealt = every.select(shard, "k", "copy", *kept).repartitionById(n, F.col("shard"))
    return dealt.sortWithinPartitions("shard", "k", "copy", *kept).select("shard", *kept)


def counted(texts: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(all counts as (h, c), vocabulary) of the texts, the only column."""
    counts = written(texts.mapInArrow(_counts, "h long, shape int, n long")
                     .groupBy("h").agg(F.sum("n").alias("c"), F.first("shape").alias("shape")), "counts")
    sizes = {r["shape"]: (r["n"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    head = commonest(counts, HEAD).toPandas()
    return counts.select("h", "c"), Vocabulary(head, sizes, sum(n for n, _ in sizes.values()), sum(v for _, v in sizes.values()))


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raws in chunked(batch.column(3), CUT):
            hashes, shape, bounds = tokens(raws)
            rank, count = vocabulary.look_up(hashes)
            code = codes(rank, shape)
            out = rank == HEAD
            tail_bounds = np.concatenate([[0], np.cumsum(out)])[bounds].astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(tail_bounds), pa.array(hashes[out].view(np.int64)))
            starts, n = bounds[:-1], len(raws)
            sums = [np.add.reduceat(x, starts) for x in (np.log10(count + 1.0), (count > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(first, n) for i in range(3)), pa.array(np.diff(bounds).astype(np.int64)), *map(pa.array, sums),
                 pa.array([len(r) for r in raws], pa.int64()), pa.array([code[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()), tail],
                names=["k", "id", "held_out", "n_tokens", "count_logs", "known", "size", "codes", "tail"])


def encoded(docs: DataFrame, held_out: Column, id_col: str, text_col: str, known) -> DataFrame:
    """Each row of ``docs`` with its tokens' codes and what the counts of the head tell, whatever the weights;
    ``tail`` has the hashes outside the head."""
    rows = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(lambda b: _encode(b, known.value), f"k long, id {kind}, held_out boolean, n_tokens long, count_logs double, "
                                   "known long, size long, codes binary, tail array<long>"), "encoded")


def train(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """(all counts as (h, c), vocabulary, weight table) of the training documents."""
    counts, vocabulary = counted(docs.select(text_col))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return counts, vocabulary, weights_of(encoded(docs, F.lit(False), id_col, text_col, known), known)


def weights_of(texts: DataFrame, known) -> np.ndarray:
    """The weight table that the ``encoded`` texts train."""
    vocabulary = known.value
    context = texts.sparkSession.sparkContext
    weights = np.zeros((table_rows(vocabulary.total), WIDTH), np.float32)
    shards = placed(texts.select("k", "size", "codes"), vocabulary.total // (SHARE * len(weights)) + 1)
    blocks = len(weights) // ROW_BLOCK
    for _ in range(ROUNDS):
        common = context.broadcast(weights)
        changes = shards.mapInArrow(lambda b, common=common: _train(b, known.value, common.value), "block int, rows binary, change binary")
        means = written(changes.repartition(blocks, "block").mapInArrow(_mean_changes, "block int, rows binary, change binary"), "changes")
        weights = weights.copy()
        for r in means.toLocalIterator():
            at = np.frombuffer(bytes(r["rows"]), np.int32)
            weights[at] += np.frombuffer(bytes(r["change"]), np.float32).reshape(-1, WIDTH)
        np.clip(weights, -LIMIT, LIMIT, out=weights)
        common.unpersist()
    return weights


def _score(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    vocabulary, common = shipped.value
    weights = aligned(len(common))
    weights[:] = common
    for batch in batches:
        parts = []
        for code, bounds in _runs(batch.select(["size", "codes"])):
            symbol = vocabulary.symbols.take(code)
            goal, base, rows = lines(code, symbol, bounds, len(weights))
            by_class, within = line_logs(goal, base, rows, weights, vocabulary.prior).reshape(2, -1) / np.log(10)
            parts.append(np.add.reduceat(by_class + within - vocabulary.log_room[symbol], bounds[:-1]))
        class_logs = np.concatenate(parts) if parts else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(class_logs)], names=[*batch.schema.names[:6], "class_logs"])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score
    and score, both log10 probabilities. The model learns from the rows where ``held_out`` is false."""
    counts, vocabulary = counted(docs.filter(~held_out).select(text_col))
    context = docs.sparkSession.sparkContext
    known = context.broadcast(vocabulary)
    texts = encoded(docs, held_out, id_col, text_col, known)
    shipped = context.broadcast((vocabulary, weights_of(texts.filter(~F.col("held_out")), known)))
    kind = texts.schema["id"].dataType.simpleString()
    scored = written(texts.drop("tail").mapInArrow(lambda b: _score(b, shipped), f"k long, id {kind}, held_out boolean, n_tokens long, count_logs double, "
                                                   "known long, class_logs double"), "scored")
    # rows that repeat id and text share k: their tokens are looked up once
    rare = texts.select("k", "tail").dropDuplicates(["k"]).select("k", F.explode("tail").alias("h"))
    rest = (rare.join(counts.hint("shuffle_hash"), "h").groupBy("k")
            .agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("rare_known")))
    out = scored.join(rest, "k", "left")
    seen = F.col("count_logs") + F.coalesce("rare_logs", F.lit(0.0))
    room = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * F.lit(room)).alias("base_score"), (seen + F.col("class_logs")).alias("score"))
