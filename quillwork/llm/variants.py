"""Spelling variants: words of a corpus one edit apart, by search schemes over a bidirectional FM-index.

Of two words at one edit, of which the longer has m code points, either the first
m // 2 or the last m - m // 2 are the same in both. Words are dealt by these two
halves, once as a word of length m and once as the shorter partner of words of
length m, so near words meet in one group. A task joins the words of its groups
with delimiters and builds the suffix order of that text and of its reverse. Each
word of length m looks for its near words in two schemes: its first half is
matched exactly, to the left up to the delimiter, and then extended to the right
over the second half with one error allowed; or the second half is matched to the
right up to the delimiter and extended to the left. A match is a pair of suffix
ranges, one in each order, that shrink together.

Groups above a bound are dealt into slabs, each pair of which is a group of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contamination import suffix_array
from .textkit import slices, store

RUNS = re.compile("[a-zÀ-ÿ]+")
HELD_WORDS = 200_000
#: Symbols of one index: bounds the memory of a task.
SHARD = 1 << 18
SLAB = 1 << 17
PART = 1 << 21
BATCH = 1 << 13


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


def mutated(run: str, prefix: int, every: int) -> str:
    """``run``, without one code point if the crc32 of ``<id>:<run>`` is a multiple of ``every``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count_task(every: int | None, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return found

        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                runs = RUNS.findall(lower_ascii(text))
                if every is None or name is None:
                    held.update(r for r in runs if len(r) >= shortest)
                    continue
                prefix = zlib.crc32(f"{name}:".encode())
                for r, n in Counter(runs).items():
                    if len(r) >= shortest:
                        word = mutated(r, prefix, every)
                        if len(word) >= shortest:
                            held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
        if held:
            yield out()
    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3,
               every: int | None = None) -> DataFrame:
    """``(word, n)`` of words of at least ``shortest`` code points and ``least`` occurrences.

    Words are runs of the letters a-z (A-Z lower-cased) and the characters U+00C0 to U+00FF. With ``every``, the words
    of a document are first changed as ``mutated`` tells; a null id changes none. Null texts have no words.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(_count_task(every, shortest), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least))


class Order:
    """Suffix order of a text: its transform with the number of every symbol before every place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.suffixes = suffix_array(symbols)
        last = symbols[self.suffixes - 1]
        self.before = np.zeros((len(symbols) + 1, sigma), dtype=np.int32)
        self.before[np.arange(1, len(symbols) + 1), last] = 1
        np.cumsum(self.before, axis=0, out=self.before)
        self.first = np.concatenate([[0], np.cumsum(self.before[-1])]).astype(np.int64)
        self.ends = np.flatnonzero(last == 0)


class BidirectionalIndex:
    """Both suffix orders of words joined by symbol 0. A match has a range in each: (low, other low, size)."""

    def __init__(self, words: list[np.ndarray], sigma: int):
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        # every word has a delimiter before it, and the text ends with one
        text = np.zeros(int(self.sizes.sum()) + len(words) + 1, dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        inside = np.ones(len(text), dtype=bool)
        inside[self.starts] = inside[-1] = False
        text[inside] = np.concatenate(words)
        self.text, self.sigma = text, sigma
        self.ahead = Order(text, sigma)
        self.back = Order(text[::-1], sigma)

    def extend(self, order: Order, low: np.ndarray, other: np.ndarray, size: np.ndarray, symbol: np.ndarray):
        """One symbol more on the side that ``order`` reads: to the left with ``ahead``, to the right with ``back``."""
        a, b = order.before[low], order.before[low + size]
        at = np.arange(len(low))
        count = b[at, symbol] - a[at, symbol]
        less = np.cumsum(b - a, axis=1)[at, symbol] - count
        return order.first[symbol] + a[at, symbol], other + less, count.astype(np.int64)

    def branches(self, order: Order, low: np.ndarray, other: np.ndarray, size: np.ndarray):
        """Every way to extend each match by one letter: ``(match, symbol, low, other, size)``."""
        a = order.before[low]
        found = order.before[low + size] - a
        less = np.cumsum(found, axis=1) - found
        match, symbol = np.nonzero(found[:, 1:])
        symbol += 1
        return (match, symbol, order.first[symbol] + a[match, symbol], other[match] + less[match, symbol],
                found[match, symbol].astype(np.int64))

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, len(self.text))

    def near(self, queries: list[np.ndarray], to_right: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` pairs: words that come from the query by one replaced or deleted symbol outside of the half
        that is matched exactly (the first one if ``to_right``). A pair may come twice."""
        m = np.array([len(q) for q in queries], dtype=np.int64)
        half = m // 2
        grid = np.zeros((len(queries), int(m.max()) + 1), dtype=np.int64)
        for row, q in enumerate(queries):
            grid[row, :len(q)] = q
        exact, error = (self.ahead, self.back) if to_right else (self.back, self.ahead)
        low, other, size = self.start(len(queries))
        # the exact half, from the middle outwards, and the delimiter at its end
        at, steps = (half - 1, half) if to_right else (half, m - half)
        for step in range(int(steps.max()) + 1):
            on = np.flatnonzero((step <= steps) & (size > 0))
            place = at[on] - step if to_right else at[on] + step
            symbol = np.where(step == steps[on], 0, grid[on, np.maximum(place, 0)])
            low[on], other[on], size[on] = self.extend(exact, low[on], other[on], size[on], symbol)
        # the other half, from the middle outwards, in the other order
        low, other = other, low
        left = m - half if to_right else half
        whole = np.flatnonzero(size > 0)
        low, other, size = low[whole], other[whole], size[whole]
        wrong: list[tuple[np.ndarray, ...]] = []
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(whole) or wrong:
            nxt: list[tuple[np.ndarray, ...]] = []
            if len(whole):
                on = left[whole] > step
                whole, low, other, size = whole[on], low[on], other[on], size[on]
            if len(whole):
                place = half[whole] + step if to_right else half[whole] - 1 - step
                symbol = grid[whole, place]
                nxt.append((whole, low, other, size))  # the symbol is missing in the word
                match, sub, l, o, s = self.branches(error, low, other, size)
                other_symbol = sub != symbol[match]
                nxt.append(tuple(x[other_symbol] for x in (whole[match], l, o, s)))
                l, o, s = self.extend(error, low, other, size, symbol)
                alive = s > 0
                exact_on = (whole[alive], l[alive], o[alive], s[alive])
            else:
                exact_on = (whole, low, other, size)
            if wrong:
                q, l, o, s = (np.concatenate(x) for x in zip(*wrong))
                done = left[q] <= step
                hits.append(self.words_of(error, q[done], l[done], s[done]))
                q, l, o, s = q[~done], l[~done], o[~done], s[~done]
                l, o, s = self.extend(error, l, o, s, grid[q, half[q] + step if to_right else half[q] - 1 - step])
                alive = s > 0
                nxt.append((q[alive], l[alive], o[alive], s[alive]))
            whole, low, other, size = exact_on
            wrong = [x for x in nxt if len(x[0])]
            step += 1
        if not hits:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*hits))

    def words_of(self, order: Order, query: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` of the matches that a delimiter ends on the open side too; words are distinct, so each has at
        most one such row."""
        at = order.before[low, 0]
        whole = order.before[low + size, 0] > at
        place = order.suffixes[order.ends[at[whole]]]
        if order is self.back:
            place = len(self.text) - 1 - place
        return query[whole], np.searchsorted(self.starts, place, side="right") - 1


def near_in_groups(words: list[str], counts: list[int], keys: list[int], first: list[bool], asks: list[bool],
                   member: list[bool]) -> list[tuple[str, int, str, int]]:
    """``(word, n, other, its n)`` for rows of whole groups: near words among the members of the asking word's group.

    A pair found from the second half is left out if the first halves are the same, as that group gives it too. Pairs
    of different lengths are asked for by the longer word and come in both directions.
    """
    names = sorted(set(words))
    number = {w: i for i, w in enumerate(names)}
    points = [np.frombuffer(w.encode("utf-32-le"), dtype="<u4") for w in names]
    letters = np.unique(np.concatenate(points))
    coded = [np.searchsorted(letters, p) + 1 for p in points]
    row_word = np.array([number[w] for w in words], dtype=np.int64)
    count = np.zeros(len(names), dtype=np.int64)
    count[row_word] = counts
    is_member, is_asking, to_first = np.array(member), np.array(asks), np.array(first)
    if not (is_member.any() and is_asking.any()):
        return []
    indexed = np.unique(row_word[is_member])
    index = BidirectionalIndex([coded[i] for i in indexed.tolist()], len(letters) + 1)
    key = np.unique(np.array(keys, dtype=np.int64), return_inverse=True)[1]
    members = np.unique(key[is_member] * len(names) + row_word[is_member])
    out: list[tuple[str, int, str, int]] = []
    for to_right in (True, False):
        rows = np.flatnonzero(is_asking & (to_first == to_right))
        for at in range(0, len(rows), BATCH):
            now = rows[at:at + BATCH]
            query, word = index.near([coded[w] for w in row_word[now].tolist()], to_right)
            pairs = np.unique(query * len(names) + indexed[word])
            query, word = pairs // len(names), pairs % len(names)
            code = key[now[query]] * len(names) + word
            spot = np.minimum(np.searchsorted(members, code), len(members) - 1)
            kept = members[spot] == code
            for q, x in zip(row_word[now[query[kept]]].tolist(), word[kept].tolist()):
                a, b = names[q], names[x]
                half = len(a) // 2
                if not to_right and a[:half] == b[:half]:
                    continue
                out.append((a, int(count[q]), b, int(count[x])))
                if len(b) < len(a):
                    out.append((b, int(count[x]), a, int(count[q])))
    return out


def _near_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; whole keys are gathered up to ``SHARD`` symbols and searched together."""
    held: list[tuple] = []
    size = 0

    def found(rows: list[tuple]) -> pa.RecordBatch:
        key, words, counts, first, asks, member = (list(x) for x in zip(*rows))
        pairs = near_in_groups(words, counts, key, first, asks, member)
        cols = list(zip(*pairs)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
            ["word", "n", "other", "other_n"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > SHARD and row[0] != held[-1][0]:
                yield found(held)
                held, size = [], 0
            held.append(row)
            size += len(row[1]) + 1
    if held:
        yield found(held)


def near_pairs(words: DataFrame, slab: int = SLAB) -> DataFrame:
    """``(word, n, other, other_n)``: every ordered pair of ``words (word, n)``, which are distinct, that differ by
    exactly one inserted, deleted or replaced code point, once. Words have two code points or more."""
    length = F.length("word")
    half = F.floor(F.col("longest") / 2).cast("int")
    dealt = (words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longest"))
             .select("word", "n", "longest", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
             .withColumn("key", F.xxhash64("longest", "first", F.when(F.col("first"), F.substring("word", F.lit(1), half)).otherwise(
                 F.expr("right(word, longest - longest DIV 2)"))))
             .withColumn("asks", length == F.col("longest")))
    dealt = store(dealt, "halves")
    sized = dealt.groupBy("key").agg(F.sum(F.length("word") + 1).alias("size"), F.max("asks").alias("asked"), F.count("*").alias("members"))
    groups = sized.filter("asked AND members > 1").select("key", F.ceil(F.col("size") / slab).cast("int").alias("slabs"))
    # members of slab i meet the asking words of slab j under (i, j)
    places = """concat(transform(sequence(0, slabs - 1), k -> struct(own AS i, k AS j, true AS member, asks AND k = own AS asks)),
                       transform(filter(sequence(0, slabs - 1), k -> asks AND k <> own), k -> struct(k AS i, own AS j, false AS member, true AS asks)))"""
    rows = (dealt.join(groups, "key").withColumn("own", F.expr("CAST(pmod(xxhash64(word, 7), slabs) AS INT)"))
            .select("key", "word", "n", "first", F.explode(F.expr(places)).alias("at"))
            .select(F.xxhash64("key", "at.i", "at.j").alias("key"), "word", "n", "first", "at.asks", "at.member"))
    symbols = dealt.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-symbols // PART))
    return (rows.repartition(parts, "key").sortWithinPartitions("key")
            .mapInArrow(_near_task, "word string, n bigint, other string, other_n bigint"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms (word, form)``: the end of each chain of forms. Chains have no circles, and every
    round doubles the step, so the rounds are the logarithm of the longest chain."""
    jump = store(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "jumps")
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = store(jump.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "jumps")
        jump = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return jump


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, ratio: int = 2,
                   every: int | None = None, slab: int = SLAB) -> DataFrame:
    """Per word of the corpus (see ``vocabulary``): ``word``, ``n``, ``n_near`` (words one edit apart), ``form`` (the most
    frequent of them, ties: the smallest by code points, if it is ``ratio`` times as frequent or more), ``form_n``, and
    ``root`` (the last of the forms that follow; the word itself if it has none).

    ``shortest`` must be 2 or more and ``ratio`` over 1. Null texts have no words, long ones and repeated rows count in
    full, other columns are not looked at, and an empty table gives an empty result.
    """
    if shortest < 2 or ratio <= 1:
        raise ValueError("words need two code points, and forms a ratio above one")
    words = store(vocabulary(docs, id_col, text_col, shortest, least, every), "words")
    best = near_pairs(words, slab).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best"))
    strong = -F.col("best.minus") >= ratio * F.col("n")
    known = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"),
        F.when(strong, -F.col("best.minus")).alias("form_n")), "forms")
    return known.join(roots(known), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
