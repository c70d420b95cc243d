"""Spelling variants by a trie of letter-group counts.

Words. Runs of letters of whole texts are counted in each task, with A-Z lower-cased and a code point deleted from the runs
that a checksum of document and run picks; the counts of tasks meet by word. Letters are dealt to GROUPS groups of about equal
weight by their counts over all words, so a word is a vector of group counts.

Near words. One replaced code point takes one from a group and gives one to a group (maybe the same), an inserted one gives one.
The words of one length are a trie whose levels are the successive counts. A depth-first search takes a word down the trie of its own
length, and that of words one longer, and may spend a surplus and a deficit of one each on the way. The words of the
leaves that it reaches are verified letter by letter, so the result is exact.

Layout. Above the trie of all groups stand levels that count several groups at once. They are a shard's address, with the length; there
are the more of them, the more words there are. A word is sent to the shards that the budget lets it reach, and of the two ways in which a pair
can meet one is left out, so that each pair meets in one shard. Shards of more than PART bytes are cut into parts, and searching words go to each.
Within a task words stream through the shard's trie in batches, whose search is a stack of arrays of (word, node, budget left); an
array beyond FRONTIER entries is cut in two, and the second half waits on the stack. Tasks return sums by word, not pairs.

Defined cases: null texts have no words; a null id reads as the empty text; repeated rows count as often as they are there; a form
always has a larger count than the word, so forms cannot run in circles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import LOWER_TABLE, discard, staged, text_of

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has so many times the count of the word.
TIMES = 5
#: One in so many runs of a document loses a code point.
DAMAGED = 199
GROUPS = 20
#: Characters read at once, different words that a task counts before it passes them on.
PIECE, HELD = 1 << 20, 200_000
#: Bytes of a shard's part, of a batch of searching words, and entries of the search and of a verification at once.
PART, FRONTIER, VERIFIED = 4 << 20, 1 << 19, 1 << 21


def runs_of(text: str) -> Iterator[list[str]]:
    """Lists of the lower-cased runs of letters, of pieces of the text that are cut between runs."""
    at, end = 0, len(text)
    while at < end:
        to = min(end, at + PIECE)
        if to < end and (rest := LETTERS.match(text, to)):
            to = rest.end()
        yield LETTERS.findall(text[at:to].encode("utf-8", "surrogatepass").translate(LOWER_TABLE).decode("utf-8", "surrogatepass"))
        at = to


def damaged(run: str, start: int) -> str:
    """The run, less a code point if the checksum picks it. ``start`` is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counting(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for id, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{id.as_py()}:".encode())
                for runs in runs_of(text.as_py()):
                    for word, n in Counter(runs).items():
                        if len(word) >= least:
                            word = damaged(word, start)
                            if len(word) >= least:
                                words[word] += n
                    if len(words) > HELD:
                        yield told()
        if words:
            yield told()

    return run


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    return rows.mapInArrow(_counting(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[int]:
    """The group of every code point up to 255: letters by falling count, each to the group that has least so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    weight, out = [0] * groups, [0] * 256
    for c, n in sorted(letters.collect(), key=lambda r: (-r[1], r[0])):
        g = min(range(groups), key=lambda i: (weight[i], i))
        weight[g] += n
        out[ord(c)] = g
    return out


def address_length(n: int) -> int:
    """How many counts a shard's address takes, so that shards of ``n`` words of usual spread stay in the thousands."""
    return next(t for t in (3, 4, 5, 6) if n <= 2_000_000 * 4 ** (t - 3) or t == 6)


class Trie:
    """Words of one length as levels of nodes: a child's key is its parent's number and its count."""

    def __init__(self, words, numbers, groups) -> None:
        import numpy as np

        counts = group_counts(words, groups)
        order = np.lexsort(counts.T[::-1])
        self.words, self.numbers, counts = words[order], numbers[order], counts[order]
        node = np.zeros(len(words), np.int64)
        self.levels, self.base = [], words.shape[1] + 2
        for j in range(counts.shape[1]):
            keys, node = np.unique(node * self.base + counts[:, j], return_inverse=True)
            self.levels.append(keys)
        self.starts = np.searchsorted(node, np.arange(node[-1] + 2))

    def search(self, counts, left_over, missing) -> Iterator[tuple]:
        """(searching word, place among ``words``) of all that the surplus and deficit left reach."""
        import numpy as np

        n = len(counts)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), left_over, missing)]
        while stack:
            level, who, node, plus, minus = stack.pop()
            if not len(who):
                continue
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(level, *(x[part] for x in (who, node, plus, minus))) for part in (slice(half, None), slice(None, half))]
                continue
            if level == len(self.levels):
                yield from self._leaves(who, node)
                continue
            keys, own = self.levels[level], node * self.base + counts[who, level]
            found = []
            for step, allowed in ((0, None), (1, plus > 0), (-1, minus > 0)):
                some = np.arange(len(who)) if allowed is None else np.flatnonzero(allowed)
                want = own[some] + step
                some, want = (some, want) if step >= 0 else (some[counts[who[some], level] > 0], want[counts[who[some], level] > 0])
                at = np.searchsorted(keys, want)
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == want)
                some = some[hit]
                found.append((who[some], at[hit], plus[some] - (step == 1), minus[some] - (step == -1)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))

    def _leaves(self, who, node) -> Iterator[tuple]:
        import numpy as np

        sizes = self.starts[node + 1] - self.starts[node]
        ends = np.cumsum(sizes)
        at = 0
        most = max(1, VERIFIED // self.words.shape[1])
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            k = sizes[at:to]
            begin = np.repeat(self.starts[node[at:to]] - (np.cumsum(k) - k), k)
            yield np.repeat(who[at:to], k), begin + np.arange(int(k.sum()))
            at = to


def group_counts(words, groups):
    """Rows of the counts of each group; ``words`` is a matrix of code points."""
    import numpy as np

    of = groups[words]
    wide = int(groups.max()) + 1
    flat = (np.arange(len(words))[:, None] * wide + of).reshape(-1)
    return np.bincount(flat, minlength=len(words) * wide).reshape(len(words), wide)


def one_apart(short, long):
    """Which rows of two matrices of code points differ by exactly one replaced (same width) or inserted code point."""
    import numpy as np

    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    before = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= short.shape[1]


def _meeting(groups: list[int]):
    """mapInArrow function over rows (task, side, word, n, own, minus) sorted by task and side: the words of a part, then those that search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        of = np.array(groups)
        coded = lambda words: np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)

        def compared(trie: Trie, own, words, n, minus) -> Iterator[pa.RecordBatch]:
            short = coded(words)
            same = short.shape[1] == trie.words.shape[1]
            counts = group_counts(short, of)
            left, right = [], []
            for who, place in trie.search(counts, np.ones(len(counts), np.int64), minus):
                ok = one_apart(short[who], trie.words[place])
                who, place = who[ok], place[ok]
                if same:  # words of this very shard search it too: of the two ways each finds the other, one counts
                    once = (own[who] == 0) | (short[who].view(f"S{short.shape[1]}")[:, 0] < trie.words[place].view(f"S{short.shape[1]}")[:, 0])
                    who, place = who[once], place[once]
                left.append(who)
                right.append(place)
                if sum(map(len, left)) > FRONTIER:
                    yield told(trie, words, n, np.concatenate(left), np.concatenate(right))
                    left, right = [], []
            if any(map(len, left)):
                yield told(trie, words, n, np.concatenate(left), np.concatenate(right))

        def told(trie: Trie, words, n, who, place) -> pa.RecordBatch:
            """word, how many near words, the most frequent of them: of both sides of the pairs."""
            texts = [bytes(w).decode("latin-1") for w in trie.words]
            best: dict[str, list] = {}
            for q, p in zip(who.tolist(), place.tolist(), strict=True):
                a, b, na, nb = words[q], texts[p], n[q], int(trie.numbers[p])
                for word, other, m in ((a, b, nb), (b, a, na)):
                    if (x := best.get(word)) is None:
                        best[word] = [1, m, other]
                    else:
                        x[0] += 1
                        if m > x[1] or (m == x[1] and other < x[2]):
                            x[1], x[2] = m, other
            return pa.RecordBatch.from_arrays([pa.array(list(best)), *(pa.array([x[i] for x in best.values()]) for i in range(3))], names=["word", "n_near", "m", "other"])

        last, held, trie = None, [], None
        for batch in batches:
            tasks, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(tasks)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if tasks[s] != last:
                    last, held, trie = tasks[s], [], None
                part = batch.slice(s, e - s)
                words, n = part.column(2).to_pylist(), part.column(3).to_numpy()
                if not sides[s]:
                    held.append((words, n))
                    continue
                if not held and trie is None:
                    continue
                if trie is None:
                    trie, held = Trie(np.concatenate([coded(w) for w, _ in held]), np.concatenate([c for _, c in held]), of), []
                own = part.column(4).to_numpy()
                lengths = np.array([len(w) for w in words])
                for length in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == length)
                    yield from compared(trie, own[at], [words[i] for i in at], n[at].tolist(), part.column(5).to_numpy()[at])

    return run


def near_words(words: DataFrame, groups: list[int], first: int, part: int = PART) -> DataFrame:
    """(word, n_near, m, other): how many words are one code point away, the largest count among them and the first word that has it."""
    at = lambda i: "".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if groups[c] % (first + 1) == i)
    counts = [F.length("word") - F.length(F.translate("word", at(i), "")) for i in range(first)]
    rows = words.select("word", "n", F.length("word").alias("size"), F.array(*counts).alias("c")).withColumn("shard", F.struct("size", "c"))
    zero = F.array(*[F.lit(0)] * first)
    unit = lambda i, by: F.array(*[F.lit(by if i == j else 0) for j in range(first)])
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    plus = [unit(i, 1) for i in range(first)]
    minus = [unit(i, -1) for i in range(first)]
    swaps = [add(plus[i], minus[j]) for i in range(first) for j in range(first) if i < j]
    move = lambda by, less, longer, own: F.struct(by.alias("by"), F.lit(less).alias("minus"), F.lit(longer).alias("longer"), F.lit(own).alias("own"))
    # a replacement is looked for from one side: the word has less of an earlier group than what it looks for, or as much
    moves = [move(zero, 1, 0, 1), *[move(x, 1, 0, 0) for x in plus + swaps], move(zero, 0, 1, 0), *[move(x, 0, 1, 0) for x in plus]]
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).withColumn("parts", F.ceil(F.col("k") * (F.col("shard.size") + 64) / F.lit(part)).cast("int"))
    own = rows.join(sizes, "shard").select(F.xxhash64("shard", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).alias("task"), F.lit(0).alias("side"), "word", "n", F.lit(0).alias("own"), F.lit(0).cast("long").alias("minus"))
    going = rows.select("word", "n", "size", "c", F.explode(F.array(*moves)).alias("m")).select("word", "n", F.struct((F.col("size") + F.col("m.longer")).alias("size"), add(F.col("c"), F.col("m.by")).alias("c")).alias("shard"), "m.own", F.col("m.minus").cast("long").alias("minus"))
    going = going.filter(F.forall("shard.c", lambda x: x >= 0)).join(sizes, "shard")
    going = going.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "*").select(F.xxhash64("shard", "p").alias("task"), F.lit(1).alias("side"), "word", "n", "own", "minus")
    found = own.unionAll(going).repartition("task").sortWithinPartitions("task", "side").mapInArrow(_meeting(groups), "word string, n_near long, m long, other string")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("m"), F.col("b.other").alias("other"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms of forms are followed, twice as far with each round."""
    now = staged(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = moved.drop("moved")
        now.staged_at = moved.staged_at
        if not moved.filter("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, part: int = PART, first: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    words = staged(count_words(docs, least_length, least_count), "words")
    n = words.count()
    groups = letter_groups(words)
    near = near_words(words, groups, first or address_length(n), part)
    likes = F.col("m") >= times * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likes, F.col("other")).alias("form"), F.when(likes, F.col("m")).alias("form_n"))
    formed = staged(formed, "formed")
    out = formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    discard(words)
    return out
