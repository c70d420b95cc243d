"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. Both hold the same ordinary text; after it, the toxic one has what zstandard's
trainer picks from toxic text, and the ordinary one as many bytes of filler. The trainer is shown the stems of words which toxic text has at
least RATIO times as often as ordinary text: without that contrast the trained dictionaries differ by common words, and far fewer toxic
documents are found. Every text is cut into windows of WINDOW words, and each window is compressed with either dictionary.
Shared content sits at equal distances in both, so the lengths differ only where toxic content matches. A window that has not LEAST_MATCH bytes
in common with the toxic dictionary cannot gain from it and counts as no difference.

What a difference of so many bytes means is calibrated on labelled documents whose texts had no part in the dictionaries: each difference has
the logarithm of how much more often toxic documents show it, and a logistic curve turns the sum and the mean over a document's windows into
a probability.

Fitting takes at most ROWS labelled documents of either class, drawn by hash of their ids; a quarter of their texts, by hash of the text,
calibrates, and of the others at most TRAINING windows of either class, drawn by hash of the window, reach the trainer. Scoring covers all
windows of all documents. Spark counts the stems of these windows; the driver gets the marked stems, those of each toxic window and
ORDINARY_BYTES of ordinary text.

Defined cases: null and empty texts have no window and get the score of no evidence; without labels
of both classes every score is 0; null labels are no labels; repeated rows score alike.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD_TABLE, crc_of_id, discard, staged, text_of

WINDOW = 4
ROWS = 3000
#: Windows whose stems are one sample for the trainer, as a document of usual length has them.
SAMPLE = 16
#: Words of a window for the trainer, and how many windows of a class it may have.
SPAN, TRAINING = 32, 40_000
ORDINARY_BYTES = 512 << 10
TOXIC_BYTES = 8 << 10
#: How many times as often as ordinary text toxic text has the stems that its dictionary is trained on, in how many
#: surroundings at least, and their number times the logarithm of how many times as often.
RATIO = 8.0
LEAST_SEEN = 4
EVIDENCE = 32.0
#: Bytes of the longest stem.
LONGEST = 14
#: Bytes of a segment and of its parts, for the trainer of the toxic dictionary.
SEGMENT, PART = 40, 8
#: One document in so many of the drawn ones calibrates.
CALIBRATE = 4
LEVEL = 19
THRESHOLD = 0.7
#: Differences outside count as the ends.
LEAST, MOST = -3, 8
#: Matches shorter than this are not looked for, so a segment must have as many bytes.
LEAST_MATCH = 6
#: Starts every window and stands in both dictionaries: a window then never falls back to being stored raw.
CARRIER = bytes(range(1, 9)) * 2 + bytes(range(14, 31)) * 2


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    #: What the toxic dictionary has besides the ordinary text.
    added: bytes
    #: Of each difference from LEAST to MOST the logarithm of how much more often toxic documents show it.
    ratios: tuple[float, ...]
    weights: tuple[float, ...]


def windows_of(text: bytes) -> list[bytes]:
    words = text.translate(WORD_TABLE).split()
    return [b" ".join([CARRIER, *words[i : i + WINDOW], b""]) for i in range(0, len(words), WINDOW)]


class Compressors:
    """Compressed lengths of windows with the two dictionaries."""

    def __init__(self, model: ToxicityModel) -> None:
        import zstandard as z

        def made(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS, window_log=20, strategy=z.STRATEGY_BTOPT, min_match=LEAST_MATCH, target_length=64, search_log=5, hash_log=18, chain_log=18)
            d.precompute_compress(compression_params=p)
            return z.ZstdCompressor(dict_data=d, compression_params=p).compress

        self.ordinary, self.toxic = made(model.ordinary), made(model.toxic)
        added = model.added + CARRIER
        self.shared = {added[i : i + LEAST_MATCH] for i in range(len(model.added))}

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves against the ordinary one."""
        own = window[len(CARRIER) :]
        if self.shared.isdisjoint([own[i : i + LEAST_MATCH] for i in range(len(own) - LEAST_MATCH + 1)]):
            return 0
        return len(self.ordinary(window)) - len(self.toxic(window))

    def differences(self, text: bytes) -> list[int]:
        """How many windows save LEAST to MOST bytes."""
        out = [0] * (MOST - LEAST + 1)
        for w in windows_of(text):
            out[min(MOST, max(LEAST, self.saved(w))) - LEAST] += 1
        return out


def evidence(ratios: tuple[float, ...], counts: list[int]) -> tuple[float, float, float]:
    """The summed ratios over the root of the number of windows, over that number, and by themselves."""
    n, total = sum(counts), math.fsum(c * r for c, r in zip(counts, ratios, strict=True))
    return (total / math.sqrt(n), 10 * total / n, max(-5.0, min(5.0, total / 3))) if n else (0.0, 0.0, 0.0)


def _score(model: ToxicityModel, counts: list[int]) -> float:
    z = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], evidence(model.ratios, counts), strict=True))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def calibrated(rows: list[tuple[list[int], int]]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Ratios and weights from the differences and labels of documents. A document counts by the root of its windows, so no long one rules."""
    shares = {0: [0.0] * (MOST - LEAST + 1), 1: [0.0] * (MOST - LEAST + 1)}
    for counts, toxic in rows:
        if n := sum(counts):
            shares[toxic] = [x + c / math.sqrt(n) for x, c in zip(shares[toxic], counts, strict=True)]
    total = {y: sum(v) or 1.0 for y, v in shares.items()}
    pooled = [(a / total[0] + b / total[1]) / 2 for a, b in zip(shares[0], shares[1], strict=True)]
    prior = max(1.0, 0.02 * min(total.values()))
    part = lambda y: [(x + prior * q + 1e-6) / (total[y] + prior) for x, q in zip(shares[y], pooled, strict=True)]
    ratios = tuple(math.log(b / a) for a, b in zip(part(0), part(1), strict=True))
    return ratios, _logistic([(evidence(ratios, counts), toxic) for counts, toxic in rows])


def _spread(texts: list[bytes]) -> tuple[Counter, int]:
    """In how many different surroundings (word before, word after) each stem stands, and all surroundings.

    So a passage that many near copies share counts once.
    """
    import numpy as np

    number: dict[bytes, int] = {}
    places, around = array("q"), array("q")  # not a set of pairs, which takes ten times the driver's memory
    for t in texts:
        words = [b"", *t.translate(WORD_TABLE).split(), b""]
        places.extend(number.setdefault(w, len(number)) for w in words[1:-1])
        around.extend(map(hash, zip(words, words[2:], strict=False)))
    seen = np.unique(np.array([places, around], np.int64), axis=1)
    counts = np.bincount(seen[0], minlength=len(number)).tolist()
    out: Counter = Counter()
    for w, c in zip(number, counts, strict=True):
        for stem in _stems(w):
            out[stem] += c
    return out, seen.shape[1]


def _stems(word: bytes) -> list[bytes]:
    """The word's beginnings that a match can stand for, the space before it included."""
    word = b" " + word + b" "
    return [word[:k] for k in range(LEAST_MATCH, min(len(word), LONGEST) + 1)]


def _contrasts(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The marked stems of every toxic text."""
    (a, n), (b, m) = _spread(toxic), _spread(ordinary)
    if not n or not m:
        return []
    odds = {s: (c / n) / ((b[s] + 0.5) / m) for s, c in a.items() if c >= LEAST_SEEN}
    marks = _marks({s for s, o in odds.items() if o >= RATIO and a[s] * math.log(o) >= EVIDENCE})
    return [s for t in toxic if (s := marks(t))]


def _marks(marked: set[bytes]):
    """Function: text -> of each word the longest of its stems that is marked, one after the other."""
    of = lru_cache(1 << 16)(lambda word: next((s for s in reversed(_stems(word)) if s in marked), b""))
    return lambda text: b"".join(map(of, text.translate(WORD_TABLE).split()))


def _trained(size: int, samples: list[bytes], **how) -> bytes:
    """What zstandard's trainer picks from samples, or their end where they are too few for it."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, level=3, **how).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def _filler(n: int) -> bytes:
    """Bytes that no UTF-8 text has, in a fixed irregular order, so that they match nothing and crowd no hash row."""
    import random

    return bytes(random.Random(1).choices(range(0xF8, 0x100), k=n))


def _logistic(rows: list[tuple[tuple[float, ...], int]]) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    import numpy as np

    x = np.array([(1.0, *f) for f, _ in rows])
    y = np.array([float(t) for _, t in rows])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.02] * (x.shape[1] - 1)]) * len(y) * 0.01
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out(name: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(name), F.lit(3)) == 1


def draw_labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``rows`` documents of either label that are not held out, drawn by a hash of the id.

    Identifiers are drawn from all documents; no text moves.
    """
    there = docs.filter(~held_out() & (F.octet_length(text_of()) > 0)).select("doc_id")
    marked = there.join(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)), "doc_id").distinct()
    chosen = [marked.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit("draw"), F.col("doc_id")), "doc_id").limit(rows) for y in (0, 1)]
    return staged(chosen[0].union(chosen[1]), "toxic-drawn")


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """The ordinary and the toxic dictionary, and what is in the toxic one alone, from windows of either class held as lists."""
    return _assembled(_contrasts(toxic, ordinary), b" ".join(b" ".join(w.translate(WORD_TABLE).split()) for w in ordinary))


def _assembled(found: list[bytes], ordinary: bytes) -> tuple[bytes, bytes, bytes]:
    """The dictionaries from the marked stems of toxic windows and from ordinary text."""
    content = ordinary[-ORDINARY_BYTES:] or b" "
    samples = [b"".join(found[i : i + SAMPLE]) + b" " for i in range(0, len(found), SAMPLE)]
    more = _trained(TOXIC_BYTES, samples, k=SEGMENT, d=PART)
    return content + _filler(len(more)) + CARRIER, content + more + CARRIER, more


def _drawn_windows(spans: DataFrame) -> DataFrame:
    """(toxic, w) of at most TRAINING windows of either class, drawn by a hash of the window."""
    first = [spans.filter(F.col("toxic") == y).orderBy(F.xxhash64("w"), "w").limit(TRAINING) for y in (0, 1)]
    return first[0].union(first[1]).repartition(16, "w")


def _stem_counts(windows: DataFrame) -> DataFrame:
    """stem, a, b: in how many different surroundings (word before, word after) it stands in toxic and in ordinary windows; the empty stem has all."""
    none = F.lit(b"")
    padded = windows.select("toxic", F.concat(F.array(none), words_udf()("w"), F.array(none)).alias("p"))
    place = F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda i: F.struct(F.get("p", i).alias("word"), F.xxhash64(F.get("p", i - 1), F.get("p", i + 1)).alias("around")))
    places = padded.select("toxic", F.explode(place).alias("at")).select("toxic", "at.word", "at.around").distinct()
    words = places.groupBy("toxic", "word").count()
    length = F.least(F.octet_length("word") + 2, F.lit(LONGEST))
    spaced = F.concat(F.lit(b" "), F.col("word"), F.lit(b" "))
    stems = F.when(length >= LEAST_MATCH, F.transform(F.sequence(F.lit(LEAST_MATCH), F.greatest(length, F.lit(LEAST_MATCH))), lambda k: F.substring(spaced, 1, k))).otherwise(F.array().cast("array<binary>"))
    of = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("count")).otherwise(0))
    return words.select("toxic", "count", F.explode(F.concat(F.array(none), stems)).alias("stem")).groupBy("stem").agg(of(1).alias("a"), of(0).alias("b"))


def _marked_stems(counts: DataFrame) -> set[bytes]:
    """The stems that toxic windows have far more often."""
    total = counts.filter((F.col("stem") == F.lit(b"")) & (F.col("a") > 0) & (F.col("b") > 0)).select(F.col("a").alias("n"), F.col("b").alias("m"))
    seen = counts.filter((F.col("stem") != F.lit(b"")) & (F.col("a") >= LEAST_SEEN)).crossJoin(F.broadcast(total))
    odds = seen.withColumn("odds", (F.col("a") / F.col("n")) / ((F.col("b") + F.lit(0.5)) / F.col("m")))
    return {bytes(r[0]) for r in odds.filter((F.col("odds") >= RATIO) & (F.col("a") * F.log("odds") >= EVIDENCE)).select("stem").collect()}


def _last_bytes(windows: DataFrame, size: int) -> bytes:
    """The end of the windows in their order, ``size`` bytes of it."""
    n = max(1, size >> 7)
    while True:
        last = [bytes(r[0]) for r in windows.orderBy(F.desc(F.xxhash64("w")), F.desc("w")).limit(n).select("w").collect()]
        text = b" ".join(reversed(last))
        if len(last) < n or len(text) >= size:
            return text[-size:]
        n *= 2


def sample_dictionaries(spans: DataFrame) -> tuple[bytes, bytes, bytes]:
    """What ``dictionaries`` gives for the drawn windows of (toxic, w). No list of windows reaches the driver."""
    windows = staged(_drawn_windows(spans), "toxic-windows")
    counts = staged(_stem_counts(windows), "toxic-stems")
    marked = _marked_stems(counts)
    found = windows.filter("toxic = 1").select("w", marks_udf(marked)("w").alias("s")).filter(F.octet_length("s") > 0).orderBy(F.xxhash64("w"), "w").select("s")
    out = _assembled([bytes(r[0]) for r in found.collect()] if marked else [], _last_bytes(windows.filter("toxic = 0"), ORDINARY_BYTES))
    discard(windows, counts)
    return out


def spans_udf():
    """Column function: binary text -> its windows of SPAN words."""

    @F.arrow_udf("array<binary>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            words = (t.as_py().translate(WORD_TABLE).split() for t in texts)
            yield pa.array([[b" ".join(w[i : i + SPAN]) for i in range(0, len(w), SPAN)] for w in words], pa.list_(pa.binary()))

    return spans


def words_udf():
    """Column function: binary window -> its words."""

    @F.arrow_udf("array<binary>")
    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for windows in batches:
            yield pa.array([w.as_py().split() for w in windows], pa.list_(pa.binary()))

    return words


def marks_udf(marked: set[bytes]):
    """Column function: binary window -> the marked stems of its words."""

    @F.arrow_udf("binary")
    def marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = _marks(marked)
        for windows in batches:
            yield pa.array([of(w.as_py()) for w in windows], pa.binary())

    return marks


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents that may be learned from."""
    drawn = draw_labelled(docs, labels, rows)
    texts = docs.select("doc_id", text_of().cast("binary").alias("text")).join(F.broadcast(drawn), "doc_id").select("toxic", "text")
    calibrates = F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(CALIBRATE)) == 0
    spans = texts.filter(~calibrates).select("toxic", F.explode(spans_udf()("text")).alias("w")).distinct()
    ordinary, toxic, added = sample_dictionaries(spans)
    fresh = ToxicityModel(ordinary, toxic, added, (), ())
    measured = texts.select("toxic", calibrates.alias("calibrates"), F.xxhash64("text").alias("h"), differences_udf(fresh)("text").alias("x")).dropDuplicates(["toxic", "h"])
    found = sorted((r[1], r[2], r[0], list(r[3])) for r in measured.select("toxic", "calibrates", "h", "x").collect())
    discard(drawn)
    for chosen in ([f for f in found if f[0]], found):
        points = [(x, y) for _, _, y, x in chosen]
        if {y for _, y in points} == {0, 1}:
            return ToxicityModel(ordinary, toxic, added, *calibrated(points))
    return ToxicityModel(b" ", b" ", b"", (0.0,) * (MOST - LEAST + 1), (-30.0, 0.0, 0.0, 0.0))


def differences_udf(model: ToxicityModel):
    """Column function: binary text -> how many windows save LEAST to MOST bytes."""

    @F.arrow_udf("array<long>")
    def differences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measure = Compressors(model).differences
        for texts in batches:
            yield pa.array([measure(t.as_py()) for t in texts], pa.list_(pa.int64()))

    return differences


def score_udf(model: ToxicityModel):
    """Column function: binary text -> score. The model is two dictionaries of at most ORDINARY_BYTES + TOXIC_BYTES."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measure = Compressors(model).differences
        for texts in batches:
            yield pa.array([_score(model, measure(t.as_py())) for t in texts], pa.float64())

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_udf(model)(text_of().cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
