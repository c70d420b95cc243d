"""Token counts by prefix dynamic programming.

A tokenizer that splits at white space gives a text the sum of its words' tokens, so the count of
every prefix that ends at a word is the count of the prefix before it plus one word's count:
P[i] = P[i-1] + c(w_i), and that of a prefix which ends inside a word is P[i-1] plus the count of that
beginning of the word. Each distinct word, and each beginning of it, is encoded once per worker (a
bounded memo); the prefix counts then answer length, truncation and budget questions without
re-encoding. ``prefix_counts`` stores the count of every prefix of a text, ``prefix_tables`` only those
that end at words; ``longest_prefix``, ``tokens_before`` and ``tokens_of_prefix`` read them with plain
column functions.

The counts are those of the tokenizer library for the whole text, special strings included: a
special string holds no white space, so it never crosses a word.

Defined cases: a null text counts as empty (0 tokens); doc_id may be null or repeat; a word of any
length is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

LIMIT = 2048
MEMO_WORDS = 1_000_000
MEMO_CHARS = 64
_loaded: dict[str, WordCounts] = {}


class WordCounts:
    """Token count of each word, by the library, remembered up to MEMO_WORDS words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.encode = lambda words: [len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)]
        else:
            raise ValueError("prefix sums need a tokenizer that drops white space")
        self.memo: dict[str, int] = {}

    def of(self, words: list[str]) -> list[int]:
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = list(set(words))
            memo.update(zip(new, self.encode(new), strict=True))
        out = [memo[w] for w in words]
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out


#: White space to Python but not to the tokenizers' patterns.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def words_of(text: str) -> list[str]:
    if any(c in text for c in SEPARATORS):
        import regex

        return regex.findall(r"[^\t-\r \x85\xa0  -     　]+", text)
    return text.split()


def word_counts(path: str) -> WordCounts:
    if path not in _loaded:
        _loaded[path] = WordCounts(path)
    return _loaded[path]


def prefix_sums(counter: WordCounts, text: str):
    """The words of a text and the token count of each prefix that ends with one of them."""
    import numpy as np

    words = words_of(text)
    return words, np.cumsum(np.array(counter.of(words), np.int64))


def word_ends(text: str, words: list[str]) -> list[int]:
    ends, at = [], 0
    for w in words:
        at = text.index(w, at) + len(w)
        ends.append(at)
    return ends


COUNTS = "struct<n_tokens:bigint,fit_chars:bigint>"


def _count_udf(path: str, limit: int):
    @F.arrow_udf(COUNTS)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        counter = word_counts(path)
        for texts in batches:
            totals, fits = [], []
            for value in texts:
                text = value.as_py()
                words, sums = prefix_sums(counter, text)
                total = int(sums[-1]) if len(sums) else 0
                if total <= limit:
                    fit = len(text)
                else:
                    k = int(np.searchsorted(sums, limit, "right"))
                    fit = word_ends(text, words[:k])[-1] if k else 0
                totals.append(total)
                fits.append(fit)
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(fits, pa.int64())], names=["n_tokens", "fit_chars"])

    return counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars: code points of the longest prefix of whole words within the limit."""
    counted = docs.select("doc_id", text_of().alias("text")).withColumn("c", _count_udf(tokenizer, limit)("text"))
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("c.n_tokens").alias("n_tokens"), (F.col("c.n_tokens") > limit).alias("over_limit"), F.col("c.fit_chars").alias("fit_chars")
    )


def every_prefix(counter: WordCounts, text: str) -> list[int]:
    """Tokens of text[:1], text[:2], ... text: white space adds none, and a word's beginnings count as words of their own."""
    words = words_of(text)
    beginnings = counter.of([w[:k] for w in words for k in range(1, len(w) + 1)])
    out, before, at, used = [], 0, 0, 0
    for w in words:
        start = text.index(w, at)
        out.extend([before] * (start - at))
        out.extend(before + n for n in beginnings[used : used + len(w)])
        used += len(w)
        before, at = out[-1], start + len(w)
    out.extend([before] * (len(text) - at))
    return out


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and counts: the token count of every prefix, by code points, of each text."""

    @F.arrow_udf("array<int>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = word_counts(tokenizer)
        for texts in batches:
            yield pa.array([every_prefix(counter, t.as_py()) for t in texts], pa.list_(pa.int32()))

    return docs.select("doc_id", counts(text_of()).alias("counts"))


def tokens_of_prefix(end: Column) -> Column:
    """Tokens of the first ``end`` code points, from a stored table of prefix_counts."""
    return F.when(end <= 0, 0).otherwise(F.get("counts", F.least(end, F.size("counts")) - 1))


def prefix_tables(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ends and sums: the code point after each word, and the token count of the prefix up to there."""

    @F.arrow_udf("struct<ends:array<int>,sums:array<bigint>>")
    def tables(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = word_counts(tokenizer)
        for texts in batches:
            out = []
            for value in texts:
                text = value.as_py()
                words, sums = prefix_sums(counter, text)
                out.append({"ends": word_ends(text, words), "sums": sums.tolist()})
            yield pa.array(out, pa.struct([("ends", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))]))

    return docs.select("doc_id", tables(text_of()).alias("p")).select("doc_id", "p.ends", "p.sums")


def longest_prefix(budget: int) -> Column:
    """Code points of the longest prefix of whole words with at most ``budget`` tokens, from a stored table."""
    fitting = F.size(F.filter("sums", lambda s: s <= budget))
    return F.when(fitting == 0, 0).otherwise(F.get("ends", fitting - 1))


def tokens_before(end: Column) -> Column:
    """Tokens of the whole words that end at or before a code point, from a stored table."""
    whole = F.size(F.filter("ends", lambda e: e <= end))
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.get("sums", whole - 1))
