"""Operators against brute-force versions, on odd small inputs and on the smallest tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import mixing, near_copies, ppm, queries, simhash, token_counts, toxicity, warc
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import RadixTrie, exact_dedup
from tidemark.llm.html_text import Page, alignment, extract_text
from tidemark.llm.line_dedup import dedup_lines, line_bitmaps

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h1 string, line string, s string, row string, found string, mix_slot string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SP = " \t\n\x0b\x0c\r"

ODD = [
    (1, "Alpha beta gamma delta\nshared line\n  SHARED line \n\nomega", "en", "a"),
    (2, "Alpha beta gamma delta\nshared line\nother", None, None),
    (3, None, "en", "a"),
    (4, "", "en", None),
    (5, " \t\n", "en", "b"),
    (6, "Éclair ÉCLAIR <|endoftext|> it's 42nd \x1c x<|endoftext|>y", "fr", "b"),
    (None, "Alpha  beta gamma delta\nshared line\nother", "en", "a"),
    (None, None, None, None),
    (7, "one two three four five six seven eight nine ten eleven", "en", "b"),
    (8, "zero ONE two three four five six seven eight nine ten, twelve", "en", "b"),
    (9, "word " * 3000 + "tail", "en", "c"),
    (9, "word " * 3000 + "tail", "en", "c"),
    (10, "one two three four five six seven eight nine ten eleven", "en", "b"),
    (11, "x" * 30000, "en", "c"),
]


def rows_of(odd=ODD):
    return [(*r, len(r[1] or ""), "k", "k", "k", "k", "k", "k", "k") for r in odd]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(spark, odd, none, first):
    docs = sorted({(r[0], r[1] or "") for r in ODD}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    where = defaultdict(list)
    for d in docs:
        for p, line in enumerate(d[1].split("\n")):
            if k := line.strip(SP).translate(LOWER):
                where[k].append((d, p))
    gone = {x for v in where.values() if len({d for d, _ in v}) >= 2 for x in (v[1:] if first else v)}
    have = dedup_lines(odd, min_docs=2, keep_first=first).select("doc_id", "n_lines", "n_dropped", "kept_text")
    if first:
        assert sum(r.n_dropped for r in have.dropDuplicates().collect()) == len(gone)
        return
    want = Counter()
    for r in ODD:
        lines = (r[1] or "").split("\n")
        kept = [x for p, x in enumerate(lines) if ((r[0], r[1] or ""), p) not in gone]
        want[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert got(have) == want
    assert dedup_lines(none).collect() == [] and line_bitmaps(none).collect() == []


def test_line_dedup_hot_keys(spark):
    rows = [(i, f"own {i}\nHot line\nwarm {i % 3}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    have = dedup_lines(docs, min_docs=10).collect()
    assert {(r.n_lines, r.n_dropped, r.kept_text == f"own {r.doc_id}") for r in have} == {(3, 2, True)}
    assert sum(r.n_dropped for r in dedup_lines(docs, min_docs=10, keep_first=True).collect()) == 8000 - 4


def test_exact_dedup(odd, none):
    groups = defaultdict(list)
    for r in ODD:
        groups[re.sub(f"[{SP}]+", " ", r[1] or "")].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        own = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, own, len(ids), i == own, hashlib.sha256(t.encode()).hexdigest()] += 1
    for budget in (48 << 20, 1000):
        assert got(exact_dedup(odd, budget)) == want
    assert exact_dedup(none).collect() == []


def test_radix_trie():
    trie, words = RadixTrie(), [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ab", b"abcabcabc", b"a"]
    for i, w in enumerate(words):
        trie.insert(w, (len(w), 0), i, 1)
    assert {t: (e[1], e[2]) for t, e in trie.drain()} == {w: (words.index(w), words.count(w)) for w in words}


def test_token_counts(odd, none, small, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    n = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), n(r[1] or ""), n(r[1] or "") > 2048) for r in ODD)
    assert got(token_counts.token_counts(odd, path).drop("fit_chars")) == want
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in small], "doc_id long, text string")
    have = token_counts.token_counts(docs, path, 100).collect()
    text = {r.doc_id: r.text for r in small}
    assert all(r.n_tokens == n(text[r.doc_id]) for r in have)
    for r in have[:60]:
        assert n(text[r.doc_id][: r.fit_chars]) <= 100
        following = re.match(r"\s*\S+", text[r.doc_id][r.fit_chars :])
        assert not following or not r.over_limit or n(text[r.doc_id][: r.fit_chars + following.end()]) > 100
    tables = token_counts.prefix_tables(docs, path).select("doc_id", token_counts.longest_prefix(100).alias("fit"), token_counts.tokens_before(F.lit(50)).alias("n50"), "ends", "sums")
    fits = {r.doc_id: r.fit_chars for r in have if r.n_tokens > 100}
    for r in tables.collect():
        assert r.doc_id not in fits or r.fit == fits[r.doc_id]
        if r.doc_id < 40:
            assert all(n(text[r.doc_id][:e]) == s for e, s in list(zip(r.ends, r.sums))[::37])
    few = spark.createDataFrame([(r[0], (r[1] or "")[:70]) for r in ODD] + [(r.doc_id, r.text[:150]) for r in small[:40]], "doc_id long, text string")
    for r in token_counts.prefix_counts(few, path).join(few.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "counts", "text", token_counts.tokens_of_prefix(F.lit(9)).alias("nine")).collect():
        if len(r.counts) == len(r.text):
            assert r.counts == [n(r.text[:i]) for i in range(1, len(r.text) + 1)]
            assert r.nine == (n(r.text[:9]) if r.text else None)
    assert token_counts.token_counts(none, path).collect() == [] and token_counts.prefix_counts(none, path).collect() == []


def test_mixing(odd, none, spark):
    assert mixing.mix_sources(none).collect() == []
    have = mixing.mix_sources(odd, block=2).collect()
    assert Counter((r.doc_id, r.text) for r in have) == Counter((r[0], r[1]) for r in ODD)
    assert len({r.mix_position for r in have}) == len(ODD)
    docs = spark.createDataFrame([(i, str(i), "abc"[0 if i % 3 else 1 + (i // 3) % 2]) for i in range(3000)], "doc_id long, text string, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    mixed = mixing.mix_sources(docs, weights, block=4).orderBy("mix_position").collect()
    slots = sorted({(r.mix_slot, r.source) for r in mixed})
    assert len(slots) == len({s for s, _ in slots})
    seen, end = Counter(), min(max(s for s, x in slots if x == name) for name in "abc")
    for slot, name in slots:
        seen[name] += 1
        if slot < end:
            assert all(abs(seen[x] - weights[x] * (slot + 1)) < 1 for x in weights)


@pytest.mark.parametrize("parts", [[500, 300, 200], [1, 999], [1] * 1000, [334, 333, 333], [7, 13, 980]])
def test_pfair(parts):
    slots, period = mixing.pfair_period(parts), sum(parts)
    assert sorted(x for s in slots for x in s) == list(range(period))
    for p, s in zip(parts, slots):
        assert all(k * period // p <= x < -(-(k + 1) * period // p) for k, x in enumerate(s))
    assert sum(mixing.shares([float(p) for p in parts], 1000)) == 1000


def test_pfair_ranges():
    """A range that starts anywhere continues the schedule from slot 0, for weights of every kind."""
    import random

    rng = random.Random(3)
    for n in (1, 2, 3, 5, 12, 40):
        for _ in range(6):
            parts = mixing.exact_shares([rng.choice([1.0, 2.0, math.sqrt(rng.randrange(1, 10**5)), rng.random() / 50]) for _ in range(n)])
            whole = list(mixing.pfair_range(parts, 0, 700))
            for start in (1, 2, 3, 17, 250, *[rng.randrange(700) for _ in range(12)]):
                assert list(mixing.pfair_range(parts, start, 700)) == whole[start:]
    with pytest.raises(ValueError):
        mixing.exact_shares([1.0, 0.0])


def plain_schedule(weights, slots):
    """Earliest deadline first over all released blocks, slot by slot, with fractions."""
    from fractions import Fraction

    total = sum(Fraction(w) for w in weights)
    share, done, out = [Fraction(w) / total for w in weights], [0] * len(weights), []
    for slot in range(slots):
        ready = [(math.ceil((done[s] + 1) / w), -w, s) for s, w in enumerate(share) if math.floor(done[s] / w) <= slot]
        s = min(ready)[2]
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_mixing_against_a_plain_schedule(spark, odd):
    docs = spark.createDataFrame([(i, str(i), "abcd"[min(3, i % 7)]) for i in range(2000)], "doc_id long, text string, source string")
    weights = {"a": 0.1, "b": 1 / 3, "c": math.sqrt(2), "d": 2.0}
    names = sorted(weights)
    for block, cells in ((1, 256), (8, 3)):
        have = mixing.mix_sources(docs, weights, block=block, cells=cells, period=50).collect()
        plan = {x: slot for slot, x in enumerate(plain_schedule([weights[n] for n in names], 1 + max(r.mix_slot for r in have)))}
        assert all(r.mix_slot == plan[names.index(r.source), r.mix_block] for r in have)
        for n in names:  # blocks of a source are numbered without a gap and full but for the last
            blocks = Counter(r.mix_block for r in have if r.source == n)
            assert set(blocks) == set(range(len(blocks))) and all(c == block for k, c in blocks.items() if k < len(blocks) - 1)
    mixed = mixing.mix_sources(odd, {"a": 2.0}, block=1).collect()  # odd rows, a null source, sources without a weight
    assert Counter((r.doc_id, r.text, r.source) for r in mixed) == Counter((r[0], r[1], r[3]) for r in ODD)


def test_mixing_does_not_drift(spark):
    from fractions import Fraction

    docs = spark.createDataFrame([(i, str(i), "abc"[i % 3]) for i in range(12000)], "doc_id long, text string, source string")
    for weights in ({"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 1.0, "b": 0.7, "c": 0.01}):
        mixed = mixing.mix_sources(docs, weights, block=1).collect()
        total = sum(Fraction(w) for w in weights.values())
        seen, at = Counter(), {r.mix_slot: r.source for r in mixed}
        assert len(at) == len(mixed) == 12000
        end = min(max(r.mix_slot for r in mixed if r.source == x) for x in "abc")
        for slot in range(end):
            seen[at[slot]] += 1
            assert all(abs(seen[x] - Fraction(w) / total * (slot + 1)) < 1 for x, w in weights.items())


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], i, i + 1, i + 2, i + 3, 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_note long, mix_key long, mix_hash long, u0 long, mix_slot long")
    have = mixing.mix_sources(docs).collect()
    assert have[0].__fields__ == ["doc_id", "text", "source", "mix_note", "mix_key", "mix_hash", "u0", "mix_source_share", "mix_block", "mix_slot", "mix_position"]
    assert sorted(tuple(r)[:7] for r in have) == [r[:7] for r in rows] and len({r.mix_position for r in have}) == 20


def plain_differences(model, text):
    """Counts of windows cut by a regular expression, each that shares bytes with the toxic dictionary compressed by a compressor of its own."""
    import zstandard as z

    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    counts = [0] * (toxicity.MOST - toxicity.LEAST + 1)
    for i in range(0, len(words), toxicity.WINDOW):
        size, own = [], b" " + " ".join(words[i : i + toxicity.WINDOW]).encode() + b" "
        near = any(own[k : k + toxicity.LEAST_MATCH] in model.added for k in range(len(own) - toxicity.LEAST_MATCH + 1))
        for content in (model.ordinary, model.toxic) if near else ():
            p = z.ZstdCompressionParameters.from_level(toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS, window_log=20, strategy=z.STRATEGY_BTOPT, min_match=toxicity.LEAST_MATCH, target_length=64, search_log=5, hash_log=18, chain_log=18)
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            size.append(len(z.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity.CARRIER + own)))
        saved = size[0] - size[1] if near else 0
        counts[min(toxicity.MOST, max(toxicity.LEAST, saved)) - toxicity.LEAST] += 1
    return counts


def test_toxic_dictionary_is_trained_on_toxic_text():
    """The trainer's picks stand in toxic text and hold its words; both dictionaries are of one length."""
    import random

    rng = random.Random(2)
    ordinary_words = ["plain%d" % i for i in range(300)]
    text = lambda extra: " ".join(rng.choice(extra) if extra and rng.random() < 0.1 else rng.choice(ordinary_words) for _ in range(120)).encode()
    toxic, ordinary = [text(["vilest", "rotten", "wretched"]) for _ in range(200)], [text([]) for _ in range(200)]
    a, b, added = toxicity.dictionaries(toxic, ordinary)
    assert len(a) == len(b) and added in b and all(w in b and w not in a for w in (b"vilest", b"rotten", b"wretched"))
    measure = toxicity.Compressors(toxicity.ToxicityModel(a, b, added, (), ())).differences
    above = lambda t, least: sum(measure(t)[least - toxicity.LEAST :])
    assert all(above(t, 1) for t in toxic if re.search(b"vilest|rotten|wretched", t)) and not any(above(t, 3) for t in ordinary)


def test_toxic_dictionaries_by_spark_as_from_lists(spark, monkeypatch):
    """Stems counted by Spark give what the plain counts over lists give: cut classes, words of other scripts, ordinary windows of one letter, an empty class."""
    import random

    monkeypatch.setattr(toxicity, "TRAINING", 150)
    monkeypatch.setattr(toxicity, "ORDINARY_BYTES", 2000)
    rng = random.Random(3)
    plain, vile = ["plain%d" % i for i in range(60)] + ["a", "of", "über", "naïveté"], ["vilest", "rottenly", "gräßlichst", "wretchednessbeyond"]
    window = lambda extra, n: " ".join(rng.choice(extra) if extra and rng.random() < 0.2 else rng.choice(plain) for _ in range(n)).encode()
    rows = [(1, window(vile, 32)) for _ in range(200)] + [(0, window([], 32)) for _ in range(100)] + [(0, bytes([c])) for c in range(ord("a"), ord("z"))] + [(0, b"\xff\xfe \xff torn"), (1, b"\xfe torn \xff"), (1, b"x")]
    for kept in (rows, [r for r in rows if r[0]], [r for r in rows if not r[0]], []):
        spans = spark.createDataFrame(kept, "toxic int, w binary").distinct()
        lists = [[bytes(r.w) for r in spans.filter(F.col("toxic") == y).orderBy(F.xxhash64("w"), "w").limit(150).collect()] for y in (1, 0)]
        found = toxicity.sample_dictionaries(spans)
        assert found == toxicity.dictionaries(*lists)
        assert (b"vilest" in found[2]) == (kept is rows)


def test_toxicity_training_leaves_windows_to_spark(spark):
    """The driver's Python stays small however many different words the drawn windows have."""
    import tracemalloc

    docs = spark.range(1200).selectExpr("id doc_id", "array_join(transform(sequence(1, 320), i -> concat('w', hex(xxhash64(id, i)))), ' ') text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    tracemalloc.start()
    try:
        toxicity.train_toxicity(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6, peak


@pytest.mark.parametrize("size, found, flagged", [("0.01", 0.6, 0.02), ("0.1", 0.5, 0.015)])
def test_toxicity(spark, sf, odd, none, size, found, flagged):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', size)}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored.values())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i].held_out for i in held)
    toxic = [i for i in held if truth[i]]
    assert sum(scored[i].predicted for i in toxic) >= found * len(toxic)
    assert sum(scored[i].predicted for i in held if not truth[i]) <= flagged * len(held)
    if size != "0.01":
        return
    assert len(toxicity.score_toxicity(odd, model).collect()) == len(ODD) and toxicity.score_toxicity(none, model).collect() == []
    whole = lambda t: toxicity._score(model, plain_differences(model, t))
    for r in docs.filter("doc_id % 50 = 0").collect() + docs.orderBy(F.desc(F.length("text"))).limit(3).collect():
        assert scored[r.doc_id].score == pytest.approx(whole(r.text or ""), abs=1e-12)
    untaught = toxicity.train_toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_toxicity(odd, untaught).collect()} == {0}


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_warc(spark, chunk):
    long = "<p>é" * 100
    rows = [(1, "http://a/x y", long, "z"), (2, None, long, "z"), (None, "u", long, "z"), (3, "u", None, "z"), (4, "u", "", "z"), (5, "u", "short", "z"), (6, "u", "short", "z"), (7, "u\r\nX: y", "line\r\n\r\nWARC/1.1\r\n" * 30, "z"), (2, None, long, "z"), (8, "u", "b" * 100_000, "z")]
    have = got(warc.archive_round_trip(pages_of(spark, rows).repartition(3), chunk))
    want = Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        own = min(j for j, _, g, _ in rows if g == h and j is not None)
        revisit = len(b) >= 100 and i != own
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", own if revisit else None] += 1
    assert have == want
    assert warc.archive_round_trip(pages_of(spark, [])).collect() == []


def test_warc_finds_damage(spark):
    rows = [(1, "u", "abc" * 100, "z")]
    path = queries.table.__globals__["archive_round_trip"].__globals__["fresh_path"](spark, "damaged")
    broken = warc.chunk_table(warc.typed_records(pages_of(spark, rows)), 100).filter("chunk_no <> 2")
    warc.write_archives(broken, path, "t0")
    with pytest.raises(Exception, match="segment"):
        warc.read_records(warc.read_archives(spark, path, "t0")).collect()


def words8(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute8(docs, items):
    out = Counter()
    for i, t in docs:
        w, hit, own = words8(t), set(), set()
        for item, text in items:
            v = words8(text)
            for s in range(max(1, len(v) - 9)) if v else ():
                window = v[s : s + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        if item is not None:
                            own.add(item)
        ids = ",".join(sorted(map(str, own)))
        out[i, len(w), len(hit), len(own), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_decontaminate(spark, odd, none, small, sf, block_words):
    items = [(1, "One two; three four five six seven eight nine TEN eleven"), (20, "éclair"), (3, None), (4, ""), (5, "two three"), (6, "word word word"), (None, "tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate(odd, bench, block_words=block_words).drop("hit_runs")) == brute8([(r[0], r[1]) for r in ODD], items)
    assert decontaminate(none, bench).collect() == []
    assert {r.contaminated for r in decontaminate(odd, bench.limit(0)).collect()} == {False}


def test_decontaminate_query(spark, sf, small):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(queries.op8_decontaminate(spark, sf)) == brute8([(r.doc_id, r.text) for r in small], items)


def brute9(docs, k, radius):
    prints = []
    for _, t in docs:
        w = re.findall(f"[^{SP}]+", (t or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i][0])
    return Counter((docs[i][0], f"{prints[i]:016x}", min((x for x in groups[root(i)] if x is not None), default=None)) for i in range(len(docs)))


@pytest.mark.parametrize("bucket", [16_384, 2])
def test_simhash(odd, none, bucket):
    assert got(simhash.near_dedup(odd, bucket=bucket)) == brute9([(r[0], r[1]) for r in ODD], 4, 4)
    assert simhash.near_dedup(none).collect() == []


def test_simhash_query(spark, sf, small):
    assert got(queries.op9_simhash(spark, sf)) == brute9([(r.doc_id, r.text) for r in small], 4, 4)


@pytest.mark.parametrize(("radius", "bucket", "agree"), [(4, 16_384, 1), (4, 30, 2), (4, 16_384, 3), (7, 50, 2), (12, 64, 1)])
def test_simhash_links_are_exact(spark, radius, bucket, agree):
    import random

    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 2))))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    have = {r.fp: r.component_id for r in simhash.component_ids(frame, radius, bucket, agree).collect()}
    parent = list(range(len(signed)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(signed)):
        for j in range(i):
            if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert [have[x] for x in signed] == [root(i) for i in range(len(signed))]


def test_components_of_a_hub_and_a_path(spark):
    """A hub that holds most edges is salted; a long path takes several rounds."""
    hub = [(0, i) for i in range(1, 6000)]
    path = [(i, i + 1) for i in range(10_000, 10_300)]
    rest = [(i, i + 1) for i in range(20_000, 24_000, 2)]
    have = {r.node: r.root for r in simhash.components(spark.createDataFrame(hub + path + rest, "a long, b long")).collect()}
    want = dict.fromkeys(range(6000), 0) | dict.fromkeys(range(10_000, 10_301), 10_000) | {j: i for i in range(20_000, 24_000, 2) for j in (i, i + 1)}
    assert have == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_keys_salted(spark):
    from tidemark.llm.shared import with_hot_keys_salted

    left = [(0 if i % 3 else i, i) for i in range(9000)]
    right = [(i, str(i)) for i in range(0, 9000, 2)]
    a, b = spark.createDataFrame(left, "k long, x long"), spark.createDataFrame(right, "k long, y string")
    for how in ("inner", "left"):
        assert got(with_hot_keys_salted(a, b, "k", 9000, how)) == got(a.join(b, "k", how))


def test_ppm_base_scores(spark, odd, none):
    for frequent in (1 << 17, 3):
        have = ppm.score_documents(odd, frequent=frequent).collect()
        crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        words = lambda t: re.findall(f"[^{SP}]+", (t or "").translate(LOWER)) + ["END"]
        c = Counter(w for r in ODD if not crc(r[0]) for w in words(r[1]))
        n, v = sum(c.values()), len(c)
        want = Counter((r[0], crc(r[0]), len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1])), 6)) for r in ODD)
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in have) == want
        assert all(r.score < 0 for r in have)
    assert ppm.score_documents(none).collect() == []
    untaught = ppm.score_documents(odd, training=F.lit(False)).collect()
    assert {r.train_tokens for r in untaught} == {0}
    assert all(abs(r.score + math.log10(256) * (len((o[1] or "").encode()) + 1)) < 1e-6 for o in ODD[:3] for r in untaught if r.doc_id == o[0])


def brute_ppm(train, text, order):
    return brute_ppm_all(train, [text], order)[0]


def brute_ppm_all(train, texts, order):
    pad = b"\xfe" * order
    counts = defaultdict(Counter)
    for t in train:
        s = pad + t + b"\xff"
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    return [brute_ppm_score(counts, t, order) for t in texts]


def brute_ppm_score(counts, text, order):
    total, s = 0.0, b"\xfe" * order + text + b"\xff"
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            seen = counts.get(s[i - k : i])
            if seen is None:
                continue
            left = {x: c for x, c in seen.items() if x not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / whole)
                break
            total += math.log10(len(left) / whole)
            out |= set(left)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_ppm_model(spark, odd):
    texts = [(r[1] or "")[:400].translate(LOWER).encode() for r in ODD]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    train = [t for i, t in enumerate(texts) if i % 2]
    for sizes in ({}, {"chunk": 500, "shard": 300, "piece": 64}):  # one chunk and few shards, or many, with texts cut in pieces
        have = {r.doc_id: r.score for r in ppm.score_documents(docs, training=F.col("doc_id") % 2 == 1, **sizes).collect()}
        assert len(have) == len(texts)
        for i, t in enumerate(texts):
            assert have[i] == pytest.approx(brute_ppm(train, t, ppm.ORDER), abs=1e-6)


def test_ppm_on_the_tables(spark, sf, small):
    """Every text of the smallest tables by a plain count over all training texts, with many chunks and shards."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = [r.text.translate(LOWER).encode() for r in small if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    have = {r.doc_id: r.score for r in ppm.score_documents(docs.repartition(3), chunk=100_000, shard=50_000).collect()}
    texts = [(r.doc_id, r.text.translate(LOWER).encode()) for r in small if len(r.text) < 2000][::5]
    for (i, _), want in zip(texts, brute_ppm_all(learned, [t for _, t in texts], ppm.ORDER)):
        assert have[i] == pytest.approx(want, abs=1e-6)


def test_html_articles(spark, sf):
    for r in queries.op2_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split("</?(?:p|h1)>", article)
        want = " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split())))
        assert r.text == want and r.n_chars == len(want)


def test_html_wrapper(spark):
    page = lambda i: f"<html><body><div class=top>Site name<ul><li>Home<li>About</ul></div><div class='box x{i % 2}'><p>Story {i}&nbsp;tells &lt;b&gt;</p><p>more <i>of</i> {i}</div><div>All rights reserved</div><div id=comments><p>me too {i}</div></body></html>"
    rows = [(i, "http://h.example/x", page(i), "z") for i in range(8)]
    rows += [(100, "http://solo.example/", "<div>Lone <script>var x='<p>';</script>text<!-- no --><br>here</div><form>q</form>", "z"), (101, None, None, "z"), (None, "bad", "", "z"), (102, "http://solo.example/", "plain &amp; text", "z")]
    rows += [(200 + i, "http://art.example/", f"<nav>n{i}</nav><main><header><h1>T{i}</h1></header><p>Same line</p><aside>x</aside><section class=comments>c</section></main>", "z") for i in range(6)]
    have = {r.page_id: r.text for r in extract_text(pages_of(spark, rows)).collect()}
    assert all(have[i] == f"Story {i} tells <b> more of {i}" for i in range(8))
    assert have[100] == "Lone text here" and have[101] == "" and have[None] == "" and have[102] == "plain & text"
    assert all(have[200 + i] == f"T{i} Same line" for i in range(6))
    assert extract_text(pages_of(spark, [])).collect() == []


def odd_pages():
    head = "<html><body><nav><a href=/>Home</a></nav>"
    article = "<article><div class='entry-header'><h1>Title {i}</h1></div><p>x {i}</p><p class='tags'>y</p><math>a+b</math><p>See <object>alt</object> z</p><div class='comments'>me too</div><form>send</form></article>"
    rows = [(i, "http://marked.example/a", head + article.format(i=i) + "<footer>f</footer></body></html>", "z") for i in range(6)]
    # no mark, an advert that varies and bears no name, a notice that is the same on every page
    plain = "<html><body><div><ul><li><a href=/a>Menu {i}</a><li><a href=/b>More {i}</a></ul></div><div id=x1><div>Same on all</div><h2>Head {i}</h2><div><p>Story {i} is long enough to be told.</p><p>It goes on, {i}.</p></div></div><div>Made by us</div></body></html>"
    rows += [(100 + i, "http://plain.example/a", plain.format(i=i), "z") for i in range(6)]
    rows += [(105, "http://plain.example/a", plain.format(i=5), "z")] * 2  # repeated rows
    rows += [(200, "http://long.example/", "<article>" + "<p>word " * 30_000 + "</article>", "z"), (201, "http://long.example/", "<div>" * 3000 + "deep", "z"), (202, "http://long.example/", "<article>" + "".join(f"<div class=c{i}>t{i}</div>" for i in range(3000)) + "</article>", "z")]
    rows += [(203 + i, "http://long.example/", "<article>" + "".join(f"<div class=c{j}>t{j}</div>" for j in range(3000 - i)) + "</article>", "z") for i in range(3)]
    return rows


def test_html_wrapper_decides(spark):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "k", "k", "k", "k") for r in rows], "page_id long, url string, html string, payload string, host string, text string, page string, shape string")
    have = got(extract_text(pages).select("page_id", "text"))
    want = Counter((i, f"Title {i} x {i} y a+b See alt z") for i in range(6))
    want += Counter((100 + i, f"Head {i} Story {i} is long enough to be told. It goes on, {i}.") for i in (0, 1, 2, 3, 4, 5, 5, 5))
    want += Counter([(200, " ".join(["word"] * 30_000)), (201, "deep"), (202, " ".join(f"t{i}" for i in range(3000)))])
    want += Counter((203 + i, " ".join(f"t{j}" for j in range(3000 - i))) for i in range(3))
    assert have == want
    alone = dict(got(extract_text(pages, induce=False).select("page_id", "text")).keys())
    assert all(alone[100 + i] != f"Head {i} Story {i} is long enough to be told. It goes on, {i}." for i in range(6)), "without its host a page keeps template"


def test_tree_matching():
    a, b = Page("<div><p>1</p><ul><li>x</ul></div>").skeleton()[0], Page("<div><h1>t</h1><p>1</p><p>2</p><ul><li>x<li>y</ul></div>").skeleton()[0]
    assert a == "#(div(p,ul(li)))" and b == "#(div(h1,p,ul(li)))"
    assert alignment(a, b) == (0, 1, 3, 4, 5) and alignment(b, a) == (0, 1, -1, 2, 3, 4)


def shingle_sets(rows, k=5):
    sets = {}
    for i, text in rows:
        words = [w for w in re.split(f"[{SP}]+", (text or "").translate(LOWER)) if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    return sets


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize("bucket", [16_384, 7])
def test_near_copies(spark, bucket):
    """Edits well above and well below the similarity, in groups of two to forty, with hot and tiny buckets."""
    import random

    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    rows = []
    for g in range(30):
        base = [word() for _ in range(rng.choice([200, 400, 1000]))]
        for c in range(40 if g == 0 else rng.randrange(1, 5)):
            words = list(base)
            for _ in range(len(base) // 200):  # about 0.9
                words[rng.randrange(len(words))] = word()
            if c == 3 and g:
                words = [w if j % 12 else word() for j, w in enumerate(base)]  # about 0.4
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, "short text"), (1001, "Short  TEXT"), (1002, ""), (1003, None), (1004, " \n")]
    sets = shingle_sets(rows)
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, _ in rows:
        for j, _ in rows:
            if i < j:
                s = jaccard(sets[i], sets[j])
                if s >= 0.8:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    have = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    assert have == {i: root(i) for i, _ in rows}


def near_groups(rows, similarity=0.8):
    """Smallest id of each id's component under the exact similarity of every pair."""
    sets, group = shingle_sets(rows), {i: i for i, _ in rows}
    for i, _ in rows:
        for j, _ in rows:
            if i < j and group[i] != group[j] and jaccard(sets[i], sets[j]) >= similarity:
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("bucket", [16_384, 3])
def test_near_copies_repeated_lines_and_short_texts(spark, bucket):
    """Lines repeated a hundred times in one text and twice in the other, texts of a few words, and pairs close to 0.8."""
    import random

    rng = random.Random(11)
    words = lambda n: ["w%d" % rng.randrange(10**6) for _ in range(n)]
    rows = []
    for many, few in ((100, 2), (60, 3), (30, 2)):
        for _ in range(8):
            base, line = words(2000), words(30)
            rows += [(len(rows), " ".join(base + line * many)), (len(rows) + 1, " ".join(base + line * few))]
    for n in (9, 12, 15, 24, 40):
        for _ in range(12):
            base = words(n)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-1])), (len(rows) + 2, " ".join(base + words(n // 6)))]
    for cut in range(60, 66):
        base = words(500)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-cut] + words(cut)))]
        rows += [(len(rows), " ".join(base[cut:]))]
    have = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    assert have == near_groups(rows)


def test_pipeline_keeps_other_texts_of_an_id(spark, sf):
    """Of each group of copies one document stays, whatever else has its id or none."""
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(200))
    more = [(20, long), (21, "x1 x2 x3"), (21, long), (None, long + " end"), (None, "only text"), (22, "only  text"), (30, "y1 y2 y3 y4"), (30, long + " end")]
    rows = [(r[0], r[1]) for r in rows_of()] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = lambda i: (i is None, i or 0)
    own = {}
    for i, t in rows:
        own.setdefault(re.sub(f"[{SP}]+", " ", t or ""), []).append(i)
    want = Counter((i, t) for i, t in rows if i == min(own[re.sub(f"[{SP}]+", " ", t or "")], key=first))
    assert got(cp.drop_copies(spark, docs, sf)) == want
    texts = sorted(set(rows), key=lambda d: (first(d[0]), d[1] or ""))
    group = near_groups(list(enumerate(t for _, t in texts)))
    groups = defaultdict(list)
    for i, d in enumerate(texts):
        groups[group[i]].append(d)
    have = got(cp.drop_near_copies(spark, docs, sf))
    for g in groups.values():
        kept = {(d[0], d[1] or "") for d in g if d in have}
        assert len(kept) == 1 and kept.pop()[0] == min((d[0] for d in g), key=first)
    assert all(n == rows.count(d) for d, n in have.items())


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    count = toxicity.Compressors(model).differences
    rows = {i: r for i, r in rows.items() if toxicity._score(model, count(r.text.encode())) < 0.7}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(f"[{SP}]+", " ", rows[i].text), i)
    rows = {i: rows[i] for i in first.values()}
    sets = shingle_sets([(i, r.text) for i, r in rows.items()], cp.NEAR_SHINGLE)
    factors = near_copies._multipliers()
    sketch = {i: np.frombuffer(near_copies.signature(r.text.encode(), cp.NEAR_SHINGLE, factors)[1], np.uint8)[None] for i, r in rows.items()}
    near = []
    for i in rows:  # every pair, without buckets and radius; the estimate is held against the exact similarity
        for j in rows:
            if i < j:
                exact, guess = jaccard(sets[i], sets[j]), near_copies.estimate(sketch[i], sketch[j])[0]
                assert abs(exact - guess) < 0.05
                if guess >= cp.NEAR_SIMILARITY:
                    near.append((i, j))
    group = {i: i for i in rows}
    for i, j in near:
        if group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = {k: low if v == high else v for k, v in group.items()}
    keep = [i for i in rows if group[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {c[0] for c in brute8([(i, rows[i].text) for i in keep], items) if not c[5]}
    have = cp.run(spark, sf)
    assert {r.doc_id for r in have.collect()} == want and have.columns[: len(columns)] == columns
    assert len({r.mix_position for r in have.collect()}) == len(want)
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).collect() == []
    odd = spark.createDataFrame(rows_of(), SCHEMA)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, odd, sf).count() <= len(ODD)


def test_pipeline_near_copies_by_simhash(spark, sf):
    """Texts that the SimHash operator links go, however few shingles they share, and its links join those of similar texts."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(10**6)
    sets = lambda a, b: shingle_sets([(0, a), (1, b)], cp.NEAR_SHINGLE)
    bits = lambda a, b: (simhash.fingerprint(a.encode(), 4) ^ simhash.fingerprint(b.encode(), 4)).bit_count()

    def changed(base, every, ok):
        while True:
            words = [word() if rng.randrange(every) == 0 else w for w in base.split()]
            s = sets(base, " ".join(words))
            if ok(jaccard(s[0], s[1]), bits(base, " ".join(words))):
                return " ".join(words)

    rows = []
    for g in range(4):
        a = " ".join(word() for _ in range(300))
        b = changed(a, 30, lambda s, d: s < 0.8 and d <= simhash.RADIUS)
        c = changed(b, 60, lambda s, d: s >= 0.82 and d > simhash.RADIUS)
        rows += [(10 * g, a), (10 * g + 1, b), (10 * g + 2, c), (10 * g + 3, changed(a, 8, lambda s, d: s < 0.6 and d > 8))]
    group = near_groups(rows)
    for i, a in rows:
        for j, b in rows:
            if i < j and group[i] != group[j] and bits(a, b) <= simhash.RADIUS:
                low, high = sorted((group[i], group[j]))
                group = {x: low if v == high else v for x, v in group.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, sf).collect()) == sorted(set(group.values())) == [0, 3, 10, 13, 20, 23, 30, 33]


def test_pipeline_stages_hand_on_small_batches(spark, sf):
    import corpus_pipeline
    from tidemark.llm.shared import BATCH_BYTES, BATCH_SETTING

    before = spark.conf.get(BATCH_SETTING)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_leaks):
            spark.conf.set(BATCH_SETTING, 1 << 28)
            stage(spark, docs, sf)
            assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES
    finally:
        spark.conf.set(BATCH_SETTING, before)
