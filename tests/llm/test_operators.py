import hashlib
import mmap
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.llm import bpe, common, exact_dedup, fingerprint, html_extract, lang_id, line_dedup, mixing, near_dup, quality, queries, token_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, norm string, digest string, key string, comp string"
LONG = "word " * 30_000


def table(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, la, s, 0, "x", "x", "x", "x", "x") for i, t, la, s in rows], SCHEMA)


EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, "  \t\n", "en", "b"), (4, LONG, "en", None), (5, "one two three", "en", "a"), (6, "One  two\tthree", None, "a"), (6, "One  two\tthree", None, "a"), (7, "é中文🙂 '", "fr", "c"), (8, "a" * 20_000, "de", "a"), (9, "12 34 !!", "en", "b")]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="module")
def empty(edges):
    return edges.where("false")


@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path(queries.RANKS)


def tiktoken_of(ranks):
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r, special_tokens={})


def test_bpe_tree_equals_library(ranks):
    whole, tree = tiktoken_of(ranks), bpe.load(ranks, public_tokenizers.PATTERN, 8)

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.one_of(st.sampled_from(" \t\n'sretvmld.,!abzABZ019éß中 ́\x1c🙂"), st.characters(exclude_categories=["Cs"])), max_size=120))
    def check(s):
        ids = tree.encode(s)
        assert ids == whole.encode_ordinary(s)
        assert tree.decode(ids) == s.encode()

    check()
    for s in (LONG[:9000], "x" * 3000, "'s" * 900, " " * 2000 + "a"):
        assert tree.encode(s) == whole.encode_ordinary(s)


def test_bpe_of_another_pattern(ranks):
    import base64

    import tiktoken

    with pytest.raises(ValueError):
        bpe.load(ranks, r"[a-z]+[!?]*\n*|[^a-z]")
    with open(ranks, "rb") as f:
        r = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"[a-z]+[!?]*\n*|[^a-z]"
    whole = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=r, special_tokens={})
    tree = bpe.load(ranks, pattern, 8, r"(?<=\n)(?=[^\n])|(?<=[a-z])(?= )")

    @settings(max_examples=200, deadline=None)
    @given(st.text("ab!?\n Z", max_size=90))
    def check(s):
        assert tree.encode(s) == whole.encode_ordinary(s)

    check()


def test_bpe_documents(spark, edges, empty, ranks):
    whole = tiktoken_of(ranks)
    got = bpe.encode_documents(edges, ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(EDGES)
    for i, t, *_ in EDGES:
        r = next(x for x in got if x["doc_id"] == i)
        assert r["ids"] == whole.encode_ordinary(t or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_exact_groups(spark, edges, empty):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(edges).collect()}
    assert got[1]["keep_id"] == 1 and got[2]["keep_id"] == 1 and not got[2]["kept"] and got[3]["keep_id"] == 3
    assert got[5]["group_size"] == 1 and got[6]["group_size"] == 2 and got[6]["kept"]
    assert got[6]["text_sha256"] == hashlib.sha256(b"One two three").hexdigest()
    assert exact_dedup.exact_groups(edges).count() == len(EDGES) and exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_of_repeats_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (2, "c"), (None, "c"), (None, "d"), (None, "d"), (7, None), (3, "")]
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert got == Counter([(1, 1, 2, True)] * 2 + [(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False)] + [(None, None, 2, True)] * 2 + [(7, 3, 2, False), (3, 3, 2, True)])


def test_exact_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(9)
    by = defaultdict(list)
    for r in docs.collect():
        by[re.sub("[\\x20\\x09-\\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    want = sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == want


def test_exact_groups_survive_colliding_digests(spark, edges):
    weak = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)  # noqa: E731  one digest for all
    plain = sorted(map(tuple, exact_dedup.exact_groups(edges).collect()))
    assert sorted(map(tuple, exact_dedup.exact_groups(edges, digest=weak).collect())) == plain
    assert sorted(map(tuple, exact_dedup.exact_groups(edges, flushes=1).collect())) == plain


def test_merge_index_levels(spark):
    from ferrule.operators.exchange import exchanges, node_names

    index = exact_dedup.MergeIndex(spark)
    add = lambda rows: index.add(spark.createDataFrame([(bytes([d]), i) for d, i in rows], "digest binary, doc_id long"))
    add([(1, 5), (1, 3), (2, 8)])
    assert [len(x) for x in index.levels] == [1]
    add([(2, 4), (0, 9)])
    assert [len(x) for x in index.levels] == [0, 1]  # two runs of level 0 became one of level 1
    add([(3, 7), (1, None)])
    assert [len(x) for x in index.levels] == [1, 1] and index.lookup(b"\1").collect() == [(b"\1", 3, 3)]
    runs = [spark.table(r[0]) for level in index.levels for r in level]
    both = index.merged(*runs)
    assert [x.kind for x in exchanges(both)] == [] and "SortMergeJoin" in node_names(both)  # runs merge where they lie
    level = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.compact().collect()}
    assert level == {b"\1": (3, 3), b"\0": (9, 1), b"\2": (4, 2), b"\3": (7, 1)} and [len(x) for x in index.levels] == [1]
    assert index.lookup(b"\7").count() == 0


def test_probes_read_only_what_filters_let_through(spark):
    """Of a run of 4 buckets a probe opens one file; its filter spares the row group if the digest is unknown."""
    index = exact_dedup.MergeIndex(spark)
    index.add(spark.range(4000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id")))

    run = spark.table(index.levels[0][0][0])

    def read(text):
        digest = hashlib.sha256(text.encode()).digest()
        df = run.where(F.col("digest") == F.lit(digest))
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert len(df.collect()) == index.lookup(digest).count()
        return df.count(), scan.metrics().apply("numOutputRows").value()

    hit, miss = read("17"), read("not there")
    assert hit[0] == 1 and 1 <= hit[1] < 1300  # one bucket's file
    assert miss == (0, 0)  # its filter spared all rows


def test_filter_of_several_digests(spark):
    sha = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    known = exact_dedup.filter_of(spark.range(500).select(sha))
    assert known.count() <= exact_dedup.FILTER_ROWS
    inside = exact_dedup.probed(spark.range(500).select(sha), known).where("maybe").count()
    outside = exact_dedup.probed(spark.range(1000, 6000).select(sha), known).where("maybe").count()
    assert inside == 500 and outside < 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.just(7)), max_size=1500), st.integers(0, 60_000))
def test_wavelet_matrix(ids, step):
    ids = np.array([i * step for i in ids], np.uint32)
    s = token_file.Shard(token_file.build(ids, np.array([7]), np.array([len(ids)])))
    assert (s.ids() == ids).all() and len(s) == len(ids)
    for i in range(0, len(ids), 97):
        c = int(ids[i])
        assert s.access(i) == c and s.rank(c, i) == (ids[:i] == c).sum() and s.count(c) == (ids == c).sum()
        assert s.select(c, s.rank(c, i)) == i and (s.ids(i, min(i + 5, len(ids))) == ids[i : i + 5]).all()
    with pytest.raises(IndexError):
        s.select(99, 0)


def test_a_shard_is_compressed_and_opened_by_document(tmp_path):
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 900, 2000)
    ids = np.minimum(rng.zipf(1.3, lengths.sum()), 49_000).astype(np.uint32)
    data = token_file.build(ids, np.arange(2000), lengths, np.arange(2000) == 0)
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    entropy = -(p * np.log2(p)).sum()
    assert len(data) * 8 < 1.1 * (entropy + 0.2) * len(ids) + 128 * 2000 + 64 * len(p) < 16 * len(ids)
    path = tmp_path / "shard"
    path.write_bytes(data)
    ends = np.cumsum(lengths)
    with path.open("rb") as f:
        s = token_file.Shard(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        for k in (0, 1, 1000, 1999):
            assert (s.document(k) == ids[ends[k] - lengths[k] : ends[k]]).all()
        assert not s._cum  # counts of whole planes were not needed
        assert s.null_ids[0] == 1 and s.doc_ids[1999] == 1999
    for c in (1, 2, 48, 777):
        where = np.flatnonzero(ids == c)
        assert s.count(c) == len(where) and all(s.select(c, k) == where[k] for k in range(0, len(where), 1 + len(where) // 9))


def test_ranges_of_a_shard_are_read_by_the_ranks_of_their_ends():
    """One plane step reads each bit of a range once: as many counts before words as there are ranges, not ids."""

    class Counted(token_file.Shard):
        asked = 0

        def _before(self, k, word):
            self.asked += len(word)
            return super()._before(k, word)

    rng = np.random.default_rng(11)
    ids = np.minimum(rng.zipf(1.2, 60_000), 40_000).astype(np.uint32)
    data = token_file.build(ids, np.array([0]), np.array([len(ids)]))
    s = Counted(data)
    assert (s.ids() == ids).all() and s.asked == s.planes  # a whole plane is one range
    s = Counted(data)
    assert (s.ids(100, 50_100) == ids[100:50_100]).all() and s.asked < 25_000

    @settings(max_examples=300, deadline=None)
    @given(st.integers(0, 60_000), st.integers(0, 3000))
    def check(lo, size):
        hi = min(lo + size, len(ids))
        assert (s.ids(lo, hi) == ids[lo:hi]).all() and (token_file.Shard(data).ids(lo, hi) == ids[lo:hi]).all()

    check()


def test_code_lengths_are_those_of_huffman():
    import heapq

    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 3000):
        counts = -np.sort(-rng.integers(1, 400, n))
        lifted = np.maximum(counts, -(-counts.sum() // 65536))
        heap = [(int(c), k, [k]) for k, c in enumerate(lifted)]
        depth = np.zeros(n, int)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            depth[a[2] + b[2]] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        got = token_file.code_lengths(counts)
        assert (got * lifted).sum() == max((depth * lifted).sum(), counts[0] if n == 1 else 0)


def plain_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORDS)
    return path, Tokenizer.from_file(path)


PIECES = st.sampled_from([" ", "\n", "'", "'s", "'ll", ".", ",", "$$$", "<", "=\u0338", "\u0301", "-", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "|>", "_", "~", "a", "Word", "don", "é", "İ", "ß", "7", "½", "中", "🙂", "\x1c", "\xa0", "\u200d"])


def same_as_library(enc, tok, texts):
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    want = [tok.encode(t or "", add_special_tokens=False).ids + [token_file.END] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, []), texts


def test_word_encoder_equals_the_untouched_library():
    path, tok = plain_tokenizer()
    enc = token_file.WordEncoder(path)

    @settings(max_examples=800, deadline=None)
    @given(st.lists(st.lists(st.one_of(PIECES, st.text(max_size=4), st.text("abcST.,'! é", max_size=8)), max_size=30).map("".join), max_size=4))
    def check(texts):
        same_as_library(enc, tok, texts)

    check()


def test_word_encoder_survives_colliding_hashes(monkeypatch):
    path, tok = plain_tokenizer()
    monkeypatch.setattr(token_file, "hash_spans", lambda raw, a, b: (b - a).astype(np.uint64) % np.uint64(5))
    enc = token_file.WordEncoder(path)
    for texts in (["one two six", "ten"], ["six <|endoftext|> one", None, ""], ["aaaaaaa bb", "bb aaaaaaa"]):
        same_as_library(enc, tok, texts)


def test_token_files(spark, edges, empty, tmp_path):
    path, tok = plain_tokenizer()
    texts = ["Don't, stop.now", "É é <|endoftext|>, x", "İ ǅ ß.,a", "a b c.", ".,.", "it's,'s", "ﬁ Ⅷ ½ 1,000.5", "one <|endoftext|> two", "<|endof", "text|> x<|startoftext|><|endoftext|>"]
    more = [(20 + i, t, None, None) for i, t in enumerate(texts)] + [(2**60 + 1, "far", None, None)]
    none = [(None, "of no id", None, None), (None, None, None, None)]
    docs = edges.unionByName(table(spark, more)).unionByName(table(spark, none))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op5_token_files(spark, str(tmp_path)).orderBy("start").collect()]
    assert {r[0] for r in got[:2]} == {None}
    known = {t or "": (len(ids := tok.encode(t or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for _, t, *_ in none + EDGES + more}
    assert sorted(r[2:] for r in got[:2]) == sorted(known[t or ""] for _, t, *_ in none)
    start = sum(r[2] for r in got[:2])
    for (i, n_start, n, crc), (j, t, *_) in zip(got[2:], EDGES + more, strict=True):
        assert (i, n_start, n, crc) == (j, start, *known[t or ""])
        start += n
    assert token_file.token_files(empty, path).count() == 0
    few = token_file.write_shards(docs, path, shard_tokens=50, rows_per_task=3)
    assert few.count() > 5 and sorted(map(str, token_file.read_shards(few).collect())) == sorted(str(spark.createDataFrame([r], "doc_id long, start long, n_tokens long, ids_crc32 long").first()) for r in got)


def test_targets():
    assert mixing.targets([100, 100, 100, 5]) == [200.0, 165.0, 82.5, 10.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0.0, 15.0]


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1001])
def test_permutations(n):
    for epoch in (0, 1):
        p = mixing.permute(np.arange(n), n, 99, epoch)
        assert sorted(p) == list(range(n)) and (mixing.inverse(p, n, 99, epoch) == np.arange(n)).all()


def test_shards_fill_the_quotas():
    quota = np.array([700, 0, 33, 5000])
    before = np.zeros(4, int)
    for s in range(-(-5733 // 256)):
        count, ahead = mixing.shard_counts(quota, 5733, s, 256, 3)
        assert (ahead == before).all()
        before = before + count
    assert (before == quota).all()


def test_mix(spark, edges, empty, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mix_documents(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_documents(docs.repartition(7)).collect()))
    sources = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        x = by[sources[r["doc_id"]]]
        x[0], x[1], x[2] = x[0] + r["size"], x[1] + r["taken"], r["target"]
    assert all(abs(t - goal) <= 64 for _, t, goal in by.values())
    odd = mixing.mix_documents(edges).collect()
    assert len(odd) == len(EDGES) and {r["doc_id"]: r["size"] for r in odd}[4] == 30_000
    assert mixing.mix_documents(empty).count() == 0
    mix = mixing.Mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    words = Counter()
    for r in mix.texts().collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert all(words[i] == n for i, n in taken.items())


def test_hypergeometric_is_exact_at_any_size():
    import math

    rng = np.random.default_rng(1)
    for good, bad, n in ((7, 9, 5), (3, 40, 20), (50, 2, 30), (1, 1, 1), (0, 5, 3), (5, 0, 3)):
        got = Counter(mixing.hypergeometric(rng, good, bad, n) for _ in range(20_000))
        for x in range(max(0, n - bad), min(good, n) + 1):
            p = math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n)
            assert abs(got[x] / 20_000 - p) < 5 * (p / 20_000) ** 0.5 + 1e-3
    good, bad, n = 3 * 10**9, 10**10, 5 * 10**9
    total = good + bad
    mean, sd = n * good / total, (n * (good / total) * (bad / total) * (total - n) / (total - 1)) ** 0.5
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(200)])
    assert abs(x.mean() - mean) < 5 * sd / 200**0.5 and 0.8 < x.std() / sd < 1.2


def test_taken_equals_slots_and_pieces_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mix = mixing.Mix(docs, block_words=16, shard_slots=64)
    reads = Counter((r["source_index"], r["block"]) for r in mix.slots().collect())
    by = defaultdict(list)
    for r in docs.collect():
        by[r["source"]].append((r["doc_id"], len([w for w in re.split("[\\x20\\x09-\\x0D]+", r["text"] or "") if w])))
    want = {}
    for k, name in enumerate(sorted(by, key=lambda x: (x is None, x or ""))):
        at = 0
        for i, size in sorted(by[name]):
            want[i] = sum(reads[(k, word // 16)] for word in range(at, at + size))
            at += size
    assert {r["doc_id"]: r["taken"] for r in mix.taken().collect()} == want


def test_mix_texts_of_repeated_ids(spark):
    rows = [(1, " ".join(f"{x}{i}" for i in range(n)), None, s) for x, n, s in (("a", 90, "s"), ("b", 90, "s"), ("b", 90, "s"), ("c", 50, None), ("d", 90, "t"))]
    rows += [(None, rows[0][1], None, "s"), (2, None, None, "s"), (3, "", None, None)]
    mix = mixing.Mix(table(spark, rows), block_words=8, shard_slots=4)
    taken = sorted((str(r["doc_id"]), r["taken"]) for r in mix.taken().collect())
    texts = mix.texts().collect()
    assert len(taken) == len(rows) and sum(n for _, n in taken) == sum(len(r["text"].split()) for r in texts)
    sizes = Counter()
    for r in texts:
        sizes[(r["doc_id"], r["source"], r["text"][0])] += len(r["text"].split())
    most = {(i, s, t[0]): 2 * len(t.split()) * (2 if t[0] == "b" else 1) for i, t, _, s in rows if t}
    assert all(n <= most[k] for k, n in sizes.items())


def brute(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for s in "\t\n\x0b\x0c\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_groups(spark, edges, empty):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 100
    for base in range(6):
        text = [rng.choice(words) for _ in range(120)]
        for copy in range(12):
            t = [w for w in text if rng.random() > 0.012 * copy]
            rows.append((n, " ".join(t), None, None))
            n += 1
    docs = edges.unionByName(table(spark, rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs).collect()}
    assert got == brute([(i, t) for i, t, *_ in EDGES + rows])
    assert near_dup.near_groups(docs).count() == len(EDGES) + len(rows)
    assert near_dup.near_groups(empty).count() == 0


def test_near_groups_equal_brute_force_at_scale(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_groups(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_recall_by_similarity(spark):
    """Pairs apart from each other, by band of their exact similarity: none at 0.75 or more is lost, none below linked."""
    rng, rows, bands = random.Random(8), [], defaultdict(list)
    for k in range(900):
        text = [f"p{k}x{i}" for i in range(rng.randint(60, 300))]
        a, b = 2 * k, 2 * k + 1
        cut = int(len(text) * rng.uniform(0.02, 0.17))
        if k % 2:
            other = text[cut:] + [f"q{k}x{i}" for i in range(cut)]
        else:
            other = [w if rng.random() > cut / len(text) / 4 else w + "!" for w in text]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (text, other))
        bands[min(int(100 * len(x & y) / len(x | y)) // 5 * 5, 95)].append((a, b, 100 * len(x & y) >= 75 * len(x | y)))
        rows += [(a, " ".join(text), None, None), (b, " ".join(other), None, None)]
    comp = {r["doc_id"]: r["component_id"] for r in near_dup.near_groups(table(spark, rows)).collect()}
    assert all(len(bands[k]) >= 20 for k in (70, 75, 80, 85, 90))
    for k, pairs in bands.items():
        assert all((comp[b] == a) == linked for a, b, linked in pairs), k


def template_documents(n):
    """Documents with a long passage in common, all pairs of similarity 0.55."""
    passage = " ".join(f"shared{i}" for i in range(145))
    return [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(57)), None, None) for i in range(n)]


def test_candidates_of_a_shared_passage_do_not_grow_with_its_square(spark, monkeypatch):
    found = []
    monkeypatch.setattr(near_dup, "confirm", lambda sets, pairs, f=near_dup.confirm: (found.append(pairs.count()), f(sets, pairs))[1])
    for n in (500, 4000):
        rows = template_documents(n)
        rows += [(n + i, rows[i][1] + " more", None, None) for i in range(0, 100)]  # a near copy each of some
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_groups(table(spark, rows)).collect()}
        assert got == {i: i if i < n else i - n for i in range(n + 100)}
    few, many = found[: len(found) // 2], found[len(found) // 2 :]
    assert sum(many) <= 10 * sum(few) <= 10 * 3000 and many[-1] <= 1000  # of 8 million pairs: proposals are linear, few stay open


def test_near_groups_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (None, c), (None, a), (None, "of its own"), (None, "of its own"), (1, ""), (None, None), (7, a), (7, a)]
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in near_dup.near_groups(table(spark, [(i, t, None, None) for i, t in rows])).collect())
    want = [(1, True, 1, True)] * 2 + [(2, True, 1, False), (3, True, 1, False), (4, True, 4, True), (None, True, 4, False), (None, True, 1, False)]
    want += [(None, True, None, True)] * 2 + [(1, False, 1, True), (None, False, None, True)] + [(7, True, 1, False)] * 2
    assert got == Counter(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r["id"]: r["comp"] for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}


def test_fingerprints_are_homomorphic():
    a, b, both, swapped = (fingerprint.fingerprints([t]) for t in ("x y z", "p q", "x y z\np q", "p q\nx y z"))
    assert (a + b).strings() == both.strings() == swapped.strings() and (both - b).strings() == a.strings()
    assert fingerprint.likeness(both, swapped)[0] == 1 and fingerprint.likeness(a, b)[0] < 0.5
    back = fingerprint.parse(both.strings())
    assert (back.ident == both.ident).all() and (back.like == both.like).all()


def test_likeness_without_spaces_and_of_many_repeats():
    rng = random.Random(5)
    like = lambda a, b: fingerprint.likeness(fingerprint.fingerprints([a]), fingerprint.fingerprints([b]))[0]
    for signs in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "".join(map(chr, range(0x4E00, 0x5200)))):
        a, b = ("".join(rng.choices(signs, k=6000)) for _ in range(2))
        assert like(a, fingerprint.edited(a, b)) > 0.5 and like(a, b[:9] + a) > 0.9 and like(a, b) < 0.3
    assert like("a" * 20_000, "a" * 15_000 + "b" * 5000) > 0.5
    assert abs(like("x y z\n" * 40_000, "x y z\n" * 20_000) - 0.8) < 0.01
    words = [f"w{i}" for i in range(600)]
    lines = lambda a, b: "\n".join(" ".join(words[i : i + 10]) for i in range(a, b, 10))
    spam = "\nbuy now, buy here" * 80  # one paragraph many times does not outweigh the rest
    assert like(lines(0, 450) + spam, lines(0, 450)) > 0.6 and like(lines(0, 450), lines(150, 600) + spam) > 0.25  # of 0.74 and 0.49; squares gave 0.03
    long, other = "".join(rng.choices("abc", k=300)), "".join(rng.choices("xyz", k=300))
    x, y, both = (fingerprint.fingerprints([t]) for t in (long, other, f"{long}\n{other}"))
    assert (x + y).strings() == both.strings()


def test_fingerprint_documents(spark, edges, empty):
    got = sorted(fingerprint.fingerprint_documents(edges).collect(), key=lambda r: r["doc_id"])
    order = sorted(EDGES, key=lambda r: -r[0])
    assert len(got) == len(EDGES)
    want = []
    for k, (i, t, *_) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and fingerprint.fingerprint_documents(empty).count() == 0


def triples(text):
    out = Counter()
    for line in text.lower().split("\n"):
        w = line.split()
        out.update(tuple(w[max(0, i - 2) : i + 1]) for i in range(len(w)))
    return out


def test_likeness_against_exact_shares(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy(F.desc("doc_id")).select("text").collect()
    texts = [r["text"] or "" for r in rows]
    new = [fingerprint.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    off = []
    for k in range(0, len(texts), 500):
        near = fingerprint.likeness(fingerprint.fingerprints(texts[k : k + 500]), fingerprint.fingerprints(new[k : k + 500]))
        for a, b, got in zip(texts[k : k + 500], new[k : k + 500], near, strict=True):
            x, y = triples(a), triples(b)
            if x and y:
                share = 2 * (x & y).total() / (x.total() + y.total())
                kinds = 2 * len(x.keys() & y.keys()) / (len(x) + len(y))
                assert got >= 0.4 or max(share, kinds) < 0.6
                off.append(got - share)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_fingerprints_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_SHARD", 2)
    rows = [(5, "one two"), (5, "one two"), (None, "of none"), (None, None), (2, "three four five"), (9, "six"), (7, ""), (1, "x"), (0, "y z")]
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    got = fingerprint.fingerprint_documents(docs).collect()
    assert len(got) == len(rows) and sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    by = {r["doc_id"]: r["edited_sha256"] for r in got if r["doc_id"] is not None}
    sha = lambda a, b: hashlib.sha256(fingerprint.edited(a, b).encode()).hexdigest()
    assert by[9] == sha("six", "") and by[2] == sha("three four five", "x") and by[1] == sha("x", "y z")
    assert {r["edited_sha256"] for r in got if r["doc_id"] == 5} == {sha("one two", "one two"), sha("one two", "three four five")}


def test_shards_with_their_neighbours(spark):
    rows = [(i * 3, f"text {i}", None, None) for i in range(300)]
    docs = table(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("h"))
    for size in (7, 1000):
        dealt = fingerprint.with_next(docs, size).collect()
        assert Counter(r["peek"] for r in dealt)[0] == 300


def test_languages(spark, edges, empty, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in r) / len(r) > 0.97
    odd = {x["doc_id"]: x for x in lang_id.predict(edges.select("doc_id", "text"), lang_id.train(lang_id.sample(docs), 20)).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3, 9)) and odd[4]["lang_pred"] != "und"
    assert lang_id.identify(empty).count() == 0
    nothing = lang_id.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x["lang_pred"] for x in nothing} == {"und"}


def test_gru_gradients():
    net = lang_id.ByteGru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seg, label = np.array([[1, 2, 3], [2, 2, 9]]), np.array([0, 1])
    _, g = net.gradients(seg, label)
    for k, at in (("x", (0, 2, 4)), ("u", (1, 0, 2)), ("c", (0, 1, 1)), ("o", (2, 1)), ("b", (0,))):
        old, e = net.p[k][at], 1e-3
        net.p[k][at] = old + e
        up = net.gradients(seg, label)[0]
        net.p[k][at] = old - e
        down = net.gradients(seg, label)[0]
        net.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4


def test_quality(spark, edges, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = quality.grade(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(x["kept"] == (x["quality"] == 1 and x["toxic"] == 0) for x in r) / len(r) > 0.95
    assert quality.grade(edges, labels.where("false")).where("kept").count() == len(EDGES)
    assert quality.grade(empty, labels).count() == 0
    assert quality.grade(docs.where("doc_id < 300").withColumn("key", F.lit(1)), labels.where("doc_id < 300")).count() == docs.where("doc_id < 300").count()
    odd = labels.unionByName(spark.createDataFrame([(4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(t) for c, t in labels.dtypes]))
    assert quality.grade(edges, odd).count() == len(EDGES)


def test_quality_of_repeats_and_ties(spark):
    rows = [(i % 40, ("good words of a kind here " if i % 2 else "poor stuff junk zzz ") * 6 + f"n{i % 40}", None, None) for i in range(200)] + [(None, "good words", None, None)] * 3
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.grade(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None)
    assert len({round(r["expected_grade"], 9) for r in got if r["doc_id"] == 3}) == 1


def test_languages_of_repeated_rows(spark):
    rows = [(1, "the quick brown fox is here", "en", None)] * 5000 + [(2 + i, f"der schnelle fuchs ist da {i}", "de", None) for i in range(50)]
    assert len(lang_id.sample(table(spark, rows), docs_per_lang=4)) <= 4 * 4 * 2 * 2


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, as ever.</div>
<article><header>by</header><h1>A &lt;title&gt;</h1><p>First, with <b>bold</b>\n text &amp; more.<p>Second<br>line.</p><form>mail<input></form><ul><li>one<li>two</ul></article>
<section id="comments"><p>I like this, really. So much, so well.</p></section><aside>More</aside><footer>&copy; 1</footer></body>"""


def test_html():
    assert html_extract.extract(PAGE) == "A <title>\n\nFirst, with bold text & more.\n\nSecond line.\n\none\n\ntwo"
    plain = PAGE.replace("article>", "div>")
    assert html_extract.extract(plain).startswith("A <title>\n\nFirst") and "like this" not in html_extract.extract(plain)
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.extract(PAGE[: PAGE.index("<form")] + "<p cla") == "A <title>\n\nFirst, with bold text & more.\n\nSecond line."


def test_html_keeps_the_whole_article():
    part = "Some words of a story, told well. It goes on, and on; so it does. "
    get = lambda body: html_extract.extract(f"<html><body>{body}</body></html>").replace(part.strip(), "#").replace("# ", "#").split("\n\n")
    teaser = f"<article><p>{part * 2}</p></article>"
    assert get(f"<main><p>{part * 6}</p></main>{teaser}") == get(f"<div><p>{part * 6}</p></div>{teaser}") == ["######", "##"]
    assert get(f"<article><p>{part * 3}</p></article><p>So.</p><article class=b><p>{part}</p></article>") == ["###", "So.", "#"]
    assert get(f"<div class=post><h1>Title</h1><div class=entry><p>{part * 3}</p><p>{part * 3}</p></div></div>") == ["Title", "###", "###"]
    assert get(f"<div><p>{part * 3}</p><section><p>{part * 6}</p></section></div>") == ["###", "######"]
    assert get(f"<div><p>{part * 9}</p><ul><li>one<li>two</ul></div>") == ["#########", "one", "two"]
    said = [f"He said so, {i}." for i in range(60)]
    assert get(f"<div>{''.join(f'<p>{x}</p>' for x in said)}</div>{teaser}") == [*said, "##"]


def test_html_names_do_not_drop_the_article():
    text = "Some words of a story, told well. It goes on, and on; so it does."
    for name in ("overflow-hidden", "elementor-widget-container", "content has-sidebar", "no-comments", "with-header", "md:hidden", "widget", "comments"):
        for tag in ("article", "main", "div"):
            assert html_extract.extract(f"<div class='{name}'><{tag}><p>{text}</p></{tag}></div>") == text, name
    assert html_extract.extract(f"<article><p>So.</p></article><div id=sidebar><p>{text}</p></div>") == f"So.\n\n{text}"
    for name in ("ad", "cookie-notice", "comments-area", "related-posts", "ad-300x250", "sidebarLeft", "site-footer"):
        assert html_extract.extract(f"<article><p>{text}</p></article><div class='{name}'><p>Not this, never.</p></div>") == text, name
    talk = f"<section id=comments><ol><li><article class=comment-body><p>{text * 9}</p></article></ol></section>"
    assert html_extract.extract(f"<div class=widget><main><p>{text}</p></main></div>{talk}") == text


def _without_names(page):
    page = re.sub(r"<(/?)(article|nav|header|footer|aside|form|section|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_html_paths_decide(spark):
    """Without any telling tag, class or headline the ratios find the article; switched off they do not."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    whole = [html_extract.extract(p) for p in pages]
    assert [html_extract.extract(_without_names(p)) for p in pages] == whole
    bare = [re.sub(r"<title>.*?</title>", "", re.sub(r"<(/?)h1", r"<\1p", _without_names(p)), flags=re.S) for p in pages]
    on, off = [html_extract.extract(p) for p in bare], [html_extract.extract(p, ratios=False) for p in bare]
    assert all(set(w.split("\n\n")) <= set(x.split("\n\n")) for w, x in zip(whole, on, strict=True))  # nothing lost
    assert sum(x == w for x, w in zip(on, whole, strict=True)) >= 0.75 * len(pages)
    assert sum(x == w for x, w in zip(off, whole, strict=True)) == 0


def test_html_quotes_and_names():
    t = "Some words of a story, told well. It goes on, and on; so it does."
    for opening in ("<p title=don't>", '<p title="don\'t>', "<p title='a>", '<p data-x="a > b" title=\'">\'>'):
        assert html_extract.extract(f'<article><p>{t}</p>{opening}{t} 2</p><p class="x">{t} 3</p></article>') == f"{t}\n\n{t} 2\n\n{t} 3", opening
    for name in ("content with-sidebar", "no-sidebar", "has-header", "layout hidden-print"):
        assert html_extract.extract(f"<div class='{name}'><p>{t}</p></div><footer>So.</footer>") == t, name
    assert html_extract.extract(f"<article><h1 class=header>Head</h1><p>{t}</p><a class=share>Share this</a></article>") == f"Head\n\n{t}"
    assert html_extract.extract(f"<form><div><p>{t}</p></div><button>Go</button></form>") == t
    assert html_extract.extract("<footer>&copy; all, rights; reserved.</footer>") == ""


def test_html_of_a_blog():
    s = "It was a long day, and the river rose; nobody knew why. The town waited, as it always had, for rain to stop."
    c = "I really like this post, thanks for writing it! My own view, though, is different. Please tell us more, much more."
    page = f"""<html><head><title>River rises | Site</title></head><body class="has-sidebar"><header><h1><a href=/>Site</a></h1><p>News, views, and more. Every day.</p></header>
    <div id="cookie-banner"><p>We use cookies, as you know. By using this site, you agree. Read more about it here, please.</p><button>OK</button></div>
    <div class="layout"><div><div class="post"><h2>River rises</h2><p>{s}</p><figcaption>A river, seen.</figcaption><p>{s}</p><h3>After</h3><ul><li>One</li><li>Two</li></ul><p>{s}</p>
    <div class="ad-slot"><p>Buy our new shoes, now with laces. They are great, really great.</p></div><p>Short.</p><div><a href=a>Tweet</a> <a href=b>Post</a></div></div>
    <div class="related-posts"><ul><li><a href=a>The town waits, once more, for the rain</a></li></ul></div><div id="comments"><h3>3 comments</h3>{f"<div><p>{c}</p></div>" * 5}</div></div>
    <div id="sidebar"><h3>About</h3><p>{c}</p></div></div><form><p>Get our newsletter, weekly. No spam, ever.</p></form><footer><p>&copy; Site. All rights reserved; see terms.</p></footer></body></html>"""
    want = f"River rises|{s}|A river, seen.|{s}|After|One|Two|{s}|".split("|")[:-1]
    assert html_extract.extract(page).split("\n\n") == [*want, "Short."]
    assert html_extract.extract(_without_names(page)).split("\n\n") == [*want, "Buy our new shoes, now with laces. They are great, really great.", "Short."]


def test_html_is_linear():
    n = 8000
    for page in ("<div>" * n + "Some text, here.", "".join(f"<div>w{i}, so." for i in range(n)), "<li><ul>" + "<div>" * n + "<li>x</li>" * n, "<svg>" * n, '<a x="' * n, "<b class=ad>" * n, "</p></zz>" * n, "x" * 2_000_000):
        start = time.perf_counter()
        html_extract.extract(page)
        assert time.perf_counter() - start < 1, page[:20]


def test_pages(spark, small):
    rows = [(1, "http://a/x", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "u", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got)[:3] == [0, 0, 0]
    assert html_extract.extract_pages(pages.where("false")).count() == 0
    assert line_dedup.drop_boilerplate(pages).count() == 4 and line_dedup.drop_boilerplate(pages.where("false")).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"https://H.example/{i}", f"<nav>Menu</nav><p>own {i}</p><p>own {i}</p><style>x</style>" + ("<p>some</p>" if i < 3 else ""), "k") for i in range(10)]
    rows += [(50, "https://few.example/", "<nav>Menu</nav>", "k")]
    rows += [(60 + i, "https://x.example/", "<p>again</p>", "k") for i in range(3)] + [(None, "https://x.example/", "<p>again</p>", "k")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for limit in (0, 10**6):
        got = {r["page_id"]: (r["host"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_boilerplate(pages, broadcast_lines=limit).collect()}
        assert got[60] == ("x.example", 1, 1, "") and got[None] == ("x.example", 1, 1, "")
        assert got[0] == ("h.example", 4, 1, "own 0\nown 0\nsome") and got[50] == ("few.example", 1, 0, "Menu")


def test_pipeline(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert out and {r["doc_id"] for r in out} <= set(docs)
    near = brute([(i, t) for i, t in docs.items()])
    assert all(near[r["doc_id"]][1] == r["doc_id"] for r in out)
    nothing = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, small)
        assert nothing.count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, further columns."""
    import corpus_pipeline

    clean = [(i, f"the cat {i} sat on the mat and the dog {i} ran over the hill to the sea", "en", "s") for i in range(30, 60)]
    rows = [(i, t, la, s) for i, t, la, s in EDGES] + [(None, "the rain in the town was cold and the wind was high", None, None), (None, None, None, None)] + clean + clean[:3]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "key", "comp", "norm", "digest")
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = corpus_pipeline.language(spark, docs, "")
    assert not any(t is None or not t.strip() for _, t in texts(kept)) and set(clean) <= {(r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept.collect()}
    exact = texts(corpus_pipeline.exact(spark, docs, ""))
    assert exact[(6, "One  two\tthree")] == 1 and exact[clean[0][:2]] == 1 and sum(exact.values()) == len({re.sub("[\\x20\\x09-\\x0D]+", " ", t or "") for _, t, *_ in rows})
    near = texts(corpus_pipeline.near(spark, docs, ""))
    assert near[(5, "one two three")] + near[(6, "One  two\tthree")] == 1 and near[clean[0][:2]] == 1
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and all(r["text"] for r in mixed.collect())
    done = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(done) == len(rows) and {r["n_tokens"] for r in done if r["doc_id"] in (1, 2)} == {0}


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(90)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b + " more"), (4, c), (5, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in exact.collect()) == [(1, a), (2, b), (3, b + " more"), (4, c)]
    near = corpus_pipeline.near(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in near.collect()) == [(1, a), (2, b), (4, c)]


def test_pipeline_is_the_whole_of_its_stages(spark, small, ranks):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if found[r["doc_id"]]["lang_pred"] != lang_id.UNKNOWN and found[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE)
    one = {}
    for i, t in rows:
        one.setdefault(re.sub("[\\x20\\x09-\\x0D]+", " ", t or ""), (i, t))
    near = brute(one.values())
    stay = [i for i, (_, comp) in near.items() if i == comp]
    assert 0 < len(stay) < len(one) < docs.count()
    left = docs.where(F.col("doc_id").isin(stay))
    mix = mixing.Mix(left)
    want = Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mix.texts().collect())
    got = corpus_pipeline.run(spark, small).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want
    whole = tiktoken_of(ranks)
    source = {r["doc_id"]: r["source"] for r in left.collect()}
    sizes, words, targets = Counter(), Counter(), {}
    for r in mixing.mix_documents(left).collect():
        sizes[source[r["doc_id"]]] += r["size"]
        targets[source[r["doc_id"]]] = r["target"]
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        words[source[r["doc_id"]]] += len(whole.decode(r["ids"]).split())
    assert set(sizes) == set(source.values()) and all(abs(words[s] - targets[s]) <= 64 for s in sizes)


BYTES, RECORDS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_batches_are_bounded(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(0, 1000, 1, 1).select("id", F.repeat(F.lit("word "), 4000).alias("text"))  # 20 MB
    before = spark.conf.get(BYTES)
    try:
        for given_, limit in (("64m", common.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(BYTES, given_)
            got = common.in_batches(docs, run, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 1000 and max(r["size"] for r in got) < 1.1 * limit
        spark.conf.set(BYTES, "64m")
        (one,) = common.in_batches(docs.limit(1).withColumn("text", F.repeat("text", 500)), run, "n long, size long").collect()
        assert one["n"] == 1 and one["size"] > 9_000_000  # a longer row comes whole
    finally:
        spark.conf.set(BYTES, before)


@pytest.mark.parametrize("number", [1, 2, 5, 6, 7, 8, 10])
def test_results_do_not_depend_on_batches(spark, small, number):
    query = next(q for name, q in queries.QUERIES.items() if name.startswith(f"op{number}_"))
    rows = lambda: sorted(map(repr, query(spark, small).collect()))
    whole, before = rows(), spark.conf.get(RECORDS)
    try:
        spark.conf.set(RECORDS, "3")
        assert rows() == whole
    finally:
        spark.conf.set(RECORDS, before)


ALONE = """
import numpy as np, pyarrow as pa
from ferrule.llm import common, lang_id
rng = np.random.default_rng(5)
texts = pa.array(["", None, "a", "x" * 64, "é 中 🙂 ", *("".join(map(chr, rng.integers(32, 400, n))) for n in rng.integers(1, 900, 40))])
for langs in (1, 4, 11):
    net = lang_id.ByteGru([str(k) for k in range(langs)])
    whole = net.documents(*common.text_buffer(texts))
    for step in (1, 2, 3, 7):
        for a in range(0, len(texts), step):
            assert (net.documents(*common.text_buffer(texts.slice(a, step))) == whole[a : a + step]).all(), (langs, step, a)
    assert (net.documents(*common.text_buffer(texts), rows=13) == whole).all()
    raw, off = common.text_buffer(texts.slice(3))
    for k, got in enumerate(whole[3:]):  # by the products of the training, which round in another order
        part = np.frombuffer(raw[off[k] : off[k + 1]].tobytes().ljust(-(-int(off[k + 1] - off[k]) // 64) * 64, b"\\0"), np.uint8).reshape(-1, 64)
        own = net.positions(net.forward(part, False)[0])[~common.SPACE[part.T] & (np.arange(part.size).reshape(-1, 64).T < off[k + 1] - off[k])]
        assert not len(own) or abs(own.mean(0) - got).max() < 1e-5
"""


@pytest.mark.parametrize("core", ["Haswell", "Nehalem", None])
def test_a_language_is_the_same_whatever_is_beside_it(core):
    """With the matrix kernels of several processors: some round a row by its place."""
    import os
    import subprocess
    import sys

    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(lang_id.__file__)) + "/..", **({"OPENBLAS_CORETYPE": core} if core else {})}
    got = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
