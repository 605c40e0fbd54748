"""Near-duplicates: a multi-index Hamming join over b-bit minhash signatures, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles (64-bit hashes). Its signature has DIGITS digits of BITS bits, each
the low bits of a minhash; two documents of similarity J differ in about (1 - J) * DIGITS digits. The signature is
split into CHUNKS chunks of WIDTH digits. If two signatures differ in at most CHUNKS * (ERRORS + 1) - 1 digits, then
by the pigeonhole principle some chunk has at most ERRORS of them; so each chunk is indexed under every way to leave
ERRORS digits out, and all pairs within that distance meet under a key. With 16 chunks of 4 digits and 1 error the
distance is 31 of 64, while pairs of similarity 0.75 have 16 on average, with deviation 3.5: about one of 10^5 such
pairs at the very threshold is beyond it, and closer ones less often. Nothing else loses a pair.

Keys that thousands of documents share must not list all pairs. Documents with equal sets are one class first. Then
components grow in ROUNDS rounds: in each bucket, in a random order, each class meets the next NEXT classes, and of
all that it has met in other components it proposes links to the BEST nearest by signature; these are confirmed and
merged. After that only pairs in a common bucket but of different components are still open:

* A bucket of at most LIGHT classes lists its open pairs.
* Classes of larger open buckets, say documents that share a long passage but too little else, meet by an exact prefix
  filter instead: with shingles in an order of all classes, the rarest first, two sets of the similarity have one in
  common among the first of each, where the smaller needs n - ceil(6/7 n) + 1 and the larger n - ceil(3/4 n) + 1 (and
  some further conditions on sizes and places). What all of these documents share comes last, so it lists no pairs.

Open pairs within the distance are confirmed too, and components made anew. So all links between different components
are found, and the components equal those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import LOWER, discard, hash_spans, in_batches, mix, partitions, shingles, stored, text_buffer, text_slices, word_spans

SHINGLE, PERCENT = 5, 75
DIGITS, BITS, CHUNKS, WIDTH, ERRORS = 64, 16, 16, 4, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Rounds of proposals; classes that one meets in a bucket; proposals of each; classes that are put in order together.
ROUNDS, NEXT, BEST, GROUP = 2, 3, 2, 256
#: Classes in a bucket that lists its open pairs.
LIGHT = 16
#: Places in which the members of one centre meet it, at most; one that has fewer has no more places than members.
PLACES = 1024
#: Rows of a list of documents to look at (24 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 200_000

_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(1, 2**63, DIGITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, DIGITS, dtype=np.uint64)
_KEY = _RNG.integers(1, 2**63, (CHUNKS, WIDTH, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of whole texts (A-Z lower-cased), one after the other, and their offsets."""
    raw, off = text_buffer(texts)
    raw = LOWER[raw]
    starts, ends, before = word_spans(raw, off)
    return shingles(hash_spans(raw, starts, ends), before, SHINGLE)


def signatures(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, DIGITS) minhash digits; documents without shingles get zeros."""
    n = len(off) - 1
    out = np.zeros((n, DIGITS), np.uint64)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    at = off[full]
    for k in range(DIGITS):
        out[full, k] = np.minimum.reduceat(((values * _MUL[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), at)
    return mix(out) & np.uint64((1 << BITS) - 1)


def planes(sig: np.ndarray) -> np.ndarray:
    """(documents, BITS) words of DIGITS bits: bit d of plane b is bit b of digit d."""
    out = np.zeros((len(sig), BITS), np.uint64)
    for b in range(BITS):
        bit = (sig >> np.uint64(b)) & np.uint64(1)
        out[:, b] = (bit << np.arange(DIGITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, CHUNKS * WIDTH): each chunk with each of its digits left out."""
    out = np.zeros((len(sig), CHUNKS, WIDTH), np.uint64)
    for c in range(CHUNKS):
        part = sig[:, c * WIDTH : (c + 1) * WIDTH] + np.uint64(1)
        for left in range(WIDTH):
            for d in range(WIDTH):
                if d != left:
                    out[:, c, left] = mix(out[:, c, left] + part[:, d] * _KEY[c, left, d])
    return out.reshape(len(sig), CHUNKS * WIDTH).view(np.int64)


def _differ(a: str, b: str, bits: int = BITS) -> str:
    """SQL of a word with a bit for each digit in which two signatures (arrays of planes) differ, by their first bits."""
    return "(" + " | ".join(f"({a}[{i}] ^ {b}[{i}])" for i in range(bits)) + ")"


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, digest, sig, keys) of rows (doc_id, h, text). One pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                values, off = sets_of(part.column(2))
                sig = signatures(values, off)
                n = np.diff(off)
                digests = [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else b"" for a, b in zip(off, off[1:], strict=False)]
                some = n > 0
                lists = []
                for m, width in ((planes(sig), BITS), (index_keys(sig), CHUNKS * WIDTH)):
                    ends = np.concatenate([[0], np.cumsum(some * width)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(m[some].ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(digests, pa.binary()), *lists], schema=schema)

    return in_batches(docs, run, "doc_id long, h long, n_shingles long, digest binary, sig array<long>, keys array<long>")


def sets_by_class(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of classes ``wanted`` (id, doc_id, h): each set is computed once, from one row with that id and text."""
    n = wanted.count()
    listed = wanted.select("id", F.col("doc_id").alias("__doc"), F.col("h").alias("__h"))
    on = (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
    joined = docs.join(F.broadcast(listed) if n <= BROADCAST_ROWS else listed, on).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                values, off = sets_of(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([values[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())], names=["id", "set"])

    sets = stored(in_batches(joined, run, "id long, set binary"), "sets")
    if sets.count() == n:
        return sets
    once = stored(sets.groupBy("id").agg(F.first("set").alias("set")), "sets")  # rows repeated as they are
    discard(sets)
    return once


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those whose full sets reach the similarity.

    The sets of one ``a`` and its ``b`` meet in at most PLACES places, dealt by ``b``; each set moves once for each pair
    that its class is the ``b`` of, and once for each such place of which it is the ``a``.
    """
    pairs = stored(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PLACES)).cast("int").alias("place")), "pairs")
    centres = pairs.select(F.col("a").alias("id"), F.col("a").alias("centre"), "place", F.lit(0).alias("kind")).distinct()
    roles = centres.unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("centre"), "place", F.lit(1).alias("kind")))
    roles = roles.withColumnRenamed("id", "who")
    joined = sets.join(F.broadcast(roles) if pairs.count() <= BROADCAST_ROWS // 2 else roles, F.col("id") == F.col("who")).select("centre", "place", "kind", "id", "set")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, None
        for batch in batches:
            a, b = [], []
            at = zip(*(batch.column(c).to_pylist() for c in ("centre", "place", "kind", "id")), strict=True)
            for (centre, salt, kind, i), raw in zip(at, batch.column("set"), strict=True):
                v = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind == 0:
                    place, own = (centre, salt), v
                elif (centre, salt) == place:
                    both = int(np.count_nonzero(own[np.minimum(np.searchsorted(own, v), len(own) - 1)] == v))
                    if 100 * both >= PERCENT * (len(own) + len(v) - both):
                        a.append(centre)
                        b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = joined.repartition(partitions(sets.sparkSession), "centre", "place").sortWithinPartitions("centre", "place", "kind")
    links = stored(in_batches(dealt, meet, "a long, b long"), "links")
    discard(pairs)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in ``edges`` (a, b): comp is the smallest id reachable.

    Each round hooks every component to its smallest neighbour, follows the chains of hooks to their ends by
    doubling, and contracts the edges; rounds and doublings are logarithmic. All tables live in the shared folder and
    go when the next ones are there.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    labels = stored(both.select(F.col("a").alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    open_ = stored(both.distinct(), "edges")
    while not open_.isEmpty():
        hooks = stored(open_.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("up"), F.lit(True).alias("moved")), "hooks")
        while True:
            nxt = hooks.alias("p").join(hooks.alias("q"), F.col("p.up") == F.col("q.x")).select(F.col("p.x").alias("x"), F.col("q.up").alias("up"), (F.col("p.up") != F.col("q.up")).alias("moved"))
            nxt = stored(nxt, "hooks")
            discard(hooks)
            hooks = nxt
            if hooks.where("moved").isEmpty():
                break
        top = hooks.select("x", "up")
        renamed = stored(labels.join(top, F.col("comp") == F.col("x"), "left").select("id", F.coalesce("up", "comp").alias("comp")), "labels")
        ea = open_.join(top, F.col("a") == F.col("x")).select(F.col("up").alias("a"), "b")
        eb = ea.join(top, F.col("b") == F.col("x")).select("a", F.col("up").alias("b"))
        left = stored(eb.where("a <> b").distinct(), "edges")
        discard(labels, open_, hooks)
        labels, open_ = renamed, left
    discard(open_)
    return labels


def prefix_pairs(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs (a, b) of the classes ``ids`` (id, comp, n) that pass the exact prefix filter, of different components."""
    schema = pa.schema([("id", pa.int64()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1)
            for i in range(0, batch.num_rows, 64):
                part = [np.frombuffer(x.as_buffer(), np.int64) for x in raw[i : i + 64]]
                who = np.repeat(batch.column(0)[i : i + 64].to_numpy(), [len(v) for v in part])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate(part))], schema=schema)

    each = in_batches(sets.join(ids.select(F.col("id").alias("who")), F.col("id") == F.col("who"), "left_semi"), run, "id long, s long")
    each = stored(each, "shingles")
    several = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")  # the others meet nothing, and come first
    met = each.join(several.withColumnRenamed("s", "t").hint("merge"), F.col("s") == F.col("t")).select("id", "s", "df")
    by_class = Window.partitionBy("id")
    ranked = met.withColumn("rank", F.row_number().over(by_class.orderBy("df", "s"))).withColumn("shared", F.count("*").over(by_class))
    t = PERCENT / 100
    placed = ranked.join(ids, "id").withColumn("pos", F.col("n") - F.col("shared") + F.col("rank") - 1)  # from 0
    least = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    first = stored(placed.withColumn("short", F.col("pos") < least(2 * t / (1 + t))).where(F.col("pos") < least(t)).select("s", "id", "comp", "n", "pos", "short"), "prefixes")
    x, y = (first.select(*[F.col(c).alias(f"{p}_{c}") for c in first.columns]) for p in "xy")
    # x is the smaller set, or that of the smaller id of two of one size; what is left after the common place must do
    bound = f"x_short AND (x_n < y_n OR (x_n = y_n AND x_id < y_id)) AND x_comp <> y_comp AND 100 * x_n >= {PERCENT} * y_n AND {100 + PERCENT} * (1 + least(x_n - x_pos, y_n - y_pos) - 1) >= {PERCENT} * (x_n + y_n)"
    pairs = stored(x.join(y.hint("merge"), (F.col("x_s") == F.col("y_s")) & F.expr(bound)).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "prefix-pairs")
    discard(each, first)
    return pairs


def still_open(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (key, id, comp, m) of the ``buckets`` (key, id) of m classes that hold several components."""
    known = buckets.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")) if labels is not None else buckets.select("key", "id", F.col("id").alias("comp"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    return stored(known.join(mixed, "key"), "open")


def proposals(open_: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b): for each class the BEST nearest of those of other components that it meets in the open buckets."""
    brief = classes.select("id", "n", F.slice("sig", 1, 4).alias("sig"))  # four bits of each digit
    order = F.xxhash64("id", "key", F.lit(seed))
    dealt = open_.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("m") / GROUP))).join(brief, "id")
    ahead = Window.partitionBy("key", "part").orderBy(order, "id").rowsBetween(1, NEXT)
    me = F.struct("id", "comp", "n", "sig")
    met = dealt.select(me.alias("x"), F.collect_list(me).over(ahead).alias("ys")).select("x", F.explode("ys").alias("y")).where(f"x.comp <> y.comp AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)")
    apart = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr(f"bit_count({_differ('x.sig', 'y.sig', 4)})").alias("d")).where(f"d <= {DISTANCE}").distinct()
    both = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d", F.xxhash64("b", F.lit(seed)), "b"))).where(F.col("rank") <= BEST)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidates(buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Open pairs (a, b) within the signature distance."""
    still = still_open(buckets, labels)
    info = classes.select("id", "n", "sig")
    ids = stored(still.where(F.col("m") > LIGHT).select("id", "comp").distinct().join(classes.select("id", "n"), "id"), "heavy")
    x, y = (still.where(F.col("m") <= LIGHT).select(*[F.col(c).alias(f"{p}_{c}") for c in ("key", "id", "comp")]) for p in "xy")
    light = x.join(y.hint("merge"), F.expr("x_key = y_key AND x_id < y_id AND x_comp <> y_comp")).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()
    heavy = None if ids.isEmpty() else prefix_pairs(sets, ids)
    pairs = light if heavy is None else light.unionByName(heavy).distinct()
    a, b = (info.select(*[F.col(c).alias(f"{p}_{c}") for c in info.columns]) for p in "xy")
    near = F.expr(f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n) AND bit_count({_differ('x_sig', 'y_sig')}) <= {DISTANCE}")
    found = stored(pairs.join(a.hint("merge"), F.col("a") == F.col("x_id")).join(b.hint("merge"), F.col("b") == F.col("y_id")).where(near).select("a", "b"), "candidates")
    discard(still, ids, *([heavy] if heavy is not None else []))
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A text of one to four words has its whole sequence as its one shingle. Null texts and texts without words have
    none, are linked with nothing and are their own component. Rows of one id are one document: what any of them
    links to is one component. A null id is no id: such a row joins what its text is linked with, its component is
    null (and it is kept) if nothing there has an id. Other columns are ignored. An empty table gives an empty result.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("h"), docs[text_col].cast("string").alias("text"))
    signed = stored(sign(own), "signed")
    full = signed.where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = full.groupBy("digest").agg(F.min(row).alias("row"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "row.doc_id", "row.h", "n", "sig", "keys"), "classes")

    keyed = classes.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    buckets = stored(keyed.join(shared, "key"), "buckets")
    wanted = stored(buckets.select("id").distinct().join(classes.select("id", "doc_id", "h"), "id"), "wanted")
    sets = sets_by_class(own, wanted)

    links, labels = None, None
    for k in range(ROUNDS):
        open_ = still_open(buckets, labels)
        new = confirm(sets, proposals(open_, classes, k))
        discard(open_, *([labels] if labels is not None else []))
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    found = candidates(buckets, labels, classes, sets)
    more = confirm(sets, found)

    texts = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    one_id = stored(full.select("doc_id", "digest").join(texts.select("doc_id", "lo"), "doc_id").select("digest", "lo").distinct(), "one-id")
    if not (more.isEmpty() and one_id.isEmpty()):
        ends = classes.select("id", "digest")
        same = one_id.join(ends.select(F.col("id").alias("a"), F.col("digest").alias("lo")), "lo").join(ends.withColumnRenamed("id", "b"), "digest").select("a", "b")
        discard(labels)
        labels = components(links.unionByName(more).unionByName(same))

    comps = classes.select("id", "digest", "doc_id").join(labels, "id", "left").select("digest", "doc_id", F.coalesce("comp", "id").alias("comp"))
    lowest = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    ids = stored(comps.join(lowest, "comp").select("digest", "component_id"), "components")
    discard(buckets, wanted, sets, found, more, one_id, labels, classes)
    out = signed.select("doc_id", "n_shingles", "digest")
    with_set = out.where("n_shingles > 0").join(ids, "digest").select("doc_id", "n_shingles", "component_id")
    without = out.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
