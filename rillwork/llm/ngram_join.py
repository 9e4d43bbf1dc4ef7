"""Jaccard similarity join of documents on word n-grams: rare-first prefix filtering with length, positional and suffix
filters; every surviving pair is verified once on whole texts.

1. Frequencies: shingle hashes are counted in a table of BUCKETS counters (fixed size, whatever the corpus). Ordering a
   text's shingles by (counter, hash) is one order for all texts with frequent shingles last; the filters hold for any
   such order, so the table's coarseness costs candidates, never links.
2. Profiles: each text becomes its number of shingles, a 128-bit hash of its set, and its prefix. Texts with equal sets
   are one node from here on, so exact copies make no pairs.
3. Stars: nodes that share a minimum hash are verified against the group's least node only. This links the bulk of large
   groups of near copies with a number of pairs in proportion to the number of nodes.
4. Crowds: where an n-gram's postings still make many pairs of different components, its nodes are verified against a leader
   picked anew in each round, as long as a round closes a quarter of these pairs, then once against LEADERS leaders.
5. Prefix join: only n-grams whose postings lie in two or more of the components can bring anything new. These
   postings are joined on the n-gram with the length, positional and bit filters (two sets differ in at least as many
   n-grams as the parities of their counts in RANGES hash ranges differ), and the distinct pairs pass the suffix filter
   (the same bound by the counts themselves).
6. Rounds: of the pairs between any two components the most promising ones are verified first; pairs whose components have
   met since are settled without verification. A pair is passed over only if links already connect it, so the components
   are those of all links, and no pair is verified twice.

Hot keys: sets, n-grams and star groups are pre-aggregated; a leader with many members is salted; joins are left to
adaptive execution, which splits hot partitions. Only tables of fixed size come to the driver: the counters, and bitmaps of
2^FILTER_BITS bits that spare rows a shuffle in which they would find no partner (a full bitmap spares none and loses none).

Defined cases: null, empty and white-space texts have an empty set and link with nothing (component: their own id); fewer
words than a shingle: the whole sequence is the one shingle; repeated rows and ids: a component is the least id of its
rows, null if all are null; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal, materialize, prepare, runs, utf8_views
from .graph import components
from .textbytes import ASCII_LOWER, RUN, mix, shingle_hashes, word_hashes, word_spans

SIZE = 5
PERCENT = 75
BUCKETS = 1 << 20
PIECE = 1 << 12
STARS = 4
RANGES = 256
BITS = [f"bits{k}" for k in range(RANGES // 64)]
MEMBERS = 512  # of one leader in a task
STAR_QUOTAS = (0,)  # first each node's best leader, then all that are not connected by that
PAIR_QUOTAS = (1, 64)  # first the best pair of any two components, then 64, then all that are left
CROWD = 8  # open pairs a posting from which an n-gram is a crowd
TURN_PAIRS = 16  # of a node in a round over crowds
MOST_TURNS = 16
LEADERS = 8  # of an n-gram in the last round over crowds
FILTER_BITS = 24
_U = np.uint64


def text_sets(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    off, raw = utf8_views(column)
    for a, b in runs(off, RUN):
        own = ASCII_LOWER[raw[off[a] : off[b]]]
        starts, ends, first = word_spans(own, off[a : b + 1] - off[a])
        hashes, at = shingle_hashes(word_hashes(own, starts, ends), first, size)
        for i in range(b - a):
            h = np.sort(hashes[at[i] : at[i + 1]])
            yield h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def least_overlap(n, m, percent: int = PERCENT):
    """The least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    need = least_overlap(len(a), len(b), percent)
    if need > min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def counters(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """How many (text, shingle) pairs fall in each of BUCKETS ranges of the hash: a table of fixed size on the driver.

    Every task adds up its own table and sends it in pieces; the pieces are added as they stream in, so no task holds more
    than one table.
    """
    shift = _U(64 - BUCKETS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(BUCKETS, np.int64), [], 0

        def add() -> None:
            nonlocal held
            if waiting:
                slot, n = np.unique((np.concatenate(waiting) >> shift).astype(np.int64), return_counts=True)
                total[slot] += n
                waiting.clear()
                held = 0

        for batch in batches:
            for h in text_sets(batch.column("text"), size):
                waiting.append(h)
                held += len(h)
                if held > 1 << 18:
                    add()
        add()
        yield _pieces({k: total[k * PIECE : (k + 1) * PIECE] for k in range(BUCKETS // PIECE) if total[k * PIECE : (k + 1) * PIECE].any()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(zlib.decompress(data), "<i8")
                total[k] = total[k] + own if k in total else own.copy()
        yield _pieces(total)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col(text).alias("text")).mapInArrow(frugal(count), "piece int, counts binary").repartition(parts, "piece")
    table = np.zeros(BUCKETS, np.int64)
    for row in sent.mapInArrow(frugal(merge), "piece int, counts binary").collect():  # BUCKETS counters in all
        table[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(row["counts"]), "<i8")
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def _pieces(tables: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = [zlib.compress(t.astype("<i8").tobytes(), 1) for t in tables.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array(data, pa.binary())], ["piece", "counts"])


def profiles(docs: DataFrame, id_col: str, text: str, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """row, doc_id, mark (hash of the text), n, s1, s2 (hash of the set), prefix (rare first), ranges, bits, keys; stored."""
    table = counters(docs, text, size)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    seeds = mix(np.arange(1, STARS + 1, dtype=np.uint64)) | _U(1)
    shift = _U(64 - BUCKETS.bit_length() + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, keys, prefix, ranges, bits = [], [], [], [], [], [], []
            for h in text_sets(batch.column("text"), size):
                n.append(len(h))
                s1.append(np.add.reduce(mix(h ^ _U(0xA5A5)), dtype=_U).astype(np.int64) if len(h) else 0)
                s2.append(np.add.reduce(mix(h + _U(0x1234567)) * _U(3), dtype=_U).astype(np.int64) if len(h) else 0)
                keys.append([int((h * s).min().astype(np.int64)) for s in seeds] if len(h) else [])
                order = np.lexsort((h, table[(h >> shift).astype(np.int64)]))[: prefix_length(len(h), percent)] if len(h) else []
                prefix.append(h[order].astype(np.int64))
                count = np.bincount((h & _U(RANGES - 1)).astype(np.int64), minlength=RANGES)
                ranges.append(np.minimum(count, 255).astype(np.uint8).tobytes())
                bits.append(np.packbits(count & 1).tobytes())
            size_of = np.array([len(p) for p in prefix], np.int32)
            flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64), pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size_of)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), listed, pa.array(ranges, pa.binary()), pa.array(bits, pa.binary())],
                ["doc_id", "mark", "n", "s1", "s2", "keys", "prefix", "ranges", "bits"],
            )

    out = source.mapInArrow(frugal(work), f"doc_id {kind}, mark long, n int, s1 long, s2 long, keys array<long>, prefix array<long>, ranges binary, bits binary")
    return scratch.keep(out.withColumn("row", F.monotonically_increasing_id()), "profiles")


def bitmap(keys: DataFrame) -> np.ndarray:
    """A 2^FILTER_BITS-bit set of the low bits of `key`, as 64-bit words: of fixed size however many keys there are."""
    low = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(F.shiftright(low, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.uint64) & _U((1 << FILTER_BITS) - 1)
    return (words[(low >> _U(6)).astype(np.int64)] >> (low & _U(63))) & _U(1) == 1


def only(table: DataFrame, column: str, keys: DataFrame, then=None, ddl: str | None = None) -> DataFrame:
    """The table without most rows whose column is not among the keys (`key`), so that they are not shuffled to a join; `then`
    makes rows of type `ddl` of each batch that is left, in the same worker."""
    words = bitmap(keys.select(F.xxhash64("key").alias("key")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(words, batch.column(batch.num_columns - 1).to_numpy())
            found = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit))
            yield then(found) if then else found

    return table.withColumn("__key", F.xxhash64(column)).mapInArrow(frugal(work), ddl or table.schema)


def fetch(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, scratch: Scratch) -> DataFrame:
    """node, text (packed) for the nodes in `wanted` (node, distinct), by id and text hash. A repeated row brings its text twice."""
    where = scratch.keep(nodes.select("node", "doc_id", "mark").join(wanted, "node"), "where")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [zlib.compress(cell.as_buffer(), 1) if cell.is_valid else None for cell in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(data, pa.binary())], ["doc_id", "mark", "text"])

    kind = source.schema["doc_id"].dataType.simpleString()
    d = only(source, "mark", where.select(F.col("mark").alias("key")), pack, f"doc_id {kind}, mark long, text binary").alias("d")
    joined = d.join(where.alias("w"), (F.col("d.mark") == F.col("w.mark")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    out = scratch.keep(joined.select("w.node", "d.text"), "texts")
    scratch.release()
    return out


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """pairs: distinct u, v (nodes). The pairs that link, by whole texts.

    Members are dealt with their leader v, whose text comes first in its group; leaders with many members are split into
    salted groups of about MEMBERS.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = scratch.keep(pairs.groupBy("v").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "groups")
    dealt = pairs.join(groups, "v").select("v", F.pmod(F.xxhash64("u"), "salts").cast("int").alias("salt"), F.col("u").alias("node"))
    lead = groups.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("v").alias("node"))
    wanted = scratch.keep(dealt.unionByName(lead), "wanted")
    found = only(texts, "node", wanted.select(F.col("node").alias("key")))
    rows = wanted.join(found, "node").select("v", "salt", (F.col("node") != F.col("v")).alias("member"), "node", "text")
    rows = rows.repartition(parts, "v", "salt").sortWithinPartitions("v", "salt", "member", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader, last = None, None, None
        for batch in batches:
            v, salt, member, node = (batch.column(c).to_pylist() for c in ("v", "salt", "member", "node"))
            us, vs = [], []
            texts = pa.array([zlib.decompress(x) for x in batch.column("text").to_pylist()], pa.binary())
            for i, own in enumerate(text_sets(texts, size)):
                if (v[i], salt[i]) != group:
                    group, leader, last = (v[i], salt[i]), None, None
                if not member[i]:
                    leader = own
                elif leader is None:
                    raise RuntimeError(f"the text of node {v[i]} did not arrive")
                elif node[i] != last and linked(own, leader, percent):
                    us.append(node[i])
                    vs.append(v[i])
                last = node[i]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    out = scratch.keep(rows.mapInArrow(frugal(work), "u long, v long"), "links")
    scratch.release()
    return out


def reopen(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v, c, lu, lv) whose components are still apart, under their present names. Names are looked up once for
    two components, not for each pair, so pairs that are connected by now cost no join rows."""
    both = pairs.select("lu", "lv").distinct()
    u, v = known.select(F.col("node").alias("lu"), F.col("label").alias("nu")), known.select(F.col("node").alias("lv"), F.col("label").alias("nv"))
    named = both.join(u, "lu", "left").join(v, "lv", "left").select("lu", "lv", F.coalesce("nu", "lu").alias("nu"), F.coalesce("nv", "lv").alias("nv"))
    return pairs.join(named.where("nu <> nv"), ["lu", "lv"]).select("u", "v", "c", F.col("nu").alias("lu"), F.col("nv").alias("lv"))


def decide(pairs: DataFrame, links: DataFrame | None, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, percent: int, scratch: Scratch):
    """Filter and verify pairs (u, v, c). Returns all links so far, the new ones and the components."""
    chosen = scratch.keep(passes_ranges(pairs.select("u", "v", "c"), nodes.select("node", "n", "ranges"), percent, scratch), "chosen")
    scratch.drop("ranges")
    texts = fetch(chosen.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs, id_col, text, scratch)
    new = verify(chosen.select("u", "v"), texts, size, percent, scratch)
    scratch.drop("texts")
    links = new if links is None else links.unionByName(new)
    return links, new, components(links)


def settle(pairs: DataFrame, links: DataFrame | None, known: DataFrame | None, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, percent: int, quotas: tuple, scratch: Scratch):
    """Decide pairs (u, v, c: how promising, lu and lv: components; stored) in rounds until every pair is decided or connected.
    quotas: pairs of two components in each round; then all that are left. Returns links and components.

    The best pairs are taken by a row number under a limit, which Spark also applies before the shuffle: a task sends at most
    the quota of two components, however many pairs they have."""
    best = Window.partitionBy(F.least("lu", "lv"), F.greatest("lu", "lv")).orderBy(F.desc("c"), "u", "v")
    own = Window.partitionBy("u").orderBy(F.desc("c"), "v")
    for quota in (*quotas, None):
        if quota is None:
            now = pairs
        else:
            now = pairs.withColumn("place", F.row_number().over(best if quota else own)).where(F.col("place") <= max(quota, 1)).drop("place")
            now = scratch.keep(now, "now")
        if now.isEmpty():
            break
        links, _, known = decide(now, links, nodes, docs, id_col, text, size, percent, scratch)
        if quota is not None:
            pairs = scratch.keep(reopen(pairs.join(now.select("u", "v"), ["u", "v"], "left_anti"), known), "left")
    return links, known


def crowds(postings: DataFrame) -> DataFrame:
    """gram, c, open: postings of each n-gram, and how many pairs of them are in different components."""
    by_label = postings.groupBy("gram", "label").agg(F.count("*").alias("m"))
    sums = by_label.groupBy("gram").agg(F.sum("m").alias("c"), F.sum(F.col("m").cast("double") * F.col("m")).alias("squares"))
    return sums.select("gram", "c", ((F.col("c").cast("double") * F.col("c") - F.col("squares")) / 2).alias("open"))


def thin_crowds(postings: DataFrame, links: DataFrame | None, known: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text: str, size: int, percent: int, scratch: Scratch):
    """Connects large groups of near copies before the join: while n-grams have many more pairs of different components than
    postings, each node of such an n-gram is verified against a leader of it, picked anew in every round by hash, so that the
    pairs of a round are no more than the postings. Ends when no crowd is left, or with a round of LEADERS leaders an n-gram
    after one that has not closed a quarter of its open pairs: what is left then are nodes that link with few of their group. The
    join that follows is over all pairs that are still open, so nothing depends on how far this comes.

    Components only grow together, so an n-gram that is no crowd does not become one: a round reads the postings of the crowds
    of the round before, and all postings get their new names once, by a table of the components that were merged.

    postings: node, n, label, pos, gram and BITS. Returns the postings without crowds that are in one component now, links,
    components and the pairs (u, v) that were decided (None if none was)."""
    tried, before, last = None, float("inf"), False
    first, crowded, known_before = None, postings, known
    for turn in range(MOST_TURNS):
        crowd = scratch.keep(crowds(crowded).where(F.col("open") > CROWD * F.col("c")).select("gram", "open"), "crowd")
        left = crowd.agg(F.sum("open")).first()[0]
        if left is None or last:
            break
        last = left > 0.75 * before
        before, crowd = left, crowd.select("gram")
        crowded = scratch.keep(crowded.join(crowd, "gram"), f"crowded-{turn}")
        scratch.drop(f"crowded-{turn - 1}")
        first = crowd if first is None else first
        part = F.pmod(F.xxhash64("gram", "node", F.lit(turn)), F.lit(LEADERS if last else 1))
        mark = F.struct(F.xxhash64("node", "gram", F.lit(turn)).alias("mark"), *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "pos", *BITS)])
        leaders = scratch.keep(crowded.groupBy("gram", part.alias("part")).agg(F.min(mark).alias("m")).select("gram", "m.*"), "crowd-leaders")
        rows = crowded.join(leaders, "gram").where(F.col("label") != F.col("label_b"))
        need = _may_link(F.col("n"), F.col("n_b"), percent)
        rows = rows.where(F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) >= need)
        rows = rows.where(percent * F.greatest("n", "n_b").cast("long") <= 100 * F.least("n", "n_b").cast("long"))
        rows = rows.where(_bits_apart("", "_b") <= F.col("n") + F.col("n_b") - 2 * need)
        # as in the join, u is the end with fewer n-grams
        forward = F.struct("n", "node") < F.struct("n_b", "node_b")
        ends = rows.select("node", F.when(forward, F.col("node")).otherwise(F.col("node_b")).alias("u"), F.when(forward, F.col("node_b")).otherwise(F.col("node")).alias("v"))
        pairs = ends.groupBy("node", "u", "v").agg(F.count("*").alias("c"))
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        few = Window.partitionBy("node").orderBy(F.desc("c"), "u", "v")  # at most a prefix's n-grams
        pairs = pairs.withColumn("place", F.row_number().over(few)).where(F.col("place") <= TURN_PAIRS).groupBy("u", "v").agg(F.max("c").alias("c"))
        pairs = scratch.keep(pairs, "crowd-pairs")
        if pairs.isEmpty():
            before = 0
            continue
        links, new, known = decide(pairs, links, nodes, docs, id_col, text, size, percent, scratch)
        tried = pairs.select("u", "v") if tried is None else tried.unionByName(pairs.select("u", "v"))
        if new.isEmpty():
            before = 0
            continue
        crowded = crowded.drop("label").join(known, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), "pos", "gram", *BITS)
    if known is not known_before:
        # least nodes that named a component and do so no longer: no more than the links found here
        merged = known.where("node <> label").join(known_before.where("node <> label"), "node", "left_anti")
        merged = scratch.keep(merged.select(F.col("node").alias("label"), F.col("label").alias("next")), "merged")
        named = postings.join(merged, "label", "left").select("node", "n", F.coalesce("next", "label").alias("label"), "pos", "gram", *BITS)
        closed = named.join(first, "gram").groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high")
        # stored first: a join to a table, not to a sum over the same shuffle, is one whose crowded n-grams can be split
        postings = scratch.keep(named.join(scratch.keep(closed.select("gram"), "closed"), "gram", "left_anti"), "postings-left")
        scratch.drop("postings")
    return postings, links, known, tried


def _may_link(n, m, percent: int):
    """The least overlap of sets of n and m as a column, in whole numbers."""
    x = (n + m).cast("long") * percent + (99 + percent)
    return ((x - x % (100 + percent)) / (100 + percent)).cast("long")


def _bits_apart(a: str, b: str):
    """In how many bits two sets differ, a bound on how many n-grams are in one of them only, as a column."""
    return sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in BITS), F.lit(0))


def passes_ranges(pairs: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The suffix filter on pairs (u, v, c): |a - b| + |b - a| is at least the summed differences of the counts in fixed hash
    ranges (counts over 255 stand for 255, which only lowers the sum), and at most n + m - 2 * least overlap for a link."""
    own = scratch.keep(only(nodes.select("node", "n", "ranges"), "node", pairs.select(F.explode(F.array("u", "v")).alias("key"))), "ranges")
    a = own.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("ranges").alias("ru"))
    b = own.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("ranges").alias("rv"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("nu", "nv"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for c in ("ru", "rv"))
            room = n + m - 2 * least_overlap(n, m, percent)
            yield batch.select(["u", "v", "c"]).filter(pa.array(np.abs(x - y).sum(1) <= room))

    return pairs.join(a, "u").join(b, "v").mapInArrow(frugal(work), "u long, v long, c long")


def _gram_rows(nodes: DataFrame, words: np.ndarray) -> DataFrame:
    """node, n, label, pos, gram and BITS of the prefix n-grams in the bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            grams = np.asarray(lists.flatten())
            count = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(count) - count, count)
            hit = in_bitmap(words, grams)
            take = pa.array(row[hit])
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), "<i8").reshape(-1, len(BITS))[row[hit]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(take), batch.column("n").take(take), batch.column("label").take(take), pa.array(pos[hit].astype(np.int32)), pa.array(grams[hit]),
                 *(pa.array(b) for b in np.ascontiguousarray(bits.T))],
                ["node", "n", "label", "pos", "gram", *BITS],
            )

    return nodes.select("node", "n", "label", "prefix", "bits").mapInArrow(frugal(work), "node long, n int, label long, pos int, gram long" + "".join(f", {c} long" for c in BITS))


def linked_rows(docs: DataFrame, id_col: str, text: str, size: int, percent: int) -> DataFrame:
    """One row a document: doc_id, mark, n, label (the class; null without words), component_id."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "jaccard")
    wide = profiles(docs, id_col, text, size, percent, scratch)
    full = wide.where("n > 0")
    least = scratch.keep(full.groupBy("s1", "s2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "sets")
    # the rows that are not their set's first: few, so the wide rows are not shuffled where that list is small
    repeated = full.select("row", "s1", "s2", "n").join(least.where("copies > 1").select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).where("row <> node").select("row")
    nodes = full.join(scratch.keep(repeated, "repeated"), "row", "left_anti").withColumnRenamed("row", "node").select("node", "doc_id", "mark", "n", "prefix", "ranges", "bits", "keys")
    nodes = scratch.keep(nodes, "nodes")
    rows = materialize(wide.select("doc_id", "mark", "n", "s1", "s2"), "jaccard-rows")
    scratch.drop("profiles")
    scratch.release()

    # stars
    keyed = nodes.select("node", F.posexplode("keys").alias("k", "key"))
    leaders = keyed.groupBy("k", "key").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").select("k", "key", "v")
    stars = keyed.join(scratch.keep(leaders, "leaders"), ["k", "key"]).where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("c"))
    stars = scratch.keep(stars.select("u", "v", "c", F.col("u").alias("lu"), F.col("v").alias("lv")), "stars")
    links, known = settle(stars, None, None, nodes, docs, id_col, text, size, percent, STAR_QUOTAS, scratch)
    if known is None:
        known = spark.createDataFrame([], "node long, label long")

    # prefix join between different components
    named = nodes.select("node", "n", "prefix", "bits").join(known, "node", "left").select("node", "n", "prefix", "bits", F.coalesce("label", "node").alias("label"))
    grams = named.select("label", F.explode("prefix").alias("gram")).groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = scratch.keep(grams.where("low <> high").select("gram"), "mixed")
    scratch.release()
    words = bitmap(mixed.select(F.col("gram").alias("key")))
    postings = scratch.keep(_gram_rows(named, words).join(mixed, "gram").select("node", "n", "label", "pos", "gram", *BITS), "postings")
    postings, links, known, tried = thin_crowds(postings, links, known, nodes, docs, id_col, text, size, percent, scratch)
    a = postings.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "pos", *BITS)])
    b = postings.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "pos", *BITS)])
    overlap = _may_link(F.col("n_a"), F.col("n_b"), percent)
    near = (
        (F.struct("n_a", "node_a") < F.struct("n_b", "node_b"))
        & (F.col("label_a") != F.col("label_b"))
        & (100 * F.col("n_a").cast("long") >= percent * F.col("n_b").cast("long"))
        & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= overlap)
        & (_bits_apart("_a", "_b") <= F.col("n_a") + F.col("n_b") - 2 * overlap)
    )
    # n-grams shared before one that passes `near` stand earlier in both texts and pass too, so c counts all that are shared
    # up to the last one found, and only what follows it is unknown
    matches = a.join(b, "gram").where(near).groupBy(F.col("node_a").alias("u"), F.col("node_b").alias("v")).agg(
        F.count("*").alias("c"), F.first("n_a").alias("nu"), F.first("n_b").alias("nv"), F.first("label_a").alias("lu"), F.first("label_b").alias("lv"),
        F.least(F.first("n_a") - F.max("pos_a"), F.first("n_b") - F.max("pos_b")).alias("from_last"),
    )
    need = _may_link(F.col("nu"), F.col("nv"), percent)
    matches = matches.where(F.col("c") + F.col("from_last") - 1 >= need).select("u", "v", "c", "lu", "lv")
    found = scratch.keep(matches if tried is None else matches.join(tried, ["u", "v"], "left_anti"), "pairs")
    scratch.drop("postings")
    scratch.drop("postings-left")
    scratch.release()
    links, known = settle(found, links, known, nodes, docs, id_col, text, size, percent, PAIR_QUOTAS, scratch)

    classes = scratch.keep(least.join(known, "node", "left").select("s1", "s2", "n", "least_id", F.coalesce("label", "node").alias("label")), "classes")
    # stored first, as above: a large component can be split in the join
    smallest = scratch.keep(classes.groupBy("label").agg(F.min("least_id").alias("component_id")), "smallest")
    classes = materialize(classes.join(smallest, "label").select("s1", "s2", "n", "label", "component_id"), "jaccard-components")
    scratch.close()
    return (
        rows.select("doc_id", "mark", "n", "s1", "s2")
        .join(classes, ["s1", "s2", "n"], "left")
        .select("doc_id", "mark", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    return linked_rows(docs, id_col, text, size, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, all columns as they were: the row with the least id (then text hash).

    Documents without words belong to no class and all stay. Only where the chosen row is repeated are texts shuffled to
    drop the repeats.
    """
    rows = linked_rows(docs, id_col, text, size, percent)
    counted = rows.groupBy("label", "doc_id", "mark", (F.col("n") == 0).alias("bare")).agg(F.count("*").alias("c"))
    best = counted.where("not bare").groupBy("label").agg(F.min(F.struct("doc_id", "mark", "c")).alias("m")).select("m.*", F.lit(False).alias("bare"))
    kept = best.unionByName(counted.where("bare").select("doc_id", "mark", "c", "bare"))
    kept = materialize(kept.select("doc_id", "mark", "c", "bare"), "jaccard-kept").alias("k")
    d = docs.alias("d")
    joined = d.join(kept, (F.xxhash64(F.col(f"d.`{text}`")) == F.col("k.mark")) & F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.doc_id")))
    rows = joined.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), "k.doc_id", "k.mark", (F.col("k.bare") | (F.col("k.c") == 1)).alias("single"))
    once = rows.where(~F.col("single")).dropDuplicates(["doc_id", "mark"])
    return rows.where("single").select("row.*").unionByName(once.select("row.*"))
