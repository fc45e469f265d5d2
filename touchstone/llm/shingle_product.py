"""Jaccard join of word shingles as a blocked sparse product: overlap counts on rare shingles, size bounds, exact checks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import (chunks, components, discard, distinct_per_row, mixed, partitions, settle, shingles, string_buffers,
                                   whole_text, words)

SKETCH_BITS = 20  # shingle counts are kept in 2^20 buckets: 8 MB whatever the corpus
SLICES = 64
NO_ID = 1 << 62  # nodes of documents without an id start here
EXTRA = 8  # shingles more than the least that a pair across components must share among its rarest
FOLLOWERS = 256  # of one leader that a task's group checks


def node(df: DataFrame) -> Column:
    """The document's id; a document without one goes by its text."""
    by_text = F.lit(NO_ID) + F.xxhash64(whole_text(df)).bitwiseAND(F.lit(NO_ID - 1))
    return F.coalesce(df["doc_id"].cast("long"), by_text)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, sorted distinct shingles and their counts per row, chunk by chunk."""
    data, offsets = string_buffers(batch["text"])
    for lo, hi in chunks(offsets):
        part = offsets[lo:hi + 1] - offsets[lo]
        h, row = distinct_per_row(*shingles(*words(data[offsets[lo]:offsets[hi]], part), width))
        yield lo, hi, h, np.bincount(row, minlength=hi - lo)


def _profile(width: int):
    """One row per document (node, size, digest of its set) and, at the end, the task's shingle counts by bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            nodes = np.asarray(batch["node"])
            for lo, hi, h, n in _sets(batch, width):
                np.add.at(counts, h >> np.uint64(64 - SKETCH_BITS), 1) if len(h) < 1000 else counts.__iadd__(
                    np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS))
                d1, d2 = _digests(h, n)
                yield _rows(hi - lo, doc_id=batch["doc_id"].slice(lo, hi - lo), node=nodes[lo:hi], n=n, d1=d1, d2=d2, **_parities(h, n))
        for s, part in enumerate(np.split(counts, SLICES)):
            if part.any():
                yield _rows(1, slice=np.array([s]), counts=pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()))

    return go


PARITY = [f"p{i}" for i in range(8)]  # 512 bits
_PROFILE = pa.schema([(c, pa.int64()) for c in ("doc_id", "node", "n", "d1", "d2", *PARITY, "slice")] + [("counts", pa.binary())])
_PROFILE_SQL = ", ".join(f"{f.name} {'binary' if f.name == 'counts' else 'bigint'}" for f in _PROFILE)


def _rows(rows: int, /, **columns) -> pa.RecordBatch:
    have = {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(
        [have[f.name].cast(f.type) if f.name in have else pa.nulls(rows, f.type) for f in _PROFILE], schema=_PROFILE)


def _digests(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's set; zero for an empty one."""
    d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        start = np.r_[0, np.cumsum(n)][some]
        d1[some] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), start)
        d2[some] = np.bitwise_xor.reduceat(mixed(h + np.uint64(0x14057B7EF767814F)), start)
    return d1.view(np.int64), d2.view(np.int64)


def _parities(h: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """512 bits per set, each the parity of the shingles hashed to it: two sets differ in as many shingles as bits, or more."""
    bits = 64 * len(PARITY)
    bit = (mixed(h ^ np.uint64(0x1B873593CC9E2D51)) >> np.uint64(64 - 9)).astype(np.int64)
    row, start = np.repeat(np.arange(len(n)), n), np.r_[0, np.cumsum(n)]
    out = np.zeros((len(n), len(PARITY)), np.int64)
    for lo in range(0, len(n), 2000):
        hi = min(lo + 2000, len(n))
        part = slice(start[lo], start[hi])
        odd = np.bincount((row[part] - lo) * bits + bit[part], minlength=(hi - lo) * bits).reshape(-1, bits) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    return {c: out[:, i] for i, c in enumerate(PARITY)}


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, blob in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.int64)
            total[s] = total[s] + part if s in total else part
    for s, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])


def _prefixes(width: int, percent: int, sketch):
    """The rarest shingles of each set: any two linked sets share one of them.

    Sets that are equal within a batch are represented once; the others are linked by their digest.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            nodes, seen = np.asarray(batch["node"]), set()
            for lo, hi, h, n in _sets(batch, width):
                new = np.zeros(hi - lo, bool)
                for i, key in enumerate(zip(n.tolist(), *[d.tolist() for d in _digests(h, n)], strict=True)):
                    if key[0] and key not in seen:
                        seen.add(key)
                        new[i] = True
                row = np.repeat(np.arange(hi - lo), n)
                h, row = h[new[row]], row[new[row]]
                seen_in = counts[h >> np.uint64(64 - SKETCH_BITS)]
                m = np.where(new, n, 0)
                common = np.bincount(row, np.log2(1 + seen_in), minlength=hi - lo) / np.maximum(m, 1)
                order = np.lexsort((h, seen_in, row))
                h, row = h[order], row[order]
                place = np.arange(len(h)) - np.repeat(np.cumsum(m) - m, m)
                keep = place < _prefix(n, percent)[row]
                h, row, place = h[keep], row[keep], place[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array(nodes[lo:hi][row]), pa.array(place.astype(np.int32)),
                     pa.array((common[row] * 1000).astype(np.int32))], ["token", "n", "node", "place", "common"])

    return go


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _stars(percent: int):
    """Postings of two and more rows, each row with the head of its star.

    Rows come sorted by (token, n, node).  A token's rows are cut into bands of sizes that can link; the head of a band is
    the set with the most common shingles, as an unedited original has them: most copies link to it, though not to each
    other.  Every Arrow batch stands alone: its first and last token may go on elsewhere and are marked, so that a token
    found everywhere becomes a tree of stars.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n, at, place, common = (np.asarray(batch[c]) for c in ("token", "n", "node", "place", "common"))
            if not len(token):
                continue
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[start, len(token)])
            open_ended = np.zeros(len(start), bool)
            open_ended[[0, -1]] = True
            band = np.repeat(start, size)
            last = start + size - 1
            wide = n[last].astype(np.int64) * percent > n[start].astype(np.int64) * 100
            for s, e in zip(start[wide], last[wide] + 1, strict=True):
                while s < e:  # the next band starts at the first set too large for this one's smallest
                    end = s + int(np.searchsorted(n[s:e].astype(np.int64) * percent, int(n[s]) * 100, side="right"))
                    band[s:end] = s
                    s = end
            best = np.lexsort((at, -common, band))
            first = np.r_[True, band[best][1:] != band[best][:-1]]
            head = np.repeat(best[first], np.diff(np.r_[np.flatnonzero(first), len(band)]))  # bands lie in order
            keep = np.repeat((size > 1) | open_ended, size)
            edge = np.repeat(open_ended, size)
            columns = (token, n, at, place, at[head], n[head], place[head], common[head], edge)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], _POSTING)

    return go


_POSTING = ["token", "n", "node", "place", "head", "head_n", "head_place", "head_common", "edge"]
_POSTING_SQL = ("token bigint, n int, node bigint, place int, head bigint, head_n int, head_place int, head_common int, edge boolean")


def _overlaps(width: int):
    """Rows sorted by (a, salt, follows): the leader's text, then its followers'; exact overlaps leave."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            a, salt, follows, at = (np.asarray(batch[c]) for c in ("a", "salt", "follows", "node"))
            out = []
            for lo, hi, h, n in _sets(batch, width):
                for i, own in zip(range(lo, hi), np.split(h, np.cumsum(n)[:-1]), strict=True):
                    if (a[i], salt[i]) != group:
                        group, leaders = (a[i], salt[i]), []
                    if not follows[i]:
                        leaders.append(own)
                        continue
                    for lead in leaders:
                        where = np.searchsorted(lead, own)
                        where[where == len(lead)] = 0
                        both = int((lead[where] == own).sum()) if len(lead) else 0
                        out.append((a[i], at[i], both, len(lead), len(own)))
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "both", "n_a", "n_b"])

    return go


def checked(texts: DataFrame, edges: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact test of candidate pairs (``a``, ``b``): ``linked`` and the distance 1 - J.

    A leader's followers are dealt into groups of about FOLLOWERS, each with its own copy of the leader's text, so that a
    leader of very many is spread over tasks.
    """
    edges = settle(edges)
    groups = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("groups"))
    leaders = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(False).alias("follows"),
                            F.col("a").alias("node"))
    followers = edges.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"),
                                               F.lit(True).alias("follows"), F.col("b").alias("node"))
    # Both sides are shuffled at every size: the pairs grow with the corpus.
    rows = leaders.union(followers).hint("merge").join(texts, "node").select("a", "salt", "follows", "node", "text")
    out = (rows.repartition(partitions(texts.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "follows", "node")
           .mapInArrow(_overlaps(width), "a bigint, b bigint, both bigint, n_a bigint, n_b bigint"))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    held = settle(out.groupBy("a", "b").agg(
        F.max(F.col("both") * 100 >= union * percent).alias("linked"),
        F.when(F.count(F.lit(1)) == 1, F.max(1 - F.col("both") / union)).alias("distance")))
    discard(edges)
    return held


def _residual(postings: DataFrame, roots: DataFrame, tested: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share rare shingles, lie in different components so far and can still be linked.

    Overlap counts on the rare shingles are accumulated per pair.  A pair falls away if its sizes, its count, its parity
    bits or its distances to a common head (Jaccard distance is a metric) rule a link out.
    """
    here = (postings.select("token", "n", "node", "place", "head").join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    by_root = here.groupBy("token", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed_tokens = (by_root.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("major"), F.count(F.lit(1)).alias("roots"))
                    .where("roots > 1").select("token", "major"))
    dist = tested.select(F.col("a").alias("head"), F.col("b").alias("node"), "distance")
    # The bits of a node with one set; several versions under one id are not told apart by them.
    one = sets.groupBy("node").agg(F.count_distinct("n", "d1", "d2").alias("versions"), *[F.min(c).alias(c) for c in PARITY])
    one = one.where("versions = 1").select("node", *PARITY)
    rows = settle(here.join(mixed_tokens, "token").join(dist, ["head", "node"], "left").join(one, "node", "left")
                  .withColumn("distance", F.when(F.col("head") == F.col("node"), 0.0).otherwise(F.col("distance"))))
    left = rows.where("root <> major").select(*[F.col(c).alias(f"l_{c}") for c in ("token", "n", "node", "place", "head", "root", "distance", *PARITY)])
    far = 1 - percent / 100 + 1e-9
    # A link shares `need` shingles.  Of the first n - need + 1 + more shingles of either set at least 1 + more are then
    # shared, for as many more as both postings hold.
    need = f"cast(ceil({percent} * (l_n + n) / {100 + percent}) as int)"
    more = f"least({EXTRA}, {need} - cast(ceil({percent} * greatest(l_n, n) / 100) as int))"
    pairs = left.join(rows, F.expr(
        f"l_token = token and l_root <> root and (root = major or l_node < node) "
        f"and least(l_n, n) * 100 >= greatest(l_n, n) * {percent} "
        f"and coalesce({' + '.join(f'bit_count(l_{c} ^ {c})' for c in PARITY)}, 0) <= l_n + n - 2 * {need} "
        f"and l_place <= l_n - {need} + {more} and place <= n - {need} + {more} "
        f"and not (l_head = head and coalesce(abs(l_distance - distance), 0) > {far})"))
    counted = pairs.groupBy(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max(F.expr(more)).alias("more"))
    return counted.where("shared > more").select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Near duplicates by the Jaccard similarity of distinct ``width``-word shingles, ``percent`` of the union or more.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id that links reach).
    No link between different sets is lost: components are exact, though not every pair inside one is listed.

    1. Sizes, digests of the sets and counts of shingles by bucket; equal sets are linked by digest.
    2. Each set's ``n - ceil(percent n) + 1`` shingles with the lowest bucket counts are posted: linked sets share one.
       Postings are range-partitioned by (shingle, size), and every row is paired with the head of its star only.
    3. Star pairs are checked exactly; links give components.
    4. What is left are pairs across components: their overlap counts are accumulated over the postings, pairs below the
       bounds that their sizes give are discarded, the rest is checked exactly.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words is one shingle.  Null and empty texts
    have none and link with nothing.  Rows that share a doc_id are versions of one document and in one component; rows
    without an id go by their text, and their component_id is null unless they link to one with an id.  Shingles are
    64-bit hashes.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(node(docs).alias("node"), whole_text(docs).alias("text"))
    profile = settle(docs.select(F.col("doc_id").cast("long"), node(docs).alias("node"), whole_text(docs).alias("text"))
                     .mapInArrow(_profile(width), _PROFILE_SQL))
    sketch = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    slices = (profile.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
              .mapInArrow(_sum_slices, "slice bigint, counts binary"))
    for r in slices.collect():  # SLICES rows, 8 MB
        sketch[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    shared = spark.sparkContext.broadcast(sketch.ravel())
    sets = profile.where("slice is null")

    classes = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copies = (sets.join(classes, ["n", "d1", "d2"]).where("node <> a").select("a", F.col("node").alias("b")))

    tokens = texts.mapInArrow(_prefixes(width, percent, shared), "token bigint, n int, node bigint, place int, common int")
    postings = settle(
        tokens.repartitionByRange(partitions(spark), "token", "n", "node").sortWithinPartitions("token", "n", "node")
        .mapInArrow(_stars(percent), _POSTING_SQL))
    # A shared shingle proves nothing new if it lies behind the first n - need + 1 of either set.
    need = f"cast(ceil({percent} * (n + head_n) / {100 + percent}) as int)"
    stars = (postings.where(f"node <> head and place <= n - {need} and head_place <= head_n - {need}")
             .select(F.col("head").alias("x"), F.col("node").alias("y")))
    heads = postings.where("edge").select("token", F.col("head").alias("y"), F.col("head_n").alias("y_n"), "head_common").distinct()
    first = (heads.groupBy("token").agg(F.max(F.struct("head_common", F.col("y").alias("x"), F.col("y_n").alias("x_n"))).alias("f"))
             .select("token", "f.x", "f.x_n"))
    trees = heads.join(first, "token").where(f"x <> y and least(x_n, y_n) * 100 >= greatest(x_n, y_n) * {percent}").select("x", "y")
    edges = stars.union(trees).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    tested = checked(texts, edges, width, percent)

    links = tested.where("linked").select("a", "b").union(copies)
    roots = components(links)
    rest = settle(_residual(postings, roots, tested, sets, percent))
    if rest.limit(1).count():
        more = checked(texts, rest, width, percent)
        between = more.where("linked").select("a", "b")
        for column in ("a", "b"):
            between = (between.join(roots.withColumnsRenamed({"node": column, "root": "r"}), column, "left")
                       .withColumn(column, F.coalesce("r", column)).drop("r"))
        merged = components(between)
        roots = settle(
            roots.union(merged.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti"))
            .join(merged.select(F.col("root").alias("top"), F.col("node").alias("root")), "root", "left")
            .select("node", F.coalesce("top", "root").alias("root")))
    discard(postings)
    root = F.when(F.col("n") == 0, F.col("doc_id")).when(F.coalesce("root", "node") < NO_ID, F.coalesce("root", "node"))
    return sets.join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))


def one_per_group(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The documents, all their columns, of which one stays of each near-duplicate group: the one with the smallest doc_id.

    Documents without an id stay unless their group has one with an id; of rows repeated under one id all stay.
    """
    found = jaccard_components(docs, width, percent)
    losers = found.where("component_id is not null and not (doc_id <=> component_id)")
    by_id = losers.where("doc_id is not null").select("doc_id").distinct()
    return docs.join(by_id, "doc_id", "left_anti").select(*docs.columns)
