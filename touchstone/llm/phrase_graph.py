"""Collocations from a weighted de Bruijn graph of words: five-word edges are counted, shorter counts follow from node flow."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchstone.llm.common import _BYTE, _LOWER, _STEP, _power, chunks, discard, mixed, partitions, settle, string_buffers, whole_text
from touchstone.settings import leaf_bytes

LONGEST = 5
HELD_WORDS = 1 << 20  # words that a task holds before it combines them
PAIR_BYTES = 64 << 20  # of the hashes of frequent pairs that tasks may be sent
BUCKET_BYTES = 8 << 20  # input bytes for each bucket of the tables of counts

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True


# ---- grams of a block, as columns of word numbers over a dictionary of word hashes


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, piece, row, begin and end of each word of the texts, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    inside = ~_GAP[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("up", n)[:n], out=total[1:])
    h = mixed((total[end] - total[begin]) * _power("down", n)[begin] + (end - begin).astype(np.uint64))
    row = np.searchsorted(offsets, begin, side="right") - 1
    return h, np.cumsum(_PIECE[data])[begin] + row, row, begin, end


def _combined(columns: list[np.ndarray], weights: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with the sums of their weights; entries are below ``size``."""
    bits = max(1, int(size).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for at in range(0, len(columns), per):
        key = np.zeros(len(weights), np.int64)
        for c in columns[at:at + per]:
            key = (key << bits) | c
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    begin = np.zeros(len(order), bool)
    begin[:1] = True
    for key in keys:
        begin[1:] |= key[order[1:]] != key[order[:-1]]
    begin = np.flatnonzero(begin)
    return [c[order[begin]] for c in columns], np.add.reduceat(weights[order], begin) if len(begin) else weights[:0]


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(words: np.ndarray, columns: list[np.ndarray], weights: np.ndarray) -> bytes:
    """Rows and the hashes of their words as bytes."""
    used = np.zeros(len(words), bool)
    for c in columns:
        used[c] = True
    number = np.cumsum(used) - 1
    parts = [_narrow(number[c]) for c in columns] + [_narrow(weights)]
    wide = max(p.itemsize for p in parts[:-1])
    parts[:-1] = [p.astype(f"u{wide}") for p in parts[:-1]]
    head = struct.pack("<QQBBB", len(weights), int(used.sum()), len(columns), wide, parts[-1].itemsize)
    raw = words[used].tobytes() + b"".join(p.tobytes() for p in parts)
    return head + struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    rows, used, columns, wide, heavy = struct.unpack_from("<QQBBB", blob)
    length, = struct.unpack_from("<Q", blob, 19)
    raw = pa.decompress(blob[27:], decompressed_size=length, codec="zstd", asbytes=True)
    at = 8 * used
    out = []
    for size in [wide] * columns + [heavy]:
        out.append(np.frombuffer(raw, f"u{size}", rows, at).astype(np.int64))
        at += rows * size
    return np.frombuffer(raw, np.uint64, used), out[:-1], out[-1]


TABLE = "size int, bucket int, lang string, blob binary, words array<bigint>, names array<string>, f bigint"
_FIELDS = ["size", "bucket", "lang", "blob", "words", "names", "f"]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()]


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f, [None] * n), type=t) for f, t in zip(_FIELDS, _TYPES, strict=True)], _FIELDS)


def _spread(lang: str, words: np.ndarray, columns: list[np.ndarray], weights: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows by buckets of the whole gram, so that no first word, however frequent, makes a large one."""
    if not len(weights):
        return
    h = np.zeros(len(weights), np.uint64)
    for c, step in zip(columns, _STEP):
        h += words[c] * step
    bucket = ((mixed(h) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.r_[bucket[order[1:]] != bucket[order[:-1]], True]) + 1
    at = 0
    for end in ends.tolist():
        pick = order[at:end]
        yield _rows(size=[len(columns)], bucket=[int(bucket[pick[0]])], lang=[lang],
                    blob=[_pack(words, [c[pick] for c in columns], weights[pick])])
        at = end


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _STEP[0] + second * _STEP[1])


def _edges(longest: int, buckets: int, most: int, pairs=None, spell: bool = True):
    """Of each block: the longest gram at every word, up to the end of its path, with counts; and its words' spellings.

    A path ends with its piece and, where the frequent ``pairs`` are known, before a pair that is not among them.
    """

    def block(lang: str, held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in held])
        piece = np.concatenate([x[1] for x in held])
        names = {}
        for x in held:
            names.update(x[2])
        words, number = np.unique(h, return_inverse=True)
        number = number.astype(np.int64)
        n = len(number)
        path = piece
        if pairs is not None and n > 1:
            known = pairs.value
            h = _pairs(h[:-1], h[1:])
            at = np.searchsorted(known, h)
            linked = known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(n - 1, bool)
            path = np.r_[0, np.cumsum(~linked | (piece[1:] != piece[:-1]))]
        columns, size = [number], np.ones(n, np.int64)
        for k in range(1, longest):
            then = np.zeros(n, np.int64)
            on = np.zeros(n, bool)
            on[:max(0, n - k)] = path[k:] == path[:max(0, n - k)]
            then[:max(0, n - k)] = number[k:]
            columns.append(then)
            size += on
        for s in range(1 if spell else longest, longest + 1):
            pick = size == s
            part, weights = _combined([c[pick] for c in columns[:s]], np.ones(int(pick.sum()), np.int64), len(words))
            yield from _spread(lang, words, part, weights, buckets)
        if spell:
            keys = np.array(list(names), np.uint64).view(np.int64).tolist()
            yield _rows(size=[0], lang=[lang], words=[keys], names=[list(names.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total, base = 0, 0
        for batch in batches:
            langs = batch["lang"].to_pylist()
            data, offsets = string_buffers(batch["text"])
            for lo, hi in chunks(offsets):
                text = data[offsets[lo]:offsets[hi]]
                h, piece, row, begin, end = _words(text, offsets[lo:hi + 1] - offsets[lo])
                if not len(h):
                    continue
                low = _LOWER[text].tobytes()
                numbers = {lang: i for i, lang in enumerate(dict.fromkeys(langs[lo:hi]))}
                owner = np.array([numbers[lang] for lang in langs[lo:hi]])[row]
                for lang, i in numbers.items():
                    mine = owner == i
                    if not mine.any():
                        continue
                    names = {}
                    if spell:
                        distinct, at = np.unique(h[mine], return_index=True)
                        b, e = begin[mine][at].tolist(), end[mine][at].tolist()
                        names = {k: low[i:j].decode("utf-8", "replace") for k, i, j in zip(distinct.tolist(), b, e, strict=True)}
                    held.setdefault(lang, []).append((h[mine], piece[mine] + base, names))
                total += len(h)
                base += int(piece[-1]) + hi - lo + 2
                if total >= most:
                    for lang, parts in held.items():
                        yield from block(lang, parts)
                    held, total = {}, 0
        for lang, parts in held.items():
            yield from block(lang, parts)

    return run


def _level(size: int, least: int, buckets: int, flow_on: bool = True):
    """Counts of all grams of ``size`` words in a bucket; the frequent ones leave as rows, the flow of their first words as blobs."""

    def merged(lang: str, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b) for b in blobs]
        words = np.unique(np.concatenate([p[0] for p in parts]))
        places = [np.searchsorted(words, p[0]) for p in parts]
        columns = [np.concatenate([at[p[1][k]] for at, p in zip(places, parts, strict=True)]) for k in range(size)]
        columns, f = _combined(columns, np.concatenate([p[2] for p in parts]), len(words))
        often = np.flatnonzero(f >= least)
        if len(often):
            spelled = np.column_stack([words[c[often]].view(np.int64) for c in columns])
            yield _rows(size=[size] * len(often), lang=[lang] * len(often), words=spelled.tolist(), f=f[often].tolist())
        if size == 1:
            yield _rows(size=[0], lang=[lang], f=[int(f.sum())])
        elif flow_on:
            heads, flow = _combined(columns[:-1], f, len(words))
            yield from _spread(lang, words, heads, flow, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, lang, blob in zip(batch["bucket"].to_pylist(), batch["lang"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if (bucket, lang) != at and held:
                    yield from merged(at[1], held)
                    held = []
                at = bucket, lang
                held.append(blob)
        if held:
            yield from merged(at[1], held)

    return run


def _placed(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.select("bucket", "lang", "blob").repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "lang")


def _frequent_pairs(text: DataFrame, least: int, buckets: int, tasks: int) -> np.ndarray | None:
    """Sorted hashes of all neighbouring pairs of words that occur ``least`` times in a language; None beyond PAIR_BYTES.

    Phrases that occur as often consist of such pairs, so all other pairs may end a path.
    """
    rows = text.mapInArrow(_edges(2, buckets, HELD_WORDS, spell=False), TABLE)
    found = settle(_placed(rows, tasks).mapInArrow(_level(2, least, buckets, False), TABLE).select("words"))
    try:
        if found.count() * 8 > PAIR_BYTES:
            return None
        both = np.array([r["words"] for r in found.collect()], np.int64).reshape(-1, 2).view(np.uint64)
        return np.unique(_pairs(both[:, 0].copy(), both[:, 1].copy()))
    finally:
        discard(found)


def frequent_grams(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``longest`` words that occur ``least`` times or more in a language.

    Returns ``grams`` (``lang``, ``words``, ``f``; words as 64-bit hashes), ``totals`` (``lang``, ``n``) and ``names``
    (``word``, ``name`` of every word of a phrase; two spellings under a hash are an error).

    The graph's nodes are phrases of ``longest`` - 1 words and its edges those of ``longest``.  Edges are counted once over
    the corpus: blocks combine their own, then buckets of whole grams.  Every shorter phrase is a node whose count is the
    flow of its edges to the next word plus the times a path ends with it, so each level needs only the level above and
    the path ends of its own length.

    A path is a piece, cut before each pair of words that is too rare for a phrase: a first reading counts pairs, and their
    hashes go to the tasks if they fit ``PAIR_BYTES``.  Otherwise paths are whole pieces.  Both give the same counts.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark), -(-leaf_bytes(docs) // BUCKET_BYTES))
    tasks = max(partitions(spark), 1)
    text = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), whole_text(docs).alias("text"))
    known = _frequent_pairs(text, least, buckets, tasks)
    pairs = spark.sparkContext.broadcast(known) if known is not None else None
    edges = settle(text.mapInArrow(_edges(longest, buckets, HELD_WORDS, pairs), TABLE))
    found, above, old = [], None, []
    for size in range(longest, 0, -1):
        rows = edges.filter(F.col("size") == size)
        if above is not None:
            rows = rows.union(above.filter(F.col("blob").isNotNull()))
        above = settle(_placed(rows, tasks).mapInArrow(_level(size, least, buckets), TABLE))
        old.append(above)
        found.append(above.filter(F.col("blob").isNull()))
    rows = reduce(DataFrame.union, found)
    grams = settle(rows.filter("size > 0").select("lang", "words", "f"))
    totals = settle(above.filter("size = 0").groupBy("lang").agg(F.sum("f").alias("n")))
    wanted = grams.filter(F.size("words") > 1).select(F.explode("words").alias("word")).distinct()
    spelled = edges.filter("size = 0").select(F.explode(F.arrays_zip("words", "names")).alias("z")).select(F.col("z.words").alias("word"), F.col("z.names").alias("name"))
    spelled = spelled.groupBy("word").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    names = settle(spelled.join(wanted, "word", "left_semi").select("word", F.when(F.col("name") == F.col("other"), F.col("name")).otherwise(
                       F.raise_error(F.lit("two words share a hash"))).alias("name")))
    for table in (edges, *old):
        discard(table)
    return grams, totals, names


def _compacted(grams: DataFrame, share: int) -> DataFrame:
    """Phrases that one edge carries on: ``share`` per cent or more of a node's flow passes one longer phrase.

    One word more decides: a phrase inside a longer one of that count is inside one of one word more with no smaller count.
    """
    size = F.size("words")
    parts = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    longer = grams.filter(size > 2).select("lang", "f", F.explode(parts).alias("words")).groupBy("lang", "words").agg(F.max("f").alias("most"))
    return grams.filter(size > 1).join(longer, ["lang", "words"]).filter(100 * F.col("most") >= share * F.col("f")).select("lang", "words")


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, share: int = 100, top: int | None = 2000) -> DataFrame:
    """Collocations of each language: ``lang, rank, phrase, a, l, r, n, score``, the first ``top`` (None: all).

    Texts, A-Z lower-cased, fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``.  ``a`` is how
    often a phrase of 2 to ``longest`` words occurs, ``l`` and ``r`` its parts at the cut that scores lowest (ties: after
    fewer words), ``n`` all words of the language, ``score`` floor(1000 a n / (l r)).  Phrases that a longer one carries on
    (:func:`_compacted`) go.  Products are decimals of 38 digits, exact up to 10^19 words.

    A null lang is ``und``; null and empty texts have no words; repeated rows count again; other columns are ignored,
    whatever their names; an empty table gives no rows.  Counts cover all texts; only reporting has a limit.
    """
    grams, totals, names = frequent_grams(docs, least, longest)
    size = F.size("words")
    phrases = grams.filter(size > 1).join(_compacted(grams, share), ["lang", "words"], "left_anti")
    cuts = phrases.withColumnRenamed("f", "a").withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("first", F.slice("words", F.lit(1), F.col("k"))).withColumn("rest", F.slice("words", F.col("k") + 1, size))
    left = grams.select("lang", F.col("words").alias("first"), F.col("f").alias("l"))
    right = grams.select("lang", F.col("words").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")

    def whole(column: Column) -> Column:
        return column.cast("decimal(19,0)")

    above, below = (whole(F.col("a")) * whole(1000 * F.col("n"))), whole(F.col("l")) * whole(F.col("r"))
    scored = cuts.withColumn("above", above).withColumn("below", below).withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spelled = best.select("lang", "words", F.posexplode("words").alias("at", "word")).join(names, "word")
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    out = best.join(spelled, ["lang", "words"]).select(
        "lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order).cast("long"))
    out = out.filter(F.col("rank") <= top) if top is not None else out
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
with p as (select coalesce(lang, 'und') as lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
x as (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(ws) >= k),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as a from x group by all),
t as (select lang, sum(a) as n from g where k = 1 group by 1),
c as (select * from g where k > 1 and a >= 100),
keep as (select * from c where not exists (
  select 1 from c as o where o.lang = c.lang and o.k > c.k and 100 * o.a >= 100 * c.a
    and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
u as (select keep.*, string_split(phrase, ' ') as ws, unnest(range(1, k)) as cut from keep),
s as (select u.lang, u.phrase, u.a, fl.a as l, fr.a as r, n, cut,
             (1000::hugeint * u.a * n::hugeint) // (fl.a::hugeint * fr.a) as score
      from u join t using (lang)
      join g as fl on fl.lang = u.lang and fl.phrase = array_to_string(ws[1:cut], ' ')
      join g as fr on fr.lang = u.lang and fr.phrase = array_to_string(ws[cut + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
       cast(n as bigint) as n, cast(score as bigint) as score
from o where rank <= 2000
"""
