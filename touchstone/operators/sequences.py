"""Counting models over letters: k-mers, positional frequencies, Markov chains.

Texts are turned into n-grams inside the scan stage and counted per (text, n-gram) before any
shuffle, so that the rows that move are distinct n-grams, not letters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions import edits as ed
from touchstone.functions.numeric import col
from touchstone.functions.tables import AMINO_ACIDS, CHARGE, HYDROPATHY, VOLUME
from touchstone.functions.text import letter_share, letters, windows
from touchstone.operators.running import numbered, with_scalars
from touchstone.settings import cut_lineage, spread


def kmer_counts(df, key: str, text, k: int, alphabet: str = "[ACGT]") -> DataFrame:
    """(key, kmer, n, share): counts of windows made of the alphabet only, and their share."""
    rows = spread(df.select(key, col(text).alias("__text")))
    grams = rows.select(key, F.explode(windows("__text", k, alphabet)).alias("kmer"))
    counts = grams.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("__total"))
    return counts.join(totals, key).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def positional_frequencies(df, label: str, text, pseudocount: float = 1.0, alphabet: Sequence[str] = "ACGT") -> DataFrame:
    """(label, pos, letter, logp, log_prior) of every letter at every place, per class."""
    size = len(alphabet)
    places = df.select(label, F.posexplode(letters(text)).alias("pos", "letter"))
    seen = places.filter(F.col("letter").isin(*alphabet)).groupBy(label, "pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__rows"))
    # Class sizes as one row: the number of classes is the label's own range, not the data's size.
    listed = classes.agg(
        F.collect_list(F.struct(F.col(label), F.col("__rows"))).alias("__classes"), F.sum("__rows").alias("__all"))
    alphabet_col = F.explode(F.array(*[F.lit(a) for a in alphabet]))
    # Every (class, place, letter) cell exists even when unseen.
    cells = with_scalars(seen.select("pos").distinct(), listed).withColumn("__c", F.explode("__classes"))
    cells = cells.select("pos", F.col(f"__c.{label}").alias(label), F.col("__c.__rows").alias("__rows"), "__all", alphabet_col.alias("letter"))
    totals = seen.groupBy(label, "pos").agg(F.sum("n").alias("__t"))
    out = cells.join(seen, [label, "pos", "letter"], "left").join(totals, [label, "pos"], "left")
    mass = F.coalesce("n", F.lit(0)) + pseudocount
    return out.select(
        label, "pos", "letter",
        F.log(mass / (F.coalesce("__t", F.lit(0)) + size * pseudocount)).alias("logp"),
        F.log(F.col("__rows") / F.col("__all")).alias("log_prior"),
    )


def pwm_scores(df, key: str, text, model: DataFrame, label: str) -> DataFrame:
    """(key, label, score): summed positional log-frequency plus log prior per class."""
    places = df.select(key, F.posexplode(letters(text)).alias("pos", "letter"))
    hit = places.join(model, ["pos", "letter"])
    return hit.groupBy(key, label).agg((F.sum("logp") + F.max("log_prior")).alias("score"))


def pwm_log_odds(df, key, text, model, label, positive, negative) -> DataFrame:
    """Two-class log-odds of the positional model."""
    scores = pwm_scores(df, key, text, model, label)
    pick = lambda c: F.max(F.when(F.col(label) == c, F.col("score")))
    return scores.groupBy(key).agg((pick(positive) - pick(negative)).alias("log_odds"))


def transition_counts(df, key: str, text, order: int, period: int = 1, alphabet: str = "ACGT") -> DataFrame:
    """(key, phase, context, letter, n): transitions with all letters in the alphabet.

    The phase is the place of the predicted letter modulo ``period``.
    """
    rows = spread(df.select(key, col(text).alias("__text")))
    grams = rows.select(key, F.posexplode(windows("__text", order + 1)).alias("__at", "__gram"))
    plain = grams.filter(F.col("__gram").rlike(f"^[{alphabet}]{{{order + 1}}}$")).select(
        key, ((F.col("__at") + order) % period).alias("phase"),
        F.substring("__gram", 1, order).alias("context"), F.substring("__gram", order + 1, 1).alias("letter"))
    return plain.groupBy(key, "phase", "context", "letter").agg(F.count(F.lit(1)).alias("n"))


DENSE_CELLS = 1 << 20


def _transitions(order: int, period: int, alphabet: str):
    """Of a batch of texts: (text number, cell, n) of its transitions, cell = (phase, context, letter) as one number.  Texts
    that are not told ``apart`` are all number 0."""
    size, places = len(alphabet), order + 1
    code = np.full(0x110000, -1, np.int32)
    code[[ord(c) for c in alphabet]] = np.arange(size)
    cells = period * size**places

    def count(texts: list[str | None], apart: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(t or "") for t in texts], np.int64)
        joined = "".join(t or "" for t in texts)
        try:  # a byte a letter where it will do
            letter = code[np.frombuffer(joined.encode("latin-1"), np.uint8)]
        except UnicodeEncodeError:
            letter = code[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(letter) - order
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none
        ends = np.cumsum(length)
        ok = np.ones(n, bool)
        for j in range(1, places):  # a transition that ends in the next text is none
            over = ends - j
            ok[over[(over >= 0) & (over < n)]] = False
        cell = np.zeros(n, np.int64)
        for j in range(places):
            ok &= letter[j:j + n] >= 0
            cell = cell * size + letter[j:j + n]
        row = np.repeat(np.arange(len(texts)), length) if apart or period > 1 else None
        if period > 1:
            at = np.arange(n) - (ends - length)[row[:n]]
            cell += (at + order) % period * size**places
        found = cell[ok]
        if not apart:
            counts = np.bincount(found, minlength=cells)
            keys = np.flatnonzero(counts)
            return np.zeros(len(keys), np.int64), keys, counts[keys]
        found += row[:n][ok] * cells
        if len(texts) * cells <= 4 * n:  # counting all cells of all texts is cheaper than sorting
            counts = np.bincount(found, minlength=len(texts) * cells)
            keys = np.flatnonzero(counts)
            return keys // cells, keys % cells, counts[keys]
        keys, counts = np.unique(found, return_counts=True)
        return keys // cells, keys % cells, counts

    return count


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of a batch's texts of about ``most`` letters."""
    texts = batch["text"].to_pylist()
    at = 0
    while at < len(texts):
        end, letters_ = at, 0
        while end < len(texts) and (end == at or letters_ + len(texts[end] or "") <= most):
            letters_ += len(texts[end] or "")
            end += 1
        yield at, end, texts[at:end]
        at = end


def _dense_markov(df, extra, text, order, period, alphabet, pseudocount, fit, leave_one_out, corpus, corpus_text) -> DataFrame:
    size = len(alphabet)
    cells = period * size ** (order + 1)
    count = _transitions(order, period, alphabet)
    total = np.zeros(cells)
    if fit == "corpus":
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(cells, np.int64)
            for batch in batches:
                for _, _, texts in _slices(batch):
                    _, cell, n = count(texts, apart=False)
                    own += np.bincount(cell, weights=n, minlength=cells).astype(np.int64)
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used])], ["cell", "n"])

        parts = spread(corpus.select(col(corpus_text).alias("text"))).mapInArrow(summed, "cell bigint, n bigint")
        found = parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most DENSE_CELLS rows
        if found:
            total[[r["cell"] for r in found]] = [r["n"] for r in found]
    contexts = total.reshape(-1, size).sum(1)
    own_fit, less = fit == "self", leave_one_out

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _slices(batch):
                row, cell, n = count(texts)
                if not len(row):
                    continue
                place, at = np.unique(row * (cells // size) + cell // size, return_inverse=True)
                own = np.bincount(at, weights=n)
                context = place % (cells // size)
                fitted = n if own_fit else total[cell] - (n if less else 0)
                around = own if own_fit else contexts[context] - (own if less else 0)
                mass = np.bincount(row, weights=n * np.log(fitted + pseudocount), minlength=hi - lo)
                mass -= np.bincount(place // (cells // size), weights=own * np.log(around + size * pseudocount), minlength=hi - lo)
                steps = np.bincount(row, weights=n, minlength=hi - lo).astype(np.int64)
                have = np.flatnonzero(steps)
                take = pa.array(have + lo)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[e].take(take) for e in extra], pa.array(steps[have]), pa.array(mass[have] / steps[have])], [*extra, "transitions", "score"])

    rows = spread(df.select(*extra, col(text).alias("text")) if "text" not in extra else df.select(*extra))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*extra).schema.fields)
    return rows.mapInArrow(scored, f"{kinds}, transitions bigint, score double")


def markov_scores(
    df, key: str, text, order: int, period: int = 1, alphabet: str = "ACGT", pseudocount: float = 1.0,
    fit: str = "corpus", leave_one_out: bool = False, corpus: DataFrame | None = None, corpus_text=None,
    score_key: str | None = None,
) -> DataFrame:
    """Mean log-probability per predicted letter under counts with a pseudocount.

    ``fit="self"`` counts each text alone; ``fit="corpus"`` counts all of ``corpus`` (default:
    the scored texts).  With ``leave_one_out`` a text's own corpus entry (same key) is taken out
    of the totals.  ``score_key`` names a finer key when several texts are scored per corpus
    entry (a text and its perturbations).

    A model of up to ``DENSE_CELLS`` transitions, a bound on alphabet and order and not on texts, is one vector that tasks
    add up and get back: two passes over the texts without a shuffle of their rows.  Larger models are joined.
    """
    size = len(alphabet)
    extra = [key] if score_key is None else [key, score_key]
    alone = corpus is None and score_key is None
    if period * size ** (order + 1) <= DENSE_CELLS and (alone or fit == "corpus" and not leave_one_out):
        return _dense_markov(df, extra, text, order, period, alphabet, pseudocount, fit, leave_one_out, df if corpus is None else corpus, text if corpus is None else corpus_text or text)
    cells, place = ["phase", "context", "letter"], ["phase", "context"]
    tagged = df.select(F.struct(*extra).alias("__unit"), col(text).alias("__text")) if score_key else df.select(key, col(text).alias("__text"))
    mine = transition_counts(tagged, "__unit" if score_key else key, "__text", order, period, alphabet)
    if score_key:
        mine = mine.select(*[F.col(f"__unit.{e}").alias(e) for e in extra], *cells, "n")
    # Counts are used several times, and the optimiser pushes different null filters into each use,
    # so the exchange would not be shared: they are written once instead of read from text again.
    mine = cut_lineage(mine)
    same = corpus is None and score_key is None
    own = mine if same else cut_lineage(transition_counts(corpus if corpus is not None else df, key, corpus_text or text, order, period, alphabet))
    # The score is a sum over cells less a sum over contexts, so the two never need to meet on rows:
    #   sum n ln(c + a) - sum n_ctx ln(c_ctx + a V), where c leaves a text's own counts out if asked.
    my_ctx = mine.groupBy(*extra, *place).agg(F.sum("n").alias("n"))
    own_ctx = my_ctx if same else own.groupBy(key, *place).agg(F.sum("n").alias("n"))
    if fit == "self":
        cell_sum = _log_mass(mine, own, None, [key, *cells], cells, same, extra, pseudocount, False)
        ctx_sum = _log_mass(my_ctx, own_ctx, None, [key, *place], place, same, extra, size * pseudocount, False)
    else:
        total = own.groupBy(*cells).agg(F.sum("n").alias("__all"))
        total_ctx = total.groupBy(*place).agg(F.sum("__all").alias("__all"))
        cell_sum = _log_mass(mine, own, total, [key, *cells], cells, same, extra, pseudocount, leave_one_out)
        ctx_sum = _log_mass(my_ctx, own_ctx, total_ctx, [key, *place], place, same, extra, size * pseudocount, leave_one_out)
    both = cell_sum.join(ctx_sum.select(*extra, F.col("__s").alias("__c")), extra)
    return both.select(*extra, F.col("__n").alias("transitions"), ((F.col("__s") - F.col("__c")) / F.col("__n")).alias("score"))


def _log_mass(rows, own, total, own_keys, total_keys, same, extra, add, leave_out) -> DataFrame:
    """Per text: n and the sum of n ln(count + add) under the fitted counts.

    ``total`` None fits each text on its own counts.  When the fitted texts are the scored ones
    (``same``), a row's own count is its n and needs no join.
    """
    mine = F.col("n")
    need_own = total is None or leave_out
    if need_own and not same:
        rows = rows.join(own.withColumnRenamed("n", "__own"), own_keys, "left")
        mine = F.coalesce("__own", F.lit(0))
    if total is None:
        count = mine
    else:
        # One row per cell of the model: the optimiser broadcasts it when it measures it as small.
        rows = rows.join(total, total_keys, "left")
        count = F.coalesce("__all", F.lit(0)) - (mine if leave_out else F.lit(0))
    return rows.groupBy(*extra).agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.log(count + add)).alias("__s"))


def bigram_scores(df, key: str, tokens: Column, alpha: float = 0.5, vocabulary: int | None = None) -> DataFrame:
    """Mean log-probability per token under the corpus's own bigrams with start and end marks."""
    padded = F.concat(F.array(F.lit("\x02")), tokens, F.array(F.lit("\x03")))
    listed = df.select(key, padded.alias("__t"))
    pairs = listed.select(key, F.explode(F.transform(
        F.slice("__t", F.lit(1), F.size("__t") - 1), lambda a, i: F.struct(a.alias("prev"), F.get("__t", i + 1).alias("next")))).alias("p"))
    own = pairs.groupBy(key, F.col("p.prev").alias("prev"), F.col("p.next").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("prev", "next").agg(F.sum("n").alias("c"))
    context = total.groupBy("prev").agg(F.sum("c").alias("ctx"))
    if vocabulary is None:
        # Distinct tokens plus the two marks; one row.
        size = own.select("next").distinct().agg((F.count(F.lit(1)) + 1).alias("__v"))
        context = with_scalars(context, size)
    else:
        context = context.withColumn("__v", F.lit(vocabulary))
    joined = own.join(total, ["prev", "next"]).join(context, "prev")
    logp = F.log((F.col("c") + alpha) / (F.col("ctx") + alpha * F.col("__v")))
    return joined.groupBy(key).agg(F.sum("n").alias("steps"), (F.sum(F.col("n") * logp) / F.sum("n")).alias("score"))


def entropy_of_scores(df, unit: Sequence[str], position: str, score: str, min_support: int = 3) -> DataFrame:
    """Per unit: mean and deviation over positions of the entropy of a softmax of scores.

    The unchanged letter joins each position at score 0.  Positions with fewer than
    ``min_support`` scores or a non-finite one are left out.
    """
    unit = list(unit)
    from touchstone.functions.numeric import finite

    per = [*unit, position]
    peaks = df.groupBy(*per).agg(
        F.greatest(F.max(F.col(score).cast("double")), F.lit(0.0)).alias("__m"), F.count(F.lit(1)).alias("__n"),
        F.min(finite(score).cast("int")).alias("__ok"))
    kept = peaks.filter((F.col("__n") >= min_support) & (F.col("__ok") == 1))
    e = F.exp(F.col(score) - F.col("__m"))
    sums = df.join(kept, per).groupBy(*per).agg(
        F.max("__m").alias("__m"), F.sum(e).alias("__z"), F.sum(e * (F.col(score) - F.col("__m"))).alias("__ez"))
    # H = ln Z - E[s - m], with the reference letter's own term exp(-m) added to both.
    ref = F.exp(-F.col("__m"))
    z = F.col("__z") + ref
    ent = sums.withColumn("__h", F.log(z) - (F.col("__ez") - ref * F.col("__m")) / z)
    return ent.groupBy(*unit).agg(
        F.avg("__h").alias("entropy_mean"), F.stddev_pop("__h").alias("entropy_sd"), F.count(F.lit(1)).alias("n_positions"))


# ---- feature vectors


def composition_features(df, key: str, text: str, alphabet: Sequence[str] = AMINO_ACIDS) -> DataFrame:
    """Letter shares and length, each divided by its population deviation over the table."""
    names = [f"f_{a}" for a in alphabet] + ["f_length"]
    raw = df.select(key, *[letter_share(text, a).alias(f"f_{a}") for a in alphabet], F.length(text).cast("double").alias("f_length"))
    sds = raw.agg(*[F.stddev_pop(n).alias(f"sd_{n}") for n in names])  # one row
    scaled = with_scalars(raw, sds)
    return scaled.select(key, *[F.when(F.col(f"sd_{n}") > 1e-9, F.col(n) / F.col(f"sd_{n}")).otherwise(F.col(n)).alias(n) for n in names])


def letter_vectors(df, key: str, text: str, length: int | None = None, alphabet: Sequence[str] = "ACGT") -> DataFrame:
    """Indicator vector of the letter at each place, up to the longest text or a ``length`` that no text may pass."""
    if length is None:
        length = df.agg(F.max(F.length(text))).first()[0] or 1
    size = len(alphabet)
    # A letter's cells are one constant, looked up once a place and not once a cell.
    cells_of = lambda i: F.array(*[F.lit(1.0 if j == i else 0.0) for j in range(size)])
    known = F.create_map(*[v for i, a in enumerate(alphabet) for v in (F.lit(a), cells_of(i))])
    fits = F.when(F.length(text) > length, F.raise_error(F.lit(f"a text has more than {length} letters")).cast("array<array<double>>"))
    places = F.coalesce(fits, F.transform(letters(text), lambda c: F.coalesce(F.try_element_at(known, c), cells_of(-1))))
    padded = F.concat(F.coalesce(places, F.array().cast("array<array<double>>")), F.array_repeat(cells_of(-1), length))
    cells = F.flatten(F.slice(padded, 1, length))
    return spread(df).select(key, array_to_vector(cells).alias("features"))


def edit_vocabulary(df, edits: str, fields: Sequence[str] = ("pos", "mut")) -> DataFrame:
    """Distinct edit keys with a dense 0-based index, in sorted order."""
    keys = df.select(F.explode(edits).alias("e")).select(*[F.col(f"e.{f}").alias(f) for f in fields]).distinct()
    return numbered(keys, [], list(fields), "__rn").select(*fields, (F.col("__rn") - 1).cast("int").alias("index"))


def onehot_edits(df, key: str, edits: str, vocabulary: DataFrame, fields=("pos", "mut")) -> DataFrame:
    """(key, indices, values): sparse indicator of each row's edits over the vocabulary."""
    rows = df.select(key, F.explode_outer(edits).alias("e")).select(key, *[F.col(f"e.{f}").alias(f) for f in fields])
    hit = rows.join(vocabulary, list(fields), "left")
    counts = hit.groupBy(key, "index").agg(F.lit(1.0).alias("v"))
    return counts.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("index").isNotNull(), F.struct("index", "v")))).alias("f")).select(
        key, F.col("f.index").alias("indices"), F.col("f.v").alias("values"))


def factorized_features(df, key: str, edits: str, pair_table: dict | None = None) -> DataFrame:
    """Long features (key, feature, value) of an additive decomposition of edit lists.

    Indicators of position, stated letter and new letter, four property sums scaled by their
    population deviation, and the edit count.  Zero entries are left out.
    """
    one = df.select(key, F.explode(edits).alias("e"))
    marks = one.select(key, F.explode(F.array(
        F.concat(F.lit("pos:"), F.col("e.pos").cast("string")), F.concat(F.lit("wt:"), F.col("e.wt")),
        F.concat(F.lit("mut:"), F.col("e.mut")))).alias("feature"))
    known = "^(pos:.*|(wt|mut):[" + AMINO_ACIDS + "])$"
    counts = marks.filter(F.col("feature").rlike(known)).groupBy(key, "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))
    scalars = df.select(
        key, ed.pair_sum(edits, pair_table or {}).alias("pair"), ed.property_shift(edits, HYDROPATHY).alias("hydropathy"),
        ed.property_shift(edits, VOLUME).alias("volume"), ed.property_shift(edits, CHARGE).alias("charge"),
        F.size(edits).cast("double").alias("count"))
    names = ["pair", "hydropathy", "volume", "charge"]
    sds = scalars.agg(*[F.stddev_pop(n).alias(f"sd_{n}") for n in names])
    scaled = with_scalars(scalars, sds).select(
        key, "count", *[F.when(F.col(f"sd_{n}") > 1e-9, F.col(n) / F.col(f"sd_{n}")).otherwise(F.col(n)).alias(n) for n in names])
    long = scaled.unpivot([key], [*names, "count"], "feature", "value").filter("value <> 0")
    return counts.unionByName(long)


def edit_descriptors(df, key: str, edits: str, pair_table: dict) -> DataFrame:
    """Five scalars per edit list: pair score, signed and absolute hydropathy and volume change."""
    return df.select(
        key, ed.pair_sum(edits, pair_table).alias("pair"),
        ed.property_shift(edits, HYDROPATHY).alias("d_hydropathy"), ed.property_shift(edits, VOLUME).alias("d_volume"),
        ed.property_shift(edits, HYDROPATHY, True).alias("abs_hydropathy"), ed.property_shift(edits, VOLUME, True).alias("abs_volume"))


def property_comparison(df, key: str, a: str, b: str, values: dict = HYDROPATHY, pair_table: dict | None = None) -> DataFrame:
    """Over aligned places of two strings: substitutions, mean pair score, mean |property change|.

    Places with X or * on either side are skipped; places run to the shorter length.
    """
    from touchstone.functions.tables import literal_map

    table = literal_map(values)
    n = F.least(F.length(a), F.length(b))
    zipped = F.arrays_zip(F.slice(letters(a), F.lit(1), n).alias("x"), F.slice(letters(b), F.lit(1), n).alias("y"))
    pairs = F.filter(zipped, lambda p: (p["x"] != p["y"]) & ~p["x"].isin("X", "*") & ~p["y"].isin("X", "*"))
    one = df.select(key, F.explode_outer(pairs).alias("p"))
    change = F.abs(F.try_element_at(table, F.col("p.x")) - F.try_element_at(table, F.col("p.y")))
    score = F.lit(None).cast("double")
    if pair_table:
        score = F.try_element_at(literal_map({x + y: float(v) for (x, y), v in pair_table.items()}), F.concat("p.x", "p.y"))
    return one.groupBy(key).agg(F.count("p").alias("substitutions"), F.avg(score).alias("mean_pair"), F.avg(change).alias("mean_abs_change"))


def cheap_scores(df, mode: str, edits: str = "edits", text: str = "sequence", score: str | None = None, pair_table: dict | None = None) -> DataFrame:
    """Baseline columns that know nothing of the target, by campaign mode."""
    from touchstone.functions.text import mean_of_letters

    if mode == "sequence":
        return df.withColumns({"seq_len": F.length(text), "mean_hydropathy": mean_of_letters(text, HYDROPATHY)})
    out = df.withColumns({
        "n_mut": ed.edit_count(edits), "pair_score": ed.pair_sum(edits, pair_table or {}),
        "hydropathy": ed.property_shift(edits, HYDROPATHY)})
    return out.withColumn("score_per_edit", ed.per_edit(score, edits)) if score else out


def recover_offset(df, group: Sequence[str], edits: str, reference: str, reach: int = 60) -> DataFrame:
    """Per group: the numbering offset in [-reach, reach] under which most stated letters agree.

    Ties go to the smallest offset.  Claims are counted per (position, letter) first, so the
    offsets multiply distinct claims only.
    """
    group = list(group)
    claims = df.select(*group, reference, F.explode(edits).alias("e")).groupBy(
        *group, reference, F.col("e.wt").alias("wt"), F.col("e.pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    tried = claims.withColumn("offset", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    at = F.col("pos") + F.col("offset")
    ok = (at >= 1) & (at <= F.length(reference)) & (F.col(reference).substr(F.greatest(at, F.lit(1)), F.lit(1)) == F.col("wt"))
    hits = tried.groupBy(*group, "offset").agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("claims"))
    best = hits.groupBy(*group).agg(F.max_by(F.struct("offset", "hits", "claims"), F.struct(F.col("hits"), -F.col("offset"))).alias("b"))
    return best.select(*group, "b.*").withColumn("match_rate", F.try_divide("hits", "claims"))


def mismatched_claims(df, group, edits: str, reference: str, offset: str) -> DataFrame:
    """Distinct claims that still disagree with the reference at the given offset."""
    rows = df.select(*group, reference, offset, F.explode(edits).alias("e"))
    at = F.col("e.pos") + F.col(offset)
    ok = (at >= 1) & (at <= F.length(reference)) & (F.col(reference).substr(F.greatest(at, F.lit(1)), F.lit(1)) == F.col("e.wt"))
    return rows.filter(~ok).select(*group, F.concat(F.col("e.wt"), F.col("e.pos").cast("string"), F.col("e.mut")).alias("claim")).distinct()


def reference_from_variants(df, group: Sequence[str], text: str, edits: str) -> DataFrame:
    """Per group: the reference string implied by reverting edits, and how many versions disagree."""
    implied = df.select(*group, ed.revert_edit(text, edits).alias("__ref"))
    counts = implied.groupBy(*group, "__ref").agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*group).agg(
        F.max_by("__ref", F.struct(F.col("__n"), F.col("__ref"))).alias("reference"), F.count(F.lit(1)).alias("versions"))


def single_edit_grid(df, group: Sequence[str], reference: str, alphabet: Sequence[str] = AMINO_ACIDS, listed: DataFrame | None = None) -> DataFrame:
    """All one-letter substitutions of each reference, without those already listed (group, name)."""
    places = df.select(*group, F.posexplode(letters(reference)).alias("__i", "wt"))
    grid = places.withColumn("mut", F.explode(F.array(*[F.lit(a) for a in alphabet]))).filter("wt <> mut")
    named = grid.select(*group, F.concat("wt", (F.col("__i") + 1).cast("string"), "mut").alias("name"))
    return named.join(listed, [*group, "name"], "left_anti") if listed is not None else named
