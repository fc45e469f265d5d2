"""String columns: letters, runs, edits and distances as JVM expressions.

Letters are taken by splitting a string once; ``substring`` at growing offsets would rescan a
UTF-8 string from its start for every position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchstone.functions.numeric import col
from touchstone.functions.tables import CODONS, literal_map


def letters(text) -> Column:
    """The characters of a string as an array; empty string gives an empty array."""
    t = col(text)
    return F.filter(F.split(t, ""), lambda c: c != "")


def positions(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def windows(text, k: int, alphabet: str = "[\\s\\S]") -> Column:
    """All overlapping windows of k letters of the alphabet class, in order."""
    return F.regexp_extract_all(col(text), F.lit(f"(?=({alphabet}{{{k}}}))"), F.lit(1))


def sanitize(text, alphabet: str = "ACGTN") -> Column:
    """Upper-case and keep only the alphabet, after dropping <...> tokens."""
    return F.regexp_replace(F.upper(F.regexp_replace(col(text), "<[^>]*>", "")), f"[^{alphabet}]", "")


def longest_run(text) -> Column:
    """Length of the longest run of one repeated character; only runs of two or more are taken out of the text."""
    runs = F.regexp_extract_all(col(text), F.lit(r"(?s)(.)\1+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.when(F.length(col(text)) > 0, 1).otherwise(0))


def longest_run_fraction(text) -> Column:
    return F.try_divide(longest_run(text), F.length(col(text)))


def is_degenerate(text, limit: float = 0.3, fraction: Column | None = None) -> Column:
    """Empty, or dominated by one repeated character; ``fraction`` where the longest run's share is already a column."""
    fraction = longest_run_fraction(text) if fraction is None else fraction
    return (F.length(col(text)) == 0) | F.coalesce(fraction > limit, F.lit(True))


def gc_fraction(text) -> Column:
    t = col(text)
    return F.try_divide(F.length(F.regexp_replace(t, "[^GC]", "")), F.length(t))


def cpg_fraction(text) -> Column:
    """Share of neighbouring pairs that are C followed by G."""
    t = col(text)
    hits = (F.length(t) - F.length(F.regexp_replace(t, "CG", ""))) / 2
    return F.try_divide(hits, F.length(t) - 1)


def letter_share(text, letter: str) -> Column:
    """Occurrences of one letter over the length."""
    t = col(text)
    return F.try_divide(F.length(t) - F.length(F.replace(t, F.lit(letter), F.lit(""))), F.length(t))


def mean_of_letters(text, values: dict) -> Column:
    """Mean of a per-letter property; letters without a value count as 0."""
    table = literal_map(values)
    total = F.aggregate(letters(text), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_element_at(table, c), F.lit(0.0)))
    return F.try_divide(total, F.length(col(text)))


def hamming(a, b) -> Column:
    """Mismatches between strings of equal length; null for unequal lengths."""
    a, b = col(a), col(b)
    count = F.aggregate(
        F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda acc, v: acc + v
    )
    return F.when(F.length(a) == F.length(b), count)


def identity(a, b) -> Column:
    """Share of equal positions of equal-length strings, else 1 - edit distance / longer length."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(F.length(a) == F.length(b), 1 - F.try_divide(hamming(a, b), F.length(a))).otherwise(
        1 - F.try_divide(F.levenshtein(a, b), longest)
    )


def position_key(text, places: list[int]) -> Column:
    """The letters at fixed 1-based places as one string."""
    return F.concat(*[F.substring(col(text), p, 1) for p in places])


def reverse_complement(text) -> Column:
    return F.reverse(F.translate(col(text), "ACGT", "TGCA"))


def rotate(text, k: int) -> Column:
    """Cyclic rotation by k letters."""
    t = col(text)
    return F.concat(t.substr(F.lit(k + 1), F.length(t)), F.substring(t, 1, k))


def blocks(text, size: int, tail: bool = False) -> Column:
    """The string cut into consecutive whole blocks of ``size`` letters; with ``tail`` the rest is a last, shorter one."""
    least = 1 if tail else size
    return F.regexp_extract_all(col(text), F.lit(f"([\\s\\S]{{{least},{size}}})"), F.lit(1))


def translate_codons(text, to_stop: bool = True) -> Column:
    """Codons to amino-acid letters (unknown codons X), ending before the first stop."""
    table = literal_map(CODONS)
    protein = F.transform(blocks(text, 3), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    if to_stop:
        stop = F.array_position(protein, "*")
        protein = F.when(stop > 0, F.slice(protein, F.lit(1), (stop - 1).cast("int"))).otherwise(protein)
    return F.array_join(protein, "")


def chunk_bounds(flank: int, chunk: int) -> list[tuple[int, int, int]]:
    """(index, near, far) distances of equal chunks going out from an anchor."""
    if flank % chunk:
        raise ValueError("the flank must be a whole number of chunks")
    return [(i, i * chunk, (i + 1) * chunk) for i in range(flank // chunk)]


def chunk_inputs(text, start, end, flank: int | None, chunk: int) -> Column:
    """Array of (chunk_index, text): the span [start, end) with its i-th chunk on both sides.

    ``flank`` letters on both sides must be there, and with none there is one entry, the bare span.  ``flank`` None goes to
    both ends of the text: the outermost chunks may be short, or empty where the other side is longer.  Offsets are 0-based
    columns.
    """
    t, s, e = col(text), col(start).cast("int"), col(end).cast("int")
    core = t.substr(s + 1, e - s)
    if flank == 0:
        return F.array(F.struct(F.lit(0).alias("chunk"), core.alias("text")))
    if flank is None:
        longest = F.greatest(s, F.length(t) - e, F.lit(1))

        def part(i: Column) -> Column:
            far = F.greatest(s - (i + 1) * chunk, F.lit(0))
            before = t.substr(far + 1, F.greatest(s - i * chunk - far, F.lit(0)))
            return F.struct(i.alias("chunk"), F.concat(before, core, t.substr(e + i * chunk + 1, F.lit(chunk))).alias("text"))

        return F.transform(F.sequence(F.lit(0), (F.ceil(longest / chunk) - 1).cast("int")), part)
    parts = []
    for i, near, far in chunk_bounds(flank, chunk):
        before = t.substr(s - F.lit(far) + 1, F.lit(chunk))
        after = t.substr(e + F.lit(near) + 1, F.lit(chunk))
        parts.append(F.struct(F.lit(i).alias("chunk"), F.concat(before, core, after).alias("text")))
    whole = (s >= flank) & (F.length(t) - e >= flank)
    return F.when(whole, F.array(*parts)).otherwise(F.array().cast("array<struct<chunk:int,text:string>>"))


def fold_context(five, ref, alt, three) -> Column:
    """Substitution channel ``X[R>A]Y`` folded onto the strand with a pyrimidine reference."""
    five, ref, alt, three = (col(c) for c in (five, ref, alt, three))
    comp = lambda c: F.translate(c, "ACGT", "TGCA")
    direct = F.concat(five, F.lit("["), ref, F.lit(">"), alt, F.lit("]"), three)
    folded = F.concat(comp(three), F.lit("["), comp(ref), F.lit(">"), comp(alt), F.lit("]"), comp(five))
    return F.when(ref.isin("C", "T"), direct).otherwise(folded)


def substitutions(a, b) -> Column:
    """Channels of all mismatches between equal-length strings with plain A, C, G, T around them."""
    a, b = col(a), col(b)
    # Both texts are cut into letters once: as the one element of an array they are bound, not spelled out in every step.
    both = F.array(F.struct(letters(a).alias("x"), letters(b).alias("y")))
    inner = F.when(F.length(a) >= 3, F.sequence(F.lit(1), F.length(a) - 2)).otherwise(F.array().cast("array<int>"))
    window = F.flatten(F.transform(both, lambda p: F.transform(inner, lambda i: F.struct(
        F.get(p["x"], i - 1).alias("five"), F.get(p["x"], i).alias("ref"), F.get(p["x"], i + 1).alias("three"),
        F.concat(F.get(p["y"], i - 1), F.get(p["y"], i), F.get(p["y"], i + 1)).alias("other"), F.get(p["y"], i).alias("alt")))))
    plain = lambda w: (F.concat(w["five"], w["ref"], w["three"], w["other"]).rlike("^[ACGT]{6}$")) & (w["ref"] != w["alt"])
    found = F.transform(F.filter(window, plain), lambda w: fold_context(w["five"], w["ref"], w["alt"], w["three"]))
    return F.when(F.length(a) == F.length(b), found).otherwise(F.array().cast("array<string>"))
