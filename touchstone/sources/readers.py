"""Readers.  Each is a thin file scan over a transform that works on any DataFrame of raw records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.functions.edits import parse_edits
from touchstone.functions.numeric import clean, keyed_int
from touchstone.operators.running import attach
from touchstone.operators.vectors import unit

# Columns of a campaign table with a reserved meaning.
RESERVED = ("variant", "fitness", "round", "sequence", "n_mut", "seq_len", "id", "mean_hydropathy", "edits",
            "esm2_wtm", "esm2_per_mut", "blosum62", "hydropathy")

# ---- campaign tables


def campaign(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, notes) of a campaign table.

    With ``variant`` rows are edits of one scaffold: unparseable names are dropped and counted and
    ``edits`` / ``n_mut`` are added.  With ``sequence`` rows are distinct items: ``seq_len`` is added
    and the name falls back to ``id`` or a content key.  A missing ``fitness`` column means that
    every row is a candidate.  ``notes`` has one row.
    """
    rows = raw if "fitness" in raw.columns else raw.withColumn("fitness", F.lit(None).cast("double"))
    rows = rows.withColumn("fitness", clean(F.col("fitness").try_cast("double")))
    if "variant" in rows.columns:
        mode, marked = "variant", rows.withColumn("edits", parse_edits("variant"))
        kept = marked.filter(F.col("edits").isNotNull()).withColumn("n_mut", F.size("edits"))
        bad = F.sum(F.col("edits").isNull().cast("long"))
    elif "sequence" in rows.columns:
        mode, marked = "sequence", rows
        name = F.col("id").cast("string") if "id" in rows.columns else F.concat(F.lit("seq-"), F.md5("sequence"))
        kept = marked.filter(F.col("sequence").isNotNull()).withColumn("variant", name).withColumn("n_mut", F.lit(None).cast("int")).withColumn("seq_len", F.length("sequence"))
        bad = F.lit(0).cast("long")
    else:
        raise ValueError("need a 'variant' column (edits of one scaffold) or a 'sequence' column (distinct items)")
    good = F.col("edits").isNotNull() if mode == "variant" else F.col("sequence").isNotNull()
    conditions = sorted(set(kept.columns) - set(RESERVED))
    notes = marked.agg(
        F.lit(mode).alias("mode"), F.coalesce(bad, F.lit(0)).alias("unparseable"),
        F.sum((good & F.col("fitness").isNotNull()).cast("long")).alias("n_measured"),
        F.sum((good & F.col("fitness").isNull()).cast("long")).alias("n_candidates"))
    return kept, notes.withColumn("conditions", F.array(*[F.lit(c) for c in conditions]).cast("array<string>"))


def read_campaign(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Campaign CSV with a header.  Give a schema in production; inference reads the file twice."""
    reader = spark.read.option("header", True)
    return campaign((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


# ---- text records


def fasta_records(raw: DataFrame, column: str = "value") -> DataFrame:
    """(id, description, seq) from texts cut at ``>``: a header line, then lines to concatenate."""
    parts = raw.select(F.split(F.col(column), "\r?\n", 2).alias("p")).filter(F.trim(F.col("p")[0]) != "")
    head, body = F.get("p", F.lit(0)), F.coalesce(F.get("p", F.lit(1)), F.lit(""))
    return parts.select(
        F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\s*\S+", "")).alias("description"),
        F.regexp_replace(body, r"\s", "").alias("seq"))


def split_fasta(raw: DataFrame, column: str) -> DataFrame:
    """Whole FASTA texts to one row per record body."""
    return raw.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(column)), "\n>")).alias("value")).filter(F.trim("value") != "")


def read_fasta(spark, path: str) -> DataFrame:
    """Records of FASTA files; the scan splits where a line starts with ``>``, so one big file is read in parallel."""
    records = spark.read.option("lineSep", "\n>").text(path)
    return fasta_records(records.withColumn("value", F.regexp_replace("value", "^>", "")))


def read_delimited(spark, path: str, sep: str = ",", schema: str | None = None, header: bool = True, partitions: int | None = None) -> DataFrame:
    """Delimited text, gzip included.  A gzip file is one task to read: give ``partitions`` to spread its rows."""
    reader = spark.read.option("header", header).option("sep", sep)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return rows.repartition(partitions) if partitions else rows


def file_stem(column: Column, suffix: str = r"\.[^.]*(\.gz)?$") -> Column:
    """Name of the file without folders and suffix."""
    return F.regexp_replace(F.regexp_extract(column, r"([^/]+)$", 1), suffix, "")


def read_study_files(spark, paths: Sequence[str], key: str, fmt: str = "csv", unit_name: str = "study") -> tuple[DataFrame, DataFrame]:
    """One table per file, united by column name, with the study taken from the file name.

    Files without the key column are left out and listed in the second result.
    """
    kept, skipped = [], []
    for path in sorted(paths):  # file headers only; the rows stay distributed
        reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
        rows = reader.format(fmt).load(path)
        if key in rows.columns:
            kept.append(rows.withColumn(unit_name, file_stem(F.lit(path))))
        else:
            skipped.append((file_name(path),))
    if not kept:
        raise ValueError(f"no file has the column {key!r}")
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
    return together, spark.createDataFrame(skipped, f"{unit_name} string")


def file_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


def well_formed(raw: DataFrame, code: str, pattern: str, values: Sequence[str], limit: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): rows whose code is well formed and whose values are numbers within the limit.

    Sub-header and aggregate rows fail the pattern; drops are counted by reason.
    """
    numbers = raw.withColumns({v: F.col(v).cast("string").try_cast("double") for v in values})
    out_of_range = F.exists(F.array(*[F.col(v) for v in values]), lambda v: F.abs(v) > limit)
    missing = F.forall(F.array(*[F.col(v) for v in values]), lambda v: v.isNull())
    reason = F.when(~F.coalesce(F.trim(F.col(code)).rlike(pattern), F.lit(False)), "malformed code").when(missing, "no value").when(F.coalesce(out_of_range, F.lit(False)), "outlier")
    marked = numbers.withColumn("__why", reason)
    drops = marked.groupBy(F.coalesce("__why", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    return marked.filter(F.col("__why").isNull()).drop("__why"), drops


def best_by_key(raw: DataFrame, key: str, value: str, length: int, one_in: int = 1, seed: int = 0, way: str = "min") -> DataFrame:
    """Best value per key among keys of one length that a hash keeps.

    The filter runs in the scan and the minimum is combined on the map side.
    """
    keep = F.length(key) == length
    if one_in > 1:
        keep = keep & (F.pmod(keyed_int(seed, key), F.lit(one_in)) == 0)
    pick = F.min(value) if way == "min" else F.max(value)
    return raw.filter(keep).groupBy(key).agg(pick.alias(value), F.count(F.lit(1)).alias("seen"))


def read_best_by_key(spark, path: str, schema: str, key: str, value: str, length: int, sep: str = "\t", one_in: int = 1) -> DataFrame:
    return best_by_key(spark.read.option("sep", sep).option("comment", "#").schema(schema).csv(path), key, value, length, one_in)


def with_coordinates(rows: DataFrame, name: str = "name", text: str = "sequence") -> DataFrame:
    """Chromosome, start and end out of ``chr:start-end``, and the text in upper case."""
    pattern = r"(\w+):(\d+)-(\d+)"
    at = lambda i: F.regexp_extract(name, pattern, i)
    return rows.withColumns({
        "chrom": F.nullif(at(1), F.lit("")), "start": at(2).try_cast("long"), "end": at(3).try_cast("long"), text: F.upper(text)})


def read_splits(spark, train: str, test: str, name: str = "name", text: str = "sequence") -> DataFrame:
    parts = [spark.read.parquet(p).withColumn("split", F.lit(s)) for p, s in ((train, "train"), (test, "test"))]
    return with_coordinates(parts[0].unionByName(parts[1]), name, text)


def gff_intervals(raw: DataFrame, column: str = "value", feature: str = "CDS") -> DataFrame:
    """(contig, start, end) of one feature kind of GFF lines, 0-based half-open."""
    f = F.split(F.col(column), "\t")
    part = lambda i: F.get(f, F.lit(i))
    rows = raw.filter(~F.col(column).startswith("#") & (part(2) == feature))
    return rows.select(part(0).alias("contig"), (part(3).try_cast("long") - 1).alias("start"), part(4).try_cast("long").alias("end")).filter("start IS NOT NULL AND end IS NOT NULL")


def range_intervals(raw: DataFrame, key: str, column: str) -> DataFrame:
    """(key, start, end) of every ``a..b`` range in a feature text, 0-based half-open."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"<?(\d+)\.\.>?(\d+)"), F.lit(0))
    rows = raw.select(key, F.explode(found).alias("r"))
    at = lambda i: F.regexp_extract("r", r"<?(\d+)\.\.>?(\d+)", i).try_cast("long")
    return rows.select(key, (at(1) - 1).alias("start"), at(2).alias("end"))


def read_gff(spark, path: str, feature: str = "CDS") -> DataFrame:
    return gff_intervals(spark.read.text(path), "value", feature)


def read_ranges(spark, path: str, key_pattern: str = r"^(\S+)") -> DataFrame:
    raw = spark.read.text(path).withColumn("contig", F.regexp_extract("value", key_pattern, 1))
    return range_intervals(raw, "contig", "value")


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors scaled to length one."""
    return rows.select(key, unit(vector).alias(vector))


def read_vectors(spark, paths: str | Sequence[str], key: str, vector: str) -> DataFrame:
    """Chunked Parquet vectors as one table, unit-normalised."""
    return unit_vectors(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), key, vector)


def profile_lines(raw: DataFrame, profile: str, column: str = "value") -> DataFrame:
    """(profile, context, share) from ``context<TAB>weight`` lines, each profile scaled to sum 1."""
    from touchstone.operators.spectra import normalise

    f = F.split(F.trim(F.col(column)), r"\s+")
    rows = raw.select(profile, F.get(f, F.lit(0)).alias("context"), F.get(f, F.lit(1)).try_cast("double").alias("weight"))
    rows = rows.filter(F.col("context").rlike(r"^[ACGT]\[[CT]>[ACGT]\][ACGT]$") & F.col("weight").isNotNull())
    return normalise(rows, [profile], "weight").select(profile, "context", "share")


def read_profiles(spark, folder: str, pattern: str = "*_PROFILE.txt", check: bool = True) -> DataFrame:
    """All profile files under a folder; an incomplete one is an error."""
    from touchstone.functions.tables import context_grid
    from touchstone.operators.spectra import missing_channels

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    raw = raw.withColumn("profile", F.regexp_replace(file_stem(F.input_file_name()), "_PROFILE$", ""))
    out = profile_lines(raw, "profile")
    if check:
        lacking = missing_channels(out, "profile", "context", context_grid(spark)).limit(5).collect()
        if lacking:
            raise ValueError(f"profiles lack contexts: {[(r[0], r[1]) for r in lacking]}")
    return out


def substitution_matrix(raw: DataFrame, column: str = "value") -> DataFrame:
    """(a, b, score) from a letter-by-letter score matrix in the usual text layout."""
    lines = raw.filter(~F.trim(column).startswith("#") & (F.trim(column) != "")).select(F.split(F.trim(column), r"\s+").alias("f"))
    header = lines.filter(~F.get("f", F.lit(1)).rlike(r"^-?\d")).limit(1).select(F.col("f").alias("h"))
    body = lines.filter(F.get("f", F.lit(1)).rlike(r"^-?\d"))
    from touchstone.operators.running import with_scalars

    both = with_scalars(body, header)
    cells = F.explode(F.arrays_zip(F.col("h").alias("b"), F.slice("f", F.lit(2), F.size("f") - 1).alias("s"))).alias("c")
    return both.select(F.get("f", F.lit(0)).alias("a"), cells).select("a", F.col("c.b").alias("b"), F.col("c.s").cast("double").alias("score"))


# ---- attaching scores


def attach_scores(rows: DataFrame, scores: DataFrame, key: Sequence[str], unit_cols: Sequence[str], score: str) -> tuple[DataFrame, DataFrame]:
    """(rows with scores, report): join cached scores by id; a unit whose counts disagree is refused.

    Rows without a score in an accepted unit are dropped and counted.
    """
    unit_cols, key = list(unit_cols), list(key)
    have = rows.groupBy(*unit_cols).agg(F.count(F.lit(1)).alias("rows"))
    cached = scores.groupBy(*unit_cols).agg(F.count(F.lit(1)).alias("scores"))
    counts = have.join(cached, unit_cols, "left").withColumn("scores", F.coalesce("scores", F.lit(0)))
    joined = rows.join(scores.select(*unit_cols, *key, score), [*unit_cols, *key], "inner")
    joined = joined.join(counts.filter("rows = scores").select(*unit_cols), unit_cols, "left_semi").filter(clean(score).isNotNull())
    used = joined.groupBy(*unit_cols).agg(F.count(F.lit(1)).alias("used"))
    report = attach(counts, used, unit_cols, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    why = F.when(F.col("scores") == 0, "no cached scores").when(F.col("rows") != F.col("scores"), "count mismatch")
    return joined, report.withColumn("refused_because", why)


def condition_table(wide: DataFrame, key: Sequence[str], pattern: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Wide ``activity_at_pH_T_substrate`` columns to long rows with the parsed parts as columns.

    ``pattern`` has one group per entry of ``names``; other columns are left out.
    """
    import re

    matched = [c for c in wide.columns if re.match(pattern, c)]
    long = wide.select(*key, *[F.col(f"`{c}`").cast("double").alias(c) for c in matched]).unpivot(list(key), matched, "__name", value)
    parts = {n: F.regexp_extract("__name", pattern, i + 1) for i, n in enumerate(names)}
    return long.filter(clean(value).isNotNull()).withColumns(parts).drop("__name")


