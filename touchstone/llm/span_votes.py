"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import settle, whole_text

KINDS = ["email", "ip", "card", "phone", "secret", "id_number"]
BASE_KINDS = 4

# Candidates: (kind, pattern, a cheap test that a text can hold one).  Possessive repeats and the start conditions keep the
# search linear on long runs; \G admits a start right behind the match before.
PATTERNS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[ -]?[0-9])++", None),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", None),
    ("secret", r"(?i)(?<![a-z0-9_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key) ?[=:] ?[^\x20\x09-\x0D]{6,256}",
     None),
    ("id_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
]
BASE_PATTERNS = 4  # the first of them are the contract's own

# Gazetteers and cue words of the labelers.
DOMAINS = "com|net|org|edu|gov|io|info|biz|de|fr|es|uk|it|nl|ch|at|eu|us|ca|au|jp|example|test"
CALLING_CODES = r"\+(1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|36|6011|65"
CUES = {
    "email": "mail|contact|write|schreib|contacto|courriel|correo",
    "ip": r"\bip\b|server|host|address|login|adresse",
    "card": "card|visa|pay|karte|carte|tarjeta|credit",
    "phone": "call|phone|tel|fax|mobile|ring|anruf|llam",
    "secret": "password|passwd|secret|token|key|login|user",
    "id_number": "ssn|social|tax|id|number",
}
AGAINST = r"version|section|chapter|page|isbn|order|build|release|item"

LABELERS = 5
BUCKETS = 1024  # of each feature template
TEMPLATES = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a body that names it several times."""
    return F.transform(F.array(value), body)[0]


def running_sums(lengths: Column, block: int = 256) -> Column:
    """Inclusive running sums of a long array, by blocks so that long arrays stay cheap."""

    def grow(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    zero = F.array(F.lit(0).cast("long"))
    return let(lengths, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(let(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")),
                    lambda b: F.aggregate(F.slice(xs, b * block + 1, F.lit(block)), zero, grow)),
        lambda blocks: F.flatten(F.zip_with(
            blocks, F.slice(F.aggregate(blocks, zero, lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(w, -1)))),
                            F.lit(1), F.size(blocks)),
            lambda w, before: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda v: v + before)))))
    )


def found(text: Column, pattern: str, needs: str | None) -> Column:
    """Leftmost non-overlapping matches: value, the text before, start and end in code points."""
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(
        F.zip_with(pieces, values, lambda p, v: F.struct(
            F.length(p).cast("long").alias("gap"), F.lower(F.right(p, F.lit(40))).alias("before"), v.alias("value"))),
        lambda z: z["value"].isNotNull())
    placed = let(pairs, lambda found: F.zip_with(
        found, running_sums(F.transform(found, lambda z: z["gap"] + F.length(z["value"]))),
        lambda z, end: F.struct((end - F.length(z["value"])).alias("start"), end.alias("end"), z["before"].alias("before"),
                                z["value"].alias("value"))))
    possible = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]" if "[0-9]" in pattern else "[=:]")
    none = F.array().cast("array<struct<start:bigint,end:bigint,before:string,value:string>>")
    return F.when(possible, placed).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    number = digits(value)
    return F.length(number).between(12, 19) & F.call_function("luhn_check", number)


def passes(kind: str, value: Column) -> Column:
    """The contract's check of a base match."""
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def votes(kind: str, value: Column, before: Column) -> list[Column]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    shape = {"secret": mixed, "id_number": ~value.rlike("^(000|666|9)")}.get(kind, passes(kind, value))
    known = {
        "email": value.rlike(rf"(?i)\.(?:{DOMAINS})$"),
        "ip": ~value.rlike(r"^(0|127|255)\."),
        "card": digits(value).rlike(f"^(?:{ISSUERS})"),
        "phone": value.rlike(rf"^{CALLING_CODES}") | ~value.startswith("+"),
        "secret": value.rlike(r"(?i)^(password|passwd|secret|token|api)"),
        "id_number": ~value.rlike("-0000$"),
    }[kind]
    size = {"email": (8, 60), "ip": (7, 15), "card": (13, 23), "phone": (9, 22), "secret": (14, 90), "id_number": (11, 11)}[kind]
    varied = F.size(F.array_distinct(F.split(F.substring(value, 1, 300), "")))
    return [
        vote(shape, ~shape),
        vote(known, ~known),
        vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
        vote(F.length(value).between(*size), ~F.length(value).between(*size)),
        vote(varied >= 6, varied <= 3),
    ]


def features(kind: str, value: Column, before: Column) -> Column:
    """Hashed features, one per template: shape, word before, length, first signs."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(value, 1, 300), "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    word = F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    parts = [shape, word, F.least(F.length(value), F.lit(64)).cast("string"), F.substring(value, 1, 2)]
    return F.array(*[
        (F.pmod(F.xxhash64(F.lit(kind), part), F.lit(BUCKETS)) + i * BUCKETS).cast("int") for i, part in enumerate(parts)])


def _span(kind: str, base: bool) -> Callable[[Column], Column]:
    def span(m: Column) -> Column:
        return F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"),
            (passes(kind, m["value"]) if base else F.lit(False)).alias("base"),
            F.concat(*[(v + 1).cast("string") for v in votes(kind, m["value"], m["before"])]).alias("votes"),
            features(kind, m["value"], m["before"]).alias("features"))

    return span


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and an array of candidate spans of each text; the text itself is left behind."""
    text = F.col("text")
    arrays = []
    for i, (kind, pattern, needs) in enumerate(PATTERNS):
        arrays.append(F.transform(found(text, pattern, needs), _span(kind, i < BASE_PATTERNS)))
    return docs.select(*keep, whole_text(docs).alias("text")).select(*keep, F.concat(*arrays).alias("spans"))


def reliabilities(patterns: DataFrame, rounds: int = 30) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation over counted vote patterns (``votes``, ``n``): at most 3^LABELERS rows, all that it needs.

    Returns the share of true spans and, for each labeler, the chance of each vote under [false, true].
    """
    rows = [([int(v) for v in r["votes"]], r["n"]) for r in patterns.collect()]
    odds = [float(sum(v) - LABELERS) for v, _ in rows]  # the first round starts from the majority
    share, chance = 0.5, [[[1 / 3] * 3] * 2] * LABELERS
    for _ in range(rounds):
        sums = [[[1.0] * 3 for _ in range(2)] for _ in range(LABELERS)]
        total = [1.0, 1.0]
        for (vote, n), x in zip(rows, odds, strict=True):
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
            for side, w in enumerate((n * (1 - p), n * p)):
                total[side] += w
                for labeler, v in enumerate(vote):
                    sums[labeler][side][v] += w
        share = total[1] / (total[0] + total[1])
        chance = [[[x / sum(side) for x in side] for side in labeler] for labeler in sums]
        start = math.log(share / (1 - share))
        odds = [start + sum(math.log(chance[i][1][v] / chance[i][0][v]) for i, v in enumerate(vote)) for vote, _ in rows]
    return share, chance


def log_odds(vote: list[Column], share: float, chance: list[list[list[float]]]) -> Column:
    total = F.lit(math.log(share / (1 - share)))
    for v, (false, true) in zip(vote, chance, strict=True):
        w = [math.log(t / f) for t, f in zip(true, false, strict=True)]
        total = total + F.when(v == 0, w[0]).when(v == 1, w[1]).otherwise(w[2])
    return total


def span_weights(spans: DataFrame, share: float, chance: list[list[list[float]]]) -> tuple[float, list[float]]:
    """The span classifier: naive Bayes over hashed features with the labelers' posteriors as soft labels."""
    odds = log_odds([F.substring("votes", i + 1, 1).cast("int") for i in range(LABELERS)], share, chance)
    sums = (spans.withColumn("p", 1 / (1 + F.exp(-odds))).select("p", F.explode("features").alias("bucket"))
            .groupBy("bucket").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")))
    rows = sums.collect()  # at most BUCKETS * TEMPLATES rows
    weights, bias = [0.0] * (BUCKETS * TEMPLATES), math.log(share / (1 - share))
    true = sum(r["true"] for r in rows) / TEMPLATES
    false = sum(r["false"] for r in rows) / TEMPLATES
    for r in rows:
        weights[r["bucket"]] = math.log((r["true"] + 0.5) / (true + 0.5 * BUCKETS)) - math.log((r["false"] + 0.5) / (false + 0.5 * BUCKETS))
    return bias, weights


def personal_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Personal data of each text: ``doc_id`` and ``spans``, an array of (start, kind, end, base, score).

    Candidates come from patterns; a shape check, gazetteers, context, length and variety vote on each.  Vote patterns are
    counted, expectation-maximisation estimates every labeler's reliability, and a naive Bayes span classifier learns from
    the posteriors of all candidates.  The base kinds' passing matches always stay (``base``); other candidates stay if the
    classifier gives ``threshold`` or more.  Offsets are code points, end exclusive.

    Null and empty texts have no spans, repeated rows give repeated results, other columns are ignored; an empty table
    gives no rows.  Work per text is linear in its length and no span leaves its document's row.
    """
    held = settle(candidates(docs, ["doc_id"]))
    spans = held.select(F.explode("spans").alias("s")).select("s.votes", "s.features")
    share, chance = reliabilities(spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    bias, weights = span_weights(spans, share, chance)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    scored = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"),
        (1 / (1 + F.exp(-F.aggregate(s["features"], F.lit(bias), lambda acc, f: acc + F.get(table, f))))).alias("score")))
    return held.select("doc_id", F.filter(scored, lambda s: s["base"] | (s["score"] >= threshold)).alias("spans"))


def op10(docs: DataFrame) -> DataFrame:
    """Digest of :func:`personal_spans`: counts of the base kinds and the spans written as ``kind:start:end``."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        order = F.array_sort(F.array_distinct(F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: s["kind"])
    counts = [F.size(F.filter(base, lambda k: k == KINDS.index(name))).cast("long").alias(f"n_{name}") for name in KINDS[:BASE_KINDS]]
    return personal_spans(docs).select(
        "doc_id", *counts, F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
