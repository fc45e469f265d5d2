"""Text, edit-list, spectrum and source-transform queries.  All run over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchstone.functions import edits as ed
from touchstone.functions import text as tx
from touchstone.functions.tables import CODONS, HYDROPATHY, context_grid
from touchstone.operators import groups as gr
from touchstone.operators import sequences as sq
from touchstone.operators import spectra as sp
from touchstone.plans.registry import drawn, query, r, rounded
from touchstone.settings import spread
from touchstone.sources import readers as rd

LETTERS = "abcdefghijklmnopqrstuvwxyz"


# ---- letters and runs

@query("sanitize", "select doc_id, cast(length(regexp_replace(upper(regexp_replace(text, '<[^>]*>', '', 'g')), '[^ACGTN]', '', 'g')) as int) as kept from documents")
def sanitize(t):
    return t.documents.select("doc_id", F.length(tx.sanitize("text")).alias("kept"))


_RUNS = """ch as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from documents where text <> ''),
is_ as (select doc_id, c, i - row_number() over (partition by doc_id, c order by i) as island from ch),
lr as (select doc_id, max(n) as longest from (select doc_id, count(*) as n from is_ group by doc_id, c, island) group by 1),
dr as (select d.*, coalesce(longest, 0) as longest, longest * 1.0 / nullif(length(text), 0) as fraction, case when coalesce(longest * 1.0 / nullif(length(text), 0) > 0.3, true) then 1 else 0 end as bad
       from documents d left join lr using (doc_id))"""


@query("longest_run", f"""
with {_RUNS} select source, cast(max(longest) as int) as longest, cast(sum(bad) as bigint) as degenerate from dr group by 1""")
def longest_run(t):
    return t.documents.groupBy("source").agg(F.max(tx.longest_run("text")).alias("longest"), F.sum(tx.is_degenerate("text").cast("int")).alias("degenerate"))


@query("quality_profile", f"""
with {_RUNS} select source, lang, cast(count(*) as bigint) as n, cast(sum(bad) as bigint) as degenerate, {r('avg(bad)')} as degenerate_rate, {r('avg(fraction)')} as mean_run_fraction,
  {r('avg(case when length(text) > 0 then 1.0 else 0 end)')} as valid_rate, {r('quantile_cont(fraction, 0.5)')} as median_run_fraction from dr group by 1, 2""")
def quality_profile(t):
    return rounded(gr.quality_profile(t.documents, "text", ["source", "lang"]))


@query("filter_inflation", """
select lang, cast(sum(n_chars) as bigint) as chars_all, cast(sum(case when n_chars > 500 then n_chars else 0 end) as bigint) as chars_kept, cast(count(*) as bigint) as docs_all,
  cast(sum(case when n_chars > 500 then 1 else 0 end) as bigint) as docs_kept, round(sum(n_chars) / nullif(sum(case when n_chars > 500 then n_chars else 0 end), 0), 6) + 0.0 as chars_ratio,
  round(count(*) / nullif(sum(case when n_chars > 500 then 1 else 0 end), 0), 6) + 0.0 as docs_ratio from documents group by 1""")
def filter_inflation(t):
    return rounded(gr.filter_inflation(t.documents, F.col("n_chars") > 500, {"chars": F.col("n_chars"), "docs": F.lit(1)}, ["lang"]))


@query("gc_features", """
with s as (select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as s from documents)
select doc_id, round(length(regexp_replace(s, '[^GC]', '', 'g')) / nullif(length(s), 0), 6) + 0.0 as gc, round((length(s) - length(replace(s, 'CG', ''))) / 2 / nullif(length(s) - 1, 0), 6) + 0.0 as cpg from s""")
def gc_features(t):
    rows = t.documents.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    return rounded(rows.select("doc_id", tx.gc_fraction("s").alias("gc"), tx.cpg_fraction("s").alias("cpg")))


@query("kmer_features", """
with ch as (select doc_id, lang, unnest(string_split(lower(text), '')) as c, generate_subscripts(string_split(lower(text), ''), 1) as i from documents),
g as (select lang, c || lead(c, 1) over w || lead(c, 2) over w as kmer from ch window w as (partition by doc_id order by i)),
c as (select lang, kmer, count(*) as n from g where regexp_full_match(kmer, '[a-z]{3}') group by 1, 2)
select lang, kmer, cast(n as bigint) as n, round(n / sum(n) over (partition by lang), 8) + 0.0 as share from c""")
def kmer_features(t):
    return rounded(sq.kmer_counts(t.documents.select("lang", F.lower("text").alias("text")), "lang", "text", 3, "[a-z]"), 8)


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_SHARES = ", ".join(f"(length(text) - length(replace(text, '{c}', ''))) / length(text) as {c}_" for c in _ALPHABET)
_SCALED = ", ".join(f"round(case when stddev_pop({c}_) over () > 1e-9 then {c}_ / stddev_pop({c}_) over () else {c}_ end, 6) + 0.0 as f_{c}" for c in _ALPHABET)


@query("composition_features", f"""
with f as (select item_id, {_SHARES}, length(text) * 1.0 as n from benchmark)
select item_id, {_SCALED}, round(n / stddev_pop(n) over (), 6) + 0.0 as f_length from f""")
def composition_features(t):
    return rounded(sq.composition_features(t.benchmark, "item_id", "text", list(_ALPHABET)))


@query("pwm_score", f"""
with a as (select doc_id, quality as y, regexp_replace(lower(text), '[^a-z]', '', 'g') as s from documents join labels using (doc_id)),
p as (select doc_id, y, unnest(string_split(s, '')) as c, generate_subscripts(string_split(s, ''), 1) - 1 as pos from a where s <> ''),
n as (select y, pos, c, count(*) as n from p group by 1, 2, 3), tt as (select y, pos, sum(n) as t from n group by 1, 2), cl as (select y, count(*) as k from a group by 1),
mods as (select unnest([0, 1]) as y), sc as (select p.doc_id, m.y, sum(ln((coalesce(n.n, 0) + 1) / (coalesce(tt.t, 0) + 26.0))) as lp from p, mods m left join n on n.y = m.y and n.pos = p.pos and n.c = p.c left join tt on tt.y = m.y and tt.pos = p.pos group by 1, 2),
s as (select doc_id, sc.y, lp + ln(k / (select sum(k) from cl)) as score from sc join cl on cl.y = sc.y)
select doc_id, {r('max(case when y = 1 then score end) - max(case when y = 0 then score end)', 4)} as log_odds from s group by 1""")
def pwm_score(t):
    rows = t.documents.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("s")).join(t.labels.select("doc_id", "quality"), "doc_id")
    model = sq.positional_frequencies(rows, "quality", "s", 1.0, LETTERS)
    return rounded(sq.pwm_log_odds(rows, "doc_id", "s", model, "quality", 1, 0), 4)


def _own(period, k):
    """SQL of per-text transition counts of order k, from one letter per row."""
    ctx = " || ".join(f"lag(c, {j}) over w" for j in range(k, 0, -1))
    return f"""ch as (select doc_id, unnest(string_split(lower(text), '')) as c, generate_subscripts(string_split(lower(text), ''), 1) - 1 as i from documents),
  g as (select doc_id, i % {period} as ph, {ctx} as cx, c as nx from ch window w as (partition by doc_id order by i)),
  own as (select doc_id, ph, cx, nx, count(*) as n from g where regexp_full_match(cx || nx, '[a-z]{{{k + 1}}}') group by all),
  tot as (select ph, cx, nx, sum(n) as c from own group by all), tcx as (select ph, cx, sum(c) as c from tot group by all), ocx as (select doc_id, ph, cx, sum(n) as c from own group by all)"""


@query("markov_leave_one_out", f"""
with {_own(3, 2)}
select own.doc_id, cast(sum(own.n) as bigint) as transitions, {r('sum(own.n * ln((tot.c - own.n + 1.0) / (tcx.c - ocx.c + 26.0))) / sum(own.n)')} as score
from own join tot on tot.ph = own.ph and tot.cx = own.cx and tot.nx = own.nx join tcx on tcx.ph = own.ph and tcx.cx = own.cx join ocx on ocx.doc_id = own.doc_id and ocx.ph = own.ph and ocx.cx = own.cx group by 1""")
def markov_leave_one_out(t):
    rows = t.documents.select("doc_id", F.lower("text").alias("text"))
    return rounded(sq.markov_scores(rows, "doc_id", "text", 2, 3, LETTERS, leave_one_out=True))


@query("markov_self_fit", f"""
with {_own(1, 1)}
select own.doc_id, cast(sum(own.n) as bigint) as transitions, {r('sum(own.n * ln((own.n + 1.0) / (ocx.c + 26.0))) / sum(own.n)')} as score from own join ocx on ocx.doc_id = own.doc_id and ocx.cx = own.cx group by 1""")
def markov_self_fit(t):
    rows = t.documents.select("doc_id", F.lower("text").alias("text"))
    return rounded(sq.markov_scores(rows, "doc_id", "text", 1, 1, LETTERS, fit="self"))


@query("bigram_score", f"""
with w as (select conv_id, turn, list_concat(list_concat(['^'], list_filter(string_split(text, ' '), lambda x: x <> '')), ['$']) as t from conversations),
b as (select conv_id * 1000 + turn as k, t[i] as a, t[i + 1] as b from w, unnest(range(1, len(t))) as u(i)), own as (select k, a, b, count(*) as n from b group by all),
tot as (select a, b, sum(n) as c from own group by all), ctx as (select a, sum(c) as c from tot group by 1), v as (select count(distinct b) + 1 as v from own)
select own.k, cast(sum(n) as bigint) as steps, {r('sum(n * ln((tot.c + 0.5) / (ctx.c + 0.5 * v))) / sum(n)')} as score from own join tot on tot.a = own.a and tot.b = own.b join ctx on ctx.a = own.a, v group by 1""")
def bigram_score(t):
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    return rounded(sq.bigram_scores(rows, "k", words))


@query("entropy_of_scores", f"""
with s as (select l_suppkey as u, l_linenumber as pos, l_discount * 20 as s from lineitem), m as (select u, pos, greatest(max(s), 0) as m, count(*) as n from s group by 1, 2 having count(*) >= 3),
z as (select s.u, s.pos, sum(exp(s - m)) + exp(-max(m)) as z, sum(exp(s - m) * (s - m)) - exp(-max(m)) * max(m) as ez from s join m on m.u = s.u and m.pos = s.pos group by 1, 2), h as (select u, ln(z) - ez / z as h from z)
select u, {r('avg(h)')} as entropy_mean, {r('stddev_pop(h)')} as entropy_sd, cast(count(*) as bigint) as n_positions from h group by 1""")
def entropy_of_scores(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("u"), F.col("l_linenumber").alias("pos"), (F.col("l_discount") * 20).alias("s"))
    return rounded(sq.entropy_of_scores(rows, ["u"], "pos", "s", 3))


@query("hamming_identity", """
with a as (select p_partkey as k, lpad(cast(p_partkey as varchar), 6, '0') as a, lpad(cast(p_partkey * 7 % 100000 as varchar), 6, '0') as b from part)
select k, cast(hamming(a, b) as int) as hamming, round(1 - hamming(a, b) / 6.0, 6) + 0.0 as identity, substr(a, 5, 1) || substr(a, 6, 1) as tail, cast(levenshtein(a, b || 'x') as int) as edits from a""")
def hamming_identity(t):
    pad = lambda c: F.lpad(c.cast("string"), 6, "0")
    rows = t.part.select(F.col("p_partkey").alias("k"), pad(F.col("p_partkey")).alias("a"), pad(F.col("p_partkey") * 7 % 100000).alias("b"))
    return rounded(rows.select("k", tx.hamming("a", "b").alias("hamming"), tx.identity("a", "b").alias("identity"), tx.position_key("a", [5, 6]).alias("tail"),
                               F.levenshtein("a", F.concat("b", F.lit("x"))).alias("edits")))


@query("chunk_aggregate", f"""
with l as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) - 1 as i from documents where text <> ''),
c as (select doc_id, i // 40 as chunk, sum(case when c = 'e' then 1 else 0 end) as v from l group by 1, 2)
select doc_id, cast(count(*) as bigint) as chunks, {r('avg(v)')} as mean, {r('quantile_cont(v, 0.5)')} as median, cast(max(v) as bigint) as max, cast(min(v) as bigint) as min,
  cast(arg_min(v, chunk) as bigint) as nearest, cast(arg_max(v, chunk) as bigint) as farthest from c group by 1""")
def chunk_aggregate(t):
    """Every letter of every text counts: the last chunk of a text is as long as what is left."""
    rows = t.documents.select("doc_id", F.posexplode(tx.blocks("text", 40, tail=True)).alias("chunk", "part"))
    rows = rows.select("doc_id", "chunk", (F.length("part") - F.length(F.replace("part", F.lit("e"), F.lit("")))).cast("long").alias("v"))
    return rounded(gr.chunk_aggregate(rows, ["doc_id"], "chunk", "v"))


@query("chunk_inputs", """
with d as (select doc_id, text, length(text) as n, length(text) // 2 as s, least(length(text), length(text) // 2 + 10) as e from documents),
c as (select *, unnest(range(cast(ceil(greatest(s, n - e, 1) / 50.0) as bigint))) as i from d)
select doc_id, cast(i as int) as chunk, md5(substr(text, cast(greatest(s - (i + 1) * 50, 0) + 1 as int), cast(greatest(s - i * 50 - greatest(s - (i + 1) * 50, 0), 0) as int))
  || substr(text, cast(s + 1 as int), cast(e - s as int)) || substr(text, cast(e + i * 50 + 1 as int), 50)) as digest from c""")
def chunk_inputs(t):
    """Ten letters at the middle of each text with chunks going out to both of its ends."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = t.documents.filter(F.col("text").isNotNull()).withColumn("s", half).withColumn("e", F.least(F.length("text"), half + 10))
    rows = rows.select("doc_id", F.explode(tx.chunk_inputs("text", "s", "e", None, 50)).alias("c"))
    return rows.select("doc_id", "c.chunk", F.md5("c.text").alias("digest"))


_CODONS = ", ".join(f"('{c}', '{a}')" for c, a in CODONS.items())


@query("translate_codons", f"""
with h as (select * from (values {", ".join(f"('{a}', {v!r})" for a, v in HYDROPATHY.items())}) v(a, v)), co as (select * from (values {_CODONS}) v(codon, aa)),
c as (select doc_id, source, regexp_replace(upper(regexp_replace(text, '<[^>]*>', '', 'g')), '[^ACGT]', '', 'g') as s from documents),
k as (select doc_id, s, unnest(range(length(s) // 3)) as i from c), j as (select doc_id, i, coalesce(aa, 'X') as aa from k left join co on codon = substr(s, cast(3 * i + 1 as int), 3)),
z as (select doc_id, min(i) filter (aa = '*') as stop from j group by 1), p as (select j.doc_id, aa from j join z using (doc_id) where stop is null or i < stop),
m as (select doc_id, count(*) as n, avg(v) as hy from p left join h on h.a = aa group by 1)
select source, {r('avg(coalesce(n, 0))')} as mean_length, cast(sum(case when coalesce(n, 0) >= 5 then 1 else 0 end) as bigint) as long_enough, {r('avg(hy)')} as mean_hydropathy from c left join m using (doc_id) group by 1""")
def translate_codons(t):
    rows = t.documents.select("source", tx.translate_codons(tx.sanitize("text", "ACGT")).alias("p"))
    return rounded(rows.groupBy("source").agg(F.avg(F.length("p")).alias("mean_length"), F.sum((F.length("p") >= 5).cast("int")).alias("long_enough"),
                                              F.avg(tx.mean_of_letters("p", HYDROPATHY)).alias("mean_hydropathy")))


# ---- edit lists.  Parts name edits of their own code string.

_LET = "chr(cast(65 + {x} % 20 as int))"
_ED = f"""e as (select p_partkey as k, p_brand as g, {_LET.format(x='p_partkey')} || (1 + p_size % 6) || {_LET.format(x='(p_partkey * 3 + 1)')} as e1,
    {_LET.format(x='(p_partkey + 7)')} || (7 + p_size % 5) || {_LET.format(x='p_size')} as e2 from part)"""


def _variants(t):
    letter = lambda c: F.chr(65 + c % 20)
    k, s = F.col("p_partkey"), F.col("p_size")
    e1 = F.concat(letter(k), (1 + s % 6).cast("string"), letter(k * 3 + 1))
    e2 = F.concat(letter(k + 7), (7 + s % 5).cast("string"), letter(s))
    name = F.when(k % 11 == 0, "WT").when(k % 13 == 0, F.concat(e1, F.lit("?"))).when(k % 2 == 0, e1).otherwise(F.concat(e1, F.lit("/"), F.lower(e2)))
    return t.part.select(k.alias("k"), F.col("p_brand").alias("g"), name.alias("variant"), F.col("p_retailprice").alias("fitness"))


@query("parse_variant", f"""
with {_ED} select k, case when k % 11 = 0 then 0 when k % 13 = 0 then null when k % 2 = 0 then 1 else 2 end::double as n_mut,
  case when k % 11 = 0 then '' when k % 13 = 0 then null when k % 2 = 0 then e1 else e1 || ',' || e2 end as edits from e""")
def parse_variant(t):
    rows = _variants(t).withColumn("e", ed.parse_edits("variant"))
    shown = F.array_join(F.transform("e", lambda x: F.concat(x["wt"], x["pos"].cast("string"), x["mut"])), ",")
    return rows.select("k", ed.edit_count("e").cast("double").alias("n_mut"), shown.alias("edits"))


@query("campaign_notes", """
select 'variant' as mode, cast(sum(case when p_partkey % 11 <> 0 and p_partkey % 13 = 0 then 1 else 0 end) as bigint) as unparseable,
  cast(sum(case when p_partkey % 11 = 0 or p_partkey % 13 <> 0 then 1 else 0 end) as bigint) as n_measured, cast(0 as bigint) as n_candidates, 'g,k' as conditions from part""")
def campaign_notes(t):
    _, notes = rd.campaign(_variants(t))
    return notes.withColumn("conditions", F.array_join("conditions", ","))


@query("lookup_sum", f"""
with {_ED}, h as (select k, e1, e2 from e where k % 11 <> 0 and k % 13 <> 0 and k % 2 = 1),
hv(l, v) as (values ('A', 1.8), ('C', 2.5), ('D', -3.5), ('E', -3.5), ('F', 2.8), ('G', -0.4), ('H', -3.2), ('I', 4.5), ('K', -3.9), ('L', 3.8), ('M', 1.9), ('N', -3.5), ('P', -1.6), ('Q', -3.5), ('R', -4.5), ('S', -0.8), ('T', -0.7), ('V', 4.2), ('W', -0.9), ('Y', -1.3)),
ex as (select k, e1 as e from h union all select k, e2 from h)
select k, {r('sum(coalesce(b.v, 0) - coalesce(a.v, 0))')} as hydropathy, {r('sum(abs(coalesce(b.v, 0) - coalesce(a.v, 0)))')} as abs_hydropathy,
  {r("sum(case when left(e, 1) || right(e, 1) = 'AE' then 2.0 when left(e, 1) || right(e, 1) = 'BA' then -1.0 else 0 end)")} as pair from ex left join hv a on a.l = left(e, 1) left join hv b on b.l = right(e, 1) group by 1""")
def lookup_sum(t):
    rows = _variants(t).withColumn("e", ed.parse_edits("variant")).filter(F.size("e") == 2)
    return rounded(rows.select("k", ed.property_shift("e", HYDROPATHY).alias("hydropathy"), ed.property_shift("e", HYDROPATHY, True).alias("abs_hydropathy"),
                               ed.pair_sum("e", {("A", "E"): 2.0, ("B", "A"): -1.0}).alias("pair")))


_REF = "'ABCDEFGHIJKLMNOPQRST'"


@query("apply_edits", f"""
with {_ED}, v as (select k, e1, cast(substr(e1, 2, 1) as int) as pos from e where k % 11 <> 0 and k % 13 <> 0 and k % 2 = 0)
select k, substr({_REF}, pos, 1) = left(e1, 1) as agrees, case when substr({_REF}, pos, 1) = left(e1, 1) then left({_REF}, pos - 1) || right(e1, 1) || substr({_REF}, pos + 1) end as edited from v""")
def apply_edits(t):
    rows = _variants(t).withColumn("e", ed.parse_edits("variant")).filter(F.size("e") == 1).withColumn("ref", F.lit("ABCDEFGHIJKLMNOPQRST"))
    return rows.select("k", ed.agrees("ref", "e").alias("agrees"), ed.apply_edits("ref", "e").alias("edited"))


@query("recover_offset", f"""
with {_ED}, c as (select g, left(e1, 1) as wt, cast(substr(e1, 2, 1) as int) as pos from e where k % 11 <> 0 and k % 13 <> 0),
c2 as (select * from c union all select g, left(e2, 1), cast(regexp_extract(e2, '[0-9]+') as int) from e where k % 11 <> 0 and k % 13 <> 0 and k % 2 = 1),
o as (select g, o, sum(case when pos + o between 1 and 20 and substr({_REF}, cast(greatest(pos + o, 1) as int), 1) = wt then 1 else 0 end) as hits, count(*) as claims from c2, (select unnest(range(-60, 61)) as o) group by 1, 2)
select g, cast(o as int) as "offset", cast(hits as bigint) as hits, cast(claims as bigint) as claims, round(hits / claims, 6) + 0.0 as match_rate from (select *, row_number() over (partition by g order by hits desc, o) as i from o) where i = 1""")
def recover_offset(t):
    rows = _variants(t).withColumn("e", ed.parse_edits("variant")).filter(F.col("e").isNotNull()).withColumn("ref", F.lit("ABCDEFGHIJKLMNOPQRST"))
    return rounded(sq.recover_offset(rows, ["g"], "e", "ref"))


@query("onehot_edits", f"""
with {_ED}, p as (select k, cast(substr(e1, 2, 1) as int) as pos, right(e1, 1) as mut from e where k % 11 <> 0 and k % 13 <> 0 and k % 2 = 0),
v as (select pos, mut, row_number() over (order by pos, mut) - 1 as i from (select distinct pos, mut from p)) select k, cast(i as varchar) as indices from p join v on v.pos = p.pos and v.mut = p.mut""")
def onehot_edits(t):
    rows = _variants(t).withColumn("e", ed.parse_edits("variant")).filter(F.size("e") == 1)
    out = sq.onehot_edits(rows, "k", "e", sq.edit_vocabulary(rows, "e"))
    return out.select("k", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"))


@query("factorized_features")
def factorized_features(t):
    rows = _variants(t).withColumn("e", ed.parse_edits("variant")).filter(F.col("e").isNotNull())
    long = sq.factorized_features(rows, "k", "e")
    return rounded(long.groupBy(F.regexp_extract("feature", "^[a-z]+", 0).alias("kind")).agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total")))


@query("single_edit_grid", f"""
with s as (select distinct p_name as g from part), p as (select g, i, substr(g, cast(i as int), 1) as wt from s, unnest(range(1, length(g) + 1)) as u(i)), a as (select unnest(['a', 'e', 't']) as m)
select g, cast(count(*) as bigint) as n, md5(string_agg(wt || i || m, ',' order by wt || i || m)) as digest from p, a where wt <> m and wt || i || m <> wt || '1e' group by 1""")
def single_edit_grid(t):
    names = t.part.select(F.col("p_name").alias("g")).distinct()
    listed = names.select("g", F.concat(F.substring("g", 1, 1), F.lit("1e")).alias("name"))
    grid = sq.single_edit_grid(names, ["g"], "g", ["a", "e", "t"], listed)
    return grid.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("name")), ",")).alias("digest"))


@query("reference_from_variants", """
with v as (select p_brand as g, overlay_at, p_name as t, 'z' as wt from (select *, 1 as overlay_at from part)), i as (select g, 'z' || substr(t, 2) as ref, count(*) as n from v group by 1, 2)
select g, arg_max(ref, (n, ref)) as reference, cast(count(*) as bigint) as versions from i group by 1""")
def reference_from_variants(t):
    edit = F.array(F.struct(F.lit("z").alias("wt"), F.lit(1).alias("pos"), F.substring("p_name", 1, 1).alias("mut")))
    return sq.reference_from_variants(t.part.select(F.col("p_brand").alias("g"), "p_name", edit.alias("e")), ["g"], "p_name", "e")


_HYDROPATHY = ", ".join(f"('{a}', {v!r})" for a, v in HYDROPATHY.items())


@query("property_comparison", f"""
with h as (select * from (values {_HYDROPATHY}) v(a, v)), s as (select p_partkey, p_type, replace(upper(p_name), ' ', '') as a from part),
l as (select p_partkey, p_type, unnest(string_split(a, '')) as x, unnest(string_split(reverse(a), '')) as y from s where a <> ''),
k as (select p_partkey, p_type, x, y, abs(hx.v - hy.v) as ch from l left join h hx on hx.a = x left join h hy on hy.a = y where x <> y and x not in ('X', '*') and y not in ('X', '*')),
m as (select p_partkey, count(*) as n, avg(ch) as ch from k group by 1)
select p_type, cast(sum(coalesce(n, 0)) as bigint) as substitutions, {r('avg(ch)')} as mean_abs_change from s left join m using (p_partkey) group by 1""")
def property_comparison(t):
    a = F.regexp_replace(F.upper("p_name"), " ", "")
    rows = t.part.select("p_type", "p_partkey", a.alias("a"), F.reverse(a).alias("b"))
    out = sq.property_comparison(rows.select("p_partkey", "a", "b"), "p_partkey", "a", "b")
    return rounded(out.join(rows.select("p_partkey", "p_type"), "p_partkey").groupBy("p_type").agg(F.sum("substitutions").alias("substitutions"), F.avg("mean_abs_change").alias("mean_abs_change")))


# ---- spectra: letters of part names mapped to bases, against the same name rotated

_BASES = "translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACG')"


def _base_pairs(t):
    a = F.translate(F.lower("p_name"), LETTERS + " ", "ACGTACGTACGTACGTACGTACGTACG")
    b = F.concat(a.substr(F.lit(2), F.length(a)), F.substring(a, 1, 1))
    return t.part.select(F.col("p_type").alias("g"), F.col("p_partkey").alias("k"), a.alias("a"), b.alias("b"))


_SPEC = f"""s as (select p_type as g, {_BASES} as a, substr({_BASES}, 2) || left({_BASES}, 1) as b from part),
  w as (select g, substr(a, cast(i as int) - 1, 1) as f5, substr(a, cast(i as int), 1) as rf, substr(a, cast(i as int) + 1, 1) as f3, substr(b, cast(i as int), 1) as al from s, unnest(range(2, length(a))) as u(i)),
  x as (select g, case when rf in ('C', 'T') then f5 || '[' || rf || '>' || al || ']' || f3 else translate(f3, 'ACGT', 'TGCA') || '[' || translate(rf, 'ACGT', 'TGCA') || '>' || translate(al, 'ACGT', 'TGCA') || ']' || translate(f5, 'ACGT', 'TGCA') end as c from w where rf <> al),
  grid as (select a || '[' || rr || '>' || t || ']' || b as context from (select unnest(['A','C','G','T']) as a), (select unnest(['C','T']) as rr), (select unnest(['A','C','G','T']) as t), (select unnest(['A','C','G','T']) as b) where rr <> t),
  n as (select g, c, count(*) as n from x group by 1, 2), full_ as (select gg.g, grid.context, coalesce(n.n, 0) as n from (select distinct g from s) gg cross join grid left join n on n.g = gg.g and n.c = grid.context)"""


@query("spectrum", f"with {_SPEC} select g, context, cast(n as bigint) as n from full_")
def spectrum(t):
    return sp.spectrum(_base_pairs(t), "a", "b", ["g"], context_grid(t.spark))


def _profiles(t):
    spec = sp.spectrum(_base_pairs(t), "a", "b", ["g"], context_grid(t.spark))
    return sp.normalise(spec, ["g"], "n").select(F.col("g").alias("profile"), "context", "share")


@query("null_profile", f"with {_SPEC}, p as (select g, context, n / sum(n) over (partition by g) as s from full_) select context, {r('sum(s) / (select count(distinct g) from p)', 8)} as share from p group by 1")
def null_profile(t):
    return rounded(sp.null_profile(_profiles(t), "profile", "context", "share"), 8)


@query("profile_cosines", f"""
with {_SPEC}, p as (select g, context, n / sum(n) over (partition by g) as s from full_), q as (select g, context, s / sqrt(sum(s * s) over (partition by g)) as u from p)
select a.g as a, b.g as b, {r('sum(a.u * b.u)')} as cosine from q a join q b on a.context = b.context and a.g < b.g group by 1, 2""")
def profile_cosines(t):
    return rounded(sp.profile_cosines(_profiles(t), "profile", "context", "share"))


@query("profile_collinearity")
def profile_collinearity(t):
    return rounded(sp.profile_collinearity(_profiles(t), "profile", "context", "share"), 4)


@query("signature_exposure", f"""
with {_SPEC} select t.g as profile, s.g, case when t.g = s.g then 1.0 else 0.0 end::double as exposure from (select distinct g from s) t, (select distinct g from s) s""")
def signature_exposure(t):
    # Each type's own spectrum decomposed on the profiles of all types: the exact answer is itself.
    spec = sp.spectrum(_base_pairs(t), "a", "b", ["g"], context_grid(t.spark))
    return rounded(sp.signature_exposure(spec, _profiles(t), ["g"], "profile"), 4)


@query("budget_stability")
def budget_stability(t):
    pairs = spread(_base_pairs(t)).withColumn("brand", F.col("k") % 40)
    found = pairs.select("g", "brand", F.explode(tx.substitutions("a", "b")).alias("context")).groupBy("g", "brand", "context").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sp.budget_stability(found, ["g"], "brand", _profiles(t), "profile", ["ECONOMY", "SMALL"], [5, 20], 20))


# ---- source transforms on records that the tables hold

@query("fasta_records", """
select cast(doc_id as varchar) as id, lang || '->x' as description, cast(length(regexp_replace(text, '\\s', '', 'g')) as int) as letters, md5(regexp_replace(text, '\\s', '', 'g')) as digest from documents""")
def fasta_records(t):
    # One FASTA text per document, cut back into records; the header line holds marks of its own.
    raw = t.documents.select(F.concat(
        F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit("->x\n "), F.regexp_replace("text", "\n>", "\n >"), F.lit("\n")).alias("fasta"))
    bodies = rd.split_fasta(raw, "fasta").withColumn("value", F.regexp_replace("value", "^>", ""))
    out = rd.fasta_records(bodies)
    return out.select("id", "description", F.length("seq").alias("letters"), F.md5("seq").alias("digest"))


@query("well_formed_rows", """
select reason, cast(count(*) as bigint) as rows from (select case when not regexp_full_match(p_brand, 'Brand#[0-9]{2}') then 'malformed code' when p_size > 45 then 'outlier' else 'kept' end as reason from part) group by 1""")
def well_formed_rows(t):
    _, drops = rd.well_formed(t.part.select("p_brand", F.col("p_size").cast("string").alias("v")), "p_brand", r"^Brand#\d{2}$", ["v"], 45.0)
    return drops


@query("best_by_key", f"""
select p_name as slide, min(p_retailprice) as energy, cast(count(*) as bigint) as seen from part where length(p_name) = 8 and {drawn(0, 'p_name')} % 2 = 0 group by 1""")
def best_by_key(t):
    rows = t.part.select(F.col("p_name").alias("slide"), F.col("p_retailprice").alias("energy"))
    return rd.best_by_key(rows, "slide", "energy", 8, 2)


@query("interval_records", """
select url, cast(regexp_extract(url, '([0-9]+)') as bigint) as start, cast(regexp_extract(url, '([0-9]+)') as bigint) + 10 as "end" from pages where regexp_matches(url, '/[a-z]{2}/[0-9]+')""")
def interval_records(t):
    number = F.regexp_extract("url", r"([0-9]+)", 1)
    raw = t.pages.filter(F.col("url").rlike("/[a-z]{2}/[0-9]+")).select("url", F.concat(F.lit("join("), (number.cast("long") + 1).cast("string"), F.lit(".."), (number.cast("long") + 10).cast("string"), F.lit(")")).alias("loc"))
    return rd.range_intervals(raw, "url", "loc")


@query("coordinates", """
select p_partkey, 'chr' || (p_size % 5) as chrom, p_partkey as start, p_partkey + p_size as "end", upper(p_name) as sequence from part""")
def coordinates(t):
    name = F.concat(F.lit("chr"), (F.col("p_size") % 5).cast("string"), F.lit(":"), F.col("p_partkey").cast("string"), F.lit("-"), (F.col("p_partkey") + F.col("p_size")).cast("string"))
    rows = t.part.select("p_partkey", name.alias("name"), F.col("p_name").alias("sequence"))
    return rd.with_coordinates(rows).select("p_partkey", "chrom", "start", "end", "sequence")


@query("attach_scores", """
with r as (select o_orderkey as k, o_orderpriority || o_orderstatus as u, o_totalprice as y from orders), s as (select k, u, y / 2 as s from r where not (u like '1%F' and k % 3 = 0)),
c as (select r.u, count(*) as rows from r group by 1), d as (select u, count(*) as scores from s group by 1)
select c.u, cast(rows as bigint) as rows, cast(coalesce(scores, 0) as bigint) as scores, cast(case when rows = scores then rows else 0 end as bigint) as used, case when coalesce(scores, 0) = 0 then 'no cached scores' when rows <> scores then 'count mismatch' end as refused_because from c left join d on d.u = c.u""")
def attach_scores(t):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.concat("o_orderpriority", "o_orderstatus").alias("u"), F.col("o_totalprice").alias("y"))
    scores = rows.filter(~(F.col("u").like("1%F") & (F.col("k") % 3 == 0))).select("k", "u", (F.col("y") / 2).alias("s"))
    _, report = rd.attach_scores(rows, scores, ["k"], ["u"], "s")
    return report


@query("condition_table", """
with m as (select l_suppkey, avg(l_quantity) filter (l_returnflag = 'A') as a, avg(l_quantity) filter (l_returnflag = 'R') as b from lineitem group by 1)
select l_suppkey, round(a, 6) + 0.0 as value, '7' as pH, '40' as temp from m where a is not null union all select l_suppkey, round(b, 6) + 0.0, '9', '70' from m where b is not null""")
def condition_table(t):
    means = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_quantity"))
    wide = means.select("l_suppkey", F.col("A").alias("activity_at_7_40"), F.col("R").alias("activity_at_9_70"))
    return rounded(rd.condition_table(wide, ["l_suppkey"], r"^activity_at_(\d+)_(\d+)$", ["pH", "temp"]))


@query("append_new", """
select cast(count(*) as bigint) as n, cast(sum(o_orderkey) as bigint) as keys from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def append_new(t):
    from touchstone.sources.writers import new_rows

    fresh = new_rows(t.orders.select("o_orderkey"), t.orders.filter("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])
    return fresh.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
