"""The opN_<name> queries: each operator over its whole table, in the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, divergence, langid, mixing, phrases, pii, secret_scan, simhash, substrings, suffix_tree, toxicity, vectors, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("sources")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words as in contamination.words_of: ASCII letters and digits and non-ASCII characters, A-Z as a-z.
_WORDS_SQL = "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op4_decontaminate"] = f"""
with d as (select doc_id, {_WORDS_SQL.format(text="text")} w from documents where doc_id is not null and text is not null),
i as (select item_id, w, least(5, len(w)) k from (select item_id, {_WORDS_SQL.format(text="text")} w from benchmark where item_id is not null and text is not null) where len(w) > 0),
ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) s from d, (select distinct k from i) where len(w) >= k),
s as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) s from i),
n as (select item_id, count(*) n_shingles from s group by item_id),
m as (select doc_id, item_id, count(*) n_shared from ds join s using (s, k) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment
from m join n using (item_id) where n_shared >= 0.8 * n_shingles - 1e-9"""


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(columns)


SQL["op7_warc"] = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h)) payload_bytes, sha1(h) x from p),
g as (select *, min(page_id) over (partition by x) low from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) as integer) >> (15 - 5 * (i % 4))) & 31)::integer, 1)), '') payload_digest,
  case when page_id > low then 'revisit' else 'response' end record_type,
  case when page_id > low then low end refers_to
from g"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_groups(table(spark, sf_dir, "embeddings"))


SQL["op9_vectors"] = """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) s from v
      where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          and list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
reach(id, other) as (select vec_id, vec_id from v union select r.id, l.b from reach r join links l on l.a = r.other),
low as (select id, min(other) component_id from reach group by id)
select vec_id, (select count(*) from links where a = vec_id) n_links, component_id, vec_id = component_id kept
from v join low on id = vec_id"""


@query
def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


SQL["op11_phrases"] = """
with t as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
pieces as (select lang, unnest(string_split_regex(x, '[.,;:!?\\x0A-\\x0D]')) s from t),
w as (select lang, regexp_extract_all(s, '[^\\x20\\x09]+') w from pieces),
n as (select lang, sum(len(w)) n from w group by lang),
u as (select lang, row_number() over () piece, w from w),
x as (select lang, piece, unnest(w) word, generate_subscripts(w, 1) spot from u),
y as (select lang, word w1, lead(word) over o w2, lead(word, 2) over o w3, lead(word, 3) over o w4 from x window o as (partition by piece order by spot)),
g as (select lang, w1, null w2, null w3, null w4, count(*) f from y group by lang, w1 having count(*) >= 30
  union all select lang, w1, w2, null, null, count(*) from y where w2 is not null group by lang, w1, w2 having count(*) >= 30
  union all select lang, w1, w2, w3, null, count(*) from y where w3 is not null group by lang, w1, w2, w3 having count(*) >= 30
  union all select lang, w1, w2, w3, w4, count(*) from y where w4 is not null group by lang, w1, w2, w3, w4 having count(*) >= 30),
f as materialized (select lang, list_filter([w1, w2, w3, w4], lambda z: z is not null) p, concat_ws(' ', w1, w2, w3, w4) s, f from g),
c as (select lang, p, f a from f where len(p) > 1),
h as materialized (select *, array_to_string(p[1:k], ' ') s1, array_to_string(p[k + 1:], ' ') s2 from (select *, unnest(range(1, len(p))) k from c)),
cuts as (select h.lang, h.p, a, k, x.f l, y.f r, cast(cast(2000000 as hugeint) * a // (x.f + y.f) as bigint) score
  from h join f x on x.lang = h.lang and x.s = s1 join f y on y.lang = h.lang and y.s = s2),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inside as (select lang, sub p, max(a) longer from (select lang, a, unnest(case len(p) when 3 then [p[1:2], p[2:3]] else [p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]] end) sub
  from c where len(p) > 2) group by lang, sub),
kept as (select b.*, array_to_string(b.p, ' ') phrase from best b left join inside i on i.lang = b.lang and i.p = b.p where longer is null or 100 * longer < 80 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) "rank", phrase, a, l, r, cast(n as bigint) n, score
from kept join n using (lang) qualify "rank" <= 2000"""


@query
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op12_substrings"] = """
with d as materialized (select row_number() over () k, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) w from documents),
s as materialized (select k, i, md5(array_to_string(w[i:i + 34], ' ')) x from (select k, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
r as (select x from s group by x having count(*) > 1),
hit as (select k, i from s join r using (x)),
gone as (select distinct k, unnest(range(i, i + 35)) i from hit),
n as (select k, list(i) g from gone group by k)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(g), 0) as bigint) n_removed,
  sha256(array_to_string(case when g is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(g, z[2])), lambda z: z[1]) end, ' ')) kept_sha256
from d left join n using (k)"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_divergence"] = """
with d as materialized (select row_number() over () k, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents),
t as materialized (select k, lang, source, unnest(w) term from d),
kept as materialized (select lang, term from t group by lang, term having count(distinct k) >= 10),
v as (select lang, count(*) v from kept group by lang),
g as materialized (select distinct lang, source from d),
c as materialized (select lang, source, term, count(*) c from t semi join kept using (lang, term) group by lang, source, term),
n as (select lang, source, sum(c) n from c group by lang, source),
lc as (select lang, term, sum(c) c from c group by lang, term),
ln as (select lang, sum(c) n from lc group by lang),
q as materialized (select lang, term, 1 + cast(1000000000 as hugeint) * (c + 2) // (n + 2 * v) q from lc join ln using (lang) join v using (lang)),
p as materialized (select g.lang, g.source, kept.term, coalesce(c.c, 0) c, 1 + cast(1000000000 as hugeint) * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v) p
  from g join kept using (lang) join v using (lang) left join n on n.lang = g.lang and n.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
sums as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) s from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by 1, 2, 3),
pairs as (select a.lang, a.source, b.source item, cast(coalesce(s, 0) as bigint) "value"
  from g a join g b on b.lang = a.lang and b.source <> a.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term item, cast((p - q) * (p - q) // (p + q) as bigint) "value" from p join q using (lang, term) where c > 0 and p > q)
select lang, source, 'pair' part, item, "value", cast(row_number() over (partition by lang, source order by "value" desc, encode(item)) as int) "rank" from pairs
union all
select lang, source, 'term', item, "value", cast(row_number() over (partition by lang, source order by "value" desc, encode(item)) as int) "rank" from terms qualify "rank" <= 10"""
