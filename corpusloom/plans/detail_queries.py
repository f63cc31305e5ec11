"""Queries over names of sources, cleaning of move numbers, comments, filters of counts, and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.functions import text as T
from corpusloom.operators import exports as X
from corpusloom.operators import filters as C
from corpusloom.operators import joins as J
from corpusloom.operators import ordering as O
from corpusloom.operators.quotas import two_quota_sample
from corpusloom.sources import movetext as M

from .bindings import ENTITY, FACTS, RECORDS, facts, records, table
from .catalog import query
from .movetext_queries import _BRANCHED, branched

PREFIXES = {"otb": "Hall_OTB_", "online": "Hall_Online_"}


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """supplier as source files of two families and of none, with years, part releases and no dates."""
    k = F.col("s_suppkey")
    family = F.when(k % 3 == 0, "Hall_OTB_").when(k % 3 == 1, "Hall_Online_").otherwise("club-")
    when = F.when(k % 7 == 0, "noDate").when(k % 7 == 1, F.concat(F.lit("19"), (k % 90 + 10).cast("string"), F.lit("-more"))).when(k % 7 == 2, F.concat((k % 60 + 1970).cast("string"), F.lit("_partial_release"))).otherwise(F.concat(F.lit("x"), (k % 50).cast("string"), F.lit("_"), (k % 50).cast("string")))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/in/a.b/"), family, when, F.lit(".pgn")).alias("path"))


_FILES = """f as (select s_suppkey, case s_suppkey % 3 when 0 then 'Hall_OTB_' when 1 then 'Hall_Online_' else 'club-' end || case s_suppkey % 7 when 0 then 'noDate' when 1 then '19' || (s_suppkey % 90 + 10) || '-more'
  when 2 then (s_suppkey % 60 + 1970) || '_partial_release' else 'x' || (s_suppkey % 50) || '_' || (s_suppkey % 50) end stem from supplier),
g as (select *, case when stem like 'Hall\\_OTB\\_%' escape '\\' then 'otb' when stem like 'Hall\\_Online\\_%' escape '\\' then 'online' end family, regexp_replace(stem, '^Hall_(OTB|Online)_', '') r,
  case when stem like '%\\_noDate' escape '\\' then 999999 else coalesce(cast((list_transform(list_filter(string_split(replace(stem, '-', '_'), '_'), lambda w: regexp_matches(w, '^([0-9]{4}.*|[0-9]+)$')), lambda w: left(w, 4)))[1] as int), 999998) end y from f)"""


@query(
    "source_labels",
    f"with {_FILES} select s_suppkey, family as \"group\", case when family is null then 'reject' else 'ok' end status, concat_ws(':', family, r) \"key\", concat_ws(' ', case family when 'otb' then 'OTB' when 'online' then 'Online' end, replace(replace(r, '_partial_release', ' partial'), '_', ' ')) title, y \"year\", row_number() over (order by y, stem, s_suppkey) place from g",
)
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Groups, keys, titles and years from the names of source files, in order of years; files of no known family are rejects."""
    f = source_files(spark, d).withColumn("stem", N.stem(F.col("path")))
    s = F.col("stem")
    told = f.select("s_suppkey", "stem", N.group(s, PREFIXES).alias("group"), N.key(s, PREFIXES).alias("key"), N.title(s, PREFIXES, {"otb": "OTB", "online": "Online"}).alias("title"), N.year(s).alias("year"))
    told = C.split_rejects(told, F.col("group").isNull())
    return O.numbered(told, ["year", "stem", "s_suppkey"]).drop("stem")


@query(
    "black_numbers",
    """with w as (select l_orderkey k, list(case l_partkey % 6 when 0 then l_linenumber || '...' when 1 then l_linenumber || '...Nf' || l_suppkey when 2 then '$' || l_linenumber when 3 then l_linenumber || '....' when 4 then l_linenumber || '..' else 'e' || l_suppkey end
  order by l_linenumber, l_partkey, l_suppkey) w from lineitem group by l_orderkey),
i as (select k, w, coalesce(list_position(list_transform(w, lambda x: x[1] <> '$'), true), 0) first_ from w)
select k, array_to_string(list_filter(list_transform(w, lambda x, j: case when j > first_ and regexp_matches(x, '^[0-9]+\\.\\.\\.([^.]|$)') then regexp_replace(x, '^[0-9]+\\.\\.\\.', '') else x end), lambda x: x <> ''), ' ') words from i""",
)
def black_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Words of movetext without the numbers of black moves that nothing needs any more."""
    n, p, s = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    k = F.col("l_partkey") % 6
    word = F.when(k == 0, F.concat(n, F.lit("..."))).when(k == 1, F.concat(n, F.lit("...Nf"), s)).when(k == 2, F.concat(F.lit("$"), n)).when(k == 3, F.concat(n, F.lit("...."))).when(k == 4, F.concat(n, F.lit(".."))).otherwise(F.concat(F.lit("e"), s))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", word.alias("w"))))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(listed, lambda r: r["w"]).alias("w"))
    return rows.select("k", F.array_join(T.drop_black_numbers(F.col("w")), " ").alias("words"))


@query(
    "original_comments",
    f"""with {_BRANCHED}, t as (select l_orderkey, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, ';[^\\n]*\\n', ' ', 'g'), '\\([^()]*\\)', ' ', 'g'), '\\([^()]*(\\([^()]*\\)[^()]*)*\\)', ' ', 'g'), '\\{{[^}}]*\\}}|[a-z][a-z0-9]*') w from
  (select l_orderkey, replace(text, '(f1 (g1))', '') as text from b)),
u as (select l_orderkey, unnest(w) x, generate_subscripts(w, 1) i from t), p as (select *, count(*) filter (x[1] <> '{{') over (partition by l_orderkey order by i) ply from u)
select l_orderkey, ply, string_agg(x[2:len(x) - 1], ' ' order by i) as comment from p where x[1] = '{{' group by l_orderkey, ply having regexp_matches(string_agg(x[2:len(x) - 1], ' ' order by i), '^a[0-9]*[05]$')""",
)
def original_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of the main line that match a pattern, with the ply that they follow."""
    found = M.comments(branched(spark, d), ["l_orderkey"], "text")
    return found.where(F.col("comment").rlike("^a[0-9]*[05]$")).select("l_orderkey", "ply", "comment")


@query("markers_within", "select event_type, count(*) filter (trim(props) = '{\"k\": 29}') exact_n, count(*) filter (contains(props, '1')) within_n from events group by event_type")
def markers_within(spark: SparkSession, d: str) -> DataFrame:
    """Comments that are a marker, and comments that contain one."""
    e, props = table(spark, d, "events"), F.col("props")
    return e.groupBy("event_type").agg(F.count_if(C.marker_equals(props, '{"k": 29}')).alias("exact_n"), F.count_if(C.marker_within(props, "1")).alias("within_n"))


@query("pair_counts_shown", f"with {FACTS}, l as (select user_id, label from facts where run_length >= 2 and label <> 'view') select a.label a, b.label b, count(*) n from l a join l b on a.user_id = b.user_id and a.label < b.label where contains(a.label, 'c') or contains(b.label, 'c') group by all having count(*) > 0")
def pair_counts_shown(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels as a table shows them: without the generic label, of runs long enough, with a text in one of the two."""
    shown = facts(spark, d).where((F.col("run_length") >= 2) & (F.col("label") != "view"))
    return J.pair_counts(shown, ENTITY, "label").where((F.contains("a", F.lit("c")) | F.contains("b", F.lit("c"))) & (F.col("n") > 0))


@query("group_counts", "with m as (select unnest(['fast', 'fast', 'slow', 'slow', 'slow']) g, unnest(['click', 'view', 'purchase', 'error', 'signup']) label), c as (select event_type label, count(*) n, count(distinct user_id) users from events group by 1) select coalesce(g, 'other') g, cast(sum(n) as bigint) n, cast(max(users) as bigint) most_users, count(*) labels from c left join m using (label) group by 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of labels merged into groups of labels; a label of no group is other."""
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    g = F.when(F.col("label").isin("click", "view"), "fast").when(F.col("label").isin("purchase", "error", "signup"), "slow").otherwise("other")
    return c.groupBy(g.alias("g")).agg(F.sum("n").alias("n"), F.max("users").alias("most_users"), F.count("*").alias("labels"))


def rule_outputs(results: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """The results of one rule on each source as one output, source by source in order, rows numbered."""
    parts = [df.withColumns({"source": F.lit(s), "turn": F.lit(k)}) for k, (s, df) in enumerate(sorted(results.items()))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return O.numbered(rows, ["turn", *order]).drop("turn")


@query("rule_outputs", f"with {RECORDS}, r as (select record_id, price, case segment when 'BUILDING' then 'a' when 'MACHINERY' then 'b' else 'c' end source, case when segment not in ('BUILDING', 'MACHINERY') then site end site from records where result = '1-0' and price > 100000) select *, row_number() over (order by source, record_id) place from r")
def rule_outputs_query(spark: SparkSession, d: str) -> DataFrame:
    """The records that one rule finds in three sources, concatenated; a column that a source lacks is null."""
    r = records(spark, d).where((F.col("result") == "1-0") & (F.col("price") > 100_000))
    segment = F.col("segment")
    found = {"a": r.where(segment == "BUILDING").select("record_id", "price"), "b": r.where(segment == "MACHINERY").select("record_id", "price"), "c": r.where(~segment.isin("BUILDING", "MACHINERY")).select("record_id", "price", "site")}
    return rule_outputs(found, ["record_id"])


@query("position_facts", f"with {FACTS} select md5(f.user_id::varchar || chr(31) || f.label) fact_key, f.user_id, f.label, s.step ply_index, s.step - f.run_start + 1 place_in_run, f.run_length from facts f join steps s on s.user_id = f.user_id and s.label = f.label and s.step between f.run_start and f.run_end")
def position_facts(spark: SparkSession, d: str) -> DataFrame:
    """A fact for each position of an entity's first run of a label, with its ply; positions come from the run's bounds, not from a join."""
    f = facts(spark, d)
    key = T.entity_key([F.col("user_id").cast("string"), F.col("label")])
    rows = f.select(key.alias("fact_key"), "user_id", "label", "run_start", "run_length", F.explode(F.sequence("run_start", "run_end")).alias("ply_index"))
    return rows.select("fact_key", "user_id", "label", "ply_index", (F.col("ply_index") - F.col("run_start") + 1).alias("place_in_run"), "run_length")


def share_row(name: Column, n: Column, total: Column) -> Column:
    """A row of a table with a count in groups of three digits and its share of the total to two places."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", name, F.format_number(n, 0), F.concat(F.format_number(100 * n / total, 2), F.lit("%"))), F.lit(" |"))


@query("share_table", "with n as (select l_returnflag mode, count(*) * 1000 n from lineitem group by 1), t as (select sum(n) t from n) select '| ' || mode || ' | ' || format('{:,}', n) || ' | ' || format('{:.2f}', 100 * n / t) || '% |' line from n, t")
def share_table(spark: SparkSession, d: str) -> DataFrame:
    """Counts and percentages as rows of a table."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg((F.count("*") * 1000).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select(share_row(F.col("mode"), F.col("n"), F.col("t")).alias("line"))  # one row


@query("text_issues", """with p as (select page_id, case page_id % 4 when 0 then '[Event "x"]' || chr(10) || url when 1 then chr(65279) || ' [Event "y"]' when 2 then url || chr(65533) else url || chr(7) end t from pages)
select page_id, t[1] = chr(65279) bom, contains(t, chr(65533)) bad_text, regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') controls, not regexp_matches(t, '(^|\\n)[\\x{FEFF}\\s]*\\[Event ') no_event from p""")
def text_issues(spark: SparkSession, d: str) -> DataFrame:
    """What stands against reading a text as records: marks, broken characters, control characters, no record at all."""
    k, url = F.col("page_id") % 4, F.col("url")
    t = F.when(k == 0, F.concat(F.lit('[Event "x"]\n'), url)).when(k == 1, F.lit('﻿ [Event "y"]')).when(k == 2, F.concat(url, F.lit("�"))).otherwise(F.concat(url, F.lit("\x07")))
    found = T.inspect(F.col("t"))
    no_event = ~F.col("t").rlike(r"(^|\n)[﻿\s]*\[Event ")
    return table(spark, d, "pages").withColumn("t", t).select("page_id", (found["boms"] > 0).alias("bom"), (found["replacements"] > 0).alias("bad_text"), (found["controls"] > 0).alias("controls"), no_event.alias("no_event"))


@query("two_quotas")
def two_quotas(spark: SparkSession, d: str) -> DataFrame:
    """events under a quota for each type and one for each group of users, as many as both allow."""
    e = table(spark, d, "events").withColumn("source", (F.col("user_id") % 4).cast("string"))
    kinds = {"click": 300, "view": 500, "purchase": 200, "error": 100, "signup": 250}
    key = O.hash_order([F.col("event_id")], "two")
    return two_quota_sample(e.select("event_id", "event_type", "source"), "event_type", "source", kinds, {"0": 150, "1": 400, "2": 300}, key)


@query("searched_customers", "select c_custkey from customer where (contains(lower(c_name), '7') or contains(lower(c_mktsegment), '7')) and (contains(lower(c_name), 'mach') or contains(lower(c_mktsegment), 'mach')) and contains(lower(c_name), 'customer') and contains(lower(c_name), '1')")
def searched_customers(spark: SparkSession, d: str) -> DataFrame:
    """Rows that match several queries, one of them on either of two fields, token by token."""
    c = table(spark, d, "customer")
    found = C.grep(c, {("c_name", "c_mktsegment"): "7", ("c_mktsegment", "c_name"): "MACH", "c_name": "1 Customer"})
    return found.select("c_custkey")


@query("scored_parts", "select p_partkey, greatest(-1000, least(1000, (p_size - 25) * 40)) score, case when p_size = 25 then 'draw' when p_size > 25 then 'white' else 'black' end winner from part")
def scored_parts(spark: SparkSession, d: str) -> DataFrame:
    """Keys scored by a function over frames that the caller hands in."""

    def scorer(frame):  # noqa: ANN001, ANN202
        score = ((frame["p_size"] - 25) * 40).clip(-1000, 1000)
        return frame.assign(score=score, winner=score.map(lambda x: "draw" if x == 0 else "white" if x > 0 else "black"))[["p_partkey", "score", "winner"]]

    return X.score_pending(table(spark, d, "part").select("p_partkey", "p_size"), scorer, "p_partkey long, score long, winner string")
