"""Queries over records: filters, joins, counts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import filters as C
from corpusloom.operators import grids as G
from corpusloom.operators import joins as J
from corpusloom.operators import ordering as O
from corpusloom.operators import runs as R
from corpusloom.operators import setops as H

from .bindings import EVALS, GROUP_SQL, POSITIONS, RECORDS, STEPS, evaluations, positions, records, source_group, steps, table
from .catalog import query
from .text_queries import MOVES_SQL, moves_sql, movetext

YEAR_SQL = "case when regexp_matches(date, '^[0-9]{4}') then substr(date, 1, 4) else 'unknown' end"


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).withColumns({"year": T.year_of(F.col("date")), "month": T.month_of(F.col("date"))})


@query("count_by_file", f"with {RECORDS} select site, count(*) n from records group by site")
def count_by_file(spark: SparkSession, d: str) -> DataFrame:
    return G.counted(records(spark, d), ["site"])


@query("count_by_year", f'with {RECORDS} select {YEAR_SQL} "year", count(*) n from records group by 1')
def count_by_year(spark: SparkSession, d: str) -> DataFrame:
    return G.counted(_dated(spark, d), ["year"])


@query("count_by_month", f"with {RECORDS} select replace(substr(date, 1, 7), '.', '-') \"month\", count(*) n from records group by 1")
def count_by_month(spark: SparkSession, d: str) -> DataFrame:
    return G.counted(_dated(spark, d), ["month"])


@query("count_by_tag", f"with {RECORDS} select tag, count(*) n from records group by tag")
def count_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return G.counted(records(spark, d), ["tag"])


@query("count_crosstab", f'with {RECORDS} select {YEAR_SQL} "year", tag, result, count(*) n from records group by all')
def count_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return G.counted(_dated(spark, d), ["year", "tag", "result"])


@query("count_top", f"with {RECORDS}, g as (select player, count(*) n from records group by player) select *, (select count(*) from g) total_groups from g order by n desc, player limit 10")
def count_top(spark: SparkSession, d: str) -> DataFrame:
    return G.top(G.counted(records(spark, d), ["player"]), ["player"], "n", 10)


@query("count_rollup", f"with {RECORDS} select tag, count(*) n, grouping(tag)::int is_total from records group by rollup (tag)")
def count_rollup(spark: SparkSession, d: str) -> DataFrame:
    return G.counted_with_total(records(spark, d), ["tag"])


@query(
    "source_totals",
    f"""with {RECORDS}, g as (select site, case when player_id % 3 = 0 then 'otb' when player_id % 3 = 1 then 'online' else 'unknown' end source_group, {YEAR_SQL} "year" from records),
v as (select site, "year", unnest(['all', source_group]) "view" from g)
select 'file' level, site "key", null "year", count(*) n from g group by site
union all select 'view', "view", null, count(*) from v group by "view" union all select 'view_year', "view", "year", count(*) from v group by "view", "year\"""",
)
def source_totals(spark: SparkSession, d: str) -> DataFrame:
    g = _dated(spark, d).select("site", "year", source_group(F.col("player_id")).alias("g"))
    v = g.select("site", "year", F.explode(F.array(F.lit("all"), F.col("g"))).alias("view"), (F.col("g").isNotNull()).alias("x"))
    sets = [["view"], ["view", "year"]]
    views = G.grouping_totals(v, sets, ["view", "year"])
    views = views.select(F.when(F.col("year").isNull(), "view").otherwise("view_year").alias("level"), F.col("view").alias("key"), "year", "n")
    files = g.groupBy("site").agg(F.count("*").alias("n"))
    return files.select(F.lit("file").alias("level"), F.col("site").alias("key"), F.lit(None).cast("string").alias("year"), "n").unionByName(views)


@query("grep_tokens", "select p_partkey, p_name, p_brand from part where (contains(lower(p_name), 'red') and contains(lower(p_name), 'ring')) or (contains(lower(p_type), 'red') and contains(lower(p_type), 'ring'))")
def grep_tokens(spark: SparkSession, d: str) -> DataFrame:
    return C.grep(table(spark, d, "part"), {("p_name", "p_type"): "RÉD, ring"}).select("p_partkey", "p_name", "p_brand")


@query("grep_year_range", f"with {RECORDS} select record_id, date from records where try_cast(substr(date, 1, 4) as int) between 1996 and 1997")
def grep_year_range(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(C.year_between(F.col("date"), 1996, 1997)).select("record_id", "date")


@query("grep_tag", f"with {RECORDS} select record_id, tag, segment from records where contains(lower(tag), 'urgent') and contains(lower(segment), 'build')")
def grep_tag(spark: SparkSession, d: str) -> DataFrame:
    return C.grep(records(spark, d), {"tag": "Urgent", "segment": "build"}).select("record_id", "tag", "segment")


@query("source_group", f"select user_id, {GROUP_SQL} source_group, count(*) n from events group by user_id")
def source_group_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.withColumn("source_group", source_group(F.col("user_id")))


@query("known_labels", "select event_id, event_type from events where event_type in (select case when r_regionkey = 0 then 'click' when r_regionkey = 1 then 'purchase' else 'none' end from region)")
def known_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    known = table(spark, d, "region").select(F.when(k == 0, "click").when(k == 1, "purchase").otherwise("none").alias("known"))
    return C.keep_known(table(spark, d, "events"), "event_type", known, "known").select("event_id", "event_type")


@query("first_marker_positions", f"with {POSITIONS} select record_id, label, min(ply) first_step, count(*) markers from positions where pieces <= 12 group by record_id, label")
def first_marker_positions(spark: SparkSession, d: str) -> DataFrame:
    return R.first_marker(positions(spark, d).where("pieces <= 12"), ["record_id"], "ply", "label")


@query("reject_split", "select event_id, case when coalesce(value < 5, true) then 'reject' else 'ok' end status from events")
def reject_split(spark: SparkSession, d: str) -> DataFrame:
    return C.split_rejects(table(spark, d, "events"), F.col("value") < 5).select("event_id", "status")


@query("marker_exact", f"with {STEPS} select user_id, step from steps where trim(label) = 'signup'")
def marker_exact(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).where(C.marker_equals(F.col("label"), "signup")).select("user_id", "step")


@query("min_markers", "select doc_id, (length(text) - length(replace(text, '|', '')))::int markers from documents where length(text) - length(replace(text, '|', '')) >= 3")
def min_markers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("|")))
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"\|")).alias("markers")).where("markers >= 3")


@query("limit_games", f"with {RECORDS} select record_id, site from records where record_id < 100")
def limit_games(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("record_id < 100").select("record_id", "site")


@query("status_mark", f"with {POSITIONS} select record_id, ply, case when label = 'O' and pieces > 40 then 'skipped' when label = 'O' then 'pending' else 'ok' end status from positions")
def status_mark(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d).withColumn("status", F.when(F.col("label") == "O", "pending").otherwise("ok"))
    return C.mark_oversized(p, "status", "pieces", 40, "skipped").select("record_id", "ply", "status")


@query("route_by_size", f"with {POSITIONS} select record_id, ply, case when pieces <= 5 then 'small' else 'large' end scorer, case when pieces <= 5 then pieces * 100 else pieces end scored from positions")
def route_by_size(spark: SparkSession, d: str) -> DataFrame:
    return C.route_by_size(positions(spark, d), "pieces", 5, F.col("pieces") * 100, F.col("pieces")).select("record_id", "ply", "scorer", "scored")


@query("rule_matrix", "select c_mktsegment, \"rule\", count(distinct c_custkey) n from (select *, unnest(list_filter([case when c_acctbal < 0 then 'debt' end, case when c_acctbal >= 5000 then 'rich' end, case when c_nationkey < 5 then 'near' end], lambda x: x is not null)) \"rule\" from customer) group by all")
def rule_matrix(spark: SparkSession, d: str) -> DataFrame:
    rules = {"debt": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") >= 5000, "near": F.col("c_nationkey") < 5}
    return C.matched_rules(table(spark, d, "customer"), rules).groupBy("c_mktsegment", "rule").agg(F.count_distinct("c_custkey").alias("n"))


@query("eval_left_default", f"with {POSITIONS}, {EVALS} select record_id, ply, coalesce(winner, 'missing') winner from positions left join evals using (eval_key)")
def eval_left_default(spark: SparkSession, d: str) -> DataFrame:
    return J.with_default(positions(spark, d), evaluations(spark, d), "eval_key", {"winner": "missing"}).select("record_id", "ply", "winner")


@query("catalog_zero_fill", "select n_nationkey, n_name, coalesce(n, 0) n from nation left join (select c_nationkey, count(*) n from customer where c_acctbal > 9900 group by 1) on c_nationkey = n_nationkey")
def catalog_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return J.zero_filled(table(spark, d, "nation").select("n_nationkey", "n_name"), facts, "n_nationkey", ["n"])


@query("catalog_parent", "select n_name, r_name parent, r_regionkey + 1 || '.1' || chr(96 + row_number() over (partition by r_regionkey order by n_name)::int) row_id from nation join region on n_regionkey = r_regionkey")
def catalog_parent(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_name"))
    letter = F.chr(F.lit(96) + place)
    return both.select("n_name", F.col("r_name").alias("parent"), F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(".1"), letter).alias("row_id"))


_EXPECT = "expected as (select c_nationkey k, count(*) e from customer where c_custkey % 7 <> 0 or c_nationkey < 12 group by 1), actual as (select c_nationkey k, count(*) a from customer where c_nationkey <> 3 group by 1)"


@query("reconcile_sources", f"with {_EXPECT} select k, e expected, a actual, case when a is null then 'missing' when e is null then 'unexpected' else 'different' end state from expected full join actual using (k) where e is distinct from a")
def reconcile_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "k")
    expected = c.where("c_custkey % 7 <> 0 or k < 12").groupBy("k").agg(F.count("*").alias("n"))
    actual = c.where("k <> 3").groupBy("k").agg(F.count("*").alias("n"))
    return J.reconcile(expected, actual, ["k"], "n")


@query("fallback_join", "select c_custkey, coalesce(b1.v, b2.v, b3.v) v from customer left join (select p_brand k, min(p_partkey) v from part group by 1) b1 on b1.k = 'Brand#' || (c_nationkey + 20) left join (select p_brand k, min(p_partkey) v from part group by 1) b2 on b2.k = 'Brand#' || c_nationkey left join (select p_brand k, min(p_partkey) v from part group by 1) b3 on b3.k = 'Brand#1'")
def fallback_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    book = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("v"))
    n = F.col("c_nationkey")
    names = [F.concat(F.lit("Brand#"), (n + 20).cast("string")), F.concat(F.lit("Brand#"), n.cast("string")), F.lit("Brand#1")]
    return J.first_candidate(c, "c_custkey", names, book, "name", "v").select("c_custkey", "v")


@query("overlay_annotations", "select o_orderkey, notes from orders left join (select l_orderkey, list_distinct(list(l_returnflag order by l_linenumber, l_returnflag)) x, array_to_string(list_sort(list_distinct(list(l_returnflag))), ' ') notes from lineitem group by 1) on l_orderkey = o_orderkey")
def overlay_annotations(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey")
    stacked = J.overlay(o, notes, ["o_orderkey"], "l_linenumber", "l_returnflag")
    return stacked.select("o_orderkey", F.array_join(F.array_sort("notes"), " ").alias("notes"))


@query("deepest_match", "with b as (select p_size k, arg_min(p_type, p_partkey) entry from part group by 1), h as (select l_orderkey, l_linenumber, entry from lineitem join b on k = cast(l_quantity as int) where l_linenumber <= 5) select l_orderkey, max(l_linenumber) l_linenumber, max_by(entry, (l_linenumber, entry)) entry from h group by 1")
def deepest_match(spark: SparkSession, d: str) -> DataFrame:
    book = table(spark, d, "part").select(F.col("p_size").alias("k"), F.col("p_type").alias("entry"), "p_partkey")
    moves = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("k"))
    return J.deepest_match(moves, ["l_orderkey"], "l_linenumber", "k", book, "p_partkey", 5)


_KEY = "md5(regexp_replace(text, '\\s+$', ''))"
_A, _MARKED = f"(select doc_id, {_KEY} k from documents)", f"(select {_KEY} k from documents where doc_id in (select doc_id from labels))"


def _operands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and those of them that have labels."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("set_union", f"select k, arg_min(side, (side, id)) side, arg_min(id, (side, id)) id from (select 0 side, doc_id id, {_KEY} k from documents union all select 1, item_id, {_KEY} from benchmark) group by k")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.lit(0).alias("side"), F.col("doc_id").alias("id"), "text")
    b = table(spark, d, "benchmark").select(F.lit(1).alias("side"), F.col("item_id").alias("id"), "text")
    return H.union_distinct(a, b, "text", ["id"]).select(H.content_key("text").alias("k"), "side", "id")


@query("set_intersect", f"select k, min(doc_id) doc_id from {_A} where k in (select k from {_MARKED}) group by k")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _operands(spark, d)
    return H.intersect_distinct(a, b, "text", ["doc_id"]).select(H.content_key("text").alias("k"), "doc_id")


@query("set_diff", f"select k, min(doc_id) doc_id from {_A} where k not in (select k from {_MARKED}) group by k")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _operands(spark, d)
    return H.difference_distinct(a, b, "text", ["doc_id"]).select(H.content_key("text").alias("k"), "doc_id")


@query("dedup_normalized", f"with {MOVES_SQL} select min(o_orderkey) o_orderkey from moves group by moves")
def dedup_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Records whose moves are new, the first in order."""
    m = movetext(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    return H.first_wins(m, H.normalised_key("t"), ["o_orderkey"]).select("o_orderkey")


@query("concat_dedup", f"with {MOVES_SQL}, {moves_sql('others', 'customer', 'c_custkey', 'c_nationkey')} select arg_min(src, (src, id)) src, arg_min(id, (src, id)) id from (select 0 src, c_custkey id, moves from others union all select 1, o_orderkey, moves from moves) group by moves")
def concat_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Records of two sources one after the other, cleaned, the first of equal moves."""
    a = movetext(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey").select(F.lit(0).alias("src"), F.col("c_custkey").alias("id"), T.clean(F.col("t")).alias("t"))
    b = movetext(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey").select(F.lit(1).alias("src"), F.col("o_orderkey").alias("id"), T.clean(F.col("t")).alias("t"))
    return H.first_wins(a.unionByName(b), H.normalised_key("t"), ["src", "id"]).select("src", "id")


@query("dedup_stats", f"with {MOVES_SQL} select count(*) seen, count(distinct moves) written, count(*) - count(distinct moves) removed from moves")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return H.dedup_stats(movetext(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey"), H.normalised_key("t"))


@query("upsert_ignore", "select user_id, event_type, min(event_id) event_id from events group by all")
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return H.first_wins(e, F.struct("user_id", "event_type"), ["event_id"])


@query("upsert_replace", "select user_id, event_type, max(event_id) event_id from events group by all")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    return H.last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("rule_dedup", "select p_partkey from part where p_partkey >= 1000 and sha256(regexp_replace(p_name || p_type, '\\s', '', 'g')) not in (select sha256(regexp_replace(p_name || p_type, '\\s', '', 'g')) from part where p_partkey < 1000 and p_size < 20)")
def rule_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", F.sha2(F.regexp_replace(F.concat("p_name", "p_type"), r"\s", ""), 256).alias("body"))
    canonical = p.where("p_partkey < 1000 and p_size < 20").select("body").distinct()
    return p.where("p_partkey >= 1000").join(canonical, "body", "left_anti").select("p_partkey")


@query("pair_counts", "with s as (select distinct l_orderkey o, l_returnflag || l_linestatus x from lineitem) select a.x a, b.x b, count(*) n from s a join s b on a.o = b.o and a.x < b.x group by all")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.pair_counts(table(spark, d, "lineitem").withColumn("x", F.concat("l_returnflag", "l_linestatus")), ["l_orderkey"], "x")


@query("label_overlap", "with s as (select l_orderkey o, l_returnflag x, count(*) c from lineitem group by all), k as (select o, count(*) k from s group by o) select x label, count(*) entities, cast(sum(c) as bigint) instances, count(*) filter (k = 1) exclusive, count(*) filter (k > 1) overlapping from s join k using (o) group by x")
def label_overlap(spark: SparkSession, d: str) -> DataFrame:
    return J.label_overlap(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label"), ["l_orderkey"], "label")


@query("pending_keys", f"with {POSITIONS}, {EVALS} select eval_key, min(pieces) pieces from positions where eval_key not in (select eval_key from evals) group by eval_key")
def pending_keys(spark: SparkSession, d: str) -> DataFrame:
    missing = positions(spark, d).groupBy("eval_key").agg(F.min("pieces").alias("pieces")).join(evaluations(spark, d), "eval_key", "left_anti")
    return missing.orderBy("pieces", "eval_key")


@query("completeness", "select n_name, t.x tag from nation, (select distinct o_orderpriority x from orders) t where not exists (select 1 from orders join customer on o_custkey = c_custkey where c_nationkey = n_nationkey and o_orderpriority = t.x and o_totalprice > 495000)")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    grid = table(spark, d, "nation").select(F.col("n_name").alias("site")).crossJoin(F.broadcast(r.select("tag").distinct()))
    return grid.join(r.where("price > 495000").select("site", "tag").distinct(), ["site", "tag"], "left_anti").select(F.col("site").alias("n_name"), "tag")


@query("invariants", "select l_orderkey, count(*) all_count, count(distinct l_partkey) first_count, count(*) >= count(distinct l_partkey) and min(l_quantity) >= 0 valid from lineitem group by 1")
def invariants(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("all_count"), F.count_distinct("l_partkey").alias("first_count"), F.min("l_quantity").alias("least"))
    return g.select("l_orderkey", "all_count", "first_count", ((F.col("all_count") >= F.col("first_count")) & (F.col("least") >= 0)).alias("valid"))


@query("hash_sample", "select event_type, event_id, place from (select event_type, event_id, row_number() over (partition by event_type order by md5('s|' || event_id)) place from events) where place <= 5")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id")
    return O.hash_sample(e, ["event_type"], O.hash_order([F.col("event_id")], "s"), 5).select("event_type", "event_id", F.col("place"))


_DEALT = "d as (select *, row_number() over (partition by event_type, g order by h) r from (select event_type, event_id, user_id % 3 g, md5('s|' || event_id) h from events))"


@query("stratified_sample", f"with {_DEALT}, p as (select *, row_number() over (partition by event_type order by r, g) place from d) select event_type, event_id, place, available from p join (select event_type, count(*) available from events group by 1) using (event_type) where place <= 6")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", (F.col("user_id") % 3).alias("g"))
    return O.stratified_sample(e, ["event_type"], "g", O.hash_order([F.col("event_id")], "s"), 6).select("event_type", "event_id", "place", "available")


@query("quota_sample", "select event_type, event_id from (select *, row_number() over (partition by event_type order by md5('q|' || event_id)) place from events) where place <= case event_type when 'click' then 3 when 'view' then 7 else 0 end")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id")
    return O.quota_sample(e, "event_type", {"click": 3, "view": 7}, O.hash_order([F.col("event_id")], "q")).select("event_type", "event_id")


@query("sample_cap", "with f as (select event_type, user_id, min(event_id) f, count(*) markers from events group by all) select event_type, user_id, markers, place from (select *, row_number() over (partition by event_type order by f) place from f) where place <= 4")
def sample_cap(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("f"), F.count("*").alias("markers"))
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("f"))
    return per.withColumn("place", place).where("place <= 4").select("event_type", "user_id", "markers", "place")


@query("top_label", f"with {RECORDS}, g as (select site, tag, count(*) n from records group by all) select site, arg_min(tag, (-n, tag)) top_label, max(n) n from g group by site")
def top_label(spark: SparkSession, d: str) -> DataFrame:
    return O.top_label(G.counted(records(spark, d), ["site", "tag"]), "site", "tag", "n")


@query("source_order", "select s_suppkey, regexp_replace(s_name, '^.*#0*', '') stem, row_number() over (order by case when s_nationkey < 10 then s_nationkey else 99 end, s_suppkey) place from supplier")
def source_order(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("s_nationkey") < 10, F.col("s_nationkey")).otherwise(99)
    sources = table(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "^.*#0*", "").alias("stem"), lead.alias("lead"))
    return O.numbered(sources, ["lead", "s_suppkey"]).drop("lead")


@query("metric_sort", f"with {RECORDS}, g as (select site, count(*) n, round(sum(price), 2) total from records group by site) select site, n, total, row_number() over (order by total desc, site) place from g")
def metric_sort(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).groupBy("site").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    return O.numbered(g, [F.desc("total"), "site"])


@query("names_per_key", "select p_brand, array_to_string(list_sort(list_distinct(list(p_name))), ';') names from part group by p_brand")
def names_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ";").alias("names"))


@query("label_alias", "with n as (select p_brand, list_sort(list_distinct(list(p_name))) x, arg_min(p_name, (length(p_name), p_name)) label from part group by 1) select p_brand, label, array_to_string((list_filter(x, lambda y: y <> label))[1:24], ', ') aliases from n")
def label_alias(spark: SparkSession, d: str) -> DataFrame:
    """The shortest name as label, the first 24 others by name as aliases."""
    g = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("x"), F.min(F.struct(F.length("p_name").alias("k"), "p_name")).alias("m"))
    label = F.col("m.p_name")
    return g.select("p_brand", label.alias("label"), F.array_join(F.slice(F.filter("x", lambda y: y != label), 1, 24), ", ").alias("aliases"))
