"""Queries that write a table in the formats of records, facts and summaries and read it back.

Files go to the shared folder; what is read is compared with what the table holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import exports as X
from corpusloom.operators import joins as J
from corpusloom.sources import records as S
from corpusloom.sources import sinks, tables

from .bindings import table
from .catalog import query
from .stream_queries import shared_folder
from .text_queries import MOVES_SQL, movetext

#: A comment that looks like tags: it splits records only where a mark needs no quote, and gives no headers.
_TAGLIKE = "~{~[Event none]~[Round ^9^]~}"
_RAW = """raw as (select o_orderkey, o_custkey % 5 part, '[Event "e' || o_orderkey || '"]' || chr(10) || '[White "w' || o_custkey || '"]' || chr(10) || '[Result "*"]' || chr(10) || chr(10)
  || case when o_orderkey % 3 = 0 then rtrim(t) || chr(10) || '{' || chr(10) || '[Event none]' || chr(10) || '[Round "9"]' || chr(10) || '}' when t = '' then '*' else rtrim(t) end raw from moves)"""


def _written(spark: SparkSession, d: str) -> str:
    """orders as record files, one for each fifth of the customers; the folder."""
    o = movetext(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    head = F.map_from_arrays(F.array(F.lit("Event"), F.lit("White"), F.lit("Result")), F.array(F.concat(F.lit("e"), "o_orderkey"), F.concat(F.lit("w"), "o_custkey"), F.lit("*")))
    taglike = F.lit(_TAGLIKE.replace("~", "\n").replace("^", '"'))
    moves = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.rtrim("t"), taglike)).when(F.col("t") == "", "*").otherwise(F.rtrim("t"))
    raw = o.select("o_orderkey", (F.col("o_custkey") % 5).alias("part"), S.to_text(head, moves).alias("raw"))
    path = shared_folder(spark, "records")
    sinks.write_records(raw, "raw", path, "part", "o_orderkey")
    return path


def _read(spark: SparkSession, d: str, reader) -> DataFrame:
    return reader(spark, _written(spark, d), "*.txt")


@query("record_files", f"with {MOVES_SQL} select 'e' || o_orderkey event, 'w' || o_custkey white, 3 tags, moves from moves")
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """Records written to files and read back: their headers and moves."""
    r = S.parsed(_read(spark, d, S.read_strict_records))
    return r.select(F.col("headers")["Event"].alias("event"), F.col("headers")["White"].alias("white"), F.size("headers").alias("tags"), T.normalize_moves(F.col("movetext")).alias("moves"))


@query("record_numbers", f"""with {MOVES_SQL}, {_RAW}, n as (select *, length(raw) - length(replace(raw, chr(10), '')) + 2 lines from raw)
select 'e' || o_orderkey event, row_number() over (partition by part order by o_orderkey) game_index, 1 + coalesce(sum(lines) over (partition by part order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint start_line from n""")
def record_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and first lines of the records in their files."""
    r = _read(spark, d, S.read_strict_records)
    return r.select(S.headers(F.col("raw"))["Event"].alias("event"), "game_index", "start_line")


@query("record_marks", f"with {MOVES_SQL} select 'strict' reader, count(*) n from moves union all select 'any', count(*) + count(*) filter (o_orderkey % 3 = 0) from moves union all select 'blank lines', count(*) from moves")
def record_marks(spark: SparkSession, d: str) -> DataFrame:
    """How many records the readers find where a comment has a line that looks like a mark."""
    path = _written(spark, d)
    found = {"strict": S.read_strict_records(spark, path, "*.txt"), "any": S.read_records(spark, path, "*.txt"), "blank lines": S.read_blank_line_records(spark, path, "*.txt")}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("reader"), "n") for k, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


_LABELS = ("red", "ring", "small")


@query("record_markers", "select 'e' || o_orderkey event, unnest(case o_orderkey % 3 when 0 then [1, 2] when 1 then [2] else [3, 3] end) ply, unnest(case o_orderkey % 3 when 0 then ['red', 'ring'] when 1 then ['small'] else ['red', 'small'] end) label from orders")
def record_markers(spark: SparkSession, d: str) -> DataFrame:
    """Labels from the comments of record files with the ply that they follow."""
    k = F.col("o_orderkey")
    moves = F.when(k % 3 == 0, "1. e4 {red} (1. d4 {small}) e5 {ring} 1-0").when(k % 3 == 1, "1. e4 $1 e5 {small} *").otherwise("1. e4 e5 2. Nf3 {x small red} 0-1")
    raw = table(spark, d, "orders").select(S.to_text(F.create_map(F.lit("Event"), F.concat(F.lit("e"), "o_orderkey")), moves).alias("raw"))
    path = shared_folder(spark, "marked")
    sinks.write_records(raw, "raw", path)
    r = S.read_records(spark, path, "*.txt")
    found = S.markers(r, list(_LABELS), {"event": S.headers(F.col("raw"))["Event"]})
    return found.select("event", F.col("ply").cast("int").alias("ply"), "label")


@query("annotated_rows", "select l_orderkey game_index, case when l_orderkey % 7 = 0 then 'reject' else 'ok' end status, count(*) positions, string_agg('m' || l_partkey, ' ' order by l_linenumber, 'm' || l_partkey) moves from lineitem group by l_orderkey")
def annotated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Annotated records written as JSON lines and read back."""
    place = F.struct(F.col("l_linenumber").alias("ply_index"), F.concat(F.lit("m"), "l_partkey").alias("move_uci"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("positions"))
    errors = F.when(F.col("l_orderkey") % 7 == 0, F.array(F.lit("bad")))
    path = shared_folder(spark, "annotated")
    g.select(F.col("l_orderkey").alias("game_index"), errors.alias("parse_errors"), F.transform("positions", lambda p: p["move_uci"]).alias("move_uci_sequence"), "positions").write.json(path)
    r = S.read_annotated(spark, path)
    return r.select("game_index", "status", F.size("positions").alias("positions"), F.array_join("move_uci_sequence", " ").alias("moves"))


def _facts(spark: SparkSession, d: str) -> str:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "position").otherwise("game_stem")
    rows = p.select((F.lit(1) + (k % 9 == 0).cast("int")).alias("schema_version"), kind.alias("kind"), F.col("p_brand").alias("stem"), F.col("p_name").alias("game_key"), F.col("p_size").alias("position_count"), F.when(k % 4 == 0, k).cast("int").alias("ply_index"))
    path = shared_folder(spark, "facts")
    rows.write.json(path)
    return path


@query("fact_kinds", "select case when p_partkey % 4 = 0 then 'position' else 'game_stem' end kind, p_brand stem, count(*) n, sum(p_size)::bigint total from part where p_partkey % 9 <> 0 group by all")
def fact_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Facts of both kinds from JSON lines of one version, their stems checked against a catalog."""
    path, stems = _facts(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("stem"))
    both = [tables.read_facts(spark, path, kind=k, stems=stems) for k in ("position", "game_stem")]
    return both[0].union(both[1]).groupBy("kind", "stem").agg(F.count("*").alias("n"), F.sum("position_count").alias("total"))


@query("old_facts", "select p_partkey, p_brand stem, p_size run_length from part")
def old_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of an older and a newer spelling in one form."""
    new = F.col("p_partkey") % 2 == 0
    mixed = table(spark, d, "part").select("p_partkey", F.when(new, F.col("p_brand")).alias("stem"), F.when(~new, F.col("p_brand")).alias("ending"), F.when(new, F.col("p_size")).alias("run_length"), F.when(~new, F.col("p_size")).alias("length"))
    return tables.normalise_facts(mixed, {"p_partkey": ["p_partkey"], "stem": ["stem", "ending"], "run_length": ["run_length", "length", "run"]})


_SUMMARY_SQL = "s as (select s_name source, 'rule' || s_nationkey \"rule\", case when s_suppkey % 11 = 0 then 'error' else 'ok' end status, s_suppkey % 100 match_count from supplier), t as (select * from s union all select * from s where match_count = 7)"


def _summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("source"), F.concat(F.lit("rule"), "s_nationkey").alias("rule"), F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), (k % 100).cast("int").alias("match_count"))
    path = shared_folder(spark, "summary")
    sinks.write_summary(s.union(s.where("match_count = 7")), path)
    return tables.read_summary(spark, path)


@query("summary_rows", f"with {_SUMMARY_SQL} select source, \"rule\", match_count from t where status = 'ok'")
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes written as a summary and read back, those that are ok."""
    return tables.lenient_summary(_summary(spark, d)).select("source", "rule", "match_count")


@query("summary_issues", f"""with {_SUMMARY_SQL}, known as (select 'rule' || n_nationkey \"rule\" from nation where n_nationkey <> 3 union all select 'rule99')
select 'status' issue, source, \"rule\" from t where status <> 'ok' union all select 'unknown stem', source, \"rule\" from t where \"rule\" not in (select \"rule\" from known)
union all select 'repeated', source, \"rule\" from t group by source, \"rule\" having count(*) > 1 union all select 'missing', null, \"rule\" from known where \"rule\" not in (select \"rule\" from t)""")
def summary_issues(spark: SparkSession, d: str) -> DataFrame:
    """What a strict reading of a summary rejects."""
    n = table(spark, d, "nation").where("n_nationkey <> 3").select(F.concat(F.lit("rule"), "n_nationkey").alias("stem"))
    return tables.summary_issues(_summary(spark, d), n.union(spark.range(1).select(F.lit("rule99"))))


@query("totals_document", "select \"view\", \"key\", games from (select n_name \"view\", c_mktsegment \"key\", count(*) games from customer join nation on n_nationkey = c_nationkey group by all)")
def totals_document(spark: SparkSession, d: str) -> DataFrame:
    """Nested totals as JSON documents, one a view, and back as rows."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    n = c.groupBy(F.col("n_name").alias("view"), F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("games"))
    path = shared_folder(spark, "totals")
    n.groupBy("view").agg(F.map_from_entries(F.collect_list(F.struct("key", "games"))).alias("totals")).write.json(path)
    return tables.read_totals(spark, path, lines=True)


@query("catalog_file", "select p_brand stem, min(p_type) label, 'g' || left(p_brand, 7) \"group\", max(p_name) description, '#fff' color from part group by p_brand")
def catalog_file(spark: SparkSession, d: str) -> DataFrame:
    """A catalog written as CSV and read back."""
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("stem")).agg(F.min("p_type").alias("label"), F.max("p_name").alias("description"))
    path = shared_folder(spark, "catalog")
    g.select("stem", "label", F.concat(F.lit("g"), F.left("stem", F.lit(7))).alias("group"), "description", F.lit("#fff").alias("color")).write.option("header", True).csv(path)
    return tables.read_catalog(spark, path)


@query("openings_file", "select p_partkey::int row_number, upper(chr(65 + (p_partkey % 5)::int)) || '\"' || p_brand || '\", ' || p_name \"name\" from part")
def openings_file(spark: SparkSession, d: str) -> DataFrame:
    """A book with quoted fields written as CSV and read back."""
    name = F.concat(F.chr(65 + F.col("p_partkey") % 5), F.lit('"'), "p_brand", F.lit('", '), "p_name")
    none = [F.lit("x").alias(c) for c in ("eco", "eco_base", "eco_group")]
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("row_number"), *none, name.alias("name"), F.lit("e4").alias("moves"), F.lit("u").alias("source_url"))
    path = shared_folder(spark, "openings")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_openings(spark, path).select("row_number", "name")


@query("count_views", "select p_brand ending, sum(p_size)::bigint first_game_count, (sum(p_size) + count(*))::bigint all_marker_count from part group by p_brand")
def count_views(spark: SparkSession, d: str) -> DataFrame:
    """Marker counts in CSV with repeated endings, summed."""
    path = shared_folder(spark, "counts")
    table(spark, d, "part").select(F.col("p_brand").alias("ending"), F.col("p_size").alias("first_game_count"), (F.col("p_size") + 1).alias("all_marker_count")).write.option("header", True).csv(path)
    return tables.read_counts(spark, path)


@query("wdl_views", "select p_brand ending, p_type material_label, sum(p_size)::bigint wins, count(*) draws, sum(p_partkey % 3)::bigint losses from part group by all")
def wdl_views(spark: SparkSession, d: str) -> DataFrame:
    """Wins, draws and losses in CSV with repeated keys, summed."""
    path = shared_folder(spark, "wdl")
    table(spark, d, "part").select(F.col("p_brand").alias("ending"), F.col("p_type").alias("material_label"), F.col("p_size").alias("wins"), F.lit(1).alias("draws"), (F.col("p_partkey") % 3).alias("losses")).write.option("header", True).csv(path)
    return tables.read_wdl(spark, path)


@query("sampled_examples", "select p_brand stem, (p_partkey % 4)::int place, p_name game_key, p_type fen from part where p_brand in (select p_brand from part where p_size = 50)")
def sampled_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples in JSON lines, those whose stem a catalog knows."""
    p, path = table(spark, d, "part"), shared_folder(spark, "examples")
    p.select(F.col("p_brand").alias("stem"), (F.col("p_partkey") % 4).alias("place"), F.col("p_name").alias("game_key"), F.col("p_type").alias("fen")).write.json(path)
    return tables.read_examples(spark, path, p.where("p_size = 50").select(F.col("p_brand").alias("stem")))


@query("fens_file", "select c_custkey || '/8 w' fen from customer where c_custkey % 4 <> 1")
def fens_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines of positions with comments and empty lines between."""
    k = F.col("c_custkey")
    path = shared_folder(spark, "fens")
    line = F.when(k % 4 == 1, F.concat(F.lit("# "), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit("/8 w # note\n")))
    table(spark, d, "customer").select(line.alias("value")).write.text(path)
    return tables.read_fens(spark, path)


@query("facts_folder", "select c_mktsegment, c_nationkey, min(c_custkey) c_custkey from customer group by all")
def facts_folder(spark: SparkSession, d: str) -> DataFrame:
    """A fact table with one row a key in folders by segment, read back."""
    path = shared_folder(spark, "facts")
    sinks.write_facts(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_mktsegment", "c_nationkey"], ["c_custkey"], "c_mktsegment", path)
    return spark.read.parquet(path).select("c_mktsegment", "c_nationkey", "c_custkey")


@query("csv_appended", "select s_suppkey::varchar s_suppkey, s_name from supplier union all select n_nationkey::varchar, n_name from nation")
def csv_appended(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to one CSV table."""
    path = shared_folder(spark, "csv")
    sinks.append_csv(table(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    sinks.append_csv(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name")), path)
    return spark.read.option("header", True).csv(path)


@query("csv_ordered", "select o_orderpriority, n::varchar n from (select o_orderpriority, count(*) n from orders group by 1)")
def csv_ordered(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate as CSV in the order of its key, read back."""
    path = shared_folder(spark, "ordered")
    sinks.write_ordered_csv(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), ["o_orderpriority"], path)
    return spark.read.option("header", True).csv(path)


@query("chunks_written", "select c_mktsegment, c_custkey from customer")
def chunks_written(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON in a folder for each group, read back."""
    path = shared_folder(spark, "chunks")
    sinks.write_chunks(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], path)
    return spark.read.schema("c_custkey long, c_mktsegment string").json(path).select("c_mktsegment", "c_custkey")


@query("notes_inserted", """with n as (select l_orderkey, string_agg('{' || y || '}', '' order by y) x from (select distinct l_orderkey, l_linestatus || l_returnflag y from lineitem) group by 1)
select o_orderkey, left(o_orderpriority, 3) || coalesce(x, '') || substr(o_orderpriority, 4) text from orders left join n on l_orderkey = o_orderkey""")
def notes_inserted(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the distinct notes of their key put in at an offset, a closing brace in a note made a parenthesis."""
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), T.comment_delta(F.concat("l_linestatus", "l_returnflag"), F.lit("")).alias("note")).distinct()
    put = notes.groupBy("o_orderkey").agg(F.collect_list(F.struct(F.lit(3).alias("offset"), F.concat(F.lit("{"), "note", F.lit("}")).alias("note"))).alias("notes"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(put, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("notes").isNull(), F.col("o_orderpriority")).otherwise(T.inserted(F.col("o_orderpriority"), F.col("notes"))).alias("text"))


@query("comment_deltas", "select c_custkey, case c_custkey % 4 when 0 then 'more' when 1 then 'pre' when 2 then 'other)' else c_name end delta from customer")
def comment_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What a newer comment adds to the older one."""
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    new = F.when(k == 0, F.concat(name, F.lit(" more"))).when(k == 1, F.concat(F.lit("pre "), name)).when(k == 2, "other}").otherwise(name)
    return table(spark, d, "customer").select("c_custkey", T.comment_delta(new, F.when(k < 3, name)).alias("delta"))


@query("snapshot_rows", "with g as (select p_brand stem, p_size, count(*) n from part group by all), c as (select distinct p_brand stem from part union all select 'none') select c.stem, t.threshold, count(g.stem) entities, coalesce(sum(n), 0)::bigint total from c cross join (select unnest([1, 10, 40]) threshold) t left join g on g.stem = c.stem and g.p_size >= t.threshold group by all")
def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an ending's rows at several thresholds, 0 where a catalog's ending has none."""
    p = table(spark, d, "part")
    per = p.groupBy(F.col("p_brand").alias("stem"), "p_size").agg(F.count("*").alias("n"))
    grid = per.withColumn("threshold", F.explode(F.filter(F.array(*(F.lit(t) for t in (1, 10, 40))), lambda t: t <= F.col("p_size"))))
    counts = grid.groupBy("stem", "threshold").agg(F.count("*").alias("entities"), F.sum("n").alias("total"))
    catalog = p.select(F.col("p_brand").alias("stem")).distinct().union(spark.range(1).select(F.lit("none")))
    full = catalog.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (1, 10, 40)))))
    return J.zero_filled(full, counts, ["stem", "threshold"], ["entities", "total"])


@query("manifest_check", "select s_suppkey, case when s_suppkey % 5 = 0 then 'build' when s_suppkey % 3 = 0 then 'rebuild' else 'keep' end state from supplier")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Which outputs a manifest of fingerprints says are up to date."""
    s = table(spark, d, "supplier").select("s_suppkey", T.canonical_fingerprint({"name": F.col("s_name"), "nation": F.col("s_nationkey")}).alias("fingerprint"))
    k = F.col("s_suppkey")
    manifest = s.where(k % 5 != 0).select("s_suppkey", F.when(k % 3 == 0, F.md5("fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    path = shared_folder(spark, "manifest")
    manifest.write.json(path)
    return X.manifest_state(s, spark.read.schema("s_suppkey long, fingerprint string").json(path), "s_suppkey", "fingerprint").select("s_suppkey", "state")


@query("summed_histograms", "select run_length, sum(n)::bigint n from (select p_size run_length, count(*) n from part group by 1 union all select l_quantity::int, count(*) from lineitem group by 1) group by 1")
def summed_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of two sources added up."""
    from corpusloom.operators import grids as G

    a = table(spark, d, "part").groupBy(F.col("p_size").alias("run_length")).agg(F.count("*").alias("n"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("run_length")).agg(F.count("*").alias("n"))
    return G.histogram_total(a.unionByName(b), "run_length", "n")
