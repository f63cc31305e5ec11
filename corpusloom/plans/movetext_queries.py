"""Queries over movetext with variations and over its annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.shared import shared_folder
from corpusloom.sources import movetext as M
from corpusloom.sources import records as S
from corpusloom.sources import sinks

from .bindings import table
from .catalog import query


def branched(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as movetext by order: comments, variations in variations, glyphs, line comments, a bracket too many."""
    flag, supplier = F.col("l_returnflag"), F.col("l_suppkey").cast("string")
    deep = F.when(F.col("l_linestatus") == "O", " (d1 e2)(f1 (g1)) h2").otherwise(" t2 $3")
    more = F.when(flag == "A", F.concat(F.lit(" {a"), supplier, F.lit("}"))).when(flag == "R", F.concat(F.lit("(s"), supplier, deep, F.lit(")")))
    more = more.otherwise(F.concat(F.lit(" ;x)y\n) q"), F.col("l_linenumber").cast("string")))
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(". p"), F.col("l_partkey").cast("string"), more)
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("t")))).alias("parts"))
    return parts.select("l_orderkey", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


_BRANCHED = """b as (select l_orderkey, string_agg(t, ' ' order by l_linenumber, t) as text from (select l_orderkey, l_linenumber, l_linenumber || '. p' || l_partkey ||
  case l_returnflag when 'A' then ' {a' || l_suppkey || '}' when 'R' then '(s' || l_suppkey || case l_linestatus when 'O' then ' (d1 e2)(f1 (g1)) h2' else ' t2 $3' end || ')'
  else ' ;x)y' || chr(10) || ') q' || l_linenumber end t from lineitem) group by l_orderkey)"""


@query(
    "variation_tree",
    f"""with recursive {_BRANCHED},
w as (select l_orderkey, regexp_extract_all(text, ';[^\\n]*|\\{{[^}}]*\\}}|[()]|[0-9]+\\.|\\$[0-9]+|[a-z][a-z0-9]*') t from b),
s as (select l_orderkey, 0 i, 0 opened, [0] stack, [0] plies, '' token from w
union all select l_orderkey, i + 1, case when n = '(' then opened + 1 else opened end,
  case when n = '(' then list_append(stack, opened + 1) when n = ')' and len(stack) > 1 then stack[1:len(stack) - 1] else stack end,
  case when n = '(' then list_append(plies, plies[-1] - 1) when n = ')' and len(stack) > 1 then plies[1:len(plies) - 1]
    when regexp_matches(n, '^[a-z]') then list_append(plies[1:len(plies) - 1], plies[-1] + 1) else plies end, n
from (select s.*, w.t[i + 1] n from s join w using (l_orderkey) where i < len(w.t)))
select l_orderkey, array_to_string(stack[2:], '.') path, cast(len(stack) - 1 as bigint) depth, cast(plies[-1] as bigint) ply, token as move, len(stack) = 1 mainline from s where regexp_matches(token, '^[a-z]')""",
)
def variation_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every move of a movetext with the path of its variation, its depth and its ply."""
    moves = M.tokens(branched(spark, d), ["l_orderkey"], "text", ["move"])
    return moves.select("l_orderkey", F.array_join("path", ".").alias("path"), "depth", "ply", F.col("token").alias("move"), (F.col("depth") == 0).alias("mainline"))


KEY = ["Event", "Site", "Date", "Round", "White", "Black", "Result"]


def annotated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records whose moves two scripts have annotated: joined by the seven tags, which several orders may share."""
    k = F.col("o_orderkey")
    tags = {
        "Event": F.concat(F.lit("e"), F.floor(k / 12).cast("string")), "Site": F.col("o_orderstatus"), "Date": F.date_format("o_orderdate", "yyyy.MM"), "Round": (k % 6).cast("string"),
        "White": F.substring("o_orderpriority", 1, 1), "Black": F.lit("b"), "Result": F.lit("1-0"),
    }
    moves = F.when(k % 4 == 0, "1. e4 {old} e5 2. Nf3 (2. d4 {in a line}) Nc6 $1 1-0").otherwise("1. e4 {old} e5 {first}\n2. Nf3 (2. d4 (2. c4) exd4) Nc6 3. Bb5 {é} 1-0")
    o = table(spark, d, "orders").select(k.alias("o_orderkey"), *(v.alias(t) for t, v in tags.items()), moves.alias("text"))
    seen = o.select(*KEY).distinct()  # a script annotates each game that it knows by its tags once
    one = seen.where("Round % 2 = 0").select(*KEY, F.concat(F.lit("1"), F.concat_ws("|", *KEY)).alias("version"), F.lit("{start} 1. e4 {old red} e5 {ring} 2. Nf3 Nc6 1-0").alias("text"))
    two = seen.where("Round % 3 = 0").select(*KEY, F.concat(F.lit("2"), F.concat_ws("|", *KEY)).alias("version"), F.lit("1. e4 {old} e5 {ring} 2. Nf3 ({no} d4) {a} } Nc6 {small blue} 3. Bb5 {new é} a6 {late} 1-0").alias("text"))
    return M.annotate(o, one.union(two), KEY, "o_orderkey", "text", "version")


_ANNOTATED = """a as (select o_orderkey, o_orderkey % 6 % 2 = 0 one, o_orderkey % 6 % 3 = 0 two, o_orderkey % 4 = 0 short from orders),
b as (select o_orderkey, one, two, short, case when one then ' {start}' else '' end s, case when one then ' {red}' else '' end r, case when one or two then ' {ring}' else '' end g, case when two then ' {a}' else '' end n,
  case when two then ' {small blue}' else '' end c, case when two then ' {new}' else '' end w, case when two then ' {late}' else '' end l from a)"""


@query(
    "annotated_records",
    f"""with {_ANNOTATED} select o_orderkey, case when short then s || '1. e4' || r || ' {{old}} e5' || g || ' 2. Nf3' || n || ' (2. d4 {{in a line}}) Nc6' || c || ' $1 1-0' || case when two then ' {{late}} {{new é}}' else '' end
  else s || '1. e4' || r || ' {{old}} e5' || g || ' {{first}}' || chr(10) || '2. Nf3' || n || ' (2. d4 (2. c4) exd4) Nc6' || c || ' 3. Bb5' || w || ' {{é}} 1-0' || l end as text from b""",
)
def annotated_records(spark: SparkSession, d: str) -> DataFrame:
    """Movetexts with the comments that two annotated versions add, each behind the move of its ply."""
    return annotated_orders(spark, d).select("o_orderkey", "text")


@query(
    "annotated_markers",
    f"""with {_ANNOTATED} select 'k' || o_orderkey event, unnest(case when one then [1] else [] end || case when one or two then [2] else [] end || case when two then [4] else [] end) ply,
  unnest(case when one then ['red'] else [] end || case when one or two then ['ring'] else [] end || case when two then ['small'] else [] end) as label from b""",
)
def annotated_markers(spark: SparkSession, d: str) -> DataFrame:
    """The annotated records written to files, read back, and their labels by ply."""
    raw = annotated_orders(spark, d).select(S.to_text(F.create_map(F.lit("Event"), F.concat(F.lit("k"), "o_orderkey")), F.col("text")).alias("raw"))
    path = shared_folder(spark, "annotated")
    sinks.write_records(raw, "raw", path)
    r = S.read_records(spark, path, "*.txt")
    found = S.markers(r, ["red", "ring", "small"], {"event": S.headers(F.col("raw"))["Event"]})
    return found.select("event", F.col("ply").cast("int").alias("ply"), "label")
