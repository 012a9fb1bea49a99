"""Queries on the provenance graph."""

from pyspark.sql import functions as F

from sluice.operators import graph
from sluice.plans.oracle import query
from sluice.session import scratch_path
from sluice.sources import tables as t

DOWN = """with recursive walk as (
  select uid as root, uid as node, 0 as depth, [uid] as path from hier_vertices
    where uid not in (select dst from hier_edges)
  union all
  select root, dst, depth + 1, list_append(path, dst) from walk join hier_edges on src = node)"""


@query("dag_edges", "select run_id, src, dst from conv_edges", ("conv_edges",))
def dag_edges(spark, sf):
    return graph.build_edges(t.tasks_conv(spark, sf))


@query(
    "dag_junction",
    """with l as (select run_id, name, arg_max(uid, pos) as src from tasks_conv group by all),
            v as (select run_id, sha256(string_agg(src, '' order by
                    case name when 'system' then 0 when 'user' then 1 else 2 end)) as dst from l group by run_id)
       select run_id, src, dst from l join v using (run_id)""",
    ("tasks_conv",),
)
def dag_junction(spark, sf):
    _, _, edges = graph.add_junction(t.tasks_conv(spark, sf), ["system", "user", "assistant"])
    return edges


@query(
    "junction_contents",
    """with l as (select run_id, name, arg_max(uid, pos) as src from tasks_conv group by all),
            v as (select run_id, sha256(string_agg(src, '' order by
                    case name when 'system' then 0 when 'user' then 1 else 2 end)) as dst from l group by run_id)
       select run_id, name, pos, uid, dst from tasks_conv join v using (run_id)""",
    ("tasks_conv",),
)
def junction_contents(spark, sf):
    _, contents, _ = graph.add_junction(t.tasks_conv(spark, sf), ["system", "user", "assistant"])
    return contents


@query(
    "trajectory_edges",
    """select 'c' || (o_custkey % 7) as src, 'o' || o_orderkey as dst from orders where o_custkey % 5 > 0""",
)
def trajectory_edges(spark, sf):
    """Edges from the last entry of explicit trajectories; tasks without one are roots."""
    orders = t.table(spark, sf, "orders")
    region = F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string"))
    nearest = F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))
    trajectory = F.when(F.col("o_custkey") % 5 > 0, F.array(region, nearest)).otherwise(F.array().cast("array<string>"))
    uid = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    return graph.trajectory_edges(orders.select(uid.alias("uid"), trajectory.alias("trajectory")))


@query(
    "graph_documents",
    """with v as (select run_id, 1 as part, uid as key, '{"_id":"' || uid
                    || '","_type":"vertex","values":{"pos":' || pos || ',"name":"' || name || '"}}'
                    as line from tasks_conv),
            e as (select run_id, 3 as part, src || '>' || dst as key, '{"source":"' || src
                    || '","target":"' || dst || '","_type":"edge"}' as line from conv_edges),
            u as (select * from v union all select * from e),
            all_lines as (
       select run_id, part, key, case when row_number() over (partition by run_id, part
                order by key) = 1 then '' else ',' end || line as line from u
       union all
       select run_id, part, '', line from (select distinct run_id from tasks_conv)
       cross join (values (0, '{"graph":{"mode":"NORMAL","vertices":['), (2, '],"edges":['),
                          (4, ']}}')) f(part, line))
       select run_id, string_agg(line, chr(10) order by part, key) || chr(10) as document
       from all_lines group by run_id""",
    ("tasks_conv", "conv_edges"),
)
def graph_documents(spark, sf):
    """One written file per run, read back whole."""
    tasks = t.tasks_conv(spark, sf)
    path = scratch_path(spark, "graphs")
    graph.write_graphs(graph.graph_to_json(tasks, graph.build_edges(tasks)), path)
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("run_id").cast("long").alias("run_id"), F.col("value").alias("document"))


@query(
    "dag_sources_sinks",
    """select uid, name, 'source' as kind from hier_vertices
         where uid not in (select dst from hier_edges)
       union all select uid, name, 'sink' from hier_vertices
         where uid not in (select src from hier_edges)""",
    ("hier_vertices", "hier_edges"),
)
def dag_sources_sinks(spark, sf):
    v, e = t.hier_vertices(spark, sf), t.hier_edges(spark, sf)
    return (
        graph.sources(v, e)
        .withColumn("kind", F.lit("source"))
        .unionByName(graph.sinks(v, e).withColumn("kind", F.lit("sink")))
    )


@query(
    "dag_descendants",
    DOWN + " select root, node, depth, array_to_string(path, '>') as path from walk",
    ("hier_vertices", "hier_edges"),
)
def dag_descendants(spark, sf):
    found = graph.descendants(t.hier_vertices(spark, sf), t.hier_edges(spark, sf))
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "dag_ancestry",
    """with recursive up as (
         select uid as node, src as ancestor, 1 as distance
           from hier_vertices join hier_edges on dst = uid
         union all
         select node, src, distance + 1 from up join hier_edges on dst = ancestor)
       select node, ancestor, min(distance) as distance from up group by all""",
    ("hier_vertices", "hier_edges"),
)
def dag_ancestry(spark, sf):
    return graph.ancestors(t.hier_edges(spark, sf), t.hier_vertices(spark, sf))


@query(
    "dag_ancestry_latest",
    """with recursive latest as (
         select src as owner, max(dst) as uid from hier_edges where dst like 'o%' group by src),
       up as (
         select uid as node, src as ancestor, 1 as distance from latest join hier_edges on dst = uid
         union all
         select node, src, distance + 1 from up join hier_edges on dst = ancestor)
       select node, ancestor, min(distance) as distance from up group by all""",
    ("hier_vertices", "hier_edges"),
)
def dag_ancestry_latest(spark, sf):
    """The walk from given vertices: what stands above one order of each customer."""
    edges = t.hier_edges(spark, sf)
    latest = edges.where(F.col("dst").startswith("o")).groupBy("src").agg(F.max("dst").alias("uid"))
    return graph.ancestors(edges, latest)


@query(
    "dag_counts",
    """with i as (select dst as uid, count(*) as n from hier_edges group by all),
            o as (select src as uid, count(*) as n from hier_edges group by all),
            d as (select uid, coalesce(i.n, 0) as i, coalesce(o.n, 0) as o from hier_vertices
                  left join i using (uid) left join o using (uid))
       select count(*) as n_vertices, cast(sum(o) as bigint) as n_edges,
              count(*) filter (i = 0) as n_sources, count(*) filter (o = 0) as n_sinks,
              max(i) as max_in, max(o) as max_out from d""",
    ("hier_vertices", "hier_edges"),
)
def dag_counts(spark, sf):
    return graph.graph_stats(t.hier_vertices(spark, sf), t.hier_edges(spark, sf))


@query(
    "dag_degrees",
    """with i as (select dst as uid, count(*) as n from conv_edges group by all),
            o as (select src as uid, count(*) as n from conv_edges group by all)
       select uid, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree
       from tasks_conv left join i using (uid) left join o using (uid)""",
    ("tasks_conv", "conv_edges"),
)
def dag_degrees(spark, sf):
    tasks = t.tasks_conv(spark, sf)
    return graph.degrees(tasks, graph.build_edges(tasks))


@query(
    "leaf_paths",
    DOWN
    + """ select node as leaf, array_to_string(path, '>') as path from walk
          where node not in (select src from hier_edges)""",
    ("hier_vertices", "hier_edges"),
)
def leaf_paths(spark, sf):
    found = graph.leaf_paths(t.hier_vertices(spark, sf), t.hier_edges(spark, sf))
    return found.withColumn("path", F.array_join("path", ">"))


@query(
    "final_outputs",
    """select run_id, max(pos) as pos, arg_max(name, pos) as name, arg_max(uid, pos) as uid
       from tasks_conv group by run_id""",
    ("tasks_conv",),
)
def final_outputs(spark, sf):
    return graph.final_outputs(t.tasks_conv(spark, sf))


@query(
    "leaf_outputs",
    DOWN
    + """ select node as leaf, array_to_string(path, '>') as path, o_totalprice as price, o_orderstatus as status
          from walk left join orders on node = 'o' || o_orderkey
          where node not in (select src from hier_edges)""",
    ("hier_vertices", "hier_edges"),
)
def leaf_outputs(spark, sf):
    """What the orders at the leaves of the hierarchy give out; a customer without one gives nothing."""
    paths = graph.leaf_paths(t.hier_vertices(spark, sf), t.hier_edges(spark, sf))
    uid = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    outputs = t.table(spark, sf, "orders").select(
        uid.alias("uid"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")
    )
    found = graph.leaf_outputs(paths, outputs)
    return found.select("leaf", F.array_join("path", ">").alias("path"), "price", "status")


@query(
    "graph_json_sink",
    """with v as (select run_id, 1 as part, uid as key, '{"_id":"' || uid
                    || '","_type":"vertex","values":{"pos":' || pos || ',"name":"' || name || '"}}'
                    as line from tasks_conv),
            e as (select run_id, 3 as part, src || '>' || dst as key, '{"source":"' || src
                    || '","target":"' || dst || '","_type":"edge"}' as line from conv_edges),
            u as (select * from v union all select * from e)
       select run_id, part, key, case when row_number() over (partition by run_id, part
                order by key) = 1 then '' else ',' end || line as line from u
       union all
       select run_id, part, '', line from (select distinct run_id from tasks_conv)
       cross join (values (0, '{"graph":{"mode":"NORMAL","vertices":['), (2, '],"edges":['),
                          (4, ']}}')) f(part, line)""",
    ("tasks_conv", "conv_edges"),
)
def graph_json_sink(spark, sf):
    tasks = t.tasks_conv(spark, sf)
    return graph.graph_to_json(tasks, graph.build_edges(tasks))
