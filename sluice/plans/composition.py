"""Queries on composition: chain, merge, branch, sweep."""

from pyspark.sql import functions as F

from sluice.operators.compose import (
    Derive,
    Summarise,
    Task,
    Where,
    branch,
    chain,
    compare,
    merge,
    run,
    sweep_above,
    sweep_where,
)
from sluice.plans.oracle import query
from sluice.session import scratch_path
from sluice.sources.files import map_batches
from sluice.sources.tables import table

NET = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"
TOTALS = {
    "n": "count(1)",
    "qty": "cast(sum(cast(l_quantity as decimal(12,2))) as double)",
    "net": "cast(sum(net) as double)",
}
TOTALS_SQL = """count(*) as n, cast(sum(cast(l_quantity as decimal(12,2))) as double) as qty,
    cast(sum(net) as double) as net"""
LINES_SQL = f"(select *, {NET} as net from lineitem)"
LOW, MID, HIGH = "l_discount < 0.03", "l_discount >= 0.03 and l_discount < 0.07", "l_discount >= 0.07"


def net_price():
    return Derive("net", {"net": NET})


def totals(*by):
    return Summarise("totals", by, TOTALS)


@query(
    "branch_two",
    f"""select branch, l_returnflag, l_linestatus, {TOTALS_SQL} from (
          select 'low' as branch, * from {LINES_SQL} where {LOW}
          union all select 'mid', * from {LINES_SQL} where {MID}
          union all select 'high', * from {LINES_SQL} where {HIGH})
        group by all""",
)
def branch_two(spark, sf):
    tree = chain(
        net_price(),
        branch(low=Where("low", LOW), mid=Where("mid", MID), high=Where("high", HIGH)),
        totals("l_returnflag", "l_linestatus"),
    )
    return run(tree, table(spark, sf, "lineitem"))


@query(
    "branch_nested",
    f"""select branch, l_returnflag, {TOTALS_SQL} from (
          select 'cheap/early' as branch, * from {LINES_SQL}
            where l_discount < 0.05 and year(l_shipdate) < 1995
          union all select 'cheap/late', * from {LINES_SQL}
            where l_discount < 0.05 and year(l_shipdate) >= 1995
          union all select 'dear', * from {LINES_SQL} where l_discount >= 0.05)
        group by all""",
)
def branch_nested(spark, sf):
    years = branch(
        early=Where("early", "year(l_shipdate) < 1995"),
        late=Where("late", "year(l_shipdate) >= 1995"),
    )
    tree = chain(
        net_price(),
        branch(
            cheap=chain(Where("cheap", "l_discount < 0.05"), years),
            dear=Where("dear", "l_discount >= 0.05"),
        ),
        totals("l_returnflag"),
    )
    return run(tree, table(spark, sf, "lineitem"))


@query(
    "branch_then_branch",
    f"""select a.branch || '/' || b.branch as branch, l_linestatus, {TOTALS_SQL}
        from {LINES_SQL} l
        join (values ('taxed', true), ('all', false)) a(branch, taxed)
          on not a.taxed or l_tax > 0.04
        join (values ('small', 0, 20), ('large', 20, 1000)) b(branch, lo, hi)
          on l_quantity > b.lo and l_quantity <= b.hi
        group by all""",
)
def branch_then_branch(spark, sf):
    tree = chain(
        branch(taxed=Where("taxed", "l_tax > 0.04"), all=Where("all", "true")),
        net_price(),
        branch(
            small=Where("small", "l_quantity > 0 and l_quantity <= 20"),
            large=Where("large", "l_quantity > 20 and l_quantity <= 1000"),
        ),
        totals("l_linestatus"),
    )
    return run(tree, table(spark, sf, "lineitem"))


@query(
    "branch_then_merge",
    """with l as (select case when l_returnflag = 'R' then 'returned' else 'kept' end as branch, *
                  from lineitem)
       select branch, 'lines' as member, l_linestatus, cast(count(*) as double) as v
         from l group by all
       union all
       select branch, 'quantity', l_linestatus,
              cast(sum(cast(l_quantity as decimal(12,2))) as double) from l group by all""",
)
def branch_then_merge(spark, sf):
    tree = chain(
        branch(
            returned=Where("returned", "l_returnflag = 'R'"),
            kept=Where("kept", "l_returnflag <> 'R'"),
        ),
        merge(
            lines=Summarise("lines", ["l_linestatus"], {"v": "cast(count(1) as double)"}),
            quantity=Summarise("quantity", ["l_linestatus"], {"v": TOTALS["qty"]}),
        ),
    )
    return run(tree, table(spark, sf, "lineitem"))


@query(
    "branch_compare",
    """select o_orderkey, by_price as label_price, by_priority as label_priority,
              by_price = by_priority as agree
       from (select o_orderkey,
               case when o_totalprice > 200000 then 'rush' else 'plain' end as by_price,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'rush' else 'plain' end
                 as by_priority
             from orders)""",
)
def branch_compare(spark, sf):
    price = "case when o_totalprice > 200000 then 'rush' else 'plain' end"
    priority = "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'rush' else 'plain' end"
    tree = branch(
        price=Derive("price", {"label": price}), priority=Derive("priority", {"label": priority})
    )
    both = run(tree, table(spark, sf, "orders"))
    return compare(both, ["o_orderkey"], "label", ["price", "priority"])


@query(
    "chain_two",
    """select o_orderkey, o_custkey,
              cast(cast(o_totalprice as decimal(12,2)) * 0.9 as double) as reduced
       from orders where o_orderstatus = 'F'""",
)
def chain_two(spark, sf):
    reduced = "cast(cast(o_totalprice as decimal(12,2)) * 0.9 as double)"
    tree = chain(Where("final", "o_orderstatus = 'F'"), Derive("reduce", {"reduced": reduced}))
    return run(tree, table(spark, sf, "orders")).select("o_orderkey", "o_custkey", "reduced")


@query(
    "chain_nested",
    f"""select l_suppkey, {TOTALS_SQL} from {LINES_SQL}
        where l_returnflag = 'N' and net > 1000 group by all""",
)
def chain_nested(spark, sf):
    inner = chain(Where("kept", "l_returnflag = 'N'"), net_price())
    tree = chain(inner, chain(Where("worth", "net > 1000"), totals("l_suppkey")))
    return run(tree, table(spark, sf, "lineitem"))


@query(
    "chain_lineage",
    """with d1 as (select sha256(sha256('null') || sha256('null')
                     || sha256('{"segment":"BUILDING"}') || sha256('"segment"')) as uid),
            r1 as (select sha256(sha256('[]') || uid) as uid from d1),
            d2 as (select sha256(sha256('null') || sha256('null') || sha256('null')
                     || sha256('"solvent"')) as uid),
            l1 as (select ['{"segment":"BUILDING"}', uid] as lineage from r1),
            r2 as (select sha256(sha256('["{\\"segment\\":\\"BUILDING\\"}","' || r1.uid || '"]')
                     || d2.uid) as uid from r1, d2)
       select c_custkey, array_to_string(list_append(l1.lineage, r2.uid), ' ') as lineage
       from customer, l1, r2 where c_mktsegment = 'BUILDING' and c_acctbal > 0""",
)
def chain_lineage(spark, sf):
    segment = Task(
        "segment", lambda df, segment: df.where(F.col("c_mktsegment") == segment),
        {"segment": "BUILDING"},
    )
    solvent = Task("solvent", lambda df: df.where("c_acctbal > 0"))
    done = run(chain(segment, solvent), table(spark, sf, "customer"), lineage=True)
    return done.select("c_custkey", F.array_join("lineage", " ").alias("lineage"))


@query(
    "merge_union",
    """select 'large' as member, o_orderpriority, count(*) as n from orders
         where o_totalprice > 250000 group by all
       union all
       select 'open', o_orderpriority, count(*) from orders where o_orderstatus = 'O' group by all""",
)
def merge_union(spark, sf):
    tree = chain(
        merge(
            large=Where("large", "o_totalprice > 250000"), open=Where("open", "o_orderstatus = 'O'")
        ),
        Summarise("count", ["member", "o_orderpriority"], {"n": "count(1)"}),
    )
    return run(tree, table(spark, sf, "orders"))


@query(
    "merge_keyed",
    """select o_custkey, count(*) as orders_n,
              cast(sum(cast(o_totalprice as decimal(12,2))) as double) as spend_total
       from orders group by all""",
)
def merge_keyed(spark, sf):
    total = "cast(sum(cast(o_totalprice as decimal(12,2))) as double)"
    tree = merge(
        orders=Summarise("orders", ["o_custkey"], {"n": "count(1)"}),
        spend=Summarise("spend", ["o_custkey"], {"total": total}),
    ).on("o_custkey")
    return run(tree, table(spark, sf, "orders"))


@query(
    "merge_outer",
    """select o_custkey, cheap.n as cheap_n, dear.n as dear_n
       from (select o_custkey, count(*) as n from orders where o_totalprice < 50000 group by all) cheap
       full join (select o_custkey, count(*) as n from orders where o_totalprice > 400000 group by all)
         dear using (o_custkey)""",
)
def merge_outer(spark, sf):
    """Members whose keys differ: a key that one of them lacks has nulls there."""
    count = Summarise("count", ["o_custkey"], {"n": "count(1)"})
    tree = merge(
        cheap=chain(Where("cheap", "o_totalprice < 50000"), count),
        dear=chain(Where("dear", "o_totalprice > 400000"), count),
    ).on("o_custkey")
    return run(tree, table(spark, sf, "orders"))


@query(
    "chain_after_write",
    """select p_brand, count(*) as n, min(p_size) as smallest from part where p_size > 10
       group by all""",
)
def chain_after_write(spark, sf):
    path = scratch_path(spark, "first")
    run(chain(Where("sized", "p_size > 10")), table(spark, sf, "part")).write.parquet(path)
    second = chain(
        Summarise("brands", ["p_brand"], {"n": "count(1)", "smallest": "min(p_size)"})
    )
    return run(second, spark.read.parquet(path))


@query(
    "task_apply",
    """select l_orderkey, l_linenumber,
              cast(cast(l_extendedprice as decimal(12,2)) * 1.5 as double) as marked
       from lineitem where l_quantity >= 10""",
)
def task_apply(spark, sf):
    def mark(df, factor, least):
        price = F.expr(f"cast(cast(l_extendedprice as decimal(12,2)) * {factor} as double)")
        return df.where(F.col("l_quantity") >= least).select(
            "l_orderkey", "l_linenumber", price.alias("marked")
        )

    return Task("mark", mark, {"factor": "1.5", "least": 10})(table(spark, sf, "lineitem"))


@query(
    "param_sweep",
    """select param_id, l_returnflag, count(*) as n, count(distinct l_suppkey) as suppliers
       from lineitem
       join (values ('p0', 10, 0.02), ('p1', 25, 0.05), ('p2', 40, 0.08)) p(param_id, q, d)
         on l_quantity > q and l_discount < d
       group by all""",
)
def param_sweep(spark, sf):
    params = [{"q": 10, "d": 0.02}, {"q": 25, "d": 0.05}, {"q": 40, "d": 0.08}]
    rows = sweep_where(table(spark, sf, "lineitem"), "l_quantity > {q} and l_discount < {d}", params)
    return rows.groupBy("param_id", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query(
    "param_sweep_table",
    """select p_partkey as param_id, 20 * p_retailprice as threshold, l_returnflag, count(*) as n,
              cast(sum(cast(l_quantity as decimal(12,2))) as double) as qty
       from lineitem join part on l_extendedprice > 20 * p_retailprice group by all""",
)
def param_sweep_table(spark, sf):
    """A threshold for every part, from the table of parts."""
    params = table(spark, sf, "part").select(
        F.col("p_partkey").alias("param_id"), (20 * F.col("p_retailprice")).alias("threshold")
    )
    measures = {"n": "1", "qty": "cast(l_quantity as decimal(12,2))"}
    swept = sweep_above(table(spark, sf, "lineitem"), params, "l_extendedprice", measures, ["l_returnflag"])
    return swept.withColumn("qty", F.col("qty").cast("double"))


@query("batch_fn", "select doc_id, len(string_split(text, ' ')) as n_words from documents")
def batch_fn(spark, sf):
    def words(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        counts = pc.list_value_length(pc.split_pattern(batch.column("text"), " "))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), counts.cast(pa.int64())], ["doc_id", "n_words"]
        )

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return map_batches(docs, words, "doc_id bigint, n_words bigint")
