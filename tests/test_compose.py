import pytest
from pyspark.sql import functions as F

from sluice import Derive, Summarise, Task, Where, branch, chain, leaves, merge, run
from sluice.functions import fingerprint as fp
from sluice.operators.compose import agreement, compare, expand, sweep, sweep_where


def step(name):
    return Task(name, lambda df: df.withColumn("seen", F.concat_ws("-", "seen", F.lit(name))))


T = {n: step(n) for n in ["0", "1", "2", "3", "4", "5", "6", "7", "8", "3_2"]}


def tree(n):
    t = T
    return {
        "simple": chain(t["0"], branch(t["1"], t["2"])),
        "one": chain(
            t["0"],
            branch(
                chain(t["2"], t["5"]),
                chain(t["4"], branch(chain(t["1"], t["5"]), chain(t["3"], t["5"]))),
            ),
        ),
        "two": chain(
            t["0"], branch(chain(t["4"], branch(t["1"], t["3"]), t["6"]), t["2"]), t["5"]
        ),
        "three": chain(t["0"], branch(branch(t["1"], t["4"]), t["6"]), t["5"]),
        "four": chain(
            t["0"],
            branch(
                chain(
                    t["4"],
                    branch(chain(t["7"], branch(t["1"], t["3"])), chain(t["8"], t["6"])),
                ),
                t["2"],
            ),
            t["5"],
        ),
        "five": chain(
            t["0"],
            branch(
                chain(
                    t["4"],
                    branch(chain(t["7"], merge(t["1"], t["3"]), t["6"]), t["6"]),
                ),
                t["2"],
            ),
            t["5"],
            t["3_2"],
        ),
        "six": chain(
            t["0"],
            branch(
                chain(
                    t["4"],
                    branch(
                        chain(
                            t["7"],
                            branch(chain(t["1"], branch(t["3"], t["3_2"])), t["8"]),
                        ),
                        t["6"],
                    ),
                ),
                t["2"],
            ),
            t["5"],
        ),
        "seven": chain(t["0"], branch(t["4"], t["3"]), t["5"], branch(t["1"], t["2"]), t["6"]),
        "eight": chain(t["0"], branch(t["4"], t["3"]), t["5"], merge(t["1"], t["2"]), t["6"]),
    }[n]


SHAPES = {
    "simple": ["0-1", "0-2"],
    "one": ["0-2-5", "0-4-1-5", "0-4-3-5"],
    "two": ["0-4-1-6-5", "0-4-3-6-5", "0-2-5"],
    "three": ["0-1-5", "0-4-5", "0-6-5"],
    "four": ["0-4-7-1-5", "0-4-7-3-5", "0-4-8-6-5", "0-2-5"],
    "five": ["0-4-7-(1+3)-6-5-3_2", "0-4-6-5-3_2", "0-2-5-3_2"],
    "six": ["0-4-7-1-3-5", "0-4-7-1-3_2-5", "0-4-7-8-5", "0-4-6-5", "0-2-5"],
    "seven": ["0-4-5-1-6", "0-4-5-2-6", "0-3-5-1-6", "0-3-5-2-6"],
    "eight": ["0-4-5-(1+2)-6", "0-3-5-(1+2)-6"],
}


@pytest.mark.parametrize("name", SHAPES)
def test_leaves(name):
    assert ["-".join(path) for path in leaves(tree(name))] == SHAPES[name]


@pytest.mark.parametrize("name", ["two", "five", "seven", "eight"])
@pytest.mark.parametrize("share", ["plan", "table"])
def test_run_matches_leaves(spark, name, share):
    df = spark.createDataFrame([("",)], "seen string")
    got = sorted(r.seen.strip("-") for r in run(tree(name), df, share=share).collect())
    expected = []
    for path in SHAPES[name]:
        head, found, tail = path.partition("(1+3)" if "(1+3)" in path else "(1+2)")
        members = found.strip("()").split("+") if found else [""]
        expected += [head + m + tail for m in members]
    assert got == sorted(expected)


def test_merge_inside_merge_and_branch_inside_merge(spark):
    df = spark.createDataFrame([("",)], "seen string")
    nested = chain(merge(x=merge(T["1"], T["2"]), y=branch(T["3"], T["4"])), T["5"])
    got = sorted(r.seen.strip("-") for r in run(nested, df).collect())
    assert got == ["1-5", "2-5", "3-5", "4-5"]


def test_lineage(spark):
    foo = Task("Resolve foo", lambda df, val: df, {"val": "foo"})
    bar = Task("Resolve bar", lambda df, val: df, {"val": "bar"})
    row = run(chain(foo, bar), spark.range(1), lineage=True).first()
    first = fp.run_uid(foo.uid)
    second = fp.run_uid(bar.uid, ['{"val":"foo"}', first])
    assert row.lineage == ['{"val":"foo"}', first, '{"val":"bar"}', second]
    assert chain(foo, bar).uid == fp.members_uid([foo.uid, bar.uid])


def test_single_pass_reads_input_once_and_equals_one_plan_per_branch(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    total = Summarise("total", ["l_returnflag"], {"n": "count(1)", "q": "sum(l_quantity)"})
    rows = dict(low=Where("low", "l_discount < 0.03"), high=Where("high", "l_discount > 0.05"))
    once = run(chain(branch(**rows), total), df)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    opaque = {k: Task(k, lambda d, c: d.where(c), {"c": w.condition}) for k, w in rows.items()}
    apart = run(chain(branch(**opaque), Task("total", lambda d: total(d))), df)
    assert sorted(map(tuple, once.select(sorted(once.columns)).collect())) == sorted(
        map(tuple, apart.select(sorted(apart.columns)).collect())
    )


def test_branches_with_derived_columns(spark):
    df = spark.range(6)
    node = branch(
        a=chain(Where("even", "id % 2 = 0"), Derive("v", {"v": "id * 10"})),
        b=branch(c=Derive("v", {"v": "id"}), d=Derive("v", {"v": "-id"})),
    )
    got = {(r.branch, r.id, r.v) for r in run(node, df).collect()}
    assert got == {("a", i, i * 10) for i in (0, 2, 4)} | {("b/c", i, i) for i in range(6)} | {
        ("b/d", i, -i) for i in range(6)
    }


def test_task_arguments(spark):
    with pytest.raises(TypeError):
        Task("t", "not callable")
    with pytest.raises(TypeError):
        Task("t", lambda df: df, params=None)
    params = {"keep": [1, 2]}

    def body(df, keep):
        keep.append(3)
        return df.where(F.col("id").isin(keep))

    assert Task("t", body, params)(spark.range(9)).count() == 3
    assert params == {"keep": [1, 2]}


def test_sweeps_and_compare(spark):
    df = spark.range(10)
    one = sweep(df, lambda d, n: d.where(F.col("id") < n), [{"n": 3}, {"n": 5}])
    two = sweep_where(df, "id < {n}", [{"n": 3}, {"n": 5}])
    assert sorted(map(tuple, one.select("param_id", "id").collect())) == sorted(
        map(tuple, two.select("param_id", "id").collect())
    )
    parity = one.withColumn("v", F.col("id") % 2)
    both = compare(parity, ["id"], "v", ["p0", "p1"], out="param_id")
    assert tuple(agreement(both).first()) == (5, 3, 0.6)


def test_failures_reach_the_caller(spark):
    def broken(df):
        raise RuntimeError("broken step")

    with pytest.raises(RuntimeError):
        run(chain(T["0"], merge(T["1"], Task("x", broken))), spark.createDataFrame([("",)], "seen string"))
    with pytest.raises(TypeError):
        expand(chain("no step"), spark.range(1))


def test_conditions_of_all_branches_reach_the_scan(spark, sf):
    import __spark_entry__ as spark_entry

    plan = spark_entry.queries()["param_sweep"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: []" not in plan and plan.count("FileScan") == 1


def test_lineage_keeps_the_single_pass(spark, sf):
    tree = chain(
        Where("open", "o_orderstatus = 'O'"),
        branch(low=Where("low", "o_totalprice < 150000"), high=Where("high", "o_totalprice > 150000")),
        Summarise("count", ["o_orderpriority"], {"n": "count(1)"}),
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    single = run(tree, orders, lineage=True)
    assert single._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    apart = {leaf.path: list(leaf.lineage) for leaf in expand(tree, orders)}
    got = {tuple(r.branch.split("/")): list(r.lineage) for r in single.collect()}
    assert got == apart
    assert "branch" not in run(chain(Where("open", "o_orderstatus = 'O'")), orders, lineage=True).columns
