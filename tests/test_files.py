import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sluice.functions.globs import glob_match_any, glob_regex
from sluice.functions.text import derive_outputs, field, to_letters
from sluice.operators import incremental
from sluice.session import materialize, release, shared_dir
from sluice.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    for name, text in {
        "foo.txt": "foo",
        "a_two.txt": "eh",
        "b_two.txt": "bee",
        "sub/deep/c.txt": "sea\nsee",
    }.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return base


def listing(spark):
    paths = ["foo.txt", "a_two.txt", "b_two.txt", "d/e/f.txt", "d/x.bin"]
    return spark.createDataFrame([(p,) for p in paths], "path string")


@pytest.mark.parametrize(
    "pattern, hits",
    [
        ("foo*", {"foo.txt"}),
        ("*_two.txt", {"a_two.txt", "b_two.txt"}),
        ("**/*.txt", {"foo.txt", "a_two.txt", "b_two.txt", "d/e/f.txt"}),
        ("d/*", {"d/x.bin"}),
        ("d/**", {"d/e/f.txt", "d/x.bin"}),
        ("{foo,a_two}.txt", {"foo.txt", "a_two.txt"}),
        ("[ab]_two.???", {"a_two.txt", "b_two.txt"}),
        ("[!a]_two.txt", {"b_two.txt"}),
        ("nonexistent.txt", set()),
    ],
)
def test_globs(spark, pattern, hits):
    assert {r.path for r in files.glob_filter(listing(spark), pattern).collect()} == hits


def test_glob_errors_and_basename(spark):
    with pytest.raises(ValueError):
        glob_regex("{a,b")
    found = listing(spark).where(glob_match_any("path", "f.txt"))
    assert [r.path for r in found.collect()] == ["d/e/f.txt"]


def test_cardinality(spark):
    df = listing(spark)
    one = {r.pattern: (r.n, r.ok) for r in files.expect_matches(df, ["foo*", "*_two.txt"]).collect()}
    assert one == {"foo*": (1, True), "*_two.txt": (2, False)}
    spec = {"*_two.txt": 2, "none": None, "zero": lambda n: n == 0, "**": None}
    assert [r.ok for r in files.expect_matches(df, spec).collect()] == [True, False, True, True]


@pytest.mark.parametrize(
    "spec",
    [
        "foo",
        ["foo"],
        {"k": "foo"},
        [{"k": "foo"}, {"k": "bar"}],
        {"k": ["foo", "bar"]},
        {"obj": {"list": [{"arr": ["foo"]}, {"str": "bar"}]}},
    ],
)
def test_specs(spark, spec):
    def same(value, fn):
        if isinstance(value, str):
            return fn(value)
        if isinstance(value, list):
            return [same(v, fn) for v in value]
        return {k: same(v, fn) for k, v in value.items()}

    assert files.map_spec(spec, str.upper) == same(spec, str.upper)
    assert set(files.spec_leaves(spec).values()) <= {"foo", "bar"}
    with pytest.raises(TypeError):
        files.map_spec({"k": 1}, str.upper)

    def fail(pattern):
        raise LookupError(pattern)

    with pytest.raises(LookupError):
        files.map_spec(spec, fail)


def test_resolve_spec(spark):
    spec = {"reads": ["*_two.txt", "foo.*"], "none": "missing"}
    got = {(r.leaf, r.path) for r in files.resolve_spec(listing(spark), spec).collect()}
    assert got == {("reads[0]", "a_two.txt"), ("reads[0]", "b_two.txt"), ("reads[1]", "foo.txt")}
    assert [r.leaf for r in files.unresolved_leaves(listing(spark), spec).collect()] == ["none"]


def test_manifest_and_scan(spark, folder):
    rows = files.manifest(spark, f"{folder}/*.txt").collect()
    assert {(r.path.rsplit("/", 1)[1], r.size, r.content_hash) for r in rows} == {
        (n, len(t), hashlib.sha256(t.encode()).hexdigest())
        for n, t in [("foo.txt", "foo"), ("a_two.txt", "eh"), ("b_two.txt", "bee")]
    }
    deep = files.glob_scan(spark, f"{folder}/**/*.txt").collect()
    assert {r.value for r in deep} == {"foo", "eh", "bee", "sea", "see"}


def test_decompress_append_concat(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wt") as out:
        out.write("one\n\nthree\n")
    plain = files.decompress(spark, f"{tmp_path}/*.gz", str(tmp_path / "plain"))
    assert sorted(r.value for r in plain.collect()) == ["", "one", "three"]
    for v in (1, 2):
        files.append(spark.range(v), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 3
    docs = spark.createDataFrame([(9, "c"), (2, "a\nb"), (30, "")], "ord long, text string")
    rows = files.concat_files(docs, "ord").orderBy("out_no").collect()
    assert [(r.out_no, r.line) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, "")]


def test_pipe(spark):
    df = spark.createDataFrame([("b x",), ("a x",), ("é 'q\" $HOME",)], "line string")
    out = files.pipe_command(df, ["cat", "tr x y"]).collect()
    assert sorted(r.line for r in out) == ["a y", "b y", "é 'q\" $HOME"]
    with pytest.raises(Exception):
        files.pipe_command(df, ["false", "cat"]).collect()


def test_text(spark):
    lines = ["70", " -66x", "+5", "x1", "", "99999999999999999999"]
    df = spark.createDataFrame([(v,) for v in lines], "line string")
    got = {r.line: (r.code, r.letter) for r in to_letters(df).collect()}
    assert got["70"] == (5, chr(5)) and got["+5"] == (5, chr(5)) and got[" -66x"][0] == -1
    assert set(got) == {"70", " -66x", "+5", "99999999999999999999"}
    text = spark.createDataFrame([("head er\n a  b c\none\n",)], "text string")
    assert [r.field for r in field(text, 2, skip=1).collect()] == ["b", "", ""]
    claims = derive_outputs(listing(spark), F.lit("same")).collect()
    assert {r.n_claims for r in claims} == {5}


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    old = spark.createDataFrame([("a", "1", 10), ("b", "9", 20), ("z", "1", 5)],
                                "path string, content_hash string, made int")
    acts = {r.path: r.action for r in incremental.incremental(now, old).collect()}
    assert acts == {"a": "reuse", "b": "recompute", "c": "recompute"}
    off = incremental.incremental(now, old, resume="off")
    assert {r.action for r in off.collect()} == {"recompute"}
    with pytest.raises(ValueError):
        incremental.incremental(now, old, resume="maybe")
    done = incremental.run_incremental(now, old, lambda df: df.withColumn("made", F.lit(99)))
    assert {(r.path, r.made) for r in done.collect()} == {("a", 10), ("b", 99), ("c", 99)}


def test_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(named)
    stored = materialize(spark.range(5))
    assert stored.count() == 5 and named in stored.inputFiles()[0]
    release(spark)
    release(spark)
