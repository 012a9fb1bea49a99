"""Operators on data where one key holds most rows, against brute force in Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.functions import fingerprint as fp
from sluice.operators import align, events, fingerprints, graph, kmers, validate
from sluice.operators import reads as rd
from sluice.operators.skew import lookup
from sluice.sources import files


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def steps():
    """Runs of uneven length; the first holds most steps."""
    rng = random.Random(5)
    out = []
    for run, length in [(0, 150), (1, 3), (2, 7), (3, 1)]:
        for pos in range(length):
            out.append((run, pos, rng.choice(["a", "b"]), sha(f"{run}.{pos}")))
    return out


def runs_of(steps):
    by_run = defaultdict(list)
    for run, _, _, uid in steps:
        by_run[run].append(uid)
    return by_run


def fold(uids):
    acc = "0"
    for uid in uids:
        acc = sha(acc + uid)
    return acc


def test_group_fold_and_lineage_uid(spark, steps):
    df = spark.createDataFrame(steps, "run long, pos long, name string, uid string")
    for made, combine, out in [
        (fingerprints.group_uid, lambda g: sha("".join(g)), "group_uid"),
        (fingerprints.fold_uid, fold, "fold_uid"),
    ]:
        got = {r.run: r[out] for r in made(df, ["run"], "pos").collect()}
        assert got == {r: combine(u) for r, u in runs_of(steps).items()}
    uids = runs_of(steps)
    for r in fingerprints.lineage_uid(df, "run", "pos").collect():
        assert r.run_uid == fp.run_uid(r.uid, uids[r.run][: r.pos])


def test_uids_of_sparse_and_long_runs(spark):
    sparse = [(7, 9000, sha("b")), (7, 5000, sha("a")), (8, -3, None), (9, 1, sha("c"))]
    df = spark.createDataFrame(sparse, "run long, pos long, uid string")
    groups = {r.run: r.group_uid for r in fingerprints.group_uid(df, ["run"], "pos").collect()}
    assert groups == {7: sha(sha("a") + sha("b")), 8: sha(""), 9: sha(sha("c"))}
    walked = {(r.run, r.pos): r.run_uid for r in fingerprints.lineage_uid(df, "run", "pos").collect()}
    assert walked[7, 9000] == fp.run_uid(sha("b"), [sha("a")])
    assert walked[7, 5000] == fp.run_uid(sha("a")) and walked[8, -3] is None
    long = [(1, 3 * k, sha(str(k))) for k in range(10_000)]
    df = spark.createDataFrame(long, "run long, pos long, uid string").repartition(5)
    uids = [u for _, _, u in long]
    assert fingerprints.group_uid(df, ["run"], "pos").first().group_uid == sha("".join(uids))
    assert fingerprints.fold_uid(df, ["run"], "pos").first().fold_uid == fold(uids)
    last = fingerprints.lineage_uid(df, "run", "pos").where("pos = 29997").first()
    assert last.run_uid == fp.run_uid(uids[-1], uids[:-1])
    assert fingerprints.group_uid(df.limit(0), ["run"], "pos").count() == 0


def test_chained_edges_and_upstream_outputs(spark, steps):
    df = spark.createDataFrame(steps, "run_id long, pos long, name string, uid string")
    got = {(r.src, r.dst) for r in graph.build_edges(df).collect()}
    assert got == {(a, b) for u in runs_of(steps).values() for a, b in zip(u, u[1:])}
    named = df.withColumn("path", F.concat("name", F.lit("/"), "pos", F.lit(".txt")))
    found = files.resolve_upstream(named, ["a/*"]).collect()
    expected = {}
    for run in {s[0] for s in steps}:
        last = None
        for _, pos, name, uid in [s for s in steps if s[0] == run]:
            expected[uid] = last
            last = f"a/{pos}.txt" if name == "a" else last
    assert {r.uid: r.resolved for r in found} == expected


def test_resolve_trajectory(spark):
    requests = spark.createDataFrame(
        [(1, ["u1", "u2", "u3"]), (2, ["u1"]), (3, [])], "request int, trajectory array<string>"
    )
    outputs = spark.createDataFrame(
        [("u1", "d/x.txt"), ("u2", "d/y.txt"), ("u2", "d/b.txt"), ("u3", "d/z.bin")],
        "uid string, path string",
    )
    got = files.resolve_trajectory(requests, outputs, "*.txt", fallback="cwd.txt").collect()
    assert {r.request: r.resolved for r in got} == {1: "d/b.txt", 2: "d/x.txt", 3: "cwd.txt"}


def test_logs_of_a_busy_task(spark):
    rows = [(i, 1 if i % 3 else i % 5, "log", f"line {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, uid long, channel string, content string")
    parts = events.concat_log(df, chunk=50).orderBy("uid", "part").collect()
    whole = defaultdict(str)
    for p in parts:
        assert p.n_entries <= 50
        whole[p.uid] += p.log
    expected = defaultdict(str)
    for _, uid, _, content in rows:
        expected[uid] += "\n" + content
    assert whole == expected
    newest = defaultdict(list)
    for seq, uid, *_ in rows:
        newest[uid].append(seq)
    kept = events.last_n(df, 7)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.uid, r.seq) for r in kept.collect()) == sorted(
        (uid, seq) for uid, seqs in newest.items() for seq in seqs[-7:]
    )


def test_routes(spark):
    rows = [(0, 1, "click"), (1, 1, "signup"), (2, 1, "click"), (3, None, "click"), (4, 2, "view")]
    df = spark.createDataFrame(rows, "seq long, uid long, action string")
    got = {r.seq: (r.route, r.reason) for r in events.route(df).collect()}
    assert got == {
        0: ("rejected", "unknown uid"),
        1: ("create", None),
        2: ("task", None),
        3: ("rejected", "no uid"),
        4: ("rejected", "unknown uid"),
    }


def test_graph_with_shared_nodes_and_cycles(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "uid string")
    walked = graph.descendants(nodes, edges).collect()
    assert Counter((r.root, r.node) for r in walked)["a", "e"] == 2
    once = graph.descendants(nodes, edges, distinct=True).collect()
    assert Counter((r.root, r.node) for r in once)["a", "e"] == 1
    up = graph.ancestors(edges, nodes).where("node = 'e'").collect()
    assert {(r.ancestor, r.distance) for r in up} == {("d", 1), ("b", 2), ("c", 2), ("a", 3)}
    paths = {"".join(r.path) for r in graph.leaf_paths(nodes, edges).collect()}
    assert paths == {"abde", "acde", "f"}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "uid string")
    with pytest.raises(ValueError):
        graph.descendants(start, loop, max_depth=5, roots=start)
    seen = graph.descendants(start, loop, distinct=True, roots=start).collect()
    assert {(r.node, r.depth) for r in seen} == {("a", 0), ("b", 1), ("c", 2)}


def test_graph_json(spark, steps):
    import json

    df = spark.createDataFrame(steps, "run_id long, pos long, name string, uid string")
    lines = graph.graph_to_json(df, graph.build_edges(df)).orderBy("run_id", "part", "key").collect()
    texts = defaultdict(str)
    for r in lines:
        texts[r.run_id] += r.line
    for run, uids in runs_of(steps).items():
        doc = json.loads(texts[run])["graph"]
        assert doc["mode"] == "NORMAL"
        assert {v["_id"] for v in doc["vertices"]} == set(uids)
        assert {(e["source"], e["target"]) for e in doc["edges"]} == set(zip(uids, uids[1:]))


# sequences


@pytest.fixture(scope="module")
def genome():
    """Contigs that share long stretches, so that many seeds occur many times."""
    rng = random.Random(11)
    shared = "".join(rng.choice("ACGT") for _ in range(200))
    contigs = []
    for i in range(12):
        own = "".join(rng.choice("ACGT") for _ in range(150))
        contigs.append((i, f"g{i}", shared + own if i % 3 else shared))
    contigs.append((12, "flat", "A" * 300))
    return contigs


@pytest.fixture(scope="module")
def sample(genome):
    rng = random.Random(12)
    out = []
    for i in range(300):
        seq = genome[rng.randrange(len(genome))][2]
        if i % 3 == 0:
            seq = genome[12][2]
        at = rng.randrange(len(seq) - 60)
        read = list(seq[at : at + rng.choice([40, 60, 80])])
        if i % 4 == 0:
            read[rng.randrange(len(read))] = rng.choice("ACGT")
        out.append((f"r{i}", 1, "".join(read)))
    return out


READS = "read_id string, mate int, seq string"
CONTIGS = "ord long, contig string, seq string"


@pytest.mark.parametrize("setting", [(16, 20, 3, 2), (12, 15, 4, 3)])
@pytest.mark.parametrize("salt", [False, True])
def test_seed_map_equals_counting_votes(spark, genome, sample, setting, salt, monkeypatch):
    if salt:
        monkeypatch.setattr(
            align, "lookup", lambda *a, **kw: lookup(*a, **{**kw, "salt": True, "share": 0.1})
        )
    k, stride, n_seeds, min_votes = setting
    places = defaultdict(list)
    for order, _, seq in genome:
        for pos in range(len(seq) - k + 1):
            places[seq[pos : pos + k]].append((order, pos + 1))
    expected = {}
    for name, _, seq in sample:
        votes = Counter()
        for s in range(n_seeds):
            if len(seq) >= s * stride + k:
                for order, pos in places[seq[s * stride : s * stride + k]]:
                    votes[order, pos - s * stride] += 1
        best = min(((-v, *place) for place, v in votes.items()), default=(0,))
        if -best[0] >= min_votes:
            expected[name] = (genome[best[1]][1], best[2], -best[0])
    kw = dict(k=k, stride=stride, n_seeds=n_seeds, min_votes=min_votes)
    contigs = spark.createDataFrame(genome, CONTIGS)
    index = align.build_index(contigs, **kw)
    mapped = align.seed_map(spark.createDataFrame(sample, READS), index, contigs, **kw)
    assert {r.read_id: (r.contig, r.pos, r.votes) for r in mapped.collect()} == expected


def comp(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_kmers(spark, sample):
    k = 20
    counts = Counter()
    for _, _, seq in sample:
        for i in range(len(seq) - k + 1):
            w = seq[i : i + k]
            counts[min(w, comp(w))] += 1
    reads = spark.createDataFrame(sample, READS)
    counted = kmers.kmer_count(reads, k).cache()
    assert {r.kmer: r.n for r in counted.collect()} == counts
    kept = kmers.filter_reads_by_kmer(reads, counted, k, cx=5).collect()
    rare = lambda seq, n: [
        i for i in range(len(seq) - k + 1) if counts[min(seq[i : i + k], comp(seq[i : i + k]))] <= n
    ]
    assert {r.read_id for r in kept} == {n for n, _, s in sample if not rare(s, 5)}
    cut = kmers.trim_low_abundance(reads, counted, k, cutoff=5).collect()
    expected = {n: s[: rare(s, 4)[0] + k - 1] if rare(s, 4) else s for n, _, s in sample}
    assert {r.read_id: r.seq for r in cut} == expected
    sketch = kmers.kmer_sketch(reads, k, width=512)
    guess = {r.kmer: r.estimate for r in kmers.sketch_estimate(counted, sketch, 512).collect()}
    assert guess.keys() == counts.keys() and all(guess[w] >= n for w, n in counts.items())


def test_depth_pileup_and_regions(spark, genome):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        order, contig, seq = genome[12] if i % 2 else genome[rng.randrange(12)]
        at = 1 if i % 3 == 0 else 1 + rng.randrange(len(seq) - 30)
        rows.append((f"r{i}", 1, contig, at, 30, seq[at - 1 : at + 29]))
    aln = spark.createDataFrame(
        rows, "read_id string, mate int, contig string, pos long, len int, seq string"
    )
    cover = Counter((c, p) for _, _, c, at, n, _ in rows for p in range(at, at + n))
    got = align.depth(aln, tile=64).collect()
    assert {(r.contig, r.pos): r.depth for r in got} == cover
    piled = align.pileup(aln, spark.createDataFrame(genome, CONTIGS)).collect()
    refs = {c: s for _, c, s in genome}
    assert {(r.contig, r.pos): (r.depth, r.ref) for r in piled} == {
        (c, p): (n, refs[c][p - 1]) for (c, p), n in cover.items()
    }
    assert all(r[f"n_{r.ref.lower()}"] == r.depth for r in piled)
    regions = [("x", "flat", 20, 90), ("y", "g1", 300, 320), ("z", "flat", 1, 1)]
    table = spark.createDataFrame(regions, "region string, contig string, start long, end long")
    hits = align.region_query(aln, table, bin=32).collect()
    assert Counter((r.region, r.read_id) for r in hits) == Counter(
        (g, n)
        for g, gc, a, b in regions
        for n, _, c, at, size, _ in rows
        if c == gc and at <= b and at + size - 1 >= a
    )


def test_quality_trim(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        qual = [rng.choice([0, 2, 15, 25, 30, 38]) for _ in range(rng.choice([3, 40, 60]))]
        rows.append((f"r{i}", 1, "".join(rng.choice("ACGT") for _ in qual), qual))
    rows.append(("bad", 1, "ACGT" * 10, [0] * 40))
    rows.append(("good", 1, "ACGT" * 10, [38] * 40))

    def trim(seq, qual):
        a = next((i for i, q in enumerate(qual) if q >= 3), len(qual))
        b = max((i + 1 for i, q in enumerate(qual) if q >= 3), default=0)
        seq, qual = seq[a:b], qual[a:b]
        for i in range(len(qual) - 3):
            if sum(qual[i : i + 4]) < 80:
                return seq[:i]
        return seq

    df = spark.createDataFrame(rows, "read_id string, mate int, seq string, qual array<int>")
    for minlen in (1, 36):
        got = {r.read_id: r.seq for r in rd.quality_trim(df, minlen=minlen).collect()}
        expected = {n: trim(s, q) for n, _, s, q in rows}
        assert got == {n: s for n, s in expected.items() if len(s) >= minlen}


def test_adapter_clip(spark):
    seed = "AGATCGGAAGAGCACA"
    near = "AGTTCGGAAGAGCTCA"
    far = "TGTTCGGAAGAGCTCA"
    rows = [("a", 1, "CCCC" + seed + "GG"), ("b", 1, near + "GG"), ("c", 1, far), ("d", 1, "ACG")]
    got = rd.adapter_clip(spark.createDataFrame(rows, READS), [seed + "TTT"]).collect()
    assert {r.read_id: (r.seq, r.clip_at) for r in got} == {
        "a": ("CCCC", 5), "b": ("", 1), "c": (far, 0), "d": ("ACG", 0)
    }


def test_fasta_and_sam_files(spark, tmp_path):
    contigs = [("a", "ACGT" * 40), ("b", "A")]
    df = spark.createDataFrame(contigs, "contig string, seq string")
    rd.to_fasta(df).write.text(str(tmp_path / "fa"), lineSep="\n")
    assert sorted(map(tuple, rd.read_fasta(spark, str(tmp_path / "fa")).collect())) == contigs
    longest = max(len(r.value) for r in spark.read.text(str(tmp_path / "fa")).collect())
    assert longest == 60


def test_checks(spark):
    df = spark.createDataFrame(
        [("a", 1, "h", 5), ("b", 0, "h", 5), ("c", None, "x", 6)],
        "path string, size int, content_hash string, mtime int",
    )
    manifest = spark.createDataFrame(
        [("a", "h", 5), ("c", "h", 5)], "path string, content_hash string, mtime int"
    )
    report = validate.validate(df, manifest)
    got = {(r.path, r.check): r.message for r in report.collect()}
    assert got == {
        ("a", "non_empty"): "match", ("a", "hash"): "match", ("a", "mtime"): "match",
        ("b", "non_empty"): "empty", ("b", "hash"): "not_in_manifest",
        ("b", "mtime"): "not_in_manifest", ("c", "non_empty"): "missing",
        ("c", "hash"): "mismatch", ("c", "mtime"): "mismatch",
    }
    assert {r.path: r.valid for r in validate.all_valid(report, "path").collect()} == {
        "a": True, "b": False, "c": False
    }
