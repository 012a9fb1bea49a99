"""Queries on file listings: globs, specs, fingerprints, manifests, validation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions import fingerprint as fp
from sluice.functions.text import drop_last, derive_outputs, first_segments, same_folder
from sluice.operators import fingerprints, incremental, validate
from sluice.operators.compose import Summarise, Where, branch, chain, run_per_file
from sluice.plans.oracle import query
from sluice.session import scratch_path
from sluice.sources import files
from sluice.sources import tables as t


@query(
    "glob_filter",
    """select path from artifacts
       where regexp_full_match(path, 'data/[^/]*/src1[^/]*_[^/]*\\.(en|de)\\.txt')""",
    ("artifacts",),
)
def glob_filter(spark, sf):
    return files.glob_filter(t.artifacts(spark, sf), "data/*/src1*_*.{en,de}.txt").select("path")


@query(
    "glob_cardinality",
    """select pattern, n, case pattern when '**/*.xx.txt' then n = 0
                         when '**/src7_7.*.txt' then n = 1 else n > 0 end as ok
       from (select '**/*.fr.txt' as pattern, count(*) filter (path like '%.fr.txt') as n
               from artifacts
             union all select '**/*.xx.txt', count(*) filter (path like '%.xx.txt') from artifacts
             union all select '**/src7_7.*.txt', count(*) filter
               (regexp_matches(path, '/src7_7\\.[^/]*\\.txt$')) from artifacts
             union all select 'data/a*/*', count(*) filter
               (regexp_matches(path, '^data/a[^/]*/[^/]*$')) from artifacts)""",
    ("artifacts",),
)
def glob_cardinality(spark, sf):
    expected = {
        "**/*.fr.txt": None,
        "**/*.xx.txt": 0,
        "**/src7_7.*.txt": 1,
        "data/a*/*": lambda n: n > 0,
    }
    return files.expect_matches(t.artifacts(spark, sf), expected)


@query(
    "spec_resolve",
    """select 'reads[0]' as leaf, path from artifacts where path like '%.en.txt'
       union all select 'reads[1]', path from artifacts where path like '%.de.txt'
       union all select 'index.file', path from artifacts
         where regexp_matches(path, '/src1?5_[^/]*$')""",
    ("artifacts",),
)
def spec_resolve(spark, sf):
    spec = {"reads": ["**/*.en.txt", "**/*.de.txt"], "index": {"file": "**/{src5,src15}_*"}}
    return files.resolve_spec(t.artifacts(spark, sf), spec)


@query(
    "upstream_resolve",
    """select run_id, uid, pattern, coalesce(resolved, first) as resolved from (
         select run_id, uid, '*.fr.txt' as pattern,
           last_value(case when path like '%.fr.txt' then path end ignore nulls) over w as resolved
         from artifacts window w as (partition by run_id order by doc_id
           rows between unbounded preceding and 1 preceding)
         union all
         select run_id, uid, 'data/*/src3_*',
           last_value(case when path like '%/src3\\_%' escape '\\' then path end ignore nulls)
             over w
         from artifacts window w as (partition by run_id order by doc_id
           rows between unbounded preceding and 1 preceding))
       join (select '*.fr.txt' as pattern, min(path) as first from artifacts
               where path like '%.fr.txt'
             union all select 'data/*/src3_*', min(path) from artifacts
               where path like '%/src3\\_%' escape '\\') using (pattern)""",
    ("artifacts",),
)
def upstream_resolve(spark, sf):
    listing = t.artifacts(spark, sf)
    return files.resolve_upstream(
        listing, ["*.fr.txt", "data/*/src3_*"], pos="doc_id", fallback=listing
    )


@query(
    "trajectory_resolve",
    """with steps as (select run_id, uid, path, doc_id, list(uid) over w as before,
              list(case when path like '%.fr.txt' then path end) over w as paths
            from artifacts window w as (partition by run_id order by doc_id
              rows between 3 preceding and 1 preceding))
       select uid as request, coalesce(list_last(list_filter(paths, lambda x: x is not null)), 'none') as resolved
       from steps""",
    ("artifacts",),
)
def trajectory_resolve(spark, sf):
    """Each artifact asks for a file among the last three before it, given as a lineage."""
    listing = t.artifacts(spark, sf)
    near = Window.partitionBy("run_id").orderBy("doc_id").rowsBetween(-3, -1)
    requests = listing.select(F.col("uid").alias("request"), F.collect_list("uid").over(near).alias("trajectory"))
    return files.resolve_trajectory(requests, listing, "*.fr.txt", fallback="none")


@query(
    "file_manifest",
    """select path, size, mtime, content_hash from artifacts
       where regexp_full_match(path, 'data/[^/]*/[^/]*\\.txt')""",
    ("artifacts",),
)
def file_manifest(spark, sf):
    listed = files.glob_filter(t.artifacts(spark, sf), "data/*/*.txt")
    return listed.select("path", "size", "mtime", "content_hash")


@query(
    "file_manifest_scan",
    """select c_mktsegment as segment, count(*) as n from customer group by all""",
)
def file_manifest_scan(spark, sf):
    """Files really written and listed again; counts and hashes come from the listing."""
    root = scratch_path(spark, "listed")
    customers = t.table(spark, sf, "customer").withColumn("segment", F.col("c_mktsegment"))
    customers.select("segment", "c_name").write.partitionBy("segment").text(root, lineSep="\n")
    listed = files.manifest(spark, f"{root}/segment=*/part-*")
    sizes = listed.where("length(content_hash) = 64 and size > 0").select(
        F.regexp_extract("path", "segment=([^/]*)/", 1).alias("segment"), "path"
    )
    lines = files.glob_scan(spark, f"{root}/segment=*/part-*").groupBy("file").agg(
        F.count(F.lit(1)).alias("n")
    )
    named = lines.select(F.substring_index("file", "/", -1).alias("name"), "n", "file")
    joined = sizes.withColumn("name", F.substring_index("path", "/", -1)).join(
        named.withColumn("segment", F.regexp_extract("file", "segment=([^/]*)/", 1)),
        ["segment", "name"],
    )
    return joined.groupBy("segment").agg(F.sum("n").alias("n"))


@query(
    "flow_per_file",
    """select doc_id, 'long' as branch, count(*) as n, max(length(line)) as longest
         from doc_lines where length(line) >= 100 group by all
       union all
       select doc_id, 'short', count(*), max(length(line)) from doc_lines where length(line) < 100 group by all""",
    ("doc_lines",),
)
def flow_per_file(spark, sf):
    """A whole tree, branches included, once per file."""
    tree = chain(
        branch(long=Where("long", "length(line) >= 100"), short=Where("short", "length(line) < 100")),
        Summarise("lines", [], {"n": "count(1)", "longest": "cast(max(length(line)) as bigint)"}),
    )
    return run_per_file(tree, t.doc_lines(spark, sf), "doc_id")


@query(
    "split_by_file",
    """select path, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars,
              max(length(line)) as longest
       from doc_lines join artifacts using (doc_id) group by all""",
    ("artifacts", "doc_lines"),
)
def split_by_file(spark, sf):
    named = t.artifacts(spark, sf).select("doc_id", "path")
    stats = files.per_file(
        t.doc_lines(spark, sf),
        "doc_id",
        n_lines=F.count(F.lit(1)),
        n_chars=F.sum(F.length("line")),
        longest=F.max(F.length("line")).cast("long"),
    )
    return stats.join(named, "doc_id").drop("doc_id")


@query(
    "derived_outputs",
    """with d as (select path as input,
                    regexp_extract(path, '^(.*/)?') || split_part(
                      regexp_extract(path, '[^/]*$'), '_', 1) || '.sorted.bam' as o1,
                    split_part(regexp_extract(path, '[^/]*$'), '.', 1) as o2,
                    path[:-5] || '.out' as o3,
                    split_part(split_part(path, '/', 3), '_', 1) as o4
                  from artifacts),
            u as (select input, 'folder' as rule, o1 as output from d
                  union all select input, 'segments', o2 from d
                  union all select input, 'suffix', o3 from d
                  union all select input, 'source', o4 from d)
       select rule, input, output, count(*) over (partition by rule, output) as n_claims from u""",
    ("artifacts",),
)
def derived_outputs(spark, sf):
    listing = t.artifacts(spark, sf)
    path = F.col("path")
    name = F.substring_index("path", "/", -1)
    source = F.substring_index(name, "_", 1)
    rules = {
        "folder": same_folder(path, F.concat(source, F.lit(".sorted.bam"))),
        "segments": first_segments(path, 1),
        "suffix": F.concat(drop_last(path, 4), F.lit(".out")),
        "source": source,
    }
    done = None
    for rule, output in rules.items():
        one = derive_outputs(listing, output).withColumn("rule", F.lit(rule))
        done = one if done is None else done.unionByName(one)
    return done


# fingerprints


@query(
    "row_fingerprint",
    """select doc_id, sha256(sha256(to_json(source)) || sha256(to_json(path))
         || sha256('{"lang":' || to_json(lang) || ',"size":' || size || '}')
         || sha256(to_json(source || ' to ' || lang))) as def_uid
       from artifacts""",
    ("artifacts",),
)
def row_fingerprint(spark, sf):
    rows = t.artifacts(spark, sf)
    uid = fp.definition_uid_of(
        fp.json_string(F.col("source")),
        fp.json_string(F.col("path")),
        F.to_json(F.struct("lang", "size")),
        fp.json_string(F.concat("source", F.lit(" to "), "lang")),
    )
    return rows.select("doc_id", uid.alias("def_uid"))


@query(
    "lineage_fingerprint",
    """select run_id, pos, uid, sha256(sha256('[' || coalesce(array_to_string(
                list_transform(before, lambda x: '"' || x || '"'), ','), '') || ']') || uid) as run_uid
       from (select *, list(uid) over (partition by run_id order by pos
               rows between unbounded preceding and 1 preceding) as before from tasks_conv)""",
    ("tasks_conv",),
)
def lineage_fingerprint(spark, sf):
    rows = fingerprints.lineage_uid(t.tasks_conv(spark, sf), "run_id", "pos")
    return rows.select("run_id", "pos", "uid", "run_uid")


@query(
    "group_fingerprint",
    """select run_id, sha256(string_agg(uid, '' order by pos)) as group_uid
       from tasks_conv group by run_id""",
    ("tasks_conv",),
)
def group_fingerprint(spark, sf):
    return fingerprints.group_uid(t.tasks_conv(spark, sf), ["run_id"], "pos")


@query(
    "fold_fingerprint",
    """select run_id, list_reduce(list_prepend('0', list(uid order by pos)),
                                  lambda a, b: sha256(a || b)) as fold_uid
       from tasks_conv group by run_id""",
    ("tasks_conv",),
)
def fold_fingerprint(spark, sf):
    return fingerprints.fold_uid(t.tasks_conv(spark, sf), ["run_id"], "pos")


@query(
    "sparse_group_fingerprint",
    """select uid, sha256(string_agg(content, '' order by seq)) as group_uid
       from task_events group by uid""",
    ("task_events",),
)
def sparse_group_fingerprint(spark, sf):
    """Members whose places lie far apart, many per group."""
    return fingerprints.group_uid(t.task_events(spark, sf), ["uid"], "seq", "content")


@query(
    "sparse_fold_fingerprint",
    """select uid, list_reduce(list_prepend('0', list(content order by seq)),
                               lambda a, b: sha256(a || b)) as fold_uid
       from task_events group by uid""",
    ("task_events",),
)
def sparse_fold_fingerprint(spark, sf):
    return fingerprints.fold_uid(t.task_events(spark, sf), ["uid"], "seq", "content")


@query(
    "sparse_lineage_fingerprint",
    """select seq, sha256(sha256('[' || coalesce(array_to_string(
                list_transform(before, lambda x: '"' || x || '"'), ','), '') || ']') || step) as run_uid
       from (select seq, step, list(step) over (partition by uid order by seq
               rows between unbounded preceding and 1 preceding) as before
             from (select uid, seq, sha256(content) as step from task_events))""",
    ("task_events",),
)
def sparse_lineage_fingerprint(spark, sf):
    steps = t.task_events(spark, sf).select("uid", "seq", F.sha2("content", 256).alias("step"))
    return fingerprints.lineage_uid(steps, "uid", "seq", "step").select("seq", "run_uid")


@query(
    "short_id_collisions",
    """select substring(uid, 1, 4) as short_id, count(distinct uid) as n_uids,
              min(uid) as first_uid, max(uid) as last_uid
       from artifacts group by 1 having count(distinct uid) > 1""",
    ("artifacts",),
)
def short_id_collisions(spark, sf):
    return fingerprints.short_id_collisions(t.artifacts(spark, sf), n=4)


@query(
    "dedupe_by_uid",
    """select * from task_events qualify row_number() over (partition by uid order by seq desc) = 1""",
    ("task_events",),
)
def dedupe_by_uid(spark, sf):
    return fingerprints.latest_by_uid(t.task_events(spark, sf), "uid", "seq")


# incremental work and manifests


@query(
    "incremental_skip",
    """select a.path, a.content_hash,
              case when m.content_hash = a.content_hash then 'reuse' else 'recompute' end as action
       from artifacts a left join manifest_old m using (path)""",
    ("artifacts", "manifest_old"),
)
def incremental_skip(spark, sf):
    listing = t.artifacts(spark, sf).select("path", "content_hash")
    return incremental.incremental(listing, t.manifest_old(spark, sf))


@query(
    "incremental_run",
    """select a.path, a.content_hash, case when m.content_hash = a.content_hash
              then 'earlier' else 'now' end as made
       from artifacts a left join manifest_old m using (path)""",
    ("artifacts", "manifest_old"),
)
def incremental_run(spark, sf):
    listing = t.artifacts(spark, sf).select("path", "content_hash")
    earlier = t.manifest_old(spark, sf).select("path", "content_hash", F.lit("earlier").alias("made"))
    return incremental.run_incremental(
        listing, earlier, lambda df: df.withColumn("made", F.lit("now"))
    )


@query(
    "write_manifest",
    """select path, content_hash, mtime from artifacts
         where path in (select path from present_files)
       union all
       select path, content_hash, mtime from manifest_old
         where path not in (select path from present_files)""",
    ("artifacts", "manifest_old", "present_files"),
)
def write_manifest(spark, sf):
    written = t.artifacts(spark, sf).join(t.present_files(spark, sf), "path", "left_semi")
    merged = incremental.upsert_manifest(
        t.manifest_old(spark, sf), written.select("path", "content_hash", "mtime")
    )
    return incremental.write_manifest(merged, scratch_path(spark, "manifest"))


# validation


@query(
    "check_non_empty",
    """select a.path, case when p.length is null then 'missing' when p.length = 0 then 'empty'
                      else 'ok' end as status
       from artifacts a left join present_files p using (path)""",
    ("artifacts", "present_files"),
)
def check_non_empty(spark, sf):
    return validate.check_non_empty(t.artifacts(spark, sf), t.present_files(spark, sf))


@query(
    "check_hash",
    """select a.path, case when m.path is null then 'not_in_manifest'
                      when m.content_hash = a.content_hash then 'match' else 'mismatch' end as status
       from artifacts a left join manifest_old m using (path)""",
    ("artifacts", "manifest_old"),
)
def check_hash(spark, sf):
    return validate.check_hash(t.artifacts(spark, sf), t.manifest_old(spark, sf))


@query(
    "check_mtime",
    """select a.path, case when m.path is null then 'not_in_manifest'
                      when m.mtime = a.mtime then 'match' else 'mismatch' end as status
       from artifacts a left join manifest_old m using (path)""",
    ("artifacts", "manifest_old"),
)
def check_mtime(spark, sf):
    return validate.check_mtime(t.artifacts(spark, sf), t.manifest_old(spark, sf))


@query(
    "validation_report",
    """with j as (select a.path, a.size, a.content_hash, a.mtime, m.path as known,
                         m.content_hash as h, m.mtime as t
                  from artifacts a left join manifest_old m using (path)),
            r as (select path, 'non_empty' as "check",
                         case when size = 0 then 'empty' else 'match' end as message from j
                  union all select path, 'hash', case when known is null then 'not_in_manifest'
                         when h = content_hash then 'match' else 'mismatch' end from j
                  union all select path, 'mtime', case when known is null then 'not_in_manifest'
                         when t = mtime then 'match' else 'mismatch' end from j)
       select path, "check", message = 'match' as ok, message from r""",
    ("artifacts", "manifest_old"),
)
def validation_report(spark, sf):
    return validate.validate(t.artifacts(spark, sf), t.manifest_old(spark, sf))


@query(
    "validated_write",
    """with j as (select a.*, m.path as known, m.content_hash as h, m.mtime as t
                  from artifacts a left join manifest_old m using (path)),
            s as (select count(*) as n,
                         sum((doc_id is null)::int + (run_id is null)::int + (uid is null)::int + (path is null)::int
                             + (size is null)::int + (content_hash is null)::int + (mtime is null)::int) as nulls,
                         count(*) filter (size is null or size = 0) as e,
                         count(*) filter (h is distinct from content_hash) as f,
                         count(*) filter (t is distinct from mtime) as g from j)
       select "check", failed = 0 as valid, n as n_checks, failed as n_failed, n as n_rows,
              cast(nulls as bigint) as n_nulls
       from (select 'non_empty' as "check", e as failed, n, nulls from s union all
             select 'hash', f, n, nulls from s union all select 'mtime', g, n, nulls from s)""",
    ("artifacts", "manifest_old"),
)
def validated_write(spark, sf):
    """The listing is written and validated in one pass."""
    files_ = t.artifacts(spark, sf).select("doc_id", "run_id", "uid", "path", "size", "content_hash", "mtime")
    report = validate.write_validated(files_, t.manifest_old(spark, sf), scratch_path(spark, "validated"))
    return report.drop("digest")


@query(
    "output_expectation",
    """with n as (select uid, count(*) filter (path like '%.en.txt') as n0,
                         count(*) filter (regexp_matches(path, '/src[^/]*\\.txt$')) as n1
                  from present_files group by uid),
            j as (select a.uid, coalesce(n0, 0) as n0, coalesce(n1, 0) as n1
                  from artifacts a left join n using (uid))
       select uid, '**/*.en.txt' as pattern, n0 as n, n0 > 0 as ok from j
       union all select uid, '**/src*.txt', n1, n1 > 0 from j""",
    ("artifacts", "present_files"),
)
def output_expectation(spark, sf):
    return validate.expect_outputs(
        t.artifacts(spark, sf), t.present_files(spark, sf), ["**/*.en.txt", "**/src*.txt"]
    )
