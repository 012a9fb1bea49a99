"""DuckDB definitions of the derived views, and the registry of checked queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    "artifacts": """
        select doc_id, doc_id % 8 as run_id, uid,
               'data/' || substring(uid, 1, 7) || '/' || source || '_' || doc_id || '.' || lang
                 || '.txt' as path,
               n_chars as size, sha256(text) as content_hash,
               doc_id * 1000 + n_chars % 2 as mtime, source, lang
        from (select *, sha256(source || ':' || doc_id) as uid from documents)""",
    "manifest_old": """
        select path,
               case when lang = 'de' then sha256(content_hash) else content_hash end
                 as content_hash,
               doc_id * 1000 as mtime
        from artifacts where source not in ('src3', 'src13')""",
    "present_files": """
        select uid, path, quality as length from artifacts join labels using (doc_id)""",
    "tasks_conv": """
        select conv_id as run_id, turn as pos, role as name,
               sha256(conv_id || ':' || turn || ':' || text) as uid
        from conversations""",
    "conv_edges": """
        select * from (
          select run_id, lag(uid) over (partition by run_id order by pos) as src, uid as dst
          from tasks_conv) where src is not null""",
    "hier_edges": """
        select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation
        union all select 'n' || c_nationkey, 'c' || c_custkey from customer
        union all select 'c' || o_custkey, 'o' || o_orderkey from orders""",
    "hier_vertices": """
        select 'r' || r_regionkey as uid, r_name as name from region
        union all select 'n' || n_nationkey, n_name from nation
        union all select 'c' || c_custkey, c_name from customer
        union all select 'o' || o_orderkey, o_orderpriority from orders""",
    "task_events": """
        select event_id as seq, ts, user_id as uid, event_type as action,
               case event_type when 'signup' then 'STATUS_CREATED'
                 when 'view' then 'RESOLVING_INPUT' when 'click' then 'RUNNING_OPERATION'
                 when 'purchase' then 'POST_VALIDATION' end as status,
               case when event_type = 'error' then 'stderr' else 'log' end as channel,
               event_type || ' ' || props as content
        from events""",
    "doc_lines": """
        select doc_id, unnest(range(len(ls)))::int as line_no, unnest(ls) as line
        from (select doc_id, string_split(text, chr(10)) as ls from documents)""",
    "contigs": """
        select doc_id as ord, 'c' || doc_id as contig,
               translate(regexp_replace(hex(encode(text)), '.(.)', '\\1', 'g'),
                         '0123456789ABCDEF', 'ACGTACGTACGTACGT') as seq
        from documents""",
    "aln": """
        select read_id, mate, contig, pos, len(s1)::int as len,
               case when tile % 7 = 0 and len(s1) >= 40
                 then s1[1:39] || translate(s1[40:40], 'ACGT', 'GTAC') || s1[41:]
                 else s1 end as seq
        from (
          select *, case when o <= len(s0)
                      then s0[1:o-1] || translate(s0[o:o], 'ACGT', 'CGTA') || s0[o+1:]
                      else s0 end as s1
          from (
            select *, 97 - (pos - 1) % 97 as o
            from (
              select read_id, contig, tile, mate,
                     case mate when 1 then start else start + shift end as pos,
                     case mate when 1 then substring(seq, start, 80)
                               else substring(seq, start + shift, 80) end as s0
              from (
                select *, ('0x' || substring(md5(read_id || '/2'), 1, 7))::bigint
                            % least(80, len(seq) - start + 1) as shift
                from (
                  select *, tile * 80 + 1 as start, contig || '_' || tile as read_id
                  from (select contig, seq, unnest(range((len(seq) + 79) // 80)) as tile
                        from contigs)))
              cross join (values (1), (2)) m(mate))))""",
    "reads": """
        select read_id, mate, seq,
               list_transform(range(len(seq)), lambda i:
                 case when i > 0 and i < cut then 24 else 0 end
                 + instr('0123456789abcdef', qh[i+1:i+1]) - 1) as qual
        from (select *,
                30 + ('0x' || substring(md5(read_id || 'c' || mate), 1, 7))::bigint % 60 as cut,
                md5(read_id || 'q' || mate) || md5(read_id || 'r' || mate)
                  || md5(read_id || 's' || mate) as qh
              from aln)""",
}

# Which other views a view reads.
NEEDS = {
    "manifest_old": ["artifacts"],
    "present_files": ["artifacts"],
    "conv_edges": ["tasks_conv"],
    "aln": ["contigs"],
    "reads": ["aln"],
}


def _with_needs(names: Iterable[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        for view in [*_with_needs(NEEDS.get(name, [])), name]:
            if view not in ordered:
                ordered.append(view)
    return ordered


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named derived views in front."""
    ordered = _with_needs(names)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} as materialized ({VIEWS[n]})" for n in ordered)
    if sql.lstrip().lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{sql.lstrip()[len('with recursive '):]}"
    if sql.lstrip().lower().startswith("with "):
        return f"with {ctes},\n{sql.lstrip()[len('with '):]}"
    return f"with {ctes}\n{sql}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views)
        return fn

    return register
