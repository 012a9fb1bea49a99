"""Queries on the event log, batch and streaming."""

from sluice.operators import events
from sluice.plans.oracle import query
from sluice.sources import tables as t
from sluice.streaming import events as streams

STATUS = """select uid, arg_max(status, seq) filter (status is not null) as status,
                   coalesce(bool_or(status = 'POST_VALIDATION'), false) as validated,
                   count(*) as n_events
            from task_events group by uid"""
LAST = """select * from task_events
          qualify row_number() over (partition by uid order by seq desc) <= 20"""


@query("status_fold", STATUS, ("task_events",))
def status_fold(spark, sf):
    return events.fold_status(t.task_events(spark, sf))


@query(
    "status_history",
    """select uid, seq, status, lag(status) over (partition by uid order by seq) as prev
       from task_events where status is not null""",
    ("task_events",),
)
def status_history(spark, sf):
    return events.transitions(t.task_events(spark, sf))


@query(
    "status_transitions",
    """select prev, status, count(*) as n from (
         select status, lag(status) over (partition by uid order by seq) as prev
         from task_events where status is not null) group by all""",
    ("task_events",),
)
def status_transitions(spark, sf):
    return events.transition_counts(t.task_events(spark, sf))


@query(
    "log_concat",
    """select uid, channel, cast(n // 1000 as bigint) as part,
              string_agg(chr(10) || content, '' order by seq) as log, count(*) as n_entries
       from (select *, row_number() over (partition by uid, channel order by seq) - 1 as n
             from task_events) group by all""",
    ("task_events",),
)
def log_concat(spark, sf):
    return events.concat_log(t.task_events(spark, sf))


@query("log_last_n", LAST, ("task_events",))
def log_last_n(spark, sf):
    return events.last_n(t.task_events(spark, sf), 20)


@query(
    "log_lines",
    "select doc_id, line_no, '    stdout: ' || line as entry from doc_lines",
    ("doc_lines",),
)
def log_lines(spark, sf):
    chunks = t.table(spark, sf, "documents").select("doc_id", "text")
    return events.explode_lines(chunks, "text", "stdout: ", depth=2)


@query(
    "action_route",
    """with c as (select uid, min(seq) as created from task_events where action = 'signup'
                  group by uid)
       select seq, uid, action,
              case when action = 'signup' then 'create'
                   when created is null or created > seq then 'rejected' else 'task' end as route,
              case when action <> 'signup' and (created is null or created > seq)
                   then 'unknown uid' end as reason
       from task_events left join c using (uid)""",
    ("task_events",),
)
def action_route(spark, sf):
    routed = events.route(t.task_events(spark, sf))
    return routed.select("seq", "uid", "action", "route", "reason")


def _event_stream(spark, sf):
    schema = t.table(spark, sf, "events").schema
    return t.as_task_events(streams.read_events(spark, f"{sf}/events.parquet", schema))


@query("stream_status", STATUS, ("task_events",))
def stream_status(spark, sf):
    return streams.stream_status(_event_stream(spark, sf))


@query("stream_log_last_n", LAST, ("task_events",))
def stream_log_last_n(spark, sf):
    return streams.stream_last_n(_event_stream(spark, sf), 20)
