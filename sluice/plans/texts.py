"""Queries on text: transforms, concatenation, pipes and text files."""

from pyspark.sql import functions as F

from sluice.functions import text
from sluice.operators.compose import Derive, merge, run
from sluice.plans.oracle import query
from sluice.session import scratch_path
from sluice.sources import files
from sluice.sources import tables as t


@query("uppercase", "select doc_id, upper(replace(text, 'ß', 'SS')) as text from documents")
def uppercase(spark, sf):
    return text.uppercase(t.table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "line_count",
    """select cast(sum(length(text) - length(replace(text, chr(10), ''))) as bigint) as n_lines
       from documents""",
)
def line_count(spark, sf):
    return text.line_count(t.table(spark, sf, "documents"))


@query(
    "numbers_to_letters",
    """select seq, code, printf('%04X', (code + 65536) % 65536) as unit from (
         select seq, try_cast(regexp_extract(line, '^\\s*([+-]?[0-9]+)', 1) as hugeint) % 65 as code
         from (select seq, split_part(content, ':', 2) as line from task_events))
       where code is not null""",
    ("task_events",),
)
def numbers_to_letters(spark, sf):
    lines = t.task_events(spark, sf).select("seq", F.get(F.split("content", ":"), F.lit(1)).alias("line"))
    unit = F.hex(F.encode("letter", "UTF-16BE"))
    return text.to_letters(lines).select("seq", F.col("code").cast("long").alias("code"), unit.alias("unit"))


@query(
    "field_extract",
    """select doc_id, line_no, case when len(ws) >= 2 then ws[2] else '' end as field
       from (select doc_id, line_no, regexp_split_to_array(
               regexp_replace(line, '^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]+') as ws
             from doc_lines where line_no >= 1)""",
    ("doc_lines",),
)
def field_extract(spark, sf):
    return text.field(t.table(spark, sf, "documents").select("doc_id", "text"), 2, skip=1)


@query(
    "multi_file_concat",
    """select cast(row_number() over (order by doc_id, line_no) - 1 as bigint) as out_no,
              doc_id, line from doc_lines""",
    ("doc_lines",),
)
def multi_file_concat(spark, sf):
    return files.concat_files(t.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(
    "concat_two",
    "select doc_id, upper(lang) || '-' || text as text from documents",
)
def concat_two(spark, sf):
    tree = merge(
        foo=Derive("foo", {"v": "upper(lang)"}), bar=Derive("bar", {"v": "text"})
    ).on("doc_id")
    both = run(tree, t.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return both.select("doc_id", F.concat("foo_v", F.lit("-"), "bar_v").alias("text"))


@query(
    "pipe_rows",
    """select line, count(*) as n from (
         select translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as line
         from doc_lines) where line like '%THE%' group by line""",
    ("doc_lines",),
)
def pipe_rows(spark, sf):
    lines = t.doc_lines(spark, sf)
    piped = files.pipe_command(lines, ["tr a-z A-Z", "awk /THE/"])
    return piped.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gunzip_text",
    "select line, count(*) as n from doc_lines group by line",
    ("doc_lines",),
)
def gunzip_text(spark, sf):
    packed = scratch_path(spark, "packed")
    lines = t.doc_lines(spark, sf).select("line")
    lines.write.option("compression", "gzip").text(packed, lineSep="\n")
    plain = files.decompress(spark, f"{packed}/*.gz", scratch_path(spark, "plain"))
    return plain.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "append_sink",
    """select c_name as name, c_nationkey as nation from customer
       union all select s_name, s_nationkey from supplier""",
)
def append_sink(spark, sf):
    path = scratch_path(spark, "appended")
    customers = t.table(spark, sf, "customer").selectExpr("c_name as name", "c_nationkey as nation")
    suppliers = t.table(spark, sf, "supplier").selectExpr("s_name as name", "s_nationkey as nation")
    files.append(customers, path)
    files.append(suppliers, path)
    return spark.read.schema(customers.schema).parquet(path)
