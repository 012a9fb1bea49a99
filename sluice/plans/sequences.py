"""Queries on sequences: reads, k-mers, alignments, and the jobs put together from them.

The reads tile every sequence about twice, so abundance limits are 1 and 2 here.
"""

from pyspark.sql import functions as F

from sluice.functions import bases
from sluice.functions.rows import once
from sluice.operators import align, kmers
from sluice.operators import reads as rd
from sluice.operators.compose import Task, agreement, branch, chain, compare, run
from sluice.plans.oracle import NEEDS, VIEWS, query
from sluice.session import materialize, plan_bytes, scratch_path
from sluice.sources import tables as t

K = 20
CX = 1
CUTOFF = 2
# Adapter seeds that occur in the reads.
ADAPTERS = ("AGATCGGAAGAGCACA", "CGCATCGAGACAAGAA")
COARSE = {"k": 16, "stride": 27, "n_seeds": 3, "min_votes": 2}
FINE = {"k": 20, "stride": 20, "n_seeds": 4, "min_votes": 3}


def _revcomp(x):
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _windows(source, column, k):
    """Oracle: every substring of length k with its 1-based position, cut in windows first."""
    return f"""select * exclude (win), w0 + i + 1 as p, substring(win, i + 1, {k}) as word
        from (select *, unnest(range(least(1000, len(win) - {k - 1}))) as i
              from (select * exclude ({column}), w0, substring({column}, w0 + 1, {1000 + k - 1}) as win
                    from (select *, unnest(range(0, len({column}) - {k - 1}, 1000)) as w0
                          from {source} where len({column}) >= {k})))"""


def _kmer_rows(reads):
    """Oracle: canonical k-mers of a reads view with their position."""
    return f"""select read_id, mate, i, least(w, {_revcomp('w')}) as kmer
        from (select read_id, mate, i, substring(seq, i + 1, {K}) as w
              from (select read_id, mate, seq, unnest(range(len(seq) - {K - 1})) as i
                    from {reads} where len(seq) >= {K}))"""


def _map(reads, k, stride, n_seeds, min_votes):
    """Oracle: seeds vote for (contig, diagonal), the best one wins."""
    offsets = ", ".join(f"({i * stride})" for i in range(n_seeds))
    return f"""select read_id, mate, contig, pos, len(seq) as len, seq, votes from (
          select *, row_number() over (partition by read_id, mate
                                       order by votes desc, ord, pos) as r
          from (select read_id, mate, ord, contig, i.p - o as pos, cast(count(*) as int) as votes
                from (select read_id, mate, o, substring(seq, o + 1, {k}) as word
                      from {reads} cross join (values {offsets}) v(o)
                      where o + {k} <= len(seq)) q
                join ({_windows('contigs', 'seq', k)}) i using (word)
                group by read_id, mate, ord, contig, i.p - o having count(*) >= {min_votes}))
        join (select read_id, mate, seq from {reads}) using (read_id, mate)
        where r = 1"""


def _depth(aln):
    return f"""select contig, pos, count(*) as depth
        from (select contig, unnest(range(pos, pos + len)) as pos from {aln}) group by all"""


def _pileup(aln):
    counts = ", ".join(f"count(*) filter (base = '{b}') as n_{b.lower()}" for b in "ACGT")
    return f"""select contig, pos, any_value(ref) as ref, count(*) as depth, {counts}
        from (select contig, pos + unnest(range(len(seq))) as pos,
                     unnest(string_split(seq, '')) as base from {aln})
        join (select contig, unnest(range(len(seq))) + 1 as pos,
                     unnest(string_split(seq, '')) as ref from contigs) using (contig, pos)
        group by all"""


def _call(piled):
    return f"""select contig, pos, ref, alt, depth, top as n_alt
        from (select *, case when n_a = top then 'A' when n_c = top then 'C'
                             when n_g = top then 'G' else 'T' end as alt
              from (select *, greatest(n_a, n_c, n_g, n_t) as top from {piled}))
        where alt <> ref and depth >= 2 and top >= 0.8 * depth"""


VIEWS.update(
    {
        "trimmed": """
            select read_id, mate, s2[1:n] as seq, q2[1:n] as qual
            from (select *, coalesce(list_position(list_transform(range(len(q2)), lambda i:
                      i + 4 <= len(q2) and list_sum(q2[i+1:i+4]) < 80), true) - 1, len(q2)) as n
                  from (select read_id, mate, seq[a:b] as s2, qual[a:b] as q2
                        from (select *,
                                list_position(list_transform(qual, lambda q: q >= 3), true) as a,
                                len(qual) + 1 - list_position(list_transform(list_reverse(qual),
                                  lambda q: q >= 3), true) as b
                              from reads) where a is not null))
            where n >= 36""",
        "paired": """
            select * from trimmed where read_id in
              (select read_id from trimmed group by read_id having count(*) = 2)""",
        "raw_kmers": _kmer_rows("reads"),
        "raw_counts": "select kmer, count(*) as n from raw_kmers group by kmer",
        "pair_kmers": _kmer_rows("paired"),
        "pair_counts": "select kmer, count(*) as n from pair_kmers group by kmer",
        "filtered": f"""
            select read_id, mate, seq from paired anti join
              (select distinct read_id, mate from pair_kmers join pair_counts using (kmer)
               where n <= {CX}) bad using (read_id, mate)""",
        "shortened": f"""
            select read_id, mate, case when f is null then seq else seq[1:f + {K - 1}] end as seq
            from paired left join
              (select read_id, mate, min(i) as f from pair_kmers join pair_counts using (kmer)
               where n < {CUTOFF} group by all) using (read_id, mate)""",
    }
)
NEEDS.update(
    {
        "trimmed": ["reads"],
        "paired": ["trimmed"],
        "raw_kmers": ["reads"],
        "raw_counts": ["raw_kmers"],
        "pair_kmers": ["paired"],
        "pair_counts": ["pair_kmers"],
        "filtered": ["pair_counts"],
        "shortened": ["pair_counts"],
    }
)


def _clip_sql():
    hits = " or ".join(f"mismatches(seq[i+1:i+16], '{a}') <= 2" for a in ADAPTERS)
    return f"""select read_id, mate, case when c is null then seq else seq[1:c - 1] end as seq,
                      cast(coalesce(c, 0) as int) as clip_at
        from (select *, list_position(list_transform(range(len(seq) - 15), lambda i: {hits}), true)
                as c from reads)"""


# reads


@query("fasta_records", "select contig, seq from contigs", ("contigs",))
def fasta_records(spark, sf):
    path = scratch_path(spark, "fasta")
    rd.to_fasta(t.contigs(spark, sf)).write.text(path, lineSep="\n")
    return rd.read_fasta(spark, path)


@query(
    "split_mates",
    """select mate, count(*) as n, cast(sum(len(seq)) as bigint) as bases,
              min(seq) as first_seq from reads group by mate""",
    ("reads",),
)
def split_mates(spark, sf):
    path = scratch_path(spark, "mates")
    rd.write_mates(t.reads(spark, sf), path)
    mates = rd.split_mates(spark.read.parquet(path))
    both = mates[1].unionByName(mates[2])
    return both.groupBy("mate").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("seq")).alias("bases"),
        F.min("seq").alias("first_seq"),
    )


@query(
    "interleave_mates",
    """select cast(row_number() over (order by read_id, mate) - 1 as bigint) as slot,
              read_id, mate, seq from reads""",
    ("reads",),
)
def interleave_mates(spark, sf):
    # the sort first samples its input, and each mate is a scan of it
    mates = rd.split_mates(materialize(t.plain_reads(spark, sf), "reads"))
    return rd.interleave(mates[1], mates[2]).select("slot", "read_id", "mate", "seq")


@query(
    "quality_trim",
    "select read_id, mate, seq, cast(list_sum(qual) as bigint) as quality from trimmed",
    ("trimmed",),
)
def quality_trim(spark, sf):
    trimmed = rd.quality_trim(t.reads(spark, sf))
    total = F.aggregate("qual", F.lit(0).cast("long"), lambda a, q: a + q)
    return trimmed.select("read_id", "mate", "seq", total.alias("quality"))


@query("adapter_clip", _clip_sql(), ("reads",))
def adapter_clip(spark, sf):
    clipped = rd.adapter_clip(t.plain_reads(spark, sf), ADAPTERS)
    return clipped.select("read_id", "mate", "seq", "clip_at")


@query(
    "palindrome_clip",
    f"""with p as (select read_id || '/' || mate as read_id,
                      case when mate = 1 then seq || '{ADAPTERS[0]}' else seq end as a,
                      case when mate = 1 then {_revcomp('seq')} || '{ADAPTERS[1]}' else seq end as b from reads),
            c as (select read_id, a, b, {_revcomp('b')} as o, unnest(range(16, least(len(a), len(b)))) as n from p),
            f as (select read_id, max(n) as fragment from c where left(a, n) = right(o, n) group by read_id),
            m as (select read_id, 1 as mate, a as seq from p union all select read_id, 2, b from p)
       select read_id, mate, case when fragment is null then seq else left(seq, fragment) end as seq,
              cast(fragment as int) as fragment from m left join f using (read_id)""",
    ("reads",),
)
def palindrome_clip(spark, sf):
    """First mates as fragments that both ends read through; second mates as pairs that do not."""
    reads, first = t.plain_reads(spark, sf), F.col("mate") == 1
    forward = F.when(first, F.concat("seq", F.lit(ADAPTERS[0]))).otherwise(F.col("seq"))
    back = F.when(first, F.concat(bases.reverse_complement("seq"), F.lit(ADAPTERS[1]))).otherwise(F.col("seq"))
    ends = [F.struct(F.lit(m).alias("mate"), s.alias("seq")) for m, s in ((1, forward), (2, back))]
    pairs = reads.select(F.concat_ws("/", "read_id", F.col("mate").cast("string")).alias("read_id"), F.inline(F.array(*ends)))
    return rd.palindrome_clip(pairs).select("read_id", "mate", "seq", "fragment")


@query(
    "paired_survival",
    """select read_id, mate, case when count(*) over (partition by read_id) = 2
              then 'paired' else 'single' end as output from trimmed""",
    ("trimmed",),
)
def paired_survival(spark, sf):
    trimmed = rd.quality_trim(t.reads(spark, sf)).select("read_id", "mate")
    return rd.paired_split(trimmed)


# k-mers


@query("kmer_count", "select kmer, n from raw_counts", ("raw_counts",))
def kmer_count(spark, sf):
    return kmers.kmer_count(t.plain_reads(spark, sf), K)


@query(
    "kmer_count_text",
    "select n, count(*) as n_kmers, min(kmer) as first_kmer, max(kmer) as last_kmer from ("
    + "select word as kmer, count(*) as n from ("
    + _windows("(select doc_id, text from documents)", "text", K)
    + ") group by word) group by n",
)
def kmer_count_text(spark, sf):
    """Substrings of the documents themselves, reported per abundance."""
    texts = t.documents(spark, sf, "text").withColumnRenamed("text", "seq")
    counts = kmers.kmer_count(texts, K, canonical=False, packed=False)
    return counts.groupBy("n").agg(
        F.count(F.lit(1)).alias("n_kmers"),
        F.min("kmer").alias("first_kmer"),
        F.max("kmer").alias("last_kmer"),
    )


@query(
    "kmer_read_filter",
    f"""select read_id, mate, seq from reads anti join
          (select distinct read_id, mate from raw_kmers join raw_counts using (kmer)
           where n <= {CX}) bad using (read_id, mate)""",
    ("raw_counts",),
)
def kmer_read_filter(spark, sf):
    reads = materialize(t.plain_reads(spark, sf), "reads")
    counts = kmers.store_counts(kmers.kmer_count(reads, K))
    return kmers.filter_reads_by_kmer(reads, counts, K, cx=CX)


@query(
    "kmer_abundance_trim",
    f"""select read_id, mate, case when f is null then seq else seq[1:f + {K - 1}] end as seq
        from reads left join
          (select read_id, mate, min(i) as f from raw_kmers join raw_counts using (kmer)
           where n < {CUTOFF} group by all) using (read_id, mate)""",
    ("raw_counts",),
)
def kmer_abundance_trim(spark, sf):
    reads = materialize(t.plain_reads(spark, sf), "reads")
    counts = kmers.store_counts(kmers.kmer_count(reads, K))
    return kmers.trim_low_abundance(reads, counts, K, cutoff=CUTOFF)


@query(
    "kmer_histogram",
    """select abundance, n_kmers, cast(sum(n_kmers) over w as bigint) as cumulative,
              round(sum(n_kmers) over w / sum(n_kmers) over (), 6) as fraction
       from (select n as abundance, count(*) as n_kmers from raw_counts group by n)
       window w as (order by abundance rows between unbounded preceding and current row)""",
    ("raw_counts",),
)
def kmer_histogram(spark, sf):
    return kmers.abundance_hist(kmers.kmer_count(t.plain_reads(spark, sf), K))


@query(
    "kmer_sketch",
    """select tab, slot, cast(sum(n) as bigint) as n from (
         select tab, ('0x' || substring(md5(kmer), 1 + 8 * tab, 7))::bigint % 65536 as slot, n
         from raw_counts cross join (values (0), (1), (2), (3)) v(tab)) group by all""",
    ("raw_counts",),
)
def kmer_sketch(spark, sf):
    return kmers.kmer_sketch(t.plain_reads(spark, sf), K)


@query(
    "kmer_sketch_bounds",
    """select count(*) as n_kmers, cast(sum(n) as bigint) as n_total, cast(0 as bigint) as n_under,
              true as within from raw_counts""",
    ("raw_counts",),
)
def kmer_sketch_bounds(spark, sf):
    """All k-mers against a sketch built for an error: none too low, as good as none too high."""
    eps, confidence = 1e-4, 0.99
    reads = t.plain_reads(spark, sf)
    counts = kmers.store_counts(kmers.kmer_count(reads, K))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    estimates = kmers.bounded_estimates(counts, kmers.bounded_sketch(reads, K, eps, confidence, counts=counts))
    over = F.count_if(F.col("estimate") > F.col("n") + eps * total)
    return estimates.agg(
        F.count(F.lit(1)).alias("n_kmers"),
        F.sum("n").alias("n_total"),
        F.count_if(F.col("estimate") < F.col("n")).alias("n_under"),
        (over <= (1 - confidence) * F.count(F.lit(1))).alias("within"),
    )


# alignment tables


@query(
    "coord_sort",
    """select cast(row_number() over (order by contig, pos, read_id, mate) - 1 as bigint) as rank,
              contig, pos, read_id, mate from aln""",
    ("aln",),
)
def coord_sort(spark, sf):
    return align.coord_sort(t.aln(spark, sf).select("contig", "pos", "read_id", "mate")).select(
        "rank", "contig", "pos", "read_id", "mate"
    )


@query(
    "bin_index",
    """select contig, cast(pos // 16384 as bigint) as bin, min(pos) as first_pos,
              max(pos) as last_pos, count(*) as n from aln group by all""",
    ("aln",),
)
def bin_index(spark, sf):
    return align.bin_index(t.aln(spark, sf))


@query(
    "contig_index",
    """select contig as name, len(seq) as length,
              cast(coalesce(sum(len(contig) + 2 + len(seq) + (len(seq) + 59) // 60) over
                (order by ord rows between unbounded preceding and 1 preceding), 0)
                as bigint) + len(contig) + 2 as "offset",
              cast(least(len(seq), 60) as int) as line_bases,
              cast(least(len(seq), 60) + 1 as int) as line_width
       from contigs""",
    ("contigs",),
)
def contig_index(spark, sf):
    return align.faidx(t.contigs(spark, sf))


@query(
    "region_query",
    """with g as (select contig, len(seq) // 4 + 1 as s, len(seq) // 2 + 1 as e from contigs)
       select contig || ':' || s || '-' || e as region, read_id, mate, pos
       from aln join g using (contig) where pos <= e and pos + len - 1 >= s""",
    ("aln",),
)
def region_query(spark, sf):
    regions = _middle_regions(spark, sf)
    return align.region_query(t.aln(spark, sf), regions).select("region", "read_id", "mate", "pos")


def _middle_regions(spark, sf):
    length = F.col("length")
    regions = once(t.contigs(spark, sf), length=F.length("seq")).select(
        "contig",
        F.floor(length / 4 + 1).alias("start"),
        F.floor(length / 2 + 1).alias("end"),
    )
    name = F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return regions.withColumn("region", name)


@query(
    "region_from_index",
    """with g as (select contig, len(seq) // 4 + 1 as s, len(seq) // 2 + 1 as e from contigs)
       select contig || ':' || s || '-' || e as region, read_id, mate, pos
       from aln join g using (contig) where pos <= e and pos + len - 1 >= s""",
    ("aln",),
)
def region_from_index(spark, sf):
    """The same, read from alignments stored by level and bin."""
    path = scratch_path(spark, "binned")
    align.write_binned(t.aln(spark, sf), path)
    regions = materialize(_middle_regions(spark, sf), "regions")
    return align.read_regions(spark, path, regions).select("region", "read_id", "mate", "pos")


@query(
    "depth",
    f"""select contig, count(*) as n_pos, cast(sum(depth) as bigint) as bases,
               max(depth) as deepest, cast(sum(pos * depth) as bigint) as weighted
        from ({_depth('aln')}) group by contig""",
    ("aln",),
)
def depth(spark, sf):
    """Depth of every position, summed per contig."""
    return _depth_report(align.depth(t.aln(spark, sf)))


@query("depth_positions", _depth("aln"), ("aln",))
def depth_positions(spark, sf):
    return align.depth(t.aln(spark, sf))


def _depth_report(df):
    return df.groupBy("contig").agg(
        F.count(F.lit(1)).alias("n_pos"),
        F.sum("depth").alias("bases"),
        F.max("depth").alias("deepest"),
        F.sum(F.col("pos") * F.col("depth")).alias("weighted"),
    )


@query(
    "sam_view",
    """select read_id, case mate when 1 then 64 else 128 end as flag, contig, pos, 60 as mapq,
              len || 'M' as cigar, seq from aln""",
    ("aln",),
)
def sam_view(spark, sf):
    path = scratch_path(spark, "sam")
    rd.sam_header(t.contigs(spark, sf)).write.text(f"{path}/header", lineSep="\n")
    rd.to_sam(t.aln(spark, sf)).write.text(f"{path}/body", lineSep="\n")
    return rd.read_sam(spark, f"{path}/*/*")


@query(
    "seed_index",
    """select contig, count(*) as n_places, count(distinct seed) as n_seeds,
              cast(sum(pos) as bigint) as places, min(seed) as first_seed, max(seed) as last_seed
       from (select contig, p as pos, word as seed from ("""
    + _windows("contigs", "seq", 16)
    + ")) group by contig",
    ("contigs",),
)
def seed_index(spark, sf):
    """Every seed of every contig, reported per contig."""
    contigs = t.contigs(spark, sf)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(contigs) >> 22)
    # all seeds of a contig come from one row: dealt before they are listed, they are not shuffled
    dealt = contigs.repartition(tasks, "contig").sortWithinPartitions("contig")
    return align.seed_report(align.seed_index(dealt, 16))


@query("seed_map", _map("reads", **COARSE), ("reads",))
def seed_map(spark, sf):
    index = align.build_index(t.contigs(spark, sf), stored=False, **COARSE)
    return align.seed_map(t.plain_reads(spark, sf), index, t.contigs(spark, sf), **COARSE)


def _map_strands(reads, k, stride, n_seeds, min_votes):
    """Oracle: seeds of either strand vote for (contig, diagonal, strand), the best one wins."""
    offsets = ", ".join(f"({i * stride})" for i in range(n_seeds))
    asked = f"""select read_id, mate, len(seq) as n, o, substring(seq, o + 1, {k}) as w
                from {reads} cross join (values {offsets}) v(o) where o + {k} <= len(seq)"""
    return f"""select read_id, mate, contig, pos, len(seq) as len,
               case strand when '+' then seq else {_revcomp('seq')} end as seq, votes, strand from (
          select *, row_number() over (partition by read_id, mate
                                       order by votes desc, ord, pos, strand) as r
          from (select read_id, mate, ord, contig, strand, i.p - shift as pos, cast(count(*) as int) as votes
                from (select read_id, mate, '+' as strand, o as shift, w as word from ({asked})
                      union all
                      select read_id, mate, '-', n - o - {k}, {_revcomp('w')} from ({asked})) q
                join ({_windows('contigs', 'seq', k)}) i using (word)
                group by read_id, mate, ord, contig, strand, i.p - shift having count(*) >= {min_votes}))
        join (select read_id, mate, seq from {reads}) using (read_id, mate)
        where r = 1"""


#: Sequencers read the second mate from the other strand.
_MATES = f"(select read_id, mate, case mate when 1 then seq else {_revcomp('seq')} end as seq from reads)"


@query("seed_map_strands", _map_strands(_MATES, **COARSE), ("reads",))
def seed_map_strands(spark, sf):
    """Pairs whose second mate comes from the other strand, placed on both strands."""
    index = align.build_index(t.contigs(spark, sf), stored=False, **COARSE)
    turned = F.when(F.col("mate") == 1, F.col("seq")).otherwise(bases.reverse_complement("seq"))
    mates = t.plain_reads(spark, sf).withColumn("seq", turned)
    return align.seed_map(mates, index, t.contigs(spark, sf), **COARSE, both_strands=True)


PILED = """select contig, count(*) as n_pos, cast(sum(depth) as bigint) as bases,
                  cast(sum(pos * depth) as bigint) as weighted,
                  cast(sum(n_a) as bigint) as n_a, cast(sum(n_c) as bigint) as n_c,
                  cast(sum(n_g) as bigint) as n_g, cast(sum(n_t) as bigint) as n_t,
                  cast(sum(pos) filter (ref = 'A') as bigint) as ref_a
           from ({}) q group by contig"""


@query("pileup", PILED.format(_pileup("aln")), ("aln",))
def pileup(spark, sf):
    """Pileup of every position, summed per contig."""
    piled = align.pileup(t.aln(spark, sf), t.contigs(spark, sf))
    total = [F.sum(f"n_{b}").alias(f"n_{b}") for b in "acgt"]
    return piled.groupBy("contig").agg(
        F.count(F.lit(1)).alias("n_pos"),
        F.sum("depth").alias("bases"),
        F.sum(F.col("pos") * F.col("depth")).alias("weighted"),
        *total,
        F.sum(F.when(F.col("ref") == "A", F.col("pos"))).alias("ref_a"),
    )


@query("pileup_positions", _pileup("aln"), ("aln",))
def pileup_positions(spark, sf):
    return align.pileup(t.aln(spark, sf), t.contigs(spark, sf))


@query("consensus_call", _call("(" + _pileup("aln") + ")"), ("aln",))
def consensus_call(spark, sf):
    return align.call_variants(align.pileup(t.aln(spark, sf), t.contigs(spark, sf)))


# jobs put together


def _mapper(contigs, name, setting):
    index = align.build_index(contigs, stored=False, **setting)
    return Task(name, lambda df, **kw: align.seed_map(df, index, contigs, **kw), setting)


def _two_mappers(spark, sf):
    contigs = t.contigs(spark, sf)
    return branch(coarse=_mapper(contigs, "coarse", COARSE), fine=_mapper(contigs, "fine", FINE))


@query(
    "mapper_compare",
    f"""select read_id, mate, c.loc as at_coarse, f.loc as at_fine,
               c.loc is not distinct from f.loc as agree
        from (select read_id, mate, contig || ':' || pos as loc from ({_map('reads', **COARSE)})) c
        full join
             (select read_id, mate, contig || ':' || pos as loc from ({_map('reads', **FINE)})) f
        using (read_id, mate)""",
    ("reads",),
)
def mapper_compare(spark, sf):
    mapped = run(_two_mappers(spark, sf), t.plain_reads(spark, sf), share="table")
    at = F.concat("contig", F.lit(":"), F.col("pos").cast("string"))
    return compare(mapped.withColumn("at", at), ["read_id", "mate"], "at", ["coarse", "fine"])


@query(
    "mapper_agreement",
    f"""select count(*) as n_keys, count(*) filter (c.loc is not distinct from f.loc) as n_agree,
               avg(cast(c.loc is not distinct from f.loc as int)) as agreement
        from (select read_id, mate, contig || ':' || pos as loc from ({_map('reads', **COARSE)})) c
        full join
             (select read_id, mate, contig || ':' || pos as loc from ({_map('reads', **FINE)})) f
        using (read_id, mate)""",
    ("reads",),
)
def mapper_agreement(spark, sf):
    return agreement(mapper_compare(spark, sf))


def _prepared():
    trim = Task("trim", lambda df: rd.quality_trim(df).drop("qual"))  # no later step looks at it
    pair = Task("pair", lambda df: rd.paired_split(df).where("output = 'paired'").drop("output"))
    mates = Task("interleave", lambda df: rd.interleave(*rd.split_mates(df).values()).drop("slot"))
    return trim, pair, mates


def _sorted_and_indexed(df):
    """Alignments in coordinate order, stored by bin, and read again bin by bin of the index."""
    spark = df.sparkSession
    path = scratch_path(spark, "binned")
    align.write_binned(align.coord_sort(df), path)
    stored = align.read_binned(spark, path)
    bin_start = F.col("bin") * align.BIN
    regions = materialize(align.bin_index(stored), "bins").select(
        "contig", bin_start.alias("start"), (bin_start + (align.BIN - 1)).alias("end")
    )
    # an alignment that reaches into the next bin belongs to the one it starts in
    read = align.read_regions(spark, path, regions).where("pos >= start")
    return read.drop("start", "end", "rank")


def _viewed(df):
    """Alignments written as lines and read back."""
    path = scratch_path(df.sparkSession, "view")
    rd.to_sam(df).write.text(path, compression="gzip", lineSep="\n")
    lines = rd.read_sam(df.sparkSession, path)
    mate = F.when(F.col("flag") == 64, 1).otherwise(2)
    return lines.select("read_id", mate.alias("mate"), "contig", "pos", F.length("seq").alias("len"), "seq")


@query(
    "variants_end_to_end",
    "select 'kmc' as branch, * from ("
    + _call("(" + _pileup("(" + _map("filtered", **COARSE) + ")") + ")")
    + ") union all select 'khmer', * from ("
    + _call("(" + _pileup("(" + _map("shortened", **COARSE) + ")") + ")")
    + ")",
    ("filtered", "shortened"),
)
def variants_end_to_end(spark, sf):
    """Reads are trimmed, paired and interleaved, then two read filters, each followed by mapping,
    sorting, indexing, pileup and calling. The index comes from the reference.

    What both branches read (the paired reads, their k-mer counts, the index) is stored
    once.
    """
    contigs = t.contigs(spark, sf)
    index = align.build_index(contigs, **COARSE)
    paired = materialize(run(chain(*_prepared()), t.reads(spark, sf)), "paired")
    counts = kmers.store_counts(kmers.kmer_count(paired, K))
    tree = chain(
        branch(
            kmc=Task("kmc", lambda df, cx: materialize(kmers.filter_reads_by_kmer(df, counts, K, cx), "kmc"), {"cx": CX}),
            khmer=Task(
                "khmer",
                lambda df, cutoff: materialize(kmers.trim_low_abundance(df, counts, K, cutoff), "khmer"),
                {"cutoff": CUTOFF},
            ),
        ),
        # sorting samples its input first, and so would map again
        Task("map", lambda df: materialize(align.seed_map(df, index, contigs, **COARSE), "mapped")),
        Task("sort and index", _sorted_and_indexed),
        Task("pile", lambda df: align.pileup(df, contigs)),
        Task("call", lambda df: align.call_variants(df)),
    )
    return run(tree, paired)


@query(
    "depth_end_to_end",
    f"""select 'coarse' as branch, contig, count(*) as n_pos, cast(sum(depth) as bigint) as bases,
               max(depth) as deepest, cast(sum(pos * depth) as bigint) as weighted
        from ({_depth('(' + _map('reads', **COARSE) + ')')}) group by all
        union all
        select 'fine', contig, count(*), cast(sum(depth) as bigint), max(depth),
               cast(sum(pos * depth) as bigint)
        from ({_depth('(' + _map('reads', **FINE) + ')')}) group by all""",
    ("reads",),
)
def depth_end_to_end(spark, sf):
    summary = Task("summary", lambda df: _depth_report(df))
    tree = chain(
        _two_mappers(spark, sf),
        Task("view", _viewed),
        Task("sort and index", _sorted_and_indexed),
        Task("depth", lambda df: align.depth(df)),
        summary,
    )
    return run(tree, t.plain_reads(spark, sf), share="table")
