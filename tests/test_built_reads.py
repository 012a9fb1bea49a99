"""Reads built from documents, and trimming by quality, on odd rows."""

from hashlib import md5

from sluice.operators import reads as rd
from sluice.sources import tables as t

TEXTS = [(1, "x" * 79), (2, ""), (3, None), (4, "Ünïcödé " * 40), (None, "ACGT" * 50), (5, "\x00\n" * 300), (5, "again " * 30)]


def _digits(*parts):
    return md5("".join(parts).encode()).hexdigest()


def _expected():
    for doc, text in TEXTS:
        seq = "".join("ACGT"[b & 3] for b in (text or "").encode())
        for i in range(0, len(seq), 80):
            name = None if doc is None else f"c{doc}_{i // 80}"
            for mate in (1, 2):
                if mate == 2 and name is None:
                    yield None, 2, None, None, None, None, None
                    continue
                shift = int(_digits(name, "/2")[:7], 16) % min(80, len(seq) - i) if mate == 2 else 0
                read, pos = list(seq[i : i + 160][shift : shift + 80]), i + 1 + shift
                planted = 97 - (pos - 1) % 97
                if planted <= len(read):
                    read[planted - 1] = dict(zip("ACGT", "CGTA"))[read[planted - 1]]
                if i // 80 % 7 == 0 and len(read) >= 40:
                    read[39] = dict(zip("ACGT", "GTAC"))[read[39]]
                qual = None
                if name is not None:
                    cut = 30 + int(_digits(name, "c", str(mate))[:7], 16) % 60
                    noise = "".join(_digits(name, c, str(mate)) for c in "qrs")
                    qual = [int(noise[j], 16) + (24 if 0 < j < cut else 0) for j in range(len(read))]
                contig = None if doc is None else f"c{doc}"
                yield name, mate, contig, pos, len(read), "".join(read), qual


def test_reads_are_built_as_described(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    monkeypatch.setattr(t, "TILES", 3)  # documents go beyond what is made at once
    expected = sorted(map(repr, _expected()))
    found = t._sequenced(spark, path, qualities=True)
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    plan = t.reads(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "regexp" not in plan


def _trimmed(qual, leading, trailing, width, mean):
    """Where the kept part begins and its length, value by value."""
    good = [i for i, q in enumerate(qual) if q is not None and q >= leading]
    start = good[0] if good else len(qual)
    end = max([i + 1 for i, q in enumerate(qual) if q is not None and q >= trailing], default=0)
    kept = qual[start:end] if start < end else []
    for i in range(len(kept) - width + 1):
        part = kept[i : i + width]
        if None not in part and sum(part) < width * mean:
            return start, kept[:i]
    return start, kept


def test_trimming_of_small_numbers_nulls_and_uneven_reads(spark):
    quals = [[40] * 40, [95, 33, 90, 100, 127], [], None, [None, 2, 30, None, 30, 30, 1, 1, 1, 1], [1, 1], [30] * 9 + [2] * 9, [3]]
    rows = [(i, "é" * (len(q or []) + i % 2), q) for i, q in enumerate(quals)]
    for kind in ("tinyint", "int", "double"):
        reads = spark.createDataFrame(rows, "read_id int, seq string, qual array<int>").selectExpr(
            "read_id", "seq", f"cast(qual as array<{kind}>) as qual"
        )
        for setting in ((3, 3, 4, 20), (25, 3, 1, 10), (3, 31, 5, 29)):
            found = rd.quality_trim(reads.coalesce(1), setting[0], setting[1], setting[2:], minlen=0).collect()
            wanted = {}
            for i, seq, q in rows:
                if q is not None:
                    start, kept = _trimmed(q, *setting)
                    wanted[i] = (seq[start : start + len(kept)], kept)
            assert {r["read_id"]: (r["seq"], r["qual"]) for r in found} == wanted
    assert "ArrowEvalPython" in rd.quality_trim(reads)._jdf.queryExecution().executedPlan().toString()
