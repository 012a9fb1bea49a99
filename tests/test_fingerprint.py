"""Golden vectors of the fingerprint formulas, on values and on columns."""

from pyspark.sql import functions as F

from sluice.functions import fingerprint as fp

SOURCE_SINK = "15dec7ceed7aa193d122c4508e0191c6aa7df053cdd08ae32dd244bffc949b0c"
FOO = "0d73bcf81843ca458b7441b1f8beaefa9c2451af9e7eeef5415b42ac50a35a19"
FOO_RUN = "36e49f333c6ef6a58637f6316775f881a6d56c04430800563959e6acf1704448"
BAR = "0d3e7b1fa11a5ca834d0612cf76b0c1b42d370a69e6667cd9be7f359583b6ba6"
BAR_AFTER_FOO = "2cf44be407d7b8d3d9366796604f77d15f21b86d79690d3e3e62ee470dc1c22a"
FOO_BAR_CHAIN = "1f6bba48b8971e0ee5256def7cb520cf1579ec2301a30caa93afd00899c7b87e"
FOLD_A_B = "bf4395bf049b15716a0af5747662c442595366443e40fb9dd35f020c825d32a0"


def test_values():
    assert fp.definition_uid("*.source", "*.sink") == SOURCE_SINK
    assert fp.definition_uid(params={"val": "foo"}, name="Resolve foo") == FOO
    assert fp.definition_uid(params={"val": "bar"}, name="Resolve bar") == BAR
    assert fp.run_uid(FOO) == FOO_RUN
    assert fp.run_uid(BAR, ['{"val":"foo"}', FOO_RUN]) == BAR_AFTER_FOO
    assert fp.members_uid([FOO, BAR]) == FOO_BAR_CHAIN


def test_columns(spark):
    row = spark.range(1).select(
        fp.definition_uid_of(
            fp.json_string(F.lit("*.source")), fp.json_string(F.lit("*.sink"))
        ).alias("source_sink"),
        fp.definition_uid_of(
            params=F.to_json(F.struct(F.lit("foo").alias("val"))),
            name=fp.json_string(F.lit("Resolve foo")),
        ).alias("foo"),
        fp.run_uid_of(F.lit(FOO), F.array().cast("array<string>")).alias("foo_run"),
        fp.run_uid_of(F.lit(BAR), F.array(F.lit('{"val":"foo"}'), F.lit(FOO_RUN))).alias("bar"),
        fp.fold_uid_of(F.array(F.lit("a"), F.lit("b"))).alias("fold"),
        fp.fold_uid_of(F.array().cast("array<string>")).alias("empty"),
    ).first()
    assert tuple(row) == (SOURCE_SINK, FOO, FOO_RUN, BAR_AFTER_FOO, FOLD_A_B, "0")
