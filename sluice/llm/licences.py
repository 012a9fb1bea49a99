"""License scans: ordered signature rules over words, in Spark SQL expressions only.

A text is brought to words joined by one blank. A keyword prefilter decides which rules may
match; only those regexes run. Each match is a span of words. A span that lies inside another
one is suppressed if that one has a higher priority, or the same priority and more words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the base: phrases that are counted in any case, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Characters that no word has, once A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words of a text in any case. Single characters make a table lookup of the
#: regex, which ranges do not.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Priorities: a clue, a licence family, a named licence, a licence with its version.
CLUE, FAMILY, NAMED, VERSIONED = 0, 1, 2, 3
CONFIDENCE = {CLUE: 0.3, FAMILY: 0.7, NAMED: 0.9, VERSIONED: 1.0}


def _versioned() -> list[tuple[str, str, str, int]]:
    """Rules of licences that come in versions: keyword, regex, label, priority."""
    rules = []
    parts = {"": "", "-sa": " sa", "-nc": " nc", "-nd": " nd", "-nc-sa": " nc sa", "-nc-nd": " nc nd"}
    names = {"sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for suffix, words in parts.items():
        long = "".join(f" {names[p]}" for p in words.split())
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-by{suffix}-{version.replace(' ', '.')}"
            rules.append(("cc by", f"cc by{words} v?{version}", label, VERSIONED))
            rules.append(
                (
                    "creative commons",
                    f"creative commons attribution{long} (?:licen[cs]e )?(?:version )?v?{version}",
                    label,
                    VERSIONED,
                )
            )
        if suffix:
            rules.append(("cc by", f"cc by{words}", f"cc-by{suffix}", NAMED))
        rules.append(("creative commons", f"creative commons attribution{long}", f"cc-by{suffix}", NAMED))
    gnu = {
        "gpl": ("general public", ("1", "2", "3")),
        "lgpl": ("(?:lesser|library) general public", ("2", "2 1", "3")),
        "agpl": ("affero general public", ("1", "3")),
        "gfdl": ("free documentation", ("1 1", "1 2", "1 3")),
    }
    tails = {"-or-later": " (?:or|and) (?:any )?later(?: version)?", "-only": " only", "": ""}
    for short, (words, versions) in gnu.items():
        keyword = "free documentation" if short == "gfdl" else "general public"
        for version in versions:
            zero = "(?: 0)?" if " " not in version else ""
            for tail, more in tails.items():
                label = f"{short}-{version.replace(' ', '.')}{tail}"
                rules.append((short, f"{short} ?(?:version |v ?)?{version}{zero}{more}", label, VERSIONED))
                rules.append(
                    (keyword, f"(?:gnu )?{words} licen[cs]e (?:version |v ?)?{version}{zero}{more}", label, VERSIONED)
                )
        rules.append((short, f"gnu {short}", short, NAMED))
    families = {
        "apache": ("apache (?:software )?licen[cs]e", "apache", ("1 0", "1 1", "2 0")),
        "mozilla": ("mozilla public licen[cs]e", "mpl", ("1 0", "1 1", "2 0")),
        "eclipse": ("eclipse (?:public|distribution) licen[cs]e", "epl", ("1 0", "2 0")),
        "european union": ("european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
        "artistic": ("artistic licen[cs]e", "artistic", ("1 0", "2 0")),
        "boost": ("boost software licen[cs]e", "bsl", ("1 0",)),
        "open font": ("(?:sil )?open font licen[cs]e", "ofl", ("1 0", "1 1")),
        "common development": (
            "common development and distribution licen[cs]e", "cddl", ("1 0", "1 1")),
        "common public": ("common public licen[cs]e", "cpl", ("0 5", "1 0")),
        "academic free": ("academic free licen[cs]e", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        "open software": ("open software licen[cs]e", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
        "php": ("php licen[cs]e", "php", ("3 0", "3 01")),
        "zope": ("zope public licen[cs]e", "zpl", ("1 1", "2 0", "2 1")),
        "lucent": ("lucent public licen[cs]e", "lpl", ("1 0", "1 02")),
        "cecill": ("cecill(?: [abc])?", "cecill", ("1 0", "1 1", "2 0", "2 1")),
        "open database": ("(?:odc )?open database licen[cs]e", "odbl", ("1 0",)),
        "community data": ("community data licen[cs]e agreement", "cdla", ("1 0", "2 0")),
        "latex project": ("latex project public licen[cs]e", "lppl", ("1 0", "1 1", "1 2", "1 3")),
        "business source": ("business source licen[cs]e", "busl", ("1 0", "1 1")),
        "server side": ("server side public licen[cs]e", "sspl", ("1 0",)),
        "elastic": ("elastic licen[cs]e", "elastic", ("1 0", "2 0")),
        "non profit open": ("non profit open software licen[cs]e", "nposl", ("3 0",)),
        "reciprocal public": ("reciprocal public licen[cs]e", "rpl", ("1 1", "1 5")),
        "netscape": ("netscape public licen[cs]e", "npl", ("1 0", "1 1")),
        "apple public": ("apple public source licen[cs]e", "apsl", ("1 0", "1 1", "1 2", "2 0")),
        "ibm public": ("ibm public licen[cs]e", "ipl", ("1 0",)),
        "q public": ("q public licen[cs]e", "qpl", ("1 0",)),
        "universal permissive": ("universal permissive licen[cs]e", "upl", ("1 0",)),
        "mulan": ("mulan (?:psl|permissive software licen[cs]e)", "mulan", ("1", "2")),
    }
    for keyword, (words, short, versions) in families.items():
        for version in versions:
            label = f"{short}-{version.replace(' ', '.')}"
            rules.append((keyword, f"{words} (?:version |v)?{version}", label, VERSIONED))
        rules.append((keyword, words, short, NAMED))
    for short, versions in (("mpl", ("1 0", "1 1", "2 0")), ("epl", ("1 0", "2 0")), ("eupl", ("1 1", "1 2"))):
        for version in versions:
            rules.append((short, f"{short} (?:version |v)?{version}", f"{short}-{version.replace(' ', '.')}", VERSIONED))
    return rules


#: Further hand-written rules: keyword, regex over words, label, priority.
_SINGLE = [
    ("apache", "apache 2(?: 0)?", "apache-2.0", VERSIONED),
    ("apache", "licensed under the apache", "apache", FAMILY),
    ("mit licen", "mit licen[cs]e", "mit", NAMED),
    ("licensed under", "licensed under (?:the )?(?:terms of (?:the )?)?mit", "mit", NAMED),
    ("hereby granted", "permission is hereby granted free of charge to any person", "mit", NAMED),
    ("expat", "expat licen[cs]e", "mit", NAMED),
    ("x11", "x11 licen[cs]e", "x11", NAMED),
    ("bsd", "(?:2|two) clause (?:simplified )?bsd", "bsd-2-clause", VERSIONED),
    ("bsd", "bsd (?:2|two) clause", "bsd-2-clause", VERSIONED),
    ("bsd", "simplified bsd licen[cs]e", "bsd-2-clause", VERSIONED),
    ("bsd", "(?:3|three) clause (?:new |revised )?bsd", "bsd-3-clause", VERSIONED),
    ("bsd", "bsd (?:3|three) clause", "bsd-3-clause", VERSIONED),
    ("bsd", "(?:new|revised|modified) bsd licen[cs]e", "bsd-3-clause", VERSIONED),
    ("bsd", "(?:4|four) clause bsd", "bsd-4-clause", VERSIONED),
    ("bsd", "original bsd licen[cs]e", "bsd-4-clause", VERSIONED),
    ("bsd", "bsd (?:style )?licen[cs]e", "bsd", NAMED),
    ("redistribution and use", "redistribution and use in source and binary forms", "bsd", FAMILY),
    ("isc licen", "isc licen[cs]e", "isc", NAMED),
    ("permission to use", "permission to use copy modify and (?:or )?distribute", "isc", FAMILY),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", NAMED),
    ("unlicense", "(?:the )?unlicense", "unlicense", NAMED),
    ("wtfpl", "wtfpl", "wtfpl", NAMED),
    ("python software", "python software foundation licen[cs]e", "psf", NAMED),
    ("openssl", "openssl licen[cs]e", "openssl", NAMED),
    ("w3c", "w3c (?:software )?licen[cs]e", "w3c", NAMED),
    ("ruby", "ruby licen[cs]e", "ruby", NAMED),
    ("cc0", "cc0(?: 1 0)?", "cc0", NAMED),
    ("creative commons", "creative commons zero", "cc0", NAMED),
    ("creative commons", "creative commons", "creative-commons", FAMILY),
    ("public domain", "public domain", "public-domain", FAMILY),
    ("public domain", "dedicated to the public domain", "public-domain", NAMED),
    ("proprietary", "proprietary and confidential", "proprietary", NAMED),
    ("unauthorized", "unauthorized (?:copying|use|distribution)", "proprietary", FAMILY),
    ("reproduced", "no part of this (?:publication|work|book) may be reproduced", "proprietary", NAMED),
    ("commercial use", "(?:not for|no) commercial use", "non-commercial", FAMILY),
    ("rights reserved", "some rights reserved", "some-rights-reserved", FAMILY),
    ("rights reserved", "copyright (?:c )?(?:[0-9]{4} )?(?:[^ ]+ ){0,6}all rights reserved", "copyright-reserved", NAMED),
    ("copyright", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?", "copyright", CLUE),
    ("licensed under", "licensed under (?:the )?(?:terms of )?", "licence-notice", CLUE),
    ("license agreement", "end user licen[cs]e agreement", "eula", NAMED),
    ("free software", "this program is free software", "gpl", FAMILY),
    ("fair use", "fair use", "fair-use", CLUE),
]


#: Signatures of notices, tags and addresses as they stand in files, written by hand: keyword,
#: regex over words, label, priority.
_NOTICES = [
    ("spdx", "spdx licen[cs]e identifier mit", "mit", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier mit 0", "mit-0", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier isc", "isc", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier 0bsd", "0bsd", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier bsd 2 clause", "bsd-2-clause", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier bsd 3 clause", "bsd-3-clause", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier apache 2 0", "apache-2.0", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier mpl 2 0", "mpl-2.0", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier epl 2 0", "epl-2.0", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier gpl 2 0(?: only)?", "gpl-2-only", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier gpl 2 0 or later", "gpl-2-or-later", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier gpl 3 0(?: only)?", "gpl-3-only", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier gpl 3 0 or later", "gpl-3-or-later", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier lgpl 2 1(?: only)?", "lgpl-2.1-only", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier lgpl 2 1 or later", "lgpl-2.1-or-later", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier lgpl 3 0(?: only)?", "lgpl-3-only", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier agpl 3 0(?: only)?", "agpl-3-only", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier agpl 3 0 or later", "agpl-3-or-later", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier cc0 1 0", "cc0", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier unlicense", "unlicense", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier zlib", "zlib", VERSIONED),
    ("spdx", "spdx licen[cs]e identifier", "licence-notice", CLUE),
    ("license mit", "license mit", "mit", NAMED),
    ("license isc", "license isc", "isc", NAMED),
    ("license apache", "license apache(?: software)?(?: licen[cs]e)? 2 0", "apache-2.0", VERSIONED),
    ("license bsd", "license bsd(?! [0-9])", "bsd", NAMED),
    ("license gpl", "license gpl(?! v?[0-9])", "gpl", NAMED),
    ("under the mit", "(?:released|distributed|available|published|provided) under the mit", "mit", NAMED),
    ("under the bsd", "(?:released|distributed|available|published|licensed) under the bsd", "bsd", NAMED),
    ("under the gpl", "(?:released|distributed|available|published|licensed) under the (?:gnu )?gpl", "gpl", NAMED),
    ("under the apache", "(?:released|distributed|available|published) under the apache", "apache", FAMILY),
    ("either version", "either version 2 of the licen[cs]e or at your option any later version", "gpl-2-or-later", VERSIONED),
    ("either version", "either version 3 of the licen[cs]e or at your option any later version", "gpl-3-or-later", VERSIONED),
    ("either version", "either version 2 1 of the licen[cs]e or at your option any later version", "lgpl-2.1-or-later", VERSIONED),
    ("version 2 of", "general public licen[cs]e version 2 as published by the free software foundation", "gpl-2-only", VERSIONED),
    ("received a copy", "you should have received a copy of the gnu general public licen[cs]e", "gpl", NAMED),
    ("received a copy", "you should have received a copy of the gnu lesser general public licen[cs]e", "lgpl", NAMED),
    ("received a copy", "you should have received a copy of the gnu affero general public licen[cs]e", "agpl", NAMED),
    ("gnu org", "gnu org licen[cs]es gpl 3 0", "gpl-3", VERSIONED),
    ("gnu org", "gnu org licen[cs]es", "gnu", FAMILY),
    ("apache org", "apache org licen[cs]es license 2 0", "apache-2.0", VERSIONED),
    ("mozilla org", "mozilla org mpl 2 0", "mpl-2.0", VERSIONED),
    ("source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "mpl-2.0", VERSIONED),
    ("opensource org", "opensource org licen[cs]es? mit", "mit", VERSIONED),
    ("opensource org", "opensource org licen[cs]es? bsd 3 clause", "bsd-3-clause", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by 3 0", "cc-by-3.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by 4 0", "cc-by-4.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by sa 3 0", "cc-by-sa-3.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by sa 4 0", "cc-by-sa-4.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by nc 4 0", "cc-by-nc-4.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by nd 4 0", "cc-by-nd-4.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by nc sa 4 0", "cc-by-nc-sa-4.0", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es by nc nd 4 0", "cc-by-nc-nd-4.0", VERSIONED),
    ("creativecommons org", "creativecommons org publicdomain zero 1 0", "cc0", VERSIONED),
    ("creativecommons org", "creativecommons org publicdomain mark 1 0", "public-domain", VERSIONED),
    ("creativecommons org", "creativecommons org licen[cs]es", "creative-commons", FAMILY),
    ("software is provided", "(?:the|this) software is provided as is(?: and [^ ]+ disclaims all warranties)?", "warranty-disclaimer", FAMILY),
    ("software is provided", "the software is provided as is without warranty of any kind express or implied", "mit", FAMILY),
    ("software is provided", "this software is provided by the copyright holders(?: and contributors)?", "bsd", FAMILY),
    ("without any warranty", "(?:but )?without any warranty without even the implied warranty of merchantability", "gpl", FAMILY),
    ("without any express", "provided as is without any express or implied warranty", "zlib", FAMILY),
    ("neither the name", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "bsd-3-clause", NAMED),
    ("above copyright", "the above copyright notice and this permission notice shall be included in all copies", "mit", NAMED),
    ("above copyright", "provided that the above copyright notice and this permission notice appear in all copies", "isc", NAMED),
    ("you may not use", "you may not use this file except in compliance with the licen[cs]e", "apache", NAMED),
    ("unless required", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", "apache", NAMED),
    ("origin of", "the origin of this software must not be misrepresented", "zlib", NAMED),
    ("free and unencumbered", "this is free and unencumbered software released into the public domain", "unlicense", NAMED),
    ("what the fuck", "do what the fuck you want to public licen[cs]e", "wtfpl", NAMED),
    ("beerware", "the beerware licen[cs]e", "beerware", NAMED),
]


def signature_rules() -> list[tuple[int, str, str, str, int]]:
    """All rules in order: number, keyword, regex over words, label, priority."""
    keywords = ("cc by", "general public", "rights reserved")
    base = [(k, p, n, FAMILY) for k, (p, n) in zip(keywords, BASE.items(), strict=True)]
    rules = [*base, *_versioned(), *_SINGLE, *_NOTICES]
    return [
        (number, keyword, f" (?:{regex.strip()})(?= |$)", label, priority)
        for number, (keyword, regex, label, priority) in enumerate(rules)
    ]


def _rule_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({n}, '{k}', '{p}', '{q}', {r})" for n, k, p, q, r in signature_rules())
    return spark.sql(
        f"select * from values {rows} as t(_rule, _keyword, _regex, label, priority)"
    )


def _needed(keyword: str) -> list[list[str]]:
    """For each word of a keyword the whole words one of which every match of its rules has."""
    spelled = {"licen": ["license", "licence"]}
    for short in ("gpl", "lgpl", "agpl", "gfdl"):  # the version may stand right behind the name
        ends = ["", "v", "version", *[f"{v}{n}" for v in ("", "v") for n in "123"]]
        spelled[short] = [short + end for end in ends]
    if keyword == "version 2 of":  # is not part of its rule's match, so the last word may go on
        keyword = "version 2"
    return [spelled.get(word, [word]) for word in keyword.split()]


def _blanks(text: Column | str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every rule: id, ``text_hash``, ``rule``, ``label``, ``priority``, ``first_word``,
    ``last_word`` (words from 0) and ``suppressed``.

    Rows that repeat both id and text give their spans once. A null text has none.
    """
    keywords = sorted({k for _, k, _, _, _ in signature_rules()})

    known = sorted({w for k in keywords for choice in _needed(k) for w in choice})

    def likely(held: Column) -> Column:
        tests = [
            F.when(
                _all(F.arrays_overlap(held, F.array(*map(F.lit, choice))) for choice in _needed(keyword)),
                F.lit(keyword),
            )
            for keyword in keywords
        ]
        return F.array_compact(F.array(*tests))

    # One pass over the words leaves the few that a keyword has, so no text is searched once for
    # each keyword. Words of ASCII are lowered alike by any rule.
    words = F.split(F.lower("_text"), BETWEEN, -1)
    held = F.array_intersect(words, F.array(*map(F.lit, known)))
    # The lambda binds the words held, so they are found once and not once for each keyword.
    hits = F.transform(F.array(held), lambda h: F.when(F.size(h) > 0, likely(h)))[0]
    gated = (
        docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
        .withColumn("_likely", hits)
        .where("size(_likely) > 0")
        .withColumn("_hash", F.xxhash64("_text"))
        .withColumn(
            "_words",
            F.concat(
                F.lit(" "),
                F.trim(F.regexp_replace(F.translate("_text", UPPER, LOWER), SEPARATORS, " ")),
            ),
        )
        .select("_id", "_hash", "_words", F.explode("_likely").alias("_keyword"))
        .where(F.contains("_words", F.concat(F.lit(" "), "_keyword")))
    )
    rules = F.broadcast(_rule_table(docs.sparkSession))  # a fixed table of a few hundred rows
    matched = (
        gated.join(rules, "_keyword")
        .withColumn("_found", F.expr("regexp_extract_all(_words, _regex, 0)"))
        .where("size(_found) > 0")
        .withColumn("_gaps", F.expr("split(_words, _regex)"))
        .select(
            "_id", "_hash", "_rule", "label", "priority",
            F.posexplode(F.arrays_zip("_found", "_gaps")).alias("_at", "_one"),
        )
        .where("_one._found is not null")
        .select(
            "_id", "_hash", "_rule", "label", "priority", "_at",
            _blanks("_one._found").alias("_length"),
            _blanks("_one._gaps").alias("_gap"),
        )
    )
    per_rule = W.partitionBy("_id", "_hash", "_rule").orderBy("_at")
    placed = (
        matched.repartition("_id", "_hash")
        .dropDuplicates(["_id", "_hash", "_rule", "_at"])
        .withColumn("first_word", F.sum(F.col("_gap") + F.col("_length")).over(per_rule) - F.col("_length"))
        .withColumn("last_word", F.col("first_word") + F.col("_length") - 1)
    )
    # Spans in order of start, longest first: what holds a span stands before it, or beside it.
    order = W.partitionBy("_id", "_hash").orderBy("first_word", F.desc("last_word"))
    before = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    reach = {
        p: F.max(F.when(F.col("priority") > p, F.col("last_word"))).over(before) for p in CONFIDENCE
    }
    same = order.rowsBetween(W.unboundedPreceding, -1)
    longer = {
        p: F.max(F.when(F.col("priority") == p, F.struct("last_word", -F.col("first_word"))))
        .over(same) for p in CONFIDENCE
    }
    above, beside = F.lit(None), F.lit(None)
    for p in CONFIDENCE:
        above = F.when(F.col("priority") == p, reach[p]).otherwise(above)
        beside = F.when(F.col("priority") == p, longer[p]).otherwise(beside)
    inside = (F.col("_beside.last_word") >= F.col("last_word")) & ~(
        (F.col("_beside.last_word") == F.col("last_word"))
        & (-F.col("_beside.col2") == F.col("first_word"))
    )
    return (
        placed.withColumn("_above", above)
        .withColumn("_beside", beside)
        .withColumn(
            "suppressed",
            F.coalesce(F.col("_above") >= F.col("last_word"), F.lit(False))
            | F.coalesce(inside, F.lit(False)),
        )
        .select(
            F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"), F.col("_rule").alias("rule"),
            "label", "priority", "first_word", "last_word", "suppressed",
        )
    )


def _word_count(text: Column) -> Column:
    """Words of a text; a word is put before and after, so no piece of the split is empty."""
    return (F.size(F.split(F.concat(F.lit("a "), text, F.lit(" a")), BETWEEN, -1)) - 2).cast("long")


def _all(tests) -> Column:
    out = None
    for test in tests:
        out = test if out is None else out & test
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``n_words``, base counts and places, ``base_labels``, ``labels``, ``score``.

    Base labels stay even where a longer rule holds them. A null text counts as empty: no words,
    no labels (empty strings), score 0. Rows that repeat id and text are reported alike.
    """
    base = F.col("rule") < len(BASE)
    shown = ~F.col("suppressed") | base
    confidence = F.lit(0.0)
    for priority, value in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == priority, F.lit(value)).otherwise(confidence)
    found = (
        license_spans(docs, id_col, text_col)
        .groupBy(F.col(f"`{id_col}`").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("_base"),
            F.array_sort(F.collect_set(F.when(shown, F.col("label")))).alias("_labels"),
            F.max(F.when(shown, confidence)).alias("_score"),
        )
    )
    narrow = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_own"),
        _word_count(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("n_words"),
    )
    joined = narrow.join(
        found, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left"
    )
    return joined.select(
        id_col,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.concat_ws(",", "_base"), F.lit("")).alias("base_labels"),
        F.coalesce(F.concat_ws(",", "_labels"), F.lit("")).alias("labels"),
        F.coalesce("_score", F.lit(0.0)).cast("double").alias("score"),
    )
