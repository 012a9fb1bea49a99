"""Content fingerprints: sha256 over canonical JSON.

A definition is identified by ``H(H(input) + H(output) + H(params) + H(name))``, a run of
it by ``H(H(lineage) + definition)``. Each formula exists twice: as a column expression
for tables of definitions, and on plain values for the few steps a program declares.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash input of an absent field, and of an absent name.
ABSENT = "null"
ABSENT_NAME = "undefined"


# plain values


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def canonical(value: Any) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def definition_uid(
    input: Any = None, output: Any = None, params: Any = None, name: str | None = None
) -> str:
    fields = [digest(canonical(v or None)) for v in (input, output)]
    fields.append(digest(canonical(None if params is None else params)))
    fields.append(digest(canonical(name)) if name else ABSENT_NAME)
    return digest("".join(fields))


def run_uid(uid: str, lineage: Sequence[str] = ()) -> str:
    return digest(digest(canonical(list(lineage))) + uid)


def members_uid(uids: Iterable[str]) -> str:
    return digest("".join(uids))


def replica_uid(step: str, branch: str, taken: str, upstream: str) -> str:
    """Uid of a downstream step copied for the branch ``taken``."""
    return digest(step + branch + taken + upstream)


# columns


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def json_string(value: Column) -> Column:
    """``value`` as a quoted JSON string."""
    boxed = F.to_json(F.array(value))
    return boxed.substr(F.lit(2), F.length(boxed) - 2)


def _field(json_value: Column | None) -> Column:
    text = F.lit(ABSENT) if json_value is None else F.coalesce(json_value, F.lit(ABSENT))
    return F.sha2(text, 256)


def definition_uid_of(
    input: Column | None = None,
    output: Column | None = None,
    params: Column | None = None,
    name: Column | None = None,
) -> Column:
    """Definition uid from columns that already hold canonical JSON (null = absent)."""
    last = F.lit(ABSENT_NAME)
    if name is not None:
        last = F.coalesce(F.sha2(name, 256), last)
    return digest_of(_field(input), _field(output), _field(params), last)


def run_uid_of(uid: Column, lineage: Column) -> Column:
    """Run uid of ``uid`` under ``lineage`` (an array of strings)."""
    return digest_of(F.sha2(F.to_json(lineage), 256), uid)


def fold_uid_of(uids: Column) -> Column:
    """Left fold ``H(acc + uid)`` from ``'0'``; an empty array folds to ``'0'``."""
    return F.aggregate(uids, F.lit("0"), lambda acc, uid: digest_of(acc, uid))
