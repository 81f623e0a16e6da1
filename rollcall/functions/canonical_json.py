"""JSON in one canonical text: equal values have equal texts, whatever their keys' order, spaces or notation of numbers."""

from __future__ import annotations

import json
from decimal import Decimal
from json.encoder import encode_basestring as _quoted  # short escapes, other controls as \u00xx, the rest as it is

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def _scalar(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return _quoted(v)
    return format(v if v else abs(v), "f") if isinstance(v, Decimal) else str(v)


def _refused(name: str):
    raise ValueError(name)


def canonical(text: str | None) -> str | None:
    """Keys by length and then by bytes, of equal ones the last; numbers without exponents, with their digits; characters as
    they are but for quotes, backslashes and controls; ', ' and ': ' between. Null for what is no JSON, for the NUL
    character, and for texts nested too deeply to be read."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_float=Decimal, parse_constant=_refused)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []
    stack: list = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, tuple):  # finished text
            out.append(v[0])
        elif isinstance(v, dict):
            stack.append(("}",))
            for k, (key, own) in enumerate(reversed(sorted(v.items(), key=lambda kv: (len(kv[0].encode()), kv[0].encode())))):
                stack += [own, (_quoted(key) + ": ",)] + ([(", ",)] if k < len(v) - 1 else [])
            stack.append(("{",))
        elif isinstance(v, list):
            stack.append(("]",))
            for k, own in enumerate(reversed(v)):
                stack += [own] + ([(", ",)] if k < len(v) - 1 else [])
            stack.append(("[",))
        else:
            out.append(_scalar(v))
    done = "".join(out)
    return None if "\\u0000" in done.replace("\\\\", "") else done


def canonical_json(spark: SparkSession, c: Column) -> Column:
    ship(spark)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(canonical)

    return run(c)


#: The keys of an audit event's hashed object.
EVENT = ("previousHash", "sequenceNumber", "occurredAt", "actorType", "actorIdentifier", "action", "subjectType", "subjectIdentifier", "metadata")
_KEYS = sorted(("version", *EVENT), key=lambda k: (len(k), k))
_FORM = "{{" + ", ".join(f"{_quoted(k)}: {{{k}}}" for k in _KEYS) + "}}"


def event_text(previous: str | None, sequence: int, occurred: pd.Timestamp, actor_type, actor, action, subject_type, subject, metadata: str | None) -> str:
    """The canonical text of an audit event that follows one with the hash `previous`; times in UTC, to the microsecond.
    ValueError if the metadata are no JSON."""
    own = canonical(metadata or "{}")
    if own is None:
        raise ValueError("an audit event's metadata are no JSON")
    values = (previous, int(sequence), f"{occurred:%Y-%m-%dT%H:%M:%S.%f}Z", actor_type, actor, action, subject_type, subject)
    parts = {k: _scalar(v if isinstance(v, (str, int)) or not pd.isna(v) else None) for k, v in zip(EVENT, values)}
    return _FORM.format(version="1", **parts | {"metadata": own})
