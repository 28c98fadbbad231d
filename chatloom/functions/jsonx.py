"""JSON from texts: strict checks, and finding a value in a model's reply."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatloom.functions.text import let, trim, without_bom


def _no_constant(name: str) -> None:
    raise ValueError(name)


def strict(text: str | None) -> Any:
    """The value of a JSON text; ValueError for anything else, NaN and Infinity included."""
    return json.loads(text if text is not None else "", parse_constant=_no_constant)


def extract_json(reply: str | None) -> Any:
    """The JSON value in a reply: the reply itself, else a fenced block, else from the first bracket to the last; or None."""
    text = (reply or "").strip()
    tries = [text]
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    if fence:
        tries.append(fence[1].strip())
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if starts:
        end = max(text.rfind("}"), text.rfind("]"))
        tries.append(text[min(starts) : end + 1])
    for t in tries:
        try:
            return strict(t)
        except ValueError:
            continue
    return None


#: What JSON itself does not allow, though parsers do.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false", "allowNumericLeadingZeros": "false", "allowUnquotedControlChars": "false", "mode": "PERMISSIVE"}


def strict_json(text: Column) -> Column:
    """The text (without byte order mark and outer space) where it is one JSON value and nothing else, else null.

    Parsers stop behind the first value. Behind ``[`` and before ``]`` only a value followed by nothing, or by a bracket, comes
    out as an array of one; as a field of an object, followed by another one, what is behind a bracket is an error.
    """

    def check(t: Column) -> Column:
        alone = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", STRICT)
        field = F.from_json(F.concat(F.lit('{"v":'), t, F.lit(',"end":1}')), "struct<v: string, end: int>", STRICT)
        return F.when((t != "") & (F.size(alone) == 1) & (field["end"] == 1), t)

    return let(trim(without_bom(text)), check)


@F.pandas_udf(StringType())
def json_in_reply(replies: pd.Series) -> pd.Series:
    """The JSON value in each reply as canonical text, or null."""

    def one(reply: str | None) -> str | None:
        found = extract_json(reply)
        return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return replies.map(one)
