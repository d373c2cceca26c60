"""Unicode normal forms, which Spark's SQL lacks, as Arrow-batched pandas UDFs, and full case folding as an expression."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellumflow.functions.text import col


@F.pandas_udf(StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """NFKC with white space squeezed."""
    return names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()))


@F.pandas_udf(StringType())
def canonical_key(names: pd.Series) -> pd.Series:
    """Letters and digits of the folded name without marks, in words."""

    def key(s: str | None) -> str | None:
        if s is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", " ", plain).strip()

    return names.map(key)


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one other letter, those letters, and what the others fold to; by the rule of the running Python."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    changed = {c: c.casefold() for c in every if c.casefold() != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefolded(c: Column | str) -> Column:
    """Full case folding as an expression, letter by letter: a letter may become several, sharp s two.

    Texts without such a letter are only translated.
    """
    text = col(c)
    old, new, several = _foldings()
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    letters = F.transform(F.split(text, ""), lambda x: F.coalesce(F.element_at(table, x), x))
    spread = F.when(text.rlike("[" + "".join(several) + "]"), F.array_join(letters, "")).otherwise(text)
    return F.translate(spread, old, new)
