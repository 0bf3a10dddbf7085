"""Normal forms of entity names and identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Titles and suffixes that do not tell names apart.
TITLES = "mr|mrs|ms|miss|dr|prof|sir|dame|rev"
SUFFIXES = "jr|sr|ii|iii|iv|phd|md|esq"


@F.pandas_udf(StringType())
def _plain(names: pd.Series) -> pd.Series:
    """Compatibility forms decomposed, combining marks dropped, case folded."""
    bare = lambda n: "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)).casefold()
    return names.map(bare, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """Case and accents folded, punctuation to spaces, leading titles and trailing suffixes stripped. Initials, the order of words and
    company endings stay, as they tell names apart."""
    words = F.trim(F.regexp_replace(F.regexp_replace(_plain(name), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    bare = F.regexp_replace(words, rf"^(?:(?:{TITLES})(?: |$))+", "")
    return F.trim(F.regexp_replace(bare, rf"(?:(?:^| )(?:{SUFFIXES}))+$", ""))


def normalize_identifier(identifier: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(identifier)), "^mailto:", ""), "/+$", "")
