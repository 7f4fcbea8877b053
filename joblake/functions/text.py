"""Text functions as native Column expressions, plus the one vectorised
Python function (token-sort ratio) that SQL cannot express."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

# --- fixed values: abbreviation rewrites, applied in this order -------------
ABBREVIATIONS = [
    (r"\bsr\.?\b", "senior"),
    (r"\bjr\.?\b", "junior"),
    (r"\beng\.?\b", "engineer"),
    (r"\bmgr\.?\b", "manager"),
    (r"\bdir\.?\b", "director"),
    (r"\bvp\.?\b", "vice president"),
    (r"\bdev\.?\b", "developer"),
    (r"\bspec\.?\b", "specialist"),
    (r"\bassoc\.?\b", "associate"),
    (r"\binc\.?\b", ""),
    (r"\bllc\.?\b", ""),
    (r"\bltd\.?\b", ""),
    (r"\bcorp\.?\b", ""),
]
# anything but a letter, digit, underscore or blank is punctuation (Unicode classes)
PUNCT = r"[^\p{L}\p{N}_\s]"
# where this finds nothing, none of the rewrites does: their full stop is optional
ANY_ABBREVIATION = r"\b(?:" + "|".join(pat.removeprefix(r"\b").removesuffix(r"\.?\b") for pat, _ in ABBREVIATIONS) + r")\b"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_text(col) -> Column:
    """lower → abbreviation rewrites → punctuation to blank → collapse blanks
    → trim; NULL becomes ''."""
    x = plain = F.lower(F.coalesce(_c(col), F.lit("")))
    for pat, rep in ABBREVIATIONS:
        x = F.regexp_replace(x, pat, rep)
    x = F.when(plain.rlike(ANY_ABBREVIATION), x).otherwise(plain)  # one search for most texts, not one for each rewrite
    x = F.regexp_replace(x, PUNCT, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalise_sql(expr: str) -> str:
    """The same normalisation as DuckDB SQL text (for oracles)."""
    x = f"lower(coalesce({expr}, ''))"
    for pat, rep in ABBREVIATIONS:
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    x = f"regexp_replace({x}, '{PUNCT}', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def dedup_hash(title, company, location) -> Column:
    """SHA-256 hex of normalised 'title|company|location'."""
    return F.sha2(F.concat_ws("|", normalise_text(title), normalise_text(company),
                              normalise_text(location)), 256)


def trigrams(col) -> Column:
    """Trigram set of a string the way the trigram index builds it: lowercase,
    words are runs of letters/digits, each word padded with two blanks in
    front and one behind, distinct 3-grams."""
    words = F.filter(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), r"[^\p{L}\p{N}]+"),
                     lambda w: F.length(w) > 0)
    grams = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    """|shared trigrams| / |union|; 0 when both are empty."""
    ga, gb = trigrams(a), trigrams(b)
    union = F.size(F.array_union(ga, gb))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ga, gb)) / union)


def _process(s) -> str:
    # token-sort preprocessing: all but letters and digits (of any script) to
    # blanks, lowercase, tokens sorted
    if s is None:
        return ""
    s = "".join(ch if ch.isalnum() else " " for ch in s).lower()
    return " ".join(sorted(s.split()))


def _lcs_len(a: str, b: str) -> int:
    # bit-parallel longest common subsequence (Hyyrö): one big-int pass per char of b
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def token_sort_ratio_py(a, b) -> int:
    """round(100 * 2*LCS / (len_a + len_b)) of the token-sorted strings; two
    empty strings score 100, one empty string scores 0."""
    pa, pb = _process(a), _process(b)
    total = len(pa) + len(pb)
    if total == 0:
        return 100
    if not pa or not pb:
        return 0
    return int(round(100.0 * 2 * _lcs_len(pa, pb) / total))


@pandas_udf(IntegerType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised over Arrow batches of candidate pairs."""
    out = np.fromiter((token_sort_ratio_py(x, y) for x, y in zip(a, b)), dtype=np.int32, count=len(a))
    return pd.Series(out)
