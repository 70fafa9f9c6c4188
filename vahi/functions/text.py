"""Text normalisers: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a party's name loses (legal forms and trade words).
DROPPED_WORDS = (
    "private", "pvt", "limited", "ltd", "llp", "inc", "incorporated", "corporation", "corp", "co", "company",
    "enterprises", "enterprise", "industries", "traders", "trading", "and", "the",
)
# State codes of the tax registration, with the official names.
STATES = {
    "01": "Jammu & Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana",
    "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland",
    "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand",
    "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "26": "Dadra and Nagar Haveli and Daman and Diu",
    "27": "Maharashtra", "29": "Karnataka", "30": "Goa", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry",
    "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh", "97": "Other Territory",
}
# Words dropped from a bank narration before it becomes a key.
NARRATION_WORDS = ("upi", "neft", "imps", "rtgs", "ref", "txn")


# The characters that count as white space at the ends of a text.
SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(v: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(v, F.lit(SPACE))


def blank_to_null(v: Column) -> Column:
    """Trimmed text; nothing left is null."""
    return F.nullif(trimmed(v.cast("string")), F.lit(""))


def norm_gstin(v: Column) -> Column:
    """Upper case, letters and digits only; nothing left is null."""
    return F.nullif(F.regexp_replace(F.upper(v), "[^A-Z0-9]", ""), F.lit(""))


def norm_name(v: Column) -> Column:
    """A party's name without punctuation, legal forms and trade words."""
    plain = F.regexp_replace(F.lower(v), r"""[.,&'"/\\()\-]""", " ")
    plain = F.regexp_replace(plain, r"\b(" + "|".join(DROPPED_WORDS) + r")\b", " ")
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def norm_keyword(v: Column) -> Column:
    """C4: lower case, single spaces, never null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(v), r"\s+", " ")), F.lit(""))


def squeeze_upper(v: Column) -> Column:
    """Upper case without white space; null is empty."""
    return F.coalesce(F.regexp_replace(F.upper(v), r"\s+", ""), F.lit(""))


def narration_key(v: Column) -> Column:
    """A narration without long numbers and channel words, as a name; null is empty."""
    plain = F.regexp_replace(F.coalesce(v, F.lit("")), r"\b\d{6,}\b", " ")
    plain = F.regexp_replace(plain, r"(?i)\b(" + "|".join(NARRATION_WORDS) + r")\b", " ")
    return F.coalesce(norm_name(plain), F.lit(""))


def _bigrams(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.substring(v, i, F.lit(2)))


def dice(a: Column, b: Column) -> Column:
    """Sørensen-Dice similarity of the bigram multisets; 1 for equal, 0 if either is empty or, when they differ, shorter than 2."""
    x, y = _bigrams(a), _bigrams(b)

    def times(of: Column, g: Column) -> Column:
        return F.size(F.filter(of, lambda h: h == g))

    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, g: acc + F.least(times(x, g), times(y, g)))
    none = F.coalesce(a, F.lit("")) == ""
    return (
        F.when(none | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when((F.length(a) < 2) | (F.length(b) < 2), F.lit(0.0))
        .otherwise(F.lit(2.0) * shared / (F.length(a) + F.length(b) - 2))
    )


def dice_bound(a: Column, b: Column) -> Column:
    """The largest similarity that two texts of these lengths can have; cheap, and lossless as a filter."""
    x, y = F.length(a) - 1, F.length(b) - 1
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(2.0) * F.least(x, y) / (x + y))


def state_code(gstin: Column) -> Column:
    """The first two characters."""
    return F.substring(gstin, 1, 2)


def pan_of(gstin: Column) -> Column:
    """The embedded account number of a 15-character registration."""
    return F.when(F.length(gstin) == 15, F.substring(gstin, 3, 10))


def _states() -> Column:
    return F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])


def state_name(code: Column) -> Column:
    """C10."""
    return F.try_element_at(_states(), code)


def gstin_valid(g: Column) -> Column:
    """Format and a known state; there is no checksum."""
    return F.coalesce(g.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$") & state_code(g).isin(*STATES), F.lit(False))


def xml_escape(v: Column) -> Column:
    """C11: & < > and the double quote, in that order."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(sign), F.lit(name))
    return v


def tokens(v: Column) -> Column:
    """C14: the words between single spaces."""
    return F.filter(F.split(v, " "), lambda x: x != "")


def token_subset(a: Column, b: Column) -> Column:
    """C14: the shorter's words are all among the longer's, and both start with the same word."""
    x, y = tokens(a), tokens(b)
    inside = F.when(F.size(x) <= F.size(y), F.forall(x, lambda t: F.array_contains(y, t))).otherwise(F.forall(y, lambda t: F.array_contains(x, t)))
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (F.try_element_at(x, F.lit(1)) == F.try_element_at(y, F.lit(1))) & inside, F.lit(False))


def norm_pattern(rule_type: Column, pattern: Column) -> Column:
    """A rule's pattern as its type compares it."""
    return (
        F.when(rule_type == "GSTIN_EQUALS", norm_gstin(pattern)).when(rule_type == "VENDOR_NAME_EQUALS", norm_name(pattern))
        .when(rule_type == "VENDOR_NAME_CONTAINS", norm_keyword(pattern)).otherwise(F.regexp_replace(pattern, r"\s+", ""))
    )


def txn_description(v: Column) -> Column:
    """At most 500 characters, `Transaction` if there are none."""
    return F.substring(F.coalesce(F.nullif(v, F.lit("")), F.lit("Transaction")), 1, 500)


def export_file_name(prefix: str, client: str, day: str, ending: str) -> str:
    """Spaces as underscores, the day as ISO."""
    return f"{prefix}_{'_'.join(client.split())}_{day}.{ending}"
