"""Column expressions over report messages, variable patterns and paths. All of them stay in the JVM.

Java's ``d`` flag makes ``.`` stop at ``\\n`` alone, and ``U`` makes classes and word bounds those of Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line formats of reports.
SEPARATOR = r"^\s*[*=\-]+\s*$"
SEVERITY = r"^\s*(error|warning|info)\s+\d+\s+\d+\s*$"
RULE = r"^\s{0,6}([A-Z]{2,4}_\d{3,4})\s+\d+(?:\s+\d+(?:\s+\S.*)?)?\s*$"
INSTANCE = r"^\s*(\d+)\s+of\s+(\d+)\s+(\d+)\s+(.*\S)"
VARIABLE = "'(.*?)'"
NUMBER = r"\b\d+\b"
#: Words that say nothing about a path.
GENERIC_TOKENS = ("AF", "ALIVE", "BLK", "CORE", "CPU", "DOWN", "INST", "ISO", "ISP", "MEM", "NORMAL", "RAM", "REG", "ROM", "RTL", "SECU", "SECURE", "SENSOR", "SHUT", "TOP", "U")
NO_VARIABLE = "NO_VAR"
MERGE_SEGMENT, MERGE_SLOT = 4, 6

U, DU = "(?U)", "(?dU)"


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, U + r"^\s+|\s+$", "")


def kind(line: Column) -> Column:
    """``skip``, ``severity``, ``rule``, ``instance`` or ``noise``; the first that fits."""
    return (
        F.when((strip(line) == "") | line.rlike(U + SEPARATOR), "skip")
        .when(line.rlike("(?iU)" + SEVERITY), "severity")
        .when(line.rlike(DU + RULE), "rule")
        .when(line.rlike(DU + INSTANCE), "instance")
        .otherwise("noise")
    )


def severity(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, "(?iU)" + SEVERITY, 1))


def rule(line: Column) -> Column:
    return F.regexp_extract(line, DU + RULE, 1)


def message(line: Column) -> Column:
    return F.regexp_extract(line, DU + INSTANCE, 4)


def variables(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?d)" + VARIABLE), F.lit(1))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_VARIABLE))).otherwise(found)


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, U + NUMBER, "<NUM>")


def template(text: Column) -> Column:
    return strip(mask_numbers(F.regexp_replace(text, "(?d)" + VARIABLE, "'<VAR>'")))


def signature(found: Column) -> Column:
    """Variables with runs of digits masked, joined; what has no variable is one signature."""
    joined = F.array_join(F.transform(found, lambda v: F.regexp_replace(v, U + r"\d+", "*")), " / ")
    none = F.coalesce(F.size(found), F.lit(0)) <= 0
    return F.when(none, NO_VARIABLE).otherwise(joined)


def unknown_rule(text: Column) -> Column:
    return F.concat(F.lit("UNKNOWN_"), F.upper(F.substring(F.md5(text), 1, 6)))


def slots(pattern: Column) -> Column:
    return F.split(strip(pattern), U + r"\s+/\s+")


def select_levels(path: Column, levels: list[int] | None) -> Column:
    """The parts of a path at ``levels`` (negative ones from the end), joined by spaces; None takes all."""
    parts = F.transform(F.split(path, "/"), strip)
    if levels is None:
        return F.array_join(parts, " ")
    if not levels:
        return F.lit("")
    at = [F.try_element_at(parts, F.lit(x + 1 if x >= 0 else x)) for x in levels]
    return F.array_join(F.filter(F.array(*at), lambda x: x.isNotNull()), " ")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "^['\" ]+|['\" ]+$", "")


def primary_path(pattern: Column) -> Column:
    return unquoted(F.get(slots(pattern), F.lit(0)))


def segment_tokens(path: Column) -> Column:
    """For each segment of a path its telling tokens; segments without any are left out."""

    def tokens(segment: Column) -> Column:
        cut = F.substring_index(F.upper(strip(segment)), "__MBIT_", 1)
        masked = F.regexp_replace(F.regexp_replace(cut, U + r"\d+", "*"), "[^A-Z0-9*]+", "_")
        bare = F.transform(F.split(masked, "_"), lambda t: F.regexp_replace(t, r"^\*+|\*+$", ""))
        return F.filter(bare, lambda t: (F.length(t) > 1) & ~t.isin(*GENERIC_TOKENS))

    return F.filter(F.transform(F.split(path, "/"), tokens), lambda s: F.size(s) > 0)


def path_document(path: Column) -> Column:
    return F.array_join(F.transform(segment_tokens(path), lambda s: F.array_join(s, " ")), " / ")


def path_parts(path: Column) -> Column:
    """Segments without quotes around the path; blank ones are left out."""
    return F.filter(F.transform(F.split(unquoted(path), "/"), strip), lambda s: s != "")


def bare_token_set(text: Column) -> Column:
    """Words as a set, with quotes around them dropped."""
    words = F.transform(F.split(text, U + r"\s+"), lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def token_set(text: Column) -> Column:
    """Words as a set, with quotes kept."""
    return F.array_distinct(F.filter(F.split(text, U + r"\s+"), lambda w: w != ""))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Of two sets as arrays: 0 if both are empty, 1 if one is."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - both / union)


def jaccard_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; a vector without length has distance 1 to others."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = lambda x: F.sqrt(dot(x, x))
    unit = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (unit(length(a)) * unit(length(b)))))


def negative_level(level: Column, depth: Column) -> Column:
    return level - depth


def short_id(group_id: Column) -> Column:
    return F.when(F.length(group_id) > 28, F.concat(F.lit(".."), F.element_at(F.split(group_id, "::"), -1))).otherwise(group_id)


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in columns))


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default))
