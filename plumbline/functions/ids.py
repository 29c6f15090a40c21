"""Column functions on point identifiers and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an id that ends in letters after a digit.
_SUFFIXED = r"^(.*\d)([A-Za-z]+)$"


def base_control_id(point_id: Column) -> Column:
    """The id without the letters that follow its last digit; ids without such letters stay as they are."""
    base = F.regexp_extract(F.trim(point_id), _SUFFIXED, 1)
    return F.when(base != "", base).otherwise(F.trim(point_id))


def shot_suffix(point_id: Column, base: Column) -> Column:
    """Upper-case letters after the base id (compared without case), else after the last digit; empty if none."""
    text = F.trim(point_id)
    after = F.substring(text, F.length(base) + 1, F.length(text))
    letters = F.regexp_extract(text, _SUFFIXED, 2)
    follows = F.lower(text).startswith(F.lower(base)) & after.rlike("^[A-Za-z]+$")
    return F.upper(F.when(follows, after).otherwise(letters))


def normal_point_id(value: Column) -> Column:
    """``1000.0`` and ``1000.00`` become ``1000``; everything else is only trimmed."""
    return F.regexp_replace(F.trim(value), r"^([+-]?\d+)\.0+$", "$1")


def header_key(value: Column) -> Column:
    """A header without case, and with every run of other characters as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def code_parts(code: Column) -> Column:
    """Struct of a field code's base, string id and commands: the dash-separated parts of its first word; commands are BS, ES, PC, PT."""
    word = F.split(F.trim(F.upper(F.coalesce(code, F.lit("")))), r"\s+")[0]
    parts = F.split(word, "-")
    commands = F.array(*map(F.lit, ("BS", "ES", "PC", "PT")))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(
        F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("base"),
        F.array_join(F.filter(rest, lambda w: ~F.array_contains(commands, w)), "-").alias("string_id"),
        F.array_sort(F.array_intersect(rest, commands)).alias("commands"),
    )


#: How a field note names a destination.
_DESTINATION = r"(?i)(?:\bto\b|\bpoint\b|\bpt\b|#)\s*[:=#-]?\s*([A-Za-z0-9][A-Za-z0-9_.-]*)"
_PLAIN = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def destination_ref(raw: Column) -> Column:
    """The point that a handwritten note such as ``to 3394`` names, or a note that is one plain word itself; null if none."""
    text = F.trim(raw)
    found = F.regexp_extract(text, _DESTINATION, 1)
    return F.when(found != "", found).when(text.rlike(_PLAIN), text)


def header_variants(value: Column) -> dict[str, Column]:
    """A header as the four readers compare it: validation, staging, inspector, survey."""
    text = F.coalesce(value, F.lit(""))
    low = F.lower(F.trim(text))
    return {
        "validation": F.lower(F.regexp_replace(F.regexp_replace(text, "^\ufeff+", ""), r"[\s_-]+", "")),
        "staging": F.regexp_replace(F.translate(low, "- ", "__"), r"[^\p{L}\p{N}_]", ""),
        "inspector": F.regexp_replace(low, "[^a-z0-9]+", ""),
        "survey": F.regexp_replace(F.translate(low, " ", "_"), "[^a-z0-9_]", ""),
    }


def series_label(point_number: Column) -> Column:
    """The thousand that a numeric id falls in, such as ``4000-series``."""
    return F.concat((F.floor(point_number / 1000) * 1000).cast("long").cast("string"), F.lit("-series"))


def safe_name(value: Column) -> Column:
    """A name for files: runs of other characters become one underscore."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned != "", cleaned).otherwise(F.lit("unnamed"))


def letters_to_number(letters: Column) -> Column:
    """Bijective base 26: A is 1, Z 26, AA 27; empty is 0."""
    digits = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 26 + d)


def number_to_letters(number: Column) -> Column:
    """Inverse of ``letters_to_number`` for 1 to 475254 (four letters)."""
    digit = lambda n: F.char(65 + F.pmod(n - 1, F.lit(26)))
    up = lambda n: F.floor((n - 1) / 26).cast("long")
    one = number.cast("long")
    two, three, four = up(one), up(up(one)), up(up(up(one)))
    part = lambda n: F.when(n > 0, digit(n)).otherwise(F.lit(""))
    return F.concat(part(four), part(three), part(two), part(one))


def next_reshoot_labels(base: Column, suffixes: Column, count: int) -> Column:
    """The next ``count`` labels after the highest letter suffix in the array ``suffixes``."""
    top = F.coalesce(F.array_max(F.transform(suffixes, letters_to_number)), F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: F.concat(base, number_to_letters(top + k)))


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet won't read as a formula."""
    return F.when(text.rlike(r"^[\s]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


#: Words of a description that suggest a role, tried in this order.
ROLE_WORDS = (
    ("discontinuity", "wall|barrier|headwall|wingwall|inlet|manhole|catch basin|drop box|curb"),
    ("ditch", "ditch"),
    ("creek", "creek|stream|channel"),
    ("setup", "backsight|setup|control point"),
    ("surface", "ground shot|pavement|shoulder|stripe|centerline|surface edge|breakline|gutter"),
    ("support", "pole|sign|meter|junction|splice"),
)


def suggested_role(description: Column) -> Column:
    """The first role whose words a description has; ``unknown`` for none and for null."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(words), role) for role, words in ROLE_WORDS], F.lit("unknown"))


#: Words of a file name that tell its role, and that a page number follows.
ROLE_TOKENS = (
    "survey", "surveys", "points", "point", "pts", "raw", "data", "coords", "coordinates", "fieldbook", "fieldbooks", "field", "book", "books", "fb", "notes", "note", "scan", "scans", "photo", "photos", "image", "images", "img",
    "export", "input",
)
PAGE_TOKENS = ("page", "pg", "p")


def job_key(filename: Column) -> Column:
    """Words and numbers of a file name without those that tell a role or a page: what files of one job share.

    A number of up to four digits goes if the word before it (role words
    aside) is a page word.
    """
    stem = F.regexp_replace(F.regexp_replace(F.lower(filename), r"^.*[/\\\\]", ""), r"(?<=.)\.[^.]*$", "")
    words = F.filter(F.regexp_extract_all(stem, F.lit(r"([a-z]+|[0-9]+)"), F.lit(1)), lambda w: ~w.isin(*ROLE_TOKENS))
    page = lambda w: w.isin(*PAGE_TOKENS)
    before = lambda i: F.coalesce(F.get(words, i - 1), F.lit(""))
    keep = F.filter(words, lambda w, i: ~page(w) & ~(w.rlike("^[0-9]{1,4}$") & page(before(i))))
    return F.array_join(keep, " ")
