"""Text clean-up, identifiers and predicates as column expressions."""
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab import constants as K


def _squeeze_once(c: Column) -> Column:
    """One pass of 'two spaces become one' (longer runs stay longer)."""
    return F.replace(c, F.lit("  "), F.lit(" "))


def plain_words(c: Column) -> Column:
    """Runs of anything but word characters and spaces become one space; lowercase."""
    spaced = F.regexp_replace(c, f"[^{K.SPACE_CHARS}{K.WORD_CHARS}]+", " ")
    return F.lower(_squeeze_once(spaced))


def clean_id(c: Column) -> Column:
    """Join form of an identifier. NULL stays NULL."""
    return plain_words(c)


def normalize_text(c: Column) -> Column:
    """Model form of a text: unusual characters dropped, lowercase, in quotes.

    A missing text becomes the word ``nan``.
    """
    dropped = f"[^{K.WORD_CHARS}{K.SPACE_CHARS}{K.KEPT_PUNCTUATION}]+"
    text = F.regexp_replace(F.coalesce(c, F.lit("nan")), dropped, "")
    return F.concat(F.lit('"'), F.lower(_squeeze_once(text)), F.lit('"'))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def mentions_any(c: Column, keywords: Sequence[str] = K.TIME_TREE_KEYWORDS) -> Column:
    """True if the lowercased text, with '-' as space, contains any keyword."""
    text = F.lower(F.replace(c, F.lit("-"), F.lit(" ")))

    def any_in(t: Column) -> Column:
        return reduce(operator.or_, [F.contains(t, F.lit(word)) for word in keywords])

    # The one-element array binds the prepared text, so it is built once per row
    # and not once per keyword.
    return F.exists(F.array(text), any_in)


def long_enough(c: Column, more_than: int = K.MIN_TEXT_LENGTH) -> Column:
    return F.coalesce(F.length(c) > more_than, F.lit(False))


def downloaded_flag(c: Column, more_than: int = K.MIN_DOWNLOADED_LENGTH) -> Column:
    return long_enough(c, more_than).cast("int")


def centre_trim(c: Column, width: int) -> Column:
    """Middle ``width`` characters of a longer text; an odd surplus is cut right."""
    surplus_left = F.floor((F.length(c) - width) / 2).cast("int")
    return F.when(F.length(c) > width, F.substring(c, surplus_left + 1, F.lit(width))).otherwise(c)


# --- identifiers from file paths -------------------------------------------


def id_from_third_part(path: Column) -> Column:
    """``a/b/NAME.pdf`` -> ``NAME``."""
    return F.replace(F.split_part(path, F.lit("/"), F.lit(3)), F.lit(".pdf"), F.lit(""))


def id_from_subfolder(path: Column, suffix: str = "") -> Column:
    """``a/b/NAME.pdf`` -> cleaned ``b NAME`` plus a suffix."""
    return F.concat(clean_id(F.regexp_extract(path, r"(?s)^[^/]*/(.*?)\.pdf", 1)), F.lit(suffix))


def _versioned_stem(path: Column) -> Column:
    return F.replace(file_name(path), F.lit(".full.pdf"), F.lit(""))


def versioned_id(path: Column, prefix: str = "10.1101/") -> Column:
    """``.../NAMEv2.full.pdf`` -> ``10.1101/NAME``."""
    return F.concat(F.lit(prefix), F.split_part(_versioned_stem(path), F.lit("v"), F.lit(1)))


def version_from_path(path: Column) -> Column:
    """``.../NAMEv2.full.pdf`` -> 2."""
    return F.split_part(_versioned_stem(path), F.lit("v"), F.lit(2)).try_cast("int")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def id_from_text_file(path: Column) -> Column:
    """``.../NAME.txt`` -> ``NAME``."""
    return F.replace(file_name(path), F.lit(".txt"), F.lit(""))


def name_before_version(name: Column) -> Column:
    return F.split_part(name, F.lit("v"), F.lit(1))


def version_of_name(name: Column) -> Column:
    """Number between the first ``v`` and the next dot."""
    tail = F.split_part(name, F.lit("v"), F.lit(2))
    return F.split_part(tail, F.lit("."), F.lit(1)).try_cast("int")
