"""Text columns: tokens, pairs, tags, formatted lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace import schemas

# Two tokens (a full stop or a word) parted by one blank. A pair never spans a
# line break, so the class leaves \n and \r out and whole texts can be matched.
# Words are taken whole and from their start, which spares all backtracking.
PAIR_PATTERN = r"(?:\.|(?<!\w)\w++)[ \t\x0B\f](?:\.|\w++)"


def word_pairs(text: Column) -> Column:
    """Array of non-overlapping pairs of the lower-cased text, as "word next_word"."""
    hits = F.regexp_extract_all(F.lower(text), F.lit(PAIR_PATTERN), F.lit(0))
    return F.transform(hits, lambda hit: F.translate(hit, "\t\x0B\f", "   "))


def words(text: Column) -> Column:
    """Tokens between non-word characters.

    An empty first token stays, empty trailing ones go; a text of non-word
    characters only has no tokens, the empty text has one empty token.
    """
    cut = F.regexp_replace(text, r"\W+$", "")
    return F.when((cut == "") & (text != ""), F.array().cast("array<string>")).otherwise(
        F.split(cut, r"\W+")
    )


def topic_hits(text: Column, markers: dict[str, list[str]]) -> Column:
    """Array with one topic per marker contained in the text, ignoring case.

    The markers are a fixed list and become literals: no join is needed.
    """
    lowered = F.lower(text)
    hits = [
        F.when(lowered.contains(marker.lower()), F.lit(topic))
        for topic, topic_markers in markers.items()
        for marker in topic_markers
    ]
    return F.array_compact(F.array(*hits))


def capitalise_first(word: Column) -> Column:
    """Upper-case the first letter and leave the rest alone."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2 ** 31 - 1))


def key_value_line(key: Column, value: Column) -> Column:
    return F.concat_ws("==", key, value)


def starts_with_ignoring_case(text: Column, prefix: str) -> Column:
    return F.startswith(F.lower(text), F.lit(prefix.lower()))


def left_aligned(value: Column, width: int) -> Column:
    """Pad on the right to ``width``; a longer value is kept whole."""
    text = F.coalesce(value.cast("string"), F.lit("null"))
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def unquoted(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit('"'), F.lit("")))


def tumour_type(diagnosis: Column) -> Column:
    """Decode a diagnosis letter in either case; anything else is NULL."""
    decoded = F.lit(None).cast("string")
    for letter, name in schemas.TUMOUR_TYPES.items():
        decoded = F.when(F.upper(diagnosis) == letter, F.lit(name)).otherwise(decoded)
    return decoded


def padded_codes(codes: Column, length: int = schemas.REVIEW_LENGTH) -> Column:
    """Start code, then the codes, cut or zero-padded to ``length`` floats."""
    full = F.concat(
        F.array(F.lit(schemas.START_CODE)), codes,
        F.array_repeat(F.lit(schemas.PAD_CODE), length - 1),
    )
    return F.slice(full, 1, length).cast("array<float>")
