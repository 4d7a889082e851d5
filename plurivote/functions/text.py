"""Text and name expressions, all built-in functions (no Python per row)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that mean the same in Java and RE2, for letters of any language.
WHITE_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
NOT_SPACE = r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
BRACKETED = r"\[[^\n]*?\]"
WEB_ADDRESS = rf"https?://{NOT_SPACE}|www\.{NOT_SPACE}"
TAG = r"<[^\n]*?>+"
PUNCTUATION_OR_BREAK = r"[!-/:-@\[-`{-~\n]"
# Starts only at the first letter of a word and never steps back, so a text takes linear time.
WORD_WITH_DIGIT = r"(?<![\p{L}\p{N}_])[\p{L}\p{Nl}\p{No}_]*+\p{Nd}[\p{L}\p{N}_]*+"


# Common English stop words, the default list.
ENGLISH_STOPWORDS = tuple(
    """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
    she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am
    is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too
    very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
    doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
    shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
)


def words(text: Column) -> Column:
    """Words between white space; no empty entries. Null stays null."""
    return F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower case, then drop bracketed parts, web addresses, tags, punctuation,
    line breaks and words that hold a digit — in this order."""
    cleaned = F.lower(text)
    for pattern in (BRACKETED, WEB_ADDRESS, TAG, PUNCTUATION_OR_BREAK, WORD_WITH_DIGIT):
        cleaned = F.regexp_replace(cleaned, pattern, "")
    return cleaned


def remove_stopwords(word_list: Column, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    """Drop the listed words, by default the English stop words."""
    if not stopwords:
        return word_list
    return F.filter(word_list, lambda w: ~w.isin(*stopwords))


def model_family(model_name: Column) -> Column:
    """Run name without its run number (``abc_01`` → ``abc``)."""
    return F.regexp_replace(model_name, r"_[0-9]+$", "")


def display_name(family: Column, prefixes: Sequence[str] = (), renames: Mapping[str, str] | None = None) -> Column:
    """Family name without the given literal prefixes, then renamed where listed."""
    name = family
    for prefix in prefixes:
        name = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    for old, new in (renames or {}).items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    return name


def path_part(path: Column, position: int) -> Column:
    """Part of a slash path, counted from 0; null when the path is shorter."""
    return F.get(F.split(path, "/"), position)


def epoch_tag(epoch_no: Column, accuracy: Column, f1: Column) -> Column:
    """``E02_A0.77_F0.4``: two-digit epoch, scores to two places without padding."""
    from plurivote.functions.scores import round_decimal

    return F.concat(
        F.lit("E"),
        F.when(epoch_no < 100, F.lpad(epoch_no.cast("string"), 2, "0")).otherwise(epoch_no.cast("string")),
        F.lit("_A"),
        round_decimal(accuracy).cast("string"),
        F.lit("_F"),
        round_decimal(f1).cast("string"),
    )


EPOCH_TAG = r"^E([0-9]+)_A([0-9.]+)_F([0-9.]+)$"


def parse_epoch_tag(tag: Column) -> Column:
    """Struct ``(epoch_no, accuracy, f1)``; all null when the text is no tag."""

    def part(i: int, kind: str) -> Column:
        return F.when(tag.rlike(EPOCH_TAG), F.regexp_extract(tag, EPOCH_TAG, i).cast(kind))

    return F.struct(
        part(1, "int").alias("epoch_no"), part(2, "double").alias("accuracy"), part(3, "double").alias("f1")
    )


def list_from_text(text: Column, item_type: str = "int") -> Column:
    """Read ``[1, 0]`` as an array. Text items stand in single or double quotes."""
    if item_type == "string":
        return quoted_items(text)
    return F.from_json(text, f"array<{item_type}>")


# One quoted item: a mark, then characters or escaped characters, then the same mark.
QUOTED_ITEM = r"""'((?:[^'\\]|\\.)*+)'|"((?:[^"\\]|\\.)*+)\""""


def quoted_items(text: Column) -> Column:
    """The quoted items of a list or tuple text; an escaped mark or backslash is one character of the item."""
    single, double = (F.regexp_extract_all(text, F.lit(QUOTED_ITEM), F.lit(i)) for i in (1, 2))
    items = F.zip_with(single, double, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.transform(items, lambda item: F.regexp_replace(item, r"\\(.)", "$1"))


def tuple_from_text(text: Column) -> Column:
    """Read ``('a', 'b')`` (also ``('a',)``) as an array of strings."""
    return quoted_items(text)
