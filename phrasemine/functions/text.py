"""Column functions on phrases and tokens, and the word lists that they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what when where who which why how"
).split()
FUNCTION_WORDS = (
    "about after all also any back because but can come could day do even first get give go good her him his i if into just know like look make me more my"
    " new no not now one only or other our out over people say see she so some take than them then there these think time two up use very want way we well were"
    " what when which who will would year you your"
).split()
TOKEN_STOP_WORDS = sorted({*STOP_WORDS, *FUNCTION_WORDS})
SEGMENT_STOP_WORDS = (
    "a an the at by for from in into of on to with about above across after against along among around before behind below beneath beside between beyond during"
    " inside near outside over through under until up upon within without and but or nor so yet i me my we our you your he him his she her it its they them their"
    " am is are was were be been being do does did have has had this that these those what which who when where why how will can could would should may might must shall"
).split()
QUESTION_WORDS = "how what why when where which who can is are do does".split()
TOKEN_TYPES = ["intent", "action", "object", "attribute", "condition", "other"]


def _ascii(c: Column) -> Column:
    """Whether a text is plain ASCII, the common case, for which patterns need no Unicode classes."""
    return F.octet_length(c) == F.length(c)


def _replace(c: Column, pattern: str, by: str) -> Column:
    return F.when(_ascii(c), F.regexp_replace(c, pattern, by)).otherwise(F.regexp_replace(c, f"(?U){pattern}", by))


def folded(c: Column) -> Column:
    """Lower case, white space folded and trimmed."""
    return F.trim(_replace(F.lower(F.trim(c)), r"\s+", " "))


def valid_phrase(p: Column) -> Column:
    """Of a folded phrase: 1 to 255 long, not all digits and at least half Latin."""
    odd = F.length(_replace(p, r"[a-z0-9\s-]+", ""))
    return F.length(p).between(1, 255) & ~p.rlike(r"^(?U)\d+$") & (odd / F.length(p) <= 0.5)


def clean_phrase(c: Column) -> Column:
    """Lower case, white space folded; null unless 1 to 255 long, not all digits and at least half Latin."""
    p = folded(c)
    return F.when(valid_phrase(p), p)


def clean_seed(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isNull() | (s == "") | (F.length(s) > 100), "unknown").otherwise(s)


def to_long(c: Column, default: int) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float(default))).cast("long")


def clean_token(c: Column) -> Column:
    """Lower case, without punctuation but hyphens, white space folded."""
    return F.trim(_replace(_replace(F.lower(c), r"[^\w\s-]+", ""), r"\s+", " "))


def is_valid_token(c: Column, least: int = 2, most: int = 30) -> Column:
    return F.length(c).between(least, most) & c.rlike(r"\p{L}") & ~c.isin(TOKEN_STOP_WORDS)


def token_candidates(c: Column) -> Column:
    """Words of a phrase in order; a hyphenated word is followed by its parts."""
    words = F.split(clean_token(c), " ")
    parts = F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))))
    return F.when(F.contains(c, F.lit("-")), parts).otherwise(words)


def tokens(c: Column) -> Column:
    """Valid words of a phrase in order."""
    return F.filter(token_candidates(c), lambda w: is_valid_token(w))


def segment_words(c: Column, stop_words: list[str] = SEGMENT_STOP_WORDS) -> Column:
    """Words of a to z, two letters or more, that are no stop words."""
    return F.filter(segment_candidates(c), lambda w: is_segment_word(w, stop_words))


def segment_candidates(c: Column) -> Column:
    return F.split(F.lower(c), r"[\s\-_]+")


def is_segment_word(w: Column, stop_words: list[str] = SEGMENT_STOP_WORDS) -> Column:
    return (F.length(w) >= 2) & w.rlike("^[a-z]+$") & ~w.isin(stop_words)


def ngrams(words: str, low: int, high: int) -> Column:
    """All runs of low to high words of an array column: array of (n, gram, pos)."""
    return F.expr(
        f"flatten(transform(sequence({low}, {high}), n -> if(size({words}) >= n, transform(sequence(0, size({words}) - n), i -> named_struct('n', n, 'gram', array_join(slice({words}, i + 1, n), ' '), 'pos', i)),"
        " cast(array() as array<struct<n:int,gram:string,pos:int>>))))"
    )


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
