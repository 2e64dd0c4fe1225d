"""Text functions as Column expressions (JVM side, no Python workers).

All give null for null input unless said otherwise. White space means blank,
tab, line feed, carriage return and form feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f]+"
#: Fixed value: ASCII punctuation as a character class.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """The runs of characters between white space; no empty strings."""
    return F.filter(F.split(_c(x), SPACE), lambda w: w != "")


def lower_words(x: Column | str) -> Column:
    return words(F.lower(_c(x)))


def blank_parts(x: Column | str) -> Column:
    """The parts between single blanks, empty ones kept."""
    return F.split(_c(x), " ", -1)


def strip(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(x), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def plain_letters(x: Column | str) -> Column:
    """Digits dropped, line feeds to blanks, then all but letters, marks, digits, underscores and white space dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(x), r"[0-9]", ""), r"\n", " "), r"[^\p{L}\p{M}\p{N}_ \t\n\r\f]", "")


def clean_review(x: Column | str) -> Column:
    """Lower case, line-break tags to blanks, ASCII punctuation dropped."""
    return F.regexp_replace(F.replace(F.lower(_c(x)), F.lit("<br />"), F.lit(" ")), PUNCTUATION, "")


def without(x: Column | str, marker: str) -> Column:
    return F.replace(_c(x), F.lit(marker), F.lit(""))


def normal_answer(x: Column | str) -> Column:
    """For exact match of answers: lower case, no ASCII punctuation, no English articles, single blanks."""
    bare = F.regexp_replace(F.lower(_c(x)), PUNCTUATION, "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin("a", "an", "the")), " ")


def clean_label(x: Column | str, default: str = "Unlabelled") -> Column:
    """The first line with runs of other than word characters as one blank; the default where nothing is left."""
    first = F.split_part(_c(x), F.lit("\n"), F.lit(1))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(first, r"[^A-Za-z0-9_]+", " ")), F.lit("")), F.lit(default))


def between(x: Column | str, start: str, end: str) -> Column:
    """What stands between two markers; empty if the first is missing."""
    return F.split_part(F.split_part(_c(x), F.lit(start), F.lit(2)), F.lit(end), F.lit(1))


def sentences(x: Column | str) -> Column:
    """Parts between '. ', each ending in a full stop."""
    parts = F.filter(F.split(_c(x), r"\. "), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))


def to_width(x: Column | str, n: int) -> Column:
    """Padded with blanks on the right; longer texts stay."""
    c = _c(x)
    return F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)


def to_words(x: Column | str, n: int, pad: str = "<pad>") -> Column:
    """The first n parts between single blanks, joined by blanks; a text of fewer gets as many padding words right behind it, without blanks."""
    c, w = _c(x), blank_parts(x)
    return F.when(F.size(w) >= n, F.array_join(F.slice(w, 1, n), " ")).otherwise(F.concat(c, F.repeat(F.lit(pad), F.lit(n) - F.size(w))))


def basic_tokens(x: Column | str) -> Column:
    """In lower case, split at white space after . , ( ) ! ? and ' are set apart; double quotes, semicolons, colons and line-break tags are dropped."""
    c = F.replace(F.replace(F.lower(_c(x)), F.lit("<br />"), F.lit(" ")), F.lit('"'), F.lit(""))
    return words(F.regexp_replace(F.regexp_replace(c, "[;:]", " "), r"([.,()!?'])", r" $1 "))


def prompt(template: str, *parts: Column | str) -> Column:
    """A template with {} for each part; null parts are empty."""
    pieces = template.split("{}")
    out = [F.lit(pieces[0])]
    for part, piece in zip(parts, pieces[1:], strict=True):
        out += [F.coalesce(_c(part), F.lit("")), F.lit(piece)]
    return F.concat(*out)


def chat(turns: Column, generation: bool = True) -> Column:
    """One string of an array of struct<role,content>; with an open assistant turn at the end if asked for."""
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.coalesce(t["content"], F.lit("")), F.lit("</s>\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n" if generation else ""))


def html_text(x: Column | str) -> Column:
    """Text of HTML: scripts, styles and tags dropped, five entities restored, white space squeezed."""
    c = F.regexp_replace(_c(x), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(c, SPACE, " "))


def elapsed(seconds: Column | str) -> Column:
    """'%dm %ds'"""
    s = _c(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.floor(s % 60).cast("string"), F.lit("s"))


def literal_list(x: Column | str) -> Column:
    """A list of strings written as a Python literal, without evaluating it."""
    return F.from_json(F.replace(_c(x), F.lit("'"), F.lit('"')), "array<string>")


def pair_key(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("|", F.least(_c(a), _c(b)).cast("string"), F.greatest(_c(a), _c(b)).cast("string"))


def bucket(key: Column | str, buckets: int, seed: int = 0) -> Column:
    """A stable pseudo-random bucket of a key; the same in any engine that has md5."""
    digest = F.md5(F.concat(_c(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
