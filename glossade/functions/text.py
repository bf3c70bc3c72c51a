"""Column expressions over texts: splitting, cleaning, and flags. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as CPython splits on it, for Java's regular expressions.
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The same characters one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = r"[ \n\t\r]+"
# Punctuation (ASCII, then curly double quotes, guillemets, dashes and the ellipsis), quotes, and the patterns of code and tags.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + "“”„«»—–…"
DOUBLE_QUOTES, SINGLE_QUOTES = "“”„‟«»", "‘’‚‛"
CODE = r"(?iU)```|<code>|</code>|def\s+\w+\s*\(|class\s+\w+|function\s+\w+\s*\(|var\s+\w+\s*="
MARKUP = r"</?[a-zA-Z][^>]*>"


def words(text: Column, space: str = UNICODE_SPACE) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(text, space, -1), lambda w: w != "")


def strip_controls(text: Column) -> Column:
    """Without characters of category C, except line feed and tab; nothing takes their place."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def strip_space(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACES))


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNICODE_SPACE, " "))


def plain_quotes(text: Column) -> Column:
    text = F.translate(text, DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))
    return F.replace(text, F.lit("…"), F.lit("..."))


def basic_clean(text: Column) -> Column:
    return plain_quotes(fold_space(strip_controls(text)))


def digit_dominated(text: Column, above: float = 0.5) -> Column:
    """Whether more than this share of the letters and digits are digits; false where there are none."""
    both = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]", ""))
    return F.coalesce(F.try_divide(digits, both) > above, F.lit(False))


def has_markup(text: Column) -> Column:
    """Code or tags."""
    return text.rlike(CODE) | text.rlike(MARKUP)


def repetition(text: Column, space: str = UNICODE_SPACE) -> Column:
    """Struct of n (words), ttr (different words by words) and top (the commonest word's share); 0, 1, 0 without words."""
    w = F.array_sort(words(F.lower(text), space))
    runs = F.aggregate(
        w,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda s, x: F.struct(x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["most"], F.when(x == s["last"], s["run"] + 1).otherwise(1)).alias("most")),
    )
    n = F.size(w)
    return F.struct(n.alias("n"), F.coalesce(F.try_divide(F.size(F.array_distinct(w)), n), F.lit(1.0)).alias("ttr"), F.coalesce(F.try_divide(runs["most"], n), F.lit(0.0)).alias("top"))


def repetitive(r: Column, least: int = 20, top: float = 0.4, ttr: float = 0.3) -> Column:
    return (r["n"] >= least) & (r["top"] > top) & (r["ttr"] < ttr)


def punctuation_share(text: Column) -> Column:
    solid = F.regexp_replace(text, UNICODE_SPACE, "")
    return F.coalesce(F.try_divide(F.length(solid) - F.length(F.translate(solid, PUNCTUATION, "")), F.length(solid)), F.lit(0.0))


def cleaned(text: Column) -> dict[str, Column]:
    """The columns of a cleaned generation: the text, what it was before where that differs, and 0/1 flags.

    A digit-dominated text becomes empty. A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    base = basic_clean(text)
    blank = digit_dominated(base)
    changed = blank | (base != text)
    markup, again, punct = has_markup(text), repetitive(repetition(base)), punctuation_share(base) > 0.4
    flag = lambda c: c.cast("int")
    return {
        "continuation": F.when(blank, "").otherwise(base),
        "before_cleaning": F.when(changed, text).otherwise(""),
        "cleaned": flag(changed),
        "review_markup": flag(markup),
        "review_repetition": flag(again),
        "review_punct_dominated": flag(punct),
        "review_any": flag(markup | again | punct),
    }
