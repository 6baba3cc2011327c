"""Text functions: normalisation, tokens, stems, hash folds, fielded documents and n-grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem

# Lengths of parts of documents, in characters after normalisation.
PARAMS_CHARS = 1200
DESCRIPTION_CHARS = 900
DENSE_PARAMS_CHARS = 200
DENSE_DESCRIPTION_CHARS = 300

#: What is not a word character after lower-casing; ı and ᲀ to ᲆ stay, for they fold to word characters without regard to case.
#: Given as the ranges themselves: Java's matcher takes ten times as long for a negated class with letters beyond ASCII.
_NOT_WORD = r"[\x00-/:-`{-İĲ-Яѐ-᱿ᲇ-\x{10ffff}]+"



def _steady() -> list[int]:
    """The characters that NFKC leaves alone wherever they stand: Latin, Greek and Cyrillic letters and usual punctuation, without marks."""
    plain = [c for r in (range(0x250), range(0x370, 0x530), range(0x2010, 0x2070), range(0x20A0, 0x20C0)) for c in r]
    return [c for c in plain if unicodedata.category(chr(c)) != "Cn" and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFKC", chr(c)) == chr(c)]


def _beside(plain: list[int]) -> str:
    """The ranges of all characters but these, which are in order."""
    between = zip([-1, *plain], [*plain, 0x110000], strict=True)
    return "".join(f"\\x{{{a + 1:x}}}-\\x{{{b - 1:x}}}" for a, b in between if b > a + 1)


#: A character that NFKC may change, by itself or beside others.
_CHANGEABLE = f"[{_beside(_steady())}]"
#: The same behind a look at what most letters are: Java's matcher asks a class's ranges one by one, for each character that is in none of them.
_CHANGED = r"(?![\x00-\x{9f}\x{bf}-\x{131}\x{3fa}-\x{482}])" + _CHANGEABLE


#: A character that NFKC may change, or whose lower case is several characters or goes by its neighbours (İ, Σ).
_ODD = f"[{_beside([c for c in _steady() if len(chr(c).lower()) == 1 and chr(c) != 'Σ'])}]"
#: As _NOT_WORD, but a single space is left as it is.
_NOT_WORD_NOR_SPACE = "[^0-9a-zıа-яᲀ-ᲆ]{2,}|[^0-9a-zıа-яᲀ-ᲆ ]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def folded(c: Column) -> Column:
    """NFKC. Only texts with a character that it may change reach Python; the others are sent as null."""
    beyond = (F.octet_length(c) != F.char_length(c)) & c.rlike(_CHANGED)
    return F.coalesce(_nfkc(F.when(beyond, c)), c)


def normalize_text(c: Column, unicode: bool = True) -> Column:
    """null → "", NFKC, lower case, ё → е, each run of other characters one space, trimmed.

    unicode=False skips NFKC, for texts known to be in that form.
    """
    t = text_or_empty(c)
    t = folded(t) if unicode else t
    return F.btrim(F.regexp_replace(F.replace(F.lower(t), F.lit("ё"), F.lit("е")), _NOT_WORD, " "))


def normalized_plain(texts: pa.Array) -> pa.Array:
    """normalize_text of whole texts in an Arrow batch; null for those with a character of _ODD, which are left to it."""
    texts = pc.fill_null(texts, "")
    low = pc.replace_substring(pc.utf8_lower(texts), "ё", "е")
    spaced = pc.ascii_trim(pc.replace_substring_regex(low, _NOT_WORD_NOR_SPACE, " "), " ")
    return pc.if_else(pc.match_substring_regex(texts, _ODD), pa.scalar(None, spaced.type), spaced)


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.array_remove(F.split(normalized, " "), "")


def stems(tokens_: Column) -> Column:
    """Stems; arrays without Cyrillic letters stay in the JVM."""
    cyrillic = F.exists(tokens_, lambda t: t.rlike("[а-я]"))
    return F.coalesce(_stemmed(F.when(cyrillic, tokens_)), tokens_)


def stable_fold(normalized: Column, modulus: int) -> Column:
    """The first 8 bytes of SHA-256, big-endian, modulo."""
    return (F.conv(F.substring(F.sha2(normalized, 256), 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("int")


def stable_rank(seed: str, *parts: Column) -> Column:
    """Hexadecimal SHA-256 of the seed and the parts; a null part reads None."""
    read = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.sha2(F.concat(F.lit(f"{seed}\x1e"), F.concat_ws("\x1f", *read)), 256)


def repeated(c: Column, times: int) -> list[Column]:
    return [c] * times


def item_word_document(title: Column, params: Column, description: Column) -> Column:
    """Of normalised fields: the title three times, the parameters twice, the description once, the latter two cut."""
    parts = repeated(title, 3) + repeated(F.substring(params, 1, PARAMS_CHARS), 2) + [F.substring(description, 1, DESCRIPTION_CHARS)]
    return F.concat_ws(" ", *parts)


def item_filter_document(params: Column) -> Column:
    return F.substring(params, 1, PARAMS_CHARS)


def word_grams(tokens_: Column) -> Column:
    """Words and pairs of neighbouring words."""
    n = F.size(tokens_)
    pairs = F.when(n > 1, F.zip_with(F.slice(tokens_, F.lit(1), n - 1), F.slice(tokens_, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(tokens_, F.coalesce(pairs, F.array().cast("array<string>")))


def char_grams(tokens_: Column, least: int = 3, most: int = 5) -> Column:
    """n-grams inside each word with a space on both sides, up to the word's own length."""

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(w)
        return F.flatten(F.transform(F.sequence(F.lit(least), F.least(F.lit(most), size)), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda p: F.substring(w, p, n))))

    return F.flatten(F.transform(tokens_, of))


def clean_spaces(c: Column) -> Column:
    """Each run of Unicode white space one space, trimmed; null is empty."""
    return F.btrim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


def dense_query_text(query: Column, params: Column) -> Column:
    q, p = F.lower(clean_spaces(query)), clean_spaces(params)
    return F.when(p == "", q).otherwise(F.concat(q, F.lit(" | "), p))


def dense_item_text(title: Column, params: Column, description: Column) -> Column:
    return F.concat(clean_spaces(title), F.lit(" | "), F.substring(clean_spaces(params), 1, DENSE_PARAMS_CHARS), F.lit(" | "), F.substring(clean_spaces(description), 1, DENSE_DESCRIPTION_CHARS))


def log_tokens(normalized: Column) -> Column:
    return F.log1p(F.size(tokens(normalized)).cast("double"))


def log_chars(normalized: Column) -> Column:
    return F.log1p(F.length(normalized).cast("double"))
