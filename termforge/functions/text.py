"""Text functions as column expressions; Python only where the built-ins can't say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop words (a parameter everywhere).
STOP_WORDS = (
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it "
    "its more most no not of on or other our out over she so some such than that the their them then there these they this those to under up "
    "was we were what when where which who will with would you your"
).split()


def normalize_text(text: Column, keep_digits: bool = False, percent_mode: str = "drop") -> Column:
    """Dashes and line ends become spaces, other characters that aren't letters (or digits) go, spaces collapse."""
    if percent_mode not in ("drop", "word"):
        raise ValueError(f"Unsupported percent_mode: {percent_mode}")
    out = F.regexp_replace(text, "[-‐‑‒–—―]+", " ")
    if percent_mode == "word":
        out = F.replace(out, F.lit("%"), F.lit(" percent "))
    out = F.regexp_replace(out, "[\r\n]+", " ")
    out = F.regexp_replace(out, r"(?U)[^a-zA-Z0-9\s]" if keep_digits else r"(?U)[^a-zA-Z\s]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def strip_short_words(text: Column) -> Column:
    """The historic cleaner: letters only, single-letter words dropped."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.regexp_replace(F.regexp_replace(out, r"[^a-zA-Z\s]", ""), r"\b\w{1}\b", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Latin letters with marks and what they become.
_MARKED, _PLAIN = "àâäáãåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def deaccent(text: Column) -> Column:
    return F.translate(text, _MARKED, _PLAIN)


def tokenize(text: Column, min_len: int = 2, max_len: int = 15, deacc: bool = False) -> Column:
    """Lower-cased alphabetic tokens within the length bounds, in order, repeats kept."""
    low = F.lower(text)
    low = deaccent(low) if deacc else low
    found = F.regexp_extract_all(low, F.lit(r"(?U)([^\W\d_]+)"), F.lit(1))
    return F.filter(found, lambda x: (F.length(x) >= min_len) & (F.length(x) <= max_len))


def remove_stop_words(tokens: Column, words: list[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(list(words)))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """Contiguous n-grams of low..high tokens, joined by a space."""
    def of(t: Column, n: int) -> Column:
        if n == 1:
            return t
        last = F.size(t) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    # the outer lambda binds the tokens once; else they'd be computed again for each n-gram
    return F.get(F.transform(F.array(tokens), lambda t: F.concat(*[of(t, n) for n in range(low, high + 1)])), F.lit(0))


def word_count(text: Column) -> Column:
    """len(text.split())"""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def phrase_count(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences, case ignored."""
    return ((F.length(text) - F.length(F.replace(F.lower(text), F.lit(phrase.lower()), F.lit("")))) / len(phrase)).cast("long")


def contains_term(tokens: Column, term: str) -> Column:
    """1 where the term's words stand in the tokens one after another."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.when(padded.contains(f" {term} "), 1).otherwise(0)


def display_name(name: Column) -> Column:
    """x_text_cleaned.txt and the like become x.pdf; other names stay."""
    stem = F.regexp_replace(name, r"\.[tT][xX][tT]$", "")
    bare = F.when(stem.endswith("_text_cleaned"), F.regexp_replace(stem, "_text_cleaned$", "")).when(stem.endswith("_ocr_text_cleaned"), F.regexp_replace(stem, "_ocr_text_cleaned$", "")).otherwise(F.regexp_replace(stem, "_cleaned$", ""))
    return F.when(F.lower(name).endswith(".txt"), F.concat(bare, F.lit(".pdf"))).otherwise(name)


# Stop words and word classes of Japanese text, one run of a class a word.
JAPANESE_STOP_WORDS = "これ それ ため もの こと よう 及び また なお 当社 当該 これら について により による として おり ます です".split()
JAPANESE_NUMBER = "[0-9０-９]+(?:年|月|日)?"
JAPANESE_WORD = r"[一-龯々〆ヵヶ]+|[ァ-ヴー]+|[ぁ-ん]+|[A-Za-z][A-Za-z0-9_]+|[0-9]+(?:\.[0-9]+)?"


def japanese_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Runs of one class, without numbers; no stop words, pure hiragana, digits or single characters."""
    stop = JAPANESE_STOP_WORDS if stop_words is None else stop_words
    low = F.regexp_replace(F.lower(text), JAPANESE_NUMBER, " ")
    found = F.regexp_extract_all(low, F.lit(f"({JAPANESE_WORD})"), F.lit(1))
    return F.filter(found, lambda x: ~x.isin(list(stop) or [""]) & ~F.regexp_like(x, F.lit("^([ぁ-ん]+|[0-9]+)$")) & (F.length(x) >= 2))


# Porter's stemmer (1980), written from the paper's rule tables.
_VOWELS = set("aeiou")
# Suffix rules of steps 2, 3 and 4.
_STEP2 = dict(p.split(">") for p in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split())
_STEP3 = dict(p.split(">") for p in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split())
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in _VOWELS or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted((s for s in rules if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for suffix in sorted((s for s in _STEP4 if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _cvc(stem):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: Column) -> Column:
    """For a column of distinct words: join the result back to the tokens."""
    return F.pandas_udf(_stem_all, "string")(word)


def _stem_all(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")
