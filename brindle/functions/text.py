"""Utterance keys and tokens as Column expressions.

The keys differ on purpose: each is the identity that one part of the engine was built on, so none stands in
for another.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English contractions and what they stand for.
CONTRACTIONS = {
    "won't": "will not", "can't": "cannot", "ain't": "is not", "don't": "do not", "doesn't": "does not", "didn't": "did not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not",
    "hadn't": "had not", "wouldn't": "would not", "couldn't": "could not", "shouldn't": "should not", "mustn't": "must not", "needn't": "need not",
    "what's": "what is", "that's": "that is", "it's": "it is", "there's": "there is", "here's": "here is", "where's": "where is",
    "how's": "how is", "who's": "who is", "she's": "she is", "he's": "he is", "let's": "let us", "i'm": "i am",
    "you're": "you are", "we're": "we are", "they're": "they are", "i've": "i have", "you've": "you have", "we've": "we have",
    "they've": "they have", "would've": "would have", "could've": "could have", "should've": "should have",
    "i'll": "i will", "you'll": "you will", "we'll": "we will", "they'll": "they will", "it'll": "it will", "that'll": "that will",
    "i'd": "i would", "you'd": "you would", "we'd": "we would", "they'd": "they would",
}
# Substrings that the norm key replaces, in this order.
NORM_CONTRACTIONS = {
    "won't": "will not", "can't": "cannot", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'m": " am", "'d": " would",
    "let's": "let us", "it's": "it is", "that's": "that is", "what's": "what is", "who's": "who is", "there's": "there is", "how's": "how is", "i'm": "i am", "don't": "do not",
}
# Words that the group key leaves out.
GROUP_STOPWORDS = ("the", "a", "an", "my", "please", "can", "you", "could", "would", "hey", "ok", "okay", "so", "just", "um", "uh", "well", "do", "i", "to", "it", "is", "are", "for", "of", "me", "and", "that", "this")
# Letters that don't decompose, and Latin letters with marks and their base letters.
LIGATURES = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}
MARKED, PLAIN = "øðđłàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "oddlaaaaaaceeeeiiiinooooouuuuyy"
SPACE = r"[ \t\n\r\f]+"
LETTER = r"[0-9A-Za-zÀ-ÿ]"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def _apostrophes(c: Column) -> Column:
    return F.translate(c, "’ʼ`", "'''")


def expand(c: Column) -> Column:
    """Contractions as whole words, longest first; texts without an apostrophe are left alone at once."""
    out = c
    for short in sorted(CONTRACTIONS, key=len, reverse=True):
        out = F.regexp_replace(out, rf"\b{short}\b", CONTRACTIONS[short])
    return F.when(F.contains(c, F.lit("'")), out).otherwise(c)


def feature_key(c: Column) -> Column:
    return squeeze(F.replace(expand(_apostrophes(F.lower(squeeze(c)))), F.lit("'"), F.lit("")))


def leak_key(c: Column) -> Column:
    """Case and punctuation go, accents stay. Compatibility forms are left as they are: see ``leak_key_unicode``."""
    t = F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "['’ʼ]", "")
    return squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}_ \t\n\r\f]", " "))


@F.pandas_udf(T.StringType())
def _leak_forms(texts: pd.Series) -> pd.Series:
    s = texts.str.normalize("NFKC").str.casefold().str.replace("['’ʼ]", "", regex=True).str.replace(r"[^\w\s]", " ", regex=True)
    return s.str.replace(r"\s+", " ", regex=True).str.strip()


@F.pandas_udf(T.StringType())
def _token_forms(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD").str.replace("’", "'", regex=False).str.lower().str.findall("[a-z0-9]+(?:'[a-z0-9]+)?").str.join(" ")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def leak_key_unicode(c: Column) -> Column:
    """The leak key with NFKC and full case folding; only texts that aren't ASCII go through Python, in Arrow batches."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "'", ""), r"[^a-z0-9_ \t\n\x0B\f\r\x1c-\x1f]", " "), r"[ \t\n\x0B\f\r\x1c-\x1f]+", " ")
    return F.when(_ascii(c), F.trim(plain)).otherwise(_leak_forms(F.when(~_ascii(c), c)))


def token_key_unicode(c: Column) -> Column:
    """The token key after NFKD: marks part words, as their letters do; only texts that aren't ASCII go through Python."""
    return F.when(_ascii(c), token_key(c)).otherwise(_token_forms(F.when(~_ascii(c), c)))


def norm_key(c: Column) -> Column:
    """Contractions as substrings, in table order; punctuation other than ' becomes space."""
    t = F.lower(squeeze(c))
    out = t
    for short, long in NORM_CONTRACTIONS.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    t = F.when(F.contains(t, F.lit("'")), out).otherwise(t)
    return squeeze(F.regexp_replace(t, r"[^\p{L}\p{N}_' \t\n\r\f]", " "))


def stem(w: Column) -> Column:
    long = F.length(w) > 4
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.when(long & F.endswith(w, F.lit("ing")), cut(3)).when(long & F.endswith(w, F.lit("ed")), cut(2)).when(long & F.endswith(w, F.lit("es")), cut(2)).when(long & F.endswith(w, F.lit("s")), cut(1)).otherwise(w)


def group_key(c: Column) -> Column:
    """The different stemmed content words of the norm key, sorted."""
    words = F.filter(F.split(norm_key(c), " "), lambda w: (w != "") & ~w.isin(*GROUP_STOPWORDS))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, stem))), " ")


def token_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(c, "’", "'")), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def token_key(c: Column) -> Column:
    return F.array_join(token_list(c), " ")


def loose_key(c: Column) -> Column:
    return squeeze(F.lower(c))


def ascii_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.translate(F.lower(c), "’", "'"), r"[^a-z0-9' \t\n\r\f]", " "))


# Polite words in front of and behind the core of an utterance.
POLITE_PREFIX = "^((please|pls|hey|hi|ok|okay|can you|could you|would you|will you|i want to|i need to|i would like to|i'd like to|i wanna) +)+"
POLITE_SUFFIX = "( +(please|pls|for me|thanks|thank you))+[.!?]*$"


def core_key(c: Column, rounds: int = 4) -> Column:
    """The ASCII key without politeness around it; empty cores keep the key."""
    whole = ascii_key(c)
    t = whole
    for _ in range(rounds):
        t = F.trim(F.regexp_replace(F.regexp_replace(t, POLITE_PREFIX, ""), POLITE_SUFFIX, ""))
    return F.coalesce(F.nullif(t, F.lit("")), whole)


def fold_key(c: Column) -> Column:
    t = F.lower(F.trim(c))
    for letter, plain in LIGATURES.items():
        t = F.replace(t, F.lit(letter), F.lit(plain))
    return F.translate(t, MARKED, PLAIN)


def token_set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))), " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(c: Column) -> Column:
    """Words of two and more letters, digits or underscores, and their bigrams."""

    def both(one: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(one) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(one, i - 1), F.get(one, i)))
        return F.when(F.size(one) > 1, F.concat(one, two)).otherwise(one)

    return let(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), both)


def truncated(c: Column, most: int = 500) -> Column:
    return F.substring(F.trim(c), 1, most)
