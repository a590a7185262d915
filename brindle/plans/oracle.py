"""DuckDB expressions that the oracle queries share."""

from __future__ import annotations

from brindle.functions import text as X

SPACE = r"[ \t\n\r\f]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'), ' ')"


def expand(c: str) -> str:
    for short in sorted(X.CONTRACTIONS, key=len, reverse=True):
        c = f"regexp_replace({c}, {quoted(chr(92) + 'b' + short + chr(92) + 'b')}, {quoted(X.CONTRACTIONS[short])}, 'g')"
    return c


def feature_key(c: str) -> str:
    return squeeze(f"replace({expand(f'translate(lower({squeeze(c)}), {quoted("’ʼ`")}, {quoted(chr(39) * 3)})')}, '''', '')")


def leak_key(c: str) -> str:
    t = f"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[''’ʼ]', '', 'g')"
    return squeeze(rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}_ \t\n\r\f]', ' ', 'g')")


def norm_key(c: str) -> str:
    t = f"lower({squeeze(c)})"
    for short, long in X.NORM_CONTRACTIONS.items():
        t = f"replace({t}, {quoted(short)}, {quoted(long)})"
    return squeeze(rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}_'' \t\n\r\f]', ' ', 'g')")


def group_key(c: str) -> str:
    stops = ", ".join(map(quoted, X.GROUP_STOPWORDS))
    stem = "CASE " + " ".join(f"WHEN length(w) > 4 AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)})" for s in ("ing", "ed", "es", "s")) + " ELSE w END"
    return f"array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({norm_key(c)}, ' '), lambda w: w <> '' AND w NOT IN ({stops})), lambda w: {stem}))), ' ')"


def token_list(c: str) -> str:
    return f"regexp_extract_all(lower(translate({c}, '’', '''')), '[a-z0-9]+(?:''[a-z0-9]+)?')"


def token_key(c: str) -> str:
    return f"array_to_string({token_list(c)}, ' ')"


def loose_key(c: str) -> str:
    return squeeze(f"lower({c})")


def ascii_key(c: str) -> str:
    return squeeze(rf"regexp_replace(translate(lower({c}), '’', ''''), '[^a-z0-9'' \t\n\r\f]', ' ', 'g')")


def core_key(c: str) -> str:
    whole = t = ascii_key(c)
    for _ in range(4):
        t = f"trim(regexp_replace(regexp_replace({t}, {quoted(X.POLITE_PREFIX)}, ''), {quoted(X.POLITE_SUFFIX)}, ''), ' ')"
    return f"coalesce(nullif({t}, ''), {whole})"


def fold_key(c: str) -> str:
    t = f"lower(trim({c}, ' '))"
    for letter, plain in X.LIGATURES.items():
        t = f"replace({t}, '{letter}', '{plain}')"
    return f"translate({t}, '{X.MARKED}', '{X.PLAIN}')"


def token_set(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))), ' ')"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}'), lambda w: w <> '')"


def ngram_words(c: str) -> str:
    return rf"regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]{{2,}}')"


def rooted(rows: str, by: str, columns: str, digits: tuple[int, ...] = (6, 3, 0)) -> str:
    """Digests of digests by shorter and shorter beginnings, for ``rows`` with ``by`` and a digest d."""
    level = f"SELECT {by}, d AS head, d, 1::BIGINT AS n FROM ({rows})"
    for width in digits:
        level = f"SELECT {by}, cell AS head, sha256(string_agg(d, chr(10) ORDER BY head, d)) AS d, sum(n)::BIGINT AS n FROM (SELECT {by}, head, d, n, left(head, {width}) AS cell FROM ({level})) GROUP BY {by}, cell"
    return f"SELECT {columns} FROM (SELECT {by}, n, d AS root FROM ({level}))"
