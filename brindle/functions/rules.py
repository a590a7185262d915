"""Keyword rules, guards and polarity as Column expressions; rule tables are parameters and become one CASE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = "0-9A-Za-zÀ-ÿ"
# Cues that turn a statement around, uncertain answers, and idioms in which "no" is no refusal.
NEGATIONS = ("not", "don't", "dont", "do not", "never", "without", "no need to", "stop", "cancel")
UNCERTAIN = ("not sure", "maybe", "dunno", "don't know", "dont know", "i don't know", "no idea", "unsure")
NO_IDIOMS = ("no worries", "no problem", "no doubt", "no biggie", "no probs", "no sweat", "not a problem")
# Fixed value: the shape of a correction; the comma or dash is the signal, so the text must not be normalised.
CORRECTIVE = r"(^|[^a-z])(not|no|never|dont|do not|didnt|did not|skip|forget)([^a-z,\-—][^,\-—]*)?[,\-—] *[^ ]+|(^|[^a-z])i meant([^a-z]|$)|(^|[^a-z])instead([^a-z]|$)|is not what i (wanted|asked)([^a-z]|$)"
# Phrases in front of the topic of a request, tried in order, once each. Spaces and line ends stand for
# word boundaries: \b and \s mean different characters to different engines.
CARRIERS = (
    r"^ *please +",
    r"^ *(do *n[o']?t|don't|dont) +let +me +forget( +(to|about))? *",
    r"^ *(remind|tell|alert|notify) +me( +(to|that|about|of))?( +|$)",
    r"^ *set( +up)? +(an? +)?(reminder|alarm)( +(to|about))?( +|$)",
    r"^ *make +sure +(i|to)( +|$)",
    r"^ *i +(need|have|want) +to( +|$)",
)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def word(cue: str) -> str:
    """A pattern for a cue as whole words; classes instead of \\b, which goes wrong beside accents."""
    plain = "".join(f"\\{c}" if c in ".^$*+?()[]{}|\\" else c for c in cue)
    return f"(^|[^{LETTER}]){plain}([^{LETTER}]|$)"


def has_word(text: Column, cues: Sequence[str]) -> Column:
    return any_of([text.rlike(word(c)) for c in cues])


def negated(text: Column, term: Column, cues: Sequence[str] = NEGATIONS, window: int = 30) -> Column:
    """A cue stands within ``window`` characters before the first place of ``term``."""
    at = F.instr(text, term)
    before = F.substring(text, F.lit(1), at - 1)
    near = F.when(F.length(before) > window, F.substring(before, F.length(before) - window + 1, F.lit(window))).otherwise(before)
    return (at > 0) & has_word(near, cues)


def first_rule(text: Column, rules: Sequence[dict]) -> Column:
    """struct(intent, tier) of the first rule that fires, else null. Rules: intent and one of exact, contains, regex (with not_regex)."""
    out = F.lit(None).cast("struct<intent: string, tier: string>")
    for rule in reversed(rules):
        if "exact" in rule:
            fires, tier = text.isin(*rule["exact"]), "exact"
        elif "contains" in rule:
            fires, tier = any_of([F.contains(text, F.lit(t)) & ~negated(text, F.lit(t)) for t in rule["contains"]]), "contains"
        else:
            fires, tier = text.rlike(rule["regex"]), "regex"
            if "not_regex" in rule:
                fires, tier = fires & ~text.rlike(rule["not_regex"]), "regex_guarded"
        out = F.when(fires, F.struct(F.lit(rule["intent"]).alias("intent"), F.lit(tier).alias("tier"))).otherwise(out)
    return out


def yes_no(text: Column, yes: Sequence[str], no: Sequence[str]) -> Column:
    """True, false, or null where there is no telling; a no beats a yes, idioms are masked first."""
    t = F.lower(F.trim(text))
    scan = t
    for idiom in NO_IDIOMS:
        scan = F.replace(scan, F.lit(idiom), F.lit(" "))
    unsure = any_of([F.contains(t, F.lit(p)) for p in UNCERTAIN])
    return F.when(unsure, F.lit(None).cast("boolean")).when(has_word(scan, no), False).when(has_word(scan, yes), True)


def cancels(text: Column, cues: Sequence[str], yes: Sequence[str], no: Sequence[str]) -> Column:
    """An explicit cue anywhere, or a bare refusal of two words at most."""
    t = F.lower(F.trim(text))
    return has_word(t, cues) | (F.coalesce(~yes_no(text, yes, no), F.lit(False)) & (F.size(F.split(t, " +")) <= 2))


def without_carriers(text: Column, carriers: Sequence[str] = CARRIERS) -> Column:
    return F.trim(reduce(lambda t, p: F.regexp_replace(t, p, ""), carriers, F.lower(text)))


# Constructs outside the portable subset of regular expressions, and its bounds.
FORBIDDEN = (
    (r"\\[1-9]", "backreference"), (r"\(\?=", "lookahead"), (r"\(\?!", "negative lookahead"), (r"\(\?<[=!]", "lookbehind"), (r"\(\?P", "named group"), (r"\(\?<[a-zA-Z]", "named group"),
    (r"\(\?[aiLmsux]+[):]", "inline flags"), (r"\(\?#", "comment group"), (r"\(\?>", "atomic group"), (r"[*+?]\?", "lazy quantifier"), (r"[*+?]\+", "possessive quantifier"),
    (r"\{\d+(,\d*)?\}[?+]", "lazy/possessive bounded quantifier"), (r"\\p\{", "unicode property escape"), (r"\\[0-7]{2,3}", "octal escape"),
)
MOST_LENGTH, MOST_REPEATS, MOST_DEPTH = 512, 32, 4


def depth(pattern: Column) -> Column:
    """The deepest nesting of groups, escaped brackets aside."""
    plain = F.regexp_replace(pattern, r"\\.", "")
    steps = F.transform(F.regexp_extract_all(plain, F.lit(r"[()]"), F.lit(0)), lambda c: F.when(c == "(", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, x: F.struct(F.greatest(F.lit(0), s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most"))
    return F.aggregate(steps, start, step, lambda s: s["most"])


def portability(pattern: Column) -> Column:
    """The problems of a pattern, sorted; empty if it is portable. Whether it compiles is not checked here."""
    bounds = F.transform(F.regexp_extract_all(pattern, F.lit(r"[{,](\d+)"), F.lit(1)), lambda n: F.coalesce(n.try_cast("long") > MOST_REPEATS, F.lit(True)))  # beyond a long: too large
    found = [F.when(pattern.rlike(p), F.lit(name)) for p, name in FORBIDDEN]
    found += [F.when(F.length(pattern) > MOST_LENGTH, F.lit("too long")), F.when(F.exists(bounds, lambda b: b), F.lit("bound too large")), F.when(depth(pattern) > MOST_DEPTH, F.lit("too deep"))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*found), F.isnotnull)))
