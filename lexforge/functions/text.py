"""Text functions as column expressions: normalizers, tokenizers and extractors."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.lexicons import CLEANUP_PHRASES, CONSTRAINT_GROUPS, CONSTRAINT_PHRASES, CONSTRAINT_WORDS, CONTRACT_PREFIXES, KEYWORD_STOP, NEGATIONS, POLARITY_TERMS, SAFE_PHRASES, STOPWORDS, SYNONYMS
from lexforge.functions.similarity import bind

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[A-Za-z0-9_.$%/-]+"
#: a number stands between word edges; the edge is spelled out so that other engines agree
NUMBER = r"[$₹€£]?\b\d+(?:[,.]\d+)*(?:%|\b)"
CODE = r"\b[A-Z]{1,6}[-_]?[0-9]{1,8}[A-Z0-9-]*\b"
ENTITY = r"\b[A-Z][a-zA-Z0-9&.-]+(?:\s+[A-Z][a-zA-Z0-9&.-]+){0,4}\b"


def words_in(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """Without the white space of \\s at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


# -- normalizers --------------------------------------------------------------------------------------


def squeeze(c: Column) -> Column:
    """Runs of blanks to one, three newlines or more to two, ends stripped; null is empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def squeeze_nul(c: Column) -> Column:
    """squeeze() after turning NUL characters into spaces."""
    return squeeze(F.regexp_replace(c, r"\x00", " "))


def _phrase(p: str) -> str:
    return r"(?i)\b" + re.escape(p) + r"\b"


def _without(c: Column, phrases: Iterable[str], then: Callable[[Column], Column]) -> Column:
    """then() of a struct (text, low, removed): the phrases go one after the other, and each one's hits are counted in the text of its turn.

    A phrase's pattern runs only where the lower-case text of its turn holds the phrase at all.
    """
    turn = lambda t, n: F.struct(t.alias("text"), F.lower(t).alias("low"), n.alias("removed"))
    steps = F.array(*[F.struct(F.lit(p.lower()).alias("held"), F.lit(_phrase(p)).alias("pattern")) for p in phrases])

    def step(s: Column, p: Column) -> Column:
        hits = F.size(F.regexp_extract_all(s.text, p.pattern, F.lit(0)))
        return F.when(F.contains(s.low, p.held), bind(F.regexp_replace(s.text, p.pattern, F.lit("")), lambda t: turn(t, s.removed + hits))).otherwise(s)

    return F.aggregate(steps, turn(c, F.lit(0)), step, then)


def drop_filler(c: Column) -> Column:
    """Struct (text, removed): the filler phrases go one after the other, and each one's hits are counted in the text of its turn."""

    def done(s: Column) -> Column:
        return F.struct(squeeze(F.regexp_replace(s.text, r"\s+([,.!?;:])", "$1")).alias("text"), s.removed.cast("long").alias("removed"))

    return _without(F.coalesce(c, F.lit("")), SAFE_PHRASES, done)


def light_cleanup(c: Column) -> Column:
    def done(s: Column) -> Column:
        t = F.regexp_replace(s.text, r"\s+([,.;:])", "$1")
        return squeeze_nul(F.regexp_replace(t, r"(?i)\b(really|very|properly|clearly)\b", ""))

    return _without(c, CLEANUP_PHRASES, done)


def strip_contract(c: Column) -> Column:
    """Without lines that begin like a compression header; a text of nothing else stays."""
    lines = F.filter(F.split(c, r"\n", -1), lambda x: ~x.rlike("^\\s*(" + "|".join(re.escape(p) for p in CONTRACT_PREFIXES) + ")"))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(c)


#: each one named: Java takes ten times as long for a class that mixes ranges and single characters
_LOWER, _DIGITS = string.ascii_lowercase, string.digits


def _plain(c: Column) -> Column:
    """What evidence isn't written in, and runs of spaces, to one space each; ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, f"[^{_LOWER}{_DIGITS}+/#. -]+", " "), " {2,}", " "))


def canonical(c: Column) -> Column:
    """Lower-case form that evidence is matched in."""
    c = strip(F.lower(c))
    for old, new in (("ml ops", "mlops"), ("ci cd", "ci/cd"), ("retrieval augmented generation", "rag"), ("retrieval-augmented generation", "rag")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return _plain(c)


def synonym_canonical(c: Column) -> Column:
    """canonical form for similarity, synonyms rewritten longest first."""
    c = F.replace(F.replace(F.lower(c), F.lit("ml ops"), F.lit("mlops")), F.lit("ci cd"), F.lit("ci/cd"))
    for old in sorted(SYNONYMS, key=len, reverse=True):
        c = F.regexp_replace(c, r"(?<![a-z0-9])" + re.escape(old) + r"(?![a-z0-9])", SYNONYMS[old])
    return _plain(c)


def canonical_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"[^a-z0-9_]+", "_"), "^_+|_+$", "")


def strip_fences(c: Column) -> Column:
    bare = lambda s: strip(F.regexp_replace(F.regexp_replace(s, r"^```(?:json|JSON)?\s*", ""), r"\s*```$", ""))
    return bind(strip(c), lambda s: F.when(F.contains(s, F.lit("```")), bare(s)).otherwise(s))


def json_candidate(c: Column) -> Column:
    """From the first { to the last } of the unfenced text, or all of it."""
    ends = lambda t: F.struct(t.alias("t"), F.instr(t, "{").alias("a"), (F.length(t) - F.length(F.substring_index(t, "}", -1))).alias("b"))
    # bound: each of its five uses would take the fences off again
    return bind(bind(strip_fences(F.coalesce(c, F.lit(""))), ends), lambda x: F.when((x.a > 0) & (x.b > x.a), F.substring(x.t, x.a, x.b - x.a + 1)).otherwise(x.t))


# -- tokens and chunks -----------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    return find_all(F.coalesce(c, F.lit("")), TOKEN)


def count_tokens(c: Column) -> Column:
    """Pieces, and an eighth of each piece longer than 12."""
    t = tokens(c)
    extra = F.aggregate(F.filter(t, lambda x: F.length(x) > 12), F.lit(0), lambda a, x: a + F.floor(F.length(x) / 8).cast("int"))
    return (F.size(t) + extra).cast("long")


def approx_tokens(c: Column) -> Column:
    n = F.coalesce(F.length(c), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def sentences(c: Column) -> Column:
    """Parts at white space after . ! ? and at newlines, stripped, blanks dropped."""
    parts = F.transform(F.split(strip(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+|\n+", -1), strip)
    return F.filter(parts, lambda x: x != "")


def line_chunks(c: Column, longest: int = 240) -> Column:
    """Lines; only those of longest characters or more are cut into sentences."""
    lines = F.filter(F.transform(F.split(c, r"\n+", -1), strip), lambda x: x != "")
    cut = lambda x: F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+", -1), strip), lambda y: y != "")
    return F.flatten(F.transform(lines, lambda x: F.when(F.length(x) < longest, F.array(x)).otherwise(cut(x))))


def all_words(c: Column) -> Column:
    return F.transform(find_all(F.coalesce(c, F.lit("")), WORD), F.lower)


#: a whole word that is no stop word: one pattern, where a filter would look at each word in a lambda
CONTENT_WORD = r"(?<![A-Za-z0-9_.$%/-])(?!(?i:" + "|".join(STOPWORDS) + r")(?![A-Za-z0-9_.$%/-]))" + WORD


def words(c: Column) -> Column:
    """Lower-case words without stop words."""
    return F.transform(find_all(F.coalesce(c, F.lit("")), CONTENT_WORD), F.lower)


def content(all_words: Column) -> Column:
    """words() of a text whose all_words() are there already."""
    return F.filter(all_words, lambda x: ~x.isin(*STOPWORDS))


def keyword_set(c: Column) -> Column:
    found = F.transform(find_all(c, r"[A-Za-z][A-Za-z0-9_+#.-]{2,}"), F.lower)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*KEYWORD_STOP)))


def char_ngrams(c: Column, n: int = 4) -> Column:
    def grams(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(found)

    # bound as a lambda's variable, the canonical text is worked out once a row and not once a gram
    return F.flatten(F.transform(F.array(synonym_canonical(c)), grams))


# -- extractors ----------------------------------------------------------------------------------------------


def numbers(c: Column) -> Column:
    return F.sort_array(F.array_distinct(find_all(F.coalesce(c, F.lit("")), NUMBER)))


def codes(c: Column) -> Column:
    return F.sort_array(F.array_distinct(find_all(F.coalesce(c, F.lit("")), CODE)))


def entities(c: Column) -> Column:
    found = F.filter(find_all(F.coalesce(c, F.lit("")), ENTITY), lambda x: ~F.lower(x).isin(*STOPWORDS) & (F.length(x) >= 2))
    return F.sort_array(F.array_distinct(found))


TRIGGERS = tuple(dict.fromkeys([*CONSTRAINT_WORDS, *NEGATIONS]))


def window(toks: Column, at: Column, before: int, after: int) -> Column:
    """Tokens from before to after around the one at (from 0), joined by spaces."""
    start = F.greatest(at - before, F.lit(0))
    return F.array_join(F.slice(toks, start + 1, F.least(at + after + 1, F.size(toks)) - start), " ")


def constraint_windows(c: Column) -> Column:
    """Sorted distinct windows of three words on either side of a constraint or negation."""
    # bound: named inside the function, the words would be found again for every trigger
    hits = bind(all_words(c), lambda toks: F.filter(F.transform(toks, lambda x, i: F.when(x.isin(*TRIGGERS), window(toks, i, 3, 3))), lambda x: x.isNotNull()))
    return F.sort_array(F.array_distinct(hits))


def constraint_atoms(c: Column) -> Column:
    """atoms_in() of a text."""
    return atoms_in(all_words(c))


def atoms_in(words: Column) -> Column:
    """Constraints of a text, given all_words() of it: array of (group, terms, numbers, window, weight) around each trigger word or phrase.

    terms are the content words of the window, eight at most; fewer than three are filled up to five with the text's
    other long words. Of atoms with equal group, first six terms and numbers the first stays.
    """

    def atom(toks: Column, long: Column, i: Column) -> Column:
        near = F.slice(toks, F.greatest(i - 5, F.lit(1)), i + 9 - F.greatest(i - 6, F.lit(0)))

        def of(n: Column) -> Column:
            own = F.filter(n, lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS) & ~x.isin(*TRIGGERS))
            terms = bind(own, lambda t: F.slice(F.when(F.size(t) >= 3, t).otherwise(F.concat(t, F.slice(F.array_except(long, t), F.lit(1), 5 - F.size(t)))), 1, 8))
            return bind(F.array_join(n, " "), lambda w: F.struct(constraint_group(w).alias("group"), terms.alias("terms"), numbers(w).alias("numbers"), w.alias("window")))

        return bind(near, of)

    def atoms(x: Column) -> Column:
        phrase = lambda t, i: F.concat_ws(" ", F.get(x.toks, i - 1), t)
        trigger = lambda t, i: t.isin(*TRIGGERS) | phrase(t, i).isin(*CONSTRAINT_PHRASES)
        return F.filter(F.transform(x.toks, lambda t, i: F.when(trigger(t, i), atom(x.toks, x.long, i))), lambda a: a.isNotNull())

    def first_of_equals(found: Column) -> Column:
        key = lambda a: F.concat_ws("\x1f", a.group, F.concat_ws(" ", F.slice(a.terms, 1, 6)), F.concat_ws(" ", a.numbers))
        keyed = F.sort_array(F.transform(found, lambda a, i: F.struct(key(a).alias("k"), i.alias("i"))))
        # sorted, equal atoms are neighbours and the first of them leads
        firsts = bind(keyed, lambda s: F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["k"] != x.k), x.i)), lambda i: i.isNotNull()))
        return F.transform(F.sort_array(firsts), lambda i: F.get(found, i))

    toks = bind(words, lambda t: F.struct(t.alias("toks"), F.array_distinct(F.filter(t, lambda x: (F.length(x) >= 5) & ~x.isin(*STOPWORDS))).alias("long")))
    return bind(bind(toks, atoms), first_of_equals)


def constraint_group(w: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(w), F.lit(" "))
    out = None
    for group, cues in CONSTRAINT_GROUPS:
        hit = F.exists(words_in(cues), lambda x: F.contains(padded, x))
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("generic")


def keywords(c: Column, most: int = 30) -> Column:
    """Best words: length, 4 for a digit, 3 for no letter; ties by name."""
    return best_words(words(c), most)


def best_words(content: Column, most: int = 30) -> Column:
    """keywords() of a text, given words() of it."""
    t = F.array_distinct(F.filter(content, lambda x: F.length(x) >= 3))
    scored = F.transform(t, lambda x: F.struct((-(F.length(x) + F.when(x.rlike("[0-9]"), 4).otherwise(0) + F.when(F.upper(x) == x, 3).otherwise(0))).alias("s"), x.alias("w")))
    return F.transform(F.slice(F.sort_array(scored), 1, most), lambda x: x.w)


def has_polarity(c: Column) -> Column:
    # bound: named in the lambda, the lower case would be worked out for each term
    return bind(F.lower(c), lambda low: F.exists(words_in(POLARITY_TERMS), lambda x: F.contains(low, x)))
