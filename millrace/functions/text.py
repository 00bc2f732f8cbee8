"""Column functions on text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import bound

# Words that keyword extraction ignores, by kind.
STOPWORDS = (
    "who", "what", "where", "when", "why", "how", "which", "whose",
    "tell", "know", "explain", "describe", "discuss", "give", "show",
    "please", "help", "need", "want", "looking", "find", "get", "got",
    "me", "about", "some", "any", "many", "much", "more", "most",
    "other", "another", "such", "own", "same", "different",
    "really", "actually", "basically", "simply", "just", "even",
    "also", "too", "very", "quite", "rather", "well", "still",
)
# Beginnings that are written with or without a hyphen.
PREFIXES = ("co", "pre", "post", "non", "self", "ex", "anti", "semi", "multi", "sub")
# Labels that say nothing about their target.
GENERIC = ("click here", "read more", "learn more", "more info", "view", "see", "go", "link", "here", "this", "that", "continue", "next", "previous", "back", "forward")
# Phrases that pages carry and contents don't.
ARTIFACTS = r"(?i)Skip to content|Skip to main content|Skip navigation|Share this page|Print this page|Email this page|JavaScript must be enabled|Enable JavaScript"


def normalize(t: Column) -> Column:
    """Lower case, hyphens deleted, other punctuation to spaces, white space collapsed; null gives ''."""
    low = F.replace(F.lower(F.coalesce(t, F.lit(""))), F.lit("-"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(t: Column) -> Column:
    """Lower-cased, split at white space, punctuation kept, no blanks."""
    return F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda x: x != "")


def words(t: Column) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalize(t), " "), lambda x: x != ""))


def keywords(t: Column) -> Column:
    """Distinct normalised words of over two characters that are no stopwords."""
    return F.filter(words(t), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def bare_word(w: Column) -> Column:
    """The default lemma and stem: a word without the ending of a plural."""
    return F.regexp_replace(w, "(ies|es|s)$", "")


def ascii_words(t: Column) -> Column:
    """Distinct words of ASCII letters and digits of the normalised text."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(normalize(t), "[^a-z0-9 ]", ""), " "), lambda w: w != ""))


def stem_words(t: Column, stem=bare_word) -> Column:
    """Distinct stems of the words."""
    return F.array_distinct(F.transform(words(t), stem))


def ngrams(t: Column, n: int = 3) -> Column:
    """Distinct character n-grams without spaces; none if the text is shorter."""
    s = F.split(F.replace(F.lower(F.coalesce(t, F.lit(""))), F.lit(" "), F.lit("")), "")  # its characters

    def runs(x: Column) -> Column:
        out = x["c"]
        for k in range(2, n + 1):
            out = F.zip_with(out, F.slice(x["c"], F.lit(k), F.size(x["c"])), lambda p, q: F.concat(p, q))  # null beyond the end
        return F.array_distinct(F.filter(out, lambda g: F.length(g) == n))

    return bound(runs, c=s)


def variants(word: Column) -> Column:
    """Spellings of a keyword: hyphen dropped, and for known beginnings hyphenated, spaced and bare (bare over 3 characters)."""
    out = [F.array(word, F.replace(word, F.lit("-"), F.lit("")), F.replace(word, F.lit("-"), F.lit(" ")))]
    for p in PREFIXES:
        rest = F.substring(word, F.lit(len(p) + 1), F.length(word))
        forms = F.filter(F.array(F.concat(F.lit(f"{p}-"), rest), F.concat(F.lit(f"{p} "), rest), F.when(F.length(rest) > 3, rest)), lambda x: x.isNotNull())
        out.append(F.when(F.startswith(word, F.lit(p)) & (F.length(word) > len(p)), forms).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))


def preview(t: Column, n: int = 200) -> Column:
    """The first n characters, with dots if there are more."""
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def generic_label(t: Column) -> Column:
    """Empty, one character, all digits, or a label that says nothing."""
    s = F.lower(F.trim(F.coalesce(t, F.lit(""))))
    return (F.length(s) <= 1) | s.rlike(r"^\d+$") | s.isin(*GENERIC)


def cut_content(t: Column, most: int = 4000, floor: int = 3000) -> Column:
    """White space collapsed, page artifacts dropped, cut at most characters, at the last full stop if that comes after floor."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "), ARTIFACTS, ""))
    head = F.left(s, F.lit(most))
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    sentence = F.left(head, stop)
    return F.when(F.length(s) <= most, s).when((F.instr(head, ".") > 0) & (stop - 1 > floor), sentence).otherwise(head)


def clean_label(t: Column, n: int = 50) -> Column:
    """Word characters, white space and hyphens only, collapsed, the first n characters."""
    s = F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}\p{N}_\s-]", "")
    return F.left(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(n))


def topic_of_path(p: Column) -> Column:
    """The last segment of a path with - and _ as spaces; the whole path if that is empty."""
    last = F.trim(F.translate(F.element_at(F.split(p, "/"), -1), "-_", "  "))
    return F.when(last != "", last).otherwise(p)


def stars(score: Column) -> Column:
    """5 to 1 stars from 0.8, 0.6, 0.4, 0.2 on."""
    return F.when(score >= 0.8, 5).when(score >= 0.6, 4).when(score >= 0.4, 3).when(score >= 0.2, 2).otherwise(1)


def read_minutes(t: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(tokens(t)) / 200)).cast("int")


def pairs_wanted(t: Column) -> Column:
    """How many questions a page is good for: a thousand characters each, three to five."""
    return F.greatest(F.lit(3), F.least(F.lit(5), F.floor(F.length(F.coalesce(t, F.lit(""))) / 1000))).cast("int")
