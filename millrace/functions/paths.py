"""Paths, titles, statuses and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contents that stand for none.
NO_CONTENT = ("No content extracted", "AI extraction failed", "API key not available")
# Least and most pairs of a generated list.
PAIRS_LEAST, PAIRS_MOST = 2, 12


def path_text(t: Column) -> Column:
    """Word characters, white space and -.,() only, white space collapsed."""
    kept = F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}\p{N}_\s\-.,()]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def title_case(t: Column) -> Column:
    """Every run of letters begins with a capital and goes on in lower case (also after digits and apostrophes)."""
    marks = F.regexp_extract_all(t, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(marks, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def natural_url(path: Column) -> Column:
    """A URL's path as words: -_/ to spaces, a page's ending dropped, title case, 50 characters; 'Home' if empty."""
    bare = F.regexp_replace(F.translate(path, "-_/", "   "), r"\.(html|php|jsp|asp)$", "")
    return F.when(F.coalesce(path, F.lit("")) == "", "Home").otherwise(F.left(F.trim(title_case(bare)), F.lit(50)))


def title_of_path(p: Column) -> Column:
    """What follows the last // up to the next /, or without // the last segment."""
    after = F.element_at(F.split(p, "//"), -1)
    return F.when(p.contains("//"), F.element_at(F.split(after, "/"), 1)).otherwise(F.element_at(F.split(p, "/"), -1))


def slashes(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def names_node(title: Column, path: Column, topic: Column) -> Column:
    """Whether a node is a topic's: by its title, or by the end of its path."""
    return (title == topic) | F.endswith(path, F.concat(F.lit("/"), topic))


def content_status(content: Column) -> Column:
    """skipped for no content or one that stands for none, else pending."""
    return F.when(content.isNull() | (content == "") | content.isin(*NO_CONTENT), "skipped").otherwise("pending")


def targeted(topic: Column, target: Column) -> Column:
    """All topics for 'all', else those whose name holds the target in any case."""
    return (F.lower(target) == "all") | F.contains(F.lower(topic), F.lower(target))


def in_bounds(topic_index: Column, qa_index: Column, topics: Column, pairs: Column) -> Column:
    """Whether a topic and a pair (null: the topic alone) of these numbers are there."""
    return (topic_index >= 0) & (topic_index < topics) & (qa_index.isNull() | ((qa_index >= 0) & (qa_index < pairs)))


def must(condition: Column, value: Column, message: str) -> Column:
    """The value; an error where the condition does not hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def valid_size(pairs: Column) -> Column:
    """Whether a generated list has a size that counts."""
    return F.size(F.coalesce(pairs, F.array())).between(PAIRS_LEAST, PAIRS_MOST)


def right_wins(a: Column, b: Column) -> Column:
    """Two maps in one; of a key in both, b's value."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def stamp(ts: Column) -> Column:
    """A time as part of a file's name."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two times, with two decimals."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.round((micros(end) - micros(start)) / 1e6, 2)


def related_stems(word: Column, stem) -> Column:
    """For words that begin with 'co' in over four characters: 'co' and the stem of the rest; else none. stem is an injected column function."""
    low = F.lower(word)
    return F.when(low.startswith("co") & (F.length(low) > 4), F.array(F.concat(F.lit("co"), stem(F.substring(low, F.lit(3), F.length(low)))))).otherwise(F.array().cast("array<string>"))


def stem_match(stem: Column, text: Column, stems: Column | None = None) -> Column:
    """Whether a text has a stem: among its stems if they are given, else as a part of it."""
    return F.array_contains(stems, stem) if stems is not None else F.contains(F.lower(text), F.lower(stem))


def lemmas(text: Column, lemma=lambda w: w, most: int = 2000) -> Column:
    """Distinct lemmas of over two characters in the beginning of a text; lemma is an injected column function (the word itself by default)."""
    words = F.regexp_extract_all(F.left(F.lower(F.coalesce(text, F.lit(""))), F.lit(most)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(words, lemma), lambda w: F.length(w) > 2))
