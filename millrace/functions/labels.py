"""Labels, rephrasings and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from . import urls

# What a question's first word can become (a longer beginning never gets its turn), and openings for others.
REPHRASED = {
    "What": ("Which ", "Can you tell me what ", "I want to know what "),
    "Who": ("Which person ", "Can you tell me who ", "I'd like to know who "),
    "How": ("In what way ", "What's the method to ", "Can you explain how "),
    "Why": ("What's the reason ", "For what reason ", "Can you explain why "),
    "Where": ("In what location ", "What place ", "Can you tell me where "),
    "When": ("At what time ", "What time ", "Can you tell me when "),
}
OPENINGS = ("Can you tell me: ", "I'd like to know: ", "Please explain: ", "Help me understand: ")


def rephrase(question: Column, pick: Column) -> Column:
    """Another wording; pick (any integer) chooses among them, so a seed makes it repeatable."""
    q = F.trim(question)
    one = lambda forms: F.get(F.array(*map(F.lit, forms)), F.pmod(pick, F.lit(len(forms))).cast("int"))
    out = F.concat(one(OPENINGS), q)
    for word, forms in reversed(REPHRASED.items()):
        out = F.when(q.rlike(f"(?i)^{word} "), F.concat(one(forms), F.substring(q, F.lit(len(word) + 2), F.length(q)))).otherwise(out)
    return out


def heuristic(text: Column, attrs: Column, href: Column) -> Column:
    """The first that says something: a text of at most 50 characters, aria-label, title, alt, the URL's last segment."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    use = lambda c: F.when(~tx.generic_label(c), c)
    slug = F.initcap(F.translate(urls.slug(F.coalesce(href, F.lit(""))), "-_", "  "))
    return F.coalesce(
        F.when(~tx.generic_label(text) & (F.length(flat) <= 50), flat),
        *(use(F.try_element_at(attrs, F.lit(k))) for k in ("aria-label", "title", "alt")),
        use(slug),
    )


def final(label: Column, text: Column, href: Column) -> Column:
    """The label; else the first 50 characters of a text below 100; else the URL's last segment; else 'Page'."""
    flat = F.trim(F.coalesce(text, F.lit("")))
    slug = urls.slug(F.coalesce(href, F.lit("")))
    return F.coalesce(label, F.when((flat != "") & (F.length(flat) < 100), F.left(flat, F.lit(50))), F.nullif(slug, F.lit("")), F.lit("Page"))


def highlight(text: Column, term: str) -> Column:
    """Every occurrence of a term, in any case, as >>>TERM<<<."""
    return F.regexp_replace(text, f"(?i){term}", f">>>{term.upper()}<<<")


def snippet(text: Column, term: str, before: int = 20, after: int = 30) -> Column:
    """Text around the first occurrence of a term in any case; null if there is none."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at + len(term) + after - start))


def numbered(lines: Column) -> Column:
    """A line without a leading number."""
    return F.regexp_replace(lines, r"^\d+[.):]\s*", "")


def fused_label(score: Column) -> Column:
    """Names for fused scores from 0.06, 0.05, 0.04, 0.03 on."""
    return F.when(score >= 0.06, "Very High").when(score >= 0.05, "High").when(score >= 0.04, "Medium").when(score >= 0.03, "Low").otherwise("Very Low")


def consensus(votes: Column) -> Column:
    """Names for 4, 3, 2 and other numbers of votes."""
    return F.when(votes == 4, "✓✓✓✓ Strong Consensus").when(votes == 3, "✓✓✓ Good Consensus").when(votes == 2, "✓✓ Moderate Agreement").otherwise("✓ Weak Agreement")


def listed_pairs(pairs: Column) -> Column:
    """Numbered questions and answers of an array of pairs, as a prompt carries them."""
    one = lambda p, k: F.concat(F.lit("\n"), (k + 1).cast("string"), F.lit(". Q: "), p["question"], F.lit("\n   A: "), p["answer"], F.lit("\n"))
    return F.array_join(F.transform(pairs, one), "")


def without_repeats(parts: Column) -> Column:
    """An array without the entries that equal the one before, in any case."""
    return F.filter(parts, lambda x, k: (k == 0) | (F.lower(x) != F.lower(F.get(parts, k - 1))))


#: Words of links that lead to a site's main pages.
LEADING = ("for", "about", "services", "members", "providers")


def meaningful(links: Column) -> Column:
    """Of the texts of a page's links, the first that says something in over 3 characters, one with a word of main pages before others."""
    good = F.filter(F.transform(links, lambda t: F.trim(t)), lambda t: ~tx.generic_label(t) & (F.length(t) > 3))
    main = F.filter(good, lambda t: F.lower(t).rlike("|".join(LEADING)))
    return F.left(F.coalesce(F.get(main, F.lit(0)), F.get(good, F.lit(0))), F.lit(50))


def located(kind: Column, label: Column, url: Column) -> Column:
    """Place of a label: /label for headings, //label for links, else the URL's path, or 'Home'."""
    path = F.regexp_extract(F.element_at(F.split(url, r"[?#]", 2), 1), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?/*(.*?)/*$", 1)
    said = F.nullif(F.trim(label), F.lit(""))
    return F.coalesce(F.when(kind == "heading", F.concat(F.lit("/"), said)).when(kind == "link", F.concat(F.lit("//"), said)), F.nullif(path, F.lit("")), F.lit("Home"))


def readable_path(path: Column) -> Column:
    """Segments without scheme or host, joined by arrows."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.startswith("http") & ~x.contains(":"))
    return F.array_join(parts, " → ")
