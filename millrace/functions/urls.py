"""Column functions on URLs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(u: Column) -> Column:
    """Without fragment, and without trailing slashes unless the path is only one; scheme, host case and query stay."""
    whole = F.element_at(F.split(u, "#", 2), 1)
    path, query = F.element_at(F.split(whole, r"\?", 2), 1), F.try_element_at(F.split(whole, r"\?", 2), F.lit(2))
    root = path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/$") | (path == "/")
    bare = F.when(root, path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(query.isNotNull(), F.concat(bare, F.lit("?"), query)).otherwise(bare)


def authority(u: Column) -> Column:
    """Host with port, '' for a relative URL."""
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def link_kind(href: Column, host: Column) -> Column:
    """internal (no host of its own, or the page's) or external."""
    own = authority(href)
    return F.when((own == "") | (own == host), "internal").otherwise("external")


def skipped(href: Column, text: Column) -> Column:
    """Links without a target of their own, navigation aids and very short texts."""
    return (
        href.isNull() | (href == "") | F.startswith(href, F.lit("#")) | F.lower(href).startswith("javascript:")
        | text.rlike("(?i)^(skip to|menu|search|login)") | (F.length(F.trim(F.coalesce(text, F.lit("")))) <= 2)
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link on a page: absolute, host-relative, root-relative or relative to the page's folder."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), authority(base))
    folder = F.regexp_extract(F.element_at(F.split(base, r"[?#]", 2), 1), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/.*/|[A-Za-z][A-Za-z0-9+.-]*://[^/]*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), href))
    )


def slug(u: Column) -> Column:
    """Last segment of the path, '' if there is none."""
    path = F.regexp_extract(F.element_at(F.split(u, r"[?#]", 2), 1), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?/*(.*?)/*$", 1)
    return F.element_at(F.split(path, "/"), -1)
