"""Text and list expressions. All are native columns; none starts Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results: the host prefix of repository links, the
# branch names taken before the default branch, the separator in commit links
# and the suffix of archive links, the longest text handed to an embedding
# model, the function text layout, and the summary prompt layout.
REPO_PREFIX = "https://github.com/"
PREFERRED_BRANCHES = ("master", "main", "develop")
COMMIT_SEPARATOR = "/commits/"
ARCHIVE_SUFFIX = "/zipball"
EMBED_CAP = 4096
PROMPT_BODY_CHARS = 100
KEEP_SHORTER_THAN = 85
KEEP_DISTANT_SHORTER_THAN = 120
DISTANCE_THRESHOLD = 10.0

_ITEM = r"""(?:'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|[\w.+\-]++)"""
_ANCHOR_HREF = (
    r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
)
_NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def repo_slug(url: Column, prefix: str = REPO_PREFIX) -> Column:
    """``owner/name`` of a repository link; NULL or empty gives NULL."""
    path = F.when(url.startswith(prefix), F.substr(url, F.lit(len(prefix) + 1))).otherwise(url)
    parts = F.slice(F.split(path, "/"), 1, 2)
    return F.when(url != "", F.array_join(parts, "/"))


def first_link(html: Column, host: str) -> Column:
    """First ``<a href>`` value holding ``host``, outside comments and scripts."""
    markup = F.regexp_replace(html, _NOT_MARKUP, "")
    tags = F.regexp_extract_all(markup, F.lit(_ANCHOR_HREF), F.lit(0))
    hrefs = F.transform(
        tags,
        lambda tag: F.replace(
            F.concat(*[F.regexp_extract(tag, _ANCHOR_HREF, group) for group in (1, 2, 3)]),
            F.lit("&amp;"),
            F.lit("&"),
        ),
    )
    return F.get(F.filter(hrefs, lambda href: F.contains(href, F.lit(host))), F.lit(0))


def prefer_first(
    items: Column, wanted: Sequence[str], fallback: Column, name_of=lambda item: item
) -> Column:
    """First listed item whose name is wanted, else the one named ``fallback``."""
    by_list = F.filter(items, lambda item: name_of(item).isin(list(wanted)))
    by_fallback = F.filter(items, lambda item: name_of(item) == fallback)
    return F.coalesce(F.get(by_list, F.lit(0)), F.get(by_fallback, F.lit(0)))


def preferred_branch(
    branches: Column, default_branch: Column, preferred: Sequence[str] = PREFERRED_BRANCHES
) -> Column:
    """The branch record to download, from ``array<struct<name, commit>>``."""
    return prefer_first(branches, preferred, default_branch, lambda branch: branch["name"])


def archive_url(commit_url: Column) -> Column:
    """Archive link belonging to a commit link."""
    stem = F.split_part(commit_url, F.lit(COMMIT_SEPARATOR), F.lit(1))
    return F.concat(stem, F.lit(ARCHIVE_SUFFIX))


def format_args(args: Column, strip_braces: bool = True) -> Column:
    """Brace text such as ``{a b}`` to ``a, b``."""
    bare = F.translate(args, "{}", "") if strip_braces else args
    words = F.filter(F.split(bare, r"\s+"), lambda word: word != "")
    return F.array_join(words, ", ")


def format_arg_list(args: Column) -> Column:
    """``array<string>`` to ``a, b``."""
    return F.array_join(args, ", ")


def flatten(text: Column) -> Column:
    """One blank for every line feed and every carriage return."""
    return F.translate(text, "\n\r", "  ")


def render_function(name: Column, args: Column, body: Column) -> Column:
    """Function text as given to a model; ``args`` is already formatted."""
    return F.concat(F.lit("def "), name, F.lit("("), args, F.lit("):\n "), flatten(body))


def render_with_docstring(name: Column, args: Column, body: Column, docstring: Column) -> Column:
    """Function text, a blank line, and the docstring (nothing if NULL)."""
    return F.concat(
        render_function(name, args, body), F.lit("\n\n"), F.coalesce(docstring, F.lit(""))
    )


def cap(text: Column, n: int = EMBED_CAP) -> Column:
    """At most the first ``n`` characters."""
    return F.substring(text, 1, n)


def summary_prompt(docstring: Column, body: Column, body_chars: int = PROMPT_BODY_CHARS) -> Column:
    """Prompt asking a model for a one-line summary."""
    return F.concat(
        F.lit("Docstring: "),
        docstring,
        F.lit(". Function body: "),
        cap(body, body_chars),
        F.lit("; Summary: "),
    )


def search_text(text: Column, n: int | None = None) -> Column:
    """A typed query, lower-cased, and cut to ``n`` characters if asked; blank gives NULL."""
    lowered = F.lower(text)
    typed = F.trim(F.translate(text, "\t\r\n", "   ")) != ""
    return F.when(typed, lowered if n is None else cap(lowered, n))


def keep_rule(
    docstring: Column,
    short: Column,
    distance: Column,
    short_enough: int = KEEP_SHORTER_THAN,
    distant_enough: int = KEEP_DISTANT_SHORTER_THAN,
    threshold: float = DISTANCE_THRESHOLD,
) -> Column:
    """Which of docstring, summary or neither to keep.

    A brief docstring stays; so does a fairly brief one that its summary does
    not resemble. A summary that resembles the docstring and is longer drops
    the row (NULL). Everything else takes the summary.
    """
    doc_len = F.length(docstring)
    return (
        F.when(doc_len < short_enough, docstring)
        .when((distance > threshold) & (doc_len < distant_enough), docstring)
        .when(
            (distance < threshold) & (F.length(short) > doc_len),
            F.lit(None).cast("string"),
        )
        .otherwise(short)
    )


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def count_substring(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    without = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(without)) / len(needle)).cast("bigint")


def parse_list_literal(text: Column) -> Column:
    """``"['a', \"b's\"]"`` to ``array<string>``; text that is no list gives NULL.

    Items stand in single or double quotes, in which a backslash frees the
    next character, or are bare words and numbers.
    """
    whole = rf"^\s*\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*+,?\s*)?\]\s*$"
    items = F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))
    quoted = lambda item: item.rlike("^['\"]")
    inner = lambda item: item.substr(F.lit(2), F.length(item) - 2)
    free = lambda item: F.regexp_replace(inner(item), r"\\(.)", "$1")
    plain = F.transform(items, lambda item: F.when(quoted(item), free(item)).otherwise(item))
    return F.when(text.rlike(whole), plain)


def tag_label(tag: Column) -> Column:
    """Trimmed tag with each hyphen turned into a line break."""
    return F.translate(F.trim(tag), "-", "\n")


def has_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    """Case-sensitive suffix test; a bare ``.py`` has a name but no suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | (name.endswith(suffix) & (F.length(name) > len(suffix)))
    return hit


def file_stem(path: Column) -> Column:
    """Last path part without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def _first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^\r\n]*)", 1)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def leading_comment(text: Column, marker: str = "#") -> Column:
    """Text of a comment on the first line, or NULL."""
    line = _first_line(text)
    words = _strip(F.regexp_replace(line, rf"^[ \t]*(?:{marker})+", ""))
    return F.when(line.rlike(rf"^[ \t]*{marker}"), F.nullif(words, F.lit("")))


def without_leading_comment(text: Column, marker: str = "#") -> Column:
    """Text less a comment on its first line, stripped at both ends."""
    line = _first_line(text)
    rest = F.regexp_replace(text, r"^[^\r\n]*(?:\r\n|\r|\n)?", "")
    return _strip(F.when(line.rlike(rf"^[ \t]*{marker}"), rest).otherwise(text))
