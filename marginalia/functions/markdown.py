"""Markdown to plain text, as an ordered chain of built-in rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import RENDERED_BLANKS

# Character classes the patterns below are written with. Lines end at \n, \r,
# U+2028 and U+2029, and blanks are Unicode blanks, which the regex engine's own
# ^, $, . and \s do not quite cover.
_BLANKS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S = "[" + _BLANKS + "]"
_NS = "[^" + _BLANKS + "]"
_DOT = r"[^\n\r\u2028\u2029]"
_BOL = r"(?:\A|(?<=[\n\r\u2028\u2029]))"
_EOL = r"(?=[\n\r\u2028\u2029]|\z)"

# The rewrites, in the order they apply (the order has meaning).
REWRITES = (
    ("heading", _BOL + r"#{1,6}" + _S + r"+", ""),
    ("autolink", r"<(https?://[^>" + _BLANKS + r"]+)>", "$1"),
    ("html_tag", r"<[^>]*>", ""),
    ("code_block", r"```[\s\S]*?```", ""),
    ("image", r"!\[" + _DOT + r"*?\]\(" + _DOT + r"*?\)", ""),
    ("link", r"\[([^\]]+)\]\(" + _DOT + r"*?\)", "$1"),
    ("task", _BOL + _S + r"*[-*+]" + _S + r"+\[[ xX]\]" + _S + r"*", ""),
    ("strong_underscore", r"(^|[^\w])__(" + _NS + r"(?:[^_\n]*?" + _NS + r")?)__(?=[^\w]|\z)", "$1$2"),
    ("underscore", r"(^|[^\w])_(" + _NS + r"(?:[^_\n]*?" + _NS + r")?)_(?=[^\w]|\z)", "$1$2"),
    ("emphasis_chars", r"[*~`]", ""),
    ("quote", _BOL + _S + r"*>" + _S + r"*", ""),
    ("bullet", _BOL + _S + r"*[-+*]" + _S + r"+", ""),
    ("numbered", _BOL + _S + r"*\d+\." + _S + r"+", ""),
    ("rule", _BOL + r"---+" + _EOL, ""),
    ("blanks", r"[ \t\r]+", " "),
    ("newlines", r"\n+", "\n"),
)


# What a text must hold for a rewrite to change it. Looking for it costs far less than
# the pattern, and most previews hold few of these; rewrites not listed always run.
_NEEDS = {
    "heading": "#",
    "autolink": "<http",
    "html_tag": "<",
    "code_block": "```",
    "image": "![",
    "link": "](",
    "task": "[",
    "strong_underscore": "__",
    "underscore": "_",
    "quote": ">",
    "rule": "---",
    "newlines": "\n\n",
}


def _rewritten(pattern: str, replacement: str, need: str):
    def rewrite(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(need)), F.regexp_replace(text, pattern, replacement)).otherwise(text)

    return rewrite


def strip_markdown(text: Column) -> Column:
    """Plain text of a Markdown snippet. Meant for previews, which are short."""
    out = F.coalesce(text, F.lit(""))
    for name, pattern, replacement in REWRITES:
        if name in _NEEDS:
            # An array of one binds the text so far, which is then computed once.
            out = F.transform(F.array(out), _rewritten(pattern, replacement, _NEEDS[name]))[0]
        else:
            out = F.regexp_replace(out, pattern, replacement)
    return F.btrim(out, F.lit(RENDERED_BLANKS))
