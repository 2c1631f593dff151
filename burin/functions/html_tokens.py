"""The pattern that cuts a page into tokens; Java's and Python's regular expressions read it alike.

Repetitions are possessive or lazy over single characters, so neither engine recurses with the
length of a page, and a token that has no end takes the rest of the page: one pass, linear.
"""

from __future__ import annotations

_WS = r"[ \t\n\r]"
#: What a tag holds up to its `>`: quotes hide a `>`.
_BODY = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_QUOTED = r""""[^"]*+"|'[^']*+'"""
# Elements whose content is text up to their end tag.
RAW = ("script", "style", "title", "textarea", "xmp", "noscript")
#: How deep the brackets of a declaration may nest.
_DEPTH = 4


def _brackets(depth: int) -> str:
    inner = rf"|\[{_brackets(depth - 1)}\]" if depth > 1 else ""
    return rf"(?:[^\[\]\"']++|{_QUOTED}{inner})*+"


_DECLARATION = rf"(?:[^\[\"'>]++|{_QUOTED}|\[{_brackets(_DEPTH)}\])*+>"
_NAMED = rf"(?={_WS}|[/>])"
#: One whole token after its `<`: comment, declaration, end tag, raw element with its content, plaintext, start tag.
_REST = (
    r"!--[\s\S]*?-->"
    rf"|!(?!--){_DECLARATION}"
    rf"|/{_BODY}>"
    rf"|({'|'.join(RAW)}){_NAMED}{_BODY}(?:(?<=/)>|>(?>[\s\S]*?</\1(?={_WS}|>)){_BODY}>)"
    rf"|plaintext{_NAMED}{_BODY}(?:(?<=/)>|>[\s\S]*+)"
    rf"|(?!(?:{'|'.join(RAW)}|plaintext){_NAMED})(?=[^ \t\n\r/>!]){_BODY}>"
)
#: Every piece of a page, in order; the last takes the rest if it is no whole token.
PIECES = rf"(?i)[^<]++|<(?:{_REST}|[\s\S]*+)"
TOKENS = rf"(?i)<(?:{_REST}|[\s\S]*+)"
WHOLE = rf"(?i)\A(?:[^<]++|<(?:{_REST}))\z"
#: The name of a token that the inventory looks at: head, body, /head, /body, meta, link or !.
NAME = rf"(?i)\A<(/\s*+(?:head|body)\s*+(?=>)|(?:head|body|meta|link){_NAMED}|!(?!--))"
#: One attribute after another, from the name of a tag to its end; a slash between two ends them.
ATTRIBUTE = rf"\G{_WS}*+[^ \t\n\r=/>]*+{_WS}*+(?:={_WS}*+(?:\"[^\"]*+\"?|'[^']*+'?|[^ \t\n\r>]*+))?"
