"""The grammars of JSON and XML, each as a lexer and a pushdown stack. Nesting may be of any depth."""

from __future__ import annotations

import re

Error = tuple[str, int]

_JSON_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null))'
)
#: A whole flat run of an array or an object, which needs no look at the stack: the values, or keys
#: with values, that are no brackets, each with the comma behind it.
_SCALAR = r'(?:"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)'
_BLANK = r"[ \t\n\r]*+"
_ITEMS = re.compile(rf"(?:{_BLANK}{_SCALAR}{_BLANK},)++")
_FIELDS = re.compile(rf'(?:{_BLANK}"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{{4}}))*+"{_BLANK}:{_BLANK}{_SCALAR}{_BLANK},)++')


def json_error(text: str) -> Error | None:
    """The kind and line of the first error of a JSON text without byte-order mark, or None."""
    text = text.rstrip(" \t\n\r")
    stack: list[str] = []
    at, state = 0, "value"
    while at < len(text):
        if stack and state in ("value", "first value", "key", "first key"):
            run = (_FIELDS if state.endswith("key") else _ITEMS if stack[-1] == "[" else None)
            if run and (m := run.match(text, at)):
                at, state = m.end(), "value" if stack[-1] == "[" else "key"
                continue
        m = _JSON_TOKEN.match(text, at)
        mark = m[1] if m else None
        if m and mark is None and (state in ("value", "first value") or m[2] and state in ("key", "first key")):
            state = "colon" if "key" in state else "after"
        elif mark and mark in "[{" and state in ("value", "first value"):
            stack.append(mark)
            state = "first value" if mark == "[" else "first key"
        elif mark == ":" and state == "colon":
            state = "value"
        elif mark == "," and state == "after" and stack:
            state = "value" if stack[-1] == "[" else "key"
        elif mark and stack and stack[-1] + mark in ("[]", "{}") and state in ("after", "first value" if mark == "]" else "first key"):
            stack.pop()
            state = "after"
        else:
            break
        at = m.end()
    if at == len(text) and state == "after" and not stack:
        return None
    what = "premature end: open bracket" if at == len(text) else "against the grammar"
    return what, text.count("\n", 0, at) + 1


_NAME = r"[A-Za-z_:\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff]"
_NAME += rf"(?:{_NAME}|[-.0-9\u00b7\u0300-\u036f\u203f\u2040])*+"
_VALUE = r"""(?:"[^"<]*+"|'[^'<]*+')"""
_TAG = re.compile(
    rf"<(?:(?P<open>{_NAME})(?P<attributes>(?:\s++{_NAME}\s*+=\s*+{_VALUE})*+)\s*+(?P<empty>/?)>|/(?P<close>{_NAME})\s*+>|"
    rf"!--(?P<comment>(?:[^-]|-(?!-))*+)-->|!\[CDATA\[(?P<data>(?:[^\]]|\](?!\]>))*+)\]\]>|"
    rf"\?(?P<target>{_NAME})(?:\s(?:[^?]|\?(?!>))*+)?\?>|"
    rf"!DOCTYPE\s++(?P<doctype>{_NAME}(?:[^\[<>\"']|{_VALUE})*+)(?:\[(?P<subset>(?:[^\]\"'<]|{_VALUE}|<!--(?:[^-]|-(?!-))*+-->|<[!?](?!--)(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>)*+)\]\s*+)?>)"
)
_ATTRIBUTE = re.compile(rf"({_NAME})\s*+=\s*+({_VALUE})")
_DECLARATION = re.compile(
    r"<\?xml\s+version\s*=\s*(?:\"1\.[0-9]+\"|'1\.[0-9]+')(?:\s+encoding\s*=\s*(?:\"[A-Za-z][\w.-]*\"|'[A-Za-z][\w.-]*'))?"
    r"(?:\s+standalone\s*=\s*(?:\"(?:yes|no)\"|'(?:yes|no)'))?\s*\?>"
)
_ENTITY = re.compile(rf"<!ENTITY\s+({_NAME})\s")
_REFERENCE = re.compile(rf"&(?:\#(?:([0-9]++)|x([0-9a-fA-F]++));|({_NAME});)?+")
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _bad_reference(text: str, entities: set[str]) -> bool:
    """Whether an ampersand begins no reference, or one to nothing."""
    for m in _REFERENCE.finditer(text):
        if m[3]:
            if m[3] not in entities:
                return True
        elif m[1] or m[2]:
            n = int(m[1]) if m[1] else int(m[2], 16)
            if n > 0x10FFFF or n < 0x20 and n not in (9, 10, 13) or 0xD800 <= n <= 0xDFFF or n in (0xFFFE, 0xFFFF):
                return True
        else:
            return True
    return False


def xml_error(text: str) -> Error | None:
    """The kind and line of the first error of an XML text without byte-order mark, or None."""

    def wrong(what: str, at: int) -> Error:
        return what, text.count("\n", 0, at) + 1

    stack: list[str] = []
    entities = {"amp", "lt", "gt", "quot", "apos"}
    seen_root = seen_doctype = False
    if strange := _NOT_XML.search(text):
        return wrong("character outside of literals", strange.start())
    at = 0
    if declaration := _DECLARATION.match(text):
        at = declaration.end()
    while True:
        tag = text.find("<", at)
        between = text[at : tag if tag >= 0 else len(text)]
        if stack:
            if "]]>" in between or "&" in between and _bad_reference(between, entities):
                return wrong("against the grammar", at)
        elif between.strip(" \t\r\n"):
            return wrong("text outside of the root element", at)
        if tag < 0:
            break
        m = _TAG.match(text, tag)
        if not m:
            return wrong("malformed or unterminated markup", tag)
        at = m.end()
        if m["open"] is not None:
            if not stack and seen_root:
                return wrong("second root element", tag)
            seen_root = True
            if m["attributes"]:
                names = set()
                for name, value in _ATTRIBUTE.findall(m["attributes"]):
                    if name in names or "&" in value and _bad_reference(value, entities):
                        return wrong("against the grammar", tag)
                    names.add(name)
            if not m["empty"]:
                stack.append(m["open"])
        elif m["close"] is not None:
            if not stack or stack.pop() != m["close"]:
                return wrong("tags that do not fit", tag)
        elif m["data"] is not None:
            if not stack:
                return wrong("text outside of the root element", tag)
        elif m["target"] is not None:
            if m["target"].lower() == "xml":
                return wrong("declaration behind the beginning", tag)
        elif m["doctype"] is not None:
            if seen_root or seen_doctype:
                return wrong("document type behind the root element", tag)
            seen_doctype = True
            entities |= set(_ENTITY.findall(m["subset"] or ""))
    if stack or not seen_root:
        return wrong("premature end: open element" if stack else "no root element", len(text))
    return None
