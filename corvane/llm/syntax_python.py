"""Python's grammar as a lexer and two pushdown stacks.

The lexer turns each token into one letter. One stack holds open brackets and interpolations of
f-strings: where one closes, what it holds is a flat string of letters, since everything nested in
it is one letter by then, and flat expressions are a regular language, so one regular expression
for each kind of bracket decides. The other stack holds the indentation: blocks open after heads
that end in a colon, and ``else``, ``except`` and the like have to follow what they belong to.
Python means 3.13.
"""

from __future__ import annotations

import re

Error = tuple[str, int]

#: The letter of each keyword and operator. Operators of one class share a letter.
_LETTERS = (
    dict.fromkeys(("None", "True", "False"), "k")
    | dict.fromkeys(("and", "or"), "o")
    | dict.fromkeys(("global", "nonlocal"), "g")
    | dict.fromkeys(("pass", "break", "continue"), "b")
    | {
        "not": "!", "in": "I", "is": "i", "if": "F", "elif": "f", "else": "E", "for": "R", "while": "v", "async": "Y", "await": "Q",
"yield": "y", "from": "M", "import": "m", "as": "A", "with": "h", "def": "d", "class": "c", "return": "r",
        "raise": "z", "del": "x", "assert": "a", "try": "j", "except": "q", "finally": "u",
    }
    | dict.fromkeys(("+", "-"), "+")
    | dict.fromkeys(("/", "//", "%", "<<", ">>", "&", "|", "^"), "/")
    | dict.fromkeys(("<", ">", "<=", ">=", "==", "!="), "<")
    | dict.fromkeys(("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="), "%")
    | {"~": "~", "*": "*", "**": "^", "@": "@", "=": "=", ":=": "W", "->": ">", ".": ".", ",": ",", ":": ":", ";": ";", "...": "e"}
)

_TOKEN = re.compile(
    r"""[ \t\f]*+(?:(?P<name>(?![rRbBuUfF]{1,2}["'])[^\W\d][\w\u00b7\U000e0100-\U000e01ef]*+)|(?P<newline>\n)|
    (?P<op>\*\*=?|//=?|>>=?|<<=?|\.\.\.|:=|->|[-+*/%@&|^]=|[<>=!]=|[-+*/%@&|^~<>=,:;]|\.(?!\d))|
    (?P<open>[(\[{])|(?P<close>[)\]}])|
    (?P<string>(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|
        "(?!"")(?:[^"\\\n]|\\[\s\S])*+"|""(?!")|'(?!'')(?:[^'\\\n]|\\[\s\S])*+'|''(?!')))|
    (?P<format>(?:[fF][rR]?|[rR][fF])(?:\"{3}|'{3}|"|'))|
    (?P<quote>[rRbBuUfF]{0,2}["'])|
    (?P<number>(?:0[xX](?:_?[0-9a-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|
        (?:(?:\d(?:_?\d)*+)?\.\d(?:_?\d)*+|\d(?:_?\d)*+\.?)(?:[eE][+-]?\d(?:_?\d)*+)?[jJ]?))|
    (?P<blank>\\\n|\#[^\n]*+|\Z))""",
    re.X,
)
_BLANKS = re.compile(r"\s*+")
_BAD_NUMBER = re.compile(r"0\d[\d_]*\Z(?<!0)|0[\d_]*[1-9][\d_]*\Z")
_BAD_ESCAPE = re.compile(r"(?:\\x(?![0-9a-fA-F]{2})|\\u(?![0-9a-fA-F]{4})|\\U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|\\N(?!\{[^{}\n]+\}))")
#: The text of an f-string up to an interpolation or its end, by its quotes; and that of a format.
_LITERAL, _SPEC = {}, {}
for _q in ('"', "'", '"""', "'''"):
    _plain = rf"[^{_q[0]}\\{{}}\n]" if len(_q) == 1 else rf"[^{_q[0]}\\{{}}]|{_q[0]}(?!{_q[0] * 2})"
    _LITERAL[_q] = re.compile(rf"(?:{_plain}|\\N\{{[^}}\n]*\}}|\\[^{{}}]|\\(?=[{{}}])|\{{\{{|\}}\}})*+")
    _SPEC[_q] = re.compile(rf"(?:{_plain}|\\[^{{}}])*+")


def _list(item: str) -> str:
    return rf"{item}(?:,{item})*+,?"


# Flat expressions, on letters: P, L, D are brackets that stand as operands, C and X calls and
# subscripts behind one, n names, k constants, 0 and e other literals, s strings, l heads of lambdas.
_PRIMARY = r"Q?(?:[nk0ePLD]|s++)(?:[CX]|\.n)*+"
_UNARY = rf"[+~]*+{_PRIMARY}"
_SUM = rf"{_UNARY}(?:[-+*/@^]{_UNARY})*+"
_COMPARED = rf"!*+{_SUM}(?:(?:<|!?I|i!?){_SUM})*+"
_OR = rf"{_COMPARED}(?:o{_COMPARED})*+"
_EXPR = rf"l*+{_OR}(?:F{_OR}El*+{_OR})*+"
_NAMED = rf"(?:nW)?{_EXPR}"
_STARRED = rf"(?:[*]{_OR}|{_NAMED})"
_TARGET = rf"[*]?{_PRIMARY}(?<=[nXPL])"
_TARGETS = _list(rf"(?:{_TARGET})")
_FOR = rf"(?:Y?R{_TARGETS}I{_OR}(?:F{_OR})*+)++"
_ROW = _list(rf"(?:[*]{_OR}|{_EXPR})")
_YIELD = rf"y(?:M{_EXPR}|{_ROW})?"
_RIGHT = rf"(?:{_YIELD}|{_ROW})"
_POSITIONAL, _KEYWORD, _STARS = rf"(?:[*]{_EXPR}|(?!n=){_NAMED})", rf"(?:n={_EXPR}|[*]{_EXPR})", rf"(?:n={_EXPR}|\^{_EXPR})"
_NOTE = rf"(?::{_EXPR})?"
_END = r"(?:,|\Z)"
_ALIASES = _list(r"n(?:An)?")
#: What each kind of bracket may hold.
_HOLDS = {
    kind: re.compile(rf"(?:{rule})\Z")
    for kind, rule in {
        "P": rf"(?![*]{_OR}\Z)(?:{_YIELD}|{_list(_STARRED)}|{_NAMED}{_FOR})?",
        "L": rf"(?:{_list(_STARRED)}|{_NAMED}{_FOR})?",
        "D": rf"(?:{_list(rf'(?:{_EXPR}:{_EXPR}|\^{_OR})')}|{_EXPR}:{_EXPR}{_FOR}|{_list(_STARRED)}|{_NAMED}{_FOR})?",
        "C": rf"(?:{_NAMED}{_FOR}|(?:{_POSITIONAL}{_END})*+(?:{_KEYWORD}{_END})*+(?:{_STARS}{_END})*+)",
        "X": _list(rf"(?:(?:{_EXPR})?:(?:{_EXPR})?(?::(?:{_EXPR})?)?|[*]{_OR}|{_NAMED})"),
        "p": rf"(?:(?:n{_NOTE}(?!=)|/){_END})*+(?:(?:n{_NOTE}={_EXPR}|/){_END})*+"
        rf"(?:(?:[*]n(?::(?:[*]{_OR}|{_EXPR}))?|[*](?=,n)){_END}(?:n{_NOTE}(?:={_EXPR})?{_END})*+)?(?:\^n{_NOTE}{_END})?",
        "T": _list(rf"(?:[*^]?n{_NOTE}(?:=[*]?{_EXPR})?)"),
        "l": rf"(?:{_list(rf'(?:n(?:={_EXPR})?|[*]n?|\^n|/)')})?",
        "N": _ALIASES,
        "H": rf"(?:{_list(rf'{_EXPR}(?:A{_TARGET})?')}|{_YIELD}|{_list(_STARRED)}|{_NAMED}{_FOR})?",
        "f": rf"{_RIGHT}=?V?",
    }.items()
}
_DOTTED = r"n(?:\.n)*+"
_SIMPLE = re.compile(
    rf"(?:{_ROW}|(?:{_TARGETS}=)+{_RIGHT}|{_PRIMARY}(?<=[nXP]):{_EXPR}(?:={_RIGHT})?|{_PRIMARY}(?<=[nX])%{_RIGHT}|{_YIELD}|b|r(?:{_ROW})?|"
    rf"z(?:{_EXPR}(?:M{_EXPR})?)?|gn(?:,n)*+|x{_TARGETS}|a{_EXPR}(?:,{_EXPR})?|m{_DOTTED}(?:An)?(?:,{_DOTTED}(?:An)?)*+|"
    rf"M(?:[.e]*{_DOTTED}|[.e]+)m(?:[*]|N|n(?:An)?(?:,n(?:An)?)*+))\Z"
)
_ALIAS = re.compile(rf"nnT?={_EXPR}\Z")
#: Heads of compound statements, by their first letter.
_HEADS = {
    first: re.compile(rule + ":")
    for first, rule in {
        "F": rf"F{_NAMED}", "f": rf"f{_NAMED}", "v": rf"v{_NAMED}", "E": "E", "j": "j", "u": "u", "q": rf"q(?:[*]?{_EXPR}(?:An)?)?",
        "R": rf"R{_TARGETS}I{_ROW}", "h": rf"h{_EXPR}(?:A{_TARGET})?(?:,{_EXPR}(?:A{_TARGET})?)*+", "d": rf"dnT?p(?:>{_EXPR})?", "c": "cnT?C?",
    }.items()
}
_DECORATOR = re.compile(rf"@{_NAMED}\Z")
_MATCH = re.compile(rf"n(?:[CX](?:[CX]|\.n)*+(?:[-+*/@^]{_UNARY})*+(?:,(?:{_STARRED})?)*+|{_list(_STARRED)}):\Z")
# Patterns of ``case``.
_VALUE = r"(?:[+]?0(?:[+]0)?|s++|k|n(?:\.n)*+)"
_PATTERN = rf"(?:{_VALUE}C?|[PLD])(?:/(?:{_VALUE}C?|[PLD]))*+(?:An)?"
_PATTERNS = _list(rf"(?:[*]n|{_PATTERN})")
_IN_CASE = {
    "P": re.compile(rf"(?:{_PATTERNS})?\Z"),
    "L": re.compile(rf"(?:{_PATTERNS})?\Z"),
    "C": re.compile(rf"(?:{_list(rf'(?:n=)?{_PATTERN}')})?\Z"),
    "D": re.compile(rf"(?:{_list(rf'(?:{_VALUE}:{_PATTERN}|\^n)')})?\Z"),
}
_CASE = re.compile(rf"n{_PATTERNS}(?:F{_NAMED})?:")
#: What has to stand before a follower, and what stands there after each head.
_AFTER = {"f": {"if"}, "E": {"if", "loop", "except"}, "q": {"try", "except"}, "u": {"try", "except", "else"}}
_LEAVES = {"F": "if", "f": "if", "R": "loop", "v": "loop", "j": "try", "q": "except"}


class _Wrong(Exception):
    pass


class _Blocks:
    """The stack of indentation: its columns, what the last statement was, whether it is a match."""

    def __init__(self):
        self.stack = [[0, 0, "", False]]
        self.wanted = self.match = self.decorated = False

    def enter(self, indent: str) -> None:
        column = alternative = 0
        for c in indent:
            column = column // 8 * 8 + 8 if c == "\t" else 0 if c == "\f" else column + 1
            alternative = 0 if c == "\f" else alternative + 1
        top = self.stack[-1]
        if self.wanted:
            if column <= top[0] or alternative <= top[1]:
                raise _Wrong("expected an indented block")
            self.stack.append([column, alternative, "", self.match])
            self.wanted = False
            return
        if column > top[0]:
            raise _Wrong("unexpected indent")
        while column < self.stack[-1][0]:
            self.leave()
        if [column, alternative] != self.stack[-1][:2]:
            raise _Wrong("indentation that fits no block")

    def leave(self) -> None:
        if self.stack.pop()[2] == "try":
            raise _Wrong("try without except or finally")

    def statement(self, line: str, first: str) -> None:
        """One logical line: a compound head, with or without statements behind it, or statements."""
        block = self.stack[-1]
        start = line[1:] if line[0] == "Y" and line[1:2] in ("d", "R", "h") else line
        letter = start[0]
        if letter in _AFTER:
            if block[2] not in _AFTER[letter]:
                raise _Wrong("clause without its statement")
        elif block[2] == "try":
            raise _Wrong("try without except or finally")
        if self.decorated and letter not in "dc@":
            raise _Wrong("decorator without definition")
        self.decorated = letter == "@"
        before, block[2] = block[2], ""
        if self.decorated:
            if not _DECORATOR.match(line):
                raise _Wrong("against the grammar")
            return
        self.match = False
        head = _HEADS[letter].match(start) if letter in _HEADS else None
        if block[3]:
            head = _CASE.match(line) if first == "case" else None
            if not head:
                raise _Wrong("match without cases")
        elif first == "match" and _MATCH.match(line):
            self.wanted = self.match = True
            return
        elif letter in _HEADS and not head:
            raise _Wrong("against the grammar")
        if not head:
            self.simple(line, first)
            return
        block[2] = "else" if letter == "E" and before == "except" else _LEAVES.get(letter, "")
        rest = start[head.end() :]
        if rest:
            self.simple(rest, "")
        else:
            self.wanted = True

    def simple(self, line: str, first: str) -> None:
        parts = line.split(";")
        if len(parts) > 1 and not parts[-1]:
            parts.pop()
        for part in parts:
            if not _SIMPLE.match(part) and not (first == "type" and _ALIAS.match(part)):
                raise _Wrong("against the grammar")

    def end(self) -> None:
        if self.wanted or self.decorated:
            raise _Wrong("premature end: open block")
        while self.stack:
            self.leave()


def _kind(mark: str, held: list[str]) -> str:
    """What a bracket that opens behind ``held`` is."""
    last = held[-1] if held else ""
    if mark == "{":
        return "D"
    named = held[-2:-1] in (["d"], ["c"]) and last == "n"
    if mark == "[":
        return "T" if named or held[:1] == ["n"] and len(held) == 2 and last == "n" else "X" if last in set("nk0esPLDCXT") else "L"
    if last == "m":
        return "N"
    if last == "h":
        return "H"
    if last == "n" and held[-2:-1] == ["d"] or last == "T" and held[-3:-2] == ["d"]:
        return "p"
    return "C" if last and last in "nk0esPLDCXT" else "P"


def python_error(text: str) -> Error | None:
    """The kind and line of the first error of a text without byte-order mark, or None."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    blocks = _Blocks()
    held: list[str] = []  # letters of the innermost open bracket or line
    stack: list[tuple[str, list[str], str, str, int]] = []  # kind, letters outside, closing mark, quotes, position
    first, in_case = "", False
    at, line_start, size = 0, 0, len(text)
    literal = None  # quotes of the f-string whose text is being read
    spec = False
    try:
        while True:
            if literal is not None:
                at = (_SPEC if spec else _LITERAL)[literal].match(text, at).end()
                if text.startswith("{", at):
                    stack.append(("f", held, "}", literal + (":" if spec else ""), at))
                    held, literal, at = [], None, at + 1
                elif spec and text.startswith("}", at):
                    _, held, _, back, _ = stack.pop()
                    spec, literal, at = back.endswith(":"), back.rstrip(":"), at + 1
                elif not spec and text.startswith(literal, at):
                    held.append("s")
                    at += len(literal)
                    literal = None
                else:
                    raise _Wrong("unterminated literal")
                continue
            if at >= size:
                break
            if stack and stack[-1][0] == "f":
                at = _BLANKS.match(text, at).end()
                if at == size:
                    continue
                if text[at] == ":":
                    if not _HOLDS["f"].match("".join(held)):
                        raise _Wrong("against the grammar")
                    literal, spec, at = stack[-1][3].rstrip(":"), True, at + 1
                    continue
                if text[at] == "!" and text[at + 1 : at + 2] in tuple("rsa") and text[at + 2 : at + 3] in tuple(":} "):
                    held.append("V")
                    at += 2
                    continue
            m = _TOKEN.match(text, at)
            if not m:
                raise _Wrong("character outside of literals")
            kind = m.lastgroup
            token = m[kind]
            if kind == "blank":
                at = m.end()
                continue
            if kind == "newline":
                at = m.end()
                if stack and all(x[0] == "l" for x in stack):
                    raise _Wrong("against the grammar")
                if not stack:
                    if held:
                        blocks.statement("".join(held), first)
                        held.clear()
                    line_start = at
                continue
            if not held and not stack:  # a logical line begins
                blank = text[line_start : m.start(kind)]
                blocks.enter(blank if "\\" not in blank else "")
                first = token if kind == "name" else ""
                in_case = first == "case" and blocks.stack[-1][3]
            at = m.end()
            if kind == "name":
                if not token.isascii() and not token.isidentifier():
                    raise _Wrong("character outside of literals")
                if token == "lambda":  # its parameters are held like those in a bracket, up to the colon
                    stack.append(("l", held, ":", "", m.start(kind)))
                    held = []
                else:
                    held.append(_LETTERS.get(token, "n"))
            elif kind == "op":
                if token == ":" and stack and stack[-1][0] == "l":
                    if not _HOLDS["l"].match("".join(held)):
                        raise _Wrong("against the grammar")
                    held = stack.pop()[1]
                    held.append("l")
                else:
                    held.append(_LETTERS[token])
            elif kind == "string":
                if "\\" in token:
                    _check_escapes(token)
                if token[0] in "bB" or token[1] in "bB" and token[0] in "rR":
                    if not token.isascii():
                        raise _Wrong("literal of bytes with other characters")
                held.append("s")
            elif kind == "number":
                if token.isdigit() and _BAD_NUMBER.match(token) or at < size and (text[at].isalnum() or text[at] == "_") and not re.compile(r"(?:if|else|and|or|in|is|for|not)\b").match(text, at):
                    raise _Wrong("malformed number")
                held.append("0")
            elif kind == "open":
                what = _kind(token, held)
                if in_case and len(held) == 1 and not stack:
                    what = {"C": "P", "X": "L"}.get(what, what)
                stack.append((what, held, {"(": ")", "[": "]", "{": "}"}[token], "", m.end() - 1))
                held = []
            elif kind == "close":
                if not stack:
                    raise _Wrong("closing bracket without opening one")
                what, outside, mark, quotes, _ = stack.pop()
                if mark != token:
                    raise _Wrong("brackets that do not fit")
                in_pattern = in_case and "F" not in (stack[0][1] if stack else outside)
                if not (_IN_CASE if in_pattern and what in _IN_CASE else _HOLDS)[what].match("".join(held)):
                    raise _Wrong("against the grammar")
                held = outside
                if what == "f":
                    literal, spec = quotes.rstrip(":"), quotes.endswith(":")
                else:
                    held.append("P" if what == "H" else what)
            elif kind == "format":
                literal, spec = token.lstrip("fFrR"), False
            else:
                raise _Wrong("unterminated literal")
        if stack:
            at = stack[-1][4]
            raise _Wrong("premature end: open bracket")
        if held:
            blocks.statement("".join(held), first)
        blocks.end()
    except _Wrong as wrong:
        return str(wrong), text.count("\n", 0, max(0, at - 1)) + 1
    return None


def _check_escapes(token: str) -> None:
    quote = min(i for i in (token.find('"'), token.find("'")) if i >= 0)
    prefix = token[:quote].lower()
    if "r" in prefix:
        return
    body = token.replace("\\\\", "")
    wrong = _BAD_ESCAPE.search(body)
    if wrong and ("b" not in prefix or wrong[0][1] == "x"):
        raise _Wrong("malformed escape")
