"""Source files that do not parse.

Each language has a lexer and a pushdown stack, and they alone decide. Python, JSON and XML are read
by automata of their whole grammar (``syntax_python``, ``syntax_data``). In the brace languages the
lexer knows comments and literals, also nested ones, and what a preprocessor does to brackets; what
it leaves, code without texts, is read by a stack of brackets and by rules on neighbouring tokens.
Found are unterminated literals and comments, unbalanced delimiters, a premature end,
merge-conflict markers, characters that the language does not have, operators and words that miss
an operand or a name, unrendered template fields, listings with line numbers, and text of another
language.

Per row this is a helper over one text; Spark spreads the files. The text goes to Python in Arrow
batches once, and only the kind and line of the first error come back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import code_language
from corvane.llm.syntax_data import json_error, xml_error
from corvane.llm.syntax_python import python_error
from corvane.session import ship_package, spread

#: Languages that are checked; others have no error.
CHECKED = ("python", "javascript", "typescript", "cpp", "c_sharp", "go", "json", "xml")

_OPEN = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")
_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|\|{7})(?: |\r?$)|^={7}\r?$")
_LISTING = re.compile(r"\A\s*1 *\| ?[^\n]*\n\s*2 *\|")
_STRANGE = re.compile("[\x00-\x08\x0e-\x1f�“”‘’…–—«»]")
_FIELD = re.compile(r"\{\{\s*[A-Za-z_]\w*\s*\}\}")

# Literals and comments. The group ``bad`` takes what begins one that does not end.
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_LINE = r"//[^\n]*"
_DOUBLE = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*'"
_REGEX = (
    r"(?:(?<=[=(,:;!&|?{}\[+\n>])|(?<=[=(,:;!&|?{}\[+\n>][ \t])|(?<=return )|(?<=return))"
    r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
)
_LEXERS = {
    "javascript": re.compile(rf"(?P<c>{_BLOCK}|{_LINE})|(?P<s>{_DOUBLE}|{_SINGLE}|{_REGEX})|(?P<bad>/\*|[\"'`])"),
    "go": re.compile(rf"(?P<c>{_BLOCK}|{_LINE})|(?P<s>{_DOUBLE}|`[^`]*`|{_SINGLE})|(?P<bad>/\*|[\"'`])"),
    "cpp": re.compile(
        rf"(?P<c>{_BLOCK}|{_LINE})|(?P<p>(?m:^)[ \t]*\#(?:[^\n\\]|\\\r?\n|\\)*)|"
        rf"(?P<s>R\"(?P<d>[^(\s]{{0,16}})\([\s\S]*?\)(?P=d)\"|{_DOUBLE}|(?<![0-9a-fA-F]){_SINGLE}|(?<=[0-9a-fA-F])'(?=[0-9a-fA-F]))|(?P<bad>/\*|[\"'])"
    ),
    "c_sharp": re.compile(
        rf"(?P<c>{_BLOCK}|{_LINE})|(?P<p>(?m:^)[ \t]*\#[ \t]*(?:if|elif|else|endif|define|undef|warning|error|line|region|endregion|pragma|nullable)\b[^\n]*)|"
        rf"(?P<s>\$*\"{{3,}}[\s\S]*?\"{{3,}}|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|"
        r'\$"(?:[^"\\\n{}]|\\.|\{\{|\}\}|\{(?:[^{}"\n]|"(?:[^"\\\n]|\\.)*")*\})*"|'
        rf"{_DOUBLE}|{_SINGLE})|(?P<bad>/\*|[\"'])"
    ),
}
_LEXERS["typescript"] = _LEXERS["javascript"]
#: Steps through a template literal, and through the code of its fields.
_IN_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?P<quote>`)|(?P<open>\$\{)|\\[\s\S]|\$)")
_IN_FIELD = re.compile(rf"(?:[^`'\"{{}}/]|/(?![/*]))*+(?:(?P<quote>`)|(?P<open>\{{)|(?P<close>\}})|{_BLOCK}|{_LINE}|{_DOUBLE}|{_SINGLE})")
#: Macros, and directives that choose between branches.
_DEFINE = re.compile(r"[ \t]*\#[ \t]*define[ \t]+(\w+)(?:\([^)]*\))?(.*)\Z", re.S)
_BRANCH = re.compile(r"[ \t]*\#[ \t]*(if(?:n?def)?|elif(?:n?def)?|else|endif)\b[ \t]*(0\b)?")
#: What stands in the code for the beginning of a choice, of another branch, and the end of it.
_IF, _ELSE, _ENDIF = "\ue000", "\ue001", "\ue002"
_CHOICE = re.compile(rf"{_IF}([^{_IF}{_ENDIF}{_ELSE}]*)((?:{_ELSE}[^{_IF}{_ENDIF}{_ELSE}]*)*){_ENDIF}")

# Words, as fixed values of the languages.
_JS_BEFORE = (
    "let const var function class return typeof new delete void throw case in of instanceof import export default "
    "from as async await yield extends implements interface type enum namespace module abstract declare readonly "
    "public private protected static get set keyof infer is asserts else do override accessor satisfies unique "
    "require global break continue using"
).split()
_JS_AFTER = "in of instanceof as from is extends implements satisfies else catch finally while".split()
_CPP_WORDS = (
    "alignas auto bool char char8_t char16_t char32_t class const consteval constexpr constinit decltype double else "
    "enum explicit export extern final float friend goto inline int long mutable namespace new noexcept operator "
    "override private protected public register return short signed sizeof static struct template thread_local "
    "throw typedef typename union unsigned using virtual void volatile wchar_t co_await co_return co_yield case "
    "delete typeid and or not requires concept do try catch import module asm"
).split()
_CS_WORDS = (
    "abstract as async await base bool byte case catch char checked class const decimal default delegate do double "
    "else enum event explicit extern finally fixed float foreach from get global goto group implicit in init int "
    "interface internal into is join let lock long namespace new not and or object on operator orderby out override "
    "params partial private protected public readonly record ref required return sbyte sealed select set short "
    "sizeof stackalloc static string struct switch throw typeof uint ulong unchecked unmanaged unsafe ushort using "
    "var virtual void volatile when where while with yield nint nuint file scoped by equals ascending descending "
    "dynamic this assembly"
).split()
_GO_WORDS = "chan const defer else func go goto import interface map package range return struct type var case select".split()


_JS_BEFORE_SET, _JS_AFTER_SET = frozenset(_JS_BEFORE), frozenset(_JS_AFTER)
#: Neighbouring words of one line; the rules on them are looked up in sets.
_PAIR = re.compile(r"(?<![\w$.#@])([\w$]++)[ \t]++(?=([\w$]++|\"\"))")
_TRIPLE = re.compile(r"(?<![\w.:>])([^\W\d]\w*+)(?=[ \t]++([^\W\d]\w*+)[ \t]++([^\W\d]\w*+))")
_THREE_NAMES = {"cpp": frozenset(_CPP_WORDS), "c_sharp": frozenset(_CS_WORDS), "go": frozenset(_GO_WORDS)}

# Rules on how lines begin, one expression a language.
_C_LINES = (
    r"def \w+\(|async def|from [\w.]+ import\b|import[ \t]+[\w.]+[ \t]*$|import[ \t]*[{*]|import[ \t]+\"\"|"
    r"package \w+[ \t]*$|func[ \t(]|elif\b|<[!/a-zA-Z]|export[ \t]+(?:const|class|function|default|interface|async)\b|"
    r"(?:const|let|var)[ \t]+\w+[ \t]*=[ \t]*[\[{]|interface[ \t]+\w+[ \t]*\{[^}]*\w+\??[ \t]*:|"
    r"function\b|(?:if|for|while|with|try|else|class|match|except)\b[^\n;{}]*:[ \t]*$"
)
_LINES = {
    "javascript": (
        r"\#(?:include|define|pragma|if|endif)\b|def \w|using [\w.]+;|package \w+[ \t]*$|func \w|elif\b|"
        r"from [\w.]+ import\b|@\w+\n[ \t]*(?:async )?def |<[!/a-zA-Z]|import[ \t]+[\w.]+[ \t]*$"
    ),
    "cpp": _C_LINES
    + r"|using[ \t]+(?!namespace\b|enum\b)[\w.]+;|namespace[ \t]+\w+\.\w|(?:public|private|protected|internal)[ \t]+(?!:)\w",
    "c_sharp": _C_LINES + r"|(?:public|private|protected)[ \t]*:|\#[ \t]*(?:include|pragma once)",
    "go": r"class[ \t]+\w|while[ \t(]|def[ \t]+\w+\(|try\b[ \t]*\{|public[ \t]|private[ \t]|\#",
}
_LINES["typescript"] = _LINES["javascript"]
_LINES = {k: re.compile(rf"(?m)^[ \t]*+(?:{v})") for k, v in _LINES.items()}
#: Lines that only TypeScript has, not JavaScript.
_TS_LINES = re.compile(
    r"(?m)^[ \t]*+(?:(?:export[ \t]+)?(?:interface|declare|abstract[ \t]+class|namespace|enum)[ \t]+\w|"
    r"(?:export[ \t]+)?type[ \t]+\w+[ \t]*(?:<[^>\n]*>)?[ \t]*=|(?:public|private|protected|readonly)[ \t]+\w)"
)
#: Rules on what stands anywhere: a piece of text that has to be there, and the expression.
_ANYWHERE = {
    "javascript": [
        (":=", None),
        ("::", None),
        ("export", r"\bexport[ \t]+(?!(?:default|const|let|var|function|class|async|type|interface|enum|abstract|declare|namespace|import|as)\b)\w"),
        ("->", r"\)[ \t]*->"),
        ("] ", r"\][ \t]+(?!(?:in|of|instanceof|as|from|is|extends|implements|satisfies|else|catch|finally|while)\b)[\w$]"),
        ("static", r"(?m)^static\b"),
        ('""', r"\A\s*\{\s*\"\"\s*:"),
    ],
    "cpp": [
        ("===", None),
        ("=>", None),
        (":= ", None),
        ("foreach", r"\bforeach[ \t]*\("),
        ("]", r"=[ \t]*\[[ \t]*\][ \t]*;"),
        ("var", r"\bvar[ \t]+\w+[ \t]*="),
        ("", r"\A\s*(?:\{|\[(?!\[))"),
    ],
    "c_sharp": [
        ("===", None),
        (":= ", None),
        ("::", r"(?<!\bglobal)::"),
        ("->", r"->[ \t]*\w+[ \t]*\{"),
        ("auto", r"\bauto[ \t&*]+\w+[ \t]*="),
        ("const", r"\bstatic[ \t]+const\b"),
        ("[]", r"\w[ \t]+\w+\[\][ \t]*="),
        ("", r"\A\s*(?:\{|\[[ \t\n]*(?:\"\"|[-\d\[{]))"),
    ],
    "go": [("=>", None), ("===", None), ("??", None), ("else", r";[ \t]*\n[ \t]*else\b")],
}
_ANYWHERE["typescript"] = _ANYWHERE["javascript"]
#: The same for what is TypeScript and not JavaScript.
_TS_ANYWHERE = [
    (":", r"\b(?:const|let|var)[ \t]+\w+[ \t]*:"),
    (":", r"\([ \t]*(?:\.\.\.)?\w+\??[ \t]*:[ \t]*[\w\[{]"),
    ("):", r"\):[ \t]*[\w<>\[\]|., \t]+(?:\{|=>)"),
    (" as ", r"\bas[ \t]+(?:any|const|unknown|string|number|boolean)\b"),
]
_ANYWHERE, _TS_ANYWHERE = (
    {k: [(x, re.compile(r) if r else None) for x, r in v] for k, v in _ANYWHERE.items()},
    [(x, re.compile(r)) for x, r in _TS_ANYWHERE],
)
#: Neighbouring tokens that no grammar rule of the language brings together.
_JS_NUMBER = r"(?>0[xX][\da-fA-F_]++n?|0[oO][0-7_]++n?|0[bB][01_]++n?|\d[\d_]*+n|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][-+]?\d[\d_]*+)?)"
_GO_NUMBER = r"(?>0[xX][\da-fA-F_.]++(?:[pP][-+]?\d++)?i?|0[oO][0-7_]++i?|0[bB][01_]++i?|(?:\d[\d_]*+\.?[\d_]*+|\.\d[\d_]*+)(?:[eE][-+]?\d++)?i?)"
_CS_NUMBER = r"(?>0[xX][\da-fA-F_]++(?:[uU][lL]?|[lL][uU]?)?|0[bB][01_]++(?:[uU][lL]?|[lL][uU]?)?|\d[\d_]*+(?:\.\d[\d_]*+)?(?:[eE][-+]?\d++)?(?:[uU][lL]?|[lL][uU]?|[fFdDmM])?)"
_FLAT = r"[^()\[\]{}<>;]*?"
_NO_OPERAND = (
    r"(?<![=!<>\[&+\-*/%|^?])(?<!operator)=\s*[;),}]|(?<![-+*/%<.])(?<!operator)[-+%](?![-+=])\s*[;)\]]|\(\s*,(?!\s*\.\.\.)|"
    r"(?<![A-Z0-9_])\(" + _FLAT + r",\s*,|(?<![\w$.#@])return\s*[)\],]"
)
_NO_CONDITION = r"|(?<![\w$.#@>])(?:if|while|switch)\s*(?:\{|\(\s*\)\s*\{)"
_NO_NAME = r"|(?<![\w$.])(?:var|const)\s*[=;,)]|=\s*\]"
_DEREFERENCED = r"|[-+%]\s*\*\s*\d"
_OPEN_LIST = r"|(?<![A-Z0-9_])\(" + _FLAT + r",\s*\)"
_NEIGHBOURS = {
    "javascript": _NO_OPERAND + _NO_CONDITION + _NO_NAME + r"|(?<![\w$.#])" + _JS_NUMBER + r"(?=[A-Za-z_$])|"
    r"(?<![-+])[-+%]\s*[*%](?![*=])|\bfunction[ \t]+[\w$]+\s*\{",
    "go": _NO_OPERAND + _NO_NAME + _DEREFERENCED + r"|(?<![\w.])" + _GO_NUMBER + r"(?=[A-Za-z_])|\bfunc[ \t]+\w+\s*(?:\(\s*)?\{",
    "cpp": _NO_OPERAND + _NO_CONDITION + _DEREFERENCED + _OPEN_LIST,
    "c_sharp": _NO_OPERAND + _NO_CONDITION + _DEREFERENCED + _OPEN_LIST + r"|(?<![\w.])" + _CS_NUMBER + r"(?=[A-Za-z_])|=\s*\]",
}
_NEIGHBOURS["typescript"] = _NEIGHBOURS["javascript"]
_NEIGHBOURS = {k: re.compile(v) for k, v in _NEIGHBOURS.items()}
_JS_TAIL = re.compile(
    r"(?:[-+*/%=&|^<>?:,.!~(\[{]|\b(?:import|export|default|function|class|const|let|var|new|return|typeof|throw|"
    r"async|await|extends|if|else|for|while|switch|case|try|catch|in|of|from|interface|type|enum))\Z"
)
_GO_HEAD = re.compile(r"\A\s*package[ \t]+[^\W\d]\w*[ \t]*(?:[;\n]|\Z)")
_GO_TAIL = re.compile(r"(?:[-+*/%=&|^<>!,.:(\[{]|\b(?:import|func|type|var|const|package|struct|return|if|for|switch|case|go|defer|range|else))\Z")
_GO_LINE = re.compile(r"(?m)^(?!package\b|import\b|func\b|type\b|var\b|const\b|[})\s]|\Z)")
_MAY_BEGIN = {"javascript": re.compile(r"[\"'`/]"), "go": re.compile(r"[\"'`/]"), "cpp": re.compile(r"[\"'/#]"), "c_sharp": re.compile(r"[\"'/#$@]")}
_MAY_BEGIN["typescript"] = _MAY_BEGIN["javascript"]


def _anywhere(code: str, rules: list[tuple[str, re.Pattern | None]]) -> int:
    """Where the first of the rules holds, or -1."""
    for must, rule in rules:
        at = code.find(must)
        if at >= 0 and rule is not None:
            m = rule.search(code)
            at = m.start() if m else -1
        if at >= 0:
            return at
    return -1


def _side_by_side(code: str, language: str) -> int:
    """Where words stand side by side that no grammar rule of the language brings together: two
    operands in JavaScript, three plain names elsewhere. -1 if nowhere."""
    if language in ("javascript", "typescript"):
        before, after = _JS_BEFORE_SET, _JS_AFTER_SET
        if not any(a not in before and b not in after for a, b in _PAIR.findall(code)):
            return -1
        return next(m.start() for m in _PAIR.finditer(code) if m[1] not in before and m[2] not in after)
    words = _THREE_NAMES[language]
    if not any(a not in words and b not in words and c not in words for a, b, c in _TRIPLE.findall(code)):
        return -1
    return next(m.start() for m in _TRIPLE.finditer(code) if not words.intersection(m.groups()))


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _template_end(text: str, at: int) -> int:
    """Behind the template literal that begins at ``at``, by a stack of literals and fields; -1 if
    it does not end."""
    stack = ["`"]
    at += 1
    while stack:
        m = (_IN_TEMPLATE if stack[-1] == "`" else _IN_FIELD).match(text, at)
        if not m:
            return -1
        at = m.end()
        if m["open"]:
            stack.append("{")
        elif m["quote"] and stack[-1] != "`":
            stack.append("`")
        elif m["quote"] or m.groupdict().get("close"):
            stack.pop()
    return at


def texts_of(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of each comment (``c``), literal (``s``) and directive (``p``) of a text in a
    brace language; the last one is ``bad`` if a literal or comment begins that does not end."""
    lexer, begins = _LEXERS[language], _MAY_BEGIN[language]
    at = 0
    while found := begins.search(text, at):
        a = found.start()
        if found[0] == "`" and language != "go":
            kind, at = "s", _template_end(text, a)
            if at < 0:
                kind, at = "bad", len(text)
        else:
            m = lexer.match(text, a)
            if not m:
                at = found.end()
                continue
            kind, at = m.lastgroup, m.end()
        yield ("s" if kind == "d" else kind), a, at
        if kind == "bad":
            return


def _stripped(text: str, language: str) -> tuple[str, int, dict[str, str]]:
    """The code without texts: comments become blanks, literals ``""``; where a literal begins that
    does not end, or -1; and the brackets that macros leave open or close. Line ends are kept, so
    positions of lines stay. Branches of the preprocessor are marked."""
    parts, last = [], 0
    macros: dict[str, str] = {}
    for kind, a, b in texts_of(text, language):
        parts.append(text[last:a])
        if kind == "bad":
            return "".join(parts), a, macros
        if kind == "p":
            parts.append(_directive(text[a:b], macros))
        else:
            parts.append(" " if kind == "c" else '""')
        lines = text.count("\n", a, b)
        if lines:
            parts.append("\n" * lines)
        last = b
    parts.append(text[last:])
    return "".join(parts), -1, macros


def _directive(line: str, macros: dict[str, str]) -> str:
    """What stands for a preprocessor directive; macros with brackets that do not fit are noted."""
    if m := _DEFINE.match(line):
        net = re.sub(r"[^()\[\]{}]", "", re.sub(rf"{_DOUBLE}|{_SINGLE}", "", m[2]))
        while net != (net := net.replace("()", "").replace("[]", "").replace("{}", "")):
            pass
        if net:
            macros[m[1]] = net
    elif m := _BRANCH.match(line):
        return _ENDIF if m[1] == "endif" else (_IF + _ELSE if m[2] else _IF) if m[1].startswith("if") else _ELSE
    return " "


def _one_branch(code: str) -> str:
    """The code with the first branch of each choice only; lines stay."""

    def first(m: re.Match) -> str:
        return m[1] + "\n" * m[2].count("\n")

    while code != (code := _CHOICE.sub(first, code)):
        pass
    return code


def _unbalanced(code: str) -> tuple[str, int] | None:
    """The first bracket that does not fit, by a stack of what has to close."""
    stack: list[tuple[str, int]] = []
    for m in _BRACKET.finditer(code):
        c = m[0]
        close = _OPEN.get(c)
        if close:
            stack.append((close, m.start()))
        elif not stack:
            return "closing bracket without opening one", m.start()
        elif stack.pop()[0] != c:
            return "brackets that do not fit", m.start()
    if stack:
        return "premature end: open bracket", stack[-1][1]
    return None


def _first(code: str, *rules: tuple[str, re.Pattern]) -> tuple[str, int] | None:
    for what, rule in rules:
        m = rule.search(code)
        if m:
            return what, m.start()
    return None


def _brace_language(text: str, language: str) -> tuple[str, int] | None:
    code, bad, macros = _stripped(text, language)
    bracketed = code
    if _IF in code:
        bracketed = _one_branch(code)
        code = code.translate({ord(c): " " for c in (_IF, _ELSE, _ENDIF)})
    if macros:
        bracketed = re.sub(r"\b(?:" + "|".join(map(re.escape, macros)) + r")\b", lambda m: macros[m[0]], bracketed)
    marker = _first(code, ("merge conflict", _CONFLICT))
    if marker:
        return marker[0], _line(code, marker[1])
    if bad >= 0:
        return "unterminated comment" if text.startswith("/*", bad) else "unterminated literal", _line(text, bad)
    found = (
        _first(code, ("listing with line numbers", _LISTING), ("character outside of literals", _STRANGE))
        or _template_field(code)
        or _unbalanced(bracketed)
        or _first(code, ("operand or name that is missing", _NEIGHBOURS[language]))
    )
    if not found:
        at = m.start() if (m := _LINES[language].search(code)) else _anywhere(code, _ANYWHERE[language])
        if at < 0 and language == "javascript":
            at = m.start() if (m := _TS_LINES.search(code)) else _anywhere(code, _TS_ANYWHERE)
        if at >= 0:
            found = "another language", at
    if not found and (at := _side_by_side(code, language)) >= 0:
        found = "words side by side", at
    if not found:
        end = bracketed.rstrip()
        tail = end[-80:]
        if language in ("javascript", "typescript"):
            early = bool(_JS_TAIL.search(tail))
        elif language == "go":
            if not end:
                return None
            if not _GO_HEAD.search(code):
                return "no package clause", 1
            found = _first(code, ("statement outside of functions", _GO_LINE))
            early = bool(_GO_TAIL.search(tail))
        else:
            early = bool(end) and end[-1] not in "};" and not (
                language == "c_sharp" and re.search(r"\[(?:assembly|module)\b[^\]]*\]\Z", tail)
            )
        if not found and early:
            found = "premature end", len(end) - 1
    if found:
        return found[0], _line(code, found[1])
    return None


def _template_field(code: str) -> tuple[str, int] | None:
    """``{{ name }}`` where a name has to be: after a word, or before a parameter list."""
    for m in _FIELD.finditer(code):
        before = code[max(0, m.start() - 40) : m.start()].rstrip(" \t")
        after = code[m.end() : m.end() + 2].lstrip(" \t")
        if re.search(r"[\w*&]\Z", before) and m.start() and code[m.start() - 1] in " \t*&" or after[:1] == "(":
            return "unrendered template field", m.start()
    return None


def syntax_error(text: str | None, language: str | None) -> tuple[str, int] | None:
    """The kind and line of the first error of a text, or None.

    Null texts and languages that are not checked have none; an empty text is an error in JSON and
    XML only. A byte-order mark and CRLF line ends are none.
    """
    if text is None or language not in CHECKED:
        return None
    text = text.removeprefix("\ufeff")
    if language in ("json", "xml"):
        found = (json_error if language == "json" else xml_error)(text)
    elif not text.strip("\ufeff \t\r\n"):
        return None
    elif language == "python":
        found = python_error(text)
    else:
        return _brace_language(text.replace("\r\n", "\n"), language)
    if found and _CONFLICT.match(text.split("\n", found[1])[found[1] - 1]):
        return "merge conflict", found[1]
    return found


def _errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, languages in batches:
        found = [syntax_error(t, x) or (None, None) for t, x in zip(texts, languages)]
        out = pd.DataFrame(found, columns=["error", "line"])
        out["line"] = out["line"].astype("Int32")
        yield out


def check_syntax(raw_files: DataFrame) -> DataFrame:
    """``file_id, repo_id, path, language, error, line`` of every row whose language is checked.

    ``error`` and ``line`` are null for valid files. The language is that of the path's extension;
    rows with null or other paths are left out, null texts are valid. Repeated rows are kept.
    """
    files = spread(raw_files.select("file_id", "repo_id", "path", "text")).select("file_id", "repo_id", "path", code_language(F.col("path")).alias("language"), "text")
    ship_package(raw_files.sparkSession)
    read = F.pandas_udf(_errors, "struct<error:string,line:int>")
    checked = files.where(F.col("language").isin(*CHECKED)).select(
        "file_id", "repo_id", "path", "language", read("text", "language").alias("e")
    )
    return checked.select("file_id", "repo_id", "path", "language", F.col("e.error").alias("error"), F.col("e.line").alias("line"))


def invalid_rates(checked: DataFrame) -> DataFrame:
    """Files and invalid files by repository and language; a file with several rows counts once."""
    files = checked.groupBy("repo_id", "language", "file_id").agg(F.max(F.col("error").isNotNull().cast("int")).alias("bad"))
    return files.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("bad").cast("bigint").alias("n_invalid"),
        (F.sum("bad") / F.count(F.lit(1))).alias("rate"),
    )
