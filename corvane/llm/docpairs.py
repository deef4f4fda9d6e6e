"""Functions paired with their documentation.

Per file, a lexer first blanks out literals and comments. In what is left regular expressions find
the signatures, and one pass with a stack of (indentation, opener) delimits the bodies: a bracket
ends at the one that closes it, a Python block at the first line that is indented no deeper.
Comments are attached by their distance in lines: nothing but blank lines may lie between. What a
comment says is then judged: empty, placeholder, reminder, pointer, directive, bare tag, ruling
line, disabled code, licence and rewording of the name say nothing.

Spark spreads the files; a file's text goes to Python once and its functions come back as rows,
which join the symbols of the index by file and line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import code_language
from corvane.llm.syntax import texts_of
from corvane.session import ship_package, spread
from corvane.tables import key_of

LANGUAGES = ("python", "javascript", "typescript", "cpp", "c_sharp", "go")

# Repetitions that may not end are possessive, and no two alternatives begin alike: a signature is refused in one pass.
_ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_NOT_NAMES = frozenset(
    "if for while switch catch return function else do try with case new throw sizeof using lock foreach when await "
    "typeof super delete defined alignas decltype static_assert operator fixed checked unchecked nameof and or not".split()
)
_JS_FUNCTION = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<a>[\w$]+)[ \t]*(?:<[^>\n]*>)?\("
_JS_METHOD = (
    r"(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)[ \t]+)*\*?(?P<b>\#?[\w$]+)[ \t]*"
    rf"(?:<[^>\n]*>)?(?={_ARGS}[^;\n{{=()]*+\{{)"
)
_JS_ARROW = (
    r"(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<c>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^)\n]*\)[^=\n]*=>|[\w$]+[ \t]*=>)"
)
_SIGNATURES = {
    "python": re.compile(r"(?m)^(?P<i>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<a>\w+)[ \t]*(?:\[[^\]\n]*\])?\("),
    "javascript": re.compile(rf"(?m)^(?P<i>[ \t]*+)(?:{_JS_FUNCTION}|{_JS_ARROW}|{_JS_METHOD})"),
    "go": re.compile(r"(?m)^(?P<i>)func[ \t]+(?:\([^)\n]*\)[ \t]*)?(?P<a>\w+)[ \t]*(?:\[[^\]\n]*\])?\("),
    "c_sharp": re.compile(
        r"(?m)^(?P<i>[ \t]*+)(?:\[[^\]\n]*\][ \t]*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|"
        r"async|partial|extern|unsafe|new|readonly)[ \t]+)+(?:[\w<>\[\],.? ]+[ \t]+)?(?P<a>\w+)[ \t]*(?:<[^>\n]*>)?\("
    ),
    "cpp": re.compile(
        r"(?m)^(?P<i>[ \t]*+)(?:(?:[\w:~]|<[^<>\n;(]*+(?:<[^<>\n;(]*+>[^<>\n;(]*+)?>)+[*&]*[ \t]+[*&]*)*+(?P<a>[~\w:]+|operator[^\s(]+)[ \t]*"
        rf"(?={_ARGS}(?:const\b|noexcept\b|override\b|final\b|->[^{{;:\n]*+|:[^{{;]*+|[ \t\r\n])*+\{{)"
    ),
}
_SIGNATURES["typescript"] = _SIGNATURES["javascript"]
_FIRST = re.compile(r"(?m)^([ \t]*)(\S)")
_DOCSTRING = re.compile(
    r"(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*[rRuU]?(?P<q>\"\"\"|'''|\"(?!\")|'(?!'))(?P<d>(?:\\[\s\S]|(?!(?P=q))[^\\])*?)(?P=q)|"
    r"(?:[ \t]*(?:\#[^\n]*)?\n)*[ \t]*[rRuU]?(?P<e>\"\"|'')(?![\"'])",
    re.S,
)


#: Comments and literals of Python.
_PYTHON_TEXTS = re.compile(
    r"\#[^\n]*|[rRbBuUfF]{0,2}(?:\"{3}(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"{3}|'{3}(?:[^\\']|\\[\s\S]|'(?!''))*'{3}|"
    r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
)
_DEFINITION = re.compile(r"[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+\w+[ \t]*[(:\[]")
_NOT_BREAK = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()\[\]{}]")
_STOP_AT = re.compile(r"[()\[\]{};]|=>|\n(?=[ \t]*\S)")


def _code_only(text: str, language: str) -> str:
    """The text with literals, comments and directives blanked out; all positions stay."""
    if language == "python":
        return _PYTHON_TEXTS.sub(lambda m: _NOT_BREAK.sub(" ", m[0]), text)
    parts, last = [], 0
    for kind, a, b in texts_of(text, language):
        if kind != "bad":
            parts += [text[last:a], _NOT_BREAK.sub(" ", text[a:b])]
            last = b
    return "".join([*parts, text[last:]])


def _indent(line: str) -> int:
    return len(line[: len(line) - len(line.lstrip())].expandtabs(4))


def _closers(code: str, lines: list[str], starts: list[int]) -> dict[int, int]:
    """Where each bracket ends that opens, by a stack of (indentation of its line, opener). A bracket
    that closes at the head of a line ends none that was opened on a line indented deeper: those
    are left open by mistake and end before that line."""
    stack: list[tuple[int, int, str]] = []
    ends: dict[int, int] = {}
    for m in _BRACKET.finditer(code):
        c, at = m[0], m.start()
        row = bisect_right(starts, at) - 1
        if c in "([{":
            stack.append((_indent(lines[row]), at, {"(": ")", "[": "]", "{": "}"}[c]))
            continue
        leads = not code[starts[row] : at].strip()
        while stack and (stack[-1][2] != c and any(x == c for _, _, x in stack) or leads and stack[-1][0] > _indent(lines[row])):
            ends[stack.pop()[1]] = starts[row] - 1 if leads else at
        if stack and stack[-1][2] == c:
            ends[stack.pop()[1]] = at + 1
    return ends


def _braced_end(code: str, close: int, ends: dict[int, int], language: str, indent: int, arrow: bool) -> int:
    """Where the body ends of a function whose parameter list, or arrow, ends at ``close``."""
    at = close
    while m := _STOP_AT.search(code, at):
        c = m[0]
        at = m.end()
        if c in "([":
            at = ends.get(m.start(), at)
        elif c == "{":
            end = ends.get(m.start(), len(code))
            behind = code[end : end + 200].lstrip()[:1]
            if behind != "{" and not (behind == "," and language == "cpp"):
                return end
            at = end  # a type or a member was in braces
        elif c == ";":
            return at
        elif c in ")]}":
            return m.start()
        elif c == "=>":
            arrow = True
        elif arrow and language != "c_sharp" and _indent(code[at : code.find("\n", at) if code.find("\n", at) >= 0 else len(code)]) <= indent:
            return m.start()  # an expression without braces or semicolon ends with its lines
    return len(code)


def _block_ends(code: list[str], lines: list[str]) -> list[int]:
    """For each line of Python the last line of the block that it heads, by a stack of indentations
    over logical lines: a line that is indented no deeper closes what was opened before it."""
    last = list(range(len(lines)))
    stack: list[tuple[int, int]] = []  # indentation, line
    depth, head = 0, -1
    for k, line in enumerate(code):
        if depth > 0 and _DEFINITION.match(line):  # a bracket before it was left open by mistake
            depth = 0
        if depth <= 0 and line.strip():
            indent = _indent(line)
            while stack and stack[-1][0] >= indent:
                above, row = stack.pop()
                end = k - 1
                while end > row and (not lines[end].strip() or lines[end].lstrip().startswith("#") and _indent(lines[end]) <= above):
                    end -= 1
                last[row] = end
            stack.append((indent, k))
            depth = 0
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
    for above, row in stack:
        end = len(lines) - 1
        while end > row and (not lines[end].strip() or lines[end].lstrip().startswith("#") and _indent(lines[end]) <= above):
            end -= 1
        last[row] = end
    return last


def _comment_above(lines: list[str], first: int) -> list[str]:
    """The comment that ends above line ``first`` (from 0) with only blank lines between."""
    j = first - 1
    while j >= 0 and not lines[j].strip():
        j -= 1
    if j < 0:
        return []
    last = lines[j].strip()
    if last.startswith("//"):
        k = j
        while k > 0 and lines[k - 1].lstrip().startswith("//"):
            k -= 1
        return lines[k : j + 1]
    if last.endswith("*/"):
        k = j
        while k > 0 and "/*" not in lines[k]:
            k -= 1
        return lines[k : j + 1] if lines[k].lstrip().startswith("/*") else []
    return []


_MARK = re.compile(r"^\s*(?:///?!?|/\*+!?|\*+(?!/))[ \t]?|\*+/\s*$")
_XML_TAG = re.compile(r"</?[A-Za-z][\w.]*(?:\s+[\w:]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*/?>")
#: Latin letters with marks and ideographs that run into each other, as bad decoding leaves them.
_MOJIBAKE = re.compile(r"(?:[À-ɏ]+[぀-鿿]+|[぀-鿿]+[À-ɏ]+)[À-ɏ぀-鿿]*")
_INLINE = re.compile(r"\{@(?:inheritDoc|link|code|see)\b[^}]*\}", re.I)

#: How tool directives begin.
_DIRECTIVE = re.compile(
    r"(?i)^(?:eslint(?:-[\w-]+)?\b|prettier-ignore|@ts-\w+|tslint:|jshint\b|jslint\b|istanbul\b|c8 ignore|v8 ignore|nolint\w*\b|"
    r"clang-format\b|clang-tidy\b|iwyu\b|noqa\b|pylint:|flake8\b|mypy:|type:\s*ignore|pyright:|ruff:|isort:|fmt:\s*(?:on|off|skip)|"
    r"yapf:|black:|pragma\b|resharper\b|stylecop\b|sonar\w*\b|nosonar\b|#?region\b|#?endregion\b|go:\w+|\+build\b|nosec\b|"
    r"@formatter:|cspell:|spell-?checker:|coverage:|@suppress\w*\b|suppress\w*\b|lgtm\b|codeql\b|cppcheck-suppress\b|"
    r"webpack\w+:|@jsx\b|@flow\b|@format\b|biome-ignore\b|deno-\w+|vim:|-\*-)"
)
#: Tags of documentation tools, to be followed by words of their own.
_TAG = re.compile(
    r"^(?:@(?:param|arg|argument|returns?|throws?|exception|raises?|type|typedef|template|private|public|protected|internal|"
    r"static|async|override|constructor|class|function|method|member|memberof|name|since|version|author|see|deprecated)\b|"
    r":(?:param|parameter|arg|key|type|returns?|rtype|raises?|var|ivar|meta)\b[^:\n]*:|\\(?:param|return|brief|throws)\b)"
    r"[ \t]*(?P<rest>.*)$",
    re.I,
)
_SECTION = re.compile(r"^(?:args|arguments|params|parameters|returns?|yields?|raises|throws|notes?|examples?|attributes)\s*:?$", re.I)
_REMINDER = re.compile(
    r"(?i)^(?:todo|fixme|xxx|hack|tbd|tbc|wip|to be (?:documented|done|written|described|filled)|write (?:me|docs?)\b|"
    r"documentation goes here|(?:add|insert|write|put) (?:documentation|docs?|description|comment)s?\b|"
    r"(?:description|docs?|documentation|comment)s? (?:missing|pending|to follow|goes here|here)|"
    r"(?:needs?|missing|no) (?:documentation|docs?|description|comment)s?\b|placeholder\b|lorem ipsum|"
    r"auto[- ]?(?:added|generated|inserted)\b)"
)
_EMPTY_WORDS = frozenset(
    "n a na none null nil nothing todo tbd fixme xxx wip function functions method methods func fn proc procedure class "
    "constructor member helper doc docs documentation description summary comment placeholder undocumented dummy test foo bar".split()
)
_POINTER = re.compile(
    r"(?i)^(?:(?:please\s+)?(?:see|refer to|same as|cf|compare|documented in|described in|inherited from|inherit(?:s|ed)? doc\w*|"
    r"overrides?|implements?|as in|like)\b|<?inheritdoc)"
)
_LICENCE = re.compile(
    r"(?i)\blicen[cs]ed under\b|\bpermission is hereby granted\b|\ball rights reserved\b|spdx-license|\bcopyright\b.*\b(?:19|20)\d\d\b|"
    r"\bpublic licen[cs]e\b|\bwithout (?:any )?warrant|\bunder the terms of\b"
)
_STOP = frozenset(
    "a an the this that these it its is are be was does do did done will can which what who to of for in on and or by with from as at "
    "function method procedure routine helper class member here simply just given some all".split()
)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_CODE_END = re.compile(r"[;{}]\s*$|^\s*[})\]]")
_CODE_LINE = re.compile(
    r"^\s*(?:(?:if|for|foreach|while|switch|return|else|try|catch|throw|var|let|const|auto|using|import|await|yield|case|break|"
    r"continue|defer|go|raise|assert|def|with|del|print)\b.*[({;:=].*|[\w.$\[\]\"']+\s*(?:[-+*/|&]?=|:=)(?!=)\s*\S.*|[\w.$]+\(.*\)[;,]?)\s*$"
)


def _stem(word: str) -> str:
    for end in ("ies", "es", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3 - (end == "s"):
            return word[: -len(end)] + ("y" if end == "ies" else "")
    return word


def _stems(word: str) -> set[str]:
    """A word and what it may be a form of."""
    forms = {word, _stem(word)}
    for end in ("ing", "ed", "er", "d"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            root = word[: -len(end)]
            forms |= {root, root + "e"}
            if root[-1] == root[-2]:
                forms.add(root[:-1])
    for end in ("s", "es"):
        if word.endswith(end) and len(word) > 3:
            forms.add(word[: -len(end)])
    return forms


def describe(comment: list[str] | str, name: str) -> str:
    """What a comment says of the function ``name``: its text without marks, tags and directives,
    or an empty string if it says nothing."""
    lines = comment if isinstance(comment, list) else comment.split("\n")
    kept: list[str] = []
    skipping = False
    for raw in lines:
        line = _MARK.sub("", _MARK.sub("", raw.strip()))
        line = _MOJIBAKE.sub("", _INLINE.sub(" ", _XML_TAG.sub(" ", line))).strip()
        if not line:
            skipping = False
            continue
        if not any(c.isalnum() for c in line):
            continue
        if _DIRECTIVE.match(line):
            skipping = False
            continue
        tag = _TAG.match(line)
        if tag:
            skipping = False
            rest = re.sub(r"^\{[^}]*\}\s*", "", tag["rest"]).strip()
            if line[0] in "@\\":  # a parameter's name comes first, then the words
                if re.match(r"(?i)[@\\](?:param|arg|argument|throws?|exception|raises?|typedef|template|memberof|name|type)\b", line):
                    rest = re.sub(r"^\[?[\w.$]+\]?\s*-?\s*", "", rest)
                elif re.match(r"(?i)@(?:see|author|since|version|private|public|protected|internal|static|async|override)", line):
                    rest = ""
            if len(re.findall(r"[^\W\d_]+", rest)) >= 2:
                kept.append(rest)
            continue
        if _SECTION.match(line):
            continue
        if _REMINDER.match(line):
            skipping = True
            continue
        if not skipping:
            kept.append(line)
    if not kept:
        return ""
    text = " ".join(kept)
    if _LICENCE.search(text):
        return ""
    code = sum(bool(_CODE_END.search(x) or _CODE_LINE.match(x)) for x in kept)
    if code and (code == len(kept) or _CODE_END.search(kept[-1])):
        return ""
    words = [w.lower() for w in _NAME_PART.findall(text)]
    if not words or all(w in _EMPTY_WORDS or len(w) == 1 or w.isdigit() for w in words):
        return ""
    if _POINTER.match(text) and len(words) <= 8 and not re.search(r"[.;:]\s+\w", text):
        return ""
    own = [w.lower() for w in _NAME_PART.findall(name)]
    roots = set().union(*map(_stems, own)) if own else set()
    rest = [w for w in words if w not in _STOP and len(w) > 1 and not (_stems(w) & roots)]
    return text if rest else ""


def functions_of(text: str, language: str) -> list[dict]:
    """The functions of one file with their code and documentation, in the order of their lines.

    ``line`` and ``end_line`` count from 1. ``description`` is empty if the documentation says
    nothing or there is none; ``doc_distance`` is the number of lines between comment and
    signature, null without comment.
    """
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    code = _code_only(text, language)
    if language == "python" and ('"' in code or "'" in code):
        code = text  # behind a literal that does not end, code cannot be told from text
    lines, code_lines = text.split("\n"), code.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    ends = _closers(code, lines, starts)
    blocks = _block_ends(code_lines, lines) if language == "python" else None
    out = []
    for m in _SIGNATURES[language].finditer(code):
        groups = m.groupdict()
        name = groups.get("a") or groups.get("b") or groups.get("c")
        bare = name.rsplit("::", 1)[-1]
        if not bare or bare in _NOT_NAMES:
            continue
        at = m.start("i") + len(m["i"])
        first = bisect_right(starts, at) - 1
        arrow = m[0].endswith("=>")
        opened = -1 if arrow else code.find("(", m.end() - 1)
        close = ends.get(opened, m.end()) if opened >= 0 else m.end()
        distance = None
        if language == "python":
            colon = re.compile(r"[^:\n]*:").match(text, close)
            doc = _DOCSTRING.match(text, colon.end()) if colon else None
            comment = [] if not doc else (doc["d"] or "").split("\n")
            if doc:
                distance = 0
            last = blocks[first]
        else:
            comment = _comment_above(lines, first)
            if comment:
                distance = next(k for k in range(first) if lines[first - 1 - k].strip())
            end = _braced_end(code, close, ends, language, _indent(lines[first]), arrow)
            last = max(first, bisect_right(starts, max(at, end - 1)) - 1)
        while last > first and not lines[last].strip():
            last -= 1
        out.append(
            {
                "name": bare,
                "line": first + 1,
                "signature": " ".join(text[at:close].split()),
                "description": describe(comment, bare) if comment else "",
                "doc_distance": distance,
                "end_line": last + 1,
                "code": "\n".join(lines[first : last + 1]),
            }
        )
    return out


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, languages in batches:
        yield pd.Series([functions_of(t, x) if t else [] for t, x in zip(texts, languages)])


def extract_functions(raw_files: DataFrame) -> DataFrame:
    """``file_key, path, language, name, line, signature, description, doc_distance, end_line,
    code`` for every function in the files of the six languages.

    ``file_key`` is file_id trimmed and in lower case. Null texts and other languages have no
    functions. Repeated rows of a file give repeated rows.
    """
    ship_package(raw_files.sparkSession)
    kind = "array<struct<name:string,line:int,signature:string,description:string,doc_distance:int,end_line:int,code:string>>"
    files = spread(raw_files.select("file_id", "path", "text")).select(
        key_of("file_id").alias("file_key"), "path", code_language(F.col("path")).alias("language"), "text"
    ).where(F.col("language").isin(*LANGUAGES))
    found = files.select("file_key", "path", "language", F.explode(F.pandas_udf(_extract, kind)("text", "language")).alias("f"))
    return found.select("file_key", "path", "language", "f.*")


def documented_symbols(symbols: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Functions and methods of the index with documentation that says something.

    Joined by file and first line. Result: ``symbol_id, name, path, language, line, signature,
    description, end_line, code``, one row for each symbol, however often symbol or file are
    repeated. symbols.summary is not read: the file decides. Symbols without a file in
    ``raw_files``, or without a function on their line, are left out, as are null ids.
    """
    pairs = extract_functions(raw_files).where((F.col("description") != "") & (F.col("code") != ""))
    wanted = (
        symbols.where(F.lower(F.trim("symbol_type")).isin("function", "method") & F.col("id").isNotNull())
        .select(F.col("id").alias("symbol_id"), key_of("file_id").alias("file_key"), F.col("start_line").alias("line"))
        .where(F.col("file_key").isNotNull())
    )
    return wanted.join(pairs, ["file_key", "line"]).drop("file_key", "doc_distance").dropDuplicates(["symbol_id"])
