"""Declaration heads of source files by one pass over brackets, strings and comments.

A head is the text up to the next structural ``{``, ``}`` or ``;`` (or a line end that ends a declaration) outside all
parentheses. A stack holds every open bracket, so brackets nest to any depth. Braces that belong to a declaration, such as
lists in annotations, patterns and types of parameters or member initializers, are no structure: they are blanked, and the
head goes on. Everything is counted in bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NESTED_COMMENTS = {"kotlin", "rust"}
LINE_ENDED = {"kotlin", "javascript", "typescript"}
SCRIPTS = {"javascript", "typescript"}
DEEPEST = 60
#: Pieces of code that tell what a parenthesis belongs to.
NEAR = 8
#: A line end after or before one of these ends no declaration.
OPEN_AFTER, OPEN_BEFORE = frozenset(b",(=+*/&|<.:?[-{};"), frozenset(b"{)]=.?&|:,+*-")
CLOSES = {ord(")"): ord("("), ord("]"): ord("["), ord("}"): ord("{")}
OPENS = frozenset(CLOSES.values())
#: Bytes that are a token by themselves wherever code may stand.
MARKS = frozenset(b"(){}[];\n")
#: A slash after one of these starts a regular expression.
EXPRESSION = frozenset(b"=(,:[!&|?;{}<>+-*%~^")
EXPRESSION_WORDS = {b"return", b"typeof", b"case", b"throw", b"else", b"do", b"in", b"of", b"void", b"delete", b"new", b"await", b"yield"}
REGEX = re.compile(rb"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*")
CHAR = re.compile(rb"'(?:\\[^\n'][^\n']{0,8}|\\'|[^'\\\n]{1,4})'")
LINE_STRING = re.compile(rb'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"')
QUOTED = re.compile(rb"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'")
RUST_STRING = re.compile(rb'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"')
RUST_RAW, CPP_RAW = re.compile(rb'r(#*)"'), re.compile(rb'R"([^()\\\s]{0,16})\(')
DIRECTIVE = re.compile(rb"#[^\n\\]*+(?:\\(?s:.)[^\n\\]*+)*+")
#: What may begin a token that is more than one byte of code.
INTEREST = {
    "java": re.compile(rb"""["'/(){}\[\];\n]"""), "kotlin": re.compile(rb"""["'/(){}\[\];\n]"""),
    "javascript": re.compile(rb"""["'`/(){}\[\];\n]"""), "typescript": re.compile(rb"""["'`/(){}\[\];\n]"""),
    "cpp": re.compile(rb"""["'/(){}\[\];\n#:]"""), "rust": re.compile(rb"""["'/(){}\[\];\n#]"""),
}
COMMENT_END = re.compile(rb"/\*|\*/")
WORD_BEFORE = re.compile(rb"([\w$]+)\s*$")
ANNOTATED = re.compile(rb"@(?!interface\b)[\w.:]+\s*$")
ANNOTATIONS = re.compile(rb"(?:\s*@[\w.:]+(?:\s*\(\s*\))?)+\s*")
KOTLIN_PARAMETERS = re.compile(rb"\b(?:fun|class|constructor|set)\b[^(){}=]*$")
LABEL = re.compile(rb"\s*(?:public|private|protected)\s*(?:slots\s*)?$")
INITIALIZERS = re.compile(rb"\)\s*(?:noexcept\s*)?:(?!:)")
AFTER_PARAMETERS = re.compile(rb"\{|const\b|noexcept\b|override\b|final\b|->|:(?!:)|=\s*(?:0|default|delete)\b")
TYPE_BODY = re.compile(rb"(?:^|\s)(?:class|interface)\s")


@dataclass(slots=True)
class Head:
    start: int
    row: int
    level: int
    around: str | None
    code: list[bytes] = field(default_factory=list)
    docs: list[str] = field(default_factory=list)
    first: int = -1  # where its code begins, and the line of it
    first_row: int = 0
    end: int = 0  # after its last code
    end_row: int = 0
    stop: str = ""
    stop_end: int = 0
    stop_row: int = 0
    close: int | None = None  # after the end of the block that it opens
    close_row: int | None = None
    opening: bytes = b""  # its code, and that on one line, from when it is complete
    text: str = ""


#: (kind, start, end). The kind is one of these, else the byte of a bracket, semicolon or line end; a separator ends a head.
Token = tuple[int, int, int]
CODE, STRING, COMMENT, SEPARATOR = range(4)
LINE_END, COLON, SEMICOLON = b"\n:;"
ROUND, ROUND_END, SQUARE, SQUARE_END, CURLY, CURLY_END = b"()[]{}"


def comment_end(b: bytes, at: int, nested: bool) -> int:
    if not nested:
        found = b.find(b"*/", at + 2)
        return len(b) if found < 0 else found + 2
    depth, at = 1, at + 2
    while depth:
        mark = COMMENT_END.search(b, at)
        if not mark:
            return len(b)
        depth += 1 if mark[0] == b"/*" else -1
        at = mark.end()
    return at


def template_end(b: bytes, at: int, quote: bytes, language: str, inside: int) -> int:
    """End of a string from its opening ``quote`` on, which may hold ``${ ... }`` with strings and braces of its own. Strings
    within strings are followed to a depth of DEEPEST."""
    triple = len(quote) == 3
    at += len(quote)
    while at < len(b):
        if b.startswith(quote, at):
            at += len(quote)
            while triple and b[at : at + 1] == b'"':
                at += 1
            return at
        c = b[at]
        if c == 92 and not triple:
            at += 2
        elif c == 10 and quote == b'"':
            return at
        elif c == 36 and b[at + 1 : at + 2] == b"{" and inside < DEEPEST:
            at = embedded_end(b, at + 2, language, inside + 1)
        else:
            at += 1
    return len(b)


def embedded_end(b: bytes, at: int, language: str, inside: int) -> int:
    depth = 1
    for kind, _, end in tokens(b, language, at, inside):
        if kind == CURLY:
            depth += 1
        elif kind == CURLY_END:
            depth -= 1
            if not depth:
                return end
    return len(b)


def bracketed_end(b: bytes, at: int, language: str) -> int:
    depth = 0
    for kind, _, end in tokens(b, language, at):
        if kind == SQUARE:
            depth += 1
        elif kind == SQUARE_END:
            depth -= 1
            if not depth:
                return end
    return len(b)


def tokens(b: bytes, language: str, at: int = 0, inside: int = 0):
    """Code, strings, comments, brackets, semicolons and line ends in order."""
    search, begun = INTEREST[language].search, at

    def expression_expected(upto: int) -> bool:
        k = upto - 1
        while k >= 0 and b[k] in b" \t\r\n":
            k -= 1
        if k < 0 or b[k] in EXPRESSION:
            return True
        word = WORD_BEFORE.search(b, max(0, k - 11), k + 1)
        return bool(word) and word[1] in EXPRESSION_WORDS

    while True:
        mark = search(b, at)
        if not mark:
            if begun < len(b):
                yield CODE, begun, len(b)
            return
        k = mark.start()
        c = b[k]
        if c in MARKS:
            if begun < k:
                yield CODE, begun, k
            begun = at = k + 1
            yield c, k, at
            continue
        end, kind = k + 1, None
        if c == 47:
            following = b[k + 1 : k + 2]
            if following == b"/":
                end = b.find(b"\n", k)
                end, kind = (len(b) if end < 0 else end), COMMENT
            elif following == b"*":
                end, kind = comment_end(b, k, language in NESTED_COMMENTS), COMMENT
            elif language in SCRIPTS and expression_expected(k) and (found := REGEX.match(b, k)):
                end, kind = found.end(), STRING
        elif c == 34:
            if language == "cpp" and b[k - 1 : k] == b"R" and (raw := CPP_RAW.match(b, k - 1)):
                found = b.find(b")" + raw[1] + b'"', raw.end())
                end, kind = (len(b) if found < 0 else found + len(raw[1]) + 2), STRING
            elif language == "rust":
                hashes = 0
                while b[k - 1 - hashes : k - hashes] == b"#":
                    hashes += 1
                if b[k - 1 - hashes : k - hashes] == b"r":
                    closing = b'"' + b"#" * hashes
                    found = b.find(closing, k + 1)
                    end, kind = (len(b) if found < 0 else found + len(closing)), STRING
                elif found := RUST_STRING.match(b, k):
                    end, kind = found.end(), STRING
            elif language in ("java", "kotlin") and b.startswith(b'"""', k):
                if language == "kotlin":
                    end = template_end(b, k, b'"""', language, inside)
                else:
                    found = b.find(b'"""', k + 3)
                    end = len(b) if found < 0 else found + 3
                kind = STRING
            elif language == "kotlin":
                end, kind = template_end(b, k, b'"', language, inside), STRING
            elif found := LINE_STRING.match(b, k):
                end, kind = found.end(), STRING
        elif c == 39:
            found = (QUOTED if language in SCRIPTS else CHAR).match(b, k)
            if found:
                end, kind = found.end(), STRING
        elif c == 96:
            end, kind = template_end(b, k, b"`", language, inside), STRING
        elif c == 35:
            if language == "cpp":
                end, kind = DIRECTIVE.match(b, k).end(), SEPARATOR
            elif b[k + 1 : k + 2] == b"[" or b[k + 1 : k + 3] == b"![":
                end, kind = bracketed_end(b, b.index(b"[", k), language), SEPARATOR
        elif c == 58:
            if b[k + 1 : k + 2] != b":" and b[k - 1 : k] != b":":
                kind = c
        if kind is not None:
            if begun < k:
                yield CODE, begun, k
            yield kind, k, end
            begun = end
        at = end


def matches(listed: list[Token]) -> dict[int, int]:
    """Index of the closing bracket for each opening one; brackets that fit no other are left out."""
    found, stack = {}, []
    for i, (kind, _, _) in enumerate(listed):
        if kind in OPENS:
            stack.append((kind, i))
        elif kind in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == CLOSES[kind]:
                    found[stack[k][1]] = i
                    del stack[k:]
                    break
    return found


BLANK = bytes(c if c == LINE_END else 32 for c in range(256))
MASKED = bytes(c if c == LINE_END else 1 for c in range(256))


def heads(b: bytes, language: str) -> list[Head]:
    listed = list(tokens(b, language))
    match = matches(listed)
    line_ended, typed = language in LINE_ENDED, language in ("typescript", "cpp")
    following = [len(listed)] * (len(listed) + 1)  # index of the next token with code, from each token on
    upcoming = len(listed)
    for i in range(len(listed) - 1, -1, -1):
        kind, start, end = listed[i]
        if kind != COMMENT and kind != LINE_END and (kind != CODE or not b[start:end].isspace()):
            upcoming = i
        following[i] = upcoming

    def code_at(i: int) -> bytes:
        i = following[i]
        return b[listed[i][1] : listed[i][1] + 24].lstrip() if i < len(listed) else b""

    out: list[Head] = []
    frames: list[tuple[Head, int]] = []  # head of each open block, and how many brackets were open around it
    row, depth = 1, 0

    def begin(at: int) -> Head:
        return Head(at, row, len(frames), frames[-1][0].text if frames else None)

    def add(head: Head, at: int, code: bytes) -> None:
        stripped = code.strip()
        if stripped:
            if head.first < 0:
                skip = len(code) - len(code.lstrip())
                head.first, head.first_row = at + skip, row + code[:skip].count(b"\n")
                code, at = code[skip:], at + skip
            kept = code.rstrip()
            head.end, head.end_row = at + len(kept), (head.first_row if head.first == at else row) + kept.count(b"\n")
        if head.first >= 0:
            head.code.append(code)

    def complete(head: Head) -> None:
        head.stop_end, head.stop_row = end, row
        if head.first >= 0:
            head.opening = b"".join(head.code)
            head.text = text_of(head.opening)
            out.append(head)

    head, i = begin(0), 0
    while i < len(listed):
        kind, start, end = listed[i]
        part = b[start:end]
        rows = part.count(b"\n")
        stop = None
        if kind == CODE:
            add(head, start, part)
        elif kind == COMMENT:
            if head.first < 0:
                head.docs.append(part.decode("utf-8", "replace"))
            else:
                head.code.append(part.translate(BLANK))
        elif kind == STRING:
            add(head, start, b'"' + part[1:-1].translate(MASKED) + b'"')
        elif kind == SEPARATOR:
            stop = "#"
        elif (kind == ROUND or kind == CURLY and typed) and i in match and belongs(b, language, head, listed, match, i, code_at, frames):
            # one piece of the declaration: neither its brackets nor its line ends count
            end = listed[match[i]][2]
            part = b[start:end]
            rows = part.count(b"\n")
            add(head, start, hidden(b, listed[i : match[i] + 1], part[:1] == b"(" and bool(ANNOTATED.search(b"".join(head.code[-NEAR:])))))
            head.end, head.end_row = end, row + rows
            i = match[i]
        elif kind == CURLY or kind == CURLY_END:
            stop = chr(kind)
        elif kind == SEMICOLON and depth == 0:
            stop = ";"
        elif kind == COLON and len(head.code) < 4 and LABEL.fullmatch(b"".join(head.code)):
            stop = ":"
        elif kind == LINE_END:
            if head.first < 0:
                pass
            elif line_ended and depth == 0:
                last = b"".join(head.code[-3:]).rstrip()[-1:]
                after = code_at(i)[:1]
                leads = language == "kotlin" and ANNOTATIONS.fullmatch(b"".join(head.code[:NEAR]))  # modifiers of what follows
                if not leads and not (last and last[0] in OPEN_AFTER) and not (after and after[0] in OPEN_BEFORE):
                    stop = "\n"
                else:
                    head.code.append(part)
            else:
                head.code.append(part)
        else:  # one byte of code
            if kind == ROUND or kind == SQUARE:
                depth += 1
            elif kind == ROUND_END or kind == SQUARE_END:
                depth = max(0, depth - 1)
            if head.first < 0:
                head.first, head.first_row = start, row
            head.end, head.end_row = end, row
            head.code.append(part)
        row += rows
        i += 1
        if stop is None:
            continue
        head.stop = stop
        complete(head)
        if stop == "{":
            frames.append((head, depth))
            depth = 0
        elif stop == "}":
            if frames:
                opener, depth = frames.pop()
                opener.close, opener.close_row = end, row
            else:
                depth = 0
        head = begin(end)
    if head.first >= 0:
        end = len(b)
        complete(head)
    return out


def belongs(b: bytes, language: str, head: Head, listed: list[Token], match: dict[int, int], i: int, code_at, frames) -> bool:
    """Whether the bracket opens a part of the declaration itself, in which nothing is declared."""
    if listed[i][0] == ROUND:
        before = b"".join(head.code[-NEAR:])
        if language != "cpp" and language != "rust" and b"@" in before and ANNOTATED.search(before):
            return True
        inside = [kind for kind, _, _ in listed[i + 1 : match[i]]]
        if CURLY not in inside:
            return False
        if language == "kotlin":
            return bool(KOTLIN_PARAMETERS.search(before))
        after = code_at(match[i] + 1)
        if language in SCRIPTS:
            return after[:1] == b"{" or after[:2] == b"=>" or language == "typescript" and after[:1] in (b":", b";")
        if language == "cpp":
            return bool(AFTER_PARAMETERS.match(after)) or after[:1] == b";" and SEMICOLON not in inside
        return False
    before = b"".join(head.code)
    last = before.rstrip()[-1:]
    if language == "typescript":
        tail = re.split(rb"[()=;]", before)[-1]
        if last in (b"<", b"|", b"&") or tail.count(b"<") > tail.count(b">"):  # type arguments
            return True
        in_type = bool(frames) and bool(TYPE_BODY.search(frames[-1][0].opening))
        return last == b":" and (before.rstrip()[:-1].rstrip()[-1:] == b")" or in_type)
    if language == "cpp":  # member initializers in braces
        return bool(INITIALIZERS.search(before)) and bool(re.search(rb"[\w>]\s*$", before)) and code_at(match[i] + 1)[:1] in (b",", b"{")
    return False


def hidden(b: bytes, part: list[Token], all_of_it: bool) -> bytes:
    """The part with as many bytes and lines. Braces, semicolons, strings and comments become blanks, in annotations everything."""
    out = []
    for k, (kind, start, end) in enumerate(part):
        text = b[start:end]
        edge = k in (0, len(part) - 1)
        plain = kind in (CODE, ROUND, ROUND_END, SQUARE, SQUARE_END, COLON)
        out.append(text if edge and text in b"()" or plain and not all_of_it else text.translate(BLANK))
    return b"".join(out)


SPACES = bytes(range(1, 33))
TO_SPACE = bytes.maketrans(SPACES, b" " * len(SPACES))


def text_of(opening: bytes) -> str:
    """The code of a head on one line, strings empty."""
    return b" ".join(opening.translate(TO_SPACE).split()).decode("utf-8", "replace")
