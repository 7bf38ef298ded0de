"""POSIX-style advanced regular expressions for Java's matcher.

The two dialects look alike but differ where it hurts: Java reads [[:alpha:]] as a set of letters, lets $ match
before a final newline, and lets . stop at one. Patterns are literals, so the translation runs once on the driver.
"""

from __future__ import annotations

#: POSIX classes and escapes by their Java spelling.
CLASSES = {"alpha": "\\p{IsAlphabetic}", "digit": "0-9", "alnum": "\\p{IsAlphabetic}0-9", "upper": "\\p{Lu}", "lower": "\\p{Ll}", "space": "\\s\\x0B", "blank": " \\t", "punct": "\\p{Punct}", "cntrl": "\\p{Cntrl}", "xdigit": "0-9A-Fa-f", "print": "\\p{Print}", "graph": "\\p{Graph}"}
WORD = "[\\p{IsAlphabetic}0-9_]"
EDGES = {"m": f"(?<!{WORD})(?={WORD})", "M": f"(?<={WORD})(?!{WORD})", "y": f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))", "Y": f"(?:(?<!{WORD})(?!{WORD})|(?<={WORD})(?={WORD}))", "A": "\\A", "Z": "\\z"}
SHORT = {"d": "[0-9]", "D": "[^0-9]", "s": "[\\s\\x0B]", "S": "[^\\s\\x0B]", "w": WORD, "W": "[^\\p{IsAlphabetic}0-9_]"}
INSIDE = {"d": "0-9", "s": "\\s\\x0B", "w": "\\p{IsAlphabetic}0-9_"}
MOST = 255


class RegexError(ValueError):
    """A pattern that the dialect does not have."""


def _bracket(p: str, i: int) -> tuple[str, int]:
    """The bracket expression that begins at p[i], and the place after it."""
    if p.startswith("[[:<:]]", i):
        return EDGES["m"], i + 7
    if p.startswith("[[:>:]]", i):
        return EDGES["M"], i + 7
    out, i = "[", i + 1
    if p[i : i + 1] == "^":
        out, i = "[^", i + 1
    first = True
    while True:
        if i >= len(p):
            raise RegexError("brackets [] not balanced")
        c = p[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if p.startswith("[:", i):
            end = p.find(":]", i)
            name = p[i + 2 : end] if end > 0 else ""
            if name not in CLASSES:
                raise RegexError("invalid character class")
            out, i = out + CLASSES[name], end + 2
        elif p.startswith(("[.", "[="), i):
            end = p.find(p[i + 1] + "]", i + 2)
            if end < 0 or len(p[i + 2 : end]) != 1:
                raise RegexError("invalid collating element")
            out, i = out + "\\" + p[i + 2], end + 2
        elif c == "\\" and i + 1 < len(p):
            out, i = out + (INSIDE.get(p[i + 1]) or "\\" + p[i + 1]), i + 2
        else:
            out, i = out + ("\\" + c if c in "[&~#" else c), i + 1


def to_java(pattern: str, flags: str = "") -> str:
    """Java's spelling of a pattern. flags: i (fold case), c (do not), n (newline-sensitive), x (expanded).

    Raises RegexError for what the dialect refuses: unbalanced brackets and parentheses, unknown classes, bounds
    over 255, quantified constraints, back references within lookaround.
    """
    if pattern.startswith("***="):
        return "(?s" + ("iu" if "i" in flags else "") + ")\\Q" + pattern[4:].replace("\\E", "\\E\\\\E\\Q") + "\\E"
    pattern = pattern.removeprefix("***:")
    if pattern.startswith("(?") and (end := pattern.find(")")) > 2 and pattern[2:end].isalpha():
        flags, pattern = flags + pattern[2:end], pattern[end + 1 :]
    if "q" in flags:
        return to_java("***=" + pattern, flags.replace("q", ""))
    # n and m part lines everywhere, p only where a character is matched, w only at the anchors
    fold, lines, dots, expanded = flags.rfind("i") > flags.rfind("c"), any(f in flags for f in "nmw"), any(f in flags for f in "nmp"), "x" in flags
    out: list[str] = []
    # open parentheses: the kind, and how many capturing groups of the dialect were open before
    stack: list[str] = []
    groups: list[int] = []  # the dialect's group numbers to Java's
    java_groups = 0
    i, atom = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            text, i = _bracket(pattern, i)
            out.append("(?:(?!\\n)" + text + ")" if dots and text.startswith("[^") else text)
            atom = not text.startswith("(?")
        elif c == "(":
            kind = next((k for k in ("(?:", "(?=", "(?!", "(?<=", "(?<!") if pattern.startswith(k, i)), "(")
            if kind == "(":
                java_groups += 1
                if not any(k in ("(?=", "(?!", "(?<=", "(?<!") for k in stack):
                    groups.append(java_groups)  # groups within lookaround have no number
            stack.append(kind)
            out.append(kind)
            i, atom = i + len(kind), False
        elif c == ")":
            if not stack:
                raise RegexError("parentheses () not balanced")
            atom = stack.pop() in ("(", "(?:")
            out.append(")")
            i += 1
        elif c == "\\":
            if i + 1 >= len(pattern):
                raise RegexError("invalid escape \\ sequence")
            e = pattern[i + 1]
            if e in EDGES:
                out.append(EDGES[e])
                atom = False
            elif e in SHORT:
                out.append(SHORT[e])
                atom = True
            elif e in "123456789":
                if any(k in ("(?=", "(?!", "(?<=", "(?<!") for k in stack):
                    raise RegexError("invalid backreference number")
                if pattern[i + 2 : i + 3].isdigit() and int(pattern[i + 1 : i + 3]) <= len(groups):  # two digits, if so many groups are there
                    e, i = pattern[i + 1 : i + 3], i + 1
                if int(e) > len(groups):
                    raise RegexError("invalid backreference number")
                out.append(f"\\{groups[int(e) - 1]}(?:)")
                atom = True
            else:
                out.append("\\" + e if e in "afnrtex" or not e.isalnum() else {"B": "\\\\", "b": "\\x08", "v": "\\x0B"}.get(e, "\\" + e))
                atom = True
            i += 2
        elif c in "*+?" or c == "{" and i + 1 < len(pattern) and pattern[i + 1].isdigit():
            if not atom:
                raise RegexError("quantifier operand invalid")
            end = i + 1
            if c == "{":
                end = pattern.find("}", i) + 1
                bounds = pattern[i + 1 : end - 1].split(",")
                if not end or len(bounds) > 2 or any(b and (not b.isdigit() or int(b) > MOST) for b in bounds):
                    raise RegexError("invalid repetition count(s)")
            if pattern[end : end + 1] == "?":
                end += 1
            out.append(pattern[i:end])
            i, atom = end, False
        elif c == "$":
            out.append("(?m:$)" if lines else "\\z")
            i, atom = i + 1, False
        elif c == "^":
            out.append("(?m:^)" if lines else "\\A")
            i, atom = i + 1, False
        elif c == ".":
            out.append("[^\\n]" if dots else ".")
            i, atom = i + 1, True
        elif c == "|":
            out.append(c)
            i, atom = i + 1, False
        elif expanded and (c.isspace() or c == "#"):
            i = pattern.find("\n", i) + 1 or len(pattern) if c == "#" else i + 1
        else:
            out.append("\\" + c if c in "{}" else c)
            i, atom = i + 1, True
    if stack:
        raise RegexError("parentheses () not balanced")
    return "(?s" + ("iu" if fold else "") + ")" + "".join(out)
