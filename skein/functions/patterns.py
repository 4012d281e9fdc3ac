"""Path patterns as regular expressions that Java and Python read alike, and ignore files."""

from __future__ import annotations

import re
from functools import lru_cache


def _class(body: str) -> str:
    """A bracket expression's inside (after the negation) as a character class; (?!) if nothing is in it."""
    out, i = "", 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            out += f"{re.escape(low)}-{re.escape(high)}" if low <= high else ""
            i += 3
        else:
            # re.escape leaves alone what has a meaning in Java's classes only
            out += "\\" + body[i] if not body[i].isalnum() and ord(body[i]) < 128 else body[i]
            i += 1
    return out


def _bracket(pattern: str, i: int, negations: str) -> tuple[str, int] | None:
    """The bracket expression that begins at i as a regex, and where it ends; None if it isn't closed."""
    j = i + 1
    negated = pattern[j : j + 1] in tuple(negations)
    j += negated
    end = pattern.find("]", j + 1)
    if end < 0:
        return None
    body = _class(pattern[j:end])
    if not body:
        return (r"[\s\S]" if negated else "(?!)"), end + 1
    return f"[{'^' if negated else ''}{body}]", end + 1


def glob_p(pattern: str) -> str:
    """fnmatch's patterns, where * and ? cross slashes: the regex of a whole string, without anchors."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (found := _bracket(pattern, i, "!")):
            out, i = out + found[0], found[1]
            continue
        out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return out


def glob_b(pattern: str) -> str:
    """Path globs: * and ? stop at slashes, **/ stands for any directories, {a,b} for either, \\ takes the next character as it is."""
    out, i, deep = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and (found := _bracket(pattern, i, "!^")):
            out, i = out + f"(?!/){found[0]}", found[1]
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            if c == "{":
                out, deep = out + "(?:", deep + 1
            elif c == "}" and deep:
                out, deep = out + ")", deep - 1
            elif c == "," and deep:
                out += "|"
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            i += 1
    return out + ")" * deep


def anchored(body: str) -> str:
    """For rlike."""
    return rf"(?s)\A(?:{body})\z"


def fits(body: str, text: str) -> bool:
    return re.fullmatch(f"(?s:{body})", text) is not None


class IgnoreRule:
    """A line of an ignore file: what it matches, whether it only matches folders, whether it takes back what others ignore."""

    def __init__(self, line: str):
        self.negated = line.startswith("!")
        line = line[1:] if self.negated else line
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        self.folders = line.endswith("/")
        line = line.rstrip("/") if self.folders else line
        rooted = "/" in line
        line = line.removeprefix("/")
        out, i = "" if rooted else "(?:.*/)?", 0
        while i < len(line):
            c = line[i]
            if line.startswith("**/", i) and (not i or line[i - 1] == "/"):
                out, i = out + "(?:.*/)?", i + 3
            elif line[i:] == "**" and (not i or line[i - 1] == "/"):
                out, i = out + ".+", i + 2
            elif c == "[" and (found := _bracket(line, i, "!^")):
                out, i = out + f"(?!/){found[0]}", found[1]
            elif c == "\\" and i + 1 < len(line):
                out, i = out + re.escape(line[i + 1]), i + 2
            else:
                out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
                i += 1
        self.regex = re.compile(f"(?s:{out})")


def _line(text: str) -> str:
    """Without the spaces at the end that no backslash keeps."""
    text = text.rstrip("\r")
    kept = text.rstrip(" ")
    odd = (len(kept) - len(kept.rstrip("\\"))) % 2
    return text[: len(kept) + 1] if odd and len(kept) < len(text) else kept


class Ignore:
    """The rules of an ignore file, for paths relative to its folder. The last rule that fits decides; nothing in an ignored folder comes back."""

    def __init__(self, lines: list[str]):
        lines = [_line(x) for x in lines]
        self.rules = [IgnoreRule(x) for x in lines if x and not x.startswith("#") and x.strip("/!")]
        self.folder = lru_cache(1 << 16)(self._folder)

    def _decide(self, path: str, folder: bool) -> bool:
        out = False
        for r in self.rules:
            if (folder or not r.folders) and r.regex.fullmatch(path):
                out = not r.negated
        return out

    def _folder(self, path: str) -> bool:
        above = path.rpartition("/")[0]
        return (bool(above) and self.folder(above)) or self._decide(path, True)

    def __call__(self, path: str) -> bool:
        """Whether the file at this path is ignored."""
        above = path.rpartition("/")[0]
        return (bool(above) and self.folder(above)) or self._decide(path, False)
