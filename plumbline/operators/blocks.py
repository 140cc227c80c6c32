"""Block structure of Markdown documents: headings, fences, indented code, HTML, tables, inside quotes and lists as well.

Lines are numbered from 0 and blocks are half-open line ranges. Only what decides where prose, tables and code stand is
recognised; inline markup is left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

FENCE = re.compile(r"(?P<mark>`{3,}|~{3,})(?P<info>.*)$")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
ITEM = re.compile(r"(?P<mark>[-+*]|(?P<n>\d{1,9})[.)])(?P<gap>[ \t]+|$)")
DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
RAW_TAGS = re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I)
BLOCK_TAGS = re.compile(
    r"</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset"
    r"|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=\s|/?>|$)",
    re.I,
)
ANY_TAG = re.compile(r"(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$")
#: Start and end of the HTML blocks that end at a mark; the others end at a blank line.
MARKED_HTML = [(re.compile("<!--"), "-->"), (re.compile(r"<\?"), "?>"), (re.compile("<![A-Za-z]"), ">"), (re.compile(r"<!\[CDATA\["), "]]>")]


@dataclass
class Block:
    kind: str  # heading, table, fence, code or html
    start: int
    end: int
    text: str = ""
    level: int = 0
    info: str = ""
    closed: bool = True


def expand(line: str) -> str:
    """Tabs of the indentation as blanks up to the next column of four."""
    rest = line.lstrip(" \t")
    width = 0
    for c in line[: len(line) - len(rest)]:
        width += 4 - width % 4 if c == "\t" else 1
    return " " * width + rest


def cells(line: str) -> int:
    """Number of columns of a table row."""
    inner = re.sub(r"\\.", "x", line.strip())
    return inner.removeprefix("|").removesuffix("|").count("|") + 1


def blocks(text: str) -> list[Block]:
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return Scanner().scan([(i, expand(x)) for i, x in enumerate(lines)])


Numbered = tuple[int, str]


class Scanner:
    """One level of blocks; quotes and list items are scanned again without their marks."""

    def scan(self, lines: list[Numbered]) -> list[Block]:
        self.out: list[Block] = []
        self.paragraph: list[Numbered] = []
        i = 0
        while i < len(lines):
            i = self._step(lines, i)
        return self.out

    def _step(self, lines: list[Numbered], i: int) -> int:
        number, line = lines[i]
        body = line.lstrip(" ")
        depth = len(line) - len(body)
        if not body.strip():
            self.paragraph = []
            return i + 1
        if depth >= 4:
            if self.paragraph:
                self.paragraph.append(lines[i])
                return i + 1
            return self._indented(lines, i)
        if self.paragraph and (m := UNDERLINE.match(body)):
            self.out.append(Block("heading", self.paragraph[0][0], number + 1, "\n".join(x.strip() for _, x in self.paragraph), 1 if m[1][0] == "=" else 2))
            self.paragraph = []
            return i + 1
        for method in (self._fence, self._quote, self._heading, self._rule, self._list, self._html, self._table):
            end = method(lines, i, body, depth)
            if end is not None:
                return end
        self.paragraph.append(lines[i])
        return i + 1

    def _indented(self, lines: list[Numbered], i: int) -> int:
        last = j = i
        while j < len(lines) and (not lines[j][1].strip() or lines[j][1].startswith("    ")):
            if lines[j][1].strip():
                last = j
            j += 1
        self.out.append(Block("code", lines[i][0], lines[last][0] + 1, "\n".join(x[4:] for _, x in lines[i : last + 1])))
        return last + 1

    def _fence(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        m = FENCE.match(body)
        if not m or (m["mark"][0] == "`" and "`" in m["info"]):
            return None
        self.paragraph = []
        inner, closed, j = [], False, i + 1
        while j < len(lines):
            x = lines[j][1]
            bare = x.strip()
            if len(x) - len(x.lstrip(" ")) < 4 and len(bare) >= len(m["mark"]) and set(bare) == {m["mark"][0]}:
                closed = True
                break
            inner.append(x[min(depth, len(x) - len(x.lstrip(" "))) :] + "\n")
            j += 1
        end = lines[j][0] + 1 if closed else lines[-1][0] + 1
        self.out.append(Block("fence", lines[i][0], end, "".join(inner), info=m["info"].strip(), closed=closed))
        return j + 1

    def _quote(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        if not body.startswith(">"):
            return None
        inner, j, lazy = [], i, False
        while j < len(lines):
            x = lines[j][1].lstrip(" ")
            if x.startswith(">") and len(lines[j][1]) - len(x) < 4:
                inside = x[2:] if x[1:2] == " " else x[1:]
                lazy = bool(inside.strip()) and not self._opens(inside)
            elif lazy and x.strip() and not self._opens(x):
                inside = x
            else:
                break
            inner.append((lines[j][0], expand(inside)))
            j += 1
        self._within(inner)
        return j

    @staticmethod
    def _opens(x: str) -> bool:
        """Whether a line starts a block that a paragraph can't run over."""
        x = x.lstrip(" ")
        return bool(FENCE.match(x) or HEADING.match(x) or RULE.match(x) or ITEM.match(x) or x.startswith(">"))

    def _within(self, inner: list[Numbered]) -> None:
        self.paragraph = []
        self.out += Scanner().scan(inner)

    def _heading(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        m = HEADING.match(body)
        if not m:
            return None
        self.paragraph = []
        text = m[2] or ""
        self.out.append(Block("heading", lines[i][0], lines[i][0] + 1, "" if set(text) == {"#"} else text.strip(), len(m[1])))
        return i + 1

    def _rule(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        if not RULE.match(body):
            return None
        self.paragraph = []
        return i + 1

    def _list(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        m = ITEM.match(body)
        if not m or (self.paragraph and (not body[m.end() :].strip() or m["n"] not in (None, "1"))):
            return None
        gap = len(m["gap"].expandtabs(4))
        width = depth + len(m["mark"]) + (gap if 1 <= gap <= 4 and body[m.end() :].strip() else 1)
        inner = [(lines[i][0], expand(" " * max(0, gap - 1) + body[m.end() :] if gap > 4 else body[m.end() :]))]
        j, lazy = i + 1, bool(body[m.end() :].strip()) and not self._opens(body[m.end() :])
        while j < len(lines):
            x = lines[j][1]
            here = len(x) - len(x.lstrip(" "))
            if not x.strip():
                lazy = False
                inner.append((lines[j][0], ""))
            elif here >= width:
                inner.append((lines[j][0], x[width:]))
                lazy = not self._opens(x[width:])
            elif lazy and not self._opens(x):
                inner.append((lines[j][0], x.lstrip(" ")))
            else:
                break
            j += 1
        while len(inner) > 1 and not inner[-1][1].strip():
            inner.pop()
            j -= 1
        self._within(inner)
        return j

    def _html(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        if not body.startswith("<"):
            return None
        stop = None
        if RAW_TAGS.match(body):
            stop = lambda x: bool(re.search(r"</(?:script|pre|style|textarea)>", x, re.I))
        for start, mark in MARKED_HTML:
            if start.match(body):
                stop = lambda x, mark=mark: mark in x
        if stop is None and not (BLOCK_TAGS.match(body) or (ANY_TAG.match(body) and not self.paragraph)):
            return None
        self.paragraph = []
        j = i
        if stop:
            while j < len(lines) and not stop(lines[j][1]):
                j += 1
            j = min(j + 1, len(lines))
        else:
            while j < len(lines) and lines[j][1].strip():
                j += 1
        self.out.append(Block("html", lines[i][0], lines[j - 1][0] + 1))
        return j

    def _table(self, lines: list[Numbered], i: int, body: str, depth: int) -> int | None:
        if self.paragraph or i + 1 >= len(lines):
            return None
        below = lines[i + 1][1]
        if len(below) - len(below.lstrip(" ")) >= 4 or not DELIMITERS.match(below.strip()) or not ("|" in below or ":" in below or "|" in body) or cells(body) != cells(below):
            return None
        if "|" not in body and "|" not in below:
            return None
        j = i + 2
        while j < len(lines) and lines[j][1].strip() and not lines[j][1].startswith("    ") and not self._opens(lines[j][1]):
            j += 1
        self.out.append(Block("table", lines[i][0], lines[j - 1][0] + 1))
        return j
