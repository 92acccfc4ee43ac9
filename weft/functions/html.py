"""The lead paragraphs of a page by the structure of its elements: open elements on a stack, with the ends that HTML lets authors leave out."""

from __future__ import annotations

import re
from html import unescape

#: Elements without content, elements whose text is no markup, elements that end an open paragraph, and what else an element ends by its start.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements at which the search for an element to end stops.
SCOPE = frozenset("table ul ol dl section article div body html button object".split())
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


class _Lead:
    """Reads the first block and its paragraphs."""

    def __init__(self, dropped: frozenset[str]):
        self.dropped = dropped
        #: Open elements: name, whether it is dropped, where its text begins in the paragraph, and a link's target.
        self.open: list[tuple[str, bool, int, str | None]] = []
        self.block: int | None = None
        self.hidden, self.paragraph, self.out, self.done = 0, None, [], False

    def text(self, text: str) -> None:
        if self.paragraph is not None and not self.hidden:
            self.paragraph.append(unescape(text))

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS_P:
            self.end_within("p", frozenset({"button", "object"}))
        for other in ENDS.get(name, ()):
            self.end_within(other, SCOPE)
        if name == "br":
            self.text(" ")
        if name in VOID:
            return
        about = _attributes(attributes)
        classes = set(about.get("class", "").split())
        if name in ("section", "article") and self.block is None:
            self.block = len(self.open)
        gone = bool(classes & self.dropped)
        target = None
        if name == "a" and (href := about.get("href", "")).startswith("./") and "redlink=1" not in href and "new" not in classes:
            target = href[2:]
        if name == "p" and self.block is not None and not self.hidden and not gone:
            self.paragraph = []
        self.open.append((name, gone, len(self.paragraph or ()), target))
        self.hidden += gone

    def close(self) -> None:
        name, gone, at, target = self.open.pop()
        self.hidden -= gone
        if name == "a" and target is not None and self.paragraph is not None and not self.hidden:
            self.paragraph[at:] = [f"[{''.join(self.paragraph[at:])}](:{target})"]
        if name == "p" and self.paragraph is not None:
            self.out.append("".join(self.paragraph))
            self.paragraph = None
        if self.block is not None and len(self.open) == self.block:
            self.done = True

    def end_within(self, name: str, scope: frozenset[str]) -> None:
        """Ends the innermost open element of this name, and what is open in it, unless an element of scope holds it off."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                while len(self.open) > i:
                    self.close()
                return
            if self.open[i][0] in scope:
                return

    def end(self, name: str) -> None:
        self.end_within(name, frozenset() if name in SCOPE or name == "p" else SCOPE - {name})


def lead(page: str | None, dropped: tuple[str, ...]) -> str | None:
    """The paragraphs of the first article or section: text, with links to ./pages as [label](:page). Elements of the dropped classes go with all that they
    hold; links to pages that don't exist (redlink=1, class new) and to elsewhere leave their label; white space is one space."""
    if page is None:
        return None
    read, at, raw = _Lead(frozenset(dropped)), 0, None
    for m in _MARKUP.finditer(page):
        if m.start() < at:
            continue
        if raw:
            if m[1] and m[2].lower() == raw:
                raw = None
                read.end(m[2].lower())
                at = m.end()
            continue
        read.text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            read.end(name)
        else:
            read.start(name, m[3])
            raw = name if name in RAW and not m[3].rstrip().endswith("/") else None
        if read.done:
            break
    if not read.done:
        if not raw:
            read.text(page[at:])
        while read.open:
            read.close()
    return re.sub(r"[ \n\r\t]+", " ", " ".join(read.out)).strip(" ")
