"""Text blocks of an HTML page in page order, with the path of tags above each.

A block is the text between two block-level tags; inline tags are transparent and a line break is white space.
Scripts, styles, titles, form controls, embedded media, comments and declarations give no text.  Character
references are decoded, white space inside a block becomes one blank, and empty blocks are left out.  An element of
HIDDEN_TAGS gives no text if its own end tag comes before its parent's end; if there is none, as after an svg tag
that ends in a slash, only the tag is left out and what follows is read.

The work is linear in the page, however deep it is: open elements are found by name, blocks share the elements above
them, and a missing end tag is looked for once.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed lists of HTML element names by their role in the page's structure.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HIDDEN_TAGS = frozenset("template select button svg object audio video canvas".split())
#: A start tag of the key ends an open element of the first set, unless one of the second is open inside it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
_P_SCOPE = frozenset({"table", "td", "th"})
#: Elements that the end tag of an element of HIDDEN_TAGS does not end: blocks other than those without a needed end tag.
_HIDDEN_SCOPE = BLOCK_TAGS - {"p", "li", "dd", "dt"}

_TAG = re.compile(r"""<(?:(?P<skip>!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z))"""
                  r"""|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""",
                  re.DOTALL)
_HIDDEN = re.compile(f"<(?:{'|'.join(sorted(HIDDEN_TAGS))})", re.IGNORECASE)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An element's tag and names and the element around it.  Like elements in one parent are one object; ``known`` is
    free for what a reader works out about it."""

    __slots__ = ("tag", "names", "parent", "inside", "known")

    def __init__(self, tag: str, names: tuple, parent: Element | None):
        self.tag, self.names, self.parent, self.inside, self.known = tag, names, parent, None, None

    def child(self, tag: str, names: tuple) -> Element:
        if self.inside is None:
            self.inside = {}
        found = self.inside.get((tag, names))
        if found is None:
            found = self.inside[tag, names] = Element(tag, names, self)
        return found


@dataclass(slots=True)
class Block:
    """A block's text, the innermost element around it (the page itself has no tag), and how many of its characters
    stand in links."""

    text: str
    within: Element
    linked: int

    @property
    def path(self) -> tuple:
        """The (tag, names) of the elements above, outermost first."""
        out, e = [], self.within
        while e.parent is not None:
            out.append((e.tag, e.names))
            e = e.parent
        return tuple(reversed(out))


class _Open:
    """The open elements, and where the innermost of a name or of a set of names is."""

    def __init__(self, *groups: frozenset):
        self.names: list[str] = []
        self.values: list = []
        self.at: dict[str, list[int]] = {}
        self.groups: dict[frozenset, list[int]] = {g: [] for g in groups}

    def push(self, name: str, value) -> None:
        k = len(self.names)
        self.names.append(name)
        self.values.append(value)
        self.at.setdefault(name, []).append(k)
        for group, places in self.groups.items():
            if name in group:
                places.append(k)

    def last(self, names) -> int:
        places = self.groups.get(names) if isinstance(names, frozenset) else None
        if places is not None:
            return places[-1] if places else -1
        return max((own[-1] for n in names if (own := self.at.get(n))), default=-1)

    def innermost(self, names, stops) -> int:
        """Place of the innermost open element of ``names``, or -1 if there is none or one of ``stops`` is inside it."""
        k = self.last(names)
        return k if k >= 0 and k >= self.last(stops) else -1

    def cut(self, k: int) -> None:
        """Ends the element at place k and all inside it."""
        for name in self.names[k:]:
            self.at[name].pop()
            for group, places in self.groups.items():
                if name in group:
                    places.pop()
        del self.names[k:], self.values[k:]


def names_of(attrs: str) -> tuple[str, ...]:
    """Lower-case parts of the class, id and role names among a tag's attributes."""
    if "=" not in attrs:
        return ()
    found = [a or b or c for a, b, c in _ATTR.findall(attrs)]
    return tuple(p.lower() for v in found for p in _PART.findall(v))


def blocks_of(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    open_ = _Open(BLOCK_TAGS)
    root = Element("", (), None)
    parts: list[str] = []
    linked = 0
    within = root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, within, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, within
        if "&" in text:
            text = html.unescape(text)
        if not parts:
            if text.isspace():
                return
            within = open_.values[-1] if open_.values else root
        parts.append(text)
        if open_.at.get("a"):
            linked += len(text.strip())

    def close(names, stops=()) -> None:
        """Ends the innermost open element of ``names`` and all inside it; not past an element of ``stops``."""
        k = open_.innermost(names, stops)
        if k >= 0:
            open_.cut(k)

    at, raw_ends = 0, _RawEnds(page)
    ends = _hidden_ends(page, raw_ends)
    raw_ends = _RawEnds(page)
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if m["skip"] is not None:
            if m["skip"].startswith("![CDATA["):
                add(" ")
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in BLOCK_TAGS:
                flush()
                close((name,))
            else:
                close((name,), BLOCK_TAGS)
            continue
        if name in RAW_TAGS or name in HIDDEN_TAGS:
            at = raw_ends.after(name, at) if name in RAW_TAGS else ends.get(at, at)
            add(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            if name in ENDS:
                close(*ENDS[name])
            close(("p",), _P_SCOPE)
        if name not in VOID_TAGS:
            open_.push(name, (open_.values[-1] if open_.values else root).child(name, names_of(m["attrs"])))
    if at < len(page):
        add(page[at:])
    flush()
    return out


class _RawEnds:
    """Where the texts of elements of RAW_TAGS end, asked for from left to right."""

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, int] = {}  # the next end tag of a name that was looked for; -1: there is none

    def after(self, name: str, at: int) -> int:
        """The end, with its end tag, of the element that begins at ``at``.  An unclosed title is only its tag."""
        stop = self.next.get(name, 0)
        if 0 <= stop < at or name not in self.next:
            m = re.compile(f"</{name}", re.IGNORECASE).search(self.page, at)
            stop = self.next[name] = m.start() if m else -1
        if stop < 0:
            return at if name == "title" else len(self.page)
        return self.page.find(">", stop) + 1 or len(self.page)


def _hidden_ends(page: str, raw_ends: _RawEnds) -> dict[int, int]:
    """{end of the start tag: end of the end tag} of the elements of HIDDEN_TAGS that are closed inside their parent."""
    ends: dict[int, int] = {}
    open_ = _Open(BLOCK_TAGS, _HIDDEN_SCOPE)
    at = 0 if _HIDDEN.search(page) else len(page)
    while (m := _TAG.search(page, at)) is not None:
        at = m.end()
        if m["skip"] is not None:
            continue
        name = m["name"].lower()
        if m["end"]:
            k = open_.innermost((name,), _HIDDEN_SCOPE if name in HIDDEN_TAGS else () if name in BLOCK_TAGS else BLOCK_TAGS)
            if k >= 0:
                if name in HIDDEN_TAGS:
                    ends[open_.values[k]] = at
                open_.cut(k)
            continue
        if name in RAW_TAGS:
            at = raw_ends.after(name, at)
            continue
        if name in HIDDEN_TAGS:
            if name != "svg" or not m["attrs"].endswith("/"):
                open_.push(name, at)
            continue
        if name in BLOCK_TAGS:
            for names, stops in ((ENDS.get(name) or ((), ())), (("p",), _P_SCOPE)):
                k = open_.innermost(names, (*stops, *HIDDEN_TAGS))
                if k >= 0:
                    open_.cut(k)
        if name not in VOID_TAGS:
            open_.push(name, at)
    return ends
