"""HTML to text, and a small element tree for statute pages (standard library only)."""

from __future__ import annotations

from html.parser import HTMLParser

#: A line break comes before each of these elements.
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style"}


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self):
        """Nodes and strings below, in document order."""
        stack = self.children[::-1]
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(x.children[::-1])

    def find(self, tag: str, cls: str | None = None) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag == tag and (cls is None or cls in x.classes)]

    def ancestors(self):
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def without(self, cls: str) -> Node:
        """A copy that lacks descendants of the class."""
        out = Node(self.tag, self.attrs, self.parent)
        stack = [(self, out)]
        while stack:
            src, dst = stack.pop()
            for c in src.children:
                if isinstance(c, str):
                    dst.children.append(c)
                elif cls not in c.classes:
                    copy = Node(c.tag, c.attrs, dst)
                    dst.children.append(copy)
                    stack.append((c, copy))
        return out

    def text(self) -> str:
        return " ".join("".join(x for x in self.walk() if isinstance(x, str)).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p":  # a paragraph ends where the next one starts
            at = self.at
            while at.parent is not None and at.tag in ("p", "b", "i", "span", "em", "strong", "a"):
                if at.tag == "p":
                    self.at = at.parent
                    break
                at = at.parent
        node = Node(tag, {k.lower(): v for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k.lower(): v for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.at = at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def node_text(node: Node) -> str:
    """Text with a line break before block elements, the node's own included."""
    parts = ["\n"] if node.tag in BLOCKS else []
    stack = node.children[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in HIDDEN:
            if x.tag in BLOCKS:
                parts.append("\n")
            stack.extend(x.children[::-1])
    return tidy("".join(parts))


def tidy(text: str) -> str:
    """White space collapsed in each line, at most one blank line in a row, trimmed."""
    out, blank = [], 0
    for line in text.replace("\r", "").split("\n"):
        line = " ".join(line.split())
        blank = 0 if line else blank + 1
        if line or (blank == 1 and out):
            out.append(line)
    return "\n".join(out).strip()


def html_to_text(html: str | None) -> str:
    return node_text(parse(html)) if html and not html.isspace() else ""


