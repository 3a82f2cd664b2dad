"""HTML to markdown: the one normaliser step that needs a parser, as an Arrow-batched function around Python's own.

A page is read into a tree, in which elements end where HTML ends them; its white space is collapsed as browsers do; then each element writes its content:
# headings, fenced code with its language, `code`, lists by `-   ` and `1.  ` with nested lines indented by four, **strong**, _em_, [text](href "title"),
![alt](src "title"), > quotes, * * * rules, two spaces at forced breaks. Characters that markdown would take for its own are escaped. White space at
the ends of inline elements goes outside of their marks; elements without content are left out; other elements are their content, blocks apart from each other.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of elements.
BLOCKS = frozenset(
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr".split())
#: Elements that mean something without content.
MEANT = frozenset("a table thead tbody tfoot th td iframe script audio video".split())
#: What a beginning element ends: of these, the nearest open one, up to the nearest of those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
#: Elements that stand within each other; what is deeper is taken as content of the last one.
DEEPEST = 150
#: Pattern and replacement of each escape.
ESCAPES = [(re.compile(p), r) for p, r in ((r"\\", r"\\\\"), (r"\*", r"\\*"), (r"\A-", r"\\-"), (r"\A\+ ", r"\\+ "), (r"\A(=+)", r"\\\1"), (r"\A(#{1,6}) ", r"\\\1 "), ("`", r"\\`"), (r"\A~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), (r"\A>", r"\\>"), ("_", r"\\_"), (r"\A(\d+)\. ", r"\1\\. "))]
SPECIAL = re.compile(r"[\\*\-+=#`~\[\]>_0-9]")


class Node:
    """An element: its tag, attributes and content, texts and nodes."""

    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(k.data if isinstance(k, Text) else k.text() for k in self.kids)


class Text:
    __slots__ = ("data",)

    def __init__(self, data: str):
        self.data = data


class Tree(HTMLParser):
    """Reads a page into `root`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def close_to(self, tags: set, barrier: set) -> None:
        node, up = self.at, 0
        while node.parent is not None and node.tag not in barrier:
            up += 1
            if node.tag in tags:
                self.at, self.depth = node.parent, self.depth - up
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.close_to({"p"}, {"table", "td", "th", "button", "li"} - {tag})
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        node = Node(tag, dict(attrs), self.at)
        if tag in VOID:
            self.at.kids.append(node)
        elif self.depth < DEEPEST:
            self.at.kids.append(node)
            self.at, self.depth = node, self.depth + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in VOID:
            self.close_to(HEADINGS if tag in HEADINGS else {tag}, set() if tag in ("table", "body", "html", "div", "section", "article", "main", "ul", "ol") else {"table"} - {tag} if tag not in ("tr", "td", "th", "tbody", "thead", "tfoot") else {"table"})

    def handle_data(self, data):
        self.at.kids.append(Text(data))


def collapse(root: Node) -> None:
    """Collapse white space outside of pre: runs become a space, none stands at the ends of blocks or behind another one."""
    last, keep = None, False

    def edge() -> None:
        nonlocal last, keep
        if last is not None:
            last.data = last.data.removesuffix(" ")
        last, keep = None, False

    def walk(node: Node) -> None:
        nonlocal last, keep
        for kid in node.kids:
            if isinstance(kid, Text):
                data = re.sub(r"[ \r\n\t]+", " ", kid.data)
                if (last is None or last.data.endswith(" ")) and not keep and data.startswith(" "):
                    data = data[1:]
                kid.data = data
                if data:
                    last = kid
            elif kid.tag == "pre":
                edge()
                last, keep = None, False
            elif kid.tag in BLOCKS or kid.tag == "br":
                edge()
                walk(kid)
                edge()
            elif kid.tag in VOID:
                last, keep = None, True
            else:
                if last is not None:
                    keep = False
                walk(kid)

    walk(root)
    edge()


def blank(node: Node) -> bool:
    """Whether an element has nothing to say."""
    if node.tag in VOID or node.tag in MEANT or node.text().strip():
        return False
    todo = list(node.kids)
    while todo:
        kid = todo.pop()
        if isinstance(kid, Node):
            if kid.tag in VOID or kid.tag in MEANT:
                return False
            todo += kid.kids
    return True


def joined(a: str, b: str) -> str:
    """a and b with as many line breaks between them as either asks for, two at most."""
    left, right = a.rstrip("\n"), b.lstrip("\n")
    return left + "\n" * min(2, max(len(a) - len(left), len(b) - len(right))) + right


def escaped(text: str) -> str:
    if SPECIAL.search(text):
        for pattern, by in ESCAPES:
            text = pattern.sub(by, text)
    return text


def content(node: Node, code: bool) -> str:
    out = ""
    for i, kid in enumerate(node.kids):
        if isinstance(kid, Text):
            out = joined(out, kid.data if code else escaped(kid.data))
        else:
            out = joined(out, written(kid, i, code))
    return out


def beside(parent: Node, i: int, step: int) -> bool:
    """Whether what stands next to child i ends, or begins, with a space."""
    if not 0 <= i + step < len(parent.kids):
        return False
    kid = parent.kids[i + step]
    text = kid.data if isinstance(kid, Text) else "" if kid.tag in BLOCKS else kid.text()
    return text[-1:] == " " if step < 0 else text[:1] == " "


def written(node: Node, i: int, code: bool) -> str:
    """The markdown of an element, child i of its parent."""
    tag, block = node.tag, node.tag in BLOCKS
    inner = code or tag in ("code", "pre")
    if blank(node):
        return "\n\n" if block else " " if node.text() and not beside(node.parent, i, -1) and not beside(node.parent, i, 1) else ""
    text = content(node, inner)
    lead = trail = ""
    if not block and tag not in VOID:
        whole = node.text()
        lead, trail = whole[: len(whole) - len(whole.lstrip())], whole[len(whole.rstrip()) :]
        lead = "" if lead[:1] in (" ", "\t", "\n") and beside(node.parent, i, -1) else lead
        trail = "" if trail[-1:] in (" ", "\t", "\n") and beside(node.parent, i, 1) else trail
        if lead or trail or whole[:1].isspace() or whole[-1:].isspace():
            text = text.strip()
    return lead + marked(node, tag, block, text, code) + trail


def marked(node: Node, tag: str, block: bool, text: str, code: bool) -> str:
    a = node.attrs
    if tag in HEADINGS:
        return f"\n\n{'#' * int(tag[1])} {text}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "blockquote":
        return "\n\n" + re.sub(r"(?m)^", "> ", text.strip("\n")) + "\n\n"
    if tag in ("ul", "ol"):
        own = [k for k in node.parent.kids if isinstance(k, Node)]
        return "\n" + text if node.parent.tag == "li" and own[-1] is node else f"\n\n{text}\n\n"
    if tag == "li":
        return item(node, text)
    if tag == "pre" and len(node.kids) and isinstance(node.kids[0], Node) and node.kids[0].tag == "code":
        return fenced(node.kids[0])
    if code or tag == "pre" and not block:
        return text
    if tag == "a" and a.get("href"):
        href = re.sub(r"([()])", r"\\\1", a["href"])
        return f"[{text}]({href}{titled(a, True)})"
    if tag in ("em", "i") and text.strip():
        return f"_{text}_"
    if tag in ("strong", "b") and text.strip():
        return f"**{text}**"
    if tag == "code" and text:
        line = re.sub(r"\r?\n|\r", " ", text)
        pad = " " if re.search(r"^`|^ .*?[^ ].* $|`$", line) else ""
        mark = "`"
        while mark in re.findall("`+", line):
            mark += "`"
        return f"{mark}{pad}{line}{pad}{mark}"
    if tag == "img":
        alt = re.sub(r"(\n+\s*)+", "\n", a.get("alt") or "")
        return f"![{alt}]({a['src']}{titled(a)})" if a.get("src") else ""
    return f"\n\n{text}\n\n" if block else text


def titled(a: dict, quoted: bool = False) -> str:
    title = re.sub(r"(\n+\s*)+", "\n", a.get("title") or "")
    return f' "{title.replace(chr(34), chr(92) + chr(34)) if quoted else title}"' if title else ""


def item(node: Node, text: str) -> str:
    parent = node.parent
    own = [k for k in parent.kids if isinstance(k, Node)]
    mark = "-   "
    if parent.tag == "ol":
        start = re.match(r"\d+", parent.attrs.get("start") or "")
        mark = f"{(int(start[0]) if start else 1) + next(k for k, x in enumerate(own) if x is node)}.  "
    text = re.sub(r"\n+\Z", "\n", text.lstrip("\n")).replace("\n", "\n    ")
    text = re.sub(r"\n[ ]+\Z", "\n", text)
    return mark + text + ("\n" if parent.kids[-1] is not node and not text.endswith("\n") else "")


def fenced(code: Node) -> str:
    text = code.text()
    language = re.search(r"language-(\S+)", code.attrs.get("class") or "")
    size = max([3, *(len(m) + 1 for m in re.findall(r"(?m)^`{3,}", text))])
    return f"\n\n{'`' * size}{language[1] if language else ''}\n{text.removesuffix(chr(10))}\n{'`' * size}\n\n"


def markdown(html: str) -> str:
    tree = Tree()
    tree.feed(html)
    tree.close()
    collapse(tree.root)
    return re.sub(r"\A[\t\r\n]+|[\t\r\n\s]+\Z", "", content(tree.root, False)).strip()


@F.arrow_udf(T.StringType())
def html_to_markdown(html: pa.Array) -> pa.Array:
    return pa.array((markdown(x.as_py()) if x.is_valid else None for x in html), pa.string(), size=len(html))
