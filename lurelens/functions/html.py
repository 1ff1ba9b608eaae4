"""Small HTML helpers that run inside tasks, one page at a time."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

# Attribute names and value shapes that change on every request.
STRIPPED_NAMES = ("nonce",)
STRIPPED_PARTS = ("csrf", "token")
EPHEMERAL_VALUES = (
    r"^\d{10,13}$",
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9a-fA-F]{32}$",
    r"^[0-9a-fA-F]{40}$",
    r"^[0-9a-fA-F]{64}$",
)
KEPT_NAMES = ("id", "class")

# Input types that say nothing about credentials.
IGNORED_FIELD_TYPES = (
    "hidden", "submit", "button", "reset", "image", "checkbox", "radio", "file", "color", "range",
)
LABEL_CHARS = 60

_EPHEMERAL = re.compile("|".join(EPHEMERAL_VALUES))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FIELDS = ("input", "select", "textarea")
_HEAD_TEXT = frozenset("title style script noscript template".split())
_HEAD = _HEAD_TEXT | frozenset("base link meta".split())


def _is_ephemeral(value: str) -> bool:
    return any(part in value.lower() for part in STRIPPED_PARTS) or bool(_EPHEMERAL.search(value))


def stable_attributes(attrs: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
    """Attributes that stay the same between two requests, sorted."""
    pairs = sorted((name.lower(), value or "") for name, value in attrs)
    changing = [pair for pair in pairs if _is_ephemeral(pair[1])]
    by_request = {name for name, _ in pairs if name in STRIPPED_NAMES or any(part in name for part in STRIPPED_PARTS)}
    if changing:
        by_request.add("value")  # of an element that carries a token, the token is the value
    dropped = [pair for pair in changing if pair[0] not in KEPT_NAMES]
    return [pair for pair in pairs if pair[0] not in by_request and pair not in dropped]


class _Canonical(HTMLParser):
    """Re-serialises a page with stable attributes only; the head of a full document is left out.

    A head ends where it is closed, or before the first element or text that cannot stand in one. Text is escaped, so
    it never looks like an element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.in_head = False
        self.in_head_text = False

    def _put(self, text: str) -> None:
        if not self.in_head:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.in_head = True
            return
        if self.in_head and tag not in _HEAD:
            self.in_head = False
        self.in_head_text = self.in_head and tag in _HEAD_TEXT
        if tag not in ("html", "body"):
            self._put(f"<{tag}" + "".join(f" {n}={v!r}" for n, v in stable_attributes(attrs)) + ">")

    def handle_endtag(self, tag):
        self.in_head_text = False
        if tag == "head":
            self.in_head = False
        elif tag not in ("html", "body") and tag not in _VOID:
            self._put(f"</{tag}>")

    def handle_data(self, data):
        if data.strip():
            self.in_head = self.in_head and self.in_head_text
        elif not self.out:
            return  # white space before any content
        self._put(escape(data, quote=False))

    def handle_comment(self, data):
        self._put(f"<!--{data}-->")


def canonical_markup(page: str) -> str:
    """Page text that is equal for two captures of the same page state."""
    parser = _Canonical()
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "_Node | None") -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self, without_fields: bool = False) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            elif not (without_fields and node.tag in _FIELDS):
                todo.extend(reversed(node.children))
        return " ".join("".join(parts).split())


class _Tree(HTMLParser):
    """Element tree of one page plus its fields and ids in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.fields: list[_Node] = []
        self.by_id: dict[str, _Node] = {}
        self.label_for: dict[str, _Node] = {}

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {n.lower(): v or "" for n, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if node.attrs.get("id"):
            self.by_id.setdefault(node.attrs["id"], node)
        if tag == "label" and node.attrs.get("for"):
            self.label_for.setdefault(node.attrs["for"], node)
        if tag in _FIELDS:
            self.fields.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _label(tree: _Tree, field: _Node) -> str:
    """Label by ``for``, enclosing label, labelled-by, aria-label, placeholder, then the text before the field."""
    explicit = tree.label_for.get(field.attrs.get("id") or "")
    if explicit is not None:
        return explicit.text()
    wrap = field.parent
    while wrap is not None and wrap.tag != "label":
        wrap = wrap.parent
    if wrap is not None and wrap.text(without_fields=True):
        return wrap.text(without_fields=True)
    named = tree.by_id.get(field.attrs.get("aria-labelledby") or "")
    if named is not None:
        return named.text()
    for attribute in ("aria-label", "placeholder"):
        if field.attrs.get(attribute):
            return " ".join(field.attrs[attribute].split())
    siblings = [c for c in field.parent.children if isinstance(c, _Node)]
    for sibling in reversed(siblings[:siblings.index(field)]):
        if sibling.text():
            return sibling.text()[:LABEL_CHARS]
    return ""


def form_fields(page: str) -> list[dict[str, str]]:
    """Fields a visitor fills in: tag, type, name or id, and the label next to it."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    found = []
    for field in tree.fields:
        kind = field.tag if field.tag != "input" else field.attrs.get("type", "").lower()
        if kind not in IGNORED_FIELD_TYPES:
            name = field.attrs.get("name") or field.attrs.get("id") or ""
            found.append({"tag": field.tag, "type": kind, "name_or_id": name, "nearby_label_text": _label(tree, field)})
    return found
