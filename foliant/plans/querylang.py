"""The boolean query language: text -> tokens -> tree, and the flat view of a query.

    tag:A  path:GLOB  -word  -"phrase"  "phrase"  AND OR NOT ( )

One tokenizer feeds both views. Parsing never raises: stray parentheses and dangling operators are ignored, an unclosed quote
makes the query invalid and searches its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Tag:
    name: str


@dataclass(frozen=True)
class Path:
    pattern: str


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


Node = Tag | Path | Term | Not | And | Or


@dataclass
class ParsedQuery:
    clean_query: str = ""
    tag_filters: list[str] = field(default_factory=list)
    path_filters: list[str] = field(default_factory=list)
    exclude_terms: list[str] = field(default_factory=list)
    phrase: str | None = None
    is_valid: bool = True
    warn: str = ""
    expr: Node | None = None
    has_boolean: bool = False


def _tokens(raw: str) -> tuple[list[tuple[str, object]], bool]:
    """((kind, value)...), whether a quote is left open. Kinds: ( ) and or not, and atom with a node."""
    out: list[tuple[str, object]] = []
    i, n = 0, len(raw)

    def quoted(at: int) -> tuple[str, int] | None:
        end = raw.find('"', at + 1)
        return None if end < 0 else (raw[at + 1 : end], end + 1)

    while i < n:
        c = raw[i]
        if c.isspace():
            i += 1
            continue
        if c in "()":
            out.append((c, None))
            i += 1
            continue
        negative = c == "-" and i + 1 < n and not raw[i + 1].isspace() and raw[i + 1] not in "()"
        i += negative
        if raw[i] == '"':
            found = quoted(i)
            if found is None:
                return out, True
            text, i = found
            node: Node | None = Term(text.strip(), True) if text.strip() else None
        else:
            key = next((k for k in ("tag:", "path:") if raw[i : i + len(k)].lower() == k), None)
            at = i + len(key or "")
            if key and at < n and raw[at] == '"':
                found = quoted(at)
                if found is None:
                    return out, True
                text, i = found
            else:
                i = at
                while i < n and not raw[i].isspace() and raw[i] not in '()"':
                    i += 1
                text = raw[at:i]
            if key:
                node = (Tag(text) if key == "tag:" else Path(text)) if text else None
            elif not negative and text.upper() in ("AND", "OR", "NOT"):
                out.append((text.lower(), None))
                continue
            else:
                node = Term(text) if text else None
        if node is not None:
            out.append(("atom", Not(node) if negative else node))
    return out, False


class _Parser:
    """OR binds loosest, then (implicit) AND, then NOT. Operators without an operand vanish."""

    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self):
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def either(self) -> Node | None:
        parts = [self.both()]
        while self.peek() == "or":
            self.at += 1
            parts.append(self.both())
        return _join(Or, parts)

    def both(self) -> Node | None:
        parts = []
        while (k := self.peek()) is not None and k not in ("or", ")"):
            if k == "and":
                self.at += 1
            else:
                parts.append(self.unary())
        return _join(And, parts)

    def unary(self) -> Node | None:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "not":
            if self.peek() in (None, "or", ")"):
                return None
            if self.peek() == "and":
                self.at += 1
                return self.unary() if self.peek() is not None else None
            child = self.unary()
            return None if child is None else Not(child)
        if kind == "(":
            inner = self.either()
            if self.peek() == ")":
                self.at += 1
            return inner
        return value


def _join(kind, parts):
    flat = [c for p in parts if p is not None for c in (p.children if isinstance(p, kind) else (p,))]
    return None if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))


def _tree(tokens) -> Node | None:
    parts, parser = [], _Parser(tokens)
    while parser.at < len(tokens):
        parts.append(parser.either())
        if parser.peek() == ")":  # a stray one
            parser.at += 1
    return _join(And, parts)


def positive_terms(node: Node | None) -> list[Term]:
    """Terms outside any NOT, in order."""
    if isinstance(node, Term):
        return [node]
    if isinstance(node, And | Or):
        return [t for c in node.children for t in positive_terms(c)]
    return []


def _flat(node: Node | None) -> tuple[list[str], list[str], list[str]]:
    """Tags, paths and excluded terms of the top-level conjunction."""
    tags, paths, out = [], [], []
    for c in node.children if isinstance(node, And) else (node,):
        if isinstance(c, Tag):
            tags.append(c.name)
        elif isinstance(c, Path):
            paths.append(c.pattern)
        elif isinstance(c, Not) and isinstance(c.child, Term):
            out.append(c.child.text)
    return tags, paths, out


def parse_query(raw: str | None) -> ParsedQuery:
    raw = raw or ""
    tokens, open_quote = _tokens(raw)
    if open_quote:
        tags, paths, out = _flat(_tree(tokens))
        return ParsedQuery(raw.strip(), tags, paths, out, None, False, "unclosed quote: the whole text is searched")
    tree = _tree(tokens)
    tags, paths, out = _flat(tree)
    words = positive_terms(tree)
    boolean = any(k in ("or", "not", "(", ")") for k, _ in tokens) or any(k == "atom" and isinstance(v, Not) and isinstance(v.child, Tag | Path) for k, v in tokens)
    phrase = next((t.text for t in words if t.phrase), None)
    return ParsedQuery(" ".join(t.text for t in words), tags, paths, out, phrase, True, "", tree, boolean)


def tag_query(tags: list[str], op: str = "AND") -> ParsedQuery:
    """The query of a tag picker."""
    nodes = tuple(Tag(t) for t in tags if t)
    if op.upper() == "OR" and len(nodes) > 1:
        return ParsedQuery(expr=Or(nodes), has_boolean=True)
    return ParsedQuery(tag_filters=[n.name for n in nodes], expr=_join(And, list(nodes)))


def combine(text: ParsedQuery, tag: ParsedQuery | None) -> ParsedQuery:
    """Both queries at once; retrieval text and phrase come from the first."""
    if tag is None or tag.expr is None and not tag.tag_filters:
        return text
    tree = _join(And, [text.expr, tag.expr])
    merge = lambda a, b: list(dict.fromkeys([*a, *b]))
    return ParsedQuery(text.clean_query, merge(text.tag_filters, tag.tag_filters), merge(text.path_filters, tag.path_filters), merge(text.exclude_terms, tag.exclude_terms), text.phrase, text.is_valid, text.warn, tree, text.has_boolean or tag.has_boolean)


def without(raw: str, token: str) -> str:
    """The query text without one condition."""
    at = raw.find(token)
    return raw.strip() if at < 0 else " ".join((raw[:at] + " " + raw[at + len(token) :]).split())
