"""Graphs of box notation: parsing, status, Penman and notation text, repair projection, isomorphism.

Pure Python over one document at a time; operators/graph_ops.py runs it on DataFrames. A graph is a Graph of
nodes (kind, index) -> attributes in order of creation, and edges (source, target) -> (edge kind, token). Parallel
edges collapse: the last token stays at the first one's place. Documented parsing rules:

* prefix matching of synsets, indices and quoted names;
* an index after a role or operator counts with its first digit only;
* a box indicator takes the next token; if that isn't an index, it is dropped and no box is made;
* a role with < or > points to a box; an operator with them is an error;
* targets between 0 and the number of lines that have no synset give a broken graph, which fails when written.
"""

from __future__ import annotations

import re

from . import vocab

SYNSET, INDEX, NAME = (re.compile(p) for p in (vocab.SYNSET, vocab.INDEX, vocab.NAME))
BOXES, OPERATORS, ROLES, INVERTIBLE = map(frozenset, (vocab.BOX_INDICATORS, vocab.OPERATORS, vocab.ROLES, vocab.INVERTIBLE_ROLES))


class NotationError(ValueError):
    """Text that isn't box notation, or a graph that can't be written; ill_formed tells the second kind apart."""

    def __init__(self, message: str, ill_formed: bool = False):
        super().__init__(message)
        self.ill_formed = ill_formed


class Graph:
    def __init__(self):
        self.nodes: dict[tuple[str, int], dict] = {}
        self.edges: dict[tuple[tuple[str, int], tuple[str, int]], tuple[str, str]] = {}
        self.suspect = False
        self._made: dict[str, int] = {}
        self._out: tuple[dict, int, dict] | None = None

    def add(self, kind: str, token: str, **more) -> tuple[str, int]:
        node = (kind, self._made.get(kind, 0))
        self._made[kind] = node[1] + 1
        self.nodes[node] = {"token": token, **more}
        return node

    def link(self, a, b, kind: str, token: str) -> None:
        for end in (a, b):
            self.nodes.setdefault(end, {})
        self.edges[a, b] = (kind, token)
        self._out = None

    def children(self, node):
        if self._out is None or self._out[0] is not self.edges or self._out[1] != len(self.edges):
            below: dict = {}
            for (a, b), e in self.edges.items():
                below.setdefault(a, []).append((b, *e))
            self._out = (self.edges, len(self.edges), below)
        return self._out[2].get(node, [])

    def without(self, gone: set) -> Graph:
        out = Graph()
        out.suspect = self.suspect
        out.nodes = {n: v for n, v in self.nodes.items() if n not in gone}
        out.edges = {k: v for k, v in self.edges.items() if k[0] not in gone and k[1] not in gone}
        return out

    def acyclic(self) -> bool:
        waiting = dict.fromkeys(self.nodes, 0)
        for _, b in self.edges:
            waiting[b] += 1
        free = [n for n, k in waiting.items() if not k]
        done = 0
        while free:
            n = free.pop()
            done += 1
            for b, _, _ in self.children(n):
                waiting[b] -= 1
                if not waiting[b]:
                    free.append(b)
        return done == len(self.nodes)


def lines_of(text: str, single: bool = True) -> list[tuple[list[str], str | None]]:
    """(tokens, comment) of each line; text on one line is broken before synsets and box indicators."""
    if single:
        text = "".join(("\n" if SYNSET.match(t) or t in BOXES else " ") + t for t in text.split(" "))
    out = []
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("%%%"):
            continue
        body, _, comment = line.partition(" % ")
        if body.startswith("%"):
            continue
        out.append((body.split(), comment.strip() or None))
    return [x for x in out if x[0]]


def box_step(index: str) -> int:
    try:
        return int(index.replace("<", "-").replace(">", "+"))
    except ValueError:
        raise NotationError(f"{index} isn't an index") from None


def parse(text: str, single: bool = True) -> Graph:
    lines = lines_of(text or "", single)
    if not lines:
        raise NotationError("nothing to parse")
    g, limit, links = Graph(), len(lines) - 1, []
    box = g.add("box", "box")
    synset = None
    for tokens, comment in lines:
        queue = tokens[::-1]
        first = True
        while queue:
            tok = queue.pop()
            m = SYNSET.match(tok)
            if first and m:
                lemma, pos, sense = m.groups()
                synset = g.add("synset", tok, lemma=lemma, pos=pos, sense=sense, comment=comment)
                links.append((box, synset, "box-connect", "member"))
            elif tok in BOXES:
                if not queue:
                    raise NotationError(f"{tok} has no index")
                index = queue.pop()
                if INDEX.match(index):
                    step = box_step(index)
                    parent = ("box", box[1] + step + 1)
                    new = g.add("box", "box", comment=comment)
                    if step:
                        links.append((parent, new, "box-box-connect", tok))
                    box = new
            elif tok in ROLES or tok in OPERATORS:
                if not queue:
                    raise NotationError(f"{tok} has no target")
                target, kind = queue.pop(), "role" if tok in ROLES else "drs-operator"
                if synset is None:
                    raise NotationError(f"{tok} before any synset")
                index = INDEX.match(target)
                if index and tok in ROLES and target[0] in "<>":
                    links.append((synset, ("box", box[1] + box_step(target)), "syn-box-connect", tok))
                elif index:
                    if target[0] in "<>":
                        raise NotationError(f"{tok} can't point to a box")
                    to = synset[1] + int(index.group(0))
                    if 0 <= to <= limit:
                        links.append((synset, ("synset", to), kind, tok))
                    else:
                        g.suspect = True
                        links.append((synset, g.add("constant", target, comment=comment), kind, tok))
                elif NAME.match(target):
                    parts = [target]
                    while not parts[-1].endswith('"') or parts == ['"']:
                        if not queue:
                            raise NotationError("a quoted name has no end")
                        parts.append(queue.pop())
                    links.append((synset, g.add("constant", " ".join(parts), comment=comment), "role", tok))
                else:
                    links.append((synset, g.add("constant", target, comment=comment), "role", tok))
            else:
                raise NotationError(f"unknown token {tok}")
            first = False
    for link in links:
        g.link(*link)
    return g


def quote(token: str) -> str:
    if len(token) > 1 and token[0] == token[-1] == '"':
        return token
    if len(token) > 1 and token[0] == token[-1] == "'":
        return f'"{token[1:-1]}"'
    return f'"{token}"'


def penman(g: Graph, strict: bool = True) -> str:
    """Nested text from the first node without parents; what can't be reached from it is left out."""
    if not g.acyclic():
        raise NotationError("the graph has a cycle")
    if strict and g.suspect:
        raise NotationError("ill-formed index", ill_formed=True)
    if any("token" not in v for v in g.nodes.values()):
        raise NotationError("an index points to no synset")
    count: dict[str, int] = {}
    name = {}
    for n in g.nodes:
        letter = n[0][0]
        name[n] = f"{letter}{count.get(letter, 0)}"
        count[letter] = count.get(letter, 0) + 1
    below = {b for _, b in g.edges}
    root = next(n for n in g.nodes if n not in below)
    seen: set = set()

    def write(n, depth: int) -> str:
        data = g.nodes[n]
        if n[0] == "constant" and strict:
            return quote(data["token"])
        if n in seen:
            return name[n]
        seen.add(n)
        if n[0] == "synset" and not strict:
            out = f'({name[n]} / "synset" :lemma {quote(data["lemma"])} :pos {quote(data["pos"])}'
        else:
            out = f"({name[n]} / {'box' if n[0] == 'box' else quote(data['token'])}"
        for b, _, token in g.children(n):
            label = f"{token[:-2]}-of" if token in INVERTIBLE else token
            out += f"\n{'    ' * (depth + 1)}:{label} {write(b, depth + 1)}"
        return out + ")"

    return write(root, 0)


def status_of(text: str | None, strict: bool = True) -> tuple[str, str | None]:
    """("success", penman), or ("ill_formed" or "parse_error", None)."""
    try:
        return "success", penman(parse(text or ""), strict)
    except NotationError as e:
        return ("ill_formed" if e.ill_formed else "parse_error"), None
    except (KeyError, IndexError, ValueError, RecursionError):
        return "parse_error", None


def notation(g: Graph) -> str:
    """One-line box notation; boxes with several children and links from synsets to boxes can't be written."""
    out = []
    boxes = [n for n in g.nodes if n[0] == "box"]
    parent = {b: token for (_, b), (kind, token) in g.edges.items() if kind == "box-box-connect"}
    for b in boxes:
        if sum(kind == "box-box-connect" for _, kind, _ in g.children(b)) > 1:
            raise NotationError("a box has several children")
        if b in parent:
            out.append(f"{parent[b]} -1")
        for s, kind, _ in g.children(b):
            if kind != "box-connect":
                continue
            out.append(g.nodes[s]["token"])
            for t, kind2, token in g.children(s):
                if kind2 == "syn-box-connect":
                    raise NotationError("a synset points to a box")
                out.append(f"{token} {t[1] - s[1]:+d}" if t[0] == "synset" else f"{token} {g.nodes[t]['token']}")
    return " ".join(out)


def repair_pairs(g: Graph) -> list[tuple]:
    """(parent, correction box, conjunction box) of sibling boxes."""
    kids: dict = {}
    for (a, b), (kind, token) in g.edges.items():
        if kind == "box-box-connect":
            kids.setdefault(a, {}).setdefault(token, []).append(b)
    return [(p, c, j) for p, k in kids.items() for c in k.get("CORRECTION", ()) for j in k.get("CONJUNCTION", ())]


def closure(g: Graph, box) -> set:
    """What hangs below a box by membership and box links."""
    found, todo = set(), [box]
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo += [b for b, kind, _ in g.children(n) if kind in ("box-connect", "box-box-connect")]
    return found


def upright(g: Graph) -> Graph:
    """Invertible role edges between two non-constants are turned round and lose their Of; they replace edges that stand there."""
    out = Graph()
    out.nodes, out.suspect = dict(g.nodes), g.suspect
    turned = {k: e for k, e in g.edges.items() if e[0] == "role" and e[1] in INVERTIBLE and "constant" not in (k[0][0], k[1][0])}
    for (a, b), (kind, token) in g.edges.items():
        if (a, b) not in turned:
            out.link(a, b, kind, token)
    for (a, b), (kind, token) in turned.items():
        out.link(b, a, kind, token[:-2])
    return out


def project(g: Graph, normalise: bool = True) -> Graph:
    """The graph after its repairs: corrections go, what they are conjoined with moves up, orphan constants go."""
    for parent, wrong, right in repair_pairs(g):
        if wrong not in g.nodes or right not in g.nodes:
            continue
        members = [b for b, kind, _ in g.children(right) if kind == "box-connect"]
        gone = closure(g, wrong)
        for m in members:
            if m not in gone:
                g.edges = {**g.edges, (parent, m): ("box-connect", "member")}
        g = g.without(gone | {right})
    used = {b for _, b in g.edges}
    g = g.without({n for n in g.nodes if n[0] == "constant" and n not in used})
    return upright(g) if normalise else g


def isomorphic(a: Graph, b: Graph) -> bool:
    """Whether some renaming maps one graph onto the other with equal node and edge tokens."""
    if len(a.nodes) != len(b.nodes) or len(a.edges) != len(b.edges):
        return False

    def signs(g: Graph) -> dict:
        s = {n: v.get("token") for n, v in g.nodes.items()}
        for _ in range(3):
            s = {n: hash((s[n], tuple(sorted((t, str(s[y])) for (x, y), (_, t) in g.edges.items() if x == n)), tuple(sorted((t, str(s[x])) for (x, y), (_, t) in g.edges.items() if y == n)))) for n in g.nodes}
        return s

    sa, sb = signs(a), signs(b)
    if sorted(sa.values()) != sorted(sb.values()):
        return False
    order = sorted(a.nodes, key=lambda n: sum(v == sa[n] for v in sa.values()))
    to: dict = {}

    def fits(n, m) -> bool:
        for o, p in to.items():
            for x, y in (((n, o), (m, p)), ((o, n), (p, m))):
                ea, eb = a.edges.get(x), b.edges.get(y)
                if (ea is None) != (eb is None) or ea and ea[1] != eb[1]:
                    return False
        return (a.edges.get((n, n)) or (0, 0))[1] == (b.edges.get((m, m)) or (0, 0))[1]

    def place(i: int) -> bool:
        if i == len(order):
            return True
        for m in b.nodes:
            if m not in to.values() and sb[m] == sa[order[i]] and fits(order[i], m):
                to[order[i]] = m
                if place(i + 1):
                    return True
                del to[order[i]]
        return False

    return place(0)
