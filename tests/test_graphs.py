"""Parsing rules, statuses, projection and alignment, one case each."""

import pytest

from lexigraph.functions import alignment, graphs

CASES = {
    "a.n.01": "success",
    "a.n.01 b.v.01 Theme -1": "success",
    "a.n.01 Theme -9": "ill_formed",
    "a.n.01 NEGATION <1 b.n.01 Theme +1": "parse_error",
    "a.n.01 Theme +0": "parse_error",
    'a.n.01 Name "New Town"': "success",
    'a.n.01 Name "New': "parse_error",
    "a.n.01 NEGATION foo b.n.01": "success",
    "a.n.01 EQU <1": "parse_error",
    "foo": "parse_error",
    "a.n.01 Theme": "parse_error",
    "": "parse_error",
}


@pytest.mark.parametrize("text,status", CASES.items())
def test_status(text, status):
    assert graphs.status_of(text)[0] == status


def test_boxes_and_indices():
    g = graphs.parse("a.n.01 NEGATION <1 b.n.01 POSSIBILITY <2 c.n.01 NEGATION foo d.n.01")
    assert sum(k == "box" for k, _ in g.nodes) == 3
    links = {(a[1], b[1]): t for (a, b), (k, t) in g.edges.items() if k == "box-box-connect"}
    assert links == {(0, 1): "NEGATION", (0, 2): "POSSIBILITY"}
    assert graphs.parse("a.n.01 b.n.01 Theme -12").edges[("synset", 1), ("synset", 0)] == ("role", "Theme")
    g = graphs.parse("a.n.01 b.n.01 Theme -1 Agent -1")
    assert g.edges[("synset", 1), ("synset", 0)] == ("role", "Agent") and len(g.edges) == 3
    g = graphs.parse("a.n.01 NEGATION <1 b.v.01 Proposition >1 NEGATION <0 c.n.01")
    assert g.edges[("synset", 1), ("box", 2)][0] == "syn-box-connect" and (("box", 1), ("box", 2)) not in g.edges


def test_penman_and_notation():
    text = 'a.n.01 PartOf "x" b.v.01 Theme -1'
    p = graphs.penman(graphs.parse(text))
    assert ':Part-of "x"' in p and p.startswith("(b0 / box")
    assert graphs.notation(graphs.parse(text)) == text
    assert graphs.quote("'1990'") == '"1990"'


def test_projection_reaches_the_repaired_graph():
    said = graphs.parse('be.v.01 Theme +1 a.n.01 CORRECTION <1 red.a.01 Value "x" CONJUNCTION <2 blue.a.01')
    want = graphs.parse("be.v.01 Theme +1 a.n.01 blue.a.01")
    got = graphs.project(said)
    assert graphs.isomorphic(got, want)
    assert graphs.isomorphic(graphs.project(graphs.parse("a.n.01 CONJUNCTION <1 b.n.01")), graphs.parse("a.n.01 CONJUNCTION <1 b.n.01"))
    assert not graphs.isomorphic(want, graphs.parse("be.v.01 Theme +1 a.n.01 green.a.01"))
    assert graphs.upright(graphs.parse("a.n.01 b.n.01 PartOf -1")).edges[("synset", 0), ("synset", 1)] == ("role", "Part")


def test_alignment():
    texts = ["a.n.01 b.v.01 Theme -1 Agent +1 c.n.01", "c.n.01 b.v.01 Theme -1 Agent +1 a.n.01", 'a.n.01 Name "x" NEGATION <1 b.v.01 Agent -1', "a.n.01 a.n.01 a.n.01 Theme -1 Agent -2"]
    pens = [graphs.penman(graphs.parse(t)) for t in texts]
    for p in pens:
        assert alignment.score(p, p)[2] == 1.0
        for q in pens:
            exact, climbed = alignment.score(p, q), alignment.score(p, q, "climb")
            assert exact[3] == "exact" and exact[2] >= climbed[2] - 1e-12
            back = alignment.score(q, p)
            assert (back[0], back[1]) == pytest.approx((exact[1], exact[0]))
