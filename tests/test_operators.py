"""Sources, sinks, repairs, alignment and the small operators, one case each."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import alignment, graphs, repairs
from lexigraph.functions import text as X
from lexigraph.operators import analytics as A
from lexigraph.operators import fine_grained as FG
from lexigraph.operators import graph_ops as G
from lexigraph.operators import records as R
from lexigraph.operators import splitting
from lexigraph.plans import registry
from lexigraph.sources import records as SRC
from lexigraph.sources import sinks as K


@pytest.mark.parametrize("original,repaired,want", [
    ("My house is red", "Your house, my house is red", "Your house, I mean, my house is red"),
    ("a b c", "a x, b c", "a x, I mean, b c"),
    ("a b c", "a b x c", "a b x I mean, c"),
    ("a b c", "a x c", "a x c"),
    ("a b c", "a c", "a c"),
    ("a b", " ", ""), (None, "a", ""), ("a", None, ""), ("", "x", "x I mean,"),
])
def test_phrase_after_the_reparandum(original, repaired, want):
    assert repairs.with_phrase(original, repaired) == want


def test_edits_in_a_table(spark):
    df = spark.createDataFrame([(1, "a b c", "a x, b c", "keep"), (2, None, "x", "k")], "id int, a string, b string, edits0 string")
    got = {r.id: r for r in repairs.with_edits(df, "a", "b").collect()}
    assert [tuple(e) for e in got[1].edits] == [("equal", 0, 1, 0, 1), ("insert", 1, 1, 1, 2), ("equal", 1, 3, 2, 4)] and got[2].edits is None and got[1].edits0 == "keep"
    assert repairs.with_interregnum(df.limit(0), "a", "b").count() == 0


def test_corpus_folders(spark, tmp_path):
    for doc, raw, sbn, met in (("p00/d0001", "One\ntwo.", "a.n.01\nb.n.01", "ID 7"), ("p01/d0002", "Three.", "c.n.01", "x")):
        at = tmp_path / "en" / "gold" / doc
        at.mkdir(parents=True)
        for name, text in (("en.raw", raw), ("en.drs.sbn", sbn), ("en.met", met), ("other.txt", "no")):
            (at / name).write_text(text)
    docs = SRC.corpus_documents(SRC.read_corpus(spark, str(tmp_path)))
    got = sorted(tuple(r) for r in docs.collect())
    assert got == [("en", "gold", "p00/d0001", "One two.", "a.n.01\nb.n.01", "incident"), ("en", "gold", "p01/d0002", "Three.", "c.n.01", "pass")]
    (tmp_path / "ids.txt").write_text(" p01/d0002 \n\n")
    assert [r.id for r in SRC.chosen(docs, SRC.read_ids(spark, str(tmp_path / "ids.txt"))).collect()] == ["p01/d0002"]
    files = SRC.notation_files(spark, str(tmp_path / "en" / "gold" / "p01" / "d0002" / "en.drs.sbn"))
    assert [r.token for r in G.nodes(files, "file").where("node_type = 'synset'").collect()] == ["c.n.01"]


def test_tables_and_json(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "x"\\y', None), ("2", "plain", "z")], "id string, t string, v string")
    for name in ("a.tsv", "a.csv", "a.parquet"):
        K.write_table(df, str(tmp_path / name))
    assert sorted(r.id for r in SRC.read_table(spark, str(tmp_path / "a.tsv")).collect()) == ["1", "2"]
    assert sorted(map(tuple, SRC.read_table(spark, str(tmp_path / "a.parquet")).collect())) == sorted(map(tuple, df.collect()))
    assert SRC.read_table(spark, str(tmp_path / "a.csv")).schema.simpleString() == "struct<id:string,t:string,v:string>"
    (tmp_path / "odd.tsv").write_text("<built-in function id>\tnl\n7\thi\n")
    odd = R.renamed(SRC.read_table(spark, str(tmp_path / "odd.tsv")), {"<built-in function id>": "id"})
    assert [tuple(r) for r in odd.collect()] == [("7", "hi")] and odd.columns == ["id", "nl"]
    K.write_json(df, str(tmp_path / "j"))
    back = SRC.read_json(spark, str(tmp_path / "j"), "id string, t string, v string", {"t": "nl"})
    assert back.columns == ["id", "nl", "v"] and back.count() == 2
    K.write_json_array(df, str(tmp_path / "array"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))
    assert json.loads(text) == [{"id": "1", "t": 'say "x"\\y', "v": None}, {"id": "2", "t": "plain", "v": "z"}]
    assert SRC.read_json(spark, str(tmp_path / "array"), "id string", multi_line=True).count() == 2
    K.write_unquoted(df, str(tmp_path / "u"))
    assert any('say "x"' in p.read_text() for p in (tmp_path / "u").glob("part-*"))
    K.write_partitioned(df, str(tmp_path / "p"), "id")
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"id=1", "id=2"}
    K.write_each(spark.createDataFrame([("p00/d1", "a.n.01")], "id string, sbn string"), str(tmp_path / "each"), "id", "sbn")
    assert [p.read_text() for p in (tmp_path / "each" / "key=p00_d1").glob("part-*")] == ["a.n.01\n"]


def test_ids_and_line_pairs(spark, tmp_path):
    (tmp_path / "l.md").write_text("# A\n- **p00/d0001** x\n# B\n- **p02/d0003** y **p02/d0004**\n# C\n- **p09/d0009**\n")
    assert [r.id for r in SRC.markdown_ids(spark, str(tmp_path / "l.md"), "# B", "# C").collect()] == ["p02/d0003", "p02/d0004"]
    (tmp_path / "gold").write_text("1\tsentence\ta.n.01\n2\ts\tb.n.01 c.v.01 Agent -1\n")
    (tmp_path / "pred").write_text("a.n.01\nb.n.01\n")
    gold, pred = SRC.numbered_lines(spark, str(tmp_path / "gold"), True), SRC.numbered_lines(spark, str(tmp_path / "pred"))
    pairs = R.positional(pred, gold, "line_no")
    assert sorted(tuple(r) for r in pairs.select("line_no", "text", "other").collect()) == [(0, "a.n.01", "a.n.01"), (1, "b.n.01", "b.n.01 c.v.01 Agent -1")]
    assert R.positional(pred.limit(1), gold, "line_no").count() == 0
    scored = {r.line_no: r for r in G.score_frame(pairs.withColumnRenamed("text", "pred_sbn"), gold.withColumnRenamed("text", "sbn"), "line_no").collect()}
    assert scored["0"].f1 == 1 and 0 < scored["1"].f1 < 1
    (tmp_path / "amr").write_text("# ::id 1\n(a / b\n  :x c)\n\n\n# gone\n\n(d / e)")
    assert [r.text for r in SRC.graph_lines(SRC.read_files(spark, str(tmp_path / "amr"))).orderBy("chunk_idx").collect()] == ["(a / b:x c)", "(d / e)"]


def test_dot_and_reports(spark):
    nodes = G.nodes(spark.createDataFrame([("1", 'a.n.01 a.n.01 Agent -1 Name "x"')], "id string, sbn string"))
    edges = G.edges(spark.createDataFrame([("1", 'a.n.01 a.n.01 Agent -1 Name "x"')], "id string, sbn string"))
    dot = K.dot_text(nodes, edges).first().dot
    assert '[label="a.n.01"]' in dot and '[label="a.n.01-1"]' in dot and "synset_1 -> synset_0" in dot
    assert K.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_summary_without_conditions(spark):
    df = spark.createDataFrame([(1, "success", 0.5), (2, "parse_error", None)], "id int, status string, f1 double")
    r = A.summary_as_seen(df, "condition", "status", "f1", "id").first()
    assert (r.condition, r.n, r.success_pct, r.mean_f1, r.place) == ("<all>", 2, 50.0, 0.5, 1)


def test_bad_overrides(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "id string, v string")
    changes = spark.createDataFrame([("a", "x"), ("b", "q"), ("c", "q")], "id string, value string")
    assert sorted(r.id for r in R.bad_overrides(df, changes, "id", "v").collect()) == ["a", "b", "c"]
    assert R.present(df, ["id", "w"]) == ["id"]


@pytest.mark.parametrize("text", ["a.n.01 NEGATION <1x b.n.01", "a.n.01 Theme >1x"])
def test_bad_indices_are_notation_errors(spark, text):
    with pytest.raises(graphs.NotationError):
        graphs.parse(text)
    assert G.edges(spark.createDataFrame([("1", text)], "id string, sbn string")).count() == 0


def test_only_role_edges_are_turned_and_turned_ones_win(spark):
    g = graphs.upright(graphs.parse("a.n.01 b.n.01 PartOf >0"))
    assert g.edges[("box", 0), ("synset", 1)] == ("box-connect", "member") and g.edges[("synset", 1), ("box", 0)] == ("syn-box-connect", "PartOf")
    text = "a.n.01 Theme +1 b.n.01 PartOf -1"
    want = graphs.upright(graphs.parse(text)).edges[("synset", 0), ("synset", 1)]
    e = G.upright_edges(G.edges(spark.createDataFrame([("1", text)], "id string, sbn string"))).where("edge_type = 'role'")
    assert want == ("role", "Part") and [(r.src_idx, r.dst_idx, r.token) for r in e.collect()] == [(0, 1, "Part")]


def test_last_gold_counts(spark):
    gold = spark.createDataFrame([("1", "z.n.01", 0), ("1", "a.n.01", 1)], "id string, sbn string, k int")
    pred = spark.createDataFrame([("1", "a.n.01"), ("2", "a.n.01"), ("1", "foo")], "id string, pred_sbn string")
    got = sorted((r.id, r.status, r.f1) for r in G.score_frame(pred, gold, order="k").collect())
    assert [g[:2] for g in got] == [("1", "parse_error"), ("1", "success"), ("2", "gold_error")] and got[1][2] == 1


def test_percentages_round_the_exact_value_ties_to_even(spark):
    rows = [(p, w) for w in (1, 8, 16, 80, 200, 400, 1000, 2000) for p in range(w + 1)] + [(0, 0), (3, 0), (5000, 4)]
    df = spark.createDataFrame(rows, "p int, w int")
    got = {(r.p, r.w): r.pct for r in df.select("p", "w", X.percentage(F.col("p"), F.col("w")).alias("pct")).collect()}
    assert got == {(p, w): "%.1f%%" % (p * 100.0 / w if w else 0.0) for p, w in rows}
    assert got[1, 80] == "1.2%" and got[3, 2000] == "0.1%" and got[3, 400] == "0.8%"


def brute_match(pred, gold, kinds=("instance", "attribute", "relation")):
    from itertools import permutations

    pair = alignment.Pair(pred, gold, kinds)
    n, m = len(pair.left), len(pair.right)
    return max(pair.value([j if j < m else -1 for j in p[:n]]) for p in permutations(range(m + n), n))


def test_exact_alignment_is_the_best_of_all():
    rnd = random.Random(3)
    for _ in range(40):
        sides = []
        for _ in range(2):
            n = rnd.randrange(1, 5)
            concepts = {f"s{i}": rnd.choice("ab") for i in range(n)}
            rows = [(rnd.choice("RS"), f"s{rnd.randrange(n)}", rnd.choice([f"s{rnd.randrange(n)}", "x"])) for _ in range(5)]
            sides.append(alignment.listed(rows, concepts))
        matched, n, m, shown = alignment.compared(*sides)
        assert matched == brute_match(*sides) and len(shown.split()) == len(sides[0][0])
        assert matched >= alignment.compared(*sides, solver="climb")[0]


#: Lines of parts whose alignment took the search over its steps when its bound was loose.
QUANTITIES = [
    (13, 18, 41, 18, 1, 43, 5, 49, 48, 49, 2, 37, 41, 18),
    (24, 28, 36, 1, 7, 5, 19, 24, 2, 30, 7, 27, 16, 26, 14, 39),
    (4, 37, 46, 46, 22, 43, 26, 17, 23, 35, 28, 20, 30, 5),
]


def test_exact_alignment_of_many_like_parts_needs_no_climbing():
    for quantities in QUANTITIES:
        lines = [f"part.n.01 PartOf -{min(i, 9)} Quantity {q}" for i, q in enumerate(quantities, 1)]
        text, n = " ".join(["order.n.01", *lines]), len(lines)
        pred, gold = (graphs.status_of(t)[1] for t in (text.rsplit(" ", 2)[0], text))
        f, used = alignment.score(pred, gold)[2:]
        assert used == "exact" and f == pytest.approx(2 * (4 * n + 3) / (8 * n + 7))


def test_remembered_alignments_are_those_of_the_pair_itself():
    rnd = random.Random(5)
    for _ in range(60):
        sides = []
        for _ in range(2):
            n = rnd.randrange(1, 6)
            rows = [(rnd.choice("RS"), f"s{rnd.randrange(n)}", rnd.choice([f"s{rnd.randrange(n)}", "x", "y"])) for _ in range(rnd.randrange(8))]
            sides.append(alignment.listed(rows, {f"s{i}": rnd.choice("ab") for i in range(n)}))
        for kinds in (("instance", "attribute", "relation"), ("attribute",), ("relation",)):
            pair = alignment.Pair(*sides, kinds)
            matched, match, used, sizes = alignment.best(*sides, kinds=kinds)
            assert (used, sizes) == ("exact", pair.sizes) and matched == pair.value(list(match)) == brute_match(*sides, kinds) <= pair.limit()


def test_alignment_in_print_and_kinds():
    a, b = alignment.triples("(a / x :R (b / y) :S 1)"), alignment.triples("(q / x :R (r / z))")
    assert alignment.compared(a, b)[3] in ("a(x)-q(x) b(y)-r(z)",)
    assert alignment.compared(a, b, kinds=("instance",))[:3] == (1, 2, 2)
    assert alignment.compared(a, b, kinds=("relation",))[:3] == (1, 1, 1)


def lineitems(spark, tmp_path, copies):
    """A folder with lineitem: orders of 1 to 12 lines, each `copies` times."""
    rows = [(1000 * c + o, i, 1, 1, float((o * i) % 7 + 1)) for c in range(copies) for o in range(1, 13) for i in range(1, o + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_pairs_are_aligned_where_they_lie(spark):
    pairs = spark.createDataFrame([("(a / x :R 1)", "(q / x)", 7), ("(a / x :R 1)", "(q / x)", 8), (None, "(q / x)", None)], "a string, b string, k int")
    out = G.aligned(pairs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.select("k", "matched", "n_pred", "n_gold", "alignment").collect()] == [(7, 2, 3, 2, "a(x)-q(x)"), (8, 2, 3, 2, "a(x)-q(x)"), (None, 0, 0, 2, "")]
    both = G.penmans(spark.createDataFrame([(1, "a.n.01", "foo")], "k int, x string, y string"), {"p": "x", "q": "y"}).first()
    assert (both.k, both.x, both.p is not None, both.q) == (1, "a.n.01", True, None)


def test_corpus_score_counts_copies(spark, tmp_path):
    r = registry.QUERIES["g17_corpus_score"](spark, lineitems(spark, tmp_path, 3)).first()
    assert (r.matched, r.n_pred, r.n_gold) == tuple(3 * sum(4 * n + k for n in range(1, 13)) for k in (3, 3, 4))


def test_family_lists_of_texts_are_those_of_their_triples(spark):
    texts = ["order.n.01 part.n.01 PartOf -1 Quantity 3", 'a.n.01 Name "x y" NEGATION <1 b.v.01 Agent -1 EQU +1 time.n.08', "be.v.01 CORRECTION <1 c.n.01 Theme -1 CONJUNCTION <2 d.n.01", "foo", None]
    penman = G.statuses(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, sbn string"))
    odd = spark.createDataFrame([("9", "(s0 / a.n.01 :Part-of (s1 / b.n.01 :PartOf s0 :Of s0 :Name x-of))")], "id string, penman string")
    for t in (penman.select("id", "penman"), odd):
        want = sorted(map(repr, FG.family_lists(G.triple_rows(t)).collect()))
        got = FG.family_lists_of(t)
        assert want and sorted(map(repr, got.collect())) == want
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.family for r in FG.family_lists_of(penman, families=["b2c"]).collect()} == {"b2c"}


def test_list_scores_of_copies(spark, tmp_path):
    out = registry.QUERIES["g18_list_scores"](spark, lineitems(spark, tmp_path, 3))
    assert sorted(map(tuple, out.collect())) == sorted((str(1000 * c + n), *[2 * n + 4] * 3) for c in range(3) for n in range(1, 13))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_masks_and_roles(spark):
    df = spark.createDataFrame([("1", "(b0 / box :member (s0 / be.v.01 :Agent-of s1 :Odd 2))")], "id string, penman string")
    assert [r.role for r in FG.unknown_roles(df).collect()] == ["Odd"]
    r = df.select(FG.masked(F.col("penman"), "role").alias("role"), FG.masked(F.col("penman"), "none").alias("same"), X.has_be_node(F.col("penman")).alias("be")).first()
    assert r.role.count(":role") == 2 and r.same.startswith("(b0") and r.be


@pytest.mark.parametrize("options", [{}, {"task_rows": 20, "pieces": 8}, {"task_rows": 0, "pieces": 1}])
def test_length_order(spark, options):
    rows = [(i * 7 % 501, "x" * (3 if i % 3 else i % 5)) for i in range(500)] + [(None, "xxx"), (900, None), (901, "")]
    got = splitting.length_ordered(spark.createDataFrame(rows, "k long, t string"), "t", "k", **options).collect()
    order = sorted(rows, key=lambda r: (-1 if r[1] is None else len(r[1]), -1 if r[0] is None else r[0]))
    assert [(r.k, r.t) for r in sorted(got, key=lambda r: r.pos)] == order and sorted(r.pos for r in got) == list(range(len(rows)))
    empty = spark.createDataFrame([], "k long, t string")
    assert splitting.length_ordered(empty, "t", "k", **options).count() == 0
