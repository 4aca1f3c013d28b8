import pytest

from lexspark.operators import graph as G
from lexspark.sources import lexicon

TREE = {"djur..1": "PRIM..1", "däggdjur..1": "djur..1", "sällskap..1": "djur..1", "usling..1": "PRIM..1", "hund..1": "däggdjur..1", "hund..2": "usling..1", "katt..1": "däggdjur..1"}


def entry(forms, sense, primary, secondary=()):
    reps = "".join(f'<FormRepresentation><feat att="writtenForm" val="{f}"/><feat att="partOfSpeech" val="nn"/></FormRepresentation>' for f in forms)
    rel = lambda t, k: f'<SenseRelation targets="{t}"><feat att="label" val="{k}"/></SenseRelation>'
    return f'<LexicalEntry><Lemma>{reps}</Lemma><Sense id="{sense}">{rel(primary, "primary")}{"".join(rel(s, "secondary") for s in secondary)}</Sense></LexicalEntry>'


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    parts = [entry([s.split("..")[0]], s, p, ("sällskap..1",) if s == "hund..1" else ()) for s, p in TREE.items()] + ["<LexicalEntry><Lemma/><Sense id=\"mysterium..1\"><SenseRelation targets=\"PRIM..1\"><feat att=\"label\" val=\"primary\"/></SenseRelation></Sense></LexicalEntry>"]
    path = tmp_path_factory.mktemp("lex") / "mini.xml"
    path.write_text(f"<LexicalResource><Lexicon>{''.join(parts)}</Lexicon></LexicalResource>", encoding="utf-8")
    return lexicon.read_lexicon(spark, str(path))


def test_read_and_stats(g, spark, tmp_path):
    r = G.graph_stats(g, G.depths(g)).first()
    assert (r.n_senses, r.n_primary, r.n_secondary, r.n_connected, r.max_depth) == (9, 8, 1, 9, 3)
    lexicon.save_graph(g, str(tmp_path / "g"))
    assert lexicon.load_graph(spark, str(tmp_path / "g")).edges().count() == 9
    assert [x.sense for x in g.lookup(spark.createDataFrame([("hund",)], "form string")).orderBy("ord").collect()] == ["hund..1", "hund..2"]
    assert {(x.sense, x.child) for x in g.children().collect()} >= {("däggdjur..1", "katt..1")}


def test_paths_depths_and_similarity(g, spark):
    pairs = spark.createDataFrame([("hund..1", "katt..1"), ("hund..1", "PRIM..1"), ("hund..1", "djur..1"), ("hund..1", "hund..1"), ("hund..1", "nej..1"), ("nej..1", "nej..1"), (None, "hund..1")], "s1 string, s2 string")
    d = {r.sense: r.depth for r in G.depths(g).collect()}
    assert d["hund..1"] == 3 and d["PRIM..1"] == 0
    pl = {(r.s1, r.s2): r.path_length for r in G.path_lengths(pairs, g).collect()}
    assert pl == {("hund..1", "katt..1"): 2, ("hund..1", "PRIM..1"): 3, ("hund..1", "djur..1"): 2, ("hund..1", "hund..1"): 0, ("hund..1", "nej..1"): None, ("nej..1", "nej..1"): None}
    wp = {(r.s1, r.s2): r.wu_palmer for r in G.wu_palmer(pairs, G.depths(g)).collect()}
    assert wp[("hund..1", "katt..1")] == pytest.approx(4 / 6) and wp[("hund..1", "djur..1")] == 0.5 and wp[("hund..1", "hund..1")] == 1.0 and wp[("hund..1", "nej..1")] is None
    assert {(r.ancestor, r.hops) for r in G.ancestors(G.depths(g)).filter("sense = 'katt..1'").collect()} == {("katt..1", 0), ("däggdjur..1", 1), ("djur..1", 2), ("PRIM..1", 3)}


def test_relations(g, spark):
    words = spark.createDataFrame([("hund", "djur"), ("hund", "katt"), ("hund", "xyz"), ("xyz", "katt"), ("x", "y"), ("hund", "däggdjur"), ("djur", "hund"), ("usling", "hund")], "target string, response string")
    by_path = {(r.target, r.response): r.relation for r in G.relation_summary(words, g).collect()}
    assert by_path == {("hund", "djur"): "m-sibling", ("hund", "katt"): "m-sibling", ("hund", "xyz"): "oov(r)", ("xyz", "katt"): "oov(t)", ("x", "y"): "oov(both)", ("hund", "däggdjur"): "mother(t→r)", ("djur", "hund"): "m-sibling", ("usling", "hund"): "mother(t→r)"}
    named = {(r.target, r.response): r.relation for r in G.relation_summary(words, g, use_descriptors=True).collect()}
    assert named[("usling", "hund")] == "mother(r→t)" and named[("hund", "däggdjur")] == "mother(t→r)"
    sim = {(r.target, r.response): (r.path_similarity, r.wu_palmer) for r in G.pair_similarity(words, g).collect()}
    assert sim[("hund", "katt")] == (pytest.approx(1 / 3), pytest.approx(4 / 6)) and sim[("x", "y")] == (None, None)


def test_cycles_have_no_depth(spark):
    e = spark.createDataFrame([("a", "b", "primary", 0), ("b", "a", "primary", 0), ("c", "PRIM..1", "primary", 0)], "src string, dst string, label string, ord int")
    forms = spark.createDataFrame([], "form string, sense string, ord int")
    assert {r.sense for r in G.depths(G.SenseGraph(e, forms)).collect()} == {"PRIM..1", "c"}
