import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.graph import DocumentGraph
from tessera.operators import decision, graph_frames, rank
from tessera.operators.knowledge import knowledge_graph
from tessera.sources import loaders, scan

DOCS = "graph_id string, source string, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stems(spark):
    words = {"ranking": "rank", "sections": "section", "citation": "cita", "citations": "cit", "queries": "quer", "is": "is", "news": "new"}
    assert {w: one(spark, T.stem(F.lit(w))) for w in words} == words


def test_node_id(spark):
    assert one(spark, T.node_id("claim", F.lit("Hi there"))).startswith("claim:hi_there:")
    assert one(spark, T.node_id("x", F.lit("--"))).startswith("x:item:")


def test_sections_keep_the_preface_and_nest(spark):
    text = "before\n# A\nx\n## B  \ny\n#\n# Odd"
    s = one(spark, T.sections(F.lit(text)))
    assert [(r.title, r.level, r.content) for r in s] == [("Preface", 1, "before"), ("A", 1, "x"), ("B", 2, "y"), ("# Odd", 1, "")]
    assert [r.title for r in one(spark, T.sections(F.lit("none"), before=None, alone="Decision"))] == ["Decision"]


def test_whole_words(spark):
    hit = lambda c, w: one(spark, T.whole_word(F.lit(c), F.lit(w)))
    assert hit("the Graph-rank.", "graph") and hit("a.b (c)", "(c)") and hit("Élan x", "élan")
    assert not hit("graphs", "graph") and not hit("my_graph", "graph")


PAPER = """# Intro
We propose a sparse ranking method for long papers [1].
Our evaluation shows that recall improves by 12 points.

## Terms
- Sparse Ranking: the order of nodes by weight [1].

| Method | Recall |
| --- | --- |
| Sparse | 42% |

# References
[1] Doe, J. Graphs. 2024.
"""


def test_knowledge_graph(spark):
    g = knowledge_graph(spark.createDataFrame([("g", "p.md", PAPER)], DOCS))
    kinds = {r.type: r.n for r in g.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: kinds[k] for k in ("document", "section", "reference", "table", "claim", "definition", "citation")} == {"document": 1, "section": 3, "reference": 1, "table": 1, "claim": 1, "definition": 1, "citation": 1}
    labels = {r.label for r in g.edges.select("label").distinct().collect()}
    assert {"contains", "mentions", "cites", "resolves_to", "defines", "defined_by", "supported_by"} <= labels
    assert g.nodes.select("node_id").distinct().count() == g.nodes.count()


ADR = """# Choices
| Option | Pros | Decision | Confidence |
|---|:---:|----|---|
| Alpha | fast | no | low |
| Beta | cheap | selected | high |
"""


def test_decision_rows(spark):
    e = decision.decision_edges(decision.events(spark.createDataFrame([("h", "t.md", ADR)], DOCS)))
    short = lambda x: x.split(":")[0] + ("a" if "alpha" in x else "b" if "beta" in x else "")
    got = {(short(r.src), r.label, short(r.dst)) for r in e.collect() if r.label != "contains"}
    assert got == {("optiona", "pros", "prosa"), ("optionb", "pros", "prosb"), ("decisionb", "selects", "optionb"), ("optiona", "confidence", "confidencea"), ("decisionb", "has_confidence", "confidenceb")}


def test_page_rank_of_a_chain(spark):
    nodes = spark.createDataFrame([("g", str(i), float(i == 1)) for i in (1, 2, 3)], "graph_id string, node_id string, score double")
    edges = spark.createDataFrame([("g", "1", "2", "x"), ("g", "2", "3", "x"), ("g", "2", "9", "x")], "graph_id string, src string, dst string, label string")
    want = [0.263255, 0.337022, 0.399723]
    for f in (rank.ranks_by_graph, rank.ranks_by_joins):
        got = [r["rank"] for r in f(nodes, edges, tol=0.0, max_iter=6 if f is rank.ranks_by_joins else 50).orderBy("node_id").collect()]
        assert sum(got) == pytest.approx(1)
        if f is rank.ranks_by_graph:
            assert got == pytest.approx(want, abs=1e-6)


def test_facade(spark, tmp_path):
    g = DocumentGraph.from_texts(spark, [{"title": "Alpha", "content": "Beta helps"}, {"title": "Beta", "content": "uses Gamma Ray"}, {"title": "Gamma Ray", "content": ""}])
    d = g.to_dict()
    assert [tuple(e[k] for k in ("from", "to")) for e in d["edges"]] == [("alpha", "beta"), ("beta", "gamma_ray")]
    found = g.rank("alpha", k=3)
    assert [n["label"] for n in found["nodes"]] == ["Alpha", "Beta", "Gamma Ray"] and all("score" in n for n in found["nodes"])
    assert {"label": "mentions", "from": "Alpha", "to": "Beta"} in found["edges"]
    nothing = g.rank("")
    assert not nothing["nodes"] and not nothing["edges"]
    g.to_json(str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "g.json").read_text()) == d
    with pytest.raises(ValueError):
        g.add_node("alpha", "again")
    with pytest.raises(ValueError):
        DocumentGraph.from_texts(spark, [{"title": "A b", "content": ""}, {"title": "a B", "content": ""}])


def test_folder_graph(spark, tmp_path):
    files = {"a.md": "# Sparse Walks\nSee [the plan](sub/deep/plan.md).\n", "sub/deep/plan.md": "# Plan Title\nWe build on Sparse Walks here.\n", "bad.jsonl": "{}\n{bad", "p.png": "x", "odd.bin": "x"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    d = DocumentGraph.from_directory(spark, str(tmp_path)).to_dict()
    kind = {n["id"]: n["attributes"]["type"] for n in d["nodes"]}
    label = {n["id"]: n["label"] for n in d["nodes"]}
    assert len(kind) == len(d["nodes"]) and all(e["from"] in kind and e["to"] in kind for e in d["edges"])
    assert len({tuple(e.values()) for e in d["edges"]}) == len(d["edges"])
    of = lambda t: sorted(label[i] for i in kind if kind[i] == t)
    assert [of("corpus"), of("folder"), of("file")] == [[tmp_path.name], ["deep", "sub"], ["a.md", "bad.jsonl", "p.png", "plan.md"]]
    assert of("load_error") == ["ImportError: p.png", "ValueError: bad.jsonl"] and of("skipped_file") == ["Skipped odd.bin"]
    status = {n["label"]: n["attributes"]["status"] for n in d["nodes"] if n["attributes"]["type"] == "file"}
    assert status == {"a.md": "extracted", "bad.jsonl": "failed", "p.png": "failed", "plan.md": "extracted"}
    got = {(label[e["from"]], e["label"], label[e["to"]]) for e in d["edges"] if kind[e["from"]] in ("corpus", "folder", "file")}
    assert got >= {(tmp_path.name, "contains", "a.md"), (tmp_path.name, "contains", "sub"), ("sub", "contains", "deep"), ("deep", "contains", "plan.md"), ("p.png", "failed_to_extract", "ImportError: p.png")}
    assert sum(e["label"] == "extracted_as" and kind[e["from"]] == "file" and kind[e["to"]] == "document" for e in d["edges"]) == 2
    across = {(kind[e["from"]], e["label"], label[e["to"]]) for e in d["edges"]}
    assert {("section", "links_to", "plan.md"), ("section", "mentions", "Sparse Walks")} <= across
    counts = next(n["attributes"] for n in d["nodes"] if n["attributes"]["type"] == "corpus_manifest")
    assert [counts[f"{k}_file_count"] for k in ("selected", "extracted", "failed", "skipped")] == [4, 2, 2, 3]
    with pytest.raises(ValueError):
        DocumentGraph.from_document(spark, str(tmp_path / "p.png"))
    alone = DocumentGraph.from_document(spark, str(tmp_path / "a.md"), "media").to_dict()
    assert {n["attributes"]["type"] for n in alone["nodes"]} == {"media_document", "ocr_text"}


def test_media_is_part_of_all(spark):
    from tessera.graph import build_graph

    docs = spark.createDataFrame([("a", "x/a.png", "trend and legend"), ("b", "b.md", "trend and legend")], DOCS)
    got = {(r.graph_id, r.type) for r in build_graph(docs, "all").nodes.select("graph_id", "type").collect()}
    assert ("a", "media_document") in got and ("b", "media_document") not in got


def test_merge_keeps_the_first(spark):
    a = DocumentGraph.from_dict(spark, {"nodes": [dict(id="x", label="one"), dict(id="x", label="two")]})
    b = DocumentGraph.from_dict(spark, {"nodes": [dict(id="x", label="three"), dict(id="y", label="y")]})
    m = graph_frames.merge_graphs([graph_frames.Graph(a.nodes, a.edges), graph_frames.Graph(b.nodes, b.edges)])
    assert sorted((r.node_id, r.label) for r in m.nodes.collect()) == [("x", "one"), ("y", "y")]


def test_loaders(spark, tmp_path):
    files = {"a.md": b"x\r\ny", "b.html": b"<meta a><p>One<br>two</p><script>no</script>&amp;", "c.json": b'{"b": [1, null], "a": true}', "d.py": b"x = 1", "e.txt": "é".encode("latin-1"), "f.png": b"1", "g.jsonl": b"{}\n{bad", "h.txt": "﻿ü".encode("utf-16")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rpartition("/")[2]: r for r in loaders.load(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert {k: rows[k].text for k in ("a.md", "c.json", "d.py", "e.txt")} == {"a.md": "x\ny", "c.json": "a: true\nb.0: 1\nb.1: null", "d.py": "# language: python\n\nx = 1", "e.txt": "é"}
    assert rows["b.html"].text.split() == ["One", "two", "&"] and rows["h.txt"].text.endswith("ü")
    assert rows["f.png"].error and "line 2" in rows["g.jsonl"].error and len(rows) == len(files)


def test_globs():
    import re

    hit = lambda p, s: bool(re.match(scan.glob_regex(p), s))
    assert hit("*.md", "a/b.md") and hit("a?c", "abc") and hit("[!a]x", "bx") and not hit("[!a]x", "ax") and not hit("*.md", "b.mdx")


def test_incremental(spark, tmp_path):
    from tessera.streaming.incremental import extract_new

    src, out = tmp_path / "in", str(tmp_path / "out")
    for k, texts in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([("s", t) for t in texts], "source string, text string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("source string, text string").parquet(str(src))
        extract_new(stream, lambda d: d.select("text"), out, str(tmp_path / "seen"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
