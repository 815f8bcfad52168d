"""Knowledge graph of documents: sections, references, tables, concepts, definitions, claims and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph_frames import Graph, edge_row, merged, node_row, union_all
from .links import top_per
from .outline import section_rows
from .tables import is_evidence, markdown_tables

_REFERENCES = sorted("bibliography|references|works cited".split("|"))
_NUMBERED = r"^[\[](\d+)[\]]\s+(.+)$"
_AUTHOR = r"^(?:[*-]\s*)?(?:[\[]\d+[\]]\s*)?([A-Z][-a-zA-Z]+)(\s+et\s+al[.])?(?:,\s+[A-Z](?:[.][A-Z][.])?[.]?)?.*?\b((?:20|19)\d{2})\b"
_NAME = r"[ +/0-9a-zA-Z-]"
_GLOSSARY = rf"(?d)^(?:[*-]\s+)?(?:[*]{{2}})?([a-zA-Z]{_NAME}{{1,80}}?)(?:[*]{{2}})?\s*(?:--|:| - )\s+(.{{12,}})$"
_DEFINED = rf"(?id)^(?:The|An|A)?\s*([a-z]{_NAME}{{2,80}}?)\s+(?:is|are|refers to|means|(?:are|is) defined as)\s+(.{{12,}})$"


def _author_keys(c: Column) -> Column:
    surname, al, year = (F.regexp_extract(T.strip(c), _AUTHOR, k) for k in (1, 2, 3))
    one = F.concat(surname, F.lit(", "), year)
    return F.when(year == "", F.array().cast("array<string>")).when(al != "", F.array(one, F.concat(surname, F.lit(" et al., "), year))).otherwise(F.array(one))


def references(sections: DataFrame) -> DataFrame:
    """Entries of reference sections: (graph_id, source, i, title, p, key, content, aliases, ref_id). A numbered
    entry takes the lines after it; before the first, each line with author and year is one."""
    s = sections.where(F.lower(T.strip(F.col("title"))).isin(_REFERENCES))
    lines = s.select("graph_id", "source", "i", "title", F.posexplode(F.transform(T.split_lines(F.col("content")), T.strip)).alias("p", "line")).where("line <> ''")
    w = Window.partitionBy("graph_id", "i").orderBy("p")
    lines = lines.withColumn("num", F.regexp_extract("line", _NUMBERED, 1)).withColumn("g", F.sum(F.when(F.col("num") != "", 1).otherwise(0)).over(w))
    lone = lines.where("g = 0").withColumns({"keys": _author_keys(F.col("line"))}).where(F.size("keys") > 0)
    lone = lone.select("graph_id", "source", "i", "title", "p", F.get("keys", F.lit(0)).alias("key"), F.col("line").alias("content"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda e: e["line"]), " ")
    many = lines.where("g > 0").groupBy("graph_id", "source", "i", "title", "g").agg(F.min("p").alias("p"), F.max("num").alias("key"), joined.alias("all"))
    many = many.select("graph_id", "source", "i", "title", "p", "key", T.strip(F.regexp_replace("all", r"^[\[]\d+[\]]\s+", "")).alias("content"))
    out = lone.unionByName(many)
    out = out.withColumn("aliases", F.array_distinct(F.concat(F.array("key"), _author_keys(F.col("content")))))
    return out.withColumn("ref_id", T.scoped_id("reference", F.col("source"), F.concat_ws("-", "key", "content")))


def definitions(sections: DataFrame) -> DataFrame:
    """(graph_id, i, k, term, body, concept): glossary lines, then sentences; the first of a concept in a section."""
    lines = sections.select("*", F.posexplode(F.transform(T.split_lines(F.col("content")), T.strip)).alias("p", "x")).withColumn("kind", F.lit(0))
    said = sections.select("*", F.posexplode(T.sentences(F.col("content"))).alias("p", "x")).withColumn("kind", F.lit(1))

    def parts(df: DataFrame, pattern: str, chars: str) -> DataFrame:
        return df.withColumns({"term": F.btrim(F.regexp_extract("x", pattern, 1), F.lit(chars)), "body": T.strip(F.regexp_extract("x", pattern, 2))}).where("body <> ''")

    both = parts(lines, _GLOSSARY, " `*").unionByName(parts(said, _DEFINED, " \t")).withColumn("concept", T.concept(F.col("term")))
    noise = F.rlike(F.lower(T.strip(F.col("term"))), F.lit("^(?:todo|tip|warning|example|note|references|option\\s+[0-9a-z]+)$"))
    both = both.where((F.col("concept") != "") & ~noise)
    first = F.row_number().over(Window.partitionBy("graph_id", "i", "concept").orderBy("kind", "p"))
    both = both.withColumn("_f", first).where("_f = 1")
    return both.withColumn("k", F.row_number().over(Window.partitionBy("graph_id", "i").orderBy("kind", "p")) - 1).select("graph_id", "source", "i", "title", "k", "term", "body", "concept")


def concepts(docs: DataFrame, most: int = 40) -> DataFrame:
    """(graph_id, concept, frequency, seen): the most frequent phrases of each document, ties by first place."""
    found = docs.select("graph_id", F.posexplode(T.phrases(F.coalesce("text", F.lit("")))).alias("p", "x")).select("graph_id", "p", T.concept(F.col("x")).alias("concept"))
    counted = found.where("concept <> ''").groupBy("graph_id", "concept").agg(F.count(F.lit(1)).alias("frequency"), F.min("p").alias("seen"))
    return top_per(counted, "graph_id", [F.desc("frequency"), "seen"], most)


def cue_sentences(sections: DataFrame) -> DataFrame:
    """(graph_id, source, i, title, p, sentence, claim, evidence) of sentences that hold a cue of either kind."""
    s = sections.select("graph_id", "source", "i", "title", F.posexplode(T.sentences(F.col("content"))).alias("p", "sentence"))
    return s.withColumns({"claim": T.has_cue(F.col("sentence"), T.CLAIM_CUES), "evidence": T.has_cue(F.col("sentence"), T.EVIDENCE_CUES)}).where("claim OR evidence")


def support(claims: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """Edges from claims (graph_id, id, i, p, x) to at most ``most`` evidence rows of the same shape: in the same section or
    with shared terms; nearer and more shared first. Both sides are few per document."""
    c = claims.select("graph_id", F.col("id").alias("src"), F.col("i").alias("ci"), F.col("p").alias("cp"), T.support_terms(F.col("x")).alias("ct"))
    e = evidence.select("graph_id", F.col("id").alias("dst"), F.col("i").alias("ei"), F.col("p").alias("ep"), T.support_terms(F.col("x")).alias("et"))
    j = c.join(e, "graph_id").withColumns({"shared": F.size(F.array_intersect("ct", "et")), "away": (F.col("ci") != F.col("ei")).cast("int")})
    j = j.where("away = 0 OR shared > 0").withColumn("gap", F.abs(F.col("ci") - F.col("ei")) * 1000 + F.abs(F.col("cp") - F.col("ep")))
    w = Window.partitionBy("graph_id", "src", "ci", "cp").orderBy("away", F.desc("shared"), "gap", "dst")
    return j.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("graph_id", "src", "dst", "ci", "cp", "k")


def support_within(claims: Column, evidence: Column, most: int = 5) -> Column:
    """support for one section in one row, without a join: claims and evidence are arrays of (p, terms); an array of
    (cp, ep, k)."""

    def of(c: Column) -> Column:
        met = F.transform(evidence, lambda e: F.struct((-F.size(F.array_intersect(c["terms"], e["terms"]))).alias("less"), F.abs(c["p"] - e["p"]).alias("gap"), e["p"].alias("p")))
        return F.transform(F.slice(F.sort_array(met), 1, most), lambda m, k: F.struct(c["p"].alias("cp"), m["p"].alias("ep"), (k + 1).alias("k")))

    return F.flatten(F.transform(claims, of))


def knowledge_graph(docs: DataFrame, *, max_tables: int = 20, max_claims: int = 30, max_definitions: int = 30, max_concepts: int = 40) -> Graph:
    """docs (graph_id, source, text) to their knowledge graphs, one graph_id each, all in one job.

    Concept ids don't depend on the source, so documents of one corpus share concepts."""
    g, src = F.col("graph_id"), F.col("source")
    doc_id = T.node_id("document", F.when(F.coalesce(src, F.lit("")) != "", src).otherwise("document"))
    sec = section_rows(docs).withColumns({"doc": doc_id, "id": T.scoped_id("section", src, F.concat_ws("-", "i", "title"))})
    static = {"source": src, "extraction_method": F.lit("static")}
    nodes, edges, owners = [], [], []
    zero = F.lit(0)

    def attrs(kind: str, **more: Column) -> dict[str, Column]:
        return {"type": F.lit(kind), **more, **static}

    def add(df: DataFrame, kind: str, name: Column, content: Column | None, pos: list, **more: Column) -> None:
        nodes.append(df.select(*node_row(g, F.col("id"), name, content, attrs(kind, **more), pos)))

    def link(df: DataFrame, a: str, b: str, how: str, pos: list) -> None:
        edges.append(df.select(*edge_row(g, F.col(a), F.col(b), how, pos)))

    d = docs.withColumn("id", doc_id)
    add(d, "document", F.when(F.coalesce(src, F.lit("")) != "", src).otherwise("Document"), T.cut(F.coalesce("text", F.lit("")), 5000), [zero])
    refs = references(sec).withColumn("id", F.col("ref_id")).withColumn("doc", doc_id)
    add(refs, "reference", F.concat(F.lit("["), F.col("key"), F.lit("] "), T.label(F.col("content"), 80)), F.col("content"), [F.lit(1), F.col("i"), F.col("p")], key=F.col("key"), aliases=F.col("aliases"), document_id=F.col("doc"), section=F.col("title"), section_index=F.col("i"))
    link(refs, "doc", "id", "contains", [F.lit(1), F.col("i"), F.col("p")])
    at = lambda *rest: [F.lit(2), F.col("i"), *rest]
    add(sec, "section", F.col("title"), F.col("content"), at(zero), level=F.col("level"), index=F.col("i"), document_id=F.col("doc"))
    link(sec, "doc", "id", "contains", at(zero))
    u = sec.withColumnRenamed("id", "sec").select("*", F.posexplode(T.urls(F.col("content"))).alias("p", "url")).withColumn("id", T.scoped_id("url", src, F.col("url")))
    add(u, "url", F.col("url"), None, at(F.lit(1), F.col("p")), document_id=F.col("doc"))
    link(u, "sec", "id", "links_to", at(F.lit(1), F.col("p")))
    owners.append(sec.select("graph_id", "source", "doc", F.col("id").alias("owner"), F.col("content").alias("x"), F.array(*(c.cast("long") for c in at(F.lit(2)))).alias("pos")))

    rows = markdown_tables(sec).withColumn("_t", F.dense_rank().over(Window.partitionBy("graph_id").orderBy("i", "t"))).where(F.col("_t") <= max_tables)
    meta = sec.select("graph_id", "source", "doc", F.col("id").alias("sec"), "i", "title")
    rows = rows.join(meta, ["graph_id", "i"])
    rows = rows.withColumn("tab", T.scoped_id("table", src, F.concat_ws("-", "i", "t", "content")))
    tab = rows.where("r = 0").withColumn("id", F.col("tab"))
    add(tab, "table", F.concat(F.lit("Table: "), F.col("title")), F.col("content"), at(F.lit(3), F.col("t")), document_id=F.col("doc"), section=F.col("title"), section_index=F.col("i"), table_index=F.col("t"), headers=F.col("headers"), row_count=F.col("n_rows"))
    link(tab, "sec", "id", "contains", at(F.lit(3), F.col("t")))
    owners.append(tab.select("graph_id", "source", "doc", F.col("id").alias("owner"), F.col("content").alias("x"), F.array(*(c.cast("long") for c in at(F.lit(3), F.col("t"), F.lit(1)))).alias("pos")))

    con = concepts(docs, max_concepts).join(docs.select("graph_id", "source"), "graph_id")
    defs = definitions(sec).withColumn("_k", F.row_number().over(Window.partitionBy("graph_id").orderBy("i", "k"))).where(F.col("_k") <= max_definitions)
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("frequency"), "seen"))
    con = con.withColumns({"id": T.node_id("concept", F.col("concept")), "rank": rank})
    add(con, "concept", F.col("concept"), None, [F.lit(3), F.col("rank")], frequency=F.col("frequency"))
    for k, where in enumerate((sec.select("graph_id", F.col("id").alias("from"), F.col("i").alias("w"), "content"), tab.select("graph_id", F.col("id").alias("from"), (F.col("i") * 1000 + F.col("t")).alias("w"), "content"))):
        m = con.join(where, "graph_id").where(F.contains(F.lower("content"), F.col("concept")))
        link(m, "from", "id", "mentions", [F.lit(3), F.col("rank"), F.lit(k), F.col("w")])

    defs = defs.join(meta.select("graph_id", "doc", "sec", "i"), ["graph_id", "i"]).withColumns({"con": T.node_id("concept", F.col("concept")), "id": T.scoped_id("definition", src, F.concat_ws("-", "concept", "body"))})
    fresh = defs.join(con.select("graph_id", "concept"), ["graph_id", "concept"], "left_anti").join(docs.select("graph_id", "text"), "graph_id")
    often = F.regexp_count("text", F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), F.col("concept"), F.lit(r"\E(?!\w)")))
    nodes.append(fresh.select(*node_row(g, F.col("con"), F.col("concept"), None, attrs("concept", frequency=often), [F.lit(4), F.col("i"), F.col("k"), F.lit(0)])))
    here = lambda n: [F.lit(4), F.col("i"), F.col("k"), F.lit(n)]
    add(defs, "definition", T.label(F.concat_ws(": ", "term", "body")), F.col("body"), here(1), term=F.col("term"), normalized_term=F.col("concept"), document_id=F.col("doc"), section=F.col("title"), section_index=F.col("i"))
    for n, (a, b, how) in enumerate((("sec", "id", "contains"), ("id", "con", "defines"), ("con", "id", "defined_by"), ("sec", "con", "mentions"))):
        link(defs, a, b, how, here(n))
    owners.append(defs.select("graph_id", "source", "doc", F.col("id").alias("owner"), F.col("body").alias("x"), F.array(*(c.cast("long") for c in here(5))).alias("pos")))

    cues = cue_sentences(sec).join(meta.select("graph_id", "doc", "sec", "i"), ["graph_id", "i"])
    nth = F.sum(F.col("claim").cast("int")).over(Window.partitionBy("graph_id").orderBy("i", "p"))
    cues = cues.withColumn("claim", F.col("claim") & (nth <= max_claims))
    found = {}
    for n, kind in enumerate(("claim", "evidence")):
        own = cues.where(kind).withColumn("id", T.scoped_id(kind, src, F.col("sentence")))
        spot = [F.lit(5), F.col("i"), F.col("p"), F.lit(n)]
        add(own, kind, T.label(F.col("sentence")), F.col("sentence"), spot, document_id=F.col("doc"), section=F.col("title"), section_index=F.col("i"))
        link(own, "sec", "id", "contains", spot)
        owners.append(own.select("graph_id", "source", "doc", F.col("id").alias("owner"), F.col("sentence").alias("x"), F.array(*(c.cast("long") for c in [*spot, F.lit(1)])).alias("pos")))
        found[kind] = own.select("graph_id", "id", "i", "p", F.col("sentence").alias("x"))
    told = rows.where(is_evidence(F.col("row_text"))).withColumn("id", T.scoped_id("evidence", src, F.concat_ws("-", F.lit("table"), "i", "t", "r", "row_text")))
    spot = [F.lit(6), F.col("i"), F.col("t"), F.col("r")]
    add(told, "evidence", T.label(F.col("row_text")), F.col("row_text"), spot, document_id=F.col("doc"), section=F.col("title"), section_index=F.col("i"), table_index=F.col("t"), row_index=F.col("r"), evidence_kind=F.lit("table_row"))
    link(told, "tab", "id", "contains", spot)
    owners.append(told.select("graph_id", "source", "doc", F.col("id").alias("owner"), F.col("row_text").alias("x"), F.array(*(c.cast("long") for c in [*spot, F.lit(1)])).alias("pos")))
    proof = found["evidence"].unionByName(told.select("graph_id", "id", "i", (F.col("r") + 10_000).alias("p"), F.col("row_text").alias("x")))
    s = support(found["claim"], proof)
    link(s, "src", "dst", "supported_by", [F.lit(7), F.col("ci"), F.col("cp"), F.col("k")])

    cited = union_all(owners).select("*", F.posexplode(T.citations(F.col("x"))).alias("n", "cite")).withColumn("id", T.scoped_id("citation", src, F.col("cite")))
    cited = cited.withColumn("pos", F.concat("pos", F.array(F.col("n").cast("long"))))
    plain = node_row(g, F.col("id"), F.col("cite"), None, attrs("citation", document_id=F.col("doc")), [zero])
    nodes.append(cited.select(*plain[:-1], "pos"))
    edges.append(cited.select("graph_id", F.col("owner").alias("src"), F.col("id").alias("dst"), F.lit("cites").alias("label"), "pos"))
    edges.append(resolved(cited, refs))
    graph = merged(Graph(union_all(nodes), union_all(edges)))
    graph.roots = d.select("graph_id", F.col("id").alias("current_node_id"))
    return graph


def resolved(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """resolves_to edges from citations (graph_id, id, cite, pos) to the first reference with that alias."""
    named = refs.select("graph_id", F.explode("aliases").alias("cite"), "ref_id", "i", "p").groupBy("graph_id", "cite").agg(F.min_by("ref_id", F.struct("i", "p")).alias("ref_id"))
    return cited.join(named, ["graph_id", "cite"]).select("graph_id", F.col("id").alias("src"), F.col("ref_id").alias("dst"), F.lit("resolves_to").alias("label"), "pos")
