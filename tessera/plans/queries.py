"""Named queries over the test tables and the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decision, graph_frames, knowledge, lineage, links, outline, rank, schema_docs, tables
from ..sources import loaders, scan
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders dealt out by key: a few bytes of a row become a document, so one file of them is work for all cores.
    Up to bypassMergeThreshold partitions a task writes each row at once; with more it would gather its whole row group."""
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = min(n, int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")) or n)
    return table(spark, sf_dir, "orders").repartition(n, "o_orderkey")


def _docs(spark: SparkSession, sf_dir: str, text: str | None = None) -> DataFrame:
    """documents as (graph_id, source, text), the text rewritten by a SQL expression."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("graph_id"), F.lit("").alias("source"), F.expr(text or "text").alias("text"))


# Markdown made of documents: each line that begins with a word gets a heading of that word, its level by length.
MARKDOWN = r"regexp_replace(text, '(?m)^([A-Z][a-z]+) ', '\n## $1\n$1 ')"
MARKDOWN_SQL = r"regexp_replace(text, '(?m)^([A-Z][a-z]+) ', chr(10) || '## \1' || chr(10) || '\1 ', 'g')"
NESTED = r"regexp_replace(regexp_replace(text, '(?m)^([A-Z][a-z]{0,3}) ', '\n# $1\n$1 '), '(?m)^([A-Z][a-z]{4,}) ', '\n### $1\n$1 ')"
NESTED_SQL = r"regexp_replace(regexp_replace(text, '(?m)^([A-Z][a-z]{0,3}) ', chr(10) || '# \1' || chr(10) || '\1 ', 'g'), '(?m)^([A-Z][a-z]{4,}) ', chr(10) || '### \1' || chr(10) || '\1 ', 'g')"


def _sections_sql(markdown: str) -> str:
    """DuckDB rows (doc_id, i, title, level, content) of headed sections after the first heading."""
    return rf"""
parts AS (SELECT doc_id, string_split(regexp_replace({markdown}, '(?m)^(#+)[ \t]+(.+)$', chr(57345) || '\1' || chr(57346) || '\2' || chr(57347), 'g'), chr(57345)) AS p FROM documents),
raw AS (SELECT doc_id, unnest(p[2:]) AS x, unnest(range(0, len(p) - 1)) AS i FROM parts),
sections AS (SELECT doc_id, i, length(split_part(x, chr(57346), 1)) AS level, trim(split_part(split_part(x, chr(57346), 2), chr(57347), 1)) AS title,
  regexp_replace(split_part(x, chr(57347), 2), '^\s+|\s+$', '', 'g') AS content FROM raw)"""


@query(
    "tokenize",
    r"""SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\pL\pN]+')) AS token FROM documents) WHERE token <> '' GROUP BY token""",
)
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(token, '{e}') AND length(token) - {len(e)} >= 3 THEN left(token, length(token) - {len(e)})" for e in T.STEM_ENDINGS) + " ELSE token END"


@query(
    "stem_tokens",
    rf"""SELECT {_STEM_SQL} AS stem, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\pL\pN]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1""",
)
def stem_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("t"))
    return t.groupBy("t").agg(F.count(F.lit(1)).alias("c")).groupBy(T.stem(F.col("t")).alias("stem")).agg(F.sum("c").alias("n"))


_SENTENCES_SQL = r"""SELECT {key}, unnest(s) AS sentence, unnest(range(0, len(s))) AS sentence_index FROM (SELECT {key}, list_filter(string_split(regexp_replace(trim(regexp_replace({text}, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(57345), 'g'), chr(57345)), lambda x: length(x) >= 30) AS s FROM {frm})"""


@query("sentences", f"SELECT doc_id, sentence_index, sentence FROM ({_SENTENCES_SQL.format(key='doc_id', text='text', frm='documents')})")
def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query(
    "paragraphs",
    r"""SELECT doc_id, unnest(p) AS paragraph, unnest(range(0, len(p))) AS paragraph_index FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), '\n{2,}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""",
)
def paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return d.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_index", "paragraph"))


@query("sections", f"WITH {_sections_sql(MARKDOWN_SQL)} SELECT doc_id, i AS section_index, title, level, md5(content) AS content_md5 FROM sections")
def sections(spark, sf_dir):
    s = outline.section_rows(_docs(spark, sf_dir, MARKDOWN), before=None)
    s = s.join(_docs(spark, sf_dir, MARKDOWN).where(r"text rlike '(?m)^#+[ \t]+.+$'").select("graph_id"), "graph_id", "left_semi")
    return s.select(F.col("graph_id").cast("long").alias("doc_id"), F.col("i").alias("section_index"), "title", "level", F.md5("content").alias("content_md5"))


@query(
    "section_containment",
    f"""WITH {_sections_sql(NESTED_SQL)} SELECT s.doc_id, s.i AS section_index, max(p.i) AS parent_index FROM sections s JOIN sections p ON s.doc_id = p.doc_id AND p.i < s.i AND p.level < s.level GROUP BY 1, 2""",
)
def section_containment(spark, sf_dir):
    s = outline.with_parents(outline.section_rows(_docs(spark, sf_dir, NESTED), before=None)).where("parent IS NOT NULL")
    return s.select(F.col("graph_id").cast("long").alias("doc_id"), F.col("i").alias("section_index"), F.col("parent").alias("parent_index"))


@query(
    "section_references",
    f"""WITH {_sections_sql(MARKDOWN_SQL)}, names AS (SELECT doc_id, lower(title) AS t, max(i) AS j FROM sections GROUP BY 1, 2)
SELECT s.doc_id, s.i AS section_index, n.j AS target_index FROM sections s JOIN names n ON s.doc_id = n.doc_id AND contains(lower(s.content), n.t) AND s.i <> n.j""",
)
def section_references(spark, sf_dir):
    s = outline.section_rows(_docs(spark, sf_dir, MARKDOWN), before=None)
    s = s.join(_docs(spark, sf_dir, MARKDOWN).where(r"text rlike '(?m)^#+[ \t]+.+$'").select("graph_id"), "graph_id", "left_semi")
    return outline.heading_mentions(s).select(F.col("graph_id").cast("long").alias("doc_id"), F.col("i").alias("section_index"), F.col("j").alias("target_index"))


@query("urls", r"""SELECT page_id, unnest(list_transform(regexp_extract_all('see ' || url || '., and ' || html, 'https?://[^\s)>\]]+'), lambda u: rtrim(u, '.,'))) AS url FROM pages""")
def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.urls(F.concat(F.lit("see "), F.col("url"), F.lit("., and "), F.col("html")))).alias("url"))


_CITED = "concat(text, ' [', doc_id % 7, ', ', doc_id % 5, '] (Smith et al., 20', lpad(cast(doc_id % 30 as string), 2, '0'), ')')"
_CITED_SQL = "text || ' [' || doc_id % 7 || ', ' || doc_id % 5 || '] (Smith et al., 20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || ')'"


@query(
    "citations",
    rf"""WITH t AS (SELECT doc_id, {_CITED_SQL} AS x FROM documents)
SELECT doc_id, unnest(list_concat(flatten(list_transform(regexp_extract_all(x, '\[([0-9]+(?: *, *[0-9]+)*)\]', 1), lambda n: list_transform(string_split(n, ','), lambda y: trim(y)))),
  regexp_extract_all(x, '[(]([A-Z][a-zA-Z-]+(?: +et +al[.])?, *(?:20|19)[0-9][0-9])[)]', 1))) AS citation FROM t""",
)
def citations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CITED).alias("x"))
    return d.select("doc_id", F.explode(T.citations(F.col("x"))).alias("citation"))


@query(
    "citation_resolution",
    """WITH refs AS (SELECT n_regionkey AS k, min(n_nationkey) AS entry FROM nation GROUP BY 1)
SELECT doc_id, CAST(c AS VARCHAR) AS citation, entry FROM (SELECT doc_id, unnest(list_distinct([doc_id % 7, doc_id % 5])) AS c FROM documents) JOIN refs ON c = k""",
)
def citation_resolution(spark, sf_dir):
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    lines = n.select(F.concat(F.lit("["), F.col("n_regionkey"), F.lit("] "), F.col("n_name"), F.lit(" "), F.col("n_nationkey")).alias("line"), "n_nationkey")
    # one list of references: 25 lines, kept in order by key
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda e: e["line"]), "\n").alias("content"))
    refs = knowledge.references(text.select(F.lit("g").alias("graph_id"), F.lit("").alias("source"), F.lit(0).alias("i"), F.lit("References").alias("title"), "content"))
    cited = table(spark, sf_dir, "documents").select(F.lit("g").alias("graph_id"), F.col("doc_id").cast("string").alias("id"), F.explode(T.citations(F.expr("concat('[', doc_id % 7, ', ', doc_id % 5, ']')"))).alias("cite"), F.array(F.lit(0)).alias("pos")).distinct()
    found = knowledge.resolved(cited, refs)
    back = found.join(refs.select(F.col("ref_id").alias("dst"), "content", "key"), "dst")
    return back.select(F.col("src").cast("long").alias("doc_id"), F.col("key").alias("citation"), F.regexp_extract("content", r"(\d+)$", 1).cast("int").alias("entry"))


@query("concepts_topn", r"""
WITH p AS (SELECT doc_id, unnest(x) AS raw, unnest(range(0, len(x))) AS pos FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b[a-zA-Z][0-9a-zA-Z-]*(?:\s+[a-zA-Z][0-9a-zA-Z-]*){1,4}\b') AS x FROM documents)),
n AS (SELECT doc_id, pos, trim(lower(regexp_replace(raw, '\s+', ' ', 'g')), ' .,:;()[]`*_') AS concept FROM p),
c AS (SELECT doc_id, concept, count(*) AS frequency, min(pos) AS seen FROM n WHERE length(concept) >= 8 AND contains(concept, ' ')
  AND split_part(concept, ' ', 1) NOT IN ('this', 'that', 'these', 'those', 'there', 'where', 'when') AND concept NOT IN ('this paper', 'this document', 'the paper', 'the document', 'our approach', 'we propose', 'we show', 'we present') GROUP BY 1, 2)
SELECT doc_id, concept, frequency FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, seen) AS k FROM c) WHERE k <= 40""")  # fmt: skip
def concepts_topn(spark, sf_dir):
    return knowledge.concepts(_docs(spark, sf_dir)).select(F.col("graph_id").cast("long").alias("doc_id"), "concept", "frequency")


_CUED = "replace(replace(text, 'the ', 'evaluation '), ' and ', ' we show ')"


def _cue_sql(cues: list[str]) -> str:
    return " OR ".join(f"contains(lower(sentence), '{c}')" for c in cues)


_CUE_ROWS = f"SELECT doc_id, sentence_index, sentence, ({_cue_sql(T.CLAIM_CUES)}) AS claim, ({_cue_sql(T.EVIDENCE_CUES)}) AS evidence FROM ({_SENTENCES_SQL.format(key='doc_id', text=_CUED, frm='documents')})"


def _cues(spark, sf_dir):
    s = outline.section_rows(_docs(spark, sf_dir, _CUED))
    return knowledge.cue_sentences(s).select(F.col("graph_id").cast("long").alias("doc_id"), F.col("p").alias("sentence_index"), "sentence", "claim", "evidence")


@query("claims", f"SELECT doc_id, sentence_index, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) AS k FROM ({_CUE_ROWS}) WHERE claim) WHERE k <= 30")
def claims(spark, sf_dir):
    return links.top_per(_cues(spark, sf_dir).where("claim"), "doc_id", ["sentence_index"], 30).select("doc_id", "sentence_index", "sentence")


@query("evidence", f"SELECT doc_id, sentence_index, sentence FROM ({_CUE_ROWS}) WHERE evidence")
def evidence(spark, sf_dir):
    return _cues(spark, sf_dir).where("evidence").select("doc_id", "sentence_index", "sentence")


_TERMS_SQL = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z][0-9a-zA-Z-]{{3,}}')), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in T._COMMON) + "))"


@query(
    "support_edges",
    f"""WITH cues AS ({_CUE_ROWS}), c AS (SELECT doc_id, sentence_index AS ci, {_TERMS_SQL.format(x='sentence')} AS ct FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_index) AS k FROM cues WHERE claim) WHERE k <= 30),
e AS (SELECT doc_id, sentence_index AS ei, {_TERMS_SQL.format(x='sentence')} AS et FROM cues WHERE evidence),
j AS (SELECT c.doc_id, ci, ei, row_number() OVER (PARTITION BY c.doc_id, ci ORDER BY len(list_intersect(ct, et)) DESC, abs(ci - ei), lpad(CAST(ei AS VARCHAR), 6, '0')) AS k FROM c JOIN e ON c.doc_id = e.doc_id)
SELECT doc_id, ci AS claim_index, ei AS evidence_index, k AS rank FROM j WHERE k <= 5""",
)
def support_edges(spark, sf_dir):
    d = _docs(spark, sf_dir, _CUED)
    cue = lambda x, p: F.struct(p.alias("p"), x.alias("x"), T.has_cue(x, T.CLAIM_CUES).alias("claim"), T.has_cue(x, T.EVIDENCE_CUES).alias("evidence"))
    held = F.transform(T.sections(F.coalesce("text", F.lit(""))), lambda s: F.transform(T.sentences(s["content"]), cue))
    # the cues of a document in its row: read once for both sides
    d = d.select("graph_id", F.filter(F.flatten(held), lambda c: c["claim"] | c["evidence"]).alias("cues"))
    terms = lambda c: F.struct(c["p"].alias("p"), T.support_terms(c["x"]).alias("terms"))
    first = F.slice(F.sort_array(F.filter("cues", lambda c: c["claim"])), 1, 30)
    d = d.select("graph_id", F.transform(first, terms).alias("c"), F.transform(F.filter("cues", lambda c: c["evidence"]), terms).alias("e"))
    s = d.select("graph_id", F.inline(knowledge.support_within(F.col("c"), F.col("e"))))
    return s.select(F.col("graph_id").cast("long").alias("doc_id"), F.col("cp").alias("claim_index"), F.col("ep").alias("evidence_index"), F.col("k").alias("rank"))


@query(
    "definitions",
    r"""WITH l AS (SELECT p_partkey, unnest(['- ' || p_name || ' item: the kind ' || p_type || ' by ' || p_brand, 'Note: nothing of interest here', '**' || p_brand || ' thing** -- again ' || p_type]) AS x, unnest([0, 1, 2]) AS k FROM part),
d AS (SELECT p_partkey, k, regexp_extract(x, '^(?:[*-] +)?(?:[*]{2})?([a-zA-Z][ /+0-9a-zA-Z-]{1,80}?)(?:[*]{2})? *(?:--|:| - ) +(.{12,})$', 1) AS term, regexp_extract(x, '^(?:[*-] +)?(?:[*]{2})?([a-zA-Z][ /+0-9a-zA-Z-]{1,80}?)(?:[*]{2})? *(?:--|:| - ) +(.{12,})$', 2) AS body FROM l)
SELECT p_partkey, trim(term) AS term, body, lower(trim(term)) AS concept FROM d WHERE body <> '' AND lower(trim(term)) NOT IN ('note') AND length(trim(term)) >= 8 AND contains(trim(term), ' ')""",
)
def definitions(spark, sf_dir):
    text = "concat('- ', p_name, ' item: the kind ', p_type, ' by ', p_brand, '\nNote: nothing of interest here\n**', p_brand, ' thing** -- again ', p_type)"
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("graph_id"), F.lit("").alias("source"), F.lit(0).alias("i"), F.lit("").alias("title"), F.expr(text).alias("content"))
    return knowledge.definitions(p).select(F.col("graph_id").cast("long").alias("p_partkey"), "term", "body", "concept")


_ORDER_TABLE = "concat('Orders follow\n| Order | Total | Note |\n| --- | :---: | --- |\n| ', o_orderkey, ' | ', cast(o_totalprice as decimal(18,2)), ' | `', o_orderpriority, '` |\n| none | <br> | |\n| | | |\nend')"


def _order_sections(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select(F.col("o_orderkey").cast("string").alias("graph_id"), F.lit("").alias("source"), F.lit(0).alias("i"), F.lit("t").alias("title"), F.expr(_ORDER_TABLE).alias("content"))


@query(
    "md_table_rows",
    """SELECT o_orderkey, unnest([0, 1]) AS row_index, 2 AS n_rows, unnest(['Order: ' || o_orderkey || ' | Total: ' || CAST(o_totalprice AS DECIMAL(18,2)) || ' | Note: ' || o_orderpriority, 'Order: none']) AS row_text FROM orders""",
)
def md_table_rows(spark, sf_dir):
    r = tables.markdown_tables(_order_sections(spark, sf_dir))
    return r.select(F.col("graph_id").cast("long").alias("o_orderkey"), F.col("r").alias("row_index"), "n_rows", "row_text")


@query("table_evidence", """SELECT o_orderkey, 0 AS row_index FROM orders""")
def table_evidence(spark, sf_dir):
    r = tables.markdown_tables(_order_sections(spark, sf_dir)).where(tables.is_evidence(F.col("row_text")))
    return r.select(F.col("graph_id").cast("long").alias("o_orderkey"), F.col("r").alias("row_index"))


@query(
    "node_ids",
    r"""SELECT doc_id, 'claim:' || coalesce(nullif(left(trim(regexp_replace(lower(v), '[^a-zA-Z0-9]+', '_', 'g'), '_'), 70), ''), 'item') || ':' || left(sha1(v), 10) AS node_id FROM (SELECT doc_id, source || chr(0) || text AS v FROM documents)""",
)
def node_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.scoped_id("claim", F.col("source"), F.col("text")).alias("node_id"))


_SCHEMA = "concat('# ', n_name, '\n| Field | Type | Notes |\n|---|---|---|\n| `', lower(n_name), '_key` | INT | Primary key, not null |\n| region_id | BIGINT | references region_', n_regionkey, ' |\n| plain | TEXT | |\n# Region_', n_regionkey, '\n| Field | Type |\n|---|---|\n| key | INT |\n')"


def _schema_docs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("graph_id"), F.lit("").alias("source"), F.expr(_SCHEMA).alias("text"))


@query(
    "schema_columns",
    """SELECT n_nationkey, n_name AS table_name, lower(n_name) || '_key INT PK NOT NULL, region_id BIGINT references region_' || n_regionkey || ', plain TEXT' AS columns FROM nation
UNION ALL SELECT n_nationkey, 'Region_' || n_regionkey, 'key INT' FROM nation""",
)
def schema_columns(spark, sf_dir):
    g = schema_docs.schema_graph(_schema_docs(spark, sf_dir))
    return g.nodes.select(F.col("graph_id").cast("int").alias("n_nationkey"), F.col("label").alias("table_name"), F.col("content").alias("columns"))


@query("schema_fk_edges", """SELECT n_nationkey, replace(lower(n_name), ' ', '_') AS src, 'region_' || n_regionkey AS dst FROM nation""")
def schema_fk_edges(spark, sf_dir):
    g = schema_docs.schema_graph(_schema_docs(spark, sf_dir))
    return g.edges.select(F.col("graph_id").cast("int").alias("n_nationkey"), "src", "dst")


_ADR = "concat('# Problem\nOrder ', o_orderkey, ' is late.\n# Option A: ', o_orderpriority, '\nShip now.\n- Pro: quick\n# Option B: wait\n- Con: slow\n# Decision\nWe choose ', o_orderpriority, '. Status: accepted\n- Confidence: high\n# Outcomes\n- More work\n')"


def _adrs(spark, sf_dir):
    return _orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("graph_id"), F.lit("").alias("source"), F.expr(_ADR).alias("text"))


@query(
    "decision_roles",
    """SELECT o_orderkey, unnest([0, 1, 2, 3, 4]) AS section_index, unnest(['problem', 'option', 'option', 'decision', 'consequence']) AS role, unnest([NULL, NULL, NULL, 'accepted', NULL]) AS status FROM orders""",
)
def decision_roles(spark, sf_dir):
    e = decision.events(_adrs(spark, sf_dir)).where("scope = 'section'")
    return e.select(F.col("graph_id").cast("long").alias("o_orderkey"), F.get("at", F.lit(0)).alias("section_index"), "role", "status")


@query(
    "decision_items",
    """SELECT o_orderkey, unnest([1, 2, 3, 4]) AS section_index, unnest(['pros', 'cons', 'confidence', 'consequence']) AS role, unnest(['Pro: quick', 'Con: slow', 'Confidence: high', 'More work']) AS text FROM orders""",
)
def decision_items(spark, sf_dir):
    e = decision.events(_adrs(spark, sf_dir)).where("scope = 'item'")
    return e.select(F.col("graph_id").cast("long").alias("o_orderkey"), F.get("at", F.lit(0)).alias("section_index"), "role", "text")


@query(
    "decision_edges",
    """SELECT label, from_role, to_role, count(*) * (SELECT count(*) FROM orders) AS n FROM (VALUES
('contains','decision_document','problem'),('contains','decision_document','option'),('contains','decision_document','option'),('contains','decision_document','decision'),('contains','decision_document','consequence'),
('contains','option','pros'),('contains','option','cons'),('contains','decision','confidence'),('contains','consequence','consequence'),
('has_option','problem','option'),('has_option','problem','option'),('pros','option','pros'),('cons','option','cons'),('resolved_by','problem','decision'),('selects','decision','option'),
('has_confidence','decision','confidence'),('has_consequence','decision','consequence'),('has_consequence','decision','consequence'),('has_consequence','option','consequence'),('has_consequence','option','consequence')) t(label, from_role, to_role) GROUP BY 1, 2, 3""",
)
def decision_edges(spark, sf_dir):
    d = decision.with_edges(decision.logs(_adrs(spark, sf_dir)))
    # a document is a row: its edges are made distinct in it, by a text of ids that hold no NUL
    own = F.array_distinct(F.transform("edges", lambda e: F.concat_ws(T.NUL, e["label"], e["src"], e["dst"])))
    e = d.select(F.explode(own).alias("e")).select(F.split("e", T.NUL).alias("e"))
    kind = lambda k: F.substring_index(F.get("e", F.lit(k)), ":", 1)
    return e.groupBy(F.get("e", F.lit(0)).alias("label"), kind(1).alias("from_role"), kind(2).alias("to_role")).agg(F.count(F.lit(1)).alias("n"))


@query("option_selection", """SELECT o_orderkey, 1 AS option_section FROM orders""")
def option_selection(spark, sf_dir):
    d = decision.with_edges(decision.logs(_adrs(spark, sf_dir)))
    opts = F.filter("log", lambda x: x["role"] == "option")
    of = lambda e: F.transform(F.filter("opts", lambda o: o["id"] == e["dst"]), lambda o: F.get(o["at"], F.lit(0)).cast("int"))
    sel = F.flatten(F.transform(F.filter("edges", lambda e: e["label"] == "selects"), of))
    return d.withColumn("opts", opts).select(F.col("graph_id").cast("long").alias("o_orderkey"), F.explode(sel).alias("option_section"))


_CHART = "concat(text, ' ', element_at(array('legend of the x-axis', 'the trend line in 2021 of revenue', 'pie slice', 'row and column total', 'growth in q3', 'nothing'), cast(doc_id % 6 as int) + 1))"
_CHART_SQL = "text || ' ' || ['legend of the x-axis', 'the trend line in 2021 of revenue', 'pie slice', 'row and column total', 'growth in q3', 'nothing'][doc_id % 6 + 1]"


def _chart_case() -> str:
    folded = "regexp_replace(lower(x), '[^\\x00-\\x7F]', '_', 'g')"
    parts = [f"CASE WHEN regexp_matches({folded}, '\\b({'|'.join(words)})\\b') THEN '{name}' END" for name, words in T.CHART_CUES.items()]
    parts.append(f"CASE WHEN regexp_matches({folded}, '\\b(q[1-4]|20\\d\\d|19\\d\\d)\\b') AND regexp_matches({folded}, '\\b(%|\\$|revenue|growth|rate)\\b') THEN 'time_series_or_metric_chart' END")
    return f"[{', '.join(parts)}]"


@query("chart_cues", f"SELECT doc_id, array_to_string(list_sort(list_filter({_chart_case()}, lambda c: c IS NOT NULL)), ',') AS cues FROM (SELECT doc_id, {_CHART_SQL} AS x FROM documents)")
def chart_cues(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.chart_cues(F.expr(_CHART)), ",").alias("cues"))


_TITLE = "lower(regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1))"


def _titled(spark, sf_dir):
    """Items of benchmark titled by their first two words, and documents without a title."""
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("node_id"), F.expr(_TITLE).alias("label"), F.col("text").alias("content"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("node_id"), F.lit("").alias("label"), F.col("text").alias("content"))
    return b.union(d)


_TITLED_SQL = f"nodes AS (SELECT 'b' || item_id AS node_id, {_TITLE} AS label, text AS content FROM benchmark UNION ALL SELECT 'd' || doc_id, '', text FROM documents)"


@query(
    "title_links",
    rf"""WITH {_TITLED_SQL}, t AS (SELECT node_id AS dst, label AS x FROM nodes WHERE label <> '')
SELECT DISTINCT node_id AS src, dst FROM nodes JOIN t ON node_id <> dst AND CASE WHEN contains(lower(content), x) THEN regexp_matches(' ' || lower(content) || ' ', '[^\pL\pN_]' || x || '[^\pL\pN_]') ELSE false END""",
)
def title_links(spark, sf_dir):
    return links.title_links(_titled(spark, sf_dir)).select("src", "dst")


@query(
    "corpus_mentions",
    rf"""WITH {_TITLED_SQL}, t AS (SELECT node_id AS dst, label AS x FROM nodes WHERE label <> '' AND length(label) >= 4)
SELECT DISTINCT node_id AS src, dst FROM nodes JOIN t ON left(node_id, 1) = 'd' AND CASE WHEN contains(lower(content), x) THEN regexp_matches(' ' || lower(content) || ' ', '[^\pL\pN_]' || x || '[^\pL\pN_]') ELSE false END""",
)
def corpus_mentions(spark, sf_dir):
    n = _titled(spark, sf_dir)
    n = n.select("node_id", "label", "content", F.when(F.col("label") == "", "claim").otherwise("section").alias("type"), F.substring("node_id", 1, 1).alias("source"))
    return links.corpus_mentions(n)[0].select("src", "dst")


@query(
    "file_reference_links",
    """SELECT 'n' || n_nationkey AS src, 'a/r' || n_regionkey || '.md' AS rel FROM nation""",
)
def file_reference_links(spark, sf_dir):
    text = "concat('see [x](../a/r', n_regionkey, '.md#top \"t\") and ![y](https://h/z.png) <a href=\"/abs.md\">q</a> [[missing.md|m]] [up](../../out.md)')"
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"), F.lit("section").alias("type"), F.concat(F.lit("b/n"), F.col("n_nationkey"), F.lit(".md")).alias("source"), F.expr(text).alias("content"))
    files = nodes.select(F.col("source").alias("rel")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("a/r"), F.col("r_regionkey"), F.lit(".md"))))
    e, _ = links.file_reference_links(nodes, files, [".md", ".png"])
    return e.join(files.select("rel", T.corpus_id("file", F.col("rel")).alias("dst")), "dst").select("src", "rel")


@query(
    "merge_first_wins",
    """SELECT node_id, label FROM (SELECT node_id, label, row_number() OVER (PARTITION BY node_id ORDER BY k, doc_id) AS r FROM (
SELECT 0 AS k, doc_id, source AS node_id, lang AS label FROM documents UNION ALL SELECT 1, page_id, 'src' || page_id % 40, 'page' || page_id FROM pages)) WHERE r = 1""",
)
def merge_first_wins(spark, sf_dir):
    def graph(df, key, label, at):
        none = F.lit(None).cast("string")
        n = df.select(F.lit("g").alias("graph_id"), key.alias("node_id"), label.alias("label"), none.alias("content"), none.alias("type"), none.alias("source"), F.create_map().cast("map<string,string>").alias("attr_str"), none.alias("attrs_json"), F.array(at.cast("long")).alias("pos"))
        return graph_frames.Graph(n, spark.createDataFrame([], graph_frames.EDGES))

    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    a = graph(d, F.col("source"), F.col("lang"), F.col("doc_id"))
    b = graph(p, F.concat(F.lit("src"), F.col("page_id") % 40), F.concat(F.lit("page"), F.col("page_id")), F.col("page_id"))
    return graph_frames.merge_graphs([a, b]).nodes.select("node_id", "label")


_QUERY = "the ranking of sections in and with"


def _stems_sql(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split_regex(lower({x}), '[^\\pL\\pN]+'), lambda token: token <> ''), lambda token: {_STEM_SQL}))"


@query(
    "soft_match",
    f"""WITH q AS (SELECT {_stems_sql(f"'{_QUERY}'")} AS q), s AS (SELECT doc_id, {_stems_sql('source')} AS l, {_stems_sql('text')} AS c, {_stems_sql('lang')} AS a FROM documents)
SELECT doc_id, round(2 * len(list_intersect(l, q)) + len(list_intersect(c, q)) / greatest(1, sqrt(len(c) / 50.0)) + len(list_intersect(a, q)), 6) AS score FROM s, q""",
)
def soft_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang")).alias("attr_str"))
    return rank.soft_match(d, _QUERY).select("doc_id", F.round("score", 6).alias("score"))


def _trade(spark, sf_dir):
    """Regions, nations and suppliers as one graph; suppliers point at nations, nations at regions and back."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda p, k, label, at: (F.concat(F.lit(p), F.col(k)).alias("node_id"), F.col(label).alias("label"), F.array((F.col(k) + at).cast("long")).alias("pos"))
    nodes = r.select(*node("r", "r_regionkey", "r_name", 0)).union(n.select(*node("n", "n_nationkey", "n_name", 100))).union(s.select(*node("s", "s_suppkey", "s_name", 1000)))
    edge = lambda a, ak, b, bk, how: (F.concat(F.lit(a), F.col(ak)).alias("src"), F.concat(F.lit(b), F.col(bk)).alias("dst"), F.lit(how).alias("label"))
    edges = s.select(*edge("s", "s_suppkey", "n", "s_nationkey", "in")).union(n.select(*edge("n", "n_nationkey", "r", "n_regionkey", "in"))).union(n.where("n_nationkey % 2 = 0").select(*edge("n", "n_nationkey", "r", "n_regionkey", "of"))).union(n.where("n_nationkey % 3 = 0").select(*edge("r", "n_regionkey", "n", "n_nationkey", "has")))
    g = F.lit("g").alias("graph_id")
    return nodes.select(g, "node_id", "label", F.lit(None).cast("string").alias("content"), "pos"), edges.select(g, "src", "dst", "label")


_TRADE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node_id, r_name AS label, r_regionkey AS pos FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, n_nationkey + 100 FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, s_suppkey + 1000 FROM supplier),
edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'in' AS label FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in' FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'of' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'has' FROM nation WHERE n_nationkey % 3 = 0)"""
_SEED = "region nation asia europe france germany"


def _ranks(spark, sf_dir):
    nodes, edges = _trade(spark, sf_dir)
    return nodes, edges, rank.personalized_page_rank(_SEED, nodes, edges, tol=0.0, max_iter=20)


_PPR_SQL = f"""WITH RECURSIVE {_TRADE_SQL}, q AS (SELECT {_stems_sql(f"'{_SEED}'")} AS q),
seed AS (SELECT node_id, 2 * len(list_intersect({_stems_sql('label')}, q)) AS s FROM nodes, q),
p AS (SELECT node_id, s / sum(s) OVER () AS p FROM seed),
deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), w AS (SELECT DISTINCT e.src, e.dst, 1.0 / d AS w FROM edges e JOIN deg USING (src)),
n AS (SELECT count(*) AS n FROM nodes), m AS MATERIALIZED (SELECT node_id, dst, w FROM nodes JOIN w ON node_id = src UNION ALL SELECT a.node_id, b.node_id, 1.0 / n FROM nodes a, nodes b, n WHERE a.node_id NOT IN (SELECT src FROM edges) UNION ALL SELECT node_id, node_id, 0.0 FROM nodes),
it AS (SELECT 0 AS k, node_id, CAST(1.0 / n AS DOUBLE) AS r FROM nodes, n UNION ALL
  SELECT k + 1, m.dst, CAST(0.15 * any_value(p.p) + 0.85 * sum(it.r * m.w) AS DOUBLE) FROM it JOIN m ON it.node_id = m.node_id JOIN p ON p.node_id = m.dst WHERE k < 20 GROUP BY k, m.dst),
ranks AS MATERIALIZED (SELECT node_id, r AS rank FROM it WHERE k = 20)"""


@query("ppr_scores", _PPR_SQL + " SELECT node_id, round(rank, 7) AS rank FROM ranks")
def ppr_scores(spark, sf_dir):
    return _ranks(spark, sf_dir)[2].select("node_id", F.round("rank", 7).alias("rank"))


_TOP_SQL = _PPR_SQL + ", top AS MATERIALIZED (SELECT node_id, rank FROM ranks JOIN nodes USING (node_id) ORDER BY round(rank, 10) DESC, pos LIMIT 5)"


@query("ppr_topk", _TOP_SQL + " SELECT node_id, round(rank, 7) AS rank FROM top")
def ppr_topk(spark, sf_dir):
    nodes, _, r = _ranks(spark, sf_dir)
    return rank.top_k(r.withColumn("rank", F.round("rank", 10)), nodes).select("node_id", F.round("rank", 7).alias("rank"))


_NEAR_SQL = _TOP_SQL + ", near AS MATERIALIZED (SELECT node_id FROM top UNION SELECT dst FROM edges JOIN top ON src = node_id UNION SELECT src FROM edges JOIN top ON dst = node_id)"


@query("ppr_context_nodes", _NEAR_SQL + " SELECT node_id, round(rank, 7) AS score FROM near LEFT JOIN top USING (node_id)")
def ppr_context_nodes(spark, sf_dir):
    nodes, edges, r = _ranks(spark, sf_dir)
    kept, _ = rank.context(rank.top_k(r.withColumn("rank", F.round("rank", 10)), nodes), nodes, edges)
    return kept.select("node_id", F.round("score", 7).alias("score"))


@query("ppr_context_edges", _NEAR_SQL + " SELECT src, dst, label FROM edges WHERE src IN (SELECT node_id FROM near) AND dst IN (SELECT node_id FROM near)")
def ppr_context_edges(spark, sf_dir):
    nodes, edges, r = _ranks(spark, sf_dir)
    _, inner = rank.context(rank.top_k(r.withColumn("rank", F.round("rank", 10)), nodes), nodes, edges)
    return inner.select("src", "dst", "label")


def _sales(spark, sf_dir):
    """Customers and orders; every order points at its customer and at a customer that may not exist."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = c.select(F.lit("g").alias("graph_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("source"))
    n = n.union(o.select(F.lit("g"), F.concat(F.lit("o"), F.col("o_orderkey")), F.lit("order"), F.lit("orders")))
    e = o.select(F.lit("g").alias("graph_id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 10**9).otherwise(0)).alias("dst"), F.col("o_orderpriority").alias("label"))
    return graph_frames.Graph(n, e)


_SALES_SQL = """nodes AS (SELECT 'c' || c_custkey AS node_id, c_mktsegment AS type, 'n' || c_nationkey AS source FROM customer UNION ALL SELECT 'o' || o_orderkey, 'order', 'orders' FROM orders),
edges AS (SELECT 'o' || o_orderkey AS src, 'c' || (o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000000 ELSE 0 END) AS dst, o_orderpriority AS label FROM orders)"""
_DANGLING_SQL = "(SELECT * FROM edges WHERE src NOT IN (SELECT node_id FROM nodes) OR dst NOT IN (SELECT node_id FROM nodes))"
_ALONE_SQL = "(SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges))"


@query(
    "graph_summary",
    f"""WITH {_SALES_SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM {_DANGLING_SQL}) AS dangling_edges, (SELECT count(*) FROM {_ALONE_SQL}) AS isolated_nodes,
(SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes GROUP BY type)) AS types, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM edges GROUP BY label)) AS labels,
(SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM nodes GROUP BY source ORDER BY n DESC, source LIMIT 8)) AS sources""",
)
def graph_summary(spark, sf_dir):
    h = graph_frames.health(_sales(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit("="), e["n"])), ",").alias(c)
    return h.select("node_count", "edge_count", "dangling_edges", "isolated_nodes", flat("types"), flat("labels"), flat("sources"))


@query("dangling_edges", f"WITH {_SALES_SQL} SELECT src, dst, label FROM {_DANGLING_SQL}")
def dangling_edges(spark, sf_dir):
    return graph_frames.dangling_edges(_sales(spark, sf_dir)).select("src", "dst", "label")


@query("isolated_nodes", f"WITH {_SALES_SQL} SELECT node_id FROM {_ALONE_SQL}")
def isolated_nodes(spark, sf_dir):
    return graph_frames.isolated_nodes(_sales(spark, sf_dir)).select("node_id")


@query(
    "snapshot_delta",
    """WITH c AS (SELECT o_orderpriority AS target, strftime(o_orderdate, '%Y-%m') AS snapshot, count(DISTINCT o_custkey) AS node_count, count(*) AS edge_count FROM orders GROUP BY 1, 2)
SELECT target, snapshot, lag(snapshot) OVER w AS previous, node_count - lag(node_count) OVER w AS node_delta, edge_count - lag(edge_count) OVER w AS edge_delta FROM c WINDOW w AS (PARTITION BY target ORDER BY snapshot)""",
)
def snapshot_delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.groupBy(F.col("o_orderpriority").alias("target"), F.date_format("o_orderdate", "yyyy-MM").alias("snapshot")).agg(F.count_distinct("o_custkey").alias("node_count"), F.count(F.lit(1)).alias("edge_count"))
    return graph_frames.snapshot_delta(c).select("target", "snapshot", "previous", "node_delta", "edge_delta")


@query(
    "recall_at_k",
    """WITH f AS (SELECT o_custkey AS qid, o_orderpriority AS label FROM orders), g AS (SELECT DISTINCT c_custkey AS qid, unnest(['1-URGENT', '5-LOW']) AS label FROM customer),
r AS (SELECT g.qid, count(h.label) / count(*) AS r FROM g LEFT JOIN (SELECT DISTINCT * FROM f) h ON g.qid = h.qid AND g.label = h.label GROUP BY 1)
SELECT count(*) AS questions, round(avg(r), 4) AS mean_recall, round(avg(CAST(r = 1 AS INT)), 4) AS perfect, round(avg(CAST(r > 0 AND r < 1 AS INT)), 4) AS partial, round(avg(CAST(r = 0 AS INT)), 4) AS zero FROM r""",
)
def recall_at_k(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("label"))
    gold = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("label"))
    return rank.recall(found, gold)


# sources, scan and streaming


@query("load_csv_text", """SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS row_text FROM nation""")
def load_csv_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return loaders.rendered_rows(n, ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "row_text")


@query("load_json_text", """SELECT event_id, 'record.id: ' || event_id || chr(10) || 'record.props.0: ' || (json_extract_string(props, '$.k')) AS text FROM events""")
def load_json_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    js = e.select(F.concat(F.lit(""), F.col("event_id")).alias("path"), F.concat(F.lit('{"record": {"props": ['), F.get_json_object("props", "$.k"), F.lit('], "id": '), F.col("event_id"), F.lit("}}")).alias("text"), F.lit(False).alias("l"))
    out = js.mapInArrow(loaders._each(loaders.json_text), "path string, text string, error string")
    return out.select(F.col("path").cast("long").alias("event_id"), "text")


@query(
    "code_language",
    """SELECT p_partkey, ['python', 'cpp', 'yaml', 'typescript', NULL][p_partkey % 5 + 1] AS language, CASE WHEN p_partkey % 5 < 4 THEN '# language: ' || ['python', 'cpp', 'yaml', 'typescript', NULL][p_partkey % 5 + 1] || chr(10) || chr(10) ELSE '' END || p_name AS text FROM part""",
)
def code_language(spark, sf_dir):
    path = F.concat(F.lit("d.d/f"), F.element_at(F.array(*map(F.lit, (".py", ".CC", ".yml", ".tsx", ".zzz"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", loaders.language_of(path).alias("language"), loaders.code(F.col("p_name"), path).alias("text"))


@query("html_text")
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text"))
    out = p.mapInArrow(loaders._each(loaders.html_text), "path string, text string, error string")
    return out.select(F.col("path").cast("long").alias("page_id"), "text")


def _listing(spark, sf_dir):
    """Documents as files: a folder by source, a suffix by language."""
    end = F.element_at(F.create_map(*(F.lit(x) for kv in (("en", ".md"), ("fr", ".txt"), ("de", ".bin"), ("es", ".py")) for x in kv)), F.col("lang"))
    rel = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), end)
    return table(spark, sf_dir, "documents").select(rel.alias("rel"), F.col("n_chars").alias("size"))


def _selection(spark, sf_dir):
    return scan.select_files(_listing(spark, sf_dir), [".md", ".txt", ".py"], include=["*.md", "*.txt", "src1"], exclude=["src0", "*7.md"], max_files=150)


_SCAN_SQL = """f AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.bin' ELSE '.py' END AS rel, n_chars AS size, source, lang, doc_id FROM documents),
r AS (SELECT rel, size, regexp_extract(rel, '\\.[a-z]+$') AS suffix, row_number() OVER (ORDER BY source, rel) AS seq, CASE WHEN source = 'src0' OR rel LIKE '%7.md' THEN 'exclude_filter_match' WHEN lang = 'de' THEN 'unsupported_extension' WHEN NOT (lang IN ('en', 'fr') OR source = 'src1') THEN 'include_filter_mismatch' END AS reason FROM f),
scan AS (SELECT rel, size, suffix, seq, CASE WHEN reason IS NULL AND count(*) FILTER (WHERE reason IS NULL) OVER (ORDER BY seq) > 150 THEN 'max_files_exceeded' ELSE reason END AS reason FROM r)"""


@query("scan_selection", f"WITH {_SCAN_SQL} SELECT rel, seq, reason FROM scan")
def scan_selection(spark, sf_dir):
    return _selection(spark, sf_dir).select("rel", "seq", "reason")


@query("skip_histogram", f"WITH {_SCAN_SQL} SELECT reason, suffix, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM scan WHERE reason IS NOT NULL GROUP BY 1, 2")
def skip_histogram(spark, sf_dir):
    return scan.skip_histogram(_selection(spark, sf_dir))


@query("manifest_digest", f"WITH {_SCAN_SQL} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sha256(string_agg(rel || chr(0), '' ORDER BY seq)) AS digest FROM scan WHERE reason IS NULL")
def manifest_digest(spark, sf_dir):
    return scan.manifest_digest(_selection(spark, sf_dir).where("reason IS NULL"))


@query(
    "byte_budget",
    """WITH f AS (SELECT source, doc_id AS seq, n_chars AS size FROM documents), c AS (SELECT *, sum(CASE WHEN size > 5000 THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY seq) AS total FROM f),
b AS (SELECT *, size <= 5000 AND total > 20000 AS breach FROM c), e AS (SELECT *, coalesce(bool_or(breach) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM b)
SELECT source, seq, CASE WHEN before THEN 'max_total_bytes_exceeded' WHEN size > 5000 THEN 'file_too_large' WHEN breach THEN 'max_total_bytes_exceeded' END AS reason FROM e""",
)
def byte_budget(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"))
    return scan.byte_budget(f, 5000, 20_000, by=["source"]).select("source", "seq", "reason")


@query(
    "cache_hits",
    """SELECT doc_id AS rel, CASE WHEN doc_id % 10 = 0 THEN 'stale' WHEN doc_id % 10 = 1 THEN 'miss' WHEN doc_id % 10 = 2 THEN 'updated' ELSE 'hit' END AS status FROM documents""",
)
def cache_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("size"))
    was = d.where("rel % 10 <> 1").withColumn("digest", F.when(F.col("rel") % 10 == 2, "old").otherwise(F.col("digest")))
    return scan.cache_status(d.where("rel % 10 <> 0"), was.select("rel", "digest", "size"), ["digest", "size"]).select("rel", "status")


@query("streaming_incremental", """SELECT doc_id, length(text) AS n FROM documents""")
def streaming_incremental(spark, sf_dir):
    """Reads documents as a stream in two runs; the second finds nothing new."""
    import uuid

    from ..operators.lineage import shared_folder

    base = f"{shared_folder(spark)}/tessera-stream-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k in range(2):
        s = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
        s = s.select(F.col("doc_id").cast("string").alias("source"), "text")
        run = incremental.extract_new(s, lambda d: d.select(F.col("source").cast("long").alias("doc_id"), F.char_length("text").alias("n")), f"{base}/out", f"{base}/seen", f"{base}/check{k}")
        run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents titled by their first words, linked by titles, ranked against a query: the best and their context."""
    d = table(spark, sf_dir, "documents")
    nodes = d.select(
        F.lit("documents").alias("graph_id"), F.col("doc_id").cast("string").alias("node_id"), F.expr(_TITLE).alias("label"),
        F.col("text").alias("content"), F.array("doc_id").alias("pos"),
    )
    held = lineage.cut_lineage(links.titles_held(nodes))
    scored = rank.soft_match(nodes, _QUERY).select("graph_id", "node_id", F.coalesce("label", F.lit("")).alias("label"), "score")
    ranks = rank.ranks_by_titles(lineage.cut_lineage(scored), held)
    # equal nodes tie whatever the order of their sums
    top = rank.top_k(ranks.withColumn("rank", F.round("rank", 10)), nodes)
    kept = rank.title_context(top, nodes, held)
    return kept.select("node_id", "label", F.round("score", 6).alias("score"))


QUERIES["flagship_rank"] = flagship
