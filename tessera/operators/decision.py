"""Decision graphs: problems, options, decisions and what hangs off them, as an event log with carried state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph_frames import Graph, edge_row, merged, node_row
from .tables import table_runs

STATUSES = "accepted proposed rejected deprecated superseded deferred".split()
#: Cues of a section's role, in the order in which roles are tried.
ROLE_CUES = {
    "problem": "challenge|issue|motivation|problem",
    "context": "assumptions?|background|constraints?|context|(?:decision )?drivers?|goals?|non goals?|rationale|reasons?|requirements?",
    "option": "alternative|approach|option|solution",
    "pros": "advantages|benefits|pros",
    "cons": "cons|disadvantages|drawbacks",
    "tradeoff": "consideration|trade-?off",
    "decision": "|".join(["chosen", "decision", "resolution", "selected", "status", *STATUSES]),
    "consequence": "consequences?|impact|outcomes?|result|risks",
    "confidence": "certainty|confidence|confidence level",
}
_S = "(?:s)?"
_ITEM = [
    ("problem", "^(?:problem|motivation|issue|challenge):"),
    ("option", "^(?:solution|option|alternative)s?:|^approach(?:es)?:"),
    ("option", r"^(?:solution|option|approach|alternative)\s+[0-9a-z]+[-:.)]"),
    ("pros", "^(?:advantage|benefit|pro)s?:"),
    ("risk", "^risk(?::| -|[.])"),
    ("cons", "^(?:con|drawback)s?:|^cost:"),
    ("tradeoff", "trade-?off|but "),
    ("decision", "^(?:decide|decision:|choose|chosen|selected:|status:)"),
    ("context", "^(?:context|background|rationale):|^(?:goal|requirement|constraint|assumption|driver|decision driver|reason)s?:|^non[- ]goals?:"),
    ("decision", rf"(?<![0-9a-z])(?:{'|'.join(STATUSES)})(?![0-9a-z])"),
    ("consequence", "^(?:consequence|outcome|result)s?:|^(?:impact|risk):"),
    ("confidence", "^(?:certainty|confidence|confidence level):"),
]
_LEADS = "problem challenge issue motivation context background rationale cost decision choose chosen selected status impact confidence certainty"
_PREFIXED = (
    r"(?iU)^(?:" + "|".join(sorted(_LEADS.split())) + r"|confidence level|non[- ]goals?|trade-?offs?|"
    r"(?:decision )?drivers?|(?:goal|requirement|constraint|assumption|reason|pro|benefit|advantage|con|drawback|risk|consideration|consequence|outcome|result)s?|"
    r"(?:option|alternative|solution)s?(?:\s+[0-9a-z]+)?|approache?s?(?:\s+[0-9a-z]+)?)\s*:\s*(?:\S.*)$"
)
_BULLET = r"(?U)^(?:[+*-]|\d+[).])\s+(.+)$"


def _holds(text: Column, words: str) -> Column:
    return F.rlike(text, F.lit(rf"(?<![0-9a-z])(?:{words})(?![0-9a-z])"))


def section_role(title: Column, content: Column) -> Column:
    """By the title against all roles, then by title and the first 300 characters; else decision_context."""

    def first(text: Column) -> Column:
        return F.coalesce(*(F.when(_holds(text, words), role) for role, words in ROLE_CUES.items()))

    both = F.lower(F.concat(title, F.lit("\n"), T.cut(content, 300)))
    return F.coalesce(T.let(F.lower(title), first), T.let(both, first), F.lit("decision_context"))


def item_role(text: Column, default: Column) -> Column:
    """The first rule that fits a line; else the role of its section."""

    def first(low: Column) -> Column:
        value = lambda role: F.when(default == "consequence", "consequence").otherwise("cons") if role == "risk" else F.lit(role)
        return F.coalesce(*(F.when(F.rlike(low, F.lit(pattern)), value(role)) for role, pattern in _ITEM), default)

    return T.let(F.lower(text), first)


def decision_status(title: Column, content: Column) -> Column:
    return T.let(F.lower(F.concat(title, F.lit("\n"), content)), lambda text: F.coalesce(*(F.when(_holds(text, s), s) for s in STATUSES)))


def positive_cell(c: Column) -> Column:
    """Whether a cell of a decision column chooses its row."""
    low = T.strip(F.lower(c))
    no = low.isin("", "deferred", "n", "no", "not selected", "reject", "rejected")
    return ~no & (low.isin("y", "yes", "selected", "recommended", "chosen", "accepted") | F.rlike(low, F.lit("recommend|select|accept|chosen|choose")))


def items(content: Column) -> Column:
    """Array of (line, text) of a section: bullets, and lines that open with a known word and a colon."""

    def said(x: Column) -> Column:
        bullet = F.when(F.rlike(x, F.lit(_BULLET)), T.strip(F.regexp_extract(x, _BULLET, 1))).when(F.rlike(x, F.lit(_PREFIXED)), x)
        return F.when(~x.startswith("|") & ~x.startswith("#") & (x != ""), bullet)

    lines = F.transform(T.split_lines(content), lambda x, k: F.struct(k.alias("line"), T.let(T.strip(x), said).alias("text")))
    return F.filter(lines, lambda e: e["text"].isNotNull())


_ALIASES = {
    "option": "alternative alternatives approach solution",
    "pros": "advantages benefit benefits pro",
    "cons": "con disadvantages drawback drawbacks risk risks",
    "tradeoff": "considerations trade_off tradeoffs",
    "decision": "chosen resolution selected status",
    "consequence": "impact result results",
    "confidence": "certainty confidence_level",
}


def header_role(c: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    out = None
    for role, names in _ALIASES.items():
        out = F.when(h.isin(names.split()), role) if out is None else out.when(h.isin(names.split()), role)
    return out.otherwise(h)


def option_tables(content: Column) -> Column:
    """Decision tables of a section with at least one row: an array of tables, each an array of rows, each an array of
    (k, v) by header role. A table is a line with a bar, a line of dashes for at least two columns, and the lines
    with bars after it."""
    bar = r":?-{3,}:?\s*"
    dash = rf"^\s*[|]?\s*{bar}(?:[|]\s*{bar})+[|]?\s*$"
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.regexp_replace(T.strip(line), r"^\|", ""), r"\|$", ""), r"\|"), T.strip)

    def row(head: Column, cells: Column) -> Column:
        pairs = F.zip_with(F.slice(head, F.lit(1), F.size(cells)), F.slice(cells, F.lit(1), F.size(head)), lambda h, c: F.struct(h.alias("k"), c.alias("v")))
        names = F.array_distinct(F.filter(head, lambda h: h != ""))
        last = lambda pairs, n: F.try_element_at(F.filter(pairs, lambda e: e["k"] == n), F.lit(-1))["v"]
        made = T.let(pairs, lambda p: F.transform(names, lambda n: F.struct(n.alias("k"), last(p, n).alias("v"))))
        return F.filter(made, lambda e: e["v"].isNotNull())

    def rows(head: Column, body: Column) -> Column:
        return F.filter(F.transform(body, lambda x: T.let(cells(x), lambda c: row(head, c))), lambda r: F.exists(r, lambda e: e["v"] != ""))

    runs = table_runs(T.split_lines(content), lambda x: F.contains(x, F.lit("|")), lambda x: F.rlike(x, F.lit(dash)))
    found = F.transform(runs, lambda t: T.let(F.transform(cells(t["head"]), header_role), lambda head: rows(head, t["body"])))
    return F.when(F.contains(content, F.lit("|")), F.filter(found, lambda t: F.size(t) > 0)).otherwise(F.array())


def _value(row: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(row, lambda e: e["k"] == key), F.lit(-1))["v"], F.lit(""))


def normal_option(c: Column) -> Column:
    """What a title or sentence says of an option, without the words that all options share."""
    words = "solution|option|approach|alternative"
    low = F.regexp_replace(F.lower(c), rf"(?U)\b(?:{words})\s+[0-9a-z]+[-:.)]?", " ")
    low = F.regexp_replace(low, rf"(?U)\b(?:{words}|selected|decision|chosen|choose)\b[-:.)]?", " ")
    return F.btrim(F.regexp_replace(low, "[^0-9a-z]+", " "))


def option_score(option: Column, decision: Column) -> Column:
    """How much of an option a decision names: distinct terms of over 2 characters found in it, and all terms
    again if the whole text is."""
    terms = F.filter(F.split(option, " "), lambda w: F.char_length(w) > 2)
    one = F.size(F.filter(F.array_distinct(terms), lambda w: F.contains(decision, w)))
    whole = F.when(F.contains(decision, option), F.size(terms)).otherwise(0)
    return F.when((option == "") | (F.size(terms) == 0), 0).otherwise(one + whole)


_EVENT = {"at": "array<bigint>", "scope": "string", "role": "string", "id": "string", "parent": "string", "title": "string", "text": "string", "own": "string", "level": "int", "section": "string", "status": "string"}


def _event(at: list[Column], **given: Column) -> Column:
    given["at"] = F.array(*at, *[F.lit(0)] * (5 - len(at)))
    return F.struct(*(given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in _EVENT.items()))


def _root(source: Column) -> Column:
    return T.node_id("decision_document", F.when(F.coalesce(source, F.lit("")) != "", source).otherwise("document"))


def logs(docs: DataFrame) -> DataFrame:
    """Of documents (graph_id, source, text), one graph each: a row per document (graph_id, source, root, log), log the
    array of its events in order of at. No row needs another, so nothing is shuffled."""
    src, root = F.col("source"), F.col("root")

    def section(s: Column) -> Column:
        status = F.when(s["role"] == "decision", decision_status(s["title"], s["content"]))
        return _event([s["i"]], scope=F.lit("section"), role=s["role"], id=s["id"], parent=root, title=s["title"], text=s["content"], level=s["level"], section=s["title"], status=status)

    def item(s: Column, e: Column) -> Column:
        def made(role: Column) -> Column:
            nid = T.scoped_id(role, src, F.concat(s["i"].cast("string"), F.lit("-line-"), e["line"].cast("string"), F.lit("-"), e["text"]))
            status = F.when(role == "decision", decision_status(F.lit(""), e["text"]))
            return _event([s["i"], F.lit(2), e["line"]], scope=F.lit("item"), role=role, id=nid, parent=s["id"], title=T.label(e["text"]), text=e["text"], section=s["title"], status=status)

        return T.let(item_role(e["text"], s["role"]), made)

    def table(s: Column, rows: Column, t: Column) -> Column:
        has = lambda k: F.exists(rows, lambda row: _value(row, k) != "")
        said = T.let(F.when(has("option"), "option").when(has("name"), "name").when(has("title"), "title"), lambda k: F.transform(rows, lambda row: F.coalesce(F.nullif(T.strip(_value(row, k)), F.lit("")), _value(row, "decision"))))
        return F.flatten(F.zip_with(F.transform(rows, lambda row, r: F.struct(row.alias("row"), r.alias("r"))), said, lambda x, opt: cells(s, t, x["r"], x["row"], opt)))

    def cells(s: Column, t: Column, r: Column, row: Column, opt: Column) -> Column:
        def made(body: Column) -> Column:
            key = F.concat_ws("-", s["i"], t, r, F.coalesce(F.nullif(opt, F.lit("")), body))
            table_id = lambda kind: T.scoped_id(kind, src, F.concat(F.lit("table-"), key))
            out = []
            for k, kind in enumerate("option pros cons tradeoff decision consequence confidence".split()):
                text = body if kind == "option" else _value(row, kind)
                name = opt if kind == "option" else text
                ok = (opt != "") if kind == "option" else positive_cell(text) if kind == "decision" else text != ""
                out.append(F.when(ok, _event([s["i"], F.lit(1), t, r, F.lit(k)], scope=F.lit("row"), role=F.lit(kind), id=table_id(kind), parent=s["id"], title=T.label(name), text=body if kind in ("option", "decision") else text, own=F.when(opt != "", table_id("option")), section=s["title"])))
            return F.array_compact(F.array(*out))

        return T.let(F.array_join(F.transform(F.filter(row, lambda e: e["v"] != ""), lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "\n"), made)

    def of_section(s: Column) -> Column:
        rows = F.flatten(F.transform(option_tables(s["content"]), lambda rows, t: table(s, rows, t)))
        return F.concat(F.array(section(s)), rows, F.transform(items(s["content"]), lambda e: item(s, e)))

    parts = T.sections(F.coalesce("text", F.lit("")), None, "Decision")
    parts = F.transform(parts, lambda s, i: F.struct(i.alias("i"), s["title"].alias("title"), s["level"].alias("level"), s["content"].alias("content"), section_role(s["title"], s["content"]).alias("role")))
    named = F.transform(parts, lambda s: s.withField("id", T.scoped_id(s["role"], src, F.concat_ws("-", s["i"], s["title"]))))
    d = docs.select("graph_id", "source", "text", _root(src).alias("root"))
    return d.select("graph_id", "source", "root", F.flatten(F.transform(named, of_section)).alias("log"))


def events(docs: DataFrame) -> DataFrame:
    """The log: a row per section, option-table cell and item, ordered by at (an array of numbers).

    Columns: graph_id, source, root, at, scope (section, row, item), role, id, parent, title, text, own (the option
    of a table row; the row's key where it reuses the current one), level, section, status."""
    return logs(docs).select("graph_id", "source", "root", F.inline("log"))


_TOLD = "array<struct<id:string,at:array<bigint>>>"
_STATE = {"P": "string", "O": "string", "D": "string", "S": "string", "opts": "array<struct<id:string,said:string>>", "ctx": _TOLD}
_BEFORE = {"P": "string", "O": "string", "D": "string", "S": "string", "sel": "string", "row_opt": "string", "ctx": _TOLD}


def _carried(log: Column) -> Column:
    """For each event of a log in order: P last problem, O current option, D current decision, S option selected by it,
    all before the event; sel, what a decision selects; row_opt, the option of a row; ctx, the contexts before a
    decision."""
    none = F.lit(None)
    typed = lambda kinds, given: F.struct(*(given.get(k, F.array() if kind.startswith("array") and k != "sel" else none).cast(kind).alias(k) for k, kind in kinds.items()))
    outs = f"array<struct<{','.join(f'{k}:{v}' for k, v in _BEFORE.items())}>>"

    def best(opts: Column, said: Column) -> Column:
        """The earliest of the options that the decision names most."""
        scored = F.transform(opts, lambda o, k: F.struct(option_score(o["said"], said).alias("score"), (-k).alias("k"), o["id"].alias("id")))
        return T.let(F.array_max(scored), lambda m: F.when(m["score"] > 0, m["id"]))

    def step(acc: Column, e: Column) -> Column:
        role, row = e["role"], e["scope"] == "row"
        of_row = F.when(row, F.coalesce(e["own"], acc["O"]))
        chosen = F.when(role == "decision", F.when(row, of_row).otherwise(F.coalesce(best(acc["opts"], e["said"]), acc["O"])))

        def after(sel: Column) -> Column:
            decides = role == "decision"
            before = {"P": acc["P"], "O": acc["O"], "D": acc["D"], "S": acc["S"], "sel": sel, "row_opt": of_row, "ctx": F.when(decides & ~row, acc["ctx"])}
            now = {
                "P": F.when((role == "problem") & ~row, e["id"]).otherwise(acc["P"]),
                "O": F.when(role == "option", e["id"]).otherwise(acc["O"]),
                "D": F.when(decides, e["id"]).otherwise(acc["D"]),
                "S": F.when(decides, sel).otherwise(acc["S"]),
                "opts": F.when(role == "option", F.concat(acc["opts"], F.array(F.struct(e["id"].alias("id"), e["said"].alias("said"))))).otherwise(acc["opts"]),
                "ctx": F.when((role == "context") & ~row, F.concat(acc["ctx"], F.array(F.struct(e["id"].alias("id"), e["at"].alias("at"))))).otherwise(acc["ctx"]),
            }
            return F.struct(*(now[k].cast(kind).alias(k) for k, kind in _STATE.items()), F.concat(acc["out"], F.array(typed(_BEFORE, before))).cast(outs).alias("out"))

        return T.let(chosen, after)

    said = lambda e: F.when(e["role"].isin("option", "decision"), normal_option(F.concat_ws(" ", e["title"], e["text"])))
    short = F.transform(log, lambda e: F.struct(e["role"].alias("role"), e["scope"].alias("scope"), e["id"].alias("id"), e["own"].alias("own"), e["at"].alias("at"), said(e).alias("said")))
    start = F.struct(*(F.expr(f"cast({'array()' if kind.startswith('array') else 'null'} as {kind})").alias(k) for k, kind in _STATE.items()), F.expr(f"cast(array() as {outs})").alias("out"))
    return F.aggregate(short, start, step, lambda acc: acc["out"])


def _edges(e: Column, c: Column) -> Column:
    """The edges of an event, by the rules of carried state, as an array of (src, dst, label, pos)."""
    role = e["role"]
    row = e["scope"] == "row"
    free = ~row
    rules = [
        (F.lit(True), e["parent"], e["id"], F.lit("contains")),
        (free & (role == "context"), c["P"], e["id"], F.lit("has_context")),
        (free & (role == "context"), c["D"], e["id"], F.lit("informed_by")),
        (role == "option", c["P"], e["id"], F.lit("has_option")),
        (free & role.isin("pros", "cons", "tradeoff"), c["O"], e["id"], role),
        (row & role.isin("pros", "cons", "tradeoff"), c["row_opt"], e["id"], role),
        (role == "decision", c["P"], e["id"], F.lit("resolved_by")),
        (role == "decision", e["id"], c["sel"], F.lit("selects")),
        (free & (role == "consequence"), c["D"], e["id"], F.lit("has_consequence")),
        (free & (role == "consequence"), F.coalesce(c["S"], c["O"]), e["id"], F.lit("has_consequence")),
        (row & (role == "consequence"), c["row_opt"], e["id"], F.lit("has_consequence")),
        (role == "confidence", c["D"], e["id"], F.lit("has_confidence")),
        (row & (role == "confidence") & c["D"].isNull(), c["row_opt"], e["id"], F.lit("confidence")),
    ]
    edge = lambda a, b, how, *more: F.struct(a.alias("src"), b.alias("dst"), how.alias("label"), F.concat(e["at"], *more).alias("pos"))
    out = F.array_compact(F.array(*(F.when(ok & a.isNotNull() & b.isNotNull(), edge(a, b, how, F.array(F.lit(k).cast("long")))) for k, (ok, a, b, how) in enumerate(rules))))
    told = F.transform(F.coalesce(c["ctx"], F.array().cast(_TOLD)), lambda x: edge(e["id"], x["id"], F.lit("informed_by"), F.array(F.lit(20).cast("long")), x["at"]))
    return F.concat(out, told)


def with_edges(logs: DataFrame) -> DataFrame:
    """Adds edges, an array of (src, dst, label, pos), to documents with their logs."""
    return logs.withColumn("edges", F.flatten(F.zip_with("log", _carried(F.col("log")), _edges)))


def decision_edges(log: DataFrame) -> DataFrame:
    """(graph_id, src, dst, label, pos) of a log in rows, in any order, by the rules of carried state. For documents at
    hand, with_edges(logs(docs)) has the same without a shuffle."""
    own = log.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(*_EVENT))).alias("log"))
    return with_edges(own).select("graph_id", F.inline("edges"))


def decision_graph(docs: DataFrame) -> Graph:
    """docs (graph_id, source, text) to their decision graphs."""
    g, src = F.col("graph_id"), F.col("source")
    own = logs(docs)
    log = own.select("graph_id", "source", "root", F.inline("log"))
    edges = with_edges(own).select("graph_id", F.inline("edges"))
    name = F.when(F.coalesce(src, F.lit("")) != "", src).otherwise("Decision Document")
    base = {"source": src, "extraction_method": F.lit("static")}
    docs = docs.withColumn("root", _root(src))
    top = docs.select(*node_row(g, F.col("root"), name, T.cut(F.coalesce("text", F.lit("")), 4000), {"type": F.lit("decision_document"), **base}, [F.lit(-1)]))
    attrs = {"type": F.col("role"), "level": F.col("level"), "document_id": F.col("root"), "section": F.when(F.col("scope") != "section", F.col("section")), "decision_status": F.col("status"), **base}
    made = node_row(g, F.col("id"), F.col("title"), F.col("text"), attrs, [F.lit(0)])
    graph = merged(Graph(top.unionByName(log.select(*made[:-1], F.col("at").alias("pos"))), edges))
    graph.roots = docs.select("graph_id", F.col("root").alias("current_node_id"))
    return graph


__all__ = ["decision_edges", "decision_graph", "edge_row", "events", "header_role", "item_role", "items", "logs", "normal_option", "option_score", "option_tables", "positive_cell", "reduce", "section_role", "with_edges"]
