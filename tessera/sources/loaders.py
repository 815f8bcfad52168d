"""Files to text: one row per file in, one string out, by suffix. Built-in expressions except for HTML, nested JSON, delimited tables, Word files and slides."""

from __future__ import annotations

import json
import re
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import csv_text, docx_text, pptx_text

LANGUAGES = {
    "bash": "sh bash zsh", "c": "c h", "cpp": "cpp cc hpp", "csharp": "cs", "go": "go", "java": "java", "javascript": "js jsx", "json": "json",
    "kotlin": "kt", "markdown": "md", "php": "php", "python": "py", "r": "r", "ruby": "rb", "rust": "rs", "scala": "scala", "sql": "sql",
    "swift": "swift", "toml": "toml", "typescript": "ts tsx", "xml": "xml", "yaml": "yml yaml",
}
BINARY = "bmp docx gif jpeg jpg pdf png pptx tif tiff webp".split()
_TEXT = "csv htm html json jsonl markdown md mdx rst tsv txt".split()
SUPPORTED = sorted({f".{s}" for v in LANGUAGES.values() for s in v.split()} | {f".{s}" for s in (*BINARY, *_TEXT)})


def suffix_of(path: Column) -> Column:
    """The lower-cased ending with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*([.][^./]+)$", 1))


def language_of(path: Column) -> Column:
    out = None
    for name, ends in LANGUAGES.items():
        hit = suffix_of(path).isin([f".{e}" for e in ends.split()])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def decoded(content: Column) -> Column:
    """Bytes as text: by byte-order mark, else UTF-8 if valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 4))
    rest = lambda n: F.substring(content, n, 2**31 - 1)
    return (
        F.when(head.startswith("EFBBBF"), F.decode(rest(4), "UTF-8"))
        .when(head == "FFFE0000", F.decode(rest(5), "UTF-32LE"))
        .when(head == "0000FEFF", F.decode(rest(5), "UTF-32BE"))
        .when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def plain(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def code(text: Column, path: Column) -> Column:
    """Source code under a line that names its language."""
    name = language_of(path)
    return F.when(name.isNull(), text).otherwise(F.concat(F.lit("# language: "), name, F.lit("\n\n"), text))


def rendered_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds row_text: ``k: v`` of columns that aren't blank, joined by commas; rows of blanks only go."""
    parts = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns]
    return df.withColumn("row_text", F.concat_ws(", ", *parts)).where("row_text <> ''")


def read_csv_text(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Rows of CSV or TSV files (by suffix unless sep is given) as row_text."""
    df = spark.read.csv(path, header=True, sep=sep or ("\t" if path.lower().endswith(".tsv") else ","))
    return rendered_rows(df, df.columns)


def _json_lines(value: object, prefix: str, most: int | None) -> list[str]:
    if isinstance(value, dict):
        keys = sorted(value)[:most]
        return [x for k in keys for x in _json_lines(value[k], f"{prefix}.{k}" if prefix else str(k), most)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value[:most]) for x in _json_lines(v, f"{prefix}.{i}" if prefix else str(i), most)]
    said = {None: "null", True: "true", False: "false"}.get(value, value) if isinstance(value, (bool, type(None))) else value
    return [f"{prefix}: {said}" if prefix else str(said)]


def json_text(text: str, lines: bool = False, most: int | None = None) -> str:
    """Paths and values of a JSON document, keys sorted; of JSON lines, each under ``record N``."""
    if not lines:
        return "\n".join(_json_lines(json.loads(text), "", most))
    out: list[str] = []
    n = 0
    for at, line in enumerate(text.splitlines(), 1):
        if not line.strip() or (most is not None and n >= most):
            continue
        n += 1
        try:
            out += _json_lines(json.loads(line), f"record {n}", most)
        except ValueError as e:
            raise ValueError(f"line {at}: {e}") from e
    return "\n".join(out)


class _Html(HTMLParser):
    SKIP = frozenset("script style noscript template".split())
    BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.deep, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.deep += 1
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.deep = max(0, self.deep - 1)
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.deep:
            self.out.append(data)


def html_text(html: str) -> str:
    """Visible text: block elements on lines of their own, blanks collapsed. Void elements such as meta hide nothing."""
    p = _Html()
    p.feed(html)
    p.close()
    text = "\n".join(x.strip() for x in re.sub("[\t ]+", " ", "".join(p.out)).split("\n"))
    return re.sub("\n\n\n+", "\n" * 2, text).strip()


def _each(f, out_type=pa.string()):
    def run(batches):
        for b in batches:
            got = [(None, None) if x is None else _safe(f, *args) for x, args in zip(b.column(1).to_pylist(), zip(*(b.column(i).to_pylist() for i in range(1, b.num_columns))))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], out_type), pa.array([g[1] for g in got], pa.string())], names=["path", "text", "error"])

    return run


def _safe(f, *args):
    try:
        return f(*args), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:500]


def load(files: DataFrame) -> DataFrame:
    """files (path, content) of the binaryFile source to (path, text, error): a file that can't be read gets an
    error and doesn't end the run."""
    made = "path string, text string, error string"
    f = files.select("path", suffix_of(F.col("path")).alias("suffix"), "content")
    text = f.where(~F.col("suffix").isin([f".{b}" for b in BINARY])).select("path", "suffix", decoded(F.col("content")).alias("text"))
    none = F.lit(None).cast("string")
    html = text.where(F.col("suffix").isin(".html", ".htm")).select("path", "text").mapInArrow(_each(html_text), "path string, text string, error string")
    js = text.where(F.col("suffix").isin(".json", ".jsonl")).select("path", "text", (F.col("suffix") == ".jsonl").alias("l")).mapInArrow(_each(json_text), "path string, text string, error string")
    tables = text.where(F.col("suffix").isin(".csv", ".tsv")).select("path", "text", F.when(F.col("suffix") == ".tsv", "\t").otherwise(",").alias("sep")).mapInArrow(_each(csv_text), made)
    rest = text.where(~F.col("suffix").isin(".html", ".htm", ".json", ".jsonl", ".csv", ".tsv"))
    docx = f.where("suffix = '.docx'").select("path", "content").mapInArrow(_each(docx_text), made)
    pptx = f.where("suffix = '.pptx'").select("path", "content").mapInArrow(_each(pptx_text), made)
    codes = sorted({f".{e}" for v in LANGUAGES.values() for e in v.split()} - {".md", ".json"})
    body = F.when(F.col("suffix").isin(codes), code(plain(F.col("text")), F.col("path"))).otherwise(plain(F.col("text")))
    rest = rest.select("path", body.alias("text"), none.alias("error"))
    lost = f.where(F.col("suffix").isin([f".{b}" for b in BINARY if b not in ("docx", "pptx")])).select("path", none.alias("text"), F.concat(F.lit("no reader installed for "), F.col("suffix")).alias("error"))
    return reduce(DataFrame.unionByName, [rest, html, js, tables, docx, pptx, lost])
