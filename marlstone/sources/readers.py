"""Sources: decision graphs, chains, references, manifests, run folders, spreadsheets. Lines keep an explicit ordinal."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.functions.text import first_filled
from marlstone.operators.resolve import last_wins

NODE = """id string, label string, question string, description string, tier string, node_kind string, interaction string,
 spatial_policy string, options array<string>, edges map<string,string>, zoom_level string, retrieval_level string, visual_policy string,
 requires_visual_evidence boolean, is_leaf boolean, root boolean"""
_STEP = "array<struct<node_id:string,question:string,q:string,answer:string,a:string,next_question:string>>"
CHAIN = f"slide_id string, case_key string, split string, extraction_status string, error string, report string, final_report string, node_path array<string>, `chain-of-thought` {_STEP}, qa_chain {_STEP}, chains {_STEP}"
REFERENCE = "id string, title string, text string, source string, source_type string, topic string, graph_nodes array<string>, tier string"
MANIFEST = "case_id string, slide_ids string, case_class string, disease_label string, split string, n_slides int"


def json_lines(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    """Rows with ``file``, ``line`` (an order inside a file) and ``corrupt``; blank lines are no rows."""
    text = spark.read.option("recursiveFileLookup", recursive).text(path).withColumns({"file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()})
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return text.where(F.trim("value") != "").withColumn("_r", parsed).select("_r.*", "file", "line").withColumnRenamed("_corrupt", "corrupt")


def _zoom_default(tier: Column, kind: Column) -> Column:
    return F.when((tier == "global_features") | (kind == "global"), "5x").when(kind == "compartment", "10x").when(kind.isin("local", "integration", "report"), "20x").otherwise("10x")


def _policy_default(kind: Column) -> Column:
    return F.when(kind.isin("global", "compartment"), "thumbnail_only").when(kind.isin("integration", "report"), "both").otherwise("patch_retrieve")


def graph_nodes(raw: DataFrame) -> DataFrame:
    """Defaults for zoom (explicit, legacy level, by kind) and visual policy; the last row marked root is the root."""
    legacy = F.create_map(*[F.lit(x) for kv in {"low": "5x", "medium": "10x", "high": "20x", "ultra": "40x"}.items() for x in kv])
    tier = F.coalesce("tier", F.lit("global_features"))
    return raw.withColumns({"tier": tier, "zoom_level": F.coalesce(F.nullif("zoom_level", F.lit("")), F.try_element_at(legacy, F.lower("retrieval_level")), _zoom_default(tier, F.col("node_kind"))), "visual_policy": F.coalesce(F.nullif("visual_policy", F.lit("")), _policy_default(F.col("node_kind"))), "retrieval_text": F.concat_ws(" ", F.nullif("question", F.lit("")), F.nullif("description", F.lit("")))})


def graph_root(nodes: DataFrame) -> str:
    row = nodes.agg(F.max_by("id", F.when(F.col("root"), F.col("line"))).alias("marked"), F.min_by("id", "line").alias("first")).first()
    if row.first is None:
        raise ValueError("the graph has no nodes")
    return row.marked or row.first


def graph_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.explode("edges").alias("answer", "dst"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    nodes = graph_nodes(json_lines(spark, path, NODE))
    return nodes, graph_edges(nodes), graph_root(nodes)


def eval_records(raw: DataFrame) -> DataFrame:
    """Chains under any of their names as (slide_id, split, report, node_path, chain); of equal keys the last line."""
    chain = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in ("`chain-of-thought`", "qa_chain", "chains")], F.array().cast(_STEP))
    steps = F.transform(chain, lambda s: F.struct(F.coalesce(s["node_id"], F.lit("")).alias("node_id"), F.coalesce(first_filled(s["question"], s["q"]), F.lit("")).alias("question"), F.coalesce(first_filled(s["answer"], s["a"]), F.lit("")).alias("answer"), F.coalesce(s["next_question"], F.lit("")).alias("next_question")))
    r = raw.select("*", steps.alias("chain"))
    ids = F.filter(F.transform("chain", lambda s: s["node_id"]), lambda x: x != "")
    r = r.select(F.coalesce(first_filled(F.col("slide_id"), F.col("case_key")), F.col("line").cast("string")).alias("slide_id"), "split", F.coalesce("extraction_status", F.lit("ok")).alias("status"), F.coalesce(first_filled(F.col("report"), F.col("final_report")), F.lit("")).alias("report"), F.when(F.size(ids) > 0, ids).otherwise(F.coalesce("node_path", F.array().cast("array<string>"))).alias("node_path"), "chain", "line")
    return last_wins(r, ["slide_id"], "line")


def cases(records: DataFrame, split: str | None = None) -> DataFrame:
    """Usable cases: status ok, a key, of a split if one is given; the key's parts as slides."""
    ok = records.where((F.col("status") == "ok") & (F.trim("slide_id") != ""))
    ok = ok if split is None else ok.where(F.col("split") == split)
    return ok.select(F.col("slide_id").alias("case_key"), F.filter(F.transform(F.split("slide_id", ","), lambda s: F.trim(s)), lambda s: s != "").alias("slides"), "split")


def split_is(column: str, split: str, missing_counts: bool = False) -> Column:
    same = F.col(column) == split
    return same | (F.coalesce(column, F.lit("")) == "") if missing_counts else same


def references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Reference chunks of all JSON-lines files below a folder, and what is wrong with them (file, line, problem)."""
    raw = json_lines(spark, folder, REFERENCE, recursive=True).where(F.col("file").endswith(".jsonl"))
    problem = F.when(F.col("corrupt").isNotNull(), "not json")
    for k in ("id", "title", "text", "source", "source_type", "topic", "graph_nodes"):
        problem = problem.when(F.col(k).isNull(), f"missing {k}")
    problem = problem.when(F.col("source_type") != "reference", "source_type").when(F.trim("text") == "", "empty text")
    r = raw.withColumn("problem", problem)
    return r.where("problem is null").drop("problem", "corrupt"), r.where("problem is not null").select("file", "line", "problem")


def strict(good: DataFrame, bad: DataFrame) -> DataFrame:
    first = bad.orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first.file}:{first.line}: {first.problem}")
    return good


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MANIFEST).csv(path).withColumn("slides", F.filter(F.transform(F.split("slide_ids", ","), lambda s: F.trim(s)), lambda s: s != ""))


def run_folders(spark: SparkSession, root: str, name: str = "cot_chain.json") -> DataFrame:
    """One JSON document a run; the folder's name is the key. Broken files are left out."""
    raw = spark.read.option("multiLine", True).schema(CHAIN + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/{name}")
    return raw.where("_corrupt is null").withColumn("slide_id", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)).withColumn("line", F.monotonically_increasing_id()).drop("_corrupt")


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Binary files with base name and stem (slides, thumbnails, tiles)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return b.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "content")


class Spreadsheet(DataSource):
    """First sheet of an xlsx file as strings: format ``spreadsheet``, option path; the first row names the columns."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> str:
        head = next(_sheet(self.options["path"]), [])
        return ", ".join(f"`{h}` string" for h in head)

    def reader(self, schema):
        return _SheetReader(self.options["path"], len(schema))


class _SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        rows = _sheet(self.path)
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * self.width)[: self.width])


def _sheet(path: str) -> Iterator[list]:
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        for row in ET.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{ns}row"):
            out: list = []
            for cell in row.iter(f"{ns}c"):
                col = 0
                for ch in re.match(r"[A-Z]+", cell.get("r", "A1")).group(0):
                    col = col * 26 + ord(ch) - 64
                v = cell.find(f"{ns}v")
                text = "".join(t.text or "" for t in cell.iter(f"{ns}t")) if cell.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if cell.get("t") == "s" else v.text
                out += [None] * (col - len(out))
                out[col - 1] = text
            yield out


def data_url(content: Column, name: Column) -> Column:
    mime = F.when(F.lower(name).endswith(".png"), "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
