"""Sources: parquet tables, embedding batches, query matrices, ontology documents and classes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError, OntologyError
from ..schemas import embedding_file
from .shared import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database; numbers of partitions and bounds come as reader options."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def embedding_batches(spark: SparkSession, paths: str | list[str], dimension: int, *, id_name: str = "id") -> DataFrame:
    """Headerless CSV files, plain or gzipped: id and embedding. The schema follows from the dimension and is never inferred; a row that does not fit it is an error."""
    rows = spark.read.schema(embedding_file(dimension)).option("header", "false").option("mode", "FAILFAST").csv(paths)
    return rows.select(F.col("_c0").alias(id_name), F.array(*(F.col(f"_c{i}") for i in range(1, dimension + 1))).alias("embedding"))


def numbered_batches(spark: SparkSession, prefix: str, total: int, dimension: int) -> DataFrame:
    """batch, id and embedding of the files batch_0.csv.gz to batch_(total - 1).csv.gz; a file that is missing is an error."""
    paths = [f"{prefix.rstrip('/')}/batch_{i}.csv.gz" for i in range(total)]
    rows = spark.read.schema(embedding_file(dimension)).option("header", "false").option("mode", "FAILFAST").csv(paths)
    batch = F.regexp_extract("_metadata.file_name", r"batch_(\d+)\.csv\.gz$", 1).cast("int")
    return rows.select(batch.alias("batch"), F.col("_c0").alias("id"), F.array(*(F.col(f"_c{i}") for i in range(1, dimension + 1))).alias("embedding"))


def quarantined_batches(spark: SparkSession, paths: str | list[str], dimension: int, *, id_name: str = "id") -> tuple[DataFrame, DataFrame]:
    """Headerless CSV files in one scan: rows (file, id, embedding), and as a table of their own the lines that are none: file, line (from 1), value, reason.

    A line is bad if it does not parse as an id and `dimension` numbers, or holds no id or an empty component; blank lines are left out. What
    is parsed is staged, good and bad apart; files are read once, split or not: a line's number is its place in its block of the file, and
    the lines of the blocks before it.
    """
    fields = embedding_file(dimension)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", _bad string"
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    parsed = lines.withColumn("r", F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    embedding = F.array(*(F.col(f"r._c{i}") for i in range(1, dimension + 1)))
    reason = (
        F.when(F.trim("value") == "", "blank")
        .when(F.size(F.split("value", ",", -1)) != dimension + 1, F.concat((F.size(F.split("value", ",", -1)) - 1).cast("string"), F.lit(f" components of {dimension}")))
        .when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not a number")
        .when(F.col("r._c0").isNull(), "no id")
        .when(F.exists(embedding, lambda x: x.isNull()), "an empty component")
    )
    told = parsed.select("file", "block", "turn", F.col("r._c0").alias(id_name), embedding.alias("embedding"), reason.alias("reason"), "value")
    good = F.col("reason").isNull()
    both = staged(told.select("file", "block", "turn", *(F.when(good, F.col(c)).alias(c) for c in (id_name, "embedding")), "reason", F.when(~good, F.col("value")).alias("value")), "batches")
    # One row a block of a file; the lines of the blocks before it are a running sum.
    blocks = both.groupBy("file", "block").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bad = both.filter("reason <> 'blank'").join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("turn") - F.col("first") + 1).alias("line"), "value", "reason")
    return both.filter("reason is null").select("file", id_name, "embedding"), bad


OWL_CLASS = "ord bigint, name string, labels array<string>, parents array<string>"


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, labels and named parents of the classes of an OWL file in RDF/XML, in order of the file. A name is what follows the last / or # of an IRI.

    A document is one task's, and streamed: it grows with an ontology and not with the data. Anonymous classes and restrictions are left out.
    """

    def run(batches):
        import io
        import xml.etree.ElementTree as ET

        rdf, rdfs, owl = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}", "{http://www.w3.org/2002/07/owl#}"
        name = lambda iri: iri.replace("#", "/").rsplit("/", 1)[-1]
        for b in batches:
            for content in b.column("content"):
                out, depth = [], 0
                for event, x in ET.iterparse(io.BytesIO(content.as_py()), events=("start", "end")):
                    depth += 1 if event == "start" else -1
                    if event == "end" and depth == 1:
                        if x.tag == f"{owl}Class" and (iri := x.get(f"{rdf}about")):
                            labels = [t.text or "" for t in x.findall(f"{rdfs}label")]
                            parents = [name(p) for t in x.findall(f"{rdfs}subClassOf") if (p := t.get(f"{rdf}resource"))]
                            out.append((len(out), name(iri), labels, parents))
                        x.clear()
                if out:
                    kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["ord", "name", "labels", "parents"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, OWL_CLASS)


def checked_matrix(df: DataFrame) -> DataFrame:
    """A query matrix whose x and total_mrna_umis are float32, as models want them."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if "x" not in kinds or not isinstance(kinds["x"], T.ArrayType) or not isinstance(kinds["x"].elementType, T.FloatType):
        raise InputError("x must be an array of float")
    if not isinstance(kinds.get("total_mrna_umis"), T.FloatType):
        raise InputError("total_mrna_umis must be a float column")
    return df


def densified(coordinates: DataFrame, width: int, *, id_col: str = "query_cell_id") -> DataFrame:
    """Rows of (id, feature_index, value) as one array of `width` for each id; absent features are 0."""
    held = coordinates.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("feature_index", "value"))).alias("held"))
    return held.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("held")[i], F.lit(0.0).cast("float"))).alias("x"))


RESOURCE = "ancestors_dictionary map<string,array<string>>, cell_ontology_term_id_to_cell_type map<string,string>, children_dictionary map<string,array<string>>, shortest_path_lengths_from_cell_root map<string,int>, longest_path_lengths_from_cell_root map<string,int>"
REQUIRED = ("ancestors_dictionary", "cell_ontology_term_id_to_cell_type")


def ontology_resource(spark: SparkSession, path: str) -> DataFrame:
    """One row: the document of an ontology; the first two fields are required."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", RESOURCE).alias("d")).select("d.*")
    missing = doc.select(*(F.col(c).isNull().alias(c) for c in REQUIRED)).first()
    if missing is None or any(missing):
        raise OntologyError(f"the document must have {' and '.join(REQUIRED)}")
    return doc


def resource_terms(doc: DataFrame) -> DataFrame:
    """ord, term, name; the order is that of the ancestors' keys. A term without a name is an error."""
    keys = doc.select(F.posexplode(F.map_keys("ancestors_dictionary")).alias("ord", "term"))
    names = doc.select(F.explode("cell_ontology_term_id_to_cell_type").alias("term", "name"))  # a map that goes along with each term, and is searched for it, would cost the square of the terms
    terms = keys.join(names, "term", "left").select("ord", "term", "name")
    if not terms.filter("name is null").isEmpty():
        raise OntologyError("a term has no name")
    return terms


def resource_closure(doc: DataFrame) -> DataFrame:
    """term, ancestor, as the document lists them; an ancestor that is no term is an error."""
    pairs = doc.select(F.explode("ancestors_dictionary").alias("term", "ancestors")).select("term", F.explode("ancestors").alias("ancestor"))
    if not pairs.join(doc.select(F.explode(F.map_keys("ancestors_dictionary")).alias("known")), F.col("ancestor") == F.col("known"), "left_anti").isEmpty():
        raise OntologyError("an ancestor is no term")
    return pairs.distinct()


def ontology_id(name) -> F.col:
    """The first `CL_` of a class name, wherever it stands, as `CL:`."""
    c = F.col(name) if isinstance(name, str) else name
    at = F.instr(c, "CL_")
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit("CL:"), F.substring(c, at + 3, F.length(c)))).otherwise(c)


def ontology_classes(classes: DataFrame) -> DataFrame:
    """term and label of classes (ord, name, labels array) named CL_... with exactly one label; of equal ids the first counts."""
    kept = classes.filter(F.col("name").startswith("CL_") & (F.size("labels") == 1)).select("ord", ontology_id("name").alias("term"), F.col("labels")[0].alias("label"))
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("ord"))).filter("n = 1").select("term", "label")
