"""From payloads, JSON files and tables to elements.

Several payloads at once have a key each (document) and their own rules. An element row has gi (its place in its payload; over
several payloads, their number times 2**31 is added), element_id, model_id, ifc_type, name, storey, discipline,
verts array<struct<x,y,z: double>> (float32 values), faces array<struct<i0,i1,i2: int>>, n_verts, n_faces, the box
over all vertices (vx0 .. vz1) and the box over the vertices that faces use (fx0 .. fz1).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import ELEMENT_WIRE, PAYLOAD, Rules

IDENTITY = ["gi", "element_id", "model_id", "ifc_type", "name", "storey", "discipline"]


def payload_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts of JSON payload files: document (the file's path) and json."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("json"))


def read_payload(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """JSON payload files ({elements, rules}), one document a file, with the file's path as document. Malformed JSON fails the read if strict; otherwise
    such files are left out (see unreadable)."""
    return payload_texts(payload_files(spark, path), strict)


_CORRUPT = "_corrupt"
_READ = T.StructType([*PAYLOAD.fields, T.StructField(_CORRUPT, T.StringType())])


def _parsed(texts: DataFrame) -> DataFrame:
    """document and p, the payload with the text of one that can't be read as _corrupt."""
    return texts.select("document", F.from_json("json", _READ, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("p"), "json")


def _unreadable() -> Column:
    """Why a document can't be used, or null."""
    shapeless = F.trim("json").rlike(r"^[^{]") | (F.trim("json") == "")
    return F.when(F.col("json").isNull(), "no text").when(F.col(f"p.{_CORRUPT}").isNotNull() | shapeless | F.col("p").isNull(), "not a JSON payload")


def payload_texts(texts: DataFrame, strict: bool = True) -> DataFrame:
    """Payloads of a frame (document string, unique; json string). Malformed JSON fails the query if strict; otherwise such documents, and those whose
    key is null or repeated, are left out (see unreadable)."""
    if strict:
        return texts.select("document", F.from_json("json", PAYLOAD, {"mode": "FAILFAST"}).alias("p")).select("document", "p.*")
    return _parsed(_unique(texts)).where(_unreadable().isNull()).select("document", *[f"p.{n}" for n in PAYLOAD.names])


def _unique(texts: DataFrame) -> DataFrame:
    """The documents with a key of their own."""
    alone = texts.where("document IS NOT NULL").groupBy("document").agg(F.count("*").alias("payloads")).where("payloads = 1").select("document")
    return texts.join(alone, "document", "left_semi")


def unreadable(texts: DataFrame) -> DataFrame:
    """The documents that payload_texts(strict=False) leaves out: document and fault. A repeated key is told once."""
    keys = texts.groupBy("document").agg(F.count("*").alias("payloads"))
    key_fault = F.when(F.col("document").isNull(), "no document key").when(F.col("payloads") > 1, "repeated document key")
    by_key = keys.select("document", key_fault.alias("fault")).where("fault IS NOT NULL")
    return by_key.unionByName(_parsed(_unique(texts)).select("document", _unreadable().alias("fault")).where("fault IS NOT NULL"))


def payload_frame(spark: SparkSession, payload: dict | str) -> DataFrame:
    """A one-row frame of a payload given as a dict or as JSON text."""
    text = payload if isinstance(payload, str) else json.dumps(payload)
    return spark.createDataFrame([(text,)], "json string").select(F.from_json("json", PAYLOAD, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def payload_rules(payloads: DataFrame) -> Rules:
    """The rules of a one-payload frame; more than one payload is refused."""
    rows = payloads.select("rules").take(2)
    if len(rows) > 1:
        raise ValueError("several payloads have rules of their own; see detect_documents")
    return Rules.of(rows[0]["rules"].asDict() if rows and rows[0]["rules"] else None)


def explode_elements(payloads: DataFrame) -> DataFrame:
    """Wire elements with their place gi; an absent or empty list gives no rows.

    Payloads with a key (document) are numbered in its order, so that gi is unique over all of them, and their elements keep it. Keys that are null or
    repeated fail the query, as elements of different payloads would be taken for one's.
    """
    if "document" not in payloads.columns:
        return payloads.select(F.posexplode("elements").alias("gi", "e")).select(F.col("gi").cast("long").alias("gi"), "e.*")
    # one small row for each payload, ranked by one task
    keys = payloads.groupBy("document").agg(F.count("*").alias("payloads")).withColumn("number", F.row_number().over(Window.orderBy("document")) - 1)
    keys = keys.select(F.col("document").alias("key"), "payloads", "number")
    rows = payloads.select("document", F.posexplode("elements").alias("at", "e")).join(keys, F.col("document").eqNullSafe(F.col("key")))
    faulty = F.col("document").isNull() | (F.col("payloads") > 1)
    refused = F.raise_error(F.concat(F.lit("null or repeated document key: "), F.coalesce("document", F.lit("null")))).cast("long")
    return rows.select("document", F.when(faulty, refused).otherwise(F.col("number").cast("long") * (1 << 31) + F.col("at")).alias("gi"), "e.*")


def wire_frame(spark: SparkSession, elements: list[dict]) -> DataFrame:
    """Wire elements given as dicts."""
    return explode_elements(payload_frame(spark, {"elements": elements}))


def _triples(flat: str, names: tuple[str, str, str], cast: str) -> Column:
    """A flat array as an array of structs; an empty one for no entries."""
    item = ", ".join(f"'{n}', CAST(get({flat}, 3 * k + {j}) AS {cast})" for j, n in enumerate(names))
    return F.expr(f"CASE WHEN size({flat}) >= 3 THEN transform(sequence(0, size({flat}) DIV 3 - 1), k -> named_struct({item})) ELSE array() END")


def _fault() -> Column:
    """Why an element can't be used, or null: ragged arrays, indices out of range, coordinates that aren't finite."""
    ragged = (F.size("vertices") % 3 != 0) | (F.size("indices") % 3 != 0)
    outside = F.expr("exists(indices, i -> i IS NULL OR i < 0 OR i >= size(vertices) DIV 3)")
    infinite = F.expr("exists(vertices, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")
    return F.when(ragged, "array length isn't a multiple of 3").when(infinite, "coordinate isn't finite").when(outside, "face index out of range")


def parse_elements(wire: DataFrame, strict: bool = True) -> DataFrame:
    """Elements of a wire frame (gi, id, modelId, ..., vertices, indices).

    Elements with fewer than 3 vertices or no face are dropped. Faulty elements (see quarantine) fail the query if strict,
    and are left out otherwise. Absent and null attributes take their defaults.
    """
    fault, enough = _fault(), (F.size("vertices") >= 9) & (F.size("indices") >= 3)
    refused = F.raise_error(F.concat(F.lit("element "), F.coalesce("id", F.lit("0")), F.lit(": "), fault)).cast("boolean") if strict else F.lit(False)
    # conditions on the wire's own columns only: pushed below the arrays of structs, others would make these anew for each entry
    w = wire.where((F.size("vertices") > 0) & (F.size("indices") > 0)).where(F.when(fault.isNotNull(), refused).otherwise(enough))
    default = {"element_id": ("id", "0"), "model_id": ("modelId", ""), "ifc_type": ("ifcType", ""), "name": ("name", ""), "storey": ("storey", ""), "discipline": ("discipline", "other")}
    named = w.select(
        *(["document"] if "document" in w.columns else []), "gi", *[F.coalesce(F.col(c), F.lit(d)).alias(n) for n, (c, d) in default.items()],
        _triples("vertices", ("x", "y", "z"), "DOUBLE").alias("verts"), _triples("indices", ("i0", "i1", "i2"), "INT").alias("faces"),
    )
    return with_boxes(named)


def quarantine(wire: DataFrame) -> DataFrame:
    """The faulty elements (gi, id, fault) that parse_elements(strict=False) leaves out."""
    return wire.where((F.size("vertices") > 0) & (F.size("indices") > 0)).withColumn("fault", _fault()).where("fault IS NOT NULL").select("gi", "id", "fault")


def with_boxes(elements: DataFrame) -> DataFrame:
    """Adds n_verts, n_faces and both boxes to rows with verts and faces, without a shuffle."""
    used = F.expr("transform(array_distinct(flatten(transform(faces, f -> array(f.i0, f.i1, f.i2)))), i -> get(verts, i))")
    e = elements.withColumn("n_verts", F.size("verts")).withColumn("n_faces", F.size("faces")).withColumn("_used", used)
    cols = {f"{box}{axis}{end}": F.expr(f"array_{'min' if end == '0' else 'max'}(transform({arr}, p -> p.{axis}))") for box, arr in (("v", "verts"), ("f", "_used")) for axis in "xyz" for end in "01"}
    return e.withColumns(cols).drop("_used")


def elements_table(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Elements of a Parquet table of wire elements with a gi column."""
    wire = spark.read.parquet(path)
    missing = [f for f in ELEMENT_WIRE.names if f not in wire.columns]
    return parse_elements(wire.withColumns({f: F.lit(None).cast(ELEMENT_WIRE[f].dataType) for f in missing}), strict)
