"""SVG documents as rows: reading files, and the XML of each document as nested columns.

XML is the one step that needs Python, as built-in XPath functions fail a job on malformed
input. It is one Arrow map: text in, elements out; a document that doesn't parse gets an error
instead of stopping the job. Numbers follow Python's float().
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.sqlgen import let, lit

#: Containers whose content is not drawn, and style attributes that are kept.
UNDRAWN = {"defs", "clipPath", "mask", "symbol", "marker", "pattern", "filter", "style", "metadata", "title", "desc"}
STYLES = ("fill", "stroke", "stroke-width", "opacity", "fill-opacity", "stroke-opacity", "style", "class")
DRAWN = ("path", "circle", "rect", "ellipse", "line", "polygon", "polyline")
MAX_BYTES = 256 * 1024
#: Fixed values, in this order: what a document may not contain, and why.
UNSUPPORTED = {
    "<filter": "filter effects", "fegaussianblur": "filter effects", "<image": "raster image embed", "<text": "text element", "<tspan": "text element",
    "<lineargradient": "gradient fill", "<radialgradient": "gradient fill", "<pattern": "pattern fill", "<use": "symbol/use reference",
    "<foreignobject": "foreignObject", "<animate": "SMIL animation", "<animatetransform": "SMIL animation", "<set ": "SMIL animation",
}

#: Blocks that say something about a drawing and aren't drawn.
NOTES = ("desc", "title", "metadata")
COMMENT, BLOCK = r"(?s)<!--.*?-->", r"(?is)<TAG\b[^>]*>.*?</TAG>"

ELEMENT = "struct<tag:string,id:string,gid:string,attributes:map<string,string>,d:string,v:array<double>,transforms:array<string>,transform:string>"
PARSED = f"struct<width:double,height:double,viewbox:array<double>,elements:array<{ELEMENT}>,error:string>"


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """path and svg of every file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("svg"))


def write_svg(df: DataFrame, path: str, key: str | None = None) -> None:
    """One text record per document, in files of a folder; with a key that tells documents apart, a file for each in a folder of its key."""
    if key:
        df.select(key, "svg").write.mode("overwrite").partitionBy(key).text(path)
    else:
        df.select("svg").write.mode("overwrite").text(path)


def _numbers(node: ET.Element, tag: str) -> list[float]:
    get = lambda name, otherwise=0.0: float(node.get(name, otherwise))
    if tag == "circle":
        return [get("cx"), get("cy"), get("r")]
    if tag == "ellipse":
        return [get("cx"), get("cy"), get("rx"), get("ry")]
    if tag == "line":
        return [get("x1"), get("y1"), get("x2"), get("y2")]
    if tag == "rect":
        return [get("x"), get("y"), get("width"), get("height"), get("rx"), get("ry", get("rx"))]
    if tag in ("polygon", "polyline"):
        return [float(n) for n in re.findall(r"[+-]?[\d.]+", node.get("points", ""))]
    return []


def _length(text: str | None, otherwise: float) -> float:
    if not text:
        return otherwise
    m = re.match(r"[+-]?[\d.]+", text)
    return float(m[0]) if m else 0.0


def parse_xml(text: str) -> dict:
    """A document as PARSED; raises what the XML parser or float() raises."""
    if "xmlns" in text:
        text = re.sub(r'\sxmlns:xlink="[^"]*"', "", re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    root, elements = ET.fromstring(text), []
    box = re.split(r"[\s,]+", root.get("viewBox").strip()) if root.get("viewBox") else []
    todo = [(root, None, [])]
    while todo:  # in document order
        node, gid, outer = todo.pop()
        tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if tag in UNDRAWN:
            continue
        if tag == "g":
            gid, outer = node.get("id", gid), [*outer, node.get("transform")]
        elif tag in DRAWN:
            numbers = _numbers(node, tag)
            own = dict(zip(("cx", "cy", "r"), map(str, numbers), strict=False)) if tag == "circle" else {}
            attributes = own | {k: node.get(k) for k in STYLES if node.get(k)}
            elements.append({"tag": tag, "id": node.get("id"), "gid": gid, "attributes": attributes, "d": node.get("d", ""), "v": numbers, "transforms": [*outer, node.get("transform")], "transform": node.get("transform")})
        todo += [(child, gid, outer) for child in reversed(node)]
    return {"width": _length(root.get("width"), 300.0), "height": _length(root.get("height"), 300.0), "viewbox": [float(p) for p in box] if len(box) == 4 else None, "elements": elements, "error": None}


#: Fields of ELEMENT that are lists or maps, the others are text.
_NESTED = {"attributes": pa.map_(pa.string(), pa.string()), "v": pa.list_(pa.float64()), "transforms": pa.list_(pa.string())}
_FIELDS = ("tag", "id", "gid", "attributes", "d", "v", "transforms", "transform")


def _documents(svgs: pa.Array) -> pa.Array:
    """PARSED of each text, made field by field: Arrow takes rows of nested dicts apart at several times the cost."""
    fields: dict[str, list] = {name: [] for name in _FIELDS}
    widths, heights, boxes, errors, gone = [], [], [], [], []
    starts: list[int | None] = []  # null where there are no elements
    for text in svgs.to_pylist():
        row = {"width": None, "height": None, "viewbox": None, "elements": None, "error": None}
        if text is not None:
            try:
                row = parse_xml(text)
            except Exception as e:  # whatever is wrong with one document is its own error
                row["error"] = f"failed to parse SVG: {e}"
        gone.append(text is None)
        starts.append(None if row["elements"] is None else len(fields["tag"]))
        for element in row["elements"] or ():
            for name, values in fields.items():
                values.append(element[name])
        widths.append(row["width"])
        heights.append(row["height"])
        boxes.append(row["viewbox"])
        errors.append(row["error"])
    fields["attributes"] = [list(a.items()) for a in fields["attributes"]]
    element = pa.StructArray.from_arrays([pa.array(v, _NESTED.get(name, pa.string())) for name, v in fields.items()], names=list(fields))
    elements = pa.ListArray.from_arrays(pa.array([*starts, len(element)], pa.int32()), element)
    columns = [pa.array(widths, pa.float64()), pa.array(heights, pa.float64()), pa.array(boxes, pa.list_(pa.float64())), elements, pa.array(errors, pa.string())]
    return pa.StructArray.from_arrays(columns, names=["width", "height", "viewbox", "elements", "error"], mask=pa.array(gone, pa.bool_()))


def parse(df: DataFrame, **texts: str) -> DataFrame:
    """df with new columns of PARSED from columns of documents, in one step: doc from svg, if none is named; null for null.

    A map of whole rows and not a function of a column: Catalyst would join the expressions
    before it with those after it into one, whose nested lambdas it can't compile.
    """
    texts = texts or {"doc": "svg"}
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_documents(batch.column(column)) for column in texts.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *texts])

    return df.mapInArrow(run, kinds + "".join(f", {name} {PARSED}" for name in texts))


def without_notes(svg: str) -> str:
    """SQL: svg without comments, and then without the blocks of NOTES, one kind after another."""
    out = f"regexp_replace({svg}, {lit(COMMENT)}, '')"
    for tag in NOTES:
        out = f"regexp_replace({out}, {lit(BLOCK.replace('TAG', tag))}, '')"
    # Few texts have any, and looking for them is cheaper than four replacements.
    held = " OR ".join(f"contains(low_, '<{tag}')" for tag in ("!--", *NOTES))
    return f"IF({let({'low_': f'lower({svg})'}, held, 'boolean')}, {out}, {svg})"


def unsupported(svg: str) -> str:
    """SQL: why svg is refused, or null."""
    cases = " ".join(f"WHEN contains(low, {lit(k)}) THEN {lit(v)}" for k, v in UNSUPPORTED.items())
    return f"element_at(transform(array(lower({without_notes(svg)})), low -> CASE {cases} END), 1)"


def guard(svg: str, check_size: bool = True) -> str:
    """SQL: STRUCT<code, message> of what refuses svg before parsing, or null."""
    why = let({"why": unsupported(svg)}, "IF(why IS NULL, NULL, named_struct('code', 'PARSE_UNSUPPORTED_ELEMENT', 'message', concat('<', why, '> not tokenizable')))", "struct<code:string,message:string>")
    return f"IF(octet_length({svg}) > {MAX_BYTES}, named_struct('code', 'PAYLOAD_TOO_LARGE', 'message', 'svg exceeds {MAX_BYTES} bytes'), {why})" if check_size else why


def canvas_size(doc: str = "doc") -> str:
    """SQL: width and height of a document: of its view box, else its own."""
    return f"IF({doc}.viewbox IS NOT NULL, named_struct('w', {doc}.viewbox[2], 'h', {doc}.viewbox[3]), named_struct('w', {doc}.width, 'h', {doc}.height))"


__all__ = ["MAX_BYTES", "canvas_size", "guard", "ids", "parse", "parse_xml", "read_svg", "unsupported", "without_notes", "write_svg"]
