"""Word-processing packages as relations.

``shred`` is the one Python stage: it opens each package's ZIP under quotas, parses its XML parts
with document types refused, and gives parts, relationships and an ordered node tree.  What is
wrong with a package is a row too; one bad package never fails the job.  Everything after it is
DataFrame work (``paperloom.plans.packages``) over what ``shredded`` has written once: one table
with a folder for each kind of row, so a relation reads its own rows and columns only.

Entries are unpacked as streams and parsed piece by piece: a first pass over a package only checks
it, the second gives its rows in batches, an element when it closes.  So a task holds a package's
own bytes, one part for its row, the elements that are open, and a batch, whatever the package's size.

A node's name is ``w:p`` with a fixed prefix for its namespace, or the bare local name where the
namespace has none here (``type`` has it in full); attributes are named alike.  Beside its parent
a node names the nearest elements around it, itself included, so what stands inside of what is
an equal key in later joins and never a range.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from typing import IO
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import written

#: Admission limits: entries of a package, bytes of it unpacked, bytes of a part.
MAX_ENTRIES = 10_000
MAX_PACKAGE = 512 << 20
MAX_PART = 128 << 20

#: The formats' namespaces with their customary prefixes.
PREFIXES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://schemas.openxmlformats.org/drawingml/2006/picture": "pic",
    "http://schemas.microsoft.com/office/drawing/2016/SVG/main": "asvg",
    "http://schemas.microsoft.com/office/word/2010/wordml": "w14",
    "http://schemas.microsoft.com/office/word/2012/wordml": "w15",
    "http://schemas.microsoft.com/office/word/2016/wordml/cid": "w16cid",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
    "http://schemas.openxmlformats.org/package/2006/content-types": "ct",
}
#: The nearest element of a name around a node (or the node itself), by column.
AROUND = {"para_id": "w:p", "run_id": "w:r", "cell_id": "w:tc", "row_id": "w:tr", "table_id": "w:tbl", "control_id": "w:sdt", "math_id": "m:oMath", "comment_id": "w:comment", "link_id": "w:hyperlink", "drawing_id": "w:drawing", "del_id": "w:del"}

ROWS = "kind string, doc_id long, part string, name string, type string, target string, mode string, node_id int, end_id int, parent_id int, up string, sibling int, depth int, block_id int, top_row int, top_cell int, " + ", ".join(f"{c} int" for c in AROUND) + ", attrs map<string,string>, text string, in_ins boolean, in_del boolean, bytes binary"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_SCHEMA = pa.schema([(c.split(" ", 1)[0], _KINDS[c.split(" ", 1)[1]]) for c in ROWS.split(", ")])
#: The columns of an element's row, in the order in which ``Elements`` gives them.
_NODE = ["node_id", "end_id", "parent_id", "up", "sibling", "depth", "block_id", "top_row", "top_cell", *AROUND, "name", "type", "attrs", "text", "in_ins", "in_del"]
#: Bytes that are unpacked and parsed at once; rows of a batch, and bytes of parts in one.
PIECE = 1 << 16
BATCH = 10_000
BATCH_BYTES = 16 << 20


class Refused(Exception):
    """A package that is not admitted: a stable code and what was wrong."""


def safe_name(name: str) -> str:
    """The part name of a ZIP entry; refused where it could leave the package."""
    if not name or name.startswith("/") or "\\" in name or ":" in name or any(p in ("", ".", "..") for p in name.rstrip("/").split("/")):
        raise Refused(f"E0003 unsafe entry name {name!r}")
    return "/" + name


def resolve(source: str, target: str) -> str:
    """An internal relationship's target as a part name; refused above the root."""
    if target.startswith("/"):
        path = posixpath.normpath(target)
    else:
        base = posixpath.dirname(source).strip("/").split("/") if posixpath.dirname(source).strip("/") else []
        for piece in target.split("/"):
            if piece == "..":
                if not base:
                    raise Refused(f"E0005 target {target!r} leaves the package")
                base.pop()
            elif piece not in ("", "."):
                base.append(piece)
        path = "/" + "/".join(base)
    return path


class Elements:
    """A parser that is fed pieces of a part and keeps the rows (``_NODE``) of elements that have closed in ``closed``."""

    def __init__(self, keep: bool = True):
        self.closed: list[tuple] = []
        self._count, self._keep = 0, keep
        self._open: list[list] = []
        self._parser = p = expat.ParserCreate(namespace_separator="}")
        p.buffer_text = True
        p.StartDoctypeDeclHandler = self._refuse
        if keep:
            p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._text

    def feed(self, piece: bytes, last: bool = False) -> None:
        self._parser.Parse(piece, last)

    @staticmethod
    def _refuse(*_: object) -> None:
        raise Refused("E0006 document type declaration")

    @staticmethod
    def _short(qualified: str) -> tuple[str, str]:
        ns, _, local = qualified.rpartition("}")
        return f"{PREFIXES[ns]}:{local}" if ns in PREFIXES else local, ns

    def _start(self, qualified: str, attrs: dict) -> None:
        name, space = self._short(qualified)
        k, up = self._count, self._open[-1] if self._open else None
        self._count += 1
        # An open element: number, name, space, attributes, text, children, what it holds, in_ins, in_del, block, row, cell, around.
        if up is None:
            ins, gone, block, row, cell, sibling = False, False, None, None, None, 0
        else:
            up[5] += 1
            ins, gone, sibling = up[7] or up[1] in ("w:ins", "w:moveTo"), up[8] or up[1] in ("w:del", "w:moveFrom"), up[5]
            block, row, cell = up[9:12]
            if name in ("w:p", "w:tbl", "w:sectPr") and up[6]:
                block = k
            elif name == "w:tr" and up[1] == "w:tbl" and up[9] == up[0]:
                row = k
            elif name == "w:tc" and up[1] == "w:tr" and up[10] == up[0]:
                cell = k
        around = [k if name == wanted else near for wanted, near in zip(AROUND.values(), up[12] if up else [None] * len(AROUND), strict=True)]
        # What holds a story's blocks: the body, the root of another part, and revisions right inside of these.
        holds = name == "w:body" or up is None and name != "w:document" or bool(up and up[6] == 1 and name in ("w:ins", "w:del", "w:moveFrom", "w:moveTo")) * 2
        own = {self._short(a)[0]: v for a, v in attrs.items()}
        self._open.append([k, name, space, own, [], 0, holds, ins, gone, block, row, cell, around, sibling])

    def _end(self, _: str) -> None:
        k, name, space, attrs, text, _, _, ins, gone, block, row, cell, around, sibling = self._open.pop()
        up = self._open[-1] if self._open else None
        self.closed.append((k, self._count - 1, up and up[0], up and up[1], sibling, len(self._open), block, row, cell, *around, name, space, attrs, "".join(text), ins, gone))

    def _text(self, data: str) -> None:
        if self._open:
            self._open[-1][4].append(data)


def parse(data: bytes) -> list[dict]:
    """The elements of a part in document order, each with its interval of node ids; text nodes are elements' ``text``."""
    elements = Elements()
    elements.feed(data, True)
    return [dict(zip(_NODE, n, strict=True)) for n in sorted(elements.closed, key=lambda n: n[0])]


def streamed(f: IO[bytes], most: int, keep: bool = True) -> Iterator[list[tuple]]:
    """The rows of a part's elements, in lists, as they close; refused where the part is not as long as ``most`` bytes."""
    elements, size = Elements(keep), 0
    while piece := f.read(PIECE):
        size += len(piece)
        if size > most:
            break
        elements.feed(piece)
        if elements.closed:
            yield elements.closed
            elements.closed = []
    if size != most:
        raise Refused(f"E0002 size of {getattr(f, 'name', '')!r} differs from its declaration")
    elements.feed(b"", True)
    yield elements.closed


def _whole(z: zipfile.ZipFile, e: zipfile.ZipInfo, name: str) -> bytes:
    with z.open(e) as f:
        data = f.read(e.file_size + 1)
    if len(data) != e.file_size:
        raise Refused(f"E0002 size of {name!r} differs from its declaration")
    return data


def _relationships(source: str, data: bytes) -> Iterator[dict]:
    for n in parse(data):
        if n["name"] == "rel:Relationship":
            a = n["attrs"]
            mode = a.get("TargetMode", "Internal")
            yield {"kind": "rel", "part": source, "name": a.get("Id"), "type": a.get("Type", "").rpartition("/")[2], "target": a.get("Target") if mode == "External" else resolve(source, a.get("Target", "")), "mode": mode}


def _contents(z: zipfile.ZipFile) -> list[tuple[str, str | None, str, zipfile.ZipInfo]]:
    """``(part, content type, kind, entry)`` of a package's entries by name; refused where names or sizes are."""
    entries = [e for e in z.infolist() if not e.is_dir()]
    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_PACKAGE or any(e.file_size > MAX_PART for e in entries):
        raise Refused("E0002 package exceeds its quota")
    named: dict[str, zipfile.ZipInfo] = {}
    lowered: set[str] = set()
    for e in entries:
        name = safe_name(e.filename)
        if name.lower() in lowered:
            raise Refused(f"E0004 duplicate entry {name!r}")
        lowered.add(name.lower())
        named[name] = e
    types: dict[str, str] = {}
    if "/[Content_Types].xml" in named:
        for n in parse(_whole(z, named["/[Content_Types].xml"], "/[Content_Types].xml")):
            types[n["attrs"].get("PartName") or "." + n["attrs"].get("Extension", "").lower()] = n["attrs"].get("ContentType", "")
    out = []
    for name, e in sorted(named.items()):
        type_ = types.get(name) or types.get("." + name.rpartition(".")[2].lower())
        kind = "rel" if name.endswith(".rels") else "node" if (type_ or "").endswith("+xml") or name.endswith(".xml") and name != "/[Content_Types].xml" else "other"
        out.append((name, type_, kind, e))
    return out


def package_rows(doc_id: int | None, content: bytes) -> Iterator[dict]:
    """All rows of a package, as dictionaries; a refused one gives its diagnostic alone."""
    for batch in package_batches(doc_id, content):
        yield from batch.to_pylist(maps_as_pydicts="strict")


def package_batches(doc_id: int | None, content: bytes, keep: Callable[[str], bool] = lambda kind: True) -> Iterator[pa.RecordBatch]:
    """The rows of a package in batches; those of kinds that ``keep`` leaves out are neither made nor unpacked a second time."""

    def batch(columns: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns = {"doc_id": [doc_id] * n, **columns}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_SCHEMA.names, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    def rows(of: list[dict]) -> pa.RecordBatch:
        return batch({c: [r.get(c) for r in of] for c in {c for r in of for c in r}})

    def source_of(name: str) -> str:
        folder, _, leaf = name.rpartition("/_rels/")
        return f"{folder}/{leaf[:-5]}" if leaf != ".rels" else "/"

    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        contents = _contents(z)
        for name, _, kind, e in contents:  # nothing is given before all of it is known to be sound
            if kind == "rel":
                list(_relationships(source_of(name), _whole(z, e, name)))
            else:
                with z.open(e) as f:
                    if kind == "node":
                        for _ in streamed(f, e.file_size, False):
                            pass
                    elif sum(len(x) for x in iter(lambda f=f: f.read(PIECE), b"")) != e.file_size:
                        raise Refused(f"E0002 size of {name!r} differs from its declaration")
    except Refused as e:
        yield rows([{"kind": "diag", "name": str(e).split()[0], "text": str(e)}])
        return
    except Exception as e:  # whatever a damaged package makes the readers raise is said about that package
        yield rows([{"kind": "diag", "name": "E0001", "text": f"{type(e).__name__}: {e}"}])
        return
    few: list[dict] = []
    held = 0
    for name, type_, kind, e in contents:
        if keep("part"):
            few.append({"kind": "part", "part": name, "name": name[1:], "type": type_, "bytes": _whole(z, e, name)})
            held += e.file_size
        if kind == "rel" and keep("rel"):
            few += _relationships(source_of(name), _whole(z, e, name))
        if len(few) >= BATCH or held >= BATCH_BYTES:
            yield rows(few)
            few, held = [], 0
    if few:
        yield rows(few)
    for name, _, kind, e in contents:
        if kind == "node" and keep("node"):
            waiting: list[tuple] = []
            with z.open(e) as f:
                for closed in streamed(f, e.file_size):
                    waiting += closed
                    while len(waiting) >= BATCH:
                        part, waiting = waiting[:BATCH], waiting[BATCH:]
                        yield _node_batch(doc_id, name, part)
            if waiting:
                yield _node_batch(doc_id, name, waiting)


def _node_batch(doc_id: int | None, part: str, closed: list[tuple]) -> pa.RecordBatch:
    columns = dict(zip(_NODE, zip(*closed, strict=True), strict=True))
    columns["attrs"] = [list(a.items()) for a in columns["attrs"]]
    n, same = len(closed), {"kind": "node", "doc_id": doc_id, "part": part}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.array([same[c]] * n, k) if c in same else pa.nulls(n, k) for c, k in zip(_SCHEMA.names, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def shred(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``doc_id, content`` of packages to rows of parts, relationships, nodes and diagnostics (or of ``kinds`` and diagnostics alone).

    Null content, and bytes that are no package or a damaged, encrypted or too large one, give a
    diagnostic alone; a null id stays null, repeated rows are shredded each, and an empty table
    gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from package_batches(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b"", lambda kind: kinds is None or kind in kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ROWS)


def shredded(docs: DataFrame) -> DataFrame:
    """What ``shred`` gives, written once to the shared folder; every relation then starts from Parquet and no package is opened again."""
    return written(shred(docs), "shredded", partition_by="kind")


def read_packages(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """``doc_id, path, content`` of the packages below ``path``; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def save(parts: DataFrame) -> DataFrame:
    """``doc_id, content``: packages put together again from ``doc_id, name, bytes``, entries in the order of their names."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(rows["name"], rows["bytes"], strict=True)):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(data), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"doc_id": [key[0]], "content": [out.getvalue()]})

    return parts.select("doc_id", "name", "bytes").groupBy("doc_id").applyInPandas(pack, "doc_id long, content binary")
