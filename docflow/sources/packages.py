"""Corpora of office files as tables: files, parts of packages, XML nodes, relationships.

Only two steps are Python, each over Arrow batches: unpacking a file into its parts and
cutting a part's XML into numbered nodes. A node's pre is its place in document order,
post the last pre below it, anc the pres from the root to its parent and path their local names
with slashes between; so what a node stands in is known from its own row, without a join.
"""

from __future__ import annotations

import fnmatch
import io
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.functions import strings as S

MIMES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "odt": "application/vnd.oasis.opendocument.text",
}
NODES = "doc_id string, part string, pre int, post int, parent int, depth int, kind string, name string, ns string, qname string, attrs map<string,string>, text string, anc array<int>, path string"
COLUMNS = [column.split(" ")[0] for column in NODES.split(", ")]
PARTS = "doc_id string, entry_seq int, part string, ext string, content binary"
_formats: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extension(name: Column, missing: str = "") -> Column:
    return F.lower(S.after_last(name, ".", F.lit(missing)))


def infer_mime(name: Column) -> Column:
    """The MIME type of a file name's extension, or null."""
    ext = extension(name)
    return F.when(ext == "docx", MIMES["docx"]).when(ext == "odt", MIMES["odt"])


def route(mime: Column, name: Column) -> Column:
    """docx, odt or text; a MIME type that is given wins over the name."""
    known = F.coalesce(mime, infer_mime(name))
    return F.when(known == MIMES["docx"], "docx").when(known == MIMES["odt"], "odt").otherwise("text")


def register_format(ext: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Let files with that extension be read by reader(files) -> elements."""
    _formats[ext] = reader


def registered(ext: str) -> Callable[[DataFrame], DataFrame] | None:
    return _formats.get(ext)


def described(files: DataFrame) -> DataFrame:
    """files(path, length, modificationTime, content) with doc_id, filename, format and mime."""
    name = S.after_last(F.col("path"), "/")
    return files.select(
        F.col("path").alias("doc_id"), "path", name.alias("filename"), extension(name, "txt").alias("format"), infer_mime(name).alias("mime"),
        "length", F.col("modificationTime").alias("modified"), "content",
    )


def read_corpus(spark: SparkSession, path: str, pattern: str = "*", empty: bool = False) -> DataFrame:
    """One row per file below path, its bytes included. Column pruning leaves content unread where it isn't asked for.

    Spark's reader leaves out files without bytes; empty: they have rows too. Those are found by Arrow, so path must be one that it opens, without braces in pattern.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return described(files.unionByName(_empty_files(spark, path, pattern)) if empty else files)


def _empty_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The files of no bytes below path as Spark's reader would have them: one task lists path, further ones its folders."""

    def listed(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = fs.FileSystem.from_uri(path)
            root = root.rstrip("/")
            for batch in batches:
                for below in batch.column(0).to_pylist():
                    rows = []
                    for file in system.get_file_info(fs.FileSelector(f"{root}/{below}".rstrip("/"), recursive=deep)):
                        name = file.path[len(root) + 1 :]
                        hidden = any(step.startswith(("_", ".")) for step in name.split("/"))
                        if not hidden and (file.type == fs.FileType.Directory and not deep or file.type == fs.FileType.File and file.size == 0 and fnmatch.fnmatchcase(file.base_name, pattern)):
                            rows.append((name, file.mtime, file.type == fs.FileType.Directory))
                    name, modified, folder = zip(*rows, strict=True) if rows else ((),) * 3
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(folder, pa.bool_())], ["name", "modified", "folder"])

        return work

    kinds = "name string, modified timestamp, folder boolean"
    top = spark.createDataFrame([("",)], "name string").coalesce(1).mapInArrow(listed(False), kinds)
    inner = top.where("folder").select("name").repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(listed(True), kinds)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString().rstrip("/")
    found = top.where("not folder").unionByName(inner)
    return found.select(F.concat(F.lit(f"{known}/"), "name").alias("path"), F.col("modified").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def plain_text_elements(files: DataFrame) -> DataFrame:
    """doc_id, seq, type, text, color: a file of no known format is one paragraph of its whole text, read as UTF-8 (an undecodable byte becomes the replacement character)."""
    return files.select("doc_id", F.lit(0).alias("seq"), F.lit("paragraph").alias("type"), F.decode("content", "UTF-8").alias("text"), F.lit("000000").alias("color"))


def explode_parts(files: DataFrame, content: bool = True) -> DataFrame:
    """One row per package entry in archive order. Of entries with one name the last counts, at the first's place. Files that aren't packages have no rows. content: false for names alone, which inflates nothing."""
    inflated = content

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[str, bytes] = {}
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for entry in z.infolist():
                            if not entry.is_dir():
                                found[entry.filename] = z.read(entry) if inflated else None
                except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, RuntimeError, NotImplementedError, OSError, ValueError):
                    continue
                rows.extend((doc, i, name, body) for i, (name, body) in enumerate(found.items()))
            doc, seq, name, body = zip(*rows, strict=True) if rows else ((),) * 4
            ext = [n.rsplit(".", 1)[1].lower() if "." in n else "" for n in name]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), pa.array(seq, pa.int32()), pa.array(name, pa.string()), pa.array(ext, pa.string()), pa.array(body, pa.binary())], ["doc_id", "entry_seq", "part", "ext", "content"])

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(work, PARTS)


#: Bytes of packages in a batch.
PACKED = 32 << 20


def packed(parts: DataFrame) -> DataFrame:
    """doc_id, content: each document's parts in one package, in order of entry_seq. A document is one package, so its parts fit a task.

    Rows come sorted by document, and a package ends where the next document begins, so many small documents cost no more than their rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[str | None] = []
        made: list[bytes] = []
        size, doc, out, z = 0, None, None, None

        def end() -> int:
            z.close()
            docs.append(doc)
            made.append(out.getvalue())
            return len(made[-1])

        def batch() -> pa.RecordBatch:
            full = pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(made, pa.binary())], ["doc_id", "content"])
            docs.clear()
            made.clear()
            return full

        for rows in batches:
            names = rows.column(1).to_pylist()
            for i, d in enumerate(rows.column(0).to_pylist()):
                if z is None or d != doc:
                    if z is not None:
                        size += end()
                    if size >= PACKED or len(docs) >= 1_000:
                        yield batch()
                        size = 0
                    doc, out = d, io.BytesIO()
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(names[i]), rows.column(2)[i].as_py())
        if z is not None:
            end()
        yield batch()

    rows = parts.select("doc_id", "entry_seq", "part", F.col("content").cast("binary")).repartition("doc_id").sortWithinPartitions("doc_id", "entry_seq")
    return rows.select("doc_id", "part", "content").mapInArrow(work, "doc_id string, content binary")


class _Nodes:
    """The nodes of parts as their XML is fed, each given out when it ends: only open elements are kept. pre counts starts; so the order in which nodes come is not theirs.

    Nodes of many parts wait together, as rows without the columns that are made for all of them at once: runs has (doc_id, part, their nodes).
    """

    def __init__(self, places: str | None = None) -> None:
        self.names: dict[str, tuple[str, str | None, str]] = {}  # local name, namespace and qualified name of a full one
        self.places = places and re.compile(places)
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.runs: list[tuple[str, str, int]] = []
        self.keys: list[str] = []
        self.values: list[str] = []

    def part(self, doc: str, part: str) -> None:
        """What is fed from here on belongs to this part."""
        self.doc, self.name, self.from_row = doc, part, len(self.rows)
        self.n, self.text = 0, []
        self.open: list[tuple] = []  # pre, attributes, names and what the element stands in
        self.inside: tuple[int | None, int, bytes, str] = (None, 0, b"", "")  # parent, depth, anc as 32-bit integers, path
        self.parser = expat.ParserCreate(namespace_separator="\n")
        self.parser.namespace_prefixes, self.parser.ordered_attributes, self.parser.buffer_text = True, True, True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self.text.append

    def end_run(self) -> None:
        """Note whose the rows since the last note are."""
        if len(self.rows) > self.from_row:
            self.runs.append((self.doc, self.name, len(self.rows) - self.from_row))
        self.from_row = len(self.rows)

    def _names(self, full: str) -> tuple[str, str | None, str]:
        parts = full.split("\n")
        found = (full, None, full) if len(parts) == 1 else (parts[1], parts[0], f"{parts[2]}:{parts[1]}" if len(parts) > 2 else parts[1])
        if len(self.names) < 10_000:
            self.names[full] = found
        return found

    def _flush(self) -> None:
        n = self.n
        self.rows.append((n, n, "text", None, None, None, None, "".join(self.text), *self.inside))
        self.n = n + 1
        self.text.clear()

    def _start(self, name: str, attrs: list[str]) -> None:
        if self.text:
            self._flush()
        names, inside, n = self.names.get(name) or self._names(name), self.inside, self.n
        self.open.append((n, attrs, names, inside))
        _, depth, anc, path = inside
        self.inside = (n, depth + 1, anc + n.to_bytes(4, sys.byteorder), f"{path}/{names[0]}" if depth else names[0])
        self.n = n + 1

    def _end(self, _: str) -> None:
        if self.text:
            self._flush()
        n, attrs, names, inside = self.open.pop()
        self.inside = inside
        if attrs:
            own = [((self.names.get(k) or self._names(k))[2], v) for k, v in zip(attrs[::2], attrs[1::2], strict=True)]
            for k, v in sorted(own) if len(own) > 1 else own:
                self.keys.append(k)
                self.values.append(v)
        self.rows.append((n, self.n - 1, "elem", len(attrs) // 2, *names, None, *inside))

    def batch(self) -> pa.RecordBatch:
        """The waiting nodes as columns; none wait afterwards."""
        pre, post, kind, owned, name, ns, qname, text, parent, depth, anc, path = zip(*self.rows, strict=True) if self.rows else ((),) * 12
        which = pa.array(np.repeat(np.arange(len(self.runs), dtype=np.int32), np.array([r[2] for r in self.runs], dtype=np.int64)))
        doc, part = (pa.array([r[i] for r in self.runs], pa.string()).take(which) for i in (0, 1))
        starts = lambda sizes: np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
        places = pa.ListArray.from_arrays(pa.array(starts(np.array(depth, dtype=np.int32))), pa.Array.from_buffers(pa.int32(), sum(depth), [None, pa.py_buffer(b"".join(anc))]))
        is_text = np.array([o is None for o in owned] + [False], dtype=bool)
        at = starts(np.array([o or 0 for o in owned], dtype=np.int32))
        attrs = pa.MapArray.from_arrays(pa.array(at, pa.int32(), mask=is_text), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        ints, strings = (lambda c: pa.array(c, pa.int32())), (lambda c: pa.array(c, pa.string()))
        columns = [doc, part, ints(pre), ints(post), ints(parent), ints(depth), strings(kind), strings(name), strings(ns), strings(qname), attrs, strings(text), places, strings(path)]
        self.clear()
        made = pa.RecordBatch.from_arrays(columns, COLUMNS)
        if not self.places:
            return made
        here = [(f"{p}/{n or TEXT}" if p else n) for p, n in zip(path, name, strict=True)]
        known = {x: bool(self.places.fullmatch(x)) for x in set(here)}
        return made.filter(pa.array([known[x] for x in here], pa.bool_()))


UNREADABLE = (expat.ExpatError, ValueError, LookupError)
#: A text's step in a place.
TEXT = "#text"


def _well_formed(content: bytes) -> bool:
    try:
        expat.ParserCreate(namespace_separator="\n").Parse(content, True)
    except UNREADABLE:
        return False
    return True


#: Bytes of XML between two looks at how many nodes wait, and how many may wait.
SLICE, WAITING = 1 << 16, 20_000


def _fed(nodes: _Nodes, doc: str, part: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """Feed one part to nodes and give out batches as they fill; a part that isn't well formed leaves none. A part of one slice is taken back then; of a longer one, a first pass tells."""
    if len(content) <= SLICE:
        rows, keys = len(nodes.rows), len(nodes.keys)
        nodes.part(doc, part)
        try:
            nodes.parser.Parse(content, True)
        except UNREADABLE:
            del nodes.rows[rows:], nodes.keys[keys:], nodes.values[keys:]
        nodes.end_run()
    elif _well_formed(content):
        nodes.part(doc, part)
        view = memoryview(content)
        for at in range(0, len(content), SLICE):
            nodes.parser.Parse(view[at : at + SLICE], at + SLICE >= len(content))
            nodes.end_run()
            if len(nodes.rows) >= WAITING:
                yield nodes.batch()
                nodes.from_row = 0
    if len(nodes.rows) >= WAITING:
        yield nodes.batch()


NAME = rb"[^\s/:=\"'<>&]+(?::[^\s/:=\"'<>&]+)?"
#: A tag with the text after it; the inside of a tag; an attribute; a reference. Of XML without a > in values, comments, CDATA and the like.
TAG_AND_TEXT, INSIDE = re.compile(rb"<([^>]*)>([^<]*)"), re.compile(rb"(/?)(%b)((?:\s+%b\s*=\s*\"[^\"\t\n]*\")*)\s*(/?)" % (NAME, NAME))
ATTRIBUTE, REFERENCE = re.compile(rb"\s(%b)\s*=\s*\"([^\"]*)\"" % NAME), re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|[a-z]+);")
DECLARATION = re.compile(rb"<\?xml version=\"1\.0\"(?: encoding=\"[Uu][Tt][Ff]-8\")?(?: standalone=\"(?:yes|no)\")?\s*\?>\s*")
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
OPENS, CLOSES, ALONE = 0, 1, 2
#: Bytes of a part whose tags are taken together, and how many tags and paths are remembered between batches.
TOGETHER, REMEMBERED = 1 << 22, 1 << 15


def _referred(m: re.Match[str]) -> str:
    name = m[1]
    return chr(int(name[2:], 16)) if name.startswith("#x") else chr(int(name[1:])) if name[0] == "#" else REFERENCES[name]


def _plain(raw: bytes) -> str:
    """Text or a value without its references."""
    text = raw.decode()
    return REFERENCE.sub(_referred, text) if "&" in text else text


class _Scope(dict[bytes, int]):
    """The numbers of the tags that stand below one root tag, which alone declares namespaces."""

    def __init__(self, tags: _Tags, root: bytes):
        super().__init__()
        self.tags, self.root, self.spaces = tags, root, {"xml": "http://www.w3.org/XML/1998/namespace"}
        for k, v in ATTRIBUTE.findall(root):
            if k == b"xmlns" or k.startswith(b"xmlns:"):
                self.spaces[k[6:].decode()] = _plain(v)

    def __missing__(self, raw: bytes) -> int:
        found = INSIDE.fullmatch(raw)
        if not found:
            raise ValueError("a tag for the parser")
        end, name, attrs, empty = found.groups()
        own = ATTRIBUTE.findall(attrs)
        if raw != self.root and any(k == b"xmlns" or k.startswith(b"xmlns:") for k, _ in own):
            raise ValueError("a namespace declared below the root")
        prefix, _, local = name.decode().rpartition(":")
        names = (local, self.spaces.get(prefix) or None, name.decode())
        pairs = sorted((k.decode(), _plain(v)) for k, v in own if k != b"xmlns" and not k.startswith(b"xmlns:"))
        self[raw] = out = self.tags.number(CLOSES if end else ALONE if empty else OPENS, names, pairs)
        return out


class _Tags:
    """The nodes of many parts at once: tags are told apart by their bytes, each different one is read once, and numpy works out where all of them stand.

    It takes what most parts are: UTF-8 of up to TOGETHER bytes, with namespaces declared by the root and without comments, CDATA, DTDs and carriage returns.
    add() takes nothing of another part, or of one that isn't well formed; those are for the parser.
    """

    def __init__(self, places: str | None = None) -> None:
        self.places = places and re.compile(places)
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.scopes: dict[bytes, _Scope] = {}
        self.kinds: list[int] = []
        self.names: list[tuple[str, str | None, str]] = []
        self.attrs: list[list[tuple[str, str]]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.path_texts = [""]
        self.wanted = np.zeros((0, 2), dtype=bool)  # of each path: whether an element of it is at one of places, and whether its texts are

    def clear(self) -> None:
        self.codes: list[int] = []
        self.texts: list[bytes] = []
        self.runs: list[tuple[str, str, int]] = []

    def number(self, kind: int, names: tuple[str, str | None, str], attrs: list[tuple[str, str]]) -> int:
        self.kinds.append(kind)
        self.names.append(names)
        self.attrs.append(attrs)
        return len(self.kinds) - 1

    def add(self, doc: str, part: str, content: bytes) -> bool:
        """Whether the part is taken."""
        if len(content) > TOGETHER or b"\r" in content:
            return False
        if content.startswith(b"<?"):
            head = DECLARATION.match(content)
            if not head:
                return False
            body = content[head.end() :]
        else:
            body = content
        if not body.startswith(b"<") or b"<!" in body or b"<?" in body or not _well_formed(content):
            return False
        found = TAG_AND_TEXT.findall(body)
        root = found[0][0]
        scope = self.scopes.get(root)
        try:
            if scope is None:
                scope = self.scopes[root] = _Scope(self, root)
            codes = [scope[tag] for tag, _ in found]
        except ValueError:
            return False
        self.codes += codes
        self.texts += [text for _, text in found]
        self.runs.append((doc, part, len(found)))
        return True

    def _path(self, above: int, name: str) -> int:
        found = self.paths.get((above, name))
        if found is None:
            found = self.paths[above, name] = len(self.path_texts)
            self.path_texts.append(f"{self.path_texts[above]}/{name}" if above else name)
        return found

    def _wanted(self) -> np.ndarray:
        more = self.path_texts[len(self.wanted) :]
        if more:
            found = [(bool(self.places.fullmatch(x)), bool(self.places.fullmatch(f"{x}/{TEXT}"))) for x in more]
            self.wanted = np.concatenate((self.wanted, np.array(found, dtype=bool)))
        return self.wanted

    def batch(self) -> pa.RecordBatch:
        """The waiting nodes as columns, in document order; none wait afterwards."""
        used, tag = np.unique(np.array(self.codes, dtype=np.int64), return_inverse=True)
        names = [self.names[c] for c in used]
        kind = np.array([self.kinds[c] for c in used], dtype=np.int8)[tag]
        opens = kind != CLOSES
        inside = np.cumsum((kind == OPENS).astype(np.int32) - (kind == CLOSES), dtype=np.int32)  # how many are open after a tag
        has_text = np.array([len(t) for t in self.texts], dtype=np.int64).astype(bool) & (inside > 0)
        made = opens.astype(np.int64) + has_text
        after = np.cumsum(made)
        elem, text = (after - made)[opens], after[has_text] - 1
        size = int(after[-1])

        # of each node: its depth, which different tag made it, the number of its part's first node
        depth, of = np.empty(size, np.int32), np.full(size, -1, np.int64)
        depth[elem], depth[text], of[elem] = (inside - (kind == OPENS))[opens], inside[has_text], tag[opens]
        per_tag = np.repeat(np.arange(len(self.runs), dtype=np.int32), np.array([r[2] for r in self.runs]))
        which = np.empty(size, np.int32)
        which[elem], which[text] = per_tag[opens], per_tag[has_text]
        at = np.arange(size)
        first = at[np.append(True, which[1:] != which[:-1])][which]
        post = at.copy()
        paired = np.flatnonzero(kind != ALONE)
        level = (inside - (kind == OPENS))[paired]
        pairs = paired[np.argsort(level, kind="stable")].reshape(-1, 2)
        post[(after - made)[pairs[:, 0]]] = after[pairs[:, 1] - 1] - 1

        # what each node stands in, a level at a time, and the local names of that
        parent, path, own = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        is_elem, lasts = of >= 0, []
        for d in range(int(depth.max()) + 1):
            here = np.flatnonzero((depth == d) & is_elem)
            keys, back = np.unique(path[here] * len(used) + of[here], return_inverse=True)
            own[here] = np.array([self._path(k // len(used), names[k % len(used)][0]) for k in keys.tolist()], dtype=np.int64)[back]
            last = np.full(size, -1, np.int64)
            last[here] = here
            last = np.maximum.accumulate(last)
            lasts.append(last)
            child = np.flatnonzero(depth == d + 1)
            parent[child] = last[child] - first[child]
            path[child] = own[last[child]]

        if self.places:  # the others are left out from here on
            wanted = self._wanted()
            here = np.flatnonzero(np.where(is_elem, wanted[own, 0], wanted[path, 1]))
            texts = np.flatnonzero(has_text)[np.isin(text, here)]
            at, first, post, parent, depth, path, of, which, is_elem, lasts = (at[here], first[here], post[here], parent[here], depth[here], path[here], of[here], which[here], is_elem[here], [x[here] for x in lasts])
            size = len(here)
            has_text = np.zeros(len(has_text), dtype=bool)
            has_text[texts] = True
            text = np.flatnonzero(~is_elem)
        offsets = np.append(0, np.cumsum(depth, dtype=np.int64))
        anc = np.empty(int(offsets[-1]), np.int32)
        for d, last in enumerate(lasts):
            below = np.flatnonzero(depth > d)
            anc[offsets[below] + d] = last[below] - first[below]

        attrs = [self.attrs[c] for c in used]
        count = np.array([len(a) for a in attrs], dtype=np.int64)
        begin, n = np.cumsum(count) - count, np.where(is_elem, count[of], 0)
        ends = np.cumsum(n)
        flat = pa.array(np.repeat(np.where(is_elem, begin[of], 0) - (ends - n), n) + np.arange(int(n.sum())))
        keys, values = (pa.array([a[i] for x in attrs for a in x], pa.string()).take(flat) for i in (0, 1))
        pairs_of = pa.MapArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32), mask=np.append(~is_elem, False)), keys, values)
        spot = np.full(size, -1, np.int64)
        spot[text] = np.arange(len(text))
        texts = pa.array([t if b"&" not in t else _plain(t).encode() for t, has in zip(self.texts, has_text.tolist(), strict=True) if has], pa.binary()).cast(pa.string())
        named = lambda i: pa.array([x[i] for x in names], pa.string()).take(pa.array(of, mask=~is_elem))
        doc, part = (pa.array([r[i] for r in self.runs], pa.string()).take(pa.array(which)) for i in (0, 1))
        ints = lambda x: pa.array(x.astype(np.int32))
        columns = [
            doc, part, ints(at - first), ints(post - first), pa.array(parent.astype(np.int32), mask=parent < 0), ints(depth), pa.array(["text", "elem"]).take(pa.array(is_elem.astype(np.int8))), named(0), named(1), named(2),
            pairs_of, texts.take(pa.array(spot, mask=spot < 0)), pa.ListArray.from_arrays(ints(offsets), pa.array(anc)), pa.array(self.path_texts, pa.string()).take(pa.array(path)),
        ]
        self.clear()
        if len(self.kinds) > REMEMBERED or len(self.path_texts) > REMEMBERED:
            self.forget()
        return pa.RecordBatch.from_arrays(columns, COLUMNS)


def _shredded(doc: str, part: str, content: bytes) -> Iterator[list[tuple]]:
    """The nodes of one part alone, some at a time; none if it isn't well formed."""
    nodes = _Nodes()
    for batch in _fed(nodes, doc, part, content):
        yield [tuple(row.values()) for row in batch.to_pylist()]
    if nodes.rows:
        yield [tuple(row.values()) for row in nodes.batch().to_pylist()]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which the driver and all executors share; a local session without that setting gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="docflow-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str = "nodes") -> DataFrame:
    """Write a table that many operators read, such as nodes, and return the written one: each archive is then parsed once, and scans read only the rows and columns they name."""
    return written(df, new_folder(df.sparkSession, tag))


def written(df: DataFrame, path: str) -> DataFrame:
    """stored() in a folder of that path. The driver's JVM is asked to drop the plan that made the table, as Spark keeps its shuffle files as long as that."""
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shred(parts: DataFrame, places: str | None = None) -> DataFrame:
    """The nodes of each XML part, elements and texts. Parts that aren't well formed have none. Comments and processing instructions are dropped.

    places: a regular expression; only nodes whose place it fits as a whole are given out, of parts that are read as a whole all the same. A place is the local names
    from the root to the node, with slashes between; a text's last step is #text. For a question that reads the nodes once, so they needn't be written.

    Plain parts of up to TOGETHER bytes are taken many at once. Another part is fed to a parser in slices, so a worker's memory is that of its bytes and of some
    20,000 nodes, whatever its length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tags = _Nodes(places), _Tags(places)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, part, content = (batch.column(k)[i].as_py() for k in range(3))
                if not tags.add(doc, part, content or b""):
                    yield from _fed(nodes, doc, part, content or b"")
                elif len(tags.codes) >= WAITING:
                    yield tags.batch()
        if tags.runs:
            yield tags.batch()
        yield nodes.batch()

    wanted = parts.where(F.lower("part").endswith(".xml") | F.lower("part").endswith(".rels"))
    return wanted.select(F.col("doc_id").cast("string"), "part", F.col("content").cast("binary")).mapInArrow(work, NODES)


def parts_like(parts: DataFrame, prefix: str, suffix: str | None = ".xml") -> DataFrame:
    """Parts whose names begin and end so; suffix None takes any end. Without it, only XML is found, so binary entries need None."""
    found = parts.where(F.col("part").startswith(prefix))
    return found.where(F.col("part").endswith(suffix)) if suffix is not None else found


def part_text(parts: DataFrame) -> DataFrame:
    return parts.withColumn("raw", F.decode("content", "UTF-8"))


def owner_of(rels_part: Column) -> Column:
    """The part whose relationships a .rels part holds."""
    return F.regexp_replace(F.regexp_replace(rels_part, r"_rels/([^/]*)$", "$1"), r"\.rels$", "")


def relationships(nodes: DataFrame) -> DataFrame:
    """doc_id, part, rel_id, target: of relationships with one id the last counts."""
    found = nodes.where((F.col("name") == "Relationship") & F.col("part").endswith(".rels"))
    found = found.select("doc_id", owner_of(F.col("part")).alias("part"), F.col("attrs")["Id"].alias("rel_id"), F.coalesce(F.col("attrs")["Target"], F.lit("")).alias("target"), "pre")
    found = found.where(S.non_blank(F.col("rel_id")).isNotNull())
    return found.groupBy("doc_id", "part", "rel_id").agg(F.max_by("target", "pre").alias("target"))


def resolve_target(part: Column, target: Column) -> Column:
    """A target as a package path: from the root with a leading slash, else from the part's folder; dots are resolved, null stays null."""
    folder = F.when(target.startswith("/"), F.lit("")).otherwise(F.when(part.contains("/"), F.regexp_replace(part, "/[^/]*$", "")).otherwise(""))
    steps = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda s: ~s.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.array_append(acc, s)))
    return F.when(target.isNotNull(), F.array_join(walked, "/"))


def parse_status(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, ok, error: files whose main part could not be read carry a message instead of stopping the job."""
    main = nodes.where((F.col("pre") == 0) & F.col("part").isin("word/document.xml", "content.xml")).select("doc_id", "part").distinct()
    asked = files.select(F.col("doc_id").cast("string"), "format")
    docx = (F.col("format") == "docx") & (F.col("part") == "word/document.xml")
    odt = (F.col("format") == "odt") & (F.col("part") == "content.xml")
    found = asked.join(main, "doc_id", "left").groupBy("doc_id", "format").agg(F.bool_or(F.coalesce(docx | odt, F.lit(False))).alias("opened"))
    ok = F.col("opened") | ~F.col("format").isin("docx", "odt")
    message = F.when(F.col("format") == "odt", "Not a valid ODT file: missing content.xml").otherwise("Failed to open file")
    return found.select("doc_id", ok.alias("ok"), F.when(~ok, message).alias("error"))


def fail_fast(status: DataFrame) -> DataFrame:
    """status, but the job ends with the first error."""
    return status.withColumn("ok", F.when(~F.col("ok"), F.raise_error(F.concat(F.col("doc_id"), F.lit(": "), F.col("error"))).cast("boolean")).otherwise(True))


def html_nodes(pages: DataFrame) -> DataFrame:
    """doc_id, pre, name, href, text of the tags of HTML, by regular expressions: scripts, styles and comments are dropped, a p ends with the next."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    tags = F.regexp_extract_all(body, F.lit(r"(<[a-zA-Z][^>]*>[^<]*|</[a-zA-Z][^>]*>[^<]*)"), F.lit(1))
    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(tags).alias("pre", "tag"))
    rows = rows.withColumn("closing", F.col("tag").startswith("</")).withColumn("name", F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z0-9]+)", 1)))
    href = F.regexp_extract("tag", r"""(?i)\shref\s*=\s*["']([^"']*)["']""", 1)
    return rows.select("doc_id", "pre", "name", "closing", F.when(href != "", href).alias("href"), F.regexp_extract("tag", r"(?s)>(.*)$", 1).alias("text"))


def numbered(window_cols: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*window_cols).orderBy(*order))
