"""Files under names of their own, by a Spark data source whose commit puts them in place: all of a job's files or none.

Rows are (name, body): the lines of a file in the order in which a task gets them. Tasks write into a folder of the attempt;
the commit moves the files of attempts that Spark counts to their names and drops the rest, so a failed, repeated or
speculative task leaves nothing. No row goes through the driver.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "graphloom_named"


def _open(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else url.replace("file:", "file://", 1) if url.startswith("file:") else f"file://{url}")


@dataclass
class Written(WriterCommitMessage):
    folder: str = ""
    names: list = field(default_factory=list)


class NamedFiles(DataSource):
    """Options: path; header, separator and footer of every file (separator: between lines, a line end by default)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.header, self.separator, self.footer = options.get("header", ""), options.get("separator", "\n"), options.get("footer", "\n")
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex[:12]}"

    def write(self, iterator) -> Written:
        filesystem, base = _open(f"{self.staged}/{uuid.uuid4().hex[:12]}")
        now, handle, names = None, None, []
        try:
            for name, body in iterator:
                if name != now:
                    self._end(handle)
                    if name in names:
                        raise ValueError(f"rows of {name!r} are not together")
                    if not name or "/" in name or name.startswith(("_", ".")):
                        raise ValueError(f"not a file's name: {name!r}")
                    if not names:
                        filesystem.create_dir(base, recursive=True)
                    now, handle = name, None
                    handle = filesystem.open_output_stream(posixpath.join(base, name))
                    handle.write(self.header.encode())
                    names.append(name)
                else:
                    handle.write(self.separator.encode())
                handle.write((body or "").encode())
            self._end(handle)
        except BaseException:
            if handle is not None and not handle.closed:
                handle.close()
            raise
        return Written(base, names)

    def _end(self, handle) -> None:
        if handle is not None:
            handle.write(self.footer.encode())
            handle.close()

    def commit(self, messages) -> None:
        filesystem, base = _open(self.path)
        filesystem.create_dir(base, recursive=True)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("a file's rows were written by several tasks")
        if self.overwrite:
            from pyarrow import fs

            for old in filesystem.get_file_info(fs.FileSelector(base)):
                if old.is_file and old.base_name not in names:
                    filesystem.delete_file(old.path)
        for m in done:
            for n in m.names:
                filesystem.move(posixpath.join(m.folder, n), posixpath.join(base, n))
        self._drop()

    def abort(self, messages) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        filesystem, staged = _open(self.staged)
        if filesystem.get_file_info(staged).type == fs.FileType.Directory:
            filesystem.delete_dir(staged)


def write_named(rows: DataFrame, path: str, name: str | Column, body: str | Column, order: list, header: str = "", separator: str = "\n", footer: str = "\n", mode: str = "overwrite") -> None:
    """One file a name under path: header, the bodies in `order`, separated, and footer.

    A file is one stream, so one task writes it, and only its sort holds rows; files spread over tasks. Rows without a name
    are dropped. `mode` overwrite replaces the folder's files, append adds to them (files of the same name are replaced).
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    keys = [col(c).alias(f"_k{k}") for k, c in enumerate(order)]
    picked = rows.select(col(name).cast("string").alias("name"), col(body).cast("string").alias("body"), *keys).where("name IS NOT NULL")
    placed = picked.repartition(F.col("name")).sortWithinPartitions("name", *(f"_k{k}" for k in range(len(keys)))).select("name", "body")
    placed.write.format(FORMAT).mode(mode).option("path", path).option("header", header).option("separator", separator).option("footer", footer).save()


def write_explanations(documents: DataFrame, path: str, name: str = "Explanations.json") -> None:
    """(key, document as JSON text): one JSON object of all keys, keys in order, as one file."""
    entry = F.concat(F.expr("substring(to_json(named_struct('k', key)), 6, length(to_json(named_struct('k', key))) - 6)"), F.lit(":"), "document")
    write_named(documents.where("key IS NOT NULL AND document IS NOT NULL"), path, F.lit(name), entry, ["key", "document"], "{", ",\n", "}\n", "append")


def write_graphs(triples: DataFrame, path: str, base: str = "http://example.org/extracted/", label: str = "Module of ", version: str = "1.0", terminology: list[str] | None = None) -> None:
    """One Turtle file a graph, `<graph_id>.ttl`: the lines of a terminology that all share, a statement that names its ontology
    with label, comment and version, then the statements of triples(graph_id, s, p, o, o_kind, o_dtype, o_lang) in order."""
    from .files import turtle_lines

    owl, rdfs, rdf = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    safe = F.regexp_replace("graph_id", r"[^\w.\-]", "_")
    quoted = F.regexp_replace(F.regexp_replace("graph_id", r"\\", r"\\\\"), '"', r'\\"')
    counts = triples.groupBy("graph_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    head = counts.select("graph_id", F.concat(
        F.lit(f"<{base}"), safe, F.lit(f"> <{rdf}type> <{owl}Ontology> ;\n    <{rdfs}label> \"{label}"), quoted, F.lit(f"\" ;\n    <{rdfs}comment> \""), "n", F.lit(f" statements\" ;\n    <{owl}versionInfo> \"{version}\" .")).alias("value"))
    lines = turtle_lines(triples).distinct().withColumn("k", F.lit(1)).unionByName(head.withColumn("k", F.lit(0)))
    header = "".join(x + "\n" for x in terminology or ())
    write_named(lines.withColumn("file", F.concat(safe, F.lit(".ttl"))), path, "file", "value", ["k", "value"], header)


def write_texts(texts: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """Each text as a file under its own name, whole: rewritten ontologies beside their originals' names."""
    write_named(texts, path, name, text, [text], footer="")
