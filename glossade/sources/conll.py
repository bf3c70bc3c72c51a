"""Reading and writing tagged sentences in column files: basic (.pos) and ten-column CoNLL-U. A file is a partition: sentences don't split."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TOKENS = "array<struct<form:string,lemma:string,upos:string>>"
#: Sentences a written file: a file is one row when it is read from a store.
SENTENCES = 10_000
#: Tokens of a batch that the reader gives back (ten characters of text count as one).
_BATCH = 200_000
SCHEMA = f"file string, doc_no long, doc_id string, sent_no long, sent_id string, text string, tokens {TOKENS}"
# Fixed formats: the comments that name documents and sentences.
_DOC = re.compile(r"#\s*newdoc id\s*=\s*(.+)$", re.I)
_SENT = re.compile(r"#\s*sent_id\s*=\s*(.+)$", re.I)


def basic_sentences(lines: Iterator[str]):
    """(sent_id, text, tokens) of ID FORM LEMMA UPOS rows; `_` and empty lemmas or tags are left out (null). Rows of under two columns are skipped."""
    sid = text = None
    tokens: list = []
    for line in lines:
        line = line.rstrip("\n")
        if line == "":
            if tokens:
                yield sid, text, tokens
            sid, text, tokens = None, None, []
        elif line.startswith("#"):
            if line.startswith("# sent_id ="):
                sid = line.partition("=")[2].strip()
            elif line.startswith("# text ="):
                text = line.partition("=")[2].strip()
        else:
            c = line.split("\t")
            if len(c) >= 2:
                part = [x if x not in ("", "_") else None for x in c[2:4]] + [None, None]
                tokens.append((c[1], part[0], part[1]))
    if tokens:
        yield sid, text, tokens


def has_documents(lines: Iterator[str]) -> bool:
    return any(line[:1] == "#" and _DOC.match(line.rstrip("\n")) for line in lines)


def conllu_sentences(lines: Iterator[str], stem: str, documents: bool):
    """(doc_no, doc_id, sent_id, text, tokens), line by line: whole-number ids of ten columns only.

    documents: whether any document is named. If so, sentences that end before the first go (one that is open there goes on in it), and a document
    without sentences gives a row without tokens; else the file is one document. Sentences without an id are sent-0, sent-1, ... by document.
    """
    doc_no, doc_id = (0, None) if documents else (1, stem)
    sid, text, tokens, n = None, None, [], 0  # n: sentences of the document that ended
    for line in chain(lines, [None]):
        named = _DOC.match(line.rstrip("\n")) if line and line[0] == "#" else None
        ends = line is None or (named is not None and doc_no > 0)
        if tokens and (ends or line in ("\n", "")):
            if doc_no:
                yield doc_no, doc_id, sid or f"sent-{n}", text, tokens
            sid, text, tokens, n = None, None, [], n + 1
        if ends and documents and doc_no and not n:
            yield doc_no, doc_id, None, None, []
        if line is None:
            return
        line = line.rstrip("\n")
        if named:
            doc_no, doc_id, n = doc_no + 1, named[1].strip(), 0
        elif line[:1] == "#":
            if m := _SENT.match(line):
                sid = m[1].strip()
            elif line.startswith("# text ="):
                text = line.partition("=")[2].strip()
        else:
            c = line.split("\t")
            if len(c) >= 10 and c[0].isascii() and c[0].isdigit():
                tokens.append((c[1], c[2], c[3]))


def _rows(f, stem: str, layout: str):
    """(doc_no, doc_id, sent_id, text, tokens) of a file that can be read twice."""
    if layout != "conllu":
        return ((1, stem, *x) for x in basic_sentences(f))
    documents = has_documents(f)
    f.seek(0)
    return conllu_sentences(f, stem, documents)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "basic")

    def partitions(self):
        if os.path.isdir(self.path):
            return [_File(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if n.endswith((".pos", ".conllu"))]
        return [_File(self.path)]

    def read(self, partition):
        stem = os.path.splitext(os.path.basename(partition.path))[0]
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for k, (doc_no, doc_id, sid, text, tokens) in enumerate(_rows(f, stem, self.layout)):
                yield partition.path, doc_no, doc_id, k, sid, text, tokens


class ConllDataSource(DataSource):
    """spark.read.format("conll").option("layout", "basic" or "conllu").load(file or folder), on a file system that executors mount."""

    @classmethod
    def name(cls):
        return "conll"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConllDataSource)


def read_store(spark: SparkSession, path: str, layout: str = "basic") -> DataFrame:
    """The same rows from any store that Spark reads: whole files by binaryFile, parsed by the executors. A file must fit a task's memory; write() sees to that."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        def batch(rows: list[tuple], words: list[list], ends: list[int]):
            tokens = pa.StructArray.from_arrays([pa.array(w, pa.string()) for w in words], ["form", "lemma", "upos"])
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)]
            return pa.RecordBatch.from_arrays(cols, ["file", "doc_no", "doc_id", "sent_no", "sent_id", "text", "tokens"])

        for files in batches:
            for p, content in zip(files.column(0), files.column(1)):
                p, raw = p.as_py(), io.BytesIO(content.as_py())
                stem = os.path.splitext(os.path.basename(p))[0]
                rows, words, ends, chars = [], [[], [], []], [0], 0
                for k, (doc_no, doc_id, sid, text, tokens) in enumerate(_rows(io.TextIOWrapper(raw, encoding="utf-8", errors="replace"), stem, layout)):
                    rows.append((p, doc_no, doc_id, k, sid, text))
                    for w, own in zip(words, zip(*tokens)):
                        w += own
                    ends.append(len(words[0]))
                    chars += len(text or "") + 100
                    if max(ends[-1], chars // 10) >= _BATCH:
                        yield batch(rows, words, ends)
                        rows, words, ends, chars = [], [[], [], []], [0], 0
                if rows:
                    yield batch(rows, words, ends)

    return files.mapInArrow(run, SCHEMA)


def basic_block(sent_id: Column, text: Column, tokens: Column) -> Column:
    """A sentence as it is written: comments, numbered rows, `_` for what is missing, and a blank line (the text sink adds the last line end)."""
    dash = lambda c: F.coalesce(c, F.lit("_"))
    rows = F.transform(tokens, lambda t, i: F.concat_ws("\t", (i + 1).cast("string"), dash(t["form"]), dash(t["lemma"]), dash(t["upos"])))
    return F.concat(F.lit("# sent_id = "), F.coalesce(sent_id, F.lit("")), F.lit("\n# text = "), F.coalesce(text, F.lit("")), F.lit("\n"), F.array_join(rows, "\n"), F.lit("\n"))


#: Columns 5 to 10, and what stands where a token has none.
MORE = {"xpos": "_", "feats": "_", "head": "0", "deprel": "_", "deps": "_", "misc": "_"}


def conllu_block(sent_id: Column, text: Column, tokens: Column, fields: tuple[str, ...] = (), ranges: Column | None = None) -> Column:
    """Ten columns; fields: those of MORE that the tokens have. ranges: structs (first, last, form) of multi-word tokens, written before their first word."""
    cell = lambda t, name, none="_": F.coalesce(t[name].cast("string"), F.lit(none))

    def row(t: Column, i: Column) -> Column:
        line = F.concat_ws("\t", (i + 1).cast("string"), cell(t, "form"), cell(t, "lemma"), cell(t, "upos"), *(cell(t, c, none) if c in fields else F.lit(none) for c, none in MORE.items()))
        if ranges is None:
            return line
        before = F.transform(F.filter(ranges, lambda r: r["first"] == i + 1), lambda r: F.concat(F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")), F.lit("\t"), r["form"], F.lit("\t_" * 8 + "\n")))
        return F.concat(F.coalesce(F.array_join(before, ""), F.lit("")), line)

    return F.concat(F.lit("# sent_id = "), F.coalesce(sent_id, F.lit("")), F.lit("\n# text = "), F.coalesce(text, F.lit("")), F.lit("\n"), F.array_join(F.transform(tokens, row), "\n"), F.lit("\n"))


def write(sentences: DataFrame, path: str, layout: str = "basic", most: int = SENTENCES) -> None:
    """Sentences by file and place, at most so many a file. conllu: tokens may carry fields of MORE, and sentences a column ranges."""
    if layout == "basic":
        block = basic_block(F.col("sent_id"), F.col("text"), F.col("tokens"))
    else:
        names = sentences.schema["tokens"].dataType.elementType.names
        block = conllu_block(F.col("sent_id"), F.col("text"), F.col("tokens"), tuple(n for n in names if n in MORE), F.col("ranges") if "ranges" in sentences.columns else None)
    sentences.sortWithinPartitions("file", "sent_no").select(block.alias("value")).write.option("maxRecordsPerFile", most).text(path)
