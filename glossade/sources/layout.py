"""What lies where: files of a tree by name, paired by language; links to files in directory pages; manifests. All by Spark's own listing, so any store will do."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sha256

HALVES_FILE = r"^(.+?)_pregenhalves_.*\.jsonl$"
NEWS_FILE = r"news\.(\d{4})\.([A-Za-z-]+)\.shuffled\.deduped\.gz"


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, folder, size) of the files below path whose names fit glob; contents are not read. Spark's scan leaves empty files out."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return own.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.col("length").alias("size"))


def below(path: Column, root: str) -> Column:
    """The parts of a path below a folder, told by the folder's own name."""
    name = root.rstrip("/").rpartition("/")[2]
    return F.split(F.element_at(F.split(path, f"/\\Q{name}\\E/", 2), 2), "/", -1)


def languages(files: DataFrame, root: str, allowed: list[str] | None = None) -> DataFrame:
    """(lang): the folders right below root that hold files, none hidden; only allowed ones if some are given."""
    parts = below(F.col("path"), root)
    own = files.where(F.size(parts) > 1).select(parts[0].alias("lang")).where(~F.startswith("lang", F.lit("."))).distinct()
    return own.where(F.col("lang").isin(allowed)) if allowed else own


def by_language(files: DataFrame, pattern: str = HALVES_FILE, last: bool = True) -> DataFrame:
    """(lang, path): of a language's files the last by path, or the first."""
    own = files.select(F.regexp_extract("name", pattern, 1).alias("lang"), "path").where("lang != ''")
    return own.groupBy("lang").agg((F.max if last else F.min)("path").alias("path"))


def language_pairs(human: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, human, model): the first file of either side by two-letter prefix; the model is null for a language without one."""
    first = lambda files, pattern, name: by_language(files, pattern, last=False).select("lang", F.col("path").alias(name))
    a = first(human, r"^([a-z]{2})_pregenhalves_.*\.jsonl$", "human")
    b = first(model, r"^([a-z]{2})_pregenhalves_.*_generations_pos\.jsonl$", "model")
    return a.join(b, "lang", "left")


def word_tables(files: DataFrame, root: str) -> DataFrame:
    """(lang, register, model, path, summary) of las_word_<lang>.csv files that have summary_<lang>.json beside them; register and model are the folders below root."""
    tables = files.select(F.regexp_extract("name", r"^las_word_(.+)\.csv$", 1).alias("lang"), "folder", "path").where("lang != ''")
    told = files.select(F.regexp_extract("name", r"^summary_(.+)\.json$", 1).alias("lang"), "folder", F.col("path").alias("summary")).where("lang != ''")
    parts = below(F.col("path"), root)
    own = tables.join(told, ["lang", "folder"]).where(F.size(parts) >= 3)
    return own.select("lang", parts[0].alias("register"), parts[1].alias("model"), "path", "summary")


def the_file(files: DataFrame, given: str | None = None) -> str:
    """The path given, or that of the only file; an error if there are none or several."""
    if given:
        return given
    found = [r.path for r in files.select("path").limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"one file is expected, there are {'several' if found else 'none'}")
    return found[0]


def news_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(file, year, lang): the news files that directory pages link to, each once."""
    found = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(f"({NEWS_FILE})"), F.lit(1))).alias("file")).distinct()
    return found.select("file", F.regexp_extract("file", NEWS_FILE, 1).cast("int").alias("year"), F.regexp_extract("file", NEWS_FILE, 2).alias("lang"))


def folder_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(lang): folders of two or three letters that directory pages link to, each once."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([a-z]{2,3})/"'), F.lit(1))).alias("lang")).distinct()


def manifest(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(lang, year, path, bytes, lines, sha256) of {lang}/{year} files. Each file is one row while it is hashed: a file must fit a task's memory (under 2 GB). Empty files have none."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    text = F.col("content").cast("string")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    lines = ends + F.when((F.col("length") > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return own.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("lang"), F.regexp_extract("path", r"(\d{4})[^/]*$", 1).try_cast("int").alias("year"), "path", F.col("length").alias("bytes"), lines.cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))


def _part_order(name: str) -> tuple:
    """Parts that Spark wrote go by their numbers, other names as they are."""
    found = re.match(r"part-(\d+)-.*[.-]c(\d+)", name)
    return (*map(int, found.groups()), name) if found else (-1, -1, name)


def _hashed(spark: SparkSession, states: dict[str, bytes]) -> DataFrame:
    """(path, state, ends, open) of files: the state of their chains from the given ones on, how many line ends they hold, and whether their last line has none. A file is one row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                view, chain, ends = memoryview(content.as_buffer()), sha256.Chain(states[path]), 0
                for at in range(0, len(view), sha256.STEP):
                    own = bytes(view[at : at + sha256.STEP])
                    chain.update(own)
                    ends += own.count(b"\n")
                yield pa.RecordBatch.from_pylist([{"path": path, "state": chain.state(), "ends": ends, "open": bytes(view[-1:]) != b"\n"}])

    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in states]  # names, not patterns
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, state binary, ends long, open boolean")


def manifest_of_parts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(lang, path, bytes, lines, sha256) of folders of which each is one file in parts, in the order of their names (of their numbers, where Spark wrote them).

    The digest, one chain over all bytes, goes on from part to part: each job hashes the next part of every folder from the state that the job before left, so a task holds
    and reads a part, not a file. There are as many jobs as the folder with the most parts has parts; they run in this call.
    """
    parts: dict[str, list] = {}
    for r in sorted(listing(spark, path, glob).collect(), key=lambda r: (r.folder, _part_order(r.name))):
        parts.setdefault(r.folder, []).append(r)
    state, ends, unended = dict.fromkeys(parts, sha256.START), dict.fromkeys(parts, 0), {}
    for k in range(max(map(len, parts.values()), default=0)):
        own = {rows[k].path: folder for folder, rows in parts.items() if k < len(rows)}
        for r in _hashed(spark, {p: state[folder] for p, folder in own.items()}).collect():  # a row a folder
            state[own[r.path]], unended[own[r.path]] = bytes(r.state), r.open
            ends[own[r.path]] += r.ends
    rows = []
    for folder, own in parts.items():
        chain = sha256.Chain(state[folder])
        if chain.length != sum(r.size for r in own):
            raise OSError(f"parts of {folder} changed or were left out while they were hashed")
        rows.append((folder.rpartition("/")[2], folder, chain.length, ends[folder] + unended[folder], chain.hexdigest()))
    return spark.createDataFrame(rows, "lang string, path string, bytes long, lines long, sha256 string")
