"""Folders as tables.

Spark's file readers leave out files of no bytes, and empty captions matter here, so
folders are listed by a data source of our own and content is joined to the list.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..constants import CAPTION_SUFFIXES, CLIP_SUFFIXES, REFERENCE_SUFFIXES
from ..functions.text import concept_type
from ..operators.pairing import with_roles

SCHEMA = "path string, folder string, name string, stem string, suffix string, length bigint"


#: Tasks that list one folder, unless an option says otherwise.
PARTS = 8


@dataclass(frozen=True)
class Wanted:
    """What a filter leaves of the files: None is any."""

    suffixes: frozenset[str] | None = None
    names: frozenset[str] | None = None
    stems: frozenset[str] | None = None

    def narrowed(self, column: str, values: frozenset[str]) -> Wanted:
        held = getattr(self, column)
        return replace(self, **{column: values if held is None else held & values})

    def has(self, name: str) -> bool:
        stem, suffix = os.path.splitext(name)
        return all(held is None or value in held for held, value in ((self.names, name), (self.stems, stem), (self.suffixes, suffix.lower())))


def entries(folder: str, part: int = 0, parts: int = 1, wanted: Wanted = Wanted()) -> Iterator[tuple]:
    """The files of a folder whose names fall to this part by a hash, in the order of names.
    Names that aren't wanted cost no call to the file system beyond the listing."""
    base = os.path.basename(os.path.abspath(folder))
    for e in sorted((e for e in os.scandir(folder) if zlib.crc32(os.fsencode(e.name)) % parts == part and wanted.has(e.name)), key=lambda e: e.path):
        if e.is_file():
            stem, suffix = os.path.splitext(e.name)
            yield (os.path.abspath(e.path), base, e.name, stem, suffix.lower(), e.stat().st_size)


class FolderReader(DataSourceReader):
    PUSHED = {"suffix": "suffixes", "name": "names", "stem": "stems"}

    def __init__(self, folders: list[str], parts: int):
        self.folders, self.parts, self.wanted = folders, parts, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes = and IN on suffix, name and stem; gives back the others."""
        for f in filters:
            column = self.PUSHED.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column is None:
                yield f
            else:
                self.wanted = self.wanted.narrowed(column, frozenset([f.value] if isinstance(f, EqualTo) else f.value))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((f, i)) for f in self.folders for i in range(self.parts)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            folder, part = partition.value
            yield from entries(folder, part, self.parts, self.wanted)


class FolderSource(DataSource):
    """format("folder").load(path): files of a folder; option depth=1 for those of its
    sub-folders. Option parts: tasks for each folder, between which its names are dealt by a
    hash. Equality and IN on suffix, name and stem are pushed into the listing."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        root, depth = self.options["path"], int(self.options.get("depth", "0"))
        parts = int(self.options.get("parts", str(PARTS if depth == 0 else 1)))
        if depth == 0:
            return FolderReader([root] if os.path.isdir(root) else [], parts)
        return FolderReader(sorted(e.path for e in os.scandir(root) if e.is_dir()), parts)


def files(spark: SparkSession, path: str, depth: int = 0, suffixes: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Files of a folder. Lets Spark push filters into data sources written in Python, which it
    doesn't by itself."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("folder").option("depth", str(depth))
    rows = (reader if parts is None else reader.option("parts", str(parts))).load(path)
    return rows if suffixes is None else rows.where(F.col("suffix").isin(suffixes))


def clips(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, suffixes=CLIP_SUFFIXES)


def is_hierarchical(path: str) -> bool:
    return os.path.isdir(os.path.join(path, "training", "targets"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Files of a dataset folder, flat or hierarchical, with role and source. Which it is
    depends on the folder itself, wherever that is."""
    if not is_hierarchical(path):
        rows = with_roles(files(spark, path))
    else:
        rows = None
        for only, *parts in (("target", "targets"), ("caption", "signals", "captions"), ("reference", "signals", "references")):
            one = with_roles(files(spark, os.path.join(path, "training", *parts)), only)
            rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("source", F.lit(os.path.abspath(path)))


def any_case(suffixes: list[str]) -> str:
    """A glob for names that end so, in either case of letters."""
    each = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*" + (each[0] if len(each) == 1 else "{" + ",".join(each) + "}")


def content(spark: SparkSession, path: str, name: str = "content", suffixes: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """path, content of the files under a folder that have bytes; join it to a list. Files of
    other suffixes are not opened."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if suffixes is not None:
        reader = reader.option("pathGlobFilter", any_case(suffixes))
    rows = reader.load(path)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("content").alias(name))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, content of the caption files of a folder, those without bytes too. No
    other file is read."""
    rows = files(spark, path, suffixes=CAPTION_SUFFIXES)
    texts = content(spark, path, suffixes=CAPTION_SUFFIXES, recursive=False)
    return rows.join(texts, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """name, concept_type, image_path, folder_name, ref_order of reference images in
    sub-folders; files beside the sub-folders are passed over."""
    rows = files(spark, path, depth=1, suffixes=REFERENCE_SUFFIXES)
    return rows.select(F.col("stem").alias("name"), concept_type(F.col("folder")).alias("concept_type"), F.col("path").alias("image_path"), F.col("folder").alias("folder_name"), F.struct("folder", "name").alias("ref_order"))


def heads(files: DataFrame, column: str, n: int = 16) -> DataFrame:
    """column, head: the first bytes of each file of a column of paths, null if it can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch[column]:
                try:
                    with open(path, "rb") as f:
                        out.append((path, f.read(n)))
                except OSError:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=[column, "head"])

    return files.select(column).dropna().distinct().mapInPandas(run, f"`{column}` string, head binary")


def references(path: str) -> str | None:
    """The folder of a dataset's references, null if it isn't there."""
    at = os.path.join(path, "training", "signals", "references") if is_hierarchical(path) else path
    return at if os.path.isdir(at) else None


#: The first bytes of media files, in hex, and where they stand.
MAGIC = {
    "target": [("66747970", 4), ("1A45DFA3", 0), ("52494646", 0), ("000001BA", 0), ("000001B3", 0), ("3026B275", 0), ("464C56", 0), ("47", 0)],
    "reference": [("89504E47", 0), ("FFD8FF", 0), ("52494646", 0), ("424D", 0), ("49492A00", 0), ("4D4D002A", 0)],
}


def looks_like(head: Column, role: str) -> Column:
    """Whether the first bytes fit the role; null if they are no format that is known,
    which then isn't judged."""
    fits = lambda pairs: [F.startswith(F.hex(F.substring(head, at + 1, 8)), F.lit(h)) for h, at in pairs]
    any_of = lambda cs: F.exists(F.array(*cs), lambda x: x)
    known = any_of([c for pairs in MAGIC.values() for c in fits(pairs)])
    return F.when(known, any_of(fits(MAGIC[role])))
