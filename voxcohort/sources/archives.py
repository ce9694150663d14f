"""ZIP and TAR archives as catalogs of members, and their members' bytes.

A row of the listing is an archive; tasks open it where it lies and seek, so a catalog reads directories only, and a
member is read without the rest of its archive.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import MissingRows
from .stores import opened

CATALOG = "archive string, member string, basename string, size bigint, data binary"


def _members(path: str) -> Iterator[tuple[str, int, object]]:
    """(member, size, load) of one archive; `load` is for use before the next member."""
    with opened(path) as f:
        if zipfile.is_zipfile(f):
            with zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, info.file_size, lambda info=info: z.read(info)
        else:
            f.seek(0)
            with tarfile.open(fileobj=f) as t:
                for info in t:
                    if info.isfile():
                        yield info.name, info.size, lambda info=info: t.extractfile(info).read()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "member", "basename", "size", "data"])


def _catalog(wanted: frozenset[str] | None, with_data: bool):
    def catalog(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for name, size, load in _members(path):
                    base = name.rpartition("/")[2]
                    if wanted is None or base in wanted:
                        rows.append((path, name, base, size, load() if with_data else None))
                        held += 1 + (size if with_data else 0)
                    if len(rows) >= 10_000 or held > 64 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return catalog


def members(spark: SparkSession, path: str, wanted: list[str] | None = None, with_data: bool = False) -> DataFrame:
    """(archive, member, basename, size, data) of all members, or of those whose basename is wanted."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(_catalog(frozenset(wanted) if wanted is not None else None, with_data), CATALOG)


def duplicates(catalog: DataFrame) -> DataFrame:
    """(basename, n) of basenames that occur more than once."""
    return catalog.groupBy("basename").agg(F.count("*").alias("n")).where("n > 1")


def unique(catalog: DataFrame) -> DataFrame:
    """The catalog, if no basename occurs twice."""
    if twice := duplicates(catalog).orderBy("basename").limit(5).collect():
        raise ValueError(f"duplicate members: {[r.basename for r in twice]}")
    return catalog


def missing(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted basenames that no archive has, or only as empty members."""
    return wanted.join(catalog.where("size > 0"), "basename", "left_anti")


def complete(catalog: DataFrame, wanted: DataFrame, shown: int = 20) -> DataFrame:
    """Members of the catalog that are wanted; an error names those that are missing."""
    lost = [r.basename for r in missing(catalog, wanted).orderBy("basename").limit(shown + 1).collect()]
    if lost:
        raise MissingRows(f"missing members: {', '.join(lost[:shown])}{', ...' if len(lost) > shown else ''}")
    return catalog.join(wanted.select("basename").distinct(), "basename", "left_semi")


def lesion_masks(catalog: DataFrame) -> DataFrame:
    """(patient_id, phase, lesion, archive, member) of members named by them; the first of equal basenames wins."""
    pattern = r"/(\d+)_(\d+)_(\d+)_tumor_seg\.nrrd$"  # fixed value: the release's naming
    path = F.concat(F.lit("/"), "member")
    rows = catalog.where(path.rlike(pattern)).groupBy("basename").agg(F.min(F.struct("archive", "member")).alias("f"))
    at = F.concat(F.lit("/"), "f.member")
    return rows.select(*[F.regexp_extract(at, pattern, i + 1).alias(c) for i, c in enumerate(("patient_id", "phase", "lesion"))], "f.archive", "f.member")


POINTERS = "kind string, path string, archive string, member string"
LOADED = "name string, source string, size bigint, data binary, problem string"


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plain(path: str) -> bytes:
        with opened(path) as f:
            return f.read()

    def inside(path: str, names: list[str], by_name: bool) -> dict[str, bytes]:
        """The members' bytes, in one pass; of a TAR, a name that it lacks is looked for by its last part."""
        whole, parts, found = set(names), {n.rpartition("/")[2]: n for n in names} if by_name else {}, {}
        for member, _, load in _members(path):
            if member in whole:
                found[member] = load()
            elif (name := parts.get(member.rpartition("/")[2])) is not None and name not in found:
                found.setdefault(name, load())
        return found

    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    for batch in batches:
        for row in batch.to_pylist():
            names, out = [m["member"] for m in row["members"]], []
            try:
                held = {None: plain(row["place"])} if row["kind"] == "path" else inside(row["place"], names, row["kind"] == "tar") if row["kind"] in ("zip", "tar") else None
                problem = None if held is not None else f"unsupported kind {row['kind']}"
            except (OSError, zipfile.BadZipFile, tarfile.TarError) as e:
                held, problem = {}, str(e)
            for m in row["members"]:
                data = (held or {}).get(m["member"])
                wrong = problem or ("missing" if data is None else "empty" if not data else None)
                source = row["place"] if m["member"] is None else f"{row['place']}!{m['member']}"
                out.append((m["name"], source, len(data or b""), None if wrong else data, wrong))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["name", "source", "size", "data", "problem"])


def materialised(pointers: DataFrame, strict: bool = True) -> DataFrame:
    """(name, source, size, data, problem) of source pointers (name, kind: path, zip or tar, path, archive, member).

    An archive is passed once for all of its members. Missing and empty sources are problems; with `strict` they raise.
    """
    place = F.when(F.col("kind") == "path", F.col("path")).otherwise(F.col("archive"))
    jobs = pointers.select("kind", place.alias("place"), F.struct("name", F.when(F.col("kind") != "path", F.col("member")).alias("member")).alias("m"))
    grouped = jobs.groupBy("kind", "place").agg(F.collect_list("m").alias("members"))  # members of an archive
    out = grouped.mapInArrow(_load, LOADED)
    if strict and (bad := out.where("problem is not null").select("source", "problem").limit(5).collect()):
        raise MissingRows(f"sources cannot be read: {[tuple(r) for r in bad]}")
    return out
