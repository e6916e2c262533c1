"""Month-partitioned datasets whose writes become visible all at once.

Every write puts the new content of the months it touches into a folder of its own, then commits
a manifest: a small file that names, for each month, the folder that holds it. Readers take the
newest manifest, so a write that stops half-way changes nothing for them, and a reader keeps
its version while others write. Two writers cannot commit the same version: the later one looks
whether its months changed meanwhile, and only then computes them again.

    <path>/data/commit=<id>/year=YYYY/month=MM/*.parquet
    <path>/manifests/<version>.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from quantspark.session import drop_folder
from quantspark.sources.sinks import upserted, with_month, write_partitioned

Month = tuple[int, str]
PARTS = ["year", "month"]


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Manifest:
    """The folder of every month, and the columns; version 0 is the dataset before its first write."""

    version: int = 0
    months: dict[Month, str] = field(default_factory=dict)
    schema: str | None = None

    def text(self) -> str:
        rows = [[y, m, folder] for (y, m), folder in sorted(self.months.items())]
        return json.dumps({"version": self.version, "months": rows, "schema": json.loads(self.schema or "null")})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {(y, m): folder for y, m, folder in d["months"]}, json.dumps(d["schema"]))


class Dataset:
    """A dataset under ``path``; ``day`` is its date column, ``keys`` identify a row."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], day: str = "trade_date"):
        self.spark, self.path, self.keys, self.day = spark, path.rstrip("/"), list(keys), day

    # -- manifests --------------------------------------------------------------

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        folder, files = self._file("manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self, name: str) -> Manifest:
        path, files = self._file(f"manifests/{name}")
        stream = files.open(path)
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The newest committed version."""
        names = self._names()
        return self._read(names[-1]) if names else Manifest()

    def commit(self, new: Manifest) -> None:
        """Makes ``new`` the current version; raises ``Conflict`` if that version exists already.

        The file is written beside and renamed, which the file system does at once and refuses
        where the name is taken.
        """
        text = new.text()
        draft, files = self._file(f"manifests/.draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._file(f"manifests/{new.version:012d}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {new.version} of {self.path} was committed by another writer")

    # -- reading ----------------------------------------------------------------

    def rows(self, manifest: Manifest | None = None, months: Iterable[Month] | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default), with ``year`` and ``month``; None before the first write.

        With ``months``, only their folders are listed and read.
        """
        manifest = manifest or self.manifest()
        if manifest.schema in (None, "null"):
            return None
        schema = StructType.fromJson(json.loads(manifest.schema))
        wanted = manifest.months if months is None else {m: manifest.months[m] for m in months if m in manifest.months}
        full = StructType.fromJson(schema.jsonValue()).add("commit", StringType()).add("year", IntegerType()).add("month", StringType())
        if not wanted:
            return self.spark.createDataFrame([], full).drop("commit")
        folders = [f"{self.path}/data/commit={folder}/year={y}/month={m}" for (y, m), folder in sorted(wanted.items())]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*folders).drop("commit")

    def between(self, start, end) -> DataFrame | None:
        """Rows of a date range; folders of other months are not opened."""
        manifest = self.manifest()
        months = [m for m in manifest.months if (start.year, f"{start.month:02d}") <= m <= (end.year, f"{end.month:02d}")]
        rows = self.rows(manifest, months)
        return None if rows is None else rows.where(F.col(self.day).between(start, end))

    # -- writing ----------------------------------------------------------------

    def _replace(self, touched: Sequence[Month], make: Callable[[Manifest], DataFrame]) -> Manifest:
        """Writes the new content of ``touched`` and commits it; computes it again only if they changed meanwhile."""
        base = self.manifest()
        folder, rows = None, None
        while True:
            if folder is None:
                folder, rows = uuid.uuid4().hex, make(base)
                write_partitioned(rows, f"{self.path}/data/commit={folder}", "errorifexists", PARTS, sort=self.keys)
            kept = {m: f for m, f in base.months.items() if m not in set(touched)}
            # a month left without a row has no folder
            held = self.spark.read.schema("year int, month string").parquet(f"{self.path}/data/commit={folder}").distinct().collect()  # months only
            months = {**kept, **{(r["year"], r["month"]): folder for r in held}}
            schema = StructType([f for f in rows.schema if f.name not in PARTS])
            new = Manifest(base.version + 1, months, schema.json())
            try:
                self.commit(new)
                return new
            except Conflict:
                now = self.manifest()
                if any(now.months.get(m) != base.months.get(m) for m in touched) or now.schema != base.schema:
                    drop_folder(self.spark, f"{self.path}/data/commit={folder}")
                    folder = None
                base = now

    def upsert(self, batch: DataFrame) -> Manifest:
        """Adds the rows of ``batch``, which replace those of the same keys; a key stands once afterwards.

        Only the months that the batch has rows of are read and written. Columns that either side
        lacks are null there.
        """
        batch = with_month(batch, self.day).where(F.col(self.day).isNotNull())
        touched = [(r["year"], r["month"]) for r in batch.select(*PARTS).distinct().collect()]  # months only
        if not touched:
            return self.manifest()

        def make(base: Manifest) -> DataFrame:
            old = self.rows(base, touched)
            return upserted(batch.limit(0) if old is None else old, batch, self.keys)

        return self._replace(touched, make)

    def drop_months(self, months: Sequence[Month]) -> Manifest:
        """A version without these months; their files stay for readers of older versions."""
        while True:
            base = self.manifest()
            new = Manifest(base.version + 1, {m: f for m, f in base.months.items() if m not in set(months)}, base.schema)
            try:
                self.commit(new)
                return new
            except Conflict:
                continue

    def vacuum(self, versions: int = 1) -> list[str]:
        """Deletes the folders that none of the newest ``versions`` names, and older manifests; returns the folders.

        Meant for times without writers, whose folders are not committed yet.
        """
        names = self._names()
        kept = {f for n in names[-versions:] for f in self._read(n).months.values()}
        for name in names[:-versions]:
            drop_folder(self.spark, f"{self.path}/manifests/{name}")
        folder, files = self._file("data")
        if not files.exists(folder):
            return []
        found = [s.getPath().getName().removeprefix("commit=") for s in files.listStatus(folder)]
        gone = sorted(f for f in found if f not in kept)
        for f in gone:
            drop_folder(self.spark, f"{self.path}/data/commit={f}")
        return gone
