"""One commit over several relations: all of its rows are seen, or none.

A commit writes its rows as Parquet beside the others, then publishes a manifest that names all files of all relations, under
the next number, by one rename that fails where the number is taken. Whoever reads sees the newest manifest. A run that dies
before the rename leaves files that no manifest names; of two commits on one base, the second one raises ``Moved``.
The folder lies in any store that Spark reads, with a rename that does not replace (HDFS, local disks).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mutations as M


class Moved(RuntimeError):
    """Somebody else has committed since the base was read."""


class Ledger:
    """Relations that change together, in one folder; only commits number 1 and up exist."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path("commits"))

    def head(self) -> int:
        """The number of the newest commit, 0 before the first."""
        names = (f.getPath().getName() for f in self._files.listStatus(self._path("commits")))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, number: int | None = None) -> dict:
        """{relation: {schema, parts}} of a commit, of the newest one without a number."""
        number = self.head() if number is None else number
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{number:012d}", wholetext=True).first()[0]) if number else {}

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A relation's rows with ``commit``, the number of the commit that wrote each one, or of the last one merged with it."""
        entry = self.manifest(number)[name]
        return self._rows(entry, entry["parts"])

    def _rows(self, entry: dict, parts: list[str]) -> DataFrame:
        # the number is a partition of the path, so a filter on it opens only its files
        paths = [f"{self.folder}/rows/{p}" for p in parts]
        return self.spark.read.option("basePath", f"{self.folder}/rows").schema(f"{entry['schema']}, relation string, batch string, commit long").parquet(*paths).drop("relation", "batch")

    def newest(self, name: str, keys: list[str], number: int | None = None) -> DataFrame:
        """A relation whose rows replace earlier ones of their keys, as it stands."""
        return self._last(self.read(name, number), keys)

    def _last(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "commit")]
        last = rows.groupBy(keys).agg(F.max_by(F.struct(*rest), "commit").alias("row"))
        return last.select(*keys, *(f"row.{c}" for c in rest))

    def upto(self) -> int:
        """The number of the last micro-batch that a stream has committed here, -1 before the first."""
        return max((e.get("upto", -1) for e in self.manifest().values()), default=-1)

    def commit(self, base: int, replace: bool = False, upto: int | None = None, **rows: DataFrame) -> int:
        """Adds rows to relations, or puts them in the place of all there are; returns the commit's number.

        ``base`` is the commit that the rows were made from, ``upto`` the micro-batch that made them. A relation keeps its first columns and types; rows without one of them, or of another type, raise an error
        before anything is written.
        """
        number, batch, entries = base + 1, uuid.uuid4().hex, self.manifest(base)
        planned = {}
        for name, df in rows.items():
            schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
            if name in entries and entries[name]["schema"] != schema:
                raise ValueError(f"{name} has {entries[name]['schema']}, not {schema}")
            part = f"relation={name}/batch={batch}/commit={number}"
            old = entries.get(name, {"parts": [], "levels": []})
            parts, levels = ([part], [max(old["levels"], default=0)]) if replace else (old["parts"] + [part], old["levels"] + [0])
            planned[name] = old | {"schema": schema, "parts": parts, "levels": levels} | ({} if upto is None else {"upto": upto})
        for name, df in rows.items():
            df.write.parquet(f"{self.folder}/rows/{planned[name]['parts'][-1]}")
        self._publish(number, json.dumps(entries | planned))
        return number

    def compacted(self, name: str, keys: list[str]) -> int:
        """A commit that leaves one row a key, so that reading costs what the state costs, not its history."""
        base = self.head()
        return self.commit(base, replace=True, **{name: self.newest(name, keys, base)})

    def merged(self, name: str, keys: list[str], fan: int = 8) -> int:
        """Merges the newest parts of a relation whose rows replace earlier ones, wherever ``fan`` of one size have come together.

        A part of the next size takes their place, so each row is written again about log(parts) times, and a reader
        opens at most ``fan`` parts of each size, whatever the history. Returns the newest commit.
        """
        while True:
            base = self.head()
            entries = self.manifest(base)
            parts, levels = entries[name]["parts"], entries[name]["levels"]
            run = next((n for n, level in enumerate(reversed(levels)) if level != levels[-1]), len(levels))
            if run < fan:
                return base
            # the place of the last one among the parts that stay
            part = f"relation={name}/batch={uuid.uuid4().hex}/{parts[-1].rsplit('/', 1)[1]}"
            self._last(self._rows(entries[name], parts[-run:]), keys).write.parquet(f"{self.folder}/rows/{part}")
            entry = entries[name] | {"parts": parts[:-run] + [part], "levels": levels[:-run] + [levels[-1] + 1]}
            self._publish(base + 1, json.dumps(entries | {name: entry}))

    def cleaned(self, keep: int = 2) -> None:
        """Deletes all but the newest ``keep`` commits, and the rows that only those name; who still reads an older commit loses it.

        Rows that no commit names are left alone, since somebody may be about to commit them.
        """
        head = self.head()
        old = sorted(int(n) for n in (f.getPath().getName() for f in self._files.listStatus(self._path("commits"))) if n.isdigit() and int(n) <= head - keep)
        named = lambda n: {p for e in self.manifest(n).values() for p in e["parts"]}
        stay = set().union(*(named(n) for n in range(max(head - keep, 0) + 1, head + 1)))
        for number in old:
            for part in named(number) - stay:
                self._files.delete(self._path(f"rows/{part.rsplit('/', 1)[0]}"), True)
            self._files.delete(self._path(f"commits/{number:012d}"), False)

    def _publish(self, number: int, text: str) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, final = self._path(f"commits/draft-{uuid.uuid4().hex}"), self._path(f"commits/{number:012d}")
        out = self._files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self._context.rename(draft, final, how)
        except Exception as error:
            self._files.delete(draft, False)
            if self._files.exists(final):
                raise Moved(f"commit {number} of {self.folder} exists") from error
            raise


def restored(ledger: Ledger, versions: DataFrame, chosen: DataFrame) -> int:
    """Restores chosen versions (map_id, version_id, user_id), one a map, in one commit: backups and records, current states, audit rows.

    ``versions`` has (id, map_id, created_at, encoded); live states are the ledger's ``current`` (map_id, encoded). A version that is
    not the map's writes nothing.
    """
    base = ledger.head()
    live = ledger.newest("current", ["map_id"], base)
    asked = chosen.select("map_id", "version_id", "user_id")
    steps = M.restore_plan(versions, live, asked.select("map_id", "version_id"))
    by = asked.select("map_id", "user_id")
    record = steps.where("type <> 'current'").join(by, "map_id").select("map_id", "user_id", "type", "label", "encoded", "size")
    found = asked.join(versions.select(F.col("id").alias("version_id"), "map_id", "created_at"), ["version_id", "map_id"])
    audit = M.audited(found, "restore-version", versionId=F.col("version_id"), restoredFrom=F.col("created_at"))
    return ledger.commit(base, versions=record, current=steps.where("type = 'current'").select("map_id", "encoded"), audit=audit)


def saved_by_hand(ledger: Ledger, states: DataFrame) -> int:
    """Saves states (map_id, user_id, label, encoded) as versions by hand in one commit: versions, current states, audit rows."""
    label = F.when(F.coalesce("label", F.lit("")) == "", F.concat(F.lit("Manual save "), F.col("map_id").cast("string"))).otherwise(F.col("label"))
    named = states.withColumn("label", label)
    size = M.payload_size(F.col("encoded"))
    record = named.select("map_id", "user_id", F.lit("manual").alias("type"), "label", "encoded", size.alias("size"))
    audit = M.audited(named, "save-version", label=F.col("label"))
    return ledger.commit(ledger.head(), versions=record, current=named.select("map_id", "encoded"), audit=audit)
