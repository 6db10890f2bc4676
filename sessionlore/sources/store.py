"""The persisted fact store: runs of Parquet files behind numbered manifests.

A refresh compares the listing of the transcript files with the files it knows, and
writes one new *run*: the facts of new and changed files only, and the keys of all
files that are new, changed or gone. A run's keys take the place of the same keys in
every run before it, so a reader merges runs as it reads: a row counts unless a later
run has its key. What a refresh writes is in proportion to what changed.

*Compaction.* Runs of like size that follow one another are merged into one, as soon
as there are ``FANOUT`` of them, so there are few runs, and a row is written again
about as often as the logarithm of the store's size.

*Commits.* The last step is manifest n + 1, which is made only if it does not exist
yet. Where another refresh was first, its new runs are looked at: with other keys than
ours, our run is put on top of them; otherwise it is thrown away and the refresh
begins again. So no refresh drops what another one wrote.

*Leases.* ``facts`` leaves a small file that names its manifest and a time. Folders
that a manifest with a live lease names, or one of the last two manifests, are kept.
A reader makes its lease first and then sees whether the manifest is still there; a
cleaner removes a manifest first and then looks for leases, so one of them notices.

A file that changes while it is read is listed with its old size or time, so the next
refresh reads it again.

*Search.* Postings lie in order of stem and of level (see ``search_text``), and each run
counts its own by stem and level, less those that it replaces. Those counts, and the
numbers of messages and terms in the manifest, are exact without reading postings. Sums
of usage and tool calls by project are kept in the same way, for reports.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import search_text
from .facts import SCHEMAS, SUMS, Facts, Index, added, sums
from .files import Folder
from .shared import small_files, written
from .transcripts import facts, named, read_lines, records

MAX_AGE_S = 300
FORMAT = 3
#: Runs of like size that are merged; sizes are alike if this power of them is.
FANOUT = 4
LEASE_S = 3600
#: Folders that no manifest names are removed when they are older: their writer is gone.
ABANDONED_S = 24 * 3600
FILES = "path string, file_size long, file_mtime long"
TABLES = SCHEMAS | {"files": f"session_key long, {FILES}", "keys": "session_key long"} | {name: schema for name, (schema, _) in SUMS.items()}
#: Order of the rows in a run's files, where it lets readers skip some.
ORDER = {"postings": ("stem", "-level", "session_key"), "levels": ("stem",), "messages": ("session_key", "line_no"), "keys": ("session_key",)}
ROW_GROUP = 4 << 20


@dataclass(frozen=True)
class Run:
    folder: str
    size: int  # bytes of the transcripts in it
    messages: int  # its messages less those it replaces, and their terms
    terms: int
    of: tuple[str, ...]  # the refreshes that it holds


@dataclass(frozen=True)
class Manifest:
    version: int
    root: str
    synced_ms: int
    typical: float  # terms of a message when the first run was written
    runs: tuple[Run, ...] = field(default=())
    format: int = FORMAT

    @classmethod
    def of(cls, text: str) -> Manifest | None:
        told = json.loads(text)
        if told.get("format") != FORMAT:
            return None
        runs = tuple(Run(**(r | {"of": tuple(r["of"])})) for r in told.pop("runs"))
        return cls(**told, runs=runs)


def classify(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, status): new, changed, same or gone, from two lists of (path, file_size, file_mtime)."""
    return compared(known, seen).select("path", "status")


def compared(known: DataFrame, seen: DataFrame) -> DataFrame:
    """The same with the size and time of the files that are there; ``seen`` is read once."""
    k = known.select("path", F.struct("file_size", "file_mtime").alias("known"))
    s = seen.select("path", F.struct("file_size", "file_mtime").alias("seen"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("seen").isNull(), "gone").when(F.col("known") == F.col("seen"), "same").otherwise("changed")
    return k.join(s, "path", "full_outer").select("path", status.alias("status"), "seen.file_size", "seen.file_mtime")


def alike(runs: tuple[Run, ...]) -> tuple[int, int] | None:
    """The first and last place of runs to merge: the newest ones, back to the first that is larger than all of them."""
    tier = [int(math.log(r.size + 1, FANOUT)) for r in runs]
    first = len(runs)
    while first and (first == len(runs) or tier[first - 1] <= max(tier[first:])):
        first -= 1
    return (first, len(runs)) if len(runs) - first >= FANOUT else None


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    # Manifests

    def _versions(self) -> list[int]:
        """Numbers of all manifests, the newest first."""
        found = (re.fullmatch(r"v(\d+)\.json", n) for n in self.folder.names("manifest"))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _manifest(self, version: int) -> Manifest | None:
        text = self.folder.read(f"manifest/v{version}.json")
        return None if text is None else Manifest.of(text)

    def manifest(self) -> Manifest | None:
        """The newest manifest, or None."""
        while (versions := self._versions()):
            made = self.folder.read(f"manifest/v{versions[0]}.json")
            if made is not None:
                return Manifest.of(made)
        return None

    def _commit(self, made: Manifest) -> bool:
        return self.folder.create(f"manifest/v{made.version}.json", json.dumps(asdict(made)))

    def _next(self, before: Manifest | None, made: Manifest) -> Manifest:
        newest = self._versions()
        return replace(made, version=1 + (before.version if before else max(newest, default=0)))

    # Reading

    def facts(self, lease_s: int = LEASE_S, now_ms: int | None = None) -> Facts | None:
        """The facts of the newest manifest, whose files stay for ``lease_s`` seconds at least."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        while (now := self.manifest()) is not None:
            lease = f"leases/v{now.version}-{now_ms + lease_s * 1000}-{uuid.uuid4().hex}"
            self.folder.create(lease, "")
            if now.version in self._versions():
                return self._facts(now)
            self.folder.remove(lease)
        return None

    def _facts(self, now: Manifest) -> Facts:
        kept = {name: self._table(name, now.runs) for name in SUMS}
        index = Index(messages=sum(r.messages for r in now.runs), terms=sum(r.terms for r in now.runs), typical=now.typical, **kept)
        return Facts(**{name: self._table(name, now.runs) for name in SCHEMAS}, index=index)

    def _table(self, name: str, runs: tuple[Run, ...]) -> DataFrame:
        """Rows of all runs, without those whose key a later run has."""
        rows = self.spark.createDataFrame([], f"{TABLES[name]}, run int")
        for k, run in enumerate(runs):
            own = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{run.folder}/{name}")
            rows = own.withColumn("run", F.lit(k)) if k == 0 else rows.unionByName(own.withColumn("run", F.lit(k)))
        if name in SUMS or name == "keys" or len(runs) < 2:
            return rows.drop("run")
        keys = [self.spark.read.schema(TABLES["keys"]).parquet(f"{self.path}/{r.folder}/keys").withColumn("last", F.lit(k)) for k, r in enumerate(runs) if k]
        every = keys[0]
        for own in keys[1:]:
            every = every.unionByName(own)
        last = every.groupBy("session_key").agg(F.max("last").alias("last"))
        return rows.join(last, "session_key", "left").where("last is null or run >= last").select(*(c.split()[0] for c in TABLES[name].split(", ")))

    # Writing

    def _write(self, folder: str, name: str, rows: DataFrame) -> DataFrame:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows, order = rows.select(*columns), [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ORDER.get(name, ())]
        # Without a number of partitions, adaptive execution makes as many as the rows ask for.
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows.hint("rebalance")
        dealt.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{folder}/{name}")
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}/{name}")

    def _write_postings(self, folder: str, messages: DataFrame, typical: float | None, replaced: DataFrame | None) -> tuple[float, int, int]:
        """Postings and their counts; the typical length, and the messages and terms that are added."""
        size = lambda rows: rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        n, terms = size(messages)
        typical = typical or (terms / n if n else search_text.TYPICAL_TERMS)
        # Ranges are found in a sample of the rows, for which they would be made a second time.
        made = written(search_text.postings(messages, typical), "postings")
        counts = self._write(folder, "postings", made).groupBy("stem", "level").agg(F.count(F.lit(1)).alias("n"))
        if replaced is not None:
            lost = search_text.postings(replaced, typical).groupBy("stem", "level").agg((-F.count(F.lit(1))).alias("n"))
            counts = added("levels", counts.unionByName(lost))
            lost_n, lost_terms = size(replaced)
            n, terms = n - lost_n, terms - lost_terms
        self._write(folder, "levels", counts)
        return typical, n, terms

    def _write_sums(self, folder: str, own: Facts, replaced: Facts | None) -> None:
        """The sums of a run's facts, less those of the facts that they replace."""
        lost = {} if replaced is None else sums(replaced)
        for name, rows in sums(own).items():
            if name in lost:
                keys = SUMS[name][1]
                away = lost[name].select(*lost[name].columns[:keys], *((-F.col(c)).alias(c) for c in lost[name].columns[keys:]))
                rows = added(name, rows.unionByName(away))
            self._write(folder, name, rows)

    def _refresh(self, before: Manifest | None, root: str, run: str, glob: str, folder: int, name: str | None) -> tuple[Run, int, float] | None:
        """Write a run of what changed since ``before`` (None: everything); it, the number of files, and the typical length."""
        known = self.spark.createDataFrame([], FILES) if before is None else self._table("files", before.runs).select("path", "file_size", "file_mtime")
        seen = listing(self.spark, root, glob, **({} if name is None else {"name": name}))
        status = compared(known, seen).where("status <> 'same'").withColumn("session_key", F.xxhash64("path"))
        with small_files(self.spark):
            status.write.parquet(f"{self.path}/{run}/changes")
        changes = self.spark.read.schema(status.schema).parquet(f"{self.path}/{run}/changes")
        count, size = changes.agg(F.count(F.lit(1)), F.coalesce(F.sum("file_size"), F.lit(0))).first()
        if not count and before is not None:
            return None
        present = changes.where("status <> 'gone'")
        paths = None
        if before is not None:  # the reader takes paths as a list; it holds all that it reads on the driver in any case
            paths = [literal(r.path) for r in present.select("path").collect()]
        made = facts(records(read_lines(self.spark, root, glob=glob, paths=paths, folder=folder, name=name), whole=False))
        keys = self._write(run, "keys", changes.select("session_key"))
        self._write(run, "files", present)
        own = {name: self._write(run, name, rows) for name, rows in made.tables().items() if name != "postings"}
        messages = own["messages"]
        old = None if before is None else {name: self._table(name, before.runs).join(keys, "session_key", "left_semi") for name in own}
        replaced = None if old is None else old["messages"]
        self._write_sums(run, Facts(**own, postings=made.postings), None if old is None else Facts(**old, postings=made.postings))
        typical, n, terms = self._write_postings(run, messages, before.typical if before else None, replaced)
        return Run(run, size, n, terms, (run,)), count, typical

    def _meets(self, before: Manifest, now: Manifest, run: Run) -> bool:
        """Whether refreshes since ``before`` may have written keys of ``run``."""
        known = {x for r in before.runs for x in r.of}
        for other in now.runs:
            if set(other.of) <= known:
                continue
            if len(other.of) > 1 or now.root != before.root:
                return True
            keys = self._table("keys", (run,)).join(self._table("keys", (other,)), "session_key", "left_semi")
            if keys.limit(1).count():
                return True
        return not known <= {x for r in now.runs for x in r.of}  # another one began anew

    def sync(self, root: str, force: bool = False, now_ms: int | None = None, glob: str = "*/*.jsonl", folder: int = -2, name: str | None = None) -> int:
        """Bring the store up to date; the number of files read or dropped.

        ``glob``, ``folder`` and ``name`` are those of ``read_lines``. Files without a single record have no session
        but count as seen. Another root, or ``force``, starts from nothing.
        """
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        while True:
            before = self.manifest()
            anew = force or before is None or before.root != root
            run = f"run-{uuid.uuid4().hex}"
            made = self._refresh(None if anew else before, root, run, glob, folder, name)
            if made is None:
                self.folder.remove(run)
                if self._commit(replace(before, version=before.version + 1, synced_ms=now_ms)):
                    self.clean()
                return 0  # if another refresh was first, the store is as fresh
            own, count, typical = made
            base = before
            while True:
                runs = (own,) if anew else (*base.runs, own)
                if self._commit(self._next(base, Manifest(0, root, now_ms, typical, runs))):
                    self.compact()
                    self.clean()
                    return count
                base = self.manifest()
                if not anew and self._meets(before, base, own):
                    self.folder.remove(run)
                    break  # begin again from what the other one wrote

    def compact(self) -> None:
        """Merge runs of like size, if there are enough of them."""
        now = self.manifest()
        while now is not None and (found := alike(now.runs)) is not None:
            group = now.runs[found[0] : found[1]]
            folder = f"run-{uuid.uuid4().hex}"
            for name in TABLES:
                rows = self._table(name, group)
                if name in SUMS:
                    rows = added(name, rows)
                elif name == "keys":  # the oldest run has none to replace
                    rows = rows.distinct() if found[0] else rows.limit(0)
                self._write(folder, name, rows)
            merged = Run(folder, sum(r.size for r in group), sum(r.messages for r in group), sum(r.terms for r in group), tuple(x for r in group for x in r.of))
            while now is not None:
                names = [r.folder for r in now.runs]
                at = names.index(group[0].folder) if group[0].folder in names else None
                if at is None or tuple(now.runs[at : at + len(group)]) != group:
                    self.folder.remove(folder)  # another one merged them, or began anew
                    return
                runs = (*now.runs[:at], merged, *now.runs[at + len(group) :])
                if self._commit(replace(now, version=now.version + 1, runs=runs)):
                    break
                now = self.manifest()
            now = self.manifest()

    def clean(self, now_ms: int | None = None) -> None:
        """Remove manifests before the last two without a lease, and folders that no other one names."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms

        def leased() -> set[int]:
            live = set()
            for name in self.folder.names("leases"):
                if found := re.fullmatch(r"v(\d+)-(\d+)-\w+", name):
                    if int(found[2]) > now_ms:
                        live.add(int(found[1]))
                    else:
                        self.folder.remove(f"leases/{name}")
            return live

        seen = {v: self._manifest(v) for v in self._versions()}
        old = [v for v in sorted(seen, reverse=True)[2:] if v not in leased()]
        for v in old:
            self.folder.remove(f"manifest/v{v}.json")
        kept = leased() | set(self._versions())  # also a reader's that came in between, and newer ones
        used = {r.folder for v in kept if (m := seen.get(v) or self._manifest(v)) for r in m.runs}
        gone = {r.folder for v in old if seen[v] for r in seen[v].runs}
        for name, changed in self.folder.names().items():
            if name.startswith("run-") and name not in used and (name in gone or changed < now_ms - ABANDONED_S * 1000):
                self.folder.remove(name)

    def ensure_fresh(self, root: str, max_age_s: int = MAX_AGE_S, now_ms: int | None = None) -> Facts:
        """The facts, refreshed where they are older than ``max_age_s`` or of another root."""
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        before = self.manifest()
        if before is None or before.root != root or now_ms - before.synced_ms > max_age_s * 1000:
            self.sync(root, now_ms=now_ms)
        return self.facts()


def literal(path: str) -> str:
    """A file's path, as metadata columns show it, for a reader that expands patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def listing(spark: SparkSession, root: str, glob: str = "*/*.jsonl", name: str | None = None) -> DataFrame:
    """(path, file_size, file_mtime) of all transcript files, without reading them."""
    try:
        with small_files(spark):
            files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{glob}", **named(name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("file_mtime"))
