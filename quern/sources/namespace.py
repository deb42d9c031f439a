"""Durable namespaces: an append-only mutation log over compacted Parquet segments.

Layout of a namespace below the engine's root (any Hadoop file system whose
exclusive create is atomic, as that of HDFS, ABFS and local files is; on S3A one
writer at a time is safe, several are not)::

    state/000000000007.json   the states; the greatest number is the current one
    log/<uuid>/               Parquet of one write, and _state.json, the state that it meant to commit
    segment/<uuid>/           Parquet of one segment, by cluster_id where it is the vector index
    text/<uuid>/              postings of an attribute

A write first writes its log folder, then the next state file by an exclusive
create, which is the commit; only folders that a state names count, so a loser of
the race, which reads again, or a dead writer harms nobody.

A mutation row holds `_seq`, `_phase` and `_pos` (its version), `_op` (U upsert,
P patch, D delete), the key, `_present` (attributes that a patch names) and the
attributes.  Folded by key, a key lives if its newest upsert or delete is an
upsert, and the newest value of an attribute is that of the newest row that sets
it: a patch that names it, or an upsert or delete, which set all.  So a fold is
one aggregation by key, combined before the shuffle.

Segments: the bottom one (level 2) has live rows only; upper ones (levels 0 and
1) hold the keys that changed in a range of the log, folded, with a tombstone
where the key died.  A snapshot is the bottom segment without the keys that
changed above it, and the fold of those.  Indexing adds an upper segment of what
changed; TRIGGER of one level are merged into the next, so rows are rewritten a
logarithmic number of times.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.filters import Compiler, attributes
from quern.functions.textproc import Fts
from quern.functions.vectors import decode_vector
from quern.operators import ann, text_rank
from quern.plans.query import Collection

NAME = re.compile(r"[A-Za-z0-9\-_.]{1,128}")
MOST_DELETED, MOST_PATCHED = 5_000_000, 500_000
STALE_SECONDS, TAIL_BYTES, UNINDEXED_BYTES = 60, 128 << 20, 2 << 30
#: Segments of a level that are merged; changed keys sent to all executors; seconds that unused files are kept; seconds that request ids are kept.
TRIGGER, BROADCAST_KEYS, RETENTION, REPLAY_SECONDS = 4, 1 << 20, 24 * 3600.0, 300.0
_META = ("_seq", "_phase", "_pos", "_op", "_present", "_dead", "cluster_id")


class NamespaceError(ValueError):
    """The namespace or request is not valid."""


class Conflict(RuntimeError):
    """Another writer committed first, twice."""


class Backpressure(RuntimeError):
    """Too much of the log is not compacted."""


class IndexRebuilding(RuntimeError):
    """An index that the query needs is being rebuilt."""


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise NamespaceError(f"no namespace name: {name!r}")
    return name


def check_attribute(name: str) -> str:
    if not name or len(name.encode()) > 128 or name.startswith("$") or name in _META:
        raise NamespaceError(f"no attribute name: {name!r}")
    return name


@dataclass
class State:
    version: int = 0
    head: int = 0
    indexed: int = 0
    segments: list = field(default_factory=list)  # oldest first: path, level, hi, rows, dead, bytes; the bottom one's vectors: centroids; texts: {attribute: path, docs, length}
    log: dict = field(default_factory=dict)  # sequence number: path, bytes, U, P, D, once (all of one phase)
    schema: dict = field(default_factory=dict)
    key_type: str = "bigint"
    fts: dict = field(default_factory=dict)
    regex: list = field(default_factory=list)
    metric: str | None = None
    dims: int | None = None
    pending: list = field(default_factory=list)
    requests: dict = field(default_factory=dict)  # request id: time, result
    deleted: bool = False
    created: float = 0.0
    updated: float = 0.0

    @property
    def key_sql(self) -> str:
        return "string" if self.key_type == "uuid" else self.key_type

    def sizes(self) -> dict[str, int]:
        return {k: v["bytes"] for k, v in self.log.items()}

    @property
    def unindexed(self) -> int:
        return sum(v["bytes"] for k, v in self.log.items() if int(k) > self.indexed)


class Files:
    """The few file operations that commits need, on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Create a file with this content; False if there is one already."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(p):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def drop(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def age(self, path: str) -> float:
        """Seconds since a path was last written."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


def fold(log: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Live rows (key, attributes) of a mutation log, in one aggregation by key."""
    return _newest_of(log, key, attributes).where("_last = 'U'").drop("_last")


def changed(log: DataFrame, key: str, attributes: list[str], after: int) -> DataFrame:
    """The keys with a mutation after a sequence number, folded over all of the log: attributes, null where `_dead`; in the same one aggregation."""
    rows = _newest_of(log, key, attributes, F.max(F.col("_seq") > after).alias("$in")).where("`$in`")
    live = F.coalesce(F.col("_last") == "U", F.lit(False))
    return rows.select(key, *[F.when(live, F.col(f"`{a}`")).alias(a) for a in attributes], (~live).alias("_dead"))


def _newest_of(log: DataFrame, key: str, attributes: list[str], *more: Column) -> DataFrame:
    version = F.struct("_seq", "_phase", "_pos")
    whole = F.col("_op") != "P"
    newest = [F.max_by(F.struct(F.col(f"`{a}`").alias("v")), F.when(whole | F.array_contains("_present", a), version))["v"].alias(a) for a in attributes]
    return log.groupBy(key).agg(F.max_by("_op", F.when(whole, version)).alias("_last"), *newest, *more)


@dataclass
class WriteResult:
    seq: int = 0
    upserted: int = 0
    patched: int = 0
    deleted: int = 0
    remaining: bool = False

    @property
    def affected(self) -> int:
        return self.upserted + self.patched + self.deleted


class Engine:
    """Namespaces below a root folder; one committing driver at a time is meant, others lose races cleanly."""

    def __init__(self, spark: SparkSession, root: str, strict_rebuild_gating: bool = False, allow_dot_product: bool = False):
        self.spark, self.root, self.strict, self.dot = spark, root.rstrip("/"), strict_rebuild_gating, allow_dot_product
        self.files = Files(spark)
        self.seen: dict[str, tuple[float, State]] = {}
        self.warmed: dict[str, tuple[int, DataFrame]] = {}

    # -- states

    def path(self, ns: str, *parts: str) -> str:
        return "/".join([self.root, check_name(ns), *parts])

    def _newest(self, ns: str) -> State | None:
        names = self.files.names(self.path(ns, "state"))
        for attempt in range(20):
            if not names:
                return None
            text = self.files.read(self.path(ns, "state", names[-1]))
            if text.endswith("}"):
                return State(**json.loads(text))
            time.sleep(0.1)  # its writer is between create and close
        raise Conflict(f"the last commit of {ns!r} is not whole; repair() it")

    def state(self, ns: str) -> State:
        state = self._newest(ns)
        if state is None:
            raise NamespaceError(f"there is no namespace {ns!r}")
        if state.deleted:
            raise NamespaceError(f"namespace {ns!r} is deleted")
        return state

    def _load(self, ns: str) -> State:
        state = self._newest(ns) or State(created=time.time())
        if state.deleted:
            raise NamespaceError(f"namespace {ns!r} is deleted")
        return state

    def _commit(self, ns: str, state: State) -> bool:
        state.version += 1
        state.updated = time.time()
        return self.files.create(self.path(ns, "state", f"{state.version:012d}.json"), json.dumps(asdict(state)))

    def namespaces(self, prefix: str = "", cursor: str = "", page_size: int = 100) -> tuple[list[str], str | None]:
        """A page of names in order, and the cursor of the next page; states are read as far as the page goes."""
        if not 0 < page_size <= 1000:
            raise NamespaceError("a page has between 1 and 1000 names")
        out: list[str] = []
        for n in self.files.names(self.root):
            if n.startswith(prefix) and n > cursor and not self._gone(n):
                if len(out) == page_size:
                    return out, out[-1]
                out.append(n)
        return out, None

    def _gone(self, ns: str) -> bool:
        state = self._newest(ns)
        return state is None or state.deleted

    def metadata(self, ns: str) -> dict:
        """Schema, index status, and counts as the manifests have them, so rows of repeated keys in the tail count each."""
        s = self.state(ns)
        rows = sum(x["rows"] - 2 * x["dead"] if x["level"] < 2 else x["rows"] for x in s.segments) + sum(v["U"] - v["D"] for k, v in s.log.items() if int(k) > s.indexed)
        return {
            "schema": {k: {"type": v, "full_text_search": s.fts.get(k, False), "regex": k in s.regex} for k, v in s.schema.items()},
            "approx_row_count": max(rows, 0), "approx_logical_bytes": sum(x["bytes"] for x in s.segments) + s.unindexed, "created_at": s.created, "updated_at": s.updated,
            "index": {"status": "up-to-date" if s.indexed == s.head else "updating", "unindexed_bytes": s.unindexed, "head": s.head, "indexed": s.indexed, "pending": s.pending},
        }

    def delete(self, ns: str, purge: bool = False) -> None:
        s = self.state(ns)
        s.deleted = True
        if not self._commit(ns, s):
            raise Conflict(ns)
        if purge:
            self.files.drop(self.path(ns))

    # -- reads

    def _schema(self, s: State) -> T.StructType:
        fields = [T.StructField("id", T._parse_datatype_string(s.key_sql))]
        return T.StructType(fields + [T.StructField(k, T._parse_datatype_string(v)) for k, v in s.schema.items()])

    def log(self, ns: str, after: int = 0, upto: int | None = None, state: State | None = None) -> DataFrame:
        """Mutations of the sequence numbers (after, upto], as far as they are not vacuumed; only their folders are listed."""
        s = state or self.state(ns)
        upto = s.head if upto is None else min(upto, s.head)
        meta = "_seq long, _phase int, _pos long, _op string, _present array<string>"
        schema = T.StructType([*T._parse_datatype_string(meta).fields, *self._schema(s).fields])
        paths = [v["path"] for k, v in s.log.items() if after < int(k) <= upto]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bottom(self, s: State) -> dict | None:
        return next((x for x in s.segments if x["level"] == 2), None)

    def _rows(self, s: State, segment: dict, cluster: bool = False) -> DataFrame:
        schema = self._schema(s)
        extra = [T.StructField("_dead", T.BooleanType())] if segment["level"] < 2 else [T.StructField("cluster_id", T.IntegerType())] if cluster else []
        schema = T.StructType([*schema.fields, *extra])
        return self.spark.read.schema(schema).parquet(segment["path"]).select(schema.names)

    def _mutations(self, df: DataFrame, s: State, seq: int, dead: Column | None = None) -> DataFrame:
        """Rows of a segment as mutations of the version `seq`."""
        op = F.lit("U") if dead is None else F.when(dead, "D").otherwise("U")
        meta = [F.lit(seq).cast("long").alias("_seq"), F.lit(-1).alias("_phase"), F.lit(0).cast("long").alias("_pos"), op.alias("_op"), F.array().cast("array<string>").alias("_present")]
        return df.select(*meta, *[F.col(f"`{n}`") for n in self._schema(s).names])

    def _changes(self, ns: str, s: State, lowest: int = 0) -> tuple[DataFrame | None, int]:
        """(mutations above the bottom segment, how many); patches of the log come with the bottom's rows of their keys."""
        upper = [x for x in s.segments if x["level"] < 2]
        after = max(s.indexed, lowest)
        tail = {k: v for k, v in s.log.items() if after < int(k) <= s.head}
        many = sum(x["rows"] for x in upper) + sum(v["U"] + v["P"] + v["D"] for v in tail.values())
        if not upper and not tail:
            return None, 0
        out = self.log(ns, after, s.head, s)
        for x in upper:
            rows = self._rows(s, x)
            out = out.union(self._mutations(rows, s, x["hi"], F.col("_dead")))
        bottom = self._bottom(s)
        if bottom and any(v["P"] for v in tail.values()):
            keys = self._keys(out.where("_op = 'P'"), many)
            out = out.union(self._mutations(self._rows(s, bottom).join(keys, "id", "left_semi"), s, 0))
        return out, many

    def _live(self, s: State, changes: DataFrame, lowest: int = 0) -> DataFrame:
        """The fold of changes; where these are one write's upserts alone, each key is there once and nothing is shuffled."""
        tail = [v for k, v in s.log.items() if max(s.indexed, lowest) < int(k) <= s.head]
        if not s.segments and len(tail) == 1 and tail[0].get("once") and tail[0]["U"]:
            return changes.select("id", *[F.col(f"`{n}`") for n in s.schema])
        return fold(changes, "id", list(s.schema))

    @staticmethod
    def _keys(changes: DataFrame, many: int) -> DataFrame:
        keys = changes.select("id")
        return F.broadcast(keys) if many <= BROADCAST_KEYS else keys

    def snapshot(self, ns: str, consistency: str | dict = "strong", state: State | None = None) -> DataFrame:
        """Live documents. Strong: up to the head. Eventual: a state of at most STALE_SECONDS, and the newest TAIL_BYTES of its log."""
        s, lowest = self._at(ns, consistency, state)
        if not lowest and ns in self.warmed and self.warmed[ns][0] == s.version:
            return self.warmed[ns][1]
        bottom, (changes, many) = self._bottom(s), self._changes(ns, s, lowest)
        base = self._rows(s, bottom) if bottom else None
        if changes is None:
            return base if base is not None else self.spark.createDataFrame([], self._schema(s))
        new = self._live(s, changes, lowest)
        return new if base is None else base.join(self._keys(changes, many), "id", "left_anti").unionByName(new)

    def _at(self, ns: str, consistency: str | dict, state: State | None) -> tuple[State, int]:
        """(state to read, sequence number after which its log counts)."""
        level = consistency.get("level") if isinstance(consistency, dict) else consistency
        if level not in ("strong", "eventual"):
            raise NamespaceError(f"consistency is strong or eventual, not {level!r}")
        if state is None:
            at, known = self.seen.get(ns, (0.0, None))
            if level == "eventual" and known and time.time() - at < STALE_SECONDS:
                state = known
            else:
                state = self.state(ns)
                self.seen[ns] = (time.time(), state)
        if level == "strong" and state.unindexed > UNINDEXED_BYTES:
            raise Backpressure(f"{state.unindexed} bytes of the log are not indexed; read with eventual consistency")
        return state, capped(state.sizes(), state.indexed, state.head, TAIL_BYTES) if level == "eventual" else 0

    def collection(self, ns: str, consistency: str | dict = "strong", state: State | None = None) -> Collection:
        """The snapshot as a collection, with the indexes of its bottom segment; what changed above it is searched exactly."""
        s, lowest = self._at(ns, consistency, state)
        df = self.snapshot(ns, consistency, s)
        bottom = self._bottom(s)
        index, texts = None, {}
        if bottom and (bottom.get("centroids") or bottom.get("texts")):
            changes, many = self._changes(ns, s, lowest)
            keys = None if changes is None else self._keys(changes, many)
            fresh = None if changes is None else fold(changes, "id", list(s.schema))
            if bottom.get("centroids"):
                rows = self._rows(s, bottom, True)
                fitted = json.loads(self.files.read(bottom["centroids"]))
                centroids, radii = (np.array(fitted), None) if isinstance(fitted, list) else (np.array(fitted["centroids"]), np.array([np.inf if r is None else r for r in fitted["radii"]]))
                index = ann.Ivf(rows if keys is None else rows.join(keys, "id", "left_anti"), centroids, s.metric or "cosine_distance", "vector", fresh, bottom["rows"], radii)
            for a, t in (bottom.get("texts") or {}).items():
                if t["fts"] == s.fts.get(a):
                    texts[a] = text_rank.Postings(t["path"], "id", a, Fts(**s.fts[a]), t["docs"], t["length"], keys, fresh)
        return Collection(df, "id", "vector" if "vector" in s.schema else None, s.metric or "cosine_distance", {k: Fts(**v) for k, v in s.fts.items()}, set(s.regex), self.dot, index, texts, s.dims)

    def query(self, ns: str, request: dict) -> DataFrame:
        level = request.get("consistency", "strong")
        s, _ = self._at(ns, level, None)
        self._gate(s, request)
        return self.collection(ns, level, s).query(request)

    def multi_query(self, ns: str, requests: list[dict], consistency: str | dict = "strong") -> list[DataFrame]:
        """Results of several requests over one snapshot."""
        s, _ = self._at(ns, consistency, None)
        for r in requests:
            self._gate(s, r)
        return self.collection(ns, consistency, s).multi_query(requests)

    def recall(self, ns: str, num: int = 10, top_k: int = 10) -> dict[str, float]:
        """How much of the exact top lists the vector index finds; without an index both are the same."""
        c = self.collection(ns)
        if c.vector is None:
            return {"avg_recall": 1.0, "avg_ann_count": 0.0, "avg_exhaustive_count": 0.0}
        index = c.index or ann.Ivf(c.df.withColumn("cluster_id", F.lit(-1)), np.zeros((0, 0)), c.metric, c.vector)
        return ann.recall(index, "id", num or 10, top_k or 10)

    def warm(self, ns: str) -> None:
        """Hint: keep the snapshot of the present state in the executors' memory and disk until the state changes."""
        self.cool(ns)
        s = self.state(ns)
        self.warmed[ns] = (s.version, self.snapshot(ns, state=s).persist())

    def cool(self, ns: str) -> None:
        if ns in self.warmed:
            self.warmed.pop(ns)[1].unpersist()

    def debug(self, ns: str) -> dict:
        """The state as it is stored, and what is kept warm."""
        s = self.state(ns)
        return {"state": asdict(s), "warm": self.warmed.get(ns, (None,))[0] == s.version, "files": {k: self.files.names(self.path(ns, k)) for k in ("state", "log", "segment", "text")}}

    def _gate(self, s: State, request: dict) -> None:
        if self.strict and s.pending:
            used = attributes(request.get("filters", request.get("filter"))) | ranked_by(request.get("rank_by"))
            if waiting := sorted(used & set(s.pending)):
                raise IndexRebuilding(f"rebuilding: {waiting}")

    # -- writes

    def write(self, ns: str, upsert: DataFrame | list[dict] | None = None, patch: DataFrame | list[dict] | None = None, deletes: list | DataFrame | None = None, *,
              upsert_columns: dict[str, list] | None = None, delete_by_filter: object = None, patch_by_filter: dict | None = None, upsert_condition: object = None,
              patch_condition: object = None, delete_condition: object = None, copy_from: str | None = None, schema: dict | None = None, distance_metric: str | None = None,
              request_id: str | None = None, allow_partial: bool = False, disable_backpressure: bool = False, whole: bool = False) -> WriteResult:
        """One atomic write. Phases: delete_by_filter, patch_by_filter, copy, upserts, patches, deletes; of two mutations of a key the later phase, then the later row, wins.

        A filter that matches over MOST_DELETED or MOST_PATCHED rows is refused, or with `allow_partial` applied to so many; with `whole` it is applied to all, however many.
        """
        args = {k: v for k, v in locals().items() if k not in ("self", "ns")}
        for attempt in (0, 1):
            result = self._write(ns, **args)
            if result is not None:
                return result
        raise Conflict(ns)

    def write_many(self, ns: str, requests: list[dict]) -> list[WriteResult | Exception]:
        """Several requests, in order, each its own write; one that fails leaves its error and does not touch the others."""
        out: list[WriteResult | Exception] = []
        for r in requests:
            try:
                out.append(self.write(ns, **r))
            except (ValueError, RuntimeError) as e:
                out.append(e)
        return out

    def _write(self, ns, upsert, patch, deletes, upsert_columns, delete_by_filter, patch_by_filter, upsert_condition, patch_condition, delete_condition, copy_from, schema, distance_metric, request_id, allow_partial, disable_backpressure, whole):
        s = self._load(ns)
        now = time.time()
        s.requests = {k: v for k, v in s.requests.items() if now - v[0] < REPLAY_SECONDS}
        if request_id is not None and request_id in s.requests:  # written already, by whichever driver
            return WriteResult(**s.requests[request_id][1])
        if s.unindexed > UNINDEXED_BYTES and not disable_backpressure:
            raise Backpressure(f"{s.unindexed} bytes of the log are not indexed")
        before = self._all(ns, s) if s.head else None
        if upsert_columns is not None:
            upsert = self._pivot(upsert_columns)
        source = None
        if copy_from:
            other = self.state(copy_from)
            source = self._all(copy_from, other)
            if not s.head:
                s.key_type = other.key_type
        if isinstance((schema or {}).get("id"), str) and not s.head:
            s.key_type = {"uuid": "uuid", "string": "string", "uint": "bigint", "int": "bigint"}[schema["id"]]
        schema = {k: v for k, v in (schema or {}).items() if k != "id"}
        frames = {"U": self._frame(upsert, s), "P": self._frame(patch, s), "D": self._ids(deletes, s)}
        self._learn(s, [f for f in (frames["U"], frames["P"], source) if f is not None], schema or {}, distance_metric, patch_by_filter)
        if frames["P"] is not None and "vector" in frames["P"].columns:
            raise NamespaceError("a patch cannot change the vector")
        names, parts, result = list(s.schema), [], WriteResult(s.head + 1)
        compiler = lambda df: Compiler(df.schema, set(s.regex))

        def add(df: DataFrame, op: str, phase: int, present: Column | None = None, position: Column | None = None) -> None:
            cols = [F.col(f"`{n}`").cast(s.schema[n]).alias(n) if n in df.columns and op != "D" else F.lit(None).cast(s.schema[n]).alias(n) for n in names]
            place = position if position is not None else F.lit(0).cast("long")
            parts.append(df.select(F.lit(s.head + 1).cast("long").alias("_seq"), F.lit(phase).alias("_phase"), place.alias("_pos"), F.lit(op).alias("_op"), (present if present is not None else F.array().cast("array<string>")).alias("_present"), self._key(df, s), *cols))

        if delete_by_filter is not None and before is not None:
            hit = before.where(compiler(before).compile(delete_by_filter)).select("id")
            if not whole and self._over(hit, MOST_DELETED, allow_partial):
                hit, result.remaining = hit.orderBy("id").limit(MOST_DELETED), True
            add(hit, "D", 0)
        if patch_by_filter is not None and before is not None:
            values = patch_by_filter["patch"]
            if "vector" in values or "id" in values:
                raise NamespaceError("a patch cannot change the id or the vector")
            hit = before.where(compiler(before).compile(patch_by_filter["filters"]))
            if delete_by_filter is not None:
                hit = hit.where(~F.coalesce(compiler(before).compile(delete_by_filter), F.lit(False)))
            hit = hit.select("id")
            if not whole and self._over(hit, MOST_PATCHED, allow_partial):
                hit, result.remaining = hit.orderBy("id").limit(MOST_PATCHED), True
            add(hit.select("id", *[F.lit(v).cast(s.schema[k]).alias(k) for k, v in values.items()]), "P", 1, F.array(*map(F.lit, values)))
        if source is not None:
            add(source, "U", 2)
        current = before if before is not None else self.spark.createDataFrame([], self._schema(s))
        if frames["U"] is not None:
            rows = self._last(frames["U"])
            add(self._conditional(rows, current, upsert_condition, s, "left"), "U", 3, position=F.col("_row"))
        if frames["P"] is not None:
            rows = self._last(frames["P"])
            given = [c for c in frames["P"].columns if c not in ("id", "_row", "_given")]
            present = F.col("_given") if "_given" in rows.columns else F.array(*map(F.lit, given)) if given else F.array().cast("array<string>")
            alive = current.select("id")
            if frames["U"] is not None and upsert_condition is None:
                alive = alive.union(frames["U"].select("id")).distinct()
            rows = rows.join(alive, "id", "left_semi") if patch_condition is None else self._conditional(rows, current, patch_condition, s, "inner")
            add(rows, "P", 4, present, F.col("_row"))
        if frames["D"] is not None:
            rows = frames["D"]
            add(rows if delete_condition is None else self._conditional(rows.withColumn("_row", F.lit(0)), current, delete_condition, s, "inner", True), "D", 5)
        log = parts[0] if parts else None
        for p in parts[1:]:
            log = log.unionByName(p)
        if log is None:
            return result if s.head and not schema and not distance_metric else (result if self._commit(ns, s) else None)
        target = self.path(ns, "log", uuid.uuid4().hex)
        log.sortWithinPartitions("id", "_phase", "_pos").write.parquet(target)
        counts = {r._op: r.n for r in self.spark.read.parquet(target).groupBy("_op").agg(F.count(F.lit(1)).alias("n")).collect()}
        result.upserted, result.patched, result.deleted = (counts.get(k, 0) for k in "UPD")
        s.head += 1
        s.log[str(s.head)] = {"path": target, "bytes": self.files.size(target), **{k: counts.get(k, 0) for k in "UPD"}, "once": len(parts) == 1}
        if request_id is not None:
            s.requests[request_id] = [now, asdict(result)]
        self.files.create(f"{target}/_state.json", json.dumps(asdict(s)))
        if self._commit(ns, s):
            return result
        self.files.drop(target)
        return None

    def _all(self, ns: str, s: State) -> DataFrame:
        """The snapshot that a write sees: strong, whatever the size of the log."""
        bottom, (changes, many) = self._bottom(s), self._changes(ns, s)
        if changes is None:
            return self._rows(s, bottom) if bottom else self.spark.createDataFrame([], self._schema(s))
        new = self._live(s, changes)
        return new if bottom is None else self._rows(s, bottom).join(self._keys(changes, many), "id", "left_anti").unionByName(new)

    @staticmethod
    def _key(df: DataFrame, s: State) -> Column:
        """The id column as the namespace's keys are."""
        kind, c = df.schema["id"].dataType.simpleString(), F.col("id")
        if s.key_type == "uuid":
            return F.regexp_replace(F.lower(c.cast("string")), "^(.{8})-?(.{4})-?(.{4})-?(.{4})-?(.{12})$", "$1-$2-$3-$4-$5").alias("id")
        if kind == "string" and s.key_sql != "string":
            raise NamespaceError(f"ids are {s.key_type}, not strings")
        return c.cast(s.key_sql).alias("id")

    def _over(self, hit: DataFrame, most: int, allow_partial: bool) -> bool:
        over = hit.limit(most + 1).count() > most
        if over and not allow_partial:
            raise NamespaceError(f"the filter matches over {most} rows")
        return over

    @staticmethod
    def _pivot(columns: dict[str, list]) -> list[dict]:
        ids = columns.get("id") or columns.get("ids") or []
        rest = {k: v for k, v in columns.items() if k not in ("id", "ids")}
        if any(len(v) != len(ids) for v in rest.values()):
            raise NamespaceError("columns differ in length")
        if len(set(ids)) != len(ids):
            raise NamespaceError("an id repeats")
        return [{"id": i, **{k: v[n] for k, v in rest.items()}} for n, i in enumerate(ids)]

    def _frame(self, rows: DataFrame | list[dict] | None, s: State) -> DataFrame | None:
        if rows is None or isinstance(rows, list) and not rows:
            return None
        if isinstance(rows, DataFrame):
            if "id" not in rows.columns:
                raise NamespaceError("rows need an id")
            if s.head == 0 and s.key_type == "bigint":
                kind = rows.schema["id"].dataType.simpleString()
                s.key_type = "bigint" if kind in ("bigint", "int", "smallint", "tinyint") else kind if kind.startswith("decimal") else "string"
            rows = rows.where("id is not null").withColumn("id", self._key(rows, s))
            return rows if "_row" in rows.columns else rows.withColumn("_row", F.monotonically_increasing_id())
        names = list(dict.fromkeys(k for r in rows for k in r if k != "id"))
        types = dict(s.schema)
        for k in names:
            if k not in types and (kind := infer(next((r[k] for r in rows if r.get(k) not in (None, [])), None), k)):
                types[k] = kind
        names = [k for k in names if k in types]
        kinds = {key_type(r.get("id")) for r in rows}
        if s.head == 0 and s.key_type == "bigint":
            s.key_type = kinds.pop() if len(kinds) == 1 else "string"
        if "vector" in names:
            sizes = {len(decode_vector(r["vector"])) for r in rows if r.get("vector") is not None} | ({s.dims} if s.dims else set())
            if len(sizes) > 1:
                raise NamespaceError(f"vectors have {sorted(sizes)} dimensions")
            s.dims = next(iter(sizes), s.dims)
        fields = [T.StructField("id", T._parse_datatype_string(s.key_sql)), *[T.StructField(k, T._parse_datatype_string(types[k])) for k in names]]
        fields += [T.StructField("_row", T.LongType()), T.StructField("_given", T.ArrayType(T.StringType()))]
        data = [(fit(r["id"], s.key_type), *[fit(r.get(k), types[k]) for k in names], n, [k for k in r if k in names]) for n, r in enumerate(rows)]
        return self.spark.createDataFrame(data, T.StructType(fields))

    def _ids(self, ids: list | DataFrame | None, s: State) -> DataFrame | None:
        if ids is None or isinstance(ids, list) and not ids:
            return None
        if isinstance(ids, DataFrame):
            return ids.where("id is not null").select(self._key(ids, s)).distinct()
        return self.spark.createDataFrame([(fit(i, s.key_type),) for i in dict.fromkeys(ids)], T.StructType([T.StructField("id", T._parse_datatype_string(s.key_sql))]))

    def _learn(self, s: State, frames: list[DataFrame], declared: dict, metric: str | None, patch_by_filter: dict | None) -> None:
        """Extend the schema by what the request brings; a type never changes."""
        def note(name: str, kind: str) -> None:
            if s.schema.setdefault(check_attribute(name), kind) != kind and not (s.schema[name] == "double" and kind == "bigint"):
                raise NamespaceError(f"attribute {name!r} is {s.schema[name]}, not {kind}")

        for name, how in declared.items():
            how = how if isinstance(how, dict) else {"type": how}
            if "type" in how:
                note(name, TYPES.get(how["type"], how["type"]))
            elif name not in s.schema:
                raise NamespaceError(f"new attribute {name!r} needs a type")
            fts = Fts.parse(how.get("full_text_search"))
            was = json.dumps([s.fts.get(name), name in s.regex])
            if fts:
                s.fts[name] = {k: getattr(fts, k) for k in ("tokenizer", "language", "case_sensitive", "stemming", "remove_stopwords", "ascii_folding", "k1", "b")}
            if how.get("regex") and name not in s.regex:
                s.regex.append(name)
            if s.head and json.dumps([s.fts.get(name), name in s.regex]) != was and name not in s.pending:
                s.pending.append(name)
        for df in frames:
            for f in df.schema.fields:
                if f.name not in ("id", "_row", "_given"):
                    note(f.name, s.schema.get(f.name) if f.name in s.schema and f.dataType.simpleString() in ("bigint", "int") and s.schema[f.name] == "double" else f.dataType.simpleString())
        for k, v in ((patch_by_filter or {}).get("patch") or {}).items():
            if k not in s.schema and (kind := infer(v, k)):
                note(k, kind)
        if metric is not None:
            if s.metric not in (None, metric):
                raise NamespaceError(f"the distance metric is {s.metric}")
            if metric == "dot_product" and not self.dot:
                raise NamespaceError("dot_product is not allowed")
            s.metric = metric

    @staticmethod
    def _last(df: DataFrame) -> DataFrame:
        """Of rows that repeat an id the last."""
        rest = [c for c in df.columns if c != "id"]
        return df.groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "_row").alias("_last")).select("id", *[F.col(f"_last.`{c}`").alias(c) for c in rest])

    def _conditional(self, rows: DataFrame, current: DataFrame, condition: object, s: State, how: str, blank: bool = False) -> DataFrame:
        """Rows whose condition holds on the current document; a left join applies rows without one, too."""
        if condition is None:
            return rows
        old = current.select(*[F.col(f"`{c}`").alias(f"_old_{c}") for c in current.columns])
        types = {f.name: f.dataType for f in current.schema.fields}
        new: Callable[[str], Column] = lambda a: F.lit(None) if blank or a not in rows.columns else rows[f"`{a}`"].cast(types.get(a, T.StringType()))
        test = Compiler(current.schema, set(s.regex), new, lambda n: F.col(f"`_old_{n}`")).compile(condition)
        joined = rows.join(old, F.col("id") == F.col("_old_id"), how)
        holds = F.coalesce(test, F.lit(False))
        return joined.where(holds if how == "inner" else F.col("_old_id").isNull() | holds).select(*[rows[f"`{c}`"] for c in rows.columns])

    # -- maintenance

    def _segment(self, ns: str, s: State, df: DataFrame, level: int, hi: int) -> dict:
        """Write a segment; the bottom one with the indexes that the schema asks for."""
        path, out = self.path(ns, "segment", uuid.uuid4().hex), {}
        if level == 2 and "vector" in s.schema:
            centroids, radii, _ = ann.Ivf.write(df, path, "vector", s.metric or "cosine_distance")
            out["centroids"] = f"{path}/_centroids.json"
            self.files.create(out["centroids"], json.dumps({"centroids": centroids.tolist(), "radii": [r if np.isfinite(r) else None for r in radii.tolist()]}))
        else:
            df.write.parquet(path)
        written = self.spark.read.parquet(path)
        dead = F.count_if(F.col("_dead")) if level < 2 else F.lit(0)
        rows, gone = written.agg(F.count(F.lit(1)), dead).first() if written.columns else (0, 0)
        out |= {"path": path, "level": level, "hi": hi, "rows": rows, "dead": gone, "bytes": self.files.size(path)}
        if level == 2 and s.fts:
            out["texts"] = {a: self._postings(ns, s, out, a) for a in s.fts if s.schema.get(a) == "string"}
        return out

    def _postings(self, ns: str, s: State, segment: dict, attribute: str) -> dict:
        path = self.path(ns, "text", uuid.uuid4().hex)
        docs, length = text_rank.Postings.write(self._rows(s, segment), path, "id", attribute, Fts(**s.fts[attribute]))
        return {"path": path, "docs": docs, "length": length, "fts": s.fts[attribute]}

    def index(self, ns: str, merge: bool = True) -> int:
        """Fold what the log gained into a new segment, merge levels that are full, commit; the sequence number indexed."""
        s = self.state(ns)
        if s.indexed == s.head and not s.pending:
            return s.indexed
        changes, _ = self._changes(ns, s)
        if s.indexed < s.head:
            if not s.segments:
                new = self._segment(ns, s, self._live(s, changes), 2, s.head)
            else:
                new = self._segment(ns, s, changed(changes, "id", list(s.schema), s.indexed), 0, s.head)
            s.segments.append(new)
            s.indexed = s.head
        if merge:
            while plan := plan_compaction(s):
                self._merge(ns, s, *plan)
        bottom = self._bottom(s)
        for a in s.pending:  # an attribute's new settings
            if bottom and a in s.fts and s.schema.get(a) == "string":
                bottom.setdefault("texts", {})[a] = self._postings(ns, s, bottom, a)
        s.pending = []
        if not self._commit(ns, s):
            raise Conflict(ns)
        return s.indexed

    def _merge(self, ns: str, s: State, chosen: list[dict], level: int) -> None:
        """Replace neighbouring segments by one of `level`; tombstones go where it is the bottom one."""
        upper = [x for x in chosen if x["level"] < 2]
        bottom = next((x for x in chosen if x["level"] == 2), None)
        rows = None
        for x in upper:
            part = self._rows(s, x).withColumn("_hi", F.lit(x["hi"]))
            rows = part if rows is None else rows.unionByName(part)
        rest = [F.col(f"`{c}`") for c in rows.columns if c not in ("id", "_hi")]
        newest = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "_hi").alias("_r")).select("id", "_r.*")
        if level == 2:
            live = newest.where("not _dead").drop("_dead")
            if bottom:
                keys, many = rows.select("id"), sum(x["rows"] for x in upper)
                live = self._rows(s, bottom).join(F.broadcast(keys) if many <= BROADCAST_KEYS else keys, "id", "left_anti").unionByName(live)
            newest = live
        merged = self._segment(ns, s, newest, level, max(x["hi"] for x in chosen))
        at = s.segments.index(chosen[0])
        s.segments = [x for x in s.segments if x not in chosen]
        s.segments.insert(at, merged)

    def compact(self, ns: str) -> None:
        """Merge all segments into the bottom one."""
        s = self.state(ns)
        if any(x["level"] < 2 for x in s.segments):
            self._merge(ns, s, list(s.segments), 2)
            if not self._commit(ns, s):
                raise Conflict(ns)

    def rebuild_fts(self, ns: str, attribute: str | None = None) -> list[str]:
        """Write the postings of full-text attributes anew; their names."""
        s = self.state(ns)
        bottom = self._bottom(s)
        names = [a for a in s.fts if attribute in (None, a) and s.schema.get(a) == "string"]
        if bottom and names:
            for a in names:
                bottom.setdefault("texts", {})[a] = self._postings(ns, s, bottom, a)
            if not self._commit(ns, s):
                raise Conflict(ns)
        return names

    def vacuum(self, ns: str, keep_log: bool = False, retention: float = RETENTION) -> list[str]:
        """Remove segments, postings, indexed log entries and leftovers of dead writers that the current state does not use and that are older than `retention` seconds (readers may hold them)."""
        s = self.state(ns)
        old = {k: v for k, v in s.log.items() if int(k) <= s.indexed}
        if old and not keep_log:
            s.log = {k: v for k, v in s.log.items() if k not in old}
            if not self._commit(ns, s):
                raise Conflict(ns)
        used = {v["path"] for v in s.log.values()} | {x["path"] for x in s.segments} | {t["path"] for x in s.segments for t in (x.get("texts") or {}).values()}
        found = [self.path(ns, k, n) for k in ("log", "segment", "text") for n in self.files.names(self.path(ns, k))]
        found += [self.path(ns, "state", n) for n in self.files.names(self.path(ns, "state"))[:-1]]
        gone = [p for p in found if p not in used and self.files.age(p) >= retention]
        for path in gone:
            self.files.drop(path)
        return gone

    def collect(self, retention: float = RETENTION) -> list[str]:
        """Purge namespaces deleted longer than `retention` seconds ago; their names."""
        out = []
        for n in self.files.names(self.root):
            state = self._newest(n)
            if state is not None and state.deleted and time.time() - state.updated >= retention:
                self.files.drop(self.path(n))
                out.append(n)
        return out

    def repair(self, ns: str) -> int:
        """Drop a state file that its writer left unfinished, then commit log entries that follow the head without a gap but whose writers died before their commit; the head."""
        names = self.files.names(self.path(ns, "state"))
        while names and not self.files.read(self.path(ns, "state", names[-1])).endswith("}"):
            self.files.drop(self.path(ns, "state", names.pop()))
        s = self._load(ns)
        waiting = []
        for n in self.files.names(self.path(ns, "log")):
            meta = self.path(ns, "log", n, "_state.json")
            if "_state.json" in self.files.names(self.path(ns, "log", n)):
                waiting.append(State(**json.loads(self.files.read(meta))))
        while follower := next((x for x in waiting if x.version == s.version and x.head == s.head + 1), None):
            if not self._commit(ns, follower):
                raise Conflict(ns)
            s = follower
        return s.head


def plan_compaction(s: State) -> tuple[list[dict], int] | None:
    """(segments to merge, level of the result): TRIGGER of level 0 make one of level 1; TRIGGER of level 1 go, with all older ones, into the bottom."""
    for level in (0, 1):
        some = [x for x in s.segments if x["level"] == level]
        if len(some) >= TRIGGER:
            return (some, 1) if level == 0 else ([x for x in s.segments if x["level"] >= 1], 2)
    return None


def ranked_by(rank: object) -> set[str]:
    """Attributes that a ranking reads."""
    if not isinstance(rank, (list, tuple)) or not rank:
        return set()
    if rank[0] in ("Sum", "Max"):
        return set().union(*map(ranked_by, rank[1])) if len(rank) > 1 and rank[1] else set()
    if rank[0] == "Product":
        return set().union(*map(ranked_by, rank[1:]))
    return attributes(list(rank)) if isinstance(rank[0], str) else set()


TYPES = {"string": "string", "uuid": "string", "int": "bigint", "uint": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}
TYPES |= {f"[]{k}": f"array<{v}>" for k, v in list(TYPES.items())}


def capped(sizes: dict[str, int], indexed: int, head: int, most: int) -> int:
    """The sequence number after which the newest entries stay within `most` bytes."""
    total = 0
    for seq in range(head, indexed, -1):
        total += sizes.get(str(seq), 0)
        if total > most:
            return seq
    return indexed


def key_type(value: object) -> str:
    if isinstance(value, bool) or value is None or not isinstance(value, (int, str, uuid.UUID)):
        raise NamespaceError(f"no id: {value!r}")
    if isinstance(value, int):
        if not 0 <= value < 1 << 64:
            raise NamespaceError(f"no id: {value!r}")
        return "bigint" if value < 1 << 63 else "decimal(20,0)"
    if len(str(value).encode()) > 64:
        raise NamespaceError("an id has 64 bytes at most")
    return "uuid" if as_uuid(value) else "string"


def as_uuid(value: object) -> str | None:
    """The usual form of a UUID, given as such or as its text with or without dashes."""
    if isinstance(value, uuid.UUID):
        return str(value)
    if isinstance(value, str) and re.fullmatch(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}", value):
        return str(uuid.UUID(value))
    return None


def infer(value: object, name: str = "") -> str | None:
    """Spark type of a JSON value; None for null and empty arrays."""
    if name == "vector" and value is not None:
        return "array<float>"
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        from quern.functions.filters import instant

        return "timestamp" if re.match(r"\d{4}-\d\d-\d\dT", value) and instant(value) else "string"
    if isinstance(value, (list, tuple)):
        inner = infer(next((v for v in value if v is not None), None))
        return f"array<{inner}>" if inner else None
    raise NamespaceError(f"no value: {value!r}")


def fit(value: object, kind: str) -> object:
    """A JSON value as a value of a Spark type; one that does not fit raises."""
    from quern.functions.filters import instant
    if value is None:
        return None
    if kind.startswith("array<"):
        if kind == "array<float>":
            return decode_vector(value)
        if isinstance(value, (list, tuple)):
            return [fit(v, kind[6:-1]) for v in value]
    elif kind == "uuid" and (text := as_uuid(value)):
        return text
    elif kind == "timestamp" and (at := instant(value)) is not None:
        return at.replace(tzinfo=timezone.utc)
    elif kind == "string" and isinstance(value, (str, uuid.UUID, int)) and not isinstance(value, bool):
        return str(value)
    elif kind == "double" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    elif kind == "bigint" and isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
        return value
    elif kind.startswith("decimal") and isinstance(value, int):
        from decimal import Decimal

        return Decimal(value)
    elif kind == "boolean" and isinstance(value, bool):
        return value
    raise NamespaceError(f"{value!r} is no {kind}")
