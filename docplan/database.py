"""Databases of collections over Parquet.

A collection's version is a manifest: folders of Parquet files, each written by one write, less the files that later writes replaced. An
insert adds a folder; an update or a delete writes anew only the files that hold a match. The catalog names each collection's manifests;
catalogs are numbered files that are created and never changed, so a commit is the creation of the next number, and of two writers at
once one sees the other's commit and starts again. Readers keep what they read, older versions can be read, and what isn't committed is
nowhere listed. Every write also appends its changes to a log, in the order of commits, numbered without gaps."""

from __future__ import annotations

import datetime
import json
import random
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import plugins
from .functions.filters import check_document, check_filter, compile_filter, sure
from .functions.paths import of
from .functions.updates import apply_update
from .operators import relations, search, vectors
from .operators.pipeline import run_pipeline
from .plans import ansi
from .plans.builders import Aggregate, Query, UpdateBuilder
from .plans.select import find
from .plans.sql import Delete, Insert, Update, parse
from .sources import files
from .streaming import changes


class DatabaseError(ValueError):
    """The call isn't possible in this database."""


class Conflict(DatabaseError):
    """Another transaction changed a collection that this one changes."""


#: Documents of an insert that go to Spark together.
BATCH = 5000


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the same types where they have the same names: numbers widen, other differences become text."""
    for f in a.schema:
        if f.name in b.columns and (g := b.schema[f.name]).dataType != f.dataType and not isinstance(f.dataType, T.StructType):
            try:
                kind = files.merged_kind([f.dataType, g.dataType])
            except TypeError:
                kind = T.StringType()
            a, b = (x.withColumn(f.name, F.col(f"`{f.name}`").cast(kind)) for x in (a, b))
    return a, b


class Collection:
    def __init__(self, db: Database, name: str) -> None:
        self.db, self.name = db, name

    # ---- reading
    def df(self, version: int | None = None) -> DataFrame:
        """All documents, of the current or of an older version."""
        return self.db._read(self.name, version)

    def find(self, filter: Any = None, **options: Any) -> DataFrame:  # noqa: A002
        return find(self.df(), filter, **options)

    def find_one(self, filter: Any = None, **options: Any) -> Row | None:  # noqa: A002
        return self.find(filter, **options | {"limit": 1}).first()

    def count(self, filter: Any = None) -> int:  # noqa: A002
        return self.find(filter).count()

    def exists(self, filter: Any = None) -> bool:  # noqa: A002
        return bool(self.find(filter).take(1))

    def distinct(self, path: str, filter: Any = None) -> DataFrame:  # noqa: A002
        df = self.find(filter)
        return df.select(of(df).find(path).column.alias("value")).distinct()

    def aggregate(self, pipeline: list[dict] | Aggregate, **options: Any) -> DataFrame:
        stages = pipeline.to_pipeline() if isinstance(pipeline, Aggregate) else pipeline
        return run_pipeline(self.df(), stages, tables=self.db.table, write=self.db._write_stage, **options)

    def query(self) -> Query:
        return Query(self)

    def pipeline(self) -> Aggregate:
        return Aggregate(self)

    def explain(self, filter: Any = None, **options: Any) -> dict:  # noqa: A002
        df = self.find(filter, **options)
        plan = df._jdf.queryExecution()
        return {"queryPlanner": {"namespace": self.name, "parsedFilter": filter or {}, "optimizedPlan": plan.optimizedPlan().toString(), "winningPlan": plan.executedPlan().toString()}}

    def stream(self, filter: Any = None, **options: Any) -> Iterator[Row]:  # noqa: A002
        return self.find(filter, **options).toLocalIterator()

    def autocomplete(self, field: str, prefix: str, limit: int = 10) -> DataFrame:
        return search.autocomplete(self.df(), field, prefix, limit, "_id" if "_id" in self.df().columns else None)

    def search(self, query: str, field: str, limit: int = 10) -> DataFrame:
        return search.top(search.tf_idf(self.df(), query, "_id", field), limit, "_id").join(self.df(), "_id")

    def vector_search(self, vector: list[float], k: int, field: str, where: Any = None) -> DataFrame:
        return vectors.vector_search(self.df(), vector, k, field, "_id", where=where)

    # ---- writing
    def insert(self, document: dict, session: tuple | None = None) -> str:
        return self.insert_many([document], session=session)[0]

    def insert_many(self, documents: Iterable[dict], session: tuple | None = None, on_progress: Callable[[int], None] | None = None) -> list:
        """Identifiers of the documents; those without one get one. All of them become visible together. session: (id, number); a
        number that isn't above the session's last inserts nothing again, whoever asks: the catalog remembers it."""
        if session is not None:
            done = self.db._fresh()["sessions"].get(f"{self.name}/{session[0]}")
            if done and done[0] >= session[1]:
                return done[1]
        rows = []
        for d in documents:
            check_document(d)
            d = dict(d)
            d.setdefault("_id", str(uuid.uuid4()))
            for f in self.db._triggers("before", "insert", self.name):
                d = f(d) or d
            for name in self.db._catalog["collections"].get(self.name, {}).get("validators", []):
                if name not in plugins.VALIDATORS:
                    raise DatabaseError(f"the validator {name} isn't here")
                if not plugins.VALIDATORS[name](d):
                    raise DatabaseError(f"{name} refuses the document {d['_id']}")
            rows.append(d)
        ids = [d["_id"] for d in rows]
        new: DataFrame | None = None
        for k in range(0, len(rows), BATCH):
            part = files.documents(self.db.spark, rows[k : k + BATCH]).coalesce(1)  # a file for each batch
            new = part if new is None else (lambda p: p[0].unionByName(p[1], allowMissingColumns=True))(aligned(new, part))
            if on_progress:
                on_progress(min(len(rows), k + BATCH))
        if new is not None:
            self.insert_df(new, [f"{self.name}/{session[0]}", session[1], ids] if session is not None else None)
        for d in rows:
            for f in self.db._triggers("after", "insert", self.name):
                f(d)
        return ids

    def insert_df(self, new: DataFrame, session: list | None = None) -> None:
        """Rows of a DataFrame; it should have `_id`. They are added in files of their own."""
        for index in self.indexes():
            if index.get("unique"):
                self._check_unique(new, list(index["fields"]))
        part = self.db._part(self.name, new)
        added = self.db._read_parts([part])
        log = self.db._stage(self.name, added.select(F.lit("insert").alias("op"), *_image(added)))
        self.db._write(self.name, lambda parts: ([*parts, part], [log]), session=session)

    def _check_unique(self, new: DataFrame, fields: list[str]) -> None:
        both = new.select(*fields) if self.db._current(self.name) is None else self.df().select(*fields).unionByName(new.select(*fields))
        if both.groupBy(*fields).count().where("count > 1").take(1):
            raise DatabaseError(f"{', '.join(fields)} must be unique in {self.name}")

    def _hits(self, parts: list[dict], filter: Any, one: bool) -> tuple[DataFrame, Any, dict[str, list[str]], int]:  # noqa: A002
        """The documents, a filter of what changes (all matches, or the one with the smallest identifier), the files that hold them by
        folder, and how many they are. The filter runs once here, and once more over the files found."""
        df = self.db._read_parts(parts, files_too=True)
        where = filter or {}
        hit = df.where(compile_filter(of(df), where))
        touched: dict[str, list[str]] = {}
        n = 0
        if one:
            first = hit.orderBy("_id").select("_id", _FILE).first()
            if first is None:
                return df, {"$or": []}, {}, 0
            folder, name = first[_FILE].rsplit("/", 2)[1:]
            return df, {"_id": {"$in": [first["_id"]]}}, {folder: [name]}, 1
        for r in hit.groupBy(_FILE).agg(F.count("*").alias("n")).collect():  # a row for each file that holds a match
            folder, name = r[_FILE].rsplit("/", 2)[1:]
            touched.setdefault(folder, []).append(name)
            n += r["n"]
        return df, where, touched, n

    def _rewrite(self, parts: list[dict], touched: dict[str, list[str]], f: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """The parts with f's rows in place of the touched files'."""
        only = [p | {"only": touched[p["folder"]]} for p in parts if p["folder"] in touched]
        new = self.db._part(self.name, f(self.db._read_parts(only, schema_of=parts)))
        kept = [p | {"gone": sorted({*p.get("gone", []), *touched.get(p["folder"], [])})} for p in parts]
        return [*(p for p in kept if len(p["gone"]) < p["files"]), new]

    def _update(self, filter: Any, spec: dict | UpdateBuilder, one: bool, upsert: bool = False) -> int:  # noqa: A002
        spec = spec.build() if isinstance(spec, UpdateBuilder) else spec
        plain = {k: v for k, v in spec.items() if k != "$setOnInsert"} if upsert else spec
        touched_rows = 0

        def write(parts: list[dict]) -> tuple[list[dict], list[dict]] | None:
            nonlocal touched_rows
            _, where, touched, touched_rows = self._hits(parts, filter, one)
            if not touched_rows or not plain:
                return None
            before = self.db._read_parts([p | {"only": touched[p["folder"]]} for p in parts if p["folder"] in touched], schema_of=parts)
            hit = before.where(compile_filter(of(before), where))
            changed = apply_update(hit.withColumn(_BEFORE, _json(hit)), plain)
            log = self.db._stage(self.name, changed.select(F.lit("update").alias("op"), *_image(changed)))
            self._fire("before", "update", changed.drop(_BEFORE))
            return self._rewrite(parts, touched, lambda df: apply_update(df, plain, where)), [log]

        logs = self.db._write(self.name, write)
        if not touched_rows and upsert:
            base = {k: v for k, v in (filter or {}).items() if not k.startswith("$") and not isinstance(v, dict)}
            row = files.documents(self.db.spark, [base | {"_id": base.get("_id", str(uuid.uuid4()))}])
            self.insert_df(apply_update(row, spec))
            return 0
        self._fire_logged("update", logs)
        return touched_rows

    def _fire(self, when: str, op: str, df: DataFrame) -> None:
        """Triggers see documents one by one; only where there is a trigger do they leave the executors."""
        many = self.db._triggers(when, op, self.name)
        if many:
            for x in df.toJSON().toLocalIterator():
                for f in many:
                    f(json.loads(x))

    def _fire_logged(self, op: str, logs: list[dict]) -> None:
        if self.db._triggers("after", op, self.name):
            for log in logs:
                for r in self.db._staged_rows(log).where(F.col("ns") == self.name).select("document").toLocalIterator():
                    for f in self.db._triggers("after", op, self.name):
                        f(json.loads(r["document"]))

    def update(self, filter: Any, spec: Any, upsert: bool = False) -> int:  # noqa: A002
        return self._update(filter, spec, True, upsert)

    def update_many(self, filter: Any, spec: Any, upsert: bool = False) -> int:  # noqa: A002
        return self._update(filter, spec, False, upsert)

    def _delete(self, filter: Any, one: bool) -> int:  # noqa: A002
        n = 0
        children = [r for r in self.db.relations() if r["to"] == self.name]

        def write(parts: list[dict]) -> tuple[list[dict], list[dict]] | None:
            nonlocal n
            _, where, touched, n = self._hits(parts, filter, one)
            if not n:
                return None
            before = self.db._read_parts([p | {"only": touched[p["folder"]]} for p in parts if p["folder"] in touched], schema_of=parts)
            gone = before.where(compile_filter(of(before), where))
            self._fire("before", "delete", gone)
            log = self.db._stage(self.name, gone.select(F.lit("delete").alias("op"), *_image(gone)))
            for r in children:
                self.db.collection(r["from"])._follow(gone.select(F.col(r["foreign"]).alias("__key")).distinct(), r)
            return self._rewrite(parts, touched, lambda df: df.where(~sure(compile_filter(of(df), where)))), [log]

        if children and self.db._staged is None:  # parents and children change together
            with self.db.transaction():
                logs = self.db._write(self.name, write)
        else:
            logs = self.db._write(self.name, write)
        if n:
            self._fire_logged("delete", logs)
        return n

    def _follow(self, keys: DataFrame, r: dict) -> None:
        """What a relation does to the rows whose parents' keys go; nothing is written where no row has one of them."""
        local = r["local"]

        def write(parts: list[dict]) -> tuple[list[dict], list[dict]] | None:
            df = self.db._read_parts(parts, files_too=True)
            if local not in df.columns:
                return None
            hit = df.join(keys, F.col(local) == F.col("__key"), "left_semi")
            found = [r[_FILE].rsplit("/", 2)[1:] for r in hit.select(_FILE).distinct().collect()]  # files
            if not found:
                return None
            if r["on_delete"] == "restrict":
                raise relations.IntegrityError(f"rows still refer to {r['foreign']}")
            touched: dict[str, list[str]] = {}
            for folder, name in found:
                touched.setdefault(folder, []).append(name)
            plain = hit.drop(_FILE)
            if r["on_delete"] == "cascade":
                log = plain.select(F.lit("delete").alias("op"), *_image(plain))
            else:
                now = plain.withColumn(_BEFORE, _json(plain)).withColumn(local, F.lit(None).cast(plain.schema[local].dataType))
                log = now.select(F.lit("update").alias("op"), *_image(now))
            return self._rewrite(parts, touched, lambda x: relations.on_delete(x, keys, local, "__key", r["on_delete"])), [self.db._stage(self.name, log)]

        self.db._write(self.name, write)

    def delete(self, filter: Any) -> int:  # noqa: A002
        return self._delete(filter, True)

    def delete_many(self, filter: Any = None) -> int:  # noqa: A002
        return self._delete(filter, False)

    def find_one_and_update(self, filter: Any, spec: Any) -> Row | None:  # noqa: A002
        """The document as it was before."""
        row = self.find(filter, sort={"_id": 1}, limit=1).first()
        if row is not None:
            self.update({"_id": {"$eq": row["_id"]}}, spec)
        return row

    def find_one_and_delete(self, filter: Any) -> Row | None:  # noqa: A002
        row = self.find(filter, sort={"_id": 1}, limit=1).first()
        if row is not None:
            self.delete({"_id": {"$eq": row["_id"]}})
        return row

    # ---- what belongs to it
    def create_index(self, fields: dict | str, **options: Any) -> str:
        """Noted in the catalog. Indexes never change results; a unique one is checked when documents are inserted."""
        fields = {fields: 1} if isinstance(fields, str) else fields
        name = options.pop("name", None) or "_".join(f"{k}_{v}" for k, v in fields.items())
        if options.get("unique") and self.db._current(self.name) is not None and self.df().groupBy(*fields).count().where("count > 1").take(1):
            raise DatabaseError(f"{', '.join(fields)} isn't unique in {self.name}")
        self.db._edit(lambda c: _meta(c, self.name).setdefault("indexes", {}).update({name: {"name": name, "fields": fields, "hidden": False} | options}))
        return name

    def indexes(self) -> list[dict]:
        return list(self.db._fresh()["collections"].get(self.name, {}).get("indexes", {}).values())

    def drop_index(self, name: str) -> bool:
        return self.db._edit(lambda c: _meta(c, self.name).get("indexes", {}).pop(name, None)) is not None

    def hide_index(self, name: str, hidden: bool = True) -> None:
        self.db._edit(lambda c: _meta(c, self.name)["indexes"][name].update(hidden=hidden))

    def versions(self) -> list[dict]:
        """Numbers, times and tags of all versions."""
        return [{k: v for k, v in x.items() if k != "manifest"} for x in self.db._fresh()["collections"].get(self.name, {}).get("versions", [])]

    def tag(self, name: str, version: int | None = None) -> None:
        def put(c: dict) -> None:
            meta = _meta(c, self.name)
            for v in meta["versions"]:
                if v["version"] == (version or meta["current"]):
                    v["tag"] = name

        self.db._edit(put)

    def rollback(self, version: int | str) -> int:
        """An older version, by number or tag, as a new one: its files are listed again, nothing is copied."""
        n = next(v["version"] for v in self.versions() if version in (v["version"], v.get("tag")))
        parts = self.db._parts_of(self.name, n)
        self.db._write(self.name, lambda now: (parts, [self.db._difference(self.name, now, parts)]))
        return self.db._current(self.name)

    def compact(self) -> int:
        """The current version in one folder of fresh files; how many folders it was. Contents and changes stay as they are."""
        was = 0

        def write(parts: list[dict]) -> tuple[list[dict], list[dict]]:
            nonlocal was
            was = len(parts)
            return [self.db._part(self.name, self.db._read_parts(parts))], []

        self.db._write(self.name, write)
        return was

    def watch(self, callback: Callable[[dict], None], since: int = 0, once: bool = False) -> Any:
        return changes.watch(changes.stream(self.db.spark, self.db._log, self.name, since), callback, f"{self.db.path}/_watch/{uuid.uuid4().hex}", once)

    def expire(self, field: str, seconds: int, now: datetime.datetime | None = None) -> int:
        """Deletes documents whose time is so long ago."""
        return self.delete_many({field: {"$lte": (now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)) - datetime.timedelta(seconds=seconds)}})


_BEFORE, _FILE = "__before", "__file"


def _meta(catalog: dict, name: str) -> dict:
    return catalog["collections"].setdefault(name, {"versions": [], "current": None})


def _merged(schemas: list[T.StructType]) -> T.StructType:
    """One schema for rows of several: numbers widen, other differences become text."""
    kinds: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            if f.name in kinds and kinds[f.name] != f.dataType:
                try:
                    kinds[f.name] = files.merged_kind([kinds[f.name], f.dataType])
                except TypeError:
                    kinds[f.name] = T.StringType()
            else:
                kinds[f.name] = f.dataType
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def _as_kind(value: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A value in a merged kind; structs by name, as casts go by place."""
    if kind == to:
        return value
    if isinstance(to, T.StringType) and isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(value)
    if isinstance(kind, T.StructType) and isinstance(to, T.StructType):
        own = set(kind.fieldNames())
        inner = [(_as_kind(value[f.name], kind[f.name].dataType, f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(value, lambda x: _as_kind(x, kind.elementType, to.elementType))
    return value.cast(to)


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != _BEFORE]))


def _image(df: DataFrame) -> list[Column]:
    """Key, document and, for updates, the document before."""
    key = F.col("_id").cast("string") if "_id" in df.columns else F.lit(None).cast("string")
    before = F.col(_BEFORE) if _BEFORE in df.columns else F.lit(None).cast("string")
    return [key.alias("key"), _json(df).alias("document"), before.alias("before")]


#: Folders of a collection from which on a write makes one of them, and catalogs that are kept.
FOLDERS, CATALOGS = 200, 50


class Database:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self._log = f"{self.path}/_changes"
        self._number, self._catalog = self._latest()
        self._manifests: dict[str, list[dict]] = {}
        self._attached: dict[str, Database] = {}
        self._trigger: list[tuple[str, str, str, str, Callable]] = []
        self._staged: dict[str, str] | None = None
        self._pending: list[dict] = []
        self._sessions: list[list] = []
        self._started = time.time()

    # ---- catalogs
    def _latest(self) -> tuple[int, dict]:
        """The catalog with the largest number. One that goes while it is being read has a follower."""
        for _ in range(20):
            names = [n for n in files.listing(self.spark, f"{self.path}/_catalog") if n.endswith(".json") and n[:-5].isdigit()]
            if not names:
                return 0, {"collections": {}, "views": {}, "relations": {}, "pragmas": {}, "sessions": {}, "seq": 0, "unpublished": []}
            text = files.read_text(self.spark, f"{self.path}/_catalog/{names[-1]}")
            if text:
                return int(names[-1][:-5]), json.loads(text)
        raise DatabaseError("the catalog can't be read")

    def _fresh(self) -> dict:
        if self._staged is None:
            self._number, self._catalog = self._latest()
        return self._catalog

    def _try(self, number: int, catalog: dict) -> bool:
        """Creates the catalog that follows a number, unless somebody else did."""
        if self.read_only:
            raise DatabaseError("this database is open for reading only")
        if not files.create_text(self.spark, f"{self.path}/_catalog/{number + 1:012d}.json", json.dumps(catalog)):
            return False
        self._number, self._catalog = number + 1, catalog
        if number >= CATALOGS:
            files.delete(self.spark, f"{self.path}/_catalog/{number + 1 - CATALOGS:012d}.json")
        return True

    def _edit(self, f: Callable[[dict], Any]) -> Any:
        """Changes the catalog, again from the newest one if another writer was first."""
        if self._staged is not None:
            base = self._catalog  # a transaction's other edits aren't undone with it
        while True:
            number, catalog = self._latest()
            out = f(catalog)
            if self._try(number, catalog):
                if self._staged is not None:
                    self._catalog = base | {k: catalog[k] for k in ("views", "relations", "pragmas")}
                return out

    # ---- versions
    def _manifest(self, name: str, version: int | None = None) -> str | None:
        if version is None and self._staged is not None and name in self._staged:
            return self._staged[name]
        meta = self._catalog["collections"].get(name, {})
        n = version or meta.get("current")
        return next((v["manifest"] for v in meta.get("versions", []) if v["version"] == n), None)

    def _current(self, name: str) -> int | None:
        return self._catalog["collections"].get(name, {}).get("current")

    def _parts_of(self, name: str, version: int | None = None) -> list[dict]:
        ident = self._manifest(name, version)
        if ident is None:
            if version is not None:
                raise DatabaseError(f"{name} has no version {version}")
            return []
        if ident not in self._manifests:
            self._manifests[ident] = json.loads(files.read_text(self.spark, f"{self.path}/{name}/_manifest/{ident}.json") or "[]")
        return self._manifests[ident]

    def _read(self, name: str, version: int | None = None) -> DataFrame:
        self._fresh()
        return self._read_parts(self._parts_of(name, version))

    def _part(self, name: str, df: DataFrame) -> dict:
        """Rows in a folder of their own, listed nowhere yet."""
        if self.read_only:
            raise DatabaseError("this database is open for reading only")
        solid = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema])
        folder = uuid.uuid4().hex
        solid.write.parquet(f"{self.path}/{name}/{folder}")
        n = sum(x.endswith(".parquet") for x in files.listing(self.spark, f"{self.path}/{name}/{folder}"))
        return {"folder": folder, "at": f"{self.path}/{name}/{folder}", "files": n, "schema": solid.schema.jsonValue()}

    def _read_parts(self, parts: list[dict], files_too: bool = False, schema_of: list[dict] | None = None) -> DataFrame:
        """The rows of parts, one scan for each schema. files_too: with the file of each."""
        if not parts:
            df = self.spark.createDataFrame([], "_id string")
            return df.withColumn(_FILE, F.lit("")) if files_too else df
        groups: dict[str, list[str]] = {}
        for p in parts:
            if "only" in p or p.get("gone"):
                names = p.get("only") or [x for x in files.listing(self.spark, p["at"]) if x.endswith(".parquet") and x not in p["gone"]]
                paths = [f"{p['at']}/{x}" for x in names]
            else:
                paths = [p["at"]]
            groups.setdefault(json.dumps(p["schema"]), []).extend(paths)
        whole = _merged([T.StructType.fromJson(p["schema"]) for p in (schema_of or parts)])
        out: DataFrame | None = None
        for text, paths in groups.items():
            own = T.StructType.fromJson(json.loads(text))
            df = self.spark.read.schema(own).parquet(*paths)
            columns = [(_as_kind(F.col(f"`{f.name}`"), own[f.name].dataType, f.dataType) if f.name in own.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in whole.fields]
            df = df.select(*columns, F.col("_metadata.file_path").alias(_FILE)) if files_too else df.select(*columns)
            out = df if out is None else out.unionByName(df)
        return out

    def _stage(self, name: str, change: DataFrame) -> dict:
        """Changes in files that no log lists yet, numbered from 0. Those of one partition are numbered as they are written; of several,
        each behind those before it, which takes a second pass over the changes."""
        ident = uuid.uuid4().hex
        path, seen = f"{self.path}/_staged/{ident}", Observation()
        n = F.monotonically_increasing_id()
        row = [n.bitwiseAND((1 << 33) - 1).alias("i"), "op", F.lit(name).alias("ns"), "key", "document", "before", F.current_timestamp().alias("ts")]
        change.select(*row, F.shiftright(n, 33).alias("p")).observe(seen, F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).write.parquet(path)
        told = seen.get
        if told["n"] and told["lo"] != told["hi"]:
            rows = self._staged_rows({"id": ident}, "p long")
            starts, at = {}, 0
            for k, size in sorted(rows.groupBy("p").count().collect()):  # a row for each partition
                starts[k], at = at, at + size
            first = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("p"))
            numbered = uuid.uuid4().hex
            rows.withColumn("i", F.col("i") + first).drop("p").write.parquet(f"{self.path}/_staged/{numbered}")
            files.delete(self.spark, path)
            ident = numbered
        return {"id": ident, "n": told["n"]}

    def _staged_rows(self, log: dict, more: str = "") -> DataFrame:
        for path in (f"{self.path}/_staged/{log['id']}", *([f"{self._log}/c{log['start']:020d}"] if "start" in log else [])):
            if files.exists(self.spark, path):
                return self.spark.read.schema(f"{changes.STORED}{', ' * bool(more)}{more}").parquet(path)
        raise DatabaseError("the changes are gone")

    def _write(self, name: str, f: Callable[[list[dict]], tuple[list[dict], list[dict]] | None], session: list | None = None) -> list[dict]:
        """Commits f's parts and changes in place of the current ones, at once or with the transaction. Where another writer changed the
        collection meanwhile, f starts again from what it left."""
        while True:
            if self._staged is None:
                self._fresh()
            base = self._manifest(name)
            made = f(self._parts_of(name))
            if made is None:
                return []
            parts, logs = made
            if len(parts) > FOLDERS:
                parts = [self._part(name, self._read_parts(parts))]
            ident = uuid.uuid4().hex
            files.write_text(self.spark, f"{self.path}/{name}/_manifest/{ident}.json", json.dumps(parts))
            self._manifests[ident] = parts
            if self._staged is not None:
                self._staged[name] = ident
                self._pending += logs
                self._sessions += [session] if session else []
                return logs
            done = self._commit({name: ident}, {name: base}, logs, [session] if session else [])
            if done is not None:
                self._refresh_on_write(name)
                return done

    def _commit(self, new: dict[str, str], base: dict[str, str | None], logs: list[dict], sessions: list[list]) -> list[dict] | None:
        """None where a collection isn't any more what the write was made from."""
        while True:
            number, catalog = self._latest()
            for name, ident in base.items():
                meta = catalog["collections"].get(name, {})
                if next((v["manifest"] for v in meta.get("versions", []) if v["version"] == meta.get("current")), None) != ident:
                    return None
            now = datetime.datetime.now(datetime.UTC).isoformat()
            for name, ident in new.items():
                meta = _meta(catalog, name)
                n = max([0, *(v["version"] for v in meta["versions"])]) + 1
                meta["versions"].append({"version": n, "at": now, "manifest": ident})
                meta["current"] = n
            told = []
            for log in logs:
                if log["n"]:
                    told.append(log | {"start": catalog["seq"] + 1, "ts": now})
                    catalog["seq"] += log["n"]
            # what earlier commits told is in the log by now, or is put there by this one
            catalog["unpublished"] = [*(x for x in catalog["unpublished"] if files.exists(self.spark, f"{self.path}/_staged/{x['id']}")), *told]
            for key, count, ids in sessions:
                catalog["sessions"][key] = [count, ids]
            if self._try(number, catalog):
                self._publish()
                return told

    def _publish(self) -> None:
        """Puts committed changes into the log: each set is a folder that is renamed to the number that its first change has. What a
        writer that ended in between left is put there by the next one, and a folder that is there already stays."""
        todo = self._catalog["unpublished"]
        for log in todo:
            staged, target = f"{self.path}/_staged/{log['id']}", f"{self._log}/c{log['start']:020d}"
            if files.exists(self.spark, staged):
                files.move(self.spark, staged, target)

    def _difference(self, name: str, old: list[dict], new: list[dict]) -> dict:
        """The changes between two sets of parts, by identifier; one `invalidate` where there is none."""
        a, b = self._read_parts(old), self._read_parts(new)
        if "_id" not in a.columns or "_id" not in b.columns:
            none = F.lit(None).cast("string")
            return self._stage(name, self.spark.range(1).select(F.lit("invalidate").alias("op"), none.alias("key"), none.alias("document"), none.alias("before")))
        a = a.select(F.col("_id").cast("string").alias("key"), _json(a).alias("before"))
        b = b.select(F.col("_id").cast("string").alias("key"), _json(b).alias("document"))
        both = a.join(b, "key", "full").where(~F.col("before").eqNullSafe(F.col("document")))
        op = F.when(F.col("before").isNull(), "insert").when(F.col("document").isNull(), "delete").otherwise("update")
        return self._stage(name, both.select(op.alias("op"), "key", F.coalesce("document", "before").alias("document"), F.when(F.col("document").isNotNull(), F.col("before")).alias("before")))

    def _replace(self, name: str, df: DataFrame) -> None:
        """All rows of a collection anew; its log tells what differs."""
        part = self._part(name, df)
        self._write(name, lambda now: ([part], [self._difference(name, now, [part])]))

    def _write_stage(self, name: str, df: DataFrame, mode: str, on: list[str]) -> None:
        """What $out and $merge do."""
        if mode == "overwrite":
            return self._replace(name, df)
        _, matched, unmatched = mode.split(":")

        def write(parts: list[dict]) -> tuple[list[dict], list[dict]]:
            if not parts:
                made = [self._part(name, df if unmatched == "insert" else df.limit(0))]
                return made, [self._difference(name, [], made)]
            old, new = aligned(self._read_parts(parts), df)
            keys = old.select(*on).distinct()
            there = new.join(keys, on, "left_semi")
            if matched == "fail" and there.take(1):
                raise DatabaseError("a row is there already")
            if unmatched == "fail" and new.join(keys, on, "left_anti").take(1):
                raise DatabaseError("a row isn't there")
            out = old
            if matched == "replace":
                out = old.join(new.select(*on), on, "left_anti").unionByName(there, allowMissingColumns=True)
            elif matched == "merge":  # the new row's fields over the old one's
                mine = new.select(*on, F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("__new")).dropDuplicates(on)
                out = old.join(mine, on, "left")
                fresh = [c for c in new.columns if c not in on]
                out = out.withColumns({c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(f"`{c}`") if c in old.columns else F.lit(None)) for c in fresh}).drop("__new")
            if unmatched == "insert":
                out = out.unionByName(new.join(keys, on, "left_anti"), allowMissingColumns=True)
            made = [self._part(name, out)]
            return made, [self._difference(name, parts, made)]

        self._write(name, write)
        return None

    # ---- collections
    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    __getitem__ = collection

    def create_collection(self, name: str, **options: Any) -> Collection:
        self._edit(lambda c: _meta(c, name).update({k: v for k, v in options.items() if v is not None}))
        return self.collection(name)

    def drop_collection(self, name: str) -> bool:
        gone = self._edit(lambda c: c["collections"].pop(name, None))
        files.delete(self.spark, f"{self.path}/{name}")
        return gone is not None

    def collections(self) -> list[str]:
        return sorted(n for n, m in self._fresh()["collections"].items() if m.get("current") is not None or n in (self._staged or {}))

    def table(self, name: str) -> DataFrame:
        """A collection, a view, or alias.name of an attached database."""
        alias, _, rest = name.partition(".")
        if rest and alias in self._attached:
            return self._attached[alias].table(rest)
        return self.view(name) if name in self._fresh()["views"] else self._read(name)

    def register(self, name: str, df: DataFrame) -> Collection:
        """A DataFrame as a collection."""
        self._replace(name, df)
        return self.collection(name)

    # ---- SQL
    def sql(self, text: str, params: Any = None) -> Any:
        """The rows of a SELECT or of RETURNING; how many rows another statement touched. A SELECT that the document dialect doesn't know
        is Spark SQL, with its three-valued logic."""
        if not re.match(r"\s*(INSERT|UPDATE|DELETE)\b", text, re.I):
            return ansi.select(self.spark, text, self.table, [*self.collections(), *self._catalog["views"]], params)
        q = parse(text, params)
        c = self.collection(q.table)
        if isinstance(q, Insert):
            return self._sql_insert(c, q)
        if q.returning is None:
            return c.update_many(q.where, {"$set": q.values}) if isinstance(q, Update) else c.delete_many(q.where)
        with self.transaction() if self._staged is None else nullcontext():  # what returns and what changes are the same rows
            hit = c.find(q.where)
            if isinstance(q, Delete):
                gone = hit if q.returning == ["*"] else hit.select(*q.returning)  # its files stay, so it can be read after the deletion
                c.delete_many(q.where)
                return gone
            ids = [r["_id"] for r in hit.select("_id").collect()]  # the rows that the statement gives back
            c.update_many(q.where, {"$set": q.values})
            now = c.find({"_id": {"$in": ids}})
            return now if q.returning == ["*"] else now.select(*q.returning)

    def _sql_insert(self, c: Collection, q: Insert) -> Any:
        columns = q.columns or self._read(q.table).columns
        rows = [dict(zip(columns, r, strict=True)) for r in q.rows]
        for d in rows:
            d.setdefault("_id", str(uuid.uuid4()))
        done = rows
        with self.transaction() if q.conflict and self._staged is None else nullcontext():
            if q.conflict:
                key, values = q.conflict
                asked = {"$or": [{k: d.get(k) for k in key} for d in rows]}
                there = {tuple(r[k] for k in key) for r in c.find(asked).select(*key).collect()} if self._read(c.name).columns else set()
                fresh: dict[tuple, dict] = {}
                for d in rows:
                    at = tuple(d.get(k) for k in key)
                    if at in there or at in fresh:
                        if values is None:
                            continue
                        new = {k: d.get(v[1]) if isinstance(v, tuple) else v for k, v in values.items()}
                        if at in fresh:
                            fresh[at].update(new)
                        else:
                            c.update_many(dict(zip(key, at, strict=True)), {"$set": new})
                    else:
                        fresh[at] = d
                done = list(fresh.values())
            if done:
                c.insert_many(done)
        if q.returning is None:
            return len(done)
        now = c.find({"_id": {"$in": [d["_id"] for d in done]}}) if done else c.find({"$or": []})
        return now if q.returning == ["*"] else now.select(*q.returning)

    # ---- views
    def create_view(self, name: str, source: str, pipeline: list[dict], materialized: bool = False, refresh: str = "manual") -> None:
        """refresh: manual, or on_write of the source."""
        spec = {"source": source, "pipeline": pipeline, "materialized": materialized, "refresh": refresh}
        if materialized:
            spec["at"] = self._view_files(name, spec)
        self._edit(lambda c: c["views"].update({name: spec}))

    def _run_view(self, v: dict) -> DataFrame:
        return run_pipeline(self.table(v["source"]), v["pipeline"], tables=self.table)

    def _view_files(self, name: str, v: dict) -> str:
        at = uuid.uuid4().hex
        self._run_view(v).write.parquet(f"{self.path}/_views/{name}/{at}")
        return at

    def view(self, name: str) -> DataFrame:
        v = self._fresh()["views"][name]
        return self.spark.read.parquet(f"{self.path}/_views/{name}/{v['at']}") if v["materialized"] else self._run_view(v)

    def refresh_view(self, name: str) -> None:
        at = self._view_files(name, self._fresh()["views"][name])
        self._edit(lambda c: c["views"][name].update(at=at))

    def _refresh_on_write(self, source: str) -> None:
        for name, v in list(self._catalog["views"].items()):
            if v["materialized"] and v["refresh"] == "on_write" and v["source"] == source:
                self.refresh_view(name)

    def drop_view(self, name: str) -> bool:
        gone = self._edit(lambda c: c["views"].pop(name, None))
        files.delete(self.spark, f"{self.path}/_views/{name}")
        return gone is not None

    def views(self) -> list[dict]:
        return [{"name": n} | v for n, v in self._fresh()["views"].items()]

    # ---- relations
    def define_relation(self, name: str, source: str, target: str, local: str, foreign: str = "_id", on_delete: str = "restrict", one: bool = False) -> None:
        spec = {"name": name, "from": source, "to": target, "local": local, "foreign": foreign, "on_delete": on_delete, "one": one}
        self._edit(lambda c: c["relations"].update({name: spec}))

    def drop_relation(self, name: str) -> bool:
        return self._edit(lambda c: c["relations"].pop(name, None)) is not None

    def relations(self) -> list[dict]:
        return list(self._fresh()["relations"].values())

    def populate(self, relation: str, filter: Any = None, pipeline: list[dict] | None = None) -> DataFrame:  # noqa: A002
        r = self._fresh()["relations"][relation]
        other = self.table(r["to"])
        other = run_pipeline(other, pipeline, tables=self.table) if pipeline else other
        return relations.populate(find(self.table(r["from"]), filter), other, r["local"], r["foreign"], relation, r["one"])

    def check_relation(self, relation: str) -> DataFrame:
        r = self._fresh()["relations"][relation]
        return relations.violations(self.table(r["from"]), self.table(r["to"]), r["local"], r["foreign"])

    # ---- triggers
    def create_trigger(self, name: str, when: str, op: str, collection: str, f: Callable) -> None:
        """when: before or after; op: insert, update or delete. Runs in the driver, document by document: of inserts for those that come
        from Python, which a `before` trigger may change; of updates and deletes for all that change."""
        self._trigger.append((name, when, op, collection, f))

    def drop_trigger(self, name: str) -> None:
        self._trigger = [t for t in self._trigger if t[0] != name]

    def _triggers(self, when: str, op: str, collection: str) -> list[Callable]:
        return [f for _, w, o, c, f in self._trigger if (w, o, c) == (when, op, collection)]

    # ---- transactions
    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Its writes become current together when the block ends, and not at all if it raises."""
        if self._staged is not None:
            raise DatabaseError("a transaction is open")
        t = Transaction(self)
        try:
            yield t
            t.commit()
        except BaseException:
            t.abort()
            raise

    def with_transaction(self, f: Callable[[Transaction], Any], retries: int = 8, wait: float = 0.005) -> Any:
        """Again after a conflict, waiting twice as long each time."""
        for k in range(retries + 1):
            try:
                with self.transaction() as t:
                    return f(t)
            except Conflict:
                if k == retries:
                    raise
                time.sleep(wait * 2**k * (0.5 + random.random() / 2))
        return None

    # ---- other databases, export and administration
    def attach(self, path: str, alias: str) -> None:
        self._attached[alias] = Database(self.spark, path, read_only=True)

    def detach(self, alias: str) -> bool:
        return self._attached.pop(alias, None) is not None

    def attached(self) -> list[str]:
        return sorted(self._attached)

    def _tables(self) -> dict[str, DataFrame]:
        return {n: self._read(n) for n in self.collections()}

    def export(self) -> dict[str, list[dict]]:
        return files.export_object(self._tables())

    def export_files(self, path: str, form: str = "ndjson", names: list[str] | None = None) -> None:
        files.export_files({n: df for n, df in self._tables().items() if names is None or n in names}, path, form)

    def import_file(self, name: str, path: str, form: str = "ndjson") -> int:
        new = files.import_file(self.spark, path, form)
        self.collection(name).insert_df(new if "_id" in new.columns else new.withColumn("_id", F.expr("uuid()")))
        return new.count()

    def backup(self, path: str) -> dict:
        return files.backup(self.spark, self._tables(), path)

    def restore(self, path: str) -> None:
        for name, df in files.restore(self.spark, path).items():
            self._replace(name, df)

    def put_blob(self, data: bytes) -> str:
        key = str(uuid.uuid4())
        one = self.spark.createDataFrame([(key, bytearray(data))], "blob_id string, data binary")
        files.chunked(one).write.mode("append").parquet(f"{self.path}/_blobs")
        return key

    def get_blob(self, key: str) -> bytes | None:
        row = files.reassembled(self.spark.read.parquet(f"{self.path}/_blobs").where(F.col("blob_id") == key)).first()
        return None if row is None else bytes(row["data"])

    def watch(self, callback: Callable[[dict], None], since: int = 0, once: bool = False) -> Any:
        return changes.watch(changes.stream(self.spark, self._log, since=since), callback, f"{self.path}/_watch/{uuid.uuid4().hex}", once)

    def changes(self, since: int = 0, collection: str | None = None) -> DataFrame:
        return changes.read_since(self.spark, self._log, since, collection)

    def pragma(self, name: str, *value: Any) -> Any:
        if value:
            self._edit(lambda c: c["pragmas"].update({name: value[0]}))
        return self._fresh()["pragmas"].get(name)

    def check_filter(self, spec: Any, **limits: Any) -> None:
        check_filter(spec, **limits)

    def metrics(self) -> dict:
        return {"collections": len(self.collections()), "views": len(self._catalog["views"]), "relations": len(self._catalog["relations"]), "changes": self._fresh()["seq"], "uptime_s": time.time() - self._started, "spark": self.spark.version}


class Transaction:
    """Manifests that no catalog lists yet. Reads inside see them, and of other collections what was current when it began; savepoints
    are copies of the list."""

    def __init__(self, db: Database) -> None:
        self.db = db
        db._fresh()
        self.base = {n: db._manifest(n) for n in db._catalog["collections"]}
        db._staged, db._pending, db._sessions = {}, [], []
        self._points: dict[str, tuple[dict, list, list]] = {}

    def savepoint(self, name: str) -> None:
        if len(self._points) >= 16:
            raise DatabaseError("there are 16 savepoints already")
        self._points[name] = (dict(self.db._staged or {}), list(self.db._pending), list(self.db._sessions))

    def rollback_to(self, name: str) -> None:
        staged, pending, sessions = self._points[name]
        self.db._staged, self.db._pending, self.db._sessions = dict(staged), list(pending), list(sessions)

    def commit(self) -> None:
        db, staged, pending, sessions = self.db, self.db._staged or {}, self.db._pending, self.db._sessions
        db._staged, db._pending, db._sessions = None, [], []
        if not staged:
            return
        if db._commit(staged, {n: self.base.get(n) for n in staged}, pending, sessions) is None:
            raise Conflict(f"{', '.join(staged)}: changed meanwhile")
        for name in staged:
            db._refresh_on_write(name)

    def abort(self) -> None:
        self.db._staged, self.db._pending, self.db._sessions = None, [], []
