"""The catalog: collections, files, chunks and vectors as tables; listing, paging, point reads, upserts and cascades.

Reads are expressions over the tables. `Catalog` stores them below one path: the list of collections, a list of files for
each collection, and a folder of chunks for each version that a save or a bulk ingest has made, in which a file's rows lie
together. A change writes new folders beside the old ones and then renames a numbered pointer file into place that names
all of them at once: a write that fails before changes nothing, and a file's row and its chunks cannot disagree, as the
row names the version of its chunks. If another writer was first, the change is made again from the state that it left;
chunks that have been written are not written again. Only what a change concerns is written anew.

Old pointers stay readable as snapshots until `clean`, which keeps the last ones and deletes every folder that none of
them reaches.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources import shared

SCHEMAS = {
    "kb": "kb_id long, name string, description string, created_at_ms long",
    "files": "kb_id long, file_id long, filename string, chunk_count int, status string, created_at_ms long, chunks_version string, upload string",
    "chunks": "file_id long, chunk_index int, content string, metadata string, embedding array<double>, kb_id long, version string",
    "uploads": "filename string, content binary",
}
#: Columns of a chunk as it is stored; kb_id and version are its folders.
STORED = SCHEMAS["chunks"].split(", kb_id")[0]
#: How often a change is made again when another writer was first.
TRIES = 8
ALLOWED = (".pdf", ".xlsx")


def page(files: DataFrame, number: int, size: int = 10) -> DataFrame:
    """Zero-based page in the order in which files were added."""
    if number < 0 or size < 0:
        raise ValueError("page and size must not be negative")
    return files.orderBy("file_id").offset(number * size).limit(size)


def pages_of(files: DataFrame, by: str, size: int = 10) -> DataFrame:
    """All pages at once: the rows with their page number in each collection."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(by).orderBy("file_id")) - 1
    return files.withColumn("page", F.floor(at / size).cast("int"))


def files_meta(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("file_id").distinct(), "file_id", "left_semi")


def with_mime(files: DataFrame) -> DataFrame:
    return files.withColumn("mime", T.mime_type(F.col("filename")))


def name_contains(query: str) -> Column:
    q = query.strip().lower()
    return F.contains(F.lower("filename"), F.lit(q)) if q else F.lit(True)


def chunk_contains(query: str) -> Column:
    q = query.strip().lower()
    return F.contains(F.lower("content"), F.lit(q)) | F.contains(F.col("chunk_index").cast("string"), F.lit(q)) if q else F.lit(True)


def read_chunks(chunks: DataFrame, specs: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks named by (file_id, chunk_index); repeated and null specs count once or not at all."""
    wanted = specs.where("file_id is not null and chunk_index is not null").select("file_id", "chunk_index").distinct()
    named = files.select("file_id", "filename")
    found = chunks.join(wanted, ["file_id", "chunk_index"], "left_semi").join(named, "file_id", "left")
    return found.withColumn("filename", F.coalesce("filename", F.lit("unknown")))


def upsert_uploads(files: DataFrame, uploads: DataFrame, next_id: Column) -> DataFrame:
    """Files after uploads by name: a known name keeps its id and starts over, new ones take the next ids in the order of
    their names. Names are numbered within the even ranges that Spark deals them to, which are counted before."""
    from pyspark.sql import Window

    new = uploads.select("filename").distinct().join(files.select("filename"), "filename", "left_anti")
    new = shared.saved(new.repartitionByRange("filename").withColumn("_range", F.spark_partition_id()), "new-names")
    counts = new.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("filename"))
    numbered = new.join(counts.select("_range", before.alias("_before")), "_range").select(
        (next_id + F.col("_before") + within - 1).alias("file_id"), "filename", F.lit(0).alias("chunk_count"), F.lit("uploaded").alias("status")
    )
    again = uploads.select("filename", F.lit(True).alias("again")).distinct()
    kept = files.join(again, "filename", "left").select(
        "file_id", "filename", F.when(F.col("again"), 0).otherwise(F.col("chunk_count")).alias("chunk_count"), F.when(F.col("again"), "uploaded").otherwise(F.col("status")).alias("status")
    )
    return kept.unionByName(numbered)


def without_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("file_id").distinct(), "file_id", "left_anti")


def default_meta(kb: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for every id: its stored row, or a made-up name where there is none."""
    return ids.join(kb, "kb_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Knowledge Base "), F.col("kb_id").cast("string"))))


class ChangedMeanwhile(ValueError):
    """Another writer has committed since the state was read."""


class Catalog:
    """Versioned tables below a path that driver and executors share, and whose renames fail if the target exists. A
    catalog opened `at` the number of a snapshot reads that state and refuses changes. An `indexed` one writes a segment
    of the keyword index with every version of chunks; so must all writers of its path, or their chunks are not found."""

    def __init__(self, spark: SparkSession, path: str, at: int | None = None, indexed: bool = False):
        self.spark, self.path, self.at, self.indexed = spark, path.rstrip("/"), at, indexed
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- pointers and folders

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def snapshots(self) -> list[int]:
        """Numbers of the states that can be read, the current one last."""
        return [int(x) for x in self._names("pointers") if x.isdigit()]

    def _read_state(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{number:012d}").first()[0])

    def _state(self) -> dict:
        """What the greatest pointer, or that of the snapshot, says: the version of the list of collections, of each
        collection's files, and the next file ids. A new path has none; a path with tables but without a pointer is
        damaged."""
        found = self.snapshots()
        if self.at is not None and self.at not in found:
            raise ValueError(f"there is no snapshot {self.at}")
        if not found:
            if self._fs.exists(self._path("kb")):
                raise ValueError(f"{self.path} holds tables but no pointer to their versions")
            return {"number": 0, "kb": None, "files": {}, "next": {}}
        return self._read_state(found[-1] if self.at is None else self.at)

    def _commit(self, state: dict) -> None:
        """Makes a state the current one by a rename, the last step of every change."""
        number = state["number"] + 1
        draft, target = self._path(f"pointers/draft-{uuid.uuid4().hex}"), self._path(f"pointers/{number:012d}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state | {"number": number}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise ChangedMeanwhile("the catalog has been changed meanwhile")

    def _change(self, make: Callable[[dict], tuple[dict | None, Any]]) -> Any:
        """Commits what `make` makes of the current state (None: no change), again from a newer one if another writer was
        first, and returns its result."""
        if self.at is not None:
            raise ValueError("a snapshot can't be changed")
        for left in range(TRIES - 1, -1, -1):
            state, result = make(self._state())
            if state is None:
                return result
            try:
                self._commit(state)
                return result
            except ChangedMeanwhile:
                if not left:
                    raise

    def _read(self, name: str, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{folder}")

    def _write(self, name: str, df: DataFrame, folder: str) -> str:
        columns = [F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in SCHEMAS[name].split(", ")]
        version = f"{folder}/{uuid.uuid4().hex}"
        df.select(*columns).write.parquet(f"{self.path}/{version}")
        return version

    def _with_kbs(self, state: dict, kb: DataFrame) -> dict:
        return state | {"kb": self._write("kb", kb, "kb")}

    def _with_files(self, state: dict, kb_id: int, files: DataFrame) -> dict:
        return state | {"files": state["files"] | {str(kb_id): self._write("files", files, f"files/{kb_id}")}}

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def _files(self, state: dict, kb_id: int) -> DataFrame:
        return self._read("files", state["files"].get(str(kb_id)))

    def clean(self, keep: int = 2) -> int:
        """Keeps the last snapshots and deletes the folders of tables, uploads and chunks that none of them names; returns
        how many went. No change may be under way."""
        if keep < 1:
            raise ValueError("the current state must be kept")
        numbers, tables, uploads, chunks = self.snapshots(), set(), set(), set()
        for number in numbers[-keep:]:
            state = self._read_state(number)
            tables |= {state["kb"], *state["files"].values()}
            for kb_id, folder in state["files"].items():
                # one row for each save or bulk ingest that is still live, not for each file
                files = self._read("files", folder).select("upload", F.concat(F.lit(f"kb_id={kb_id}/version="), F.col("chunks_version")).alias("chunks")).distinct()
                for row in files.toLocalIterator():
                    uploads.add(row["upload"])
                    chunks.add(row["chunks"])
        gone = [f"kb/{x}" for x in self._names("kb") if f"kb/{x}" not in tables]
        for table, named in (("files", tables), ("uploads", uploads)):
            gone += [x for kb in self._names(table) for v in self._names(f"{table}/{kb}") if (x := f"{table}/{kb}/{v}") not in named]
        gone += [f"chunks/{x}" for kb in self._names("chunks") for v in self._names(f"chunks/{kb}") if (x := f"{kb}/{v}") not in chunks]
        gone += [f"postings/{x}" for kb in self._names("postings") for v in self._names(f"postings/{kb}") if (x := f"{kb}/{v}") not in chunks]
        gone += [f"pointers/{x}" for x in self._names("pointers") if x.startswith("draft-")]
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"pointers/{number:012d}"), False)
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        return len(gone)

    # -- collections

    def list_kbs(self) -> DataFrame:
        return self._read("kb", self._state()["kb"]).orderBy(F.desc("created_at_ms"), "kb_id")

    def create_kb(self, name: str, description: str | None = None) -> int:
        """Highest id plus one, so the id of a deleted last collection comes again; starts without files."""

        def make(state: dict) -> tuple[dict, int]:
            kb = self._read("kb", state["kb"])
            kb_id = (kb.agg(F.max("kb_id")).first()[0] or 0) + 1
            row = self._rows("kb", [(kb_id, name, description, int(time.time() * 1000))])
            return self._without(self._with_kbs(state, kb.union(row)), kb_id), kb_id

        return self._change(make)

    @staticmethod
    def _without(state: dict, kb_id: int) -> dict:
        return state | {part: {k: v for k, v in state[part].items() if k != str(kb_id)} for part in ("files", "next")}

    def update_kb(self, kb_id: int, name: str | None = None, description: str | None = None) -> None:
        def make(state: dict) -> tuple[dict, None]:
            here, kb = F.col("kb_id") == kb_id, self._read("kb", state["kb"])
            for column, value in (("name", name), ("description", description)):
                if value is not None:
                    kb = kb.withColumn(column, F.when(here, F.lit(value)).otherwise(F.col(column)))
            return self._with_kbs(state, kb), None

        self._change(make)

    def delete_kb(self, kb_id: int) -> None:
        self._change(lambda state: (self._without(self._with_kbs(state, self._read("kb", state["kb"]).where(F.col("kb_id") != kb_id)), kb_id), None))

    # -- files

    def files(self, kb_id: int) -> DataFrame:
        return self._files(self._state(), kb_id).orderBy("file_id")

    def next_ids(self) -> DataFrame:
        """kb_id and the stored id that its next new file gets."""
        state = self._state()
        return self.spark.createDataFrame([(int(k), v) for k, v in state["next"].items()], "kb_id long, next_id long")

    def save_upload(self, kb_id: int, filename: str, content: bytes | None = None) -> int:
        """Registers an uploaded file by its base name and stores its content; a known name keeps its id and starts over.
        Ids are never used again."""
        name = filename.replace("\\", "/").rsplit("/", 1)[-1]
        if not name.lower().endswith(ALLOWED):
            raise ValueError("only .pdf and .xlsx files can be uploaded")
        stored = self._write("uploads", self._rows("uploads", [(name, bytearray(content))]), f"uploads/{kb_id}") if content is not None else None

        def make(state: dict) -> tuple[dict, int]:
            files, mine = self._files(state, kb_id), F.col("filename") == name
            known = files.where(mine).agg(F.min("file_id")).first()[0]
            if known is not None:
                fresh = {"chunk_count": F.lit(0), "status": F.lit("uploaded"), "chunks_version": F.lit(None).cast("string"), "upload": F.lit(stored).cast("string")}
                return self._with_files(state, kb_id, files.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in fresh.items()})), known
            file_id = state["next"].get(str(kb_id), 1)
            row = self._rows("files", [(kb_id, file_id, name, 0, "uploaded", int(time.time() * 1000), None, stored)])
            return self._with_files(state, kb_id, files.union(row)) | {"next": state["next"] | {str(kb_id): file_id + 1}}, file_id

        return self._change(make)

    def save_uploads(self, kb_id: int, uploads: DataFrame) -> int:
        """Registers many files (filename, content) in one change and stores their contents in one table; returns how many
        names there were. Of several uploads of one name one is kept. Names are numbered from the stored counter."""
        name = F.element_at(F.split(F.replace("filename", F.lit("\\"), F.lit("/")), "/"), -1)
        allowed = F.coalesce(F.endswith(F.lower(name), F.lit(ALLOWED[0])) | F.endswith(F.lower(name), F.lit(ALLOWED[1])), F.lit(False))
        checked = F.when(allowed, name).otherwise(F.raise_error(F.lit("only .pdf and .xlsx files can be uploaded")).cast("string"))
        stored = self._write("uploads", uploads.select(checked.alias("filename"), "content").dropDuplicates(["filename"]), f"uploads/{kb_id}")
        names = self._read("uploads", stored).select("filename")
        n = names.count()

        def make(state: dict) -> tuple[dict, int]:
            files, first = self._files(state, kb_id), state["next"].get(str(kb_id), 1)
            old = files.select("filename", F.col("created_at_ms").alias("_created"), "chunks_version", F.col("upload").alias("_upload"))
            again = names.withColumn("_again", F.lit(True))
            listed = upsert_uploads(files.select("file_id", "filename", "chunk_count", "status"), names, F.lit(first)).join(old, "filename", "left").join(again, "filename", "left")
            fresh = {
                "kb_id": F.lit(kb_id), "created_at_ms": F.coalesce("_created", F.lit(int(time.time() * 1000))),
                "chunks_version": F.when(F.col("_again").isNull(), F.col("chunks_version")), "upload": F.when(F.col("_again"), F.lit(stored)).otherwise(F.col("_upload")),
            }
            made = self._with_files(state, kb_id, listed.withColumns(fresh))
            last = self._files(made, kb_id).agg(F.max("file_id")).first()[0] or 0
            return made | {"next": state["next"] | {str(kb_id): max(first, last + 1)}}, n

        return self._change(make) if n else 0

    def upload(self, kb_id: int, filename: str) -> DataFrame:
        """file_id, filename and content of an upload."""
        row = self._files(self._state(), kb_id).where(F.col("filename") == filename).first()
        if row is None or row["upload"] is None:
            raise FileNotFoundError(f"{filename} has not been uploaded")
        found = self._read("uploads", row["upload"]).where(F.col("filename") == filename)
        return found.select(F.lit(row["file_id"]).cast("long").alias("file_id"), "filename", "content")

    def ingest(self, kb_id: int, filename: str, parse=None, embedder=None) -> int:
        """Chunks and, with an embedder, vectors of an upload, by its extension; returns the number of chunks. `parse` turns
        the bytes of a .pdf into text."""
        from millrace.operators import ingest

        upload = self.upload(kb_id, filename)
        with shared.scratch(self.spark):
            chunks = ingest.ingest_chunks(upload, ["file_id"], parse)
            if failed := chunks.where("error is not null").first():
                raise ValueError(failed["error"])
            return self.save_chunks(kb_id, upload.first()["file_id"], chunks.select("chunk_index", "content", "metadata"), embedder=embedder)

    def ingest_all(self, kb_id: int, parse=None, embedder=None) -> DataFrame:
        """Ingests every upload of a collection that waits for it, in one job and one commit. What fails keeps its state;
        returns file_id, filename and error of those."""
        from millrace.operators import ingest, vectors

        waiting = self._files(self._state(), kb_id).where("status = 'uploaded' and upload is not null").select("file_id", "filename", "upload")
        folders = [r["upload"] for r in waiting.select("upload").distinct().collect()]  # one for each call of save_uploads
        none = self.spark.createDataFrame([], "file_id long, filename string, error string")
        if not folders:
            return none
        # a file waits for the content of its own upload, not for an older one of its name
        of = F.regexp_extract(F.input_file_name(), r"(uploads/[^/]+/[^/]+)/[^/]*$", 1)
        stored = self.spark.read.schema(SCHEMAS["uploads"]).parquet(*[f"{self.path}/{x}" for x in folders]).withColumn("upload", of)
        contents = stored.join(waiting, ["upload", "filename"]).select("file_id", "filename", "content")
        with shared.scratch(self.spark):
            chunks = ingest.ingest_chunks(contents, ["file_id"], parse)
            made = shared.saved(vectors.embed(chunks, embedder) if embedder is not None else chunks.withColumn("embedding", F.lit(None).cast("array<double>")), "ingested")
            failed = made.where("error is not null").select("file_id", "error")
            failed = shared.saved(failed.join(waiting, "file_id").select("file_id", "filename", "error"), "ingest-errors", lasting=True)
            self._save(kb_id, made.where("error is null"))
        return failed

    def _store(self, kb_id: int, chunks: DataFrame) -> tuple[str, DataFrame]:
        """Writes chunks as a new version, those of a file together; the version and the number of chunks by file."""
        if self.at is not None:
            raise ValueError("a snapshot can't be changed")
        version = uuid.uuid4().hex
        where = f"{self.path}/chunks/kb_id={kb_id}/version={version}"
        columns = [F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in STORED.split(", ")]
        chunks.select(*columns).repartitionByRange("file_id", "chunk_index").sortWithinPartitions("file_id", "chunk_index").write.parquet(where)
        if self.indexed:
            from millrace.operators import keyword_index

            keyword_index.postings(self.spark.read.schema(STORED).parquet(where)).write.parquet(f"{self.path}/postings/kb_id={kb_id}/version={version}")
        return version, self.spark.read.schema(STORED).parquet(where).groupBy("file_id").agg(F.count("*").cast("int").alias("_n"))

    def _save(self, kb_id: int, chunks: DataFrame, also: int | None = None) -> None:
        """Replaces the chunks of all files that have a row, and of file `also`, in one change."""
        version, counts = self._store(kb_id, chunks)
        if also is not None:
            one = self.spark.range(1).select(F.lit(also).cast("long").alias("file_id"))
            counts = one.join(counts, "file_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        now = int(time.time() * 1000)

        def make(state: dict) -> tuple[dict, None]:
            done = F.col("_n").isNotNull()
            fresh = {"chunk_count": F.col("_n"), "status": F.lit("done"), "chunks_version": F.lit(version), "created_at_ms": F.lit(now)}
            files = self._files(state, kb_id).join(counts, "file_id", "left")
            return self._with_files(state, kb_id, files.withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in fresh.items()})), None

        self._change(make)

    def save_chunks(self, kb_id: int, file_id: int, chunks: DataFrame, dim: int | None = None, embedder=None) -> int:
        """Replaces a file's chunks and vectors in one step and marks it done; returns their number. chunks: chunk_index,
        content and optionally metadata and embedding; an embedder makes the vectors of those that are not blank."""
        from millrace.operators import vectors

        if embedder is not None:
            chunks = vectors.embed(chunks, embedder)
        for column, kind in (("metadata", "string"), ("embedding", "array<double>")):
            if column not in chunks.columns:
                chunks = chunks.withColumn(column, F.lit(None).cast(kind))
        if dim is not None:
            chunks = vectors.checked_dimension(chunks.where("embedding is not null"), dim).unionByName(chunks.where("embedding is null"))
        self._save(kb_id, chunks.withColumn("file_id", F.lit(file_id).cast("long")), also=file_id)
        return self._files(self._state(), kb_id).where(F.col("file_id") == file_id).agg(F.max("chunk_count")).first()[0] or 0

    def save_all(self, kb_id: int, chunks: DataFrame) -> None:
        """Replaces the chunks (file_id, chunk_index, content and optionally metadata and embedding) of all files that have
        any, in one change."""
        for column, kind in (("metadata", "string"), ("embedding", "array<double>")):
            if column not in chunks.columns:
                chunks = chunks.withColumn(column, F.lit(None).cast(kind))
        self._save(kb_id, chunks)

    def add_vectors(self, kb_id: int, file_id: int, rows: DataFrame) -> int:
        """Appends chunks with vectors to a file; all must have the dimension of the vectors that it has."""
        from millrace.operators import vectors

        old = self.chunks(kb_id, file_id).select("chunk_index", "content", "metadata", "embedding")
        if first := old.where("embedding is not null").first():
            rows = vectors.checked_dimension(rows, len(first["embedding"]))
        return self.save_chunks(kb_id, file_id, old.unionByName(rows, allowMissingColumns=True))

    def all_chunks(self, kb_ids: list[int]) -> DataFrame:
        """kb_id, file_id, filename and the chunks of all files of some collections; folders that no file names are
        pruned by the join."""
        state = self._state()
        files = None
        for kb_id in kb_ids:
            own = self._files(state, kb_id).select("kb_id", "file_id", "filename", F.col("chunks_version").alias("version"))
            files = own if files is None else files.union(own)
        if files is None or not self._fs.exists(self._path("chunks")):
            return self.spark.createDataFrame([], SCHEMAS["chunks"]).drop("version").withColumn("filename", F.lit(""))
        stored = self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{self.path}/chunks").where(F.col("kb_id").isin(list(kb_ids)))
        return stored.join(files, ["kb_id", "file_id", "version"]).drop("version")

    def keyword_search(self, kb_ids: list[int], query: str, k: int = 5) -> DataFrame:
        """The k best chunks of every collection by the index: kb_id, file_id, chunk_index, score, rank and content."""
        from millrace.operators import keyword_index

        state, live, columns = self._state(), None, ["kb_id", "file_id", "chunk_index", "score", "rank", "content"]
        for kb_id in kb_ids:
            own = self._files(state, kb_id).select("kb_id", "file_id", F.col("chunks_version").alias("version"))
            live = own if live is None else live.union(own)
        if live is None or not self._fs.exists(self._path("postings")):
            return self.spark.createDataFrame([], "kb_id long, file_id long, chunk_index int, score double, rank int, content string")
        # hits are checked against the files in the index, so contents need no join with these
        mine = F.col("kb_id").isin(list(kb_ids))
        chunks = self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{self.path}/chunks").where(mine).select("kb_id", "version", *keyword_index.KEY, "content")
        stored = self.spark.read.schema(f"{keyword_index.POSTING}, kb_id long, version string").parquet(f"{self.path}/postings").where(mine)
        with shared.scratch(self.spark):
            index = keyword_index.KeywordIndex.of(stored, ["kb_id", "version", *keyword_index.KEY], live)
            hits = keyword_index.search(index, chunks, query, k, by=("kb_id",)).hits
            return shared.saved(chunks.join(F.broadcast(hits), index.keys).select(*columns), "keyword-found", lasting=True)

    def chunks(self, kb_id: int, file_id: int) -> DataFrame:
        row = self._files(self._state(), kb_id).where(F.col("file_id") == file_id).first()
        if row is None or row["chunks_version"] is None:
            return self.spark.createDataFrame([], SCHEMAS["chunks"]).drop("version")
        folder = f"{self.path}/chunks/kb_id={kb_id}/version={row['chunks_version']}"
        own = self.spark.read.schema(STORED).parquet(folder).where(F.col("file_id") == file_id)
        return own.withColumn("kb_id", F.lit(kb_id).cast("long")).orderBy("chunk_index")

    def delete_files(self, kb_id: int, gone: DataFrame) -> int:
        """Removes all files that `gone` names by file_id in one change; returns how many there were."""
        ids = gone.select(F.col("file_id").cast("long").alias("file_id")).distinct()

        def make(state: dict) -> tuple[dict | None, int]:
            files = self._files(state, kb_id)
            n = files.join(ids, "file_id", "left_semi").count()
            return (self._with_files(state, kb_id, without_files(files, ids)) if n else None), n

        return self._change(make)

    def delete_file(self, kb_id: int, file_id: int) -> bool:
        return self.delete_files(kb_id, self.spark.createDataFrame([(file_id,)], "file_id long")) > 0

    def delete_file_global(self, file_id: int) -> bool:
        """The file of that id in the lowest collection that has one."""
        return any(self.delete_file(kb_id, file_id) for kb_id in sorted(map(int, self._state()["files"])))

    def delete_vectors(self, kb_id: int, **fields) -> int:
        """Removes the vectors (not the chunks) that match, of files that have any; returns how many."""
        from millrace.operators.vectors import matching

        hit = F.coalesce(F.col("embedding").isNotNull() & matching(**fields), F.lit(False))
        chunks = self.all_chunks([kb_id]).withColumn("_hit", hit)
        concerned = chunks.where("_hit").groupBy("file_id").agg(F.count("*").alias("_n"))
        n = concerned.agg(F.sum("_n")).first()[0] or 0
        if n:
            left = chunks.join(concerned, "file_id").withColumn("embedding", F.when(~F.col("_hit"), F.col("embedding")))
            self._save(kb_id, left)
        return n

    def clear_vectors(self, kb_id: int) -> int:
        return self.delete_vectors(kb_id)
