"""Export archives: listing, fingerprints and the landing job.

A zip archive cannot be split, so one task reads one archive, once, streaming
member by member and element by element. After landing everything is columnar.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Names of conversation shards and of metadata members.
SHARD_NAME = r"(?i)^conversations(-\d+)?\.json$"
SIDECAR_HINTS = [
    "asset", "file_names", "file-names", "feedback", "message_feedback",
    "shared_conversations", "model_comparisons", "user", "chat_metadata",
    "group_chats", "library_files", "export_manifest", "user_settings",
    "codex",
]
EDGE_BYTES = 1 << 20
CONVERSATION_KEYS = {"mapping", "title", "current_node"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """Archives below a path, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("basename"), F.col("length").alias("size"), "modificationTime"
    )


def sizes(spark: SparkSession, path: str, prefix_depth: int) -> DataFrame:
    """Bytes stored below each path prefix of ``prefix_depth`` segments under ``path``."""
    listed = files(spark, path)
    rest = F.split(F.regexp_replace("path", f"^.*?{re.escape(path.rstrip('/'))}/", ""), "/")
    return listed.groupBy(F.array_join(F.slice(rest, 1, prefix_depth), "/").alias("prefix")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Content hash of each file over its size and its first and last MiB."""
    listed = files(spark, path).select("path", "basename", "size")
    schema = "path string, basename string, size bigint, content_hash string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(content_hash=[_edge_hash(p, int(s)) for p, s in zip(frame["path"], frame["size"])])

    return listed.mapInPandas(run, schema)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/+", "/", path))
    return system.open_input_file(inner)


def _edge_hash(path: str, size: int) -> str:
    digest = hashlib.sha256(str(size).encode())
    with _open(path) as f:
        digest.update(f.read(EDGE_BYTES))
        if size > EDGE_BYTES:
            f.seek(max(EDGE_BYTES, size - EDGE_BYTES))
            digest.update(f.read(EDGE_BYTES))
    return digest.hexdigest()


def members(listed: DataFrame) -> DataFrame:
    """Member names and sizes of each archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with _open(path) as f, zipfile.ZipFile(f) as z:
                    rows = [(path, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "member", "size"])

    return listed.select("path").mapInPandas(run, "path string, member string, size bigint")


def pick_shards(member_rows: DataFrame) -> DataFrame:
    """Conversation shards of each archive: by name, else its largest likely JSON member."""
    base = F.lower(F.element_at(F.split("member", "/"), -1))
    hinted = F.exists(F.array(*[F.lit(h) for h in SIDECAR_HINTS]), lambda h: F.contains(base, h))
    tier = (
        F.when(base.rlike(SHARD_NAME), 0)
        .when(F.lower("member").endswith(".json"), F.when(hinted, 2).otherwise(1))
    )
    ranked = member_rows.withColumn("tier", tier).where("tier IS NOT NULL")
    best = ranked.groupBy("path").agg(F.min("tier").alias("best"))
    order = Window.partitionBy("path").orderBy(F.desc("size"), "member")
    kept = ranked.join(best, "path").where("tier = best").withColumn("n", F.row_number().over(order))
    return kept.where("tier = 0 OR n = 1").select("path", "member", "size")


def _elements(stream: io.TextIOBase, chunk: int = 1 << 20) -> Iterator[str]:
    """JSON texts of the elements of a top-level array, or of the values of an object, one at a time."""
    decoder, buffer, at, done = json.JSONDecoder(), "", 0, False

    def fill() -> None:
        nonlocal buffer, at, done
        # Reading as much again as is already held keeps one huge element linear.
        more = stream.read(max(chunk, len(buffer) - at))
        done = not more
        buffer, at = buffer[at:] + more, 0

    def skip(chars: str) -> str:
        nonlocal at
        while True:
            while at < len(buffer) and buffer[at] in chars:
                at += 1
            if at < len(buffer) or done:
                return buffer[at : at + 1]
            fill()

    def value():
        nonlocal at
        while True:
            try:
                got, end = decoder.raw_decode(buffer, at)
                # A bare number or a value at the very end may continue in the next chunk.
                if end < len(buffer) or done:
                    text, at = buffer[at:end], end
                    return got, text
            except ValueError:
                if done:
                    raise
            fill()

    fill()
    opener = skip(" \t\r\n\ufeff")
    if opener not in ("[", "{"):
        raise ValueError("neither an array nor an object")
    at += 1
    while True:
        nxt = skip(" \t\r\n,")
        if nxt in ("]", "}"):
            return
        if not nxt:
            raise ValueError("the shard ends in the middle")
        key = None
        if opener == "{":
            key, _ = value()
            if skip(" \t\r\n") != ":":
                raise ValueError("a key without a value")
            at += 1
            skip(" \t\r\n")
            if key == "conversations" and buffer[at : at + 1] == "[":
                at += 1
                opener = "["
                continue
        got, text = value()
        if isinstance(got, dict) and CONVERSATION_KEYS & got.keys():
            yield text


def land(shards: DataFrame) -> DataFrame:
    """One row per conversation: path, member, pos, conversation (JSON text).

    A shard that is corrupt or holds nothing usable gives one row without a
    conversation and with ``error``, so its loss is counted, not hidden.
    """
    schema = "path string, member string, pos bigint, conversation string, error string"
    cols = ["path", "member", "pos", "conversation", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, member in zip(frame["path"], frame["member"]):
                rows, pos = [], 0
                try:
                    with _open(path) as f, zipfile.ZipFile(f) as z, z.open(member) as raw:
                        for text in _elements(io.TextIOWrapper(raw, encoding="utf-8-sig")):
                            rows.append((path, member, pos, text, None))
                            pos += 1
                            if len(rows) >= 500:
                                yield pd.DataFrame(rows, columns=cols)
                                rows = []
                    if pos == 0:
                        rows.append((path, member, None, None, "no conversations"))
                except (ValueError, OSError, zipfile.BadZipFile) as exc:
                    rows.append((path, member, None, None, str(exc)))
                if rows:
                    yield pd.DataFrame(rows, columns=cols)

    return shards.select("path", "member").repartition("path", "member").mapInPandas(run, schema)


def shard_accounting(landed: DataFrame) -> DataFrame:
    """Per archive: shards seen and shards that gave at least one conversation."""
    per = landed.groupBy("path", "member").agg(F.count("conversation").alias("n"))
    return per.groupBy("path").agg(
        F.count(F.lit(1)).alias("shards_total"), F.count_if(F.col("n") > 0).alias("shards_parsed"), F.sum("n").alias("conversations")
    )


def conversations(landed: DataFrame) -> DataFrame:
    """The landed conversations; refuses an export that held none at all."""
    rows = landed.where("conversation IS NOT NULL")
    if rows.isEmpty():
        raise ValueError("no conversation in any shard")
    return rows
