"""Batches, jobs and NDJSON as DataFrame operators.

An item is (pos, id, op, svg, token_ids, level, lean); its result is (pos, id, ok, token_ids, svg,
n_tokens, lean, level, compression_ratio, error). pos is the item's place, where the caller has
one: results are rows, and an order is what a sort by pos gives.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import STATUS, EngineError
from ..functions import ids, tokens
from ..sources import shared
from . import bpe, codec, configured

ITEM = "id string, op string, svg string, token_ids array<int>, level string, lean boolean"
RESULT = ["id", "ok", "token_ids", "svg", "n_tokens", "lean", "level", "compression_ratio", "error"]
ERROR = "struct<code:string,message:string,detail:map<string,string>,status:int>"
MOST_ITEMS, MOST_BYTES, INLINE = 1000, 32 * 1024 * 1024, 10_000
OPS = ("tokenize", "detokenize")
#: A job's state is stored again once so many more items are done, looked at every so many seconds.
EVERY, LOOK = 50, 0.1
FINAL = ("succeeded", "failed", "partial", "cancelled")


def strip_scheme(uri: str) -> str:
    return uri[len("file://"):] if uri.startswith("file://") else uri


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Items of the lines of files, with pos; blank lines are passed over, a bad line gets an error instead of an item."""
    return items(spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()))


def items(lines: DataFrame) -> DataFrame:
    """Item columns and bad from a column value of JSON lines; other columns stay."""
    rows = lines.filter(F.col("value").rlike(r"(?U)\S")).withColumn("i", F.from_json("value", ITEM + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    others = [c for c in lines.columns if c != "value"]
    return rows.select(*others, "i.id", "i.op", "i.svg", "i.token_ids", "i.level", "i.lean", (F.col("i._bad").isNotNull() | F.col("i").isNull()).alias("bad"))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def check_batch(rows: DataFrame, op: str) -> None:
    """Refuses an unknown operation, too many items, or too many bytes in all."""
    if op not in OPS:
        raise EngineError("INVALID_REQUEST", f"unknown op '{op}'", op=op)
    n, size = rows.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("svg"), F.lit(0)) + 4 * F.coalesce(F.array_size("token_ids"), F.lit(0)))).first()
    if n > MOST_ITEMS:
        raise EngineError("PAYLOAD_TOO_LARGE", f"items exceed {MOST_ITEMS}", limit=MOST_ITEMS)
    if (size or 0) > MOST_BYTES:
        raise EngineError("PAYLOAD_TOO_LARGE", f"batch payload exceeds {MOST_BYTES} bytes", limit=MOST_BYTES)


def _with_detail(error: str, upper: int | str) -> str:
    """SQL: an error of code and message with what its code has to add."""
    none = "cast(NULL AS MAP<STRING,STRING>)"
    detail = (
        f"CASE {error}.code WHEN 'PAYLOAD_TOO_LARGE' THEN map('limit', regexp_extract({error}.message, '([0-9]+) bytes', 1)) WHEN 'PARSE_UNSUPPORTED_ELEMENT' THEN map('reason', regexp_extract({error}.message, '^<(.*)> not', 1)) "
        f"WHEN 'VOCAB_MISMATCH' THEN map('max_id', cast({upper} AS STRING)) ELSE {none} END"
    )
    status = f"CASE {error}.code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATUS.items()) + " END"
    return f"IF({error} IS NULL, NULL, named_struct('code', {error}.code, 'message', {error}.message, 'detail', {detail}, 'status', {status}))"


def process(rows: DataFrame, lean: bool = False, merges: list | None = None, code: str | None = None, level: str = "L1", configs: configured.Configs | None = None) -> DataFrame:
    """The result of each item. An item's own level and lean come before the batch's; code, if given, replaces the codes of its own errors.

    An item without op is what it has: token_ids, else a drawing; a missing drawing counts as an
    empty text, missing token_ids as an empty stream. With configs an item has a vocab_id, and its configuration's
    canvas, level and merges stand for the batch's.
    """
    place = [c for c in ("pos",) if c in rows.columns]
    for name, kind in (("op", "string"), ("level", "string"), ("lean", "boolean")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    given = F.when(F.col("token_ids").isNotNull() & F.col("svg").isNull(), "detokenize").otherwise("tokenize")
    rows = rows.withColumns({"op": F.coalesce("op", given), "lean": F.coalesce("lean", F.lit(lean)), "level": F.upper(F.coalesce("level", F.lit(level)))})
    enc = rows.filter("op = 'tokenize'").drop("token_ids").withColumn("svg", F.coalesce("svg", F.lit("")))
    if configs:
        enc = configured.l1(enc, configs)
    else:
        enc = codec.l1(codec.parsed(enc), False)
    enc = enc.withColumn("token_ids", F.expr(f"IF(error IS NOT NULL, NULL, IF(lean, {tokens.lean_of('token_ids')}, token_ids))"))
    if configs:
        enc = configured.merged(enc, configs, "level = 'L2'")
    elif merges:
        enc = bpe.encode(enc.withColumn("_l2", F.when(F.col("level") == "L2", F.col("token_ids"))), merges, "_l2")
        enc = enc.withColumn("token_ids", F.coalesce("_l2", "token_ids")).drop("_l2")
    enc = enc.withColumn("compression_ratio", F.expr(codec.ratio("svg", "token_ids"))).withColumn("svg", F.lit(None).cast("string"))
    enc = enc.withColumn("level", F.when((F.col("level") == "L2") & (F.col("_n_merges") > 0 if configs else F.lit(bool(merges))), "L2").otherwise("L1"))
    dec = rows.filter("op = 'detokenize'").drop("svg").withColumn("tokenizer_version", F.lit(ids.TOKENIZER_VERSION)).withColumn("token_ids", F.coalesce("token_ids", F.array().cast("array<int>")))
    dec = (configured.detokenize(dec, configs, keep=True) if configs else codec.detokenize(dec, merges)).withColumn("svg", F.when(F.col("error").isNull(), F.col("svg"))).withColumn("compression_ratio", F.lit(None).cast("double")).withColumn("level", F.lit(None).cast("string"))
    own = F.expr(_with_detail("error", "_upper" if configs else ids.VOCAB + len(merges or [])))
    if code:
        own = F.when(F.col("error").isNotNull(), F.struct(F.lit(code).alias("code"), F.col("error.message").alias("message"), F.lit(None).cast("map<string,string>").alias("detail"), F.lit(None).cast("int").alias("status")))
    ok = F.col("error").isNull()
    one = lambda df: df.select(
        *place, "id", ok.alias("ok"), F.when(F.col("op") == "tokenize", F.col("token_ids")).alias("token_ids"), "svg", F.when(ok, F.size("token_ids")).alias("n_tokens"), "lean",
        F.when(ok, F.col("level")).alias("level"), F.when(ok, F.col("compression_ratio")).alias("compression_ratio"), own.alias("error"),
    )
    unknown = F.struct(F.lit("INVALID_REQUEST").alias("code"), F.format_string("unknown op '%s'", "op").alias("message"))
    other = rows.filter("op NOT IN ('tokenize', 'detokenize')").withColumns({
        "error": unknown, "token_ids": F.lit(None).cast("array<int>"), "svg": F.lit(None).cast("string"), "level": F.lit(None).cast("string"), "compression_ratio": F.lit(None).cast("double"), "_upper": F.lit(None).cast("int"),
    })
    return one(enc).unionByName(one(dec)).unionByName(one(other))


def batch(rows: DataFrame, op: str, lean: bool = False, on_error: str = "skip", level: str = "L1", merges: list | None = None) -> DataFrame:
    """Results of a checked batch, whose items all have its op, level and lean; on_error fail_fast raises on the first error when it is read."""
    check_batch(rows, op)
    out = process(rows.drop("level", "lean").withColumn("op", F.lit(op)), lean, merges, level=level)
    if on_error == "fail_fast":
        out = out.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat("error.code", F.lit(": "), "error.message")).cast("boolean")))
    return out


def counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def health(spark: SparkSession, manifest_hash: str, has_l2: bool = False) -> DataFrame:
    return spark.createDataFrame([("ok", ids.TOKENIZER_VERSION, ids.VOCAB_ID, has_l2, manifest_hash)], "status string, tokenizer_version string, vocab_id string, has_l2 boolean, manifest_hash string")


def post_to(url: str, timeout: float = 5.0) -> Callable[[dict], None]:
    """A webhook that posts a job's view as JSON."""

    def post(view: dict) -> None:
        body = json.dumps(view, default=str).encode()
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).close()

    return post


def counting(results: DataFrame, ok, failed) -> DataFrame:
    """results, whose rows are added to two accumulators as they pass: what a task adds is seen at its end.

    A task that runs twice adds twice, so the sums are for progress, and final counts come from what is stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pc.sum(batch.column("ok")).as_py() or 0
            ok.add(good)
            failed.add(len(batch) - good)
            yield batch

    return results.mapInArrow(run, results.schema)


class MemoryStore:
    """States of jobs in the driver's memory."""

    def __init__(self):
        self.states: dict[str, dict] = {}

    def put(self, state: dict) -> None:
        self.states[state["job_id"]] = dict(state)

    def get(self, job: str) -> dict | None:
        return self.states.get(job)


class FolderStore:
    """States of jobs as JSON files of a folder that Spark can write, so that another driver finds them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, state: dict) -> None:
        shared.write_text(self.spark, f"{self.folder}/{state['job_id']}.json", json.dumps(state))

    def get(self, job: str) -> dict | None:
        path = f"{self.folder}/{job}.json"
        return json.loads(shared.read_text(self.spark, path)) if shared.exists(self.spark, path) else None


class Jobs:
    """Jobs that run in threads of the driver as tagged Spark jobs, and leave their results in a folder."""

    def __init__(self, spark: SparkSession, folder: str, webhook: Callable[[dict], None] | None = None, store=None, merges: list | None = None, every: int = EVERY):
        self.every = every
        self.spark, self.folder, self.webhook, self.merges = spark, folder.rstrip("/"), webhook, merges
        self.store, self.threads, self.lock = store or MemoryStore(), {}, threading.RLock()

    def submit(self, rows: DataFrame | None = None, lean: bool = False, *, input_uri: str | None = None, op: str | None = None, level: str = "L1", on_error: str = "skip", output_uri: str | None = None) -> str:
        """Start a job over rows or the NDJSON files of input_uri, one of them; items' own op, level and lean come before the job's."""
        if op is not None and op not in OPS:
            raise EngineError("INVALID_REQUEST", f"unknown op '{op}'", op=op)
        if (rows is None) == (input_uri is None):
            raise EngineError("INVALID_REQUEST", "provide items or input_uri")
        job = "job_" + uuid.uuid4().hex[:16]
        self.store.put({
            "job_id": job, "op": op, "status": "queued", "created_at": time.time(), "started_at": None, "finished_at": None, "total": 0, "done": 0, "n_ok": 0, "n_failed": 0, "error": None,
            "results_uri": output_uri or f"{self.folder}/{job}", "tokenizer_version": ids.TOKENIZER_VERSION, "vocab_id": ids.VOCAB_ID,
        })
        t = threading.Thread(target=self._run, args=(job, rows, input_uri, op, level, lean, on_error), daemon=True)
        self.threads[job] = t
        t.start()
        return job

    def _set(self, job: str, **what) -> bool:
        with self.lock:
            state = self.store.get(job)
            if state["status"] in FINAL:
                return False
            self.store.put(state | what)
            return True

    def _run(self, job: str, rows: DataFrame | None, input_uri: str | None, op: str | None, level: str, lean: bool, on_error: str) -> None:
        if not self._set(job, status="running", started_at=time.time()):
            return
        self.spark.sparkContext.addJobTag(job)
        try:
            if rows is None:
                rows = read_ndjson(self.spark, strip_scheme(input_uri)).filter("NOT bad").drop("bad")
            if op:
                rows = rows.withColumn("op", F.coalesce(F.col("op"), F.lit(op)) if "op" in rows.columns else F.lit(op))
            self._set(job, total=rows.count())
            out = process(rows, lean, self.merges, code="ITEM_ERROR", level=level)
            if on_error == "fail_fast":
                out = out.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.col("error.message")).cast("boolean")))
            with self._watched(job, out) as watched:
                watched.write.mode("overwrite").parquet(self.store.get(job)["results_uri"])
            ok, failed = counts(self.results(job)).first()
            self._set(job, status="succeeded" if not failed else "partial", n_ok=ok, n_failed=failed, done=ok + failed, total=ok + failed, finished_at=time.time())
        except Exception as e:  # whatever ends the job is its state
            self._set(job, status="failed", error={"code": "JOB_FAILED", "message": str(e)[:500]}, finished_at=time.time())
        finally:
            self.spark.sparkContext.removeJobTag(job)
        if self.webhook:
            try:
                self.webhook(self.get(job))
            except Exception:  # a receiver's failure isn't the job's
                pass

    @contextlib.contextmanager
    def _watched(self, job: str, out: DataFrame) -> Iterator[DataFrame]:
        """out, and a thread that stores how much of it is done while it is written."""
        ok, failed = (self.spark.sparkContext.accumulator(0) for _ in range(2))
        total, ended = self.store.get(job)["total"], threading.Event()

        def look() -> None:
            seen = 0
            while not ended.wait(LOOK):
                good, bad = ok.value, failed.value
                if good + bad >= seen + self.every and good + bad <= total:
                    seen = good + bad
                    self._set(job, done=seen, n_ok=good, n_failed=bad)

        watcher = threading.Thread(target=look, daemon=True)
        watcher.start()
        try:
            yield counting(out, ok, failed)
        finally:
            ended.set()
            watcher.join()

    def results(self, job: str) -> DataFrame:
        return self.spark.read.parquet(self.store.get(job)["results_uri"])

    def get(self, job: str, include_results: bool = False) -> dict:
        """The job's public view; include_results adds the results themselves, up to INLINE of them, in the order of pos."""
        state = self.store.get(job)
        if state is None:
            raise EngineError("JOB_NOT_FOUND", f"unknown job_id {job}", job_id=job)
        done = state["status"] in ("succeeded", "partial")
        out = dict(state) | {"partial": state["status"] == "partial", "progress": state["done"] / state["total"] if state["total"] else float(done), "inline": done and state["done"] <= INLINE}
        out["results_url"] = out.pop("results_uri") if done else out.pop("results_uri") and None
        if include_results and out["inline"]:
            rows = self.results(job)
            out["results"] = [r.asDict(recursive=True) for r in (rows.orderBy("pos") if "pos" in rows.columns else rows).collect()]  # INLINE rows at most
        return out

    def wait(self, job: str, timeout: float | None = None) -> dict:
        if job in self.threads:
            self.threads[job].join(timeout)
        return self.get(job)

    def cancel(self, job: str) -> bool:
        """Whether the job was stopped: not if it has ended."""
        self.get(job)
        if not self._set(job, status="cancelled", finished_at=time.time()):
            return False
        self.spark.sparkContext.cancelJobsWithTag(job)
        return True
