"""Queries over files, batches, jobs, streams and merge tables."""

from __future__ import annotations

import contextlib
import http.server
import json
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import STATUS, EngineError
from ..functions import ids
from ..operators import bpe, codec, evaluation, manifest, service
from ..sources import files, remote, shared
from ..streaming import ndjson
from . import fixtures as fx
from .core import _DRAWN, _ITEMS, _MANIFEST, _PAIRS, LINES, MERGES, PART, TEXT, TOKENS, batch_items, d_id
from .drawn import _DOCS, documents, parts
from .registry import query

_SVG = "CASE WHEN (conv_id + turn) % 17 = 0 THEN '<svg><rect' WHEN (conv_id + turn) % 17 = 1 THEN NULL WHEN (conv_id + turn) % 17 = 2 THEN '<svg><use/></svg>' ELSE '<svg><path d=\"M' || (conv_id % 300) || ' ' || (turn * 5) || 'L100 100\"/></svg>' END"


# Batches.
_KIND = "CASE k % 7 WHEN 3 THEN 'detokenize' WHEN 5 THEN 'detokenize' WHEN 6 THEN 'paint' ELSE 'tokenize' END"


@query(
    "v3_mixed_batch",
    f"WITH {_DOCS}, q AS (SELECT *, doc_id % 7 AS m, length(svg) AS n FROM v) SELECT doc_id AS pos, 'i' || doc_id AS id, m < 4 AS ok, (CASE m WHEN 0 THEN 13 WHEN 1 THEN 14 WHEN 2 THEN 12 WHEN 3 THEN 5 END)::INT AS n_tokens, "
    "CASE m WHEN 0 THEN 'L1' WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' END AS level, m <> 1 AS lean, CASE m WHEN 0 THEN round_even(n / 13.0::DOUBLE, 4) WHEN 1 THEN round_even(n / 14.0::DOUBLE, 4) WHEN 2 THEN round_even(n / 12.0::DOUBLE, 4) END AS compression_ratio, "
    "CASE m WHEN 4 THEN 'PARSE_UNSUPPORTED_ELEMENT' WHEN 5 THEN 'VOCAB_MISMATCH' WHEN 6 THEN 'INVALID_REQUEST' END AS code, CASE m WHEN 4 THEN 'reason=symbol/use reference' WHEN 5 THEN 'max_id=5562' END AS detail, (CASE WHEN m > 3 THEN 400 END)::INT AS status, "
    "CASE m WHEN 4 THEN '<symbol/use reference> not tokenizable' WHEN 5 THEN 'token id 9999 out of range [0,5562)' WHEN 6 THEN 'unknown op ''paint''' END AS message FROM q",
)
def v3_mixed(spark, d):
    """Both operations, lean and not, with merges and without, and three kinds of refusal; a batch's defaults yield to an item's own."""
    n = parts(spark, d).select("doc_id", "k")
    rows = documents(spark, d).join(n, "doc_id").select(
        F.col("doc_id").alias("pos"), F.expr("concat('i', doc_id)").alias("id"), F.expr(_KIND).alias("op"),
        F.expr("CASE k % 7 WHEN 3 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN '<svg><use/></svg>' ELSE svg END").alias("svg"),
        F.expr("CASE k % 7 WHEN 3 THEN array(1, 10, 2000, 5561, 2) WHEN 5 THEN array(1, 9999, 2) END").alias("token_ids"), F.expr("IF(k % 7 = 2, 'l2', NULL)").alias("level"), F.expr("IF(k % 7 = 1, false, NULL)").alias("lean"),
    )
    out = service.process(rows, lean=True, merges=[[11, 1465, 5561]])
    detail = F.expr("array_join(transform(map_entries(error.detail), e -> concat(e.key, '=', e.value)), ',')")
    return out.select("pos", "id", "ok", "n_tokens", "level", "lean", "compression_ratio", "error.code", detail.alias("detail"), "error.status", "error.message")


@query("f13_error_policy", f"SELECT p.policy, CASE p.policy WHEN 'skip' THEN count_if(m > 2) END::BIGINT AS n_ok, CASE p.policy WHEN 'skip' THEN count_if(m <= 2) END::BIGINT AS n_failed, p.policy = 'fail_fast' AS raised FROM (SELECT * FROM ({_ITEMS}) ORDER BY id LIMIT 500), (VALUES ('skip'), ('fail_fast')) p(policy) GROUP BY p.policy")
def f13(spark, d):
    """A batch of as many items as there may be, under both policies."""
    rows, out = batch_items(spark, d).orderBy("id").limit(500), []
    for policy in ("skip", "fail_fast"):
        results = service.batch(rows, "tokenize", on_error=policy)
        try:
            out.append((policy, *service.counts(results).first(), False))
        except Exception as e:
            out.append((policy, None, None, any(c in str(e) for c in STATUS)))
    return spark.createDataFrame(out, "policy string, n_ok long, n_failed long, raised boolean")


@query("f12_batch_guard", "SELECT * FROM (VALUES ('unknown op', 'INVALID_REQUEST', 400), ('1000 items', NULL, NULL), ('1001 items', 'PAYLOAD_TOO_LARGE', 413), ('32 MiB', NULL, NULL), ('32 MiB and a token', 'PAYLOAD_TOO_LARGE', 413)) v(batch, code, status)")
def f12(spark, d):
    def rows(n, size=0, tokens=0):
        return spark.range(n).select(F.expr(f"repeat('x', {size})").alias("svg"), F.expr(f"cast(IF({tokens} > 0 AND id = 0, array_repeat(1, {tokens}), NULL) AS ARRAY<INT>)").alias("token_ids"))

    out = []
    for name, df, op in (
        ("unknown op", rows(1), "paint"), ("1000 items", rows(1000), "tokenize"), ("1001 items", rows(1001), "detokenize"), ("32 MiB", rows(32, 1 << 20), "tokenize"), ("32 MiB and a token", rows(32, 1 << 20, 1), "tokenize"),
    ):
        try:
            service.check_batch(df, op)
            out.append((name, None, None))
        except EngineError as e:
            out.append((name, e.code, e.status))
    return spark.createDataFrame(out, "batch string, code string, status int")


@query("f14_errors", "SELECT * FROM (VALUES ('ENGINE_ERROR', 400), ('PARSE_ERROR', 400), ('PARSE_UNSUPPORTED_ELEMENT', 400), ('PAYLOAD_TOO_LARGE', 413), ('VOCAB_MISMATCH', 400), ('VERSION_REQUIRED', 400), ('INVALID_REQUEST', 400), ('JOB_NOT_FOUND', 404)) v(code, status)")
def f14(spark, d):
    return spark.createDataFrame([(e.code, e.status) for e in (EngineError(c, "m") for c in STATUS)], "code string, status int")


@query("v1_health", f"SELECT 'ok' AS status, 'strokeforge-1.0.0' AS tokenizer_version, 'geom-5561-v1' AS vocab_id, false AS has_l2, substr(sha256({_MANIFEST}), 1, 16) AS manifest_hash")
def v1(spark, d):
    return service.health(spark, manifest.content_hash(manifest.build()))


# Jobs.
_COUNTS = f"c AS (SELECT count(*)::BIGINT AS n, count_if(m > 2)::BIGINT AS n_ok, count_if(m <= 2)::BIGINT AS n_failed FROM ({_ITEMS}))"


@query("v7_job", f"WITH {_COUNTS} SELECT 'partial' AS status, n AS total, n AS done, n_ok, n_failed, 1::DOUBLE AS progress, true AS partial, n <= 10000 AS inline, n AS n_results, n_failed AS n_item_errors FROM c")
def v7(spark, d):
    jobs = service.Jobs(spark, shared.scratch(spark, "jobs"))
    job = jobs.submit(batch_items(spark, d), lean=True)
    v = jobs.wait(job)
    results = jobs.results(job)
    row = (*(v[k] for k in ("status", "total", "done", "n_ok", "n_failed", "progress", "partial", "inline")), results.count(), results.filter("error.code = 'ITEM_ERROR'").count())
    return spark.createDataFrame([row], "status string, total long, done long, n_ok long, n_failed long, progress double, partial boolean, inline boolean, n_results long, n_item_errors long")


@query("v5_submit", "SELECT * FROM (VALUES ('items', NULL, 'succeeded'), ('input_uri', NULL, 'succeeded'), ('both', 'INVALID_REQUEST', NULL), ('neither', 'INVALID_REQUEST', NULL), ('unknown op', 'INVALID_REQUEST', NULL), ('fail_fast', NULL, 'failed')) v(given, code, status)")
def v5(spark, d):
    """What a job may be given: items, or lines of a file, not both."""
    folder = shared.scratch(spark, "jobs")
    good = batch_items(spark, d).filter("svg LIKE '%path%'")
    service.write_ndjson(good.select("id", "svg"), f"{folder}/in")
    jobs, out = service.Jobs(spark, folder), []
    for name, how in (
        ("items", {"rows": good}), ("input_uri", {"input_uri": f"{folder}/in", "op": "tokenize"}), ("both", {"rows": good, "input_uri": "x"}), ("neither", {}), ("unknown op", {"rows": good, "op": "paint"}),
        ("fail_fast", {"rows": batch_items(spark, d), "on_error": "fail_fast"}),
    ):
        try:
            out.append((name, None, jobs.wait(jobs.submit(**how))["status"]))
        except EngineError as e:
            out.append((name, e.code, None))
    return spark.createDataFrame(out, "given string, code string, status string")


@query("v8_cancel", "SELECT * FROM (VALUES ('ended', false, 'succeeded', NULL), ('ended, asked by another driver', false, 'succeeded', NULL), ('queued', true, 'cancelled', NULL), ('unknown', NULL, NULL, 'JOB_NOT_FOUND')) v(job, cancelled, status, code)")
def v8(spark, d):
    """Jobs that have ended can't be cancelled; their states are kept in a folder."""
    folder, out = shared.scratch(spark, "jobs"), []
    store = service.FolderStore(spark, folder)
    jobs = service.Jobs(spark, folder, store=store)
    ended = jobs.submit(batch_items(spark, d).filter("svg LIKE '%path%'").limit(20))
    jobs.wait(ended)
    out.append(("ended", jobs.cancel(ended), jobs.get(ended)["status"], None))
    other = service.Jobs(spark, folder, store=service.FolderStore(spark, folder))
    out.append(("ended, asked by another driver", other.cancel(ended), other.get(ended)["status"], None))
    store.put(store.get(ended) | {"job_id": "job_waits", "status": "queued", "finished_at": None})
    out.append(("queued", jobs.cancel("job_waits"), jobs.get("job_waits")["status"], None))
    try:
        jobs.cancel("job_of_nobody")
    except EngineError as e:
        out.append(("unknown", None, None, e.code))
    return spark.createDataFrame(out, "job string, cancelled boolean, status string, code string")


@contextlib.contextmanager
def receiver(spark, status: int):
    """A server of the driver's that answers every post with status: its address, and what it was sent."""
    sent: list[dict] = []

    class Posts(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            sent.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(status)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_):
            pass

    host = spark.conf.get("spark.driver.host")
    server = http.server.ThreadingHTTPServer((host, 0), Posts)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}/done", sent
    finally:
        server.shutdown()
        server.server_close()


@query(
    "s13_webhooks",
    f"WITH {_COUNTS} SELECT r AS receiver, 'partial' AS status, 1 AS n_posts, 'partial' AS posted_status, n AS posted_done, n_ok, n_failed FROM c, (VALUES ('answers'), ('fails')) v(r)",
)
def s13(spark, d):
    """A job over a file named with its scheme tells a receiver how it ended; one that fails changes nothing."""
    folder, out = shared.scratch(spark, "jobs"), []
    service.write_ndjson(batch_items(spark, d), f"{folder}/in")
    uri = f"file://{folder}/in" if folder.startswith("/") else f"{folder}/in"
    for name, answer in (("answers", 200), ("fails", 500)):
        with receiver(spark, answer) as (url, sent):
            jobs = service.Jobs(spark, folder, webhook=service.post_to(url))
            view = jobs.wait(jobs.submit(input_uri=uri, op="tokenize", lean=True))
        out.append((name, view["status"], len(sent), sent[0]["status"], sent[0]["done"], sent[0]["n_ok"], sent[0]["n_failed"]))
    return spark.createDataFrame(out, "receiver string, status string, n_posts int, posted_status string, posted_done long, n_ok long, n_failed long")


class Watched(service.MemoryStore):
    """Keeps how much was done in each state of a running job, and hands a state to a caller."""

    def __init__(self, seen=lambda state: None):
        super().__init__()
        self.done, self.seen = [], seen

    def put(self, state):
        super().put(state)
        if state["status"] == "running" and state["total"]:
            self.done.append(state["done"])
            self.seen(state)


def slow_items(spark, d):
    """Items in four times as many parts as cores, each held up a little, so that a job has a middle."""

    def run(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    rows = batch_items(spark, d)
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "id").mapInArrow(run, rows.schema)


@query("v6_progress", f"WITH {_COUNTS} SELECT 'partial' AS status, n AS total, n AS done, n_ok, n_failed, true AS seen_between, true AS rising FROM c")
def v6(spark, d):
    """A job tells how much is done while it runs."""
    store = Watched()
    jobs = service.Jobs(spark, shared.scratch(spark, "jobs"), store=store, every=1)
    v = jobs.wait(jobs.submit(slow_items(spark, d), lean=True))
    between = any(0 < n < v["total"] for n in store.done)
    row = (*(v[k] for k in ("status", "total", "done", "n_ok", "n_failed")), between, store.done == sorted(store.done))
    return spark.createDataFrame([row], "status string, total long, done long, n_ok long, n_failed long, seen_between boolean, rising boolean")


@query("v8_cancel_running", f"WITH {_COUNTS} SELECT 'cancelled' AS status, n AS total, true AS cancelled, true AS some_done, true AS some_left, false AS has_results FROM c")
def v8_running(spark, d):
    """A job is cancelled in the middle: its Spark jobs stop, and its state stays as it was then."""
    met = threading.Event()
    store = Watched(lambda state: met.set() if state["done"] else None)
    jobs = service.Jobs(spark, shared.scratch(spark, "jobs"), store=store, every=1)
    job = jobs.submit(slow_items(spark, d), lean=True)
    while not met.wait(0.1) and jobs.threads[job].is_alive():
        pass
    cancelled = jobs.cancel(job)
    v = jobs.wait(job)
    row = (v["status"], v["total"], cancelled, v["done"] > 0, v["done"] < v["total"], v["results_url"] is not None)
    return spark.createDataFrame([row], "status string, total long, cancelled boolean, some_done boolean, some_left boolean, has_results boolean")


# Files and streams.
@query("s5_ndjson_file", f"SELECT conv_id || '-' || turn AS id, 'tokenize' AS op, 'L1' AS level, true AS lean, md5(coalesce({_SVG}, 'none')) AS svg, false AS bad FROM conversations")
def s5(spark, d):
    """Items written as lines and read again."""
    path = shared.scratch(spark, "items")
    service.write_ndjson(batch_items(spark, d), path)
    return service.read_ndjson(spark, path).select("id", "op", "level", "lean", F.md5(F.coalesce("svg", F.lit("none"))).alias("svg"), "bad")


@query(
    "s6_stream",
    f"SELECT CASE WHEN m > 2 THEN id END AS id, m > 2 AS ok, CASE m WHEN 0 THEN 'PARSE_ERROR' WHEN 1 THEN 'STREAM_LINE_ERROR' WHEN 2 THEN 'PARSE_UNSUPPORTED_ELEMENT' END AS code, CASE WHEN m > 2 THEN t END AS t FROM ({_ITEMS})",
)
def s6(spark, d):
    """Lines of files as a stream; those without a drawing are broken lines here."""
    folder = shared.scratch(spark, "stream")
    line = "IF(svg IS NULL, '{bad', to_json(named_struct('id', id, 'op', op, 'svg', svg, 'lean', lean)))"
    batch_items(spark, d).select(F.expr(line).alias("value")).repartition(3).write.text(f"{folder}/in")
    ndjson.write_stream(ndjson.results(ndjson.read_stream(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = spark.read.schema("id string, ok boolean, token_ids array<int>, error struct<code:string>").json(f"{folder}/out")
    return rows.select("id", "ok", "error.code", F.expr(TEXT).alias("t"))


@query(
    "s6_exactly_once",
    f"SELECT CASE WHEN m > 2 THEN id END AS id, m > 2 AS ok, CASE m WHEN 0 THEN 'PARSE_ERROR' WHEN 1 THEN 'PARSE_ERROR' WHEN 2 THEN 'PARSE_UNSUPPORTED_ELEMENT' END AS code, CASE WHEN m > 2 THEN t END AS t, true AS placed FROM ({_ITEMS})",
)
def s6_once(spark, d):
    """Every item is in two files and the stream is stopped in between, once in mid-run: each gives one result."""
    src, out, state = (shared.scratch(spark, label) for label in ("stream-in", "stream-out", "stream-state"))
    line = F.to_json(F.struct("id", "op", "svg", "lean")).alias("value")
    rows = batch_items(spark, d).withColumn("h", F.expr("pmod(xxhash64(id), 3)"))
    # A file is one task's, so files are bounded.
    put = lambda which: rows.filter(which).select(line).repartition(2).write.mode("append").option("maxRecordsPerFile", files.FILES).text(src)
    run = lambda files, **how: ndjson.write_once(ndjson.read_numbered(spark, src, files), out, state, **how)
    put("h < 2")
    first = run(1, processingTime="0 seconds")
    while first.isActive and not first.recentProgress:
        time.sleep(0.1)
    first.stop()
    for again in ("h > 0", "h <> 1"):
        put(again)
        run(100).awaitTermination()
    kind = "id string, ok boolean, token_ids array<int>, error struct<code:string>, pos struct<file:string,line:int>"
    rows = spark.read.schema(kind).json(out)
    return rows.select("id", "ok", "error.code", F.expr(TEXT).alias("t"), (F.col("pos.file").isNotNull() & (F.col("pos.line") >= 0)).alias("placed"))


_FILES = f"WITH {PART}, f AS (SELECT k::BIGINT AS doc_id, CASE WHEN k % 5 = 0 THEN '<svg><rect' ELSE '<svg><path d=\"M' || x || ' ' || y || 'L' || cx || ' ' || cy || '\"/>' || chr(10) || '</svg>' END AS svg, '1,10,' || {d_id('x', 'y')} || ',11,' || {d_id('cx', 'cy')} || ',2' AS t FROM p)"


def small_drawings(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and svg of each part, every fifth broken."""
    svg = "IF(k % 5 = 0, '<svg><rect', concat('<svg><path d=\"M', x, ' ', y, 'L', cx, ' ', cy, '\"/>\n</svg>'))"
    return parts(spark, d, svg=svg).select("doc_id", "svg")


def folder_of(spark: SparkSession, d: str) -> str:
    """A folder with a file for each part's drawing, named by the part."""
    path = shared.scratch(spark, "files")
    files.write_files(small_drawings(spark, d), path, "doc_id")
    return path


@query("s2_svg_files", f"{_FILES} SELECT doc_id, md5(svg) AS svg FROM f")
def s2(spark, d):
    """Every part's drawing written to a file of its own and read whole."""
    return files.read_files(spark, folder_of(spark, d)).select(F.col("name").cast("long").alias("doc_id"), F.md5("svg").alias("svg"))


@query("s12_named_files", f"{_FILES} SELECT doc_id || '.svg' AS file, octet_length(encode(svg)) AS size FROM f")
def s12(spark, d):
    """What is in the folder after a stream of documents was written, stopped and written on."""
    path, state, src = (shared.scratch(spark, label) for label in ("files", "files-state", "files-in"))
    rows = small_drawings(spark, d)
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        # Files and batches that do not grow with the table, so tasks do not either.
        rows.filter(part).write.mode("append").option("maxRecordsPerFile", files.FILES).parquet(src)
        stream = spark.readStream.schema("doc_id long, svg string").option("maxFilesPerTrigger", 4 * spark.sparkContext.defaultParallelism).parquet(src)
        files.stream_files(stream, path, "doc_id", state).awaitTermination()
    return files.list_files(spark, path).select(F.col("name").alias("file"), "size")


@query("s15_corpus_scan", f"{_FILES} SELECT doc_id, t FROM f WHERE doc_id % 5 <> 0")
def s15(spark, d):
    """Every file of a folder, less those that fail."""
    rows = bpe.corpus_streams(spark, folder_of(spark, d))
    return rows.select(F.expr("cast(regexp_extract(path, '([0-9]+)[.]svg$', 1) AS BIGINT)").alias("doc_id"), F.expr(TEXT).alias("t"))


@query("s15_corpus_limit", f"{_FILES} SELECT doc_id, t FROM (SELECT * FROM f ORDER BY doc_id || '.svg' LIMIT 12) WHERE doc_id % 5 <> 0")
def s15_limit(spark, d):
    """The first twelve files by path, less those that fail: a limit is taken before files are read."""
    rows = bpe.corpus_streams(spark, folder_of(spark, d), 12)
    return rows.select(F.expr("cast(regexp_extract(path, '([0-9]+)[.]svg$', 1) AS BIGINT)").alias("doc_id"), F.expr(TEXT).alias("t"))


@query("s9_manifest_file", "SELECT l::INT AS level, (100 + (pow(4, l)::INT - 1) // 3)::INT AS start_id, 'geom-5561-v1' AS vocab_id, 5561 AS merge_base_id, 3 AS n_merges, 'CLOSE' AS command_17 FROM range(7) r(l)")
def s9(spark, d):
    """A manifest with merges, stored as a file and read as a table."""
    path = shared.scratch(spark, "manifest")
    shared.write_text(spark, path, manifest.to_json(manifest.build(MERGES)))
    kind = "vocab_id string, merge_base_id int, merges array<array<int>>, command map<string,string>, level_layout array<struct<level:int,start_id:int>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return rows.select(F.explode("m.level_layout").alias("x"), "m").select("x.level", "x.start_id", "m.vocab_id", "m.merge_base_id", F.size("m.merges").alias("n_merges"), F.col("m.command")["17"].alias("command_17"))


# Merge tables.
@query("b10_learn_first", f"WITH {_PAIRS} SELECT min_freq, a, b, new_id FROM (SELECT a, b, 5561 AS new_id, n FROM c ORDER BY n DESC, a, b LIMIT 1), (VALUES (2), (1000000000)) f(min_freq) WHERE n >= min_freq")
def b10(spark, d):
    """The first merge that is learned, and none where no pair is frequent enough."""
    rows = fx.streams(spark, d)
    found = [(f, *m) for f in (2, 1_000_000_000) for m in bpe.learn(rows, 1, min_freq=f)]
    return spark.createDataFrame(found, "min_freq int, a int, b int, new_id int")


def _steps(n: int) -> str:
    """SQL of DuckDB: s0 (id, t) and m1 to mn, the merges one by one, each after a recount."""
    out = []
    for k in range(1, n + 1):
        pairs = f"SELECT t[i] AS a, t[i + 1] AS b, count(*) AS n FROM s{k - 1}, unnest(range(1, len(t))) AS r(i) WHERE t[i] NOT IN (1, 2, 3) AND t[i + 1] NOT IN (1, 2, 3) GROUP BY ALL"
        out.append(f"m{k} AS MATERIALIZED (SELECT {k - 1} AS rank, a, b, {ids.VOCAB + k - 1} AS new_id FROM ({pairs}) WHERE n >= 2 ORDER BY n DESC, a, b LIMIT 1)")
        fold = "list_reduce(list_transform(t, lambda x: [x]), lambda p, x: CASE WHEN p[-1] = m.a AND x[1] = m.b THEN list_append(p[:-2], m.new_id) ELSE list_concat(p, x) END)"
        out.append(f"s{k} AS MATERIALIZED (SELECT {fold} AS t FROM s{k - 1}, m{k} m)")
    return ", ".join(out)


@query("b4_learn_merges", f"WITH {LINES}, {TOKENS}, s0 AS (SELECT list_transform(string_split(t, ','), lambda x: x::INT) AS t FROM lean), {_steps(8)} " + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, 9)))
def b4(spark, d):
    table = bpe.learn(fx.streams(spark, d), 8)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(table)], "rank int, a int, b int, new_id int")


@query("b7_decode_merged", f"WITH {LINES}, {TOKENS}, b AS (SELECT doc_id, t FROM lean) SELECT doc_id, true AS valid, true AS same FROM b")
def b7(spark, d):
    """Streams with merged ids decode to what they stand for, whatever level is asked for."""
    plain = fx.streams(spark, d).withColumn("tokenizer_version", F.lit(ids.TOKENIZER_VERSION))
    both = bpe.encode(plain.withColumn("plain", F.col("token_ids")), MERGES)
    out = codec.detokenize(both, MERGES).select("doc_id", "valid", "svg", "plain", "tokenizer_version")
    again = codec.detokenize(out.select("doc_id", "valid", F.col("svg").alias("first"), F.col("plain").alias("token_ids"), "tokenizer_version").withColumnRenamed("valid", "was_valid"))
    return again.select("doc_id", F.col("was_valid").alias("valid"), (F.col("svg") == F.col("first")).alias("same"))


@query("b9_manifest_merges", f"WITH {LINES}, {TOKENS} SELECT doc_id, replace(t || ',', '11,5497,', '5561,') AS t, 'INVALID_REQUEST' AS code_without FROM lean")
def b9(spark, d):
    """The codec of a manifest's merges, and the error of one that has none."""
    try:
        code = str(bpe.from_manifest(manifest.build()))
    except EngineError as e:
        code = e.code
    merges = bpe.from_manifest(manifest.from_json(manifest.to_json(manifest.build([[11, 5497, 5561]]))))
    return bpe.encode(fx.streams(spark, d), merges).select("doc_id", F.expr(f"concat({TEXT}, ',')").alias("t"), F.lit(code).alias("code_without"))


# Gates of a corpus beside those of e13_corpus_gates.
@query(
    "e13_merge_gates",
    f"WITH {LINES}, {TOKENS}, a AS (SELECT t, replace(replace(t || ',', '11,5497,', '5561,'), '5561,5561,', '5562,') AS m FROM lean), b AS (SELECT t, replace(m, ',10,5497,', ',5563,') AS m FROM a) "
    "SELECT count(*) AS icons, round(avg(len(string_split(t, ','))), 4) AS l1_tokens, round(avg(len(string_split(m, ',')) - 1), 4) AS l2_tokens, 1::DOUBLE AS lossless_rate FROM b",
)
def e13_merges(spark, d):
    return evaluation.merge_gates(fx.streams(spark, d), MERGES)


@query("e13_refusals", f"SELECT CASE m WHEN 2 THEN 'PARSE_UNSUPPORTED_ELEMENT' ELSE 'PARSE_ERROR' END AS code, count(*) AS n FROM ({_ITEMS}) WHERE m IN (0, 2) GROUP BY 1")
def e13_refusals(spark, d):
    return evaluation.refusals(batch_items(spark, d).filter("svg IS NOT NULL"))


@query("e13_determinism", f"WITH {_DRAWN} SELECT count(DISTINCT doc_id) AS icons, 1::DOUBLE AS same_rate FROM c")
def e13_same(spark, d):
    return evaluation.determinism(fx.drawings(spark, d))


# Another tokenizer.
@query(
    "e11_external_tokenizer",
    f"WITH {_DRAWN}, f AS (SELECT doc_id, count(*) AS n, max(sqrt(pow(printf('%.3f', x)::DOUBLE - 1, 2) + pow(printf('%.3f', y)::DOUBLE - 1, 2))) FILTER (WHERE i = 1) AS e FROM c GROUP BY doc_id) "
    "SELECT doc_id, round((e + (n - 1) * 300 * sqrt(2)) / n, 6) AS attr_mean_err, round(300 * sqrt(2), 6) AS attr_max_err, 1 AS n_tokens FROM f WHERE doc_id % 3 <> 0",
)
def e11(spark, d):
    """One that makes every drawing a point, and fails on every third."""

    def encode(svg: str) -> list[int]:
        number = int(svg.partition('id="g')[2].partition('"')[0])
        if number % 3 == 0:
            raise ValueError("not this one")
        return [number]

    scores = evaluation.external_eval(fx.drawings(spark, d), encode, lambda t: '<svg><path d="M1 1"/></svg>')
    return scores.select("doc_id", F.round("attr_mean_err", 6).alias("attr_mean_err"), F.round("attr_max_err", 6).alias("attr_max_err"), "n_tokens")


@contextlib.contextmanager
def unsteady_server(spark):
    """A tokenizer on the driver's host that makes every drawing a point, puts every third off at first, and refuses every fifth."""
    asked, lock = set(), threading.Lock()

    def answered(given: dict) -> tuple[int, dict]:
        if "token_ids" in given:
            return 200, {"svg": '<svg><path d="M1 1"/></svg>'}
        number = int(given["svg"].partition('id="g')[2].partition('"')[0])
        if number % 5 == 0:
            return 400, {}
        if number % 3 == 0:
            with lock:
                first = number not in asked
                # Those that came again need not be known any longer.
                (asked.add if first else asked.discard)(number)
            if first:
                return 503, {}
        return 200, {"token_ids": [number]}

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            each = [answered(g) for g in given["items"]]
            self.answer(200, {"items": [what if status == 200 else {"status": status} for status, what in each]})

        def answer(self, status, what):
            body = json.dumps(what).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    host = spark.conf.get("spark.driver.host")
    server = http.server.ThreadingHTTPServer((host, 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://{host}:{server.server_port}"
        yield remote.Remote(f"{at}/tokenize", f"{at}/detokenize", pause=0.01, batch=256)
    finally:
        server.shutdown()
        server.server_close()


@query("s14_remote", f"WITH {PART} SELECT k::BIGINT AS doc_id, CASE WHEN k % 5 <> 0 THEN 1 END::INT AS n_tokens, k % 5 <> 0 AS decoded, CASE WHEN k % 5 = 0 THEN 'HTTP 400' END AS error FROM p")
def s14(spark, d):
    """Every drawing by way of a server that fails at times."""
    with unsteady_server(spark) as tokenizer:
        rows = shared.materialize(remote.round_trip(fx.drawings(spark, d), tokenizer), "remote")
    return rows.select("doc_id", F.expr("IF(token_ids IS NULL, NULL, size(token_ids))").alias("n_tokens"), F.col("decoded").isNotNull().alias("decoded"), "error")


@query(
    "e11_remote",
    f"WITH {_DRAWN}, f AS (SELECT doc_id, count(*) AS n, max(sqrt(pow(printf('%.3f', x)::DOUBLE - 1, 2) + pow(printf('%.3f', y)::DOUBLE - 1, 2))) FILTER (WHERE i = 1) AS e FROM c GROUP BY doc_id) "
    "SELECT doc_id, round((e + (n - 1) * 300 * sqrt(2)) / n, 6) AS attr_mean_err, round(300 * sqrt(2), 6) AS attr_max_err, 1 AS n_tokens FROM f WHERE doc_id % 5 <> 0",
)
def e11_remote(spark, d):
    """Scores of such a tokenizer."""
    with unsteady_server(spark) as tokenizer:
        scores = evaluation.remote_eval(fx.drawings(spark, d), tokenizer)
    return scores.select("doc_id", F.round("attr_mean_err", 6).alias("attr_mean_err"), F.round("attr_max_err", 6).alias("attr_max_err"), "n_tokens")
