"""Row pattern matching: A (D|U)* P D* over each client's clicks in order of time.

A matches any row with a value. D and U need cents below and above the previous row's and a kind
that is neither null nor error; P needs kind view and cents at least A's; all three need a time
at most GAP after the previous row's. Rows that can only be A part the rest into segments that
no match crosses. In a segment transform() writes, for each start, the rows after it as letters:
d and u for what D and U admit, e for neither, in upper case where P's threshold holds; then
regexp_extract with classes of letters gives the three parts, with a regular expression's own
backtracking. A fold over a segment's matches keeps those that the search meets.

No client and no segment is held by one task. Rows are dealt into ranges of (client, time, id);
a segment of fewer than LIMIT rows is one array. Segments across ranges are put together again
from their parts, which are few. A segment of LIMIT rows or more, whose suffixes would be too
long to write out, is matched by running maxima (see _long): the last view that reaches a
start's cents is the maximum of places over views in falling order of cents.

Defined results: rows with a null client_id or ts are dropped; rows equal in all columns count
once; rows of equal client_id, ts and click_id are in order of kind (null and error, others,
view) and cents, null first; a value that is null, not a number or infinite fits no letter;
cents beyond 64 bits are the nearest number of 64 bits; an empty table gives an empty result;
other columns only tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard_table, hot_join, materialize
from .scans import carried, ranged, running

GAP = "INTERVAL 15 MINUTES"
#: Rows of a segment that are held and written out together.
LIMIT = 512
PARTS = "^([duDU]*)([DUE])([dD]*)"
ORDER = ["client", "ts", "id", "k", "cents"]
#: What a row of a segment carries; part and no, its range and its place there, tell it and its order.
ROW = ["part", "no", "id", "cents", "view", "letter"]


def distinct_rows(clicks: DataFrame) -> DataFrame:
    """client, ts, id, k (0: null or error, 1, 2: view) and cents (null: fits no letter) of every distinct row."""
    value = F.col("value").cast("double")
    fits = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    rest = [c for c in clicks.columns if c not in ("client_id", "ts", "click_id")]
    print_ = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in rest]) if rest else F.lit(0)
    rows = clicks.filter("client_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("client_id").alias("client"), "ts", F.col("click_id").alias("id"), F.when(F.col("kind") == "view", 2).when(F.coalesce("kind", F.lit("error")) == "error", 0).otherwise(1).alias("k"),
        F.when(fits, F.floor(value * 100 + 0.5)).cast("long").alias("cents"), print_.alias("print"),
    )
    return rows.distinct().drop("print")


def lettered(clicks: DataFrame) -> DataFrame:
    """_part, no (place in the range), client, id, cents, view and letter: d, u, e (equal, a view) or s, which starts a segment."""
    parts = ranged(distinct_rows(clicks), ORDER)
    here = F.struct("ts", "id", "k", "cents")
    by = Window.partitionBy("_part").orderBy(*ORDER)
    before = carried(parts, ["client"], {"prev": ("max", here)}).select("_part", F.col("_group.client").alias("c0"), F.col("_prev").alias("p0"))
    rows = parts.withColumns({"no": F.row_number().over(by), "pc": F.lag("client").over(by), "prev": F.lag(here).over(by)}).join(F.broadcast(before), "_part", "left")
    rows = rows.withColumns({"pc": F.when(F.col("no") == 1, F.col("c0")).otherwise(F.col("pc")), "prev": F.when(F.col("no") == 1, F.col("p0")).otherwise(F.col("prev"))})
    was = F.col("prev.cents")
    linked = (F.col("pc") == F.col("client")) & F.col("cents").isNotNull() & was.isNotNull() & (F.col("ts") <= F.col("prev.ts") + F.expr(GAP)) & (F.col("k") > 0)
    letter = F.when(~F.coalesce(linked, F.lit(False)), "s").when(F.col("cents") < was, "d").when(F.col("cents") > was, "u").when(F.col("k") == 2, "e").otherwise("s")
    return rows.select("_part", "no", "client", "id", "cents", (F.col("k") == 2).alias("view"), letter.alias("letter"))


def _found(segments: DataFrame) -> DataFrame:
    """The matches of segments (client, seg: its rows in order), each with its labels and the part and no of its first row."""
    suffix = "array_join(transform(slice(seg, i + 2, size(seg)), x -> if(x.view AND x.cents >= a.cents, upper(x.letter), x.letter)), '')"
    starts = segments.filter("size(seg) > 1").withColumn("starts", F.expr(f"transform(slice(seg, 1, size(seg) - 1), (a, i) -> struct(i AS i, {suffix} AS w))"))
    groups = ", ".join(f"regexp_extract(t.w, '{PARTS}', {g}) AS g{g}" for g in (1, 2, 3))
    starts = starts.withColumn("starts", F.expr(f"filter(transform(starts, t -> struct(t.i, {groups})), t -> t.g2 <> '')"))
    met = F.expr("""aggregate(starts, struct(0 AS at, filter(starts, t -> false) AS got), (s, t) -> if(t.i >= s.at,
        struct(t.i + 1 + length(t.g1) + length(t.g3) AS at, concat(s.got, array(t)) AS got), s)).got""")
    each = starts.select("client", "seg", F.explode(met).alias("m")).withColumn("rows", F.expr("slice(seg, m.i + 1, 2 + length(m.g1) + length(m.g3))"))
    return each.select(
        "client", F.expr("rows[0].part").alias("part"), F.expr("rows[0].no").alias("no"), F.expr("rows[0].id").alias("first_id"), F.expr("element_at(rows, -1).id").alias("last_id"),
        F.size("rows").cast("long").alias("n_rows"), F.expr("aggregate(rows, 0L, (s, x) -> s + x.cents)").alias("sum_cents"),
        F.concat(F.lit("A"), F.upper("m.g1"), F.lit("P"), F.upper("m.g3")).alias("labels"),
    )


def _reached(hops: DataFrame, firsts: DataFrame) -> DataFrame:
    """seg, x of the places that hops (seg, x, y: the next place or null) leads to from firsts (seg, x), by doubling."""
    seen, jump = materialize(firsts.select("seg", "x"), "pattern-seen"), materialize(hops.filter("y IS NOT NULL"), "pattern-jump")
    while not jump.isEmpty():
        ahead = seen.join(jump, ["seg", "x"]).select("seg", F.col("y").alias("x"))
        more = materialize(seen.unionByName(ahead).distinct(), "pattern-seen")
        far = jump.join(jump.select("seg", F.col("x").alias("y"), F.col("y").alias("z")), ["seg", "y"]).select("seg", "x", F.col("z").alias("y"))
        further = materialize(far, "pattern-jump")
        for old in (seen, jump):
            discard_table(old)
        seen, jump = more, further
    return seen


def _long(rows: DataFrame) -> DataFrame:
    """The matches of long segments. rows: client, seg (struct of part and no), at (1, 2 and so on in the segment), n (its rows) and ROW."""
    at = F.col("at")
    sides = ranged(rows, ["seg", "at"])
    edge = F.when(F.col("letter").isin("s", "e"), at)
    # A start's run of D and U is told by the s or e before it; the e that ends a run is one of its candidates for P.
    placed = running(sides, ["seg"], ["seg", "at"], {"run": ("max", edge), "run_of_p": ("max", edge)}, strict=("run_of_p",)).drop("_part").withColumn("back", -at)
    placed = ranged(placed, ["seg", "back"])
    placed = materialize(running(placed, ["seg"], ["seg", "back"], {"stop": ("max", F.when(F.col("letter") != "d", F.col("back")))}, strict=("stop",)).drop("_part"), "pattern-placed")
    firsts = placed.filter("at = 1").select("seg", F.col("at").alias("x"))
    falling = (-F.col("cents").cast("decimal(38,0)")).alias("fall")
    views = placed.filter("view AND letter <> 's'").select("seg", F.col("run_of_p").alias("run"), falling, F.lit(0).alias("role"), "at", "n", F.struct("at", "stop").alias("p"))
    starts = placed.select("seg", "run", falling, F.lit(1).alias("role"), "at", "n", F.lit(None).cast(views.schema["p"].dataType).alias("p"))
    order = ["seg", "run", "fall", "role", "at"]
    last = running(ranged(views.unionByName(starts), order), ["seg", "run"], order, {"best": ("max", F.col("p"))}).filter("role = 1 AND best.at > at")
    # stop is the negated place of the next row that is no D; without one the D's go on to the segment's end.
    ends = materialize(last.select("seg", "at", F.col("best.at").alias("p"), F.coalesce(-F.col("best.stop") - 1, F.col("n")).alias("end")), "pattern-ends")
    places = ends.select("seg", F.col("end").alias("x")).unionByName(firsts).distinct()
    ask = ends.select("seg", (-F.col("at")).alias("back"), F.lit(0).alias("role"), F.struct((-F.col("at")).alias("back"), "p", "end").alias("m"))
    ask = ask.unionByName(places.select("seg", (-F.col("x")).alias("back"), F.lit(1).alias("role"), F.lit(None).cast(ask.schema["m"].dataType).alias("m")))
    order = ["seg", "back", "role"]
    nxt = running(ranged(ask, order), ["seg"], order, {"next": ("max", F.col("m"))}).filter("role = 1")
    nxt = materialize(nxt.select("seg", (-F.col("back")).alias("x"), (-F.col("next.back")).alias("s"), F.col("next.p").alias("p"), F.col("next.end").alias("end")), "pattern-next")
    seen = _reached(nxt.select("seg", "x", F.col("end").alias("y")), firsts)
    met = materialize(seen.join(nxt, ["seg", "x"]).filter("s IS NOT NULL").select("seg", "s", "p", "end"), "pattern-met")
    # Every row from a match's start on is told its match; the last row may be the next one's start, so it is fetched by itself.
    events = met.select("seg", F.col("s").alias("at"), F.lit(0).alias("role"), F.struct("s", "p", "end").alias("m"), F.lit(None).cast("long").alias("cents"), F.lit(None).cast("string").alias("letter"))
    marks = placed.select("seg", "at", F.lit(1).alias("role"), F.lit(None).cast(events.schema["m"].dataType).alias("m"), "cents", "letter")
    order = ["seg", "at", "role"]
    inside = running(ranged(events.unionByName(marks), order), ["seg"], order, {"match": ("max", F.col("m"))}).filter("role = 1 AND at < match.end")
    inside = inside.select("seg", F.col("match.s").alias("s"), F.col("match.p").alias("p"), "at", "cents", F.upper("letter").alias("letter"))
    chunks = inside.groupBy("seg", "s", F.floor(at / 4096).alias("chunk")).agg(
        F.sum("cents").alias("cents"), F.expr("array_join(transform(sort_array(collect_list(struct(at, letter)) FILTER (WHERE at > s AND at < p)), x -> x.letter), '')").alias("text")
    )
    whole = chunks.groupBy("seg", "s").agg(F.sum("cents").alias("cents"), F.expr("array_join(transform(sort_array(collect_list(struct(chunk, text))), x -> x.text), '')").alias("text"))
    begins = placed.select("seg", F.col("at").alias("s"), "client", "part", "no", F.col("id").alias("first_id"))
    lasts = placed.select("seg", F.col("at").alias("end"), F.col("id").alias("last_id"), F.col("cents").alias("last_cents"))
    out = met.join(whole, ["seg", "s"]).join(begins, ["seg", "s"]).join(lasts, ["seg", "end"])
    labels = F.concat(F.lit("A"), F.col("text"), F.lit("P"), F.expr("repeat('D', int(end - p))"))
    return out.select("client", "part", "no", "first_id", "last_id", (F.col("end") - F.col("s") + 1).cast("long").alias("n_rows"), (F.col("cents") + F.col("last_cents")).alias("sum_cents"), labels.alias("labels"))


def match_rows(clicks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """client_id, match_no (from 1 in a client's order), first_id, last_id, n_rows, sum_cents and labels of every match."""
    rows = lettered(clicks)
    by = Window.partitionBy("_part").orderBy("no")
    first = F.max(F.when(F.col("letter") == "s", F.col("no"))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"first": first, "end": F.lead("no").over(by).isNull()}).withColumnRenamed("_part", "part")
    held = rows.groupBy("part", "client", "first", F.floor((F.col("no") - F.coalesce("first", F.lit(1))) / limit).alias("chunk"))
    held = held.agg(F.sort_array(F.collect_list(F.struct(*ROW))).alias("seg"), F.max("end").alias("end"))
    # A segment may go on beyond a range or a chunk. What can't and holds no view after its first row matches nothing.
    held = held.withColumn("odd", F.expr(f"first IS NULL OR end OR chunk > 0 OR size(seg) >= {limit}"))
    held = materialize(held.filter("odd OR exists(seg, x -> x.view AND x.letter <> 's')"), "pattern-segments")
    odd = ranged(held.filter("odd").select("client", "first", F.explode("seg").alias("x")).select("client", "first", "x.*"), ["client", "part", "no"])
    own = F.when(F.col("first").isNotNull(), F.struct("part", F.col("first").alias("no")))
    odd = materialize(running(odd, ["client"], ["client", "part", "no"], {"own": ("max", own), "place": ("sum", F.lit(1))}).drop("_part", "first"), "pattern-odd")
    sizes = odd.groupBy("client", "own").agg(F.count("*").alias("n"), F.min("place").alias("least"), F.max(F.expr("view AND letter <> 's'")).alias("some")).filter("some")
    odd = materialize(hot_join(odd, materialize(sizes.drop("some"), "pattern-sizes"), ["client", "own"], "n", odd.count()), "pattern-sized")
    whole = odd.filter(f"n < {limit}").groupBy("client", "own").agg(F.sort_array(F.collect_list(F.struct(*ROW))).alias("seg"))
    found = _found(held.filter("NOT odd").select("client", "seg")).unionByName(_found(whole.select("client", "seg")))
    if not (large := odd.filter(f"n >= {limit}")).isEmpty():
        found = found.unionByName(_long(large.select("client", F.col("own").alias("seg"), (F.col("place") - F.col("least") + 1).alias("at"), "n", *ROW)))
    # Ranges are chosen from a sample, for which the matches would be found once more.
    found = materialize(found, "pattern-found")
    found = running(ranged(found, ["client", "part", "no"]), ["client"], ["client", "part", "no"], {"match_no": ("sum", F.lit(1).cast("long"))})
    return found.select(F.col("client").alias("client_id"), "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels")


def op11_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_id, match_no, first_id, last_id, n_rows, sum_cents and labels_sha256 of every match in clicks."""
    out = match_rows(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    return out.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


SQL = """
WITH RECURSIVE r AS (
  SELECT client_id, ts, click_id, kind, cents, coalesce(kind, 'error') <> 'error' AS ok, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id, k, cents NULLS FIRST) AS i
  FROM (SELECT *, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) THEN floor(100 * value + 0.5)::BIGINT END AS cents,
               CASE WHEN coalesce(kind, 'error') = 'error' THEN 0 WHEN kind = 'view' THEN 2 ELSE 1 END AS k
        FROM (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL))),
l AS (SELECT *, lag(cents) OVER w AS was, coalesce(ts <= lag(ts) OVER w + INTERVAL 15 MINUTE, false) AS near FROM r WINDOW w AS (PARTITION BY client_id ORDER BY i)),
f AS (SELECT *, coalesce(near AND ok AND cents < was, false) AS d, coalesce(near AND ok AND cents > was, false) AS u, coalesce(near AND kind = 'view' AND cents IS NOT NULL, false) AS v FROM l),
g AS (
  SELECT *, min(CASE WHEN NOT (d OR u) THEN i END) OVER later AS stop, min(CASE WHEN NOT d THEN i END) OVER later AS fall, max(i) OVER (PARTITION BY client_id) AS n
  FROM f WINDOW later AS (PARTITION BY client_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p AS (
  SELECT a.client_id, a.i AS s, max(b.i) AS p FROM g a JOIN g b
  ON a.client_id = b.client_id AND b.i > a.i AND b.i <= coalesce(a.stop, a.n) AND b.v AND b.cents >= a.cents WHERE a.cents IS NOT NULL GROUP BY ALL),
m AS (SELECT p.client_id, s, p, coalesce(fall - 1, n) AS e FROM p JOIN g ON p.client_id = g.client_id AND p.p = g.i),
x AS (SELECT g.client_id, g.i, min(s) OVER (PARTITION BY g.client_id ORDER BY g.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM g LEFT JOIN m ON g.client_id = m.client_id AND g.i = m.s),
hop AS (SELECT x.client_id, x.i, m.s, m.p, m.e FROM x JOIN m ON x.client_id = m.client_id AND x.s = m.s),
met AS (
  SELECT client_id, 1::BIGINT AS match_no, s, p, e FROM hop WHERE i = 1
  UNION ALL SELECT hop.client_id, met.match_no + 1, hop.s, hop.p, hop.e FROM met JOIN hop ON met.client_id = hop.client_id AND met.e = hop.i)
SELECT met.client_id, match_no, arg_min(click_id, g.i) AS first_id, arg_max(click_id, g.i) AS last_id, count(*)::BIGINT AS n_rows, sum(cents)::BIGINT AS sum_cents,
       sha256(string_agg(CASE WHEN g.i = s THEN 'A' WHEN g.i = p THEN 'P' WHEN d THEN 'D' ELSE 'U' END, '' ORDER BY g.i)) AS labels_sha256
FROM met JOIN g ON met.client_id = g.client_id AND g.i BETWEEN s AND e GROUP BY met.client_id, match_no
"""
