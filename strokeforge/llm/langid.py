"""Language ID by prediction by partial matching.

For each language a variable-order byte context tree (orders 0 to ORDER, escape method C) is
counted on a bounded sample of labelled documents and then frozen. A symbol that a context
has not seen escapes, with the context's escape probability, to the context one byte shorter,
where the symbols that the longer one has seen are excluded and the rest shares the whole
mass; below order 0 all 256 bytes are alike. The probabilities of a context sum to one, so a
text's code length under each language is exact, and the shortest names the language.

Frozen statistics allow tables. Where they are small, every context that any language has seen
is a state with a row of code lengths for each symbol and language, and the state before each
byte follows from the three bytes before it: a few numpy gathers per byte. Where languages are
many, each keeps sorted tables of the symbols that its contexts have seen and of its contexts'
escapes; a byte's code length is then the sum of the escapes down to the context that has seen
it. Both give the same code lengths. Scoring works over Arrow's buffer in pieces of bounded
size; a long text is never cut.

The sample is bounded: texts are cut into pieces of CHUNK characters, and of each language
those with the least hashes of text and place are learned, TRAIN_BYTES a language and
TOTAL_BYTES of all languages at most, but one piece of each language at least. So every label
with text is learned, long texts give part of their pieces and texts that repeat count once.

Defined results: `und` with score 0 for a text that is null or has no letters; equal code
lengths go to the language that sorts first; score is the posterior probability of the
prediction under equal priors; rows that repeat are each returned; without any labelled
document every prediction is `und`; an empty table gives an empty result; other columns are
ignored, and doc_id, source and lang are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, give_back, slices

ORDER = 3
#: The bounds of the training sample in bytes, for a language and in all, and its pieces in characters.
TRAIN_BYTES, TOTAL_BYTES, CHUNK = 1_000_000, 16_000_000, 2048
#: Larger tables by state and symbol are not built; sorted ones take their place.
DENSE_BYTES = 64 << 20
PIECE = 1 << 18


def training_sample(labelled: DataFrame, train_bytes: int = TRAIN_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, list[bytes]]:
    """lang -> pieces of texts from labelled (text, lang)."""
    spark = labelled.sparkSession
    rows = labelled.filter("lang IS NOT NULL AND length(text) > 0").select("lang", F.col("text").cast("string").alias("text"))
    distinct = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.max(F.octet_length("text")).alias("n"))
    sizes = distinct.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # a row a language, as the model has
    if not sizes:
        return {}
    each = min(train_bytes, max(total_bytes // len(sizes), 1))
    # A little more than wanted is drawn, and what is beyond the bound goes after it is put in order.
    share = spark.createDataFrame([(r["lang"], float(min(1.0, 1.5 * each / r["n"] + 8.0 * CHUNK / r["n"]))) for r in sizes], "lang string, share double")
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int"))
    # The digest is bound to a name, else each place would hash the whole text.
    places = F.element_at(F.transform(F.array(F.xxhash64("text")), lambda d: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.xxhash64(d, i).alias("h")))), 1)
    drawn = lambda c: F.shiftrightunsigned(c["h"], 11) < F.col("share") * float(1 << 53)
    chosen = rows.join(F.broadcast(share), "lang").withColumn("c", F.explode(F.filter(places, drawn)))  # a row a language
    part = F.substring("text", F.col("c.i") * CHUNK + 1, F.lit(CHUNK)).cast("binary")
    chosen = chosen.select("lang", F.shiftrightunsigned("c.h", 11).alias("h"), part.alias("part")).groupBy("lang", "h").agg(F.first("part").alias("part"))
    upto = F.sum(F.length("part")).over(Window.partitionBy("lang").orderBy("h")) - F.length("part")
    out: dict[str, list[bytes]] = {}
    for r in chosen.withColumn("upto", upto).filter(F.col("upto") < each).select("lang", "part").collect():
        out.setdefault(r["lang"], []).append(bytes(r["part"]))
    missing = [r["lang"] for r in sizes if r["lang"] not in out]
    if missing:  # a language none of whose pieces was drawn
        least = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in missing], "lang string")), "lang")
        least = least.groupBy("lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.substring("text", 1, CHUNK).alias("part"))).alias("x"))
        for r in least.select("lang", F.col("x.part").cast("binary").alias("part")).collect():
            out[r["lang"]] = [bytes(r["part"])]
    return {k: sorted(v) for k, v in out.items()}


class Model:
    """Frozen context trees of some languages, as tables.

    symbol: byte -> symbol; bytes that no language has seen share the last symbol but one, the
    last stands for what is before a text. If dense, state: code of the three symbols before a
    byte -> state; cost[state * symbols + symbol, language]: bits. Else for each language and
    order: the codes of (context, symbol) seen, their bits, the contexts, their escapes' bits.
    """

    def __init__(self, sample: dict[str, list[bytes]], order: int = ORDER, dense_bytes: int = DENSE_BYTES):
        if not 1 <= order <= 3:
            raise ValueError("orders 1 to 3")
        self.languages, self.order = sorted(sample), order
        if not sample:
            return
        seen = np.zeros(256, bool)
        for texts in sample.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        known = np.flatnonzero(seen)
        self.novel, self.pad, self.n = len(known), len(known) + 1, len(known) + 2
        self.symbol = np.full(256, self.novel, np.uint16)
        self.symbol[known] = np.arange(len(known))
        n, weight = self.n, np.ones(self.n)
        weight[self.novel], weight[self.pad] = 256 - len(known), 0
        self.base = np.where(weight > 0, weight / 256, 0)
        self.spread = np.where(np.arange(n) == self.novel, max(weight[self.novel], 1), 1)  # bytes that share a symbol
        grams = {lang: self._grams(texts) for lang, texts in sample.items()}
        # States: the empty context, then all contexts of each order that any language has seen.
        contexts = [np.unique(np.concatenate([np.unique(grams[lang][k][0] // n) for lang in self.languages])) for k in range(order + 1)]
        first = np.cumsum([0] + [len(c) for c in contexts])
        self.dense = int(first[-1]) * n * len(self.languages) * 4 + 4 * n**order <= dense_bytes
        if self.dense:
            self.cost = np.empty((int(first[-1]) * n, len(self.languages)), np.float32)
            for at, lang in enumerate(self.languages):
                for k, lo, below, _ in self._orders(grams[lang], contexts):
                    row = (first[k] + lo) * n
                    self.cost[row : row + below.size, at] = self._bits(below / self.spread).ravel()
            # The state of every possible context of ORDER symbols: its longest suffix that is a state.
            self.state = np.zeros(n**order, np.int32)
            for lo in range(0, n**order, PIECE):
                state = self.state[lo : lo + PIECE]
                for k in range(1, order + 1):
                    suffix = np.arange(lo, lo + len(state)) % n**k
                    at = np.minimum(np.searchsorted(contexts[k], suffix), max(len(contexts[k]) - 1, 0))
                    hit = contexts[k][at] == suffix
                    state[hit] = (first[k] + at)[hit]
        else:
            self.tables = []
            for lang in self.languages:
                own = [np.unique(codes // n) for codes, _ in grams[lang]]
                codes = [codes for codes, _ in grams[lang]]
                self.tables.append([(a, np.empty(len(a), np.float32), c, np.empty(len(c), np.float32)) for a, c in zip(codes, own, strict=True)])
                for k, lo, below, escape in self._orders(grams[lang], own):
                    _, bits, c, escapes = self.tables[-1][k]
                    hi = lo + len(below)
                    a, b = np.searchsorted(codes[k], [c[lo] * n, (c[hi - 1] + 1) * n])
                    part = codes[k][a:b]
                    bits[a:b] = self._bits(below[np.searchsorted(c, part // n) - lo, part % n] / self.spread[part % n])
                    escapes[lo:hi] = self._bits(escape)

    @staticmethod
    def _bits(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            bits = -np.log2(p)
        return np.where(np.isfinite(bits), bits, 0)

    def _orders(self, grams: list, contexts: list[np.ndarray]):
        """(order, first context, probabilities (context, symbol), what a symbol not seen has of its probability one order lower), some contexts at a time."""
        n, below, step = self.n, self.base[None], max(1, PIECE // self.n)
        for k, ((codes, counts), c) in enumerate(zip(grams, contexts, strict=True)):
            parts = []
            for lo in range(0, len(c), step):
                own = c[lo : lo + step]
                a, b = np.searchsorted(codes, [own[0] * n, (own[-1] + 1) * n])
                freq = np.zeros((len(own), n), np.float32)
                freq[np.searchsorted(own, codes[a:b] // n), codes[a:b] % n] = counts[a:b]
                kinds, total = (freq > 0).sum(1, keepdims=True), freq.sum(1, keepdims=True, dtype=np.float64)
                parent = np.zeros(len(own), int) if k <= 1 else np.searchsorted(contexts[k - 1], own % n ** (k - 1))
                p = below[parent] if k else np.repeat(below, len(own), 0)
                rest = np.where(freq > 0, 0, p)
                mass = rest.sum(1, keepdims=True)
                escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1)
                share = np.divide(escape, mass, out=np.zeros_like(mass), where=mass > 0)
                full = np.where((total > 0) & (mass <= 0), freq / np.maximum(total, 1), freq / np.maximum(total + kinds, 1) + rest * share)
                full = np.where(total > 0, full, p)
                if k < self.order:  # the next order's contexts look into it
                    parts.append(full)
                yield k, lo, full, share[:, 0]
            if k < self.order:
                below = np.concatenate(parts)

    def _grams(self, texts: list[bytes]):
        """For each order the codes of (context, symbol) and their counts."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))] * (self.order + 1)
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= PIECE or i == len(texts) - 1:
                out = [self._summed(a, b) for a, b in zip(out, self._grams_of(texts[lo : i + 1]), strict=True)]
                lo, size = i + 1, 0
        return out

    @staticmethod
    def _summed(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        codes = np.union1d(a[0], b[0])
        counts = np.zeros(len(codes), np.int64)
        for own, n in (a, b):
            counts[np.searchsorted(codes, own)] += n
        return codes, counts

    def _grams_of(self, texts: list[bytes]):
        n, out = self.n, []
        lead = np.full(self.order, self.pad, np.int64)
        s = np.concatenate([x for t in texts for x in (lead, self.symbol[np.frombuffer(t, np.uint8)].astype(np.int64))])
        real = s[self.order :] != self.pad
        parts = [s[self.order - k : len(s) - k] for k in range(self.order + 1)]
        for k in range(self.order + 1):
            code = parts[0].copy()
            for j in range(1, k + 1):
                code += parts[j] * n**j
            # A context's oldest symbol has the highest place value.
            out.append(np.unique(code[real], return_counts=True))
        return out

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits (texts, languages) of the texts data[starts[i]:starts[i + 1]]."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        n, order = self.n, self.order
        inner = starts[:-1][starts[:-1] < starts[1:]]  # of texts that aren't empty
        number = np.flatnonzero(starts[:-1] < starts[1:])
        for lo in range(int(starts[0]), int(starts[-1]), PIECE):
            hi = min(lo + PIECE, int(starts[-1]))
            back = min(order, lo - int(starts[0]))
            s = self.symbol[data[lo - back : hi]].astype(np.int32)
            code = np.zeros(hi - lo, np.int32)
            a, b = np.searchsorted(inner, [lo - order, hi])
            for j in range(1, order + 1):
                prev = np.full(hi - lo, self.pad, np.int32)
                prev[max(0, j - back) :] = s[max(0, back - j) : back + hi - lo - j]
                for i in range(j):  # what lies before a text's start is not its context
                    at = inner[a:b] + i - lo
                    prev[at[(at >= 0) & (at < hi - lo)]] = self.pad
                code += prev * np.int32(n ** (j - 1))
            first = max(int(np.searchsorted(inner, lo, "right")) - 1, 0)
            cuts = np.maximum(inner[first : np.searchsorted(inner, hi)] - lo, 0)
            own = number[first : first + len(cuts)]
            if self.dense:
                out[own] += np.add.reduceat(self.cost[self.state[code] * n + s[back:]], cuts, axis=0, dtype=np.float64)
            else:
                for at, table in enumerate(self.tables):
                    out[own, at] += np.add.reduceat(self._sparse(table, code, s[back:]), cuts)
        return out

    def _sparse(self, table: list, code: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Bits of each symbol after the context of ORDER symbols that code holds, under one language."""
        n, out, left = self.n, np.zeros(len(code)), np.arange(len(code))
        for k in range(self.order, -1, -1):
            codes, bits, contexts, escapes = table[k]
            context = code[left].astype(np.int64) % n**k
            key = context * n + symbol[left]
            at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
            hit = codes[at] == key
            out[left[hit]] += bits[at[hit]]
            left, context = left[~hit], context[~hit]
            if len(left):
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                out[left] += np.where(contexts[at] == context, escapes[at], 0)
        out[left] += 8  # no context has seen the byte: all 256 are alike
        return out


def predict_with(model, names: list[str]):
    """An Arrow map that adds lang_pred, score and bits_per_byte to batches with text and letters."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for whole in batches:
            for batch in slices(whole, "text"):
                text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
                starts = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
                letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                if m.languages and len(text):
                    bits = m.bits(data, starts)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    per = bits.min(1) / np.maximum(np.diff(starts), 1)
                    lang = np.where(letters, np.array(m.languages, object)[best], "und")
                    score, per = np.where(letters, score, 0.0), np.where(letters, per, 0.0)
                else:
                    lang, score, per = np.full(len(text), "und", object), np.zeros(len(text)), np.zeros(len(text))
                kept = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(per)], names=[*names, "lang_pred", "score", "bits_per_byte"])
            give_back()

    return predict


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every row of docs, by a model of labelled (text, lang)."""
    return apply_model(docs.select("doc_id", F.col("text").cast("string").alias("text")), labelled, train_bytes).drop("text")


def apply_model(docs: DataFrame, labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """All columns of docs, which has text, with lang_pred, score and bits_per_byte."""
    model = docs.sparkSession.sparkContext.broadcast(Model(training_sample(labelled, train_bytes)))
    give_back()  # what building it took of the driver's memory
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    with_letters = docs.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return with_letters.mapInArrow(predict_with(model, names), f"{kinds}, lang_pred string, score double, bits_per_byte double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return apply_model(out, docs.filter(~held_out())).drop("text")


#: A document is rejected if it has no letters or if its best code length is beyond this many
#: bits a byte, where no learned language predicts it better than chance.
REJECT_BITS = 7.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a language, with all their columns; lang stays as it is.

    Null and empty texts, and texts without letters, have none and go; rows that repeat stay or
    go together; without labels every document goes; an empty table gives an empty one.
    """
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*others).alias("row"), F.col("text").cast("string").alias("text"))
    found = apply_model(row, docs.filter(~held_out()))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= REJECT_BITS))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
