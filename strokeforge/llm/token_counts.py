"""Token counts by a digest cache.

A cache table holds (version, digest, n_tokens): digest is the SHA-256 of a content, version the
SHA-256 of the tokenizer's file and the way it is called. Contents are joined to it by digest;
only distinct contents that it lacks are encoded, once each, and appended. The normalisation of
a content is the one that no tokenizer can tell apart: null becomes empty.

Defined results: a null text counts as empty, with 0 bytes and what the tokenizer makes of an
empty text; equal texts share one cache row; rows that repeat are each returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, exists, few, give_back, hot_join, materialize, scratch, slices, stored, text_or_empty

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text in one call of the tokenizer, which bounds what it holds.
CALL_BYTES = 1 << 20
CACHE = "version string, digest binary, n_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """A digest of the file and of how it is called; another file or call never meets this one's counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens added|no truncation|no padding|1").hexdigest()


def counter(path: str):
    """list of texts -> list of token counts, by the library that the file's ending names."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        count = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        return WordCounter(count) if WordCounter.suits(path) else count
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {path}")


class WordCounter:
    """Counts for the lower-casing word-end BPE, which encodes each pre-token by itself.

    In texts of the characters below LATIN_END (each its own composed form, as its small letter is), pre-tokens
    are told by plain character classes; the library counts each distinct one once and a bounded
    memory keeps it. Other texts, and those that might hold a special token, go to the library whole.
    """

    LATIN_END = 0x180
    # A dotted capital I becomes two characters, one of them beyond LATIN_END.
    OUTSIDE = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]|\u0130|<\\|")
    KEPT, RECENT, LONGEST = 500_000, 200_000, 64

    def __init__(self, count):
        self.count = count
        kinds = {k: "".join(re.escape(chr(c)) for c in range(self.LATIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        spaces = "\t-\r \x85\xa0"
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{spaces}{kinds['L']}{kinds['N']}]+").findall
        self.known: dict[str, int] = {}
        self.recent: dict[str, int] = {}

    @staticmethod
    def suits(path: str) -> bool:
        """Whether a tokenizer file says to normalise and split as this class does."""
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        steps = [n.get("type") for n in (t.get("normalizer") or {}).get("normalizers", [])]
        split = (t.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        return (
            steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and split.get("behavior") == "Removed"
            and bool(split.get("invert")) and t.get("post_processor") is None and all(a["content"].startswith("<|") for a in t.get("added_tokens") or [])
        )

    def __call__(self, texts: list[str]) -> list[int]:
        plain = [None if self.OUTSIDE.search(x) else self.words(x.lower()) for x in texts]
        known, recent = self.known, self.recent
        new = list({w for words in plain if words for w in words if w not in known and w not in recent})
        if len(recent) + len(new) > self.RECENT:
            recent.clear()
            new = list({w for words in plain if words for w in words if w not in known})
        fresh = dict(zip(new, self.count(new), strict=True)) if new else {}
        held = [x for x in fresh.items() if len(x[0]) <= self.LONGEST]
        room = max(self.KEPT - len(known), 0)
        known.update(held[:room])
        recent.update(held[room:])
        get = lambda w: known.get(w) or recent.get(w) or fresh[w]  # noqa: E731  a pre-token has one token at least
        whole = [i for i, w in enumerate(plain) if w is None]
        out = [0 if w is None else sum(map(get, w)) for w in plain]
        for i, n in zip(whole, self.count([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = n
        return out


_counters: dict = {}


def encode_with(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _counters:
            _counters[version] = counter(path)
        count = _counters[version]
        seen: set[bytes] = set()  # rows that repeat a document
        for batch in batches:
            new = [not (d in seen or seen.add(d)) for d in batch.column("digest").to_pylist()]
            for part in slices(batch.filter(pa.array(new, pa.bool_())), "text", CALL_BYTES):
                counts = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(counts), pa.string()), part.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"]
                )
            give_back()

    return encode


def token_counts(docs: DataFrame, cache: str, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; cache is a Parquet folder that grows with each call."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = version_of(path)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id")
    texts = docs.select("doc_id", text_or_empty("text").alias("text"))
    keys = stored(texts.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes")))
    total = keys.count()
    distinct = materialize(keys.select("digest", least).groupBy("digest").agg(F.min("_id").alias("_id"), F.count("*").alias("n")), "token-digests", few(total))
    misses = distinct
    if exists(spark, cache):
        known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).select("digest").distinct()
        misses = materialize(distinct.join(known, "digest", "left_anti"), "token-misses", few(total))
    # A content's text comes from the rows of its lowest document: no more of them than rows with the digest.
    with_text = hot_join(texts.select(least, digest, "text"), misses, ["digest", "_id"], "n", total)
    with_text.select("digest", "text").mapInArrow(encode_with(path, version), CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = materialize(distinct.select("digest", "n").join(counts, "digest"), "token-counted", few(total))
    return hot_join(keys, counted, ["digest"], "n", total).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a cache of its own that starts empty, so that every distinct content is encoded in this call."""
    return token_counts(documents(spark, sf_dir), scratch(spark, "token-cache"))
