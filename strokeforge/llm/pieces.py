"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model is compiled into three transducers. N, the normaliser, maps a text to the model's
alphabet: white space becomes U+2581 and one is put before the text. L, the lexicon, is the
closure of all pieces, a trie whose final states write a piece. B writes the byte pieces of a
character that is no piece. A weight is a cost in the tropical semiring. For a unigram model L's
arcs weigh minus a piece's score. For a BPE model the state of L also holds the last piece
written, and an arc weighs nothing if merging the two pieces' characters by the model's scores
gives these two pieces again, else infinity: a path of finite weight has only such neighbours,
which is what merging leaves, and there is exactly one (a merge across a boundary needs no more
than its two pieces to happen). These weights are computed as compositions ask for them.

An input is composed with N, L and B lazily and its shortest path is found position by
position. Where no piece holds a boundary inside, paths join, so an input splits there into
segments whose paths are independent; the paths of segments met before are remembered, a bounded
number of them in a worker. Decoding runs the transducers backwards.

Defined results: a null text is encoded as empty, an empty text as no pieces; rows that repeat
are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMORY, RECENT = 350_000, 100_000
#: Longer segments are not remembered, which bounds the memory's bytes.
LONGEST = 64
#: What a unigram model's path pays for a character that is no piece.
UNKNOWN_COST = 1e6
#: Bytes of text in a batch of results.
BATCH = 4 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Paths(dict):
    """Segment -> its path's ids. The first MEMORY segments stay; later ones are forgotten together, RECENT at a time."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.recent = transducer, {}

    def __missing__(self, segment: str) -> bytes:
        path = self.recent.get(segment)
        if path is None:
            t = self.transducer
            if segment[-2:] in t.ends:
                path = self[segment[:-1]] + self[segment[-1]]
            else:
                path = np.array(t.shortest(segment.replace(" ", SPACE)), "<i4").tobytes()
            if len(segment) > LONGEST:
                pass
            elif len(self) < MEMORY:
                self[segment] = path
            else:
                if len(self.recent) >= RECENT:
                    self.recent.clear()
                self.recent[segment] = path
        return path


class Transducer:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int, bpe: bool, prefix: bool = True):
        """pieces: text -> (id, score). byte_ids: the ids of the 256 byte pieces, if the model has them."""
        self.bpe, self.prefix, self.unknown, self.byte_ids = bpe, prefix, unknown, byte_ids
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.trie: dict[str, int] = {}
        for p in pieces:
            for n in range(1, len(p)):
                self.trie.setdefault(p[:n], -1)
        self.trie |= {p: i for p, (i, _) in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        self.weights: dict[tuple[int, int], bool] = {}
        self.out = {i: p.replace(SPACE, " ").encode() for i, p in self.text.items()} | {b: bytes([n]) for n, b in enumerate(byte_ids or [])}
        self.out.setdefault(unknown, " ⁇ ".encode())
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            self.segment = re.compile(r"(?s).+")
        else:
            self.segment = re.compile(rf" *[^ {alone}]+| +" + (f"|[{alone}]" if alone else ""))
        # A mark that ends a segment is a segment of its own where no piece has it after the letter before.
        pairs = {x for p in pieces for x in zip(p, p[1:], strict=False)}
        self.ends = {chr(c) + q for q in ".,;:!?" for c in range(97, 123) if (chr(c), q) not in pairs}
        self.paths = Paths(self)

    @classmethod
    def load(cls, path: str) -> Transducer:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind not in (1, 2):
            raise ValueError("only unigram and BPE models with the identity normaliser are compiled")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        ids = range(sp.get_piece_size())
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not special(i)}
        by = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        return cls(pieces, by, sp.unk_id(), kind == 2, norm.add_dummy_prefix)

    def merged(self, s: str) -> list[str]:
        """s merged from characters: always the adjacent pair of the best score, the leftmost of equals."""
        parts = list(s)
        while True:
            best = max(((self.score[x], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (x := a + b) in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def admits(self, a: int, b: int) -> bool:
        """Whether the arc that writes piece b after piece a has a finite weight (BPE)."""
        known = self.weights.get((a, b))
        if known is None:
            if len(self.weights) >= 4 * MEMORY:
                self.weights.clear()
            p, q = self.text.get(a, ""), self.text[b]
            known = self.weights[a, b] = self.merged(p + q) == [x for x in (p, q) if x]
        return known

    def shortest(self, s: str) -> list[int]:
        """The pieces on the shortest path of a normalised segment."""
        ends = self._only(s) if self.bpe else self._best(s)
        out: list[int] = []
        for c, p in ends:
            if p >= 0:
                out.append(p)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in c.encode()]
            else:
                out.append(self.unknown)
        return out

    def _arcs(self, s: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs from position i, short ones first; piece -1 where B writes the character."""
        trie, out = self.trie, []
        for j in range(i + 1, min(len(s), i + self.longest) + 1):
            p = trie.get(s[i:j])
            if p is None:
                break
            if p >= 0:
                out.append((j, p))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, -1))
        return out

    def _only(self, s: str) -> list[tuple[str, int]]:
        """BPE: the one path of finite weight, depth first. A position is reached with one state at most,
        that of its prefix's own path, so one that led nowhere is not tried again."""
        admits, n, dead = self.admits, len(s), set()
        stack = [(0, -1, self._arcs(s, 0))]
        while stack:
            i, a, arcs = stack[-1]
            while arcs:
                j, p = arcs.pop()
                if j not in dead and (p < 0 or admits(a, p)):
                    stack.append((j, p, self._arcs(s, j) if j < n else []))
                    break
            else:
                if i == n:
                    return [(s[x[0]], y[1]) for x, y in zip(stack, stack[1:], strict=False)]
                dead.add(i)
                stack.pop()
        raise AssertionError("no path")

    def _best(self, s: str) -> list[tuple[str, int]]:
        """Unigram: relaxation in the order of positions."""
        n, inf = len(s), float("inf")
        cost, by = [0.0] + [inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            for j, p in self._arcs(s, i):
                w = cost[i] + (UNKNOWN_COST if p < 0 else -self.score[s[i:j]])
                if w < cost[j]:
                    cost[j], by[j] = w, (i, p)
        out = []
        while n:
            i, p = by[n]
            out.append((s[i], p))
            n = i
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        return b"".join(map(self.paths.__getitem__, self.segment.findall(f" {text}" if self.prefix else text)))

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids in UTF-8; what isn't UTF-8 becomes U+FFFD."""
        out = b"".join(map(self.out.__getitem__, ids))
        if self.prefix and out[:1] == b" ":
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="replace").encode()
        return out


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer.load(path)
    return _loaded[path]


OUT = "doc_id long, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_with(path: str, with_text: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            held, size = [], 0
            for doc, s in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = s.as_py() or ""
                raw = t.encode(text)
                back = t.decode(np.frombuffer(raw, "<i4").tolist())
                own = text.encode()
                held.append((doc, raw, hashlib.sha256(raw).hexdigest(), back, back == own))
                size += len(own)
                if size >= BATCH:
                    yield result(held, with_text)
                    held, size = [], 0
            if held:
                yield result(held, with_text)

    return encode


def result(held: list, with_text: bool) -> pa.RecordBatch:
    counts = np.array([len(h[1]) // 4 for h in held], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(h[1] for h in held))])
    cols = [
        pa.array([h[0] for h in held], pa.int64()), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([h[2] for h in held]),
        pa.array([hashlib.sha256(h[3]).hexdigest() for h in held]), pa.array([h[4] for h in held]),
    ]
    names = ["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "round_trip"]
    return pa.RecordBatch.from_arrays(cols + ([pa.array([h[3].decode() for h in held])] if with_text else []), names=names + ["decoded"] * with_text)


def encode_documents(docs: DataFrame, model: str | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, token_ids and their count and digest, and the digest of what they decode to (with_text: and it) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode_with(model or model_path(), with_text), OUT + ", decoded string" * with_text)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of docs as pieces; a null text is encoded as empty, rows that repeat are each returned, an empty table gives an empty one."""
    return encode_documents(docs)
